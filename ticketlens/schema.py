"""Names, types and default values of the ticket table."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: column names of the two export layouts -------------------
REQUIRED_COLUMNS = [
    "Summary",
    "Reporter",
    "Status",
    "Tipo",
    "Resolution",
    "Created",
    "Description",
]
OPTIONAL_COLUMNS = ["Issue Type", "Agencia", "Last Updated", "Updated"]
COLUMN_ALIASES = {
    "Custom field (Agencia que reporta)": "Agencia",
    "Custom field (Tipo de solicitud)": "Tipo",
    "Last Viewed": "Last Updated",
}

# --- Fixed values: what a null cell becomes ---------------------------------
NULL_DEFAULTS = {
    "Issue Type": "Unknown",
    "Agencia": "Unknown",
    "Summary": "",
    "Reporter": "Unknown",
    "Status": "Unknown",
    "Tipo": "Unknown",
    "Resolution": "",
    "Description": "",
}

# --- Fixed values: cell texts that stand for "missing" in a CSV export ------
# (the default missing-value markers documented for pandas.read_csv)
NA_STRINGS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Partition column of ticket tables written by month, as 202401.
MONTH_COLUMN = "created_month"

FACETS = ["Status", "Tipo", "Reporter", "Agencia"]

TICKET_SCHEMA = T.StructType(
    [T.StructField("ticket_id", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in REQUIRED_COLUMNS + OPTIONAL_COLUMNS]
    + [
        T.StructField(c, T.TimestampType())
        for c in ("Created_dt", "Resolution_dt", "Last_Updated_dt")
    ]
    + [
        T.StructField("Date", T.StringType()),
        T.StructField("ResolvedDate", T.StringType()),
        T.StructField("DayOfWeek", T.StringType()),
        T.StructField("Description_clean", T.StringType()),
        T.StructField("Description_clean_len", T.IntegerType()),
        T.StructField("NLP_Eligible", T.BooleanType()),
        T.StructField("resolution_effective_dt", T.TimestampType()),
        T.StructField("resolution_time_hours", T.DoubleType()),
        T.StructField("aging_hours", T.DoubleType()),
        T.StructField("touch_time_hours", T.DoubleType()),
    ]
)

THEME_SCHEMA = T.StructType(
    [
        T.StructField("theme_id", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("keywords", T.StringType()),
        T.StructField("example_summaries", T.StringType()),
    ]
)


def ticket_theme_schema(id_field: T.StructField) -> T.StructType:
    return T.StructType(
        [
            id_field,
            T.StructField("theme_id", T.IntegerType()),
            T.StructField("Summary", T.StringType()),
            T.StructField("Description", T.StringType()),
            T.StructField("Description_clean", T.StringType()),
            T.StructField("representative_rank", T.IntegerType()),
            T.StructField("representative_similarity", T.DoubleType()),
            T.StructField("Description_trimmed", T.StringType()),
        ]
    )
