"""Null defaults and description cleaning of a whole ticket table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.text import clean_description
from ticketlens.schema import NULL_DEFAULTS


def fill_defaults(df: DataFrame) -> DataFrame:
    """Null cells become the default of their column; an absent column is added with it."""
    absent = {c: F.lit(v) for c, v in NULL_DEFAULTS.items() if c not in df.columns}
    present = {c: v for c, v in NULL_DEFAULTS.items() if c in df.columns}
    return df.na.fill(present).withColumns(absent)


def clean_tickets(df: DataFrame, min_desc_chars: int = 20) -> DataFrame:
    """Adds the cleaned description, its length and whether it is long enough for themes."""
    return (
        fill_defaults(df)
        .withColumn("Description_clean", clean_description(F.col("Description")))
        .withColumn("Description_clean_len", F.length("Description_clean"))
        .withColumn("NLP_Eligible", F.col("Description_clean_len") >= min_desc_chars)
    )
