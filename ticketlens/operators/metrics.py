"""Operational metrics of tickets.

Tables that the report needs together are split into a grouping step and a finishing
step: the operators here do both, the report runs one grouping for all of
them and then the same finishing steps (see `ticketlens.plans.report`).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ticketlens.functions.buckets import BUCKET_LABELS, aging_bucket
from ticketlens.functions.dates import day_text, hours_between
from ticketlens.functions.text import trim_lower
from ticketlens.schema import FACETS, MONTH_COLUMN

# --- Fixed value: statuses of tickets that wait for the client ---------------
PENDING_CLIENT = r"pend(?:ie|e).*cliente"
# The same with the one spelling that finds only statuses that begin with PENDE.
PENDING_CLIENT_LITERAL = r"pende.*cliente"

HISTOGRAM_BINS = 30

# --- Fixed values: inner edges, in hours, of the bins that do not depend on the data ------
HOUR_EDGES = [1, 2, 4, 8, 12, 24, 48, 72, 120, 168, 336, 720, 1440, 2160, 4320, 8760]


# --- Fixed values: columns that a ticket table may lack ------------------------
OPTIONAL_TYPES = {
    "Agencia": "string",
    "ResolvedDate": "string",
    "resolution_effective_dt": "timestamp_ntz",
    "resolution_time_hours": "double",
    "aging_hours": "double",
}


def with_absent_columns(df: DataFrame) -> DataFrame:
    """`df` with the optional columns that it lacks as nulls.

    Without them the operators give empty tables or zeros of the usual schema.
    """
    absent = {c: kind for c, kind in OPTIONAL_TYPES.items() if c not in df.columns}
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in absent.items()})


# --- predicates and filters --------------------------------------------------


def is_closed(status: Column) -> Column:
    """Exactly `Done`, as the KPIs and the open-ticket buckets count it."""
    return status.eqNullSafe("Done")


def is_done(status: Column) -> Column:
    """`done` whatever its case and surrounding blanks, as the time metrics count it."""
    return trim_lower(status).eqNullSafe("done")


def is_pending_client(status: Column, pattern: str = PENDING_CLIENT) -> Column:
    return trim_lower(status).rlike(pattern)


def apply_filters(
    df: DataFrame,
    date_range: tuple | None = None,
    statuses: Iterable[str] | None = None,
    tipos: Iterable[str] | None = None,
    reporters: Iterable[str] | None = None,
    agencias: Iterable[str] | None = None,
) -> DataFrame:
    """Tickets created in the date range (both days included) that match every list given.

    Bounds are cast to the type of `Created_dt`, so the comparison stays on the bare
    column and reaches the Parquet reader. Tables written by month are also pruned to
    the months of the range.
    """
    if date_range and "Created_dt" in df.columns:
        start, end = (_as_datetime(d) for d in date_range)
        end = end + dt.timedelta(days=1) - dt.timedelta(seconds=1)
        ts_type = df.schema["Created_dt"].dataType
        bounds = [F.lit(str(d)).cast(ts_type) for d in (start, end)]
        df = df.where(F.col("Created_dt").between(*bounds))
        if MONTH_COLUMN in df.columns:
            months = [d.year * 100 + d.month for d in (start, end)]
            df = df.where(F.col(MONTH_COLUMN).between(*months))
    for column, wanted in zip(FACETS, (statuses, tipos, reporters, agencias)):
        wanted = list(wanted or [])
        if wanted:
            df = df.where(F.col(column).isin(wanted))
    return df


def _as_datetime(value) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime.combine(value, dt.time())
    return dt.datetime.fromisoformat(str(value))


def facet_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of one column."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def all_facet_values(df: DataFrame) -> DataFrame:
    """Distinct values of every facet in one pass, as (facet, value)."""
    return (
        grouped_by_each(df.select(FACETS), FACETS)
        .where(F.col("slice") != "")
        .select(F.col("slice").alias("facet"), F.col("key").alias("value"))
        .orderBy("facet", "value")
    )


def grouped_by_each(
    df: DataFrame, keys: list[str], *aggregates: Column, within: Iterable[str] = ()
) -> DataFrame:
    """`df` grouped by each text column on its own and as a whole, in one pass.

    Returns (columns of `within`, slice, key, aggregates): `slice` names the column whose value is `key`,
    and is empty for the row of totals. Null values form no group. Every row is turned into
    one short (number, value) pair per column, which hashes faster than the wide,
    mostly empty keys of grouping sets.
    """
    names = ["", *keys]
    values = [F.lit(""), *[F.col(key) for key in keys]]
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("slice"), value.alias("key"))
            for i, value in enumerate(values)
        ]
    )
    grouped = (
        df.select("*", F.inline(pairs))
        .where(F.col("key").isNotNull())
        .groupBy(*within, "slice", "key")
    )
    rows = grouped.agg(*aggregates) if aggregates else grouped.count().drop("count")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("slice") + 1)
    return rows.withColumn("slice", name)


def date_bounds(df: DataFrame) -> DataFrame:
    """First and last day of creation."""
    return df.agg(
        F.to_date(F.min("Created_dt")).alias("min_date"),
        F.to_date(F.max("Created_dt")).alias("max_date"),
    )


# --- derived times -----------------------------------------------------------


def add_time_metrics(df: DataFrame, now_ts=None) -> DataFrame:
    """Adds the effective resolution, its day, and resolution, aging and touch hours."""
    now = F.localtimestamp() if now_ts is None else F.lit(str(now_ts))
    now = now.cast("timestamp_ntz")
    missing_ts = F.lit(None).cast("timestamp_ntz")
    created, resolved, updated = (
        F.col(c) if c in df.columns else missing_ts
        for c in ("Created_dt", "Resolution_dt", "Last_Updated_dt")
    )
    done = is_done(F.col("Status")) if "Status" in df.columns else F.lit(False)
    effective = F.coalesce(resolved, F.when(done, updated))
    return df.withColumns(
        {
            "resolution_effective_dt": effective,
            "resolution_time_hours": hours_between(created, effective),
            "ResolvedDate": day_text(effective),
            "aging_hours": F.when(~done, hours_between(created, now)),
            "touch_time_hours": hours_between(created, updated),
        }
    )


# --- key figures -------------------------------------------------------------

KPI_KEYS = ["Date", "Tipo", "Agencia"]


def kpis(df: DataFrame) -> DataFrame:
    """One row of key figures, from a single pass over the tickets."""
    if "Agencia" not in df.columns:
        df = df.withColumn("Agencia", F.lit("N/A"))
    pruned = df.select(
        "Date",
        F.coalesce("Tipo", F.lit("Unknown")).alias("Tipo"),
        F.coalesce("Agencia", F.lit("Unknown")).alias("Agencia"),
        (~is_closed(F.col("Status"))).alias("is_open"),
    )
    return finish_kpis(
        grouped_by_each(
            pruned,
            KPI_KEYS,
            F.count(F.lit(1)).alias("tickets"),
            F.count_if("is_open").alias("open_tickets"),
        )
    )


def finish_kpis(grouped: DataFrame) -> DataFrame:
    def of_slice(name: str, value: Column) -> Column:
        return F.when(F.col("slice") == name, value)

    def most_common(name: str) -> Column:
        order = of_slice(name, F.struct(-F.col("tickets"), F.col("key")))
        return F.coalesce(F.min_by("key", order), F.lit("N/A"))

    totals = grouped.where(F.col("slice").isin([""] + KPI_KEYS)).agg(
        F.coalesce(F.max(of_slice("", F.col("tickets"))), F.lit(0)).alias("total"),
        F.coalesce(F.max(of_slice("", F.col("open_tickets"))), F.lit(0)).alias("open"),
        F.greatest(F.count(of_slice("Date", F.col("key"))), F.lit(1)).alias("days"),
        most_common("Tipo").alias("top_tipo"),
        most_common("Agencia").alias("top_agencia"),
    )
    total, still_open = F.col("total"), F.col("open")
    return totals.select(
        total.alias("total_tickets"),
        still_open.alias("open_tickets"),
        F.when(total > 0, F.round((total - still_open) / total * 100, 2))
        .otherwise(0.0)
        .alias("pct_done"),
        F.round(total / F.col("days"), 2).alias("avg_tickets_day"),
        "top_tipo",
        "top_agencia",
    )


def sla_compliance(df: DataFrame, threshold_hours: float = 48.0) -> DataFrame:
    """One row: resolved tickets, those within the threshold, and their share."""
    df = with_absent_columns(df)
    hours = F.col("resolution_time_hours")
    return finish_sla(
        df.agg(
            F.count(hours).alias("resolved_count"),
            F.count_if(hours <= float(threshold_hours)).alias("within_sla_count"),
        )
    )


def finish_sla(counts: DataFrame) -> DataFrame:
    resolved, within = F.col("resolved_count"), F.col("within_sla_count")
    return counts.select(
        F.when(resolved > 0, F.round(within / resolved * 100, 2))
        .otherwise(0.0)
        .alias("sla_pct"),
        resolved,
        within,
    )


# --- volumes -----------------------------------------------------------------


def tickets_per_day(df: DataFrame) -> DataFrame:
    """Tickets per day of creation and their mean over seven rows."""
    return finish_tickets_per_day(
        df.groupBy("Date").agg(F.count(F.lit(1)).alias("tickets"))
    )


def finish_tickets_per_day(daily: DataFrame) -> DataFrame:
    # One window over all rows: there is one row per calendar day, however many tickets.
    last_seven = W.orderBy("Date").rowsBetween(-6, 0)
    return (
        daily.where(F.col("Date").isNotNull())
        .select(F.to_date("Date").alias("Date"), "tickets")
        .withColumn("rolling_7d", F.avg("tickets").over(last_seven))
        .orderBy("Date")
    )


def count_by_column(df: DataFrame, column: str, top_n: int | None = None) -> DataFrame:
    """Tickets per value, most frequent first; equal counts in order of value."""
    if column not in df.columns:
        schema = T.StructType(
            [T.StructField(column, T.StringType()), T.StructField("count", T.LongType())]
        )
        return df.sparkSession.createDataFrame([], schema)
    value = F.coalesce(column, F.lit("Unknown")).alias(column)
    return finish_count_by_column(
        df.groupBy(value).agg(F.count(F.lit(1)).alias("count")), column, top_n
    )


def finish_count_by_column(
    counts: DataFrame, column: str, top_n: int | None = None
) -> DataFrame:
    ordered = counts.orderBy(F.desc("count"), column)
    return ordered if top_n is None else ordered.limit(top_n)


def created_vs_resolved_per_day(df: DataFrame) -> DataFrame:
    """Tickets created and tickets resolved on each day that has either.

    Every ticket yields up to two day events, counted in one grouping instead of
    two groupings and an outer join.
    """
    df = with_absent_columns(df)
    events = F.array(
        F.struct(F.col("Date").alias("Date"), F.lit(True).alias("is_created")),
        F.struct(
            F.when(
                F.col("resolution_effective_dt").isNotNull(), F.col("ResolvedDate")
            ).alias("Date"),
            F.lit(False).alias("is_created"),
        ),
    )
    return finish_created_vs_resolved(
        df.select(F.inline(events))
        .where(F.col("Date").isNotNull())
        .groupBy("Date")
        .agg(
            F.count_if("is_created").alias("created"),
            F.count_if(~F.col("is_created")).alias("resolved"),
        )
    )


def finish_created_vs_resolved(counts: DataFrame) -> DataFrame:
    return counts.select(
        F.to_date("Date").alias("Date"), "created", "resolved"
    ).orderBy("Date")


# --- resolution times --------------------------------------------------------


def _resolved(df: DataFrame) -> DataFrame:
    return with_absent_columns(df).where(F.col("resolution_time_hours").isNotNull())


def _mean_hours(df: DataFrame, key: str) -> DataFrame:
    mean = F.avg("resolution_time_hours").alias("avg_resolution_time_hours")
    return _resolved(df).where(F.col(key).isNotNull()).groupBy(key).agg(mean)


def avg_resolution_time_over_time(df: DataFrame) -> DataFrame:
    """Mean resolution hours per day of resolution."""
    return finish_avg_over_time(_mean_hours(df, "ResolvedDate"))


def finish_avg_over_time(means: DataFrame) -> DataFrame:
    return means.select(
        F.to_date("ResolvedDate").alias("ResolvedDate"), "avg_resolution_time_hours"
    ).orderBy("ResolvedDate")


def resolution_time_by_tipo(df: DataFrame) -> DataFrame:
    """Mean resolution hours per request type, slowest first."""
    return finish_by_tipo(_mean_hours(df, "Tipo"))


def finish_by_tipo(means: DataFrame) -> DataFrame:
    return means.orderBy(F.desc("avg_resolution_time_hours"), "Tipo")


def resolution_time_distribution(df: DataFrame) -> DataFrame:
    """The resolution hours that exist, one row per resolved ticket."""
    return _resolved(df).select("resolution_time_hours")


def resolution_time_histogram(
    df: DataFrame, bins: int = HISTOGRAM_BINS, bounds: DataFrame | None = None
) -> DataFrame:
    """Counts of resolution hours in equal-width bins from least to greatest, zeros included.

    `bounds` is a one-row frame (lo, hi); given, it saves the pass that finds them.
    """
    df = with_absent_columns(df)
    hours = F.col("resolution_time_hours")
    if bounds is None:
        bounds = df.agg(F.min(hours).alias("lo"), F.max(hours).alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    # width_bucket puts the top edge in bin bins + 1 and gives null for an empty range.
    bucket = F.width_bucket(hours, F.col("lo"), F.col("hi"), F.lit(bins))
    bin_of = F.least(F.coalesce(bucket, F.lit(1)), F.lit(bins))
    counts = (
        _resolved(df)
        .select(hours, lo.alias("lo"), hi.alias("hi"))
        .groupBy(bin_of.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    width = (F.col("hi") - F.col("lo")) / bins
    every_bin = df.sparkSession.range(1, bins + 1).select(
        F.col("id").cast("int").alias("bin"), lo.alias("lo"), hi.alias("hi")
    )
    return (
        every_bin.where(F.col("lo").isNotNull())
        .join(counts, "bin", "left")
        .select(
            "bin",
            (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_start"),
            (F.col("lo") + F.col("bin") * width).alias("bin_end"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
        .orderBy("bin")
    )


def fixed_bin(hours: Column) -> Column:
    """Number, from 1, of the bin between HOUR_EDGES; a bin holds its lower edge. Null stays null."""
    passed = sum((F.when(hours >= edge, 1).otherwise(0) for edge in HOUR_EDGES), F.lit(1))
    return F.when(hours.isNotNull(), passed)


def finish_fixed_bins(counts: DataFrame) -> DataFrame:
    """All bins in order, zeros included; no rows when every count is zero.

    `counts` has (bin, count). The last bin has no end.
    """
    wide = counts.agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("held")
    ).where(F.size("held") > 0)
    starts = [0.0, *map(float, HOUR_EDGES)]
    bins = F.array(
        *[
            F.struct(
                F.lit(i).alias("bin"),
                F.lit(start).alias("bin_start"),
                F.lit(end).cast("double").alias("bin_end"),
                F.coalesce(F.try_element_at("held", F.lit(i)), F.lit(0)).alias("count"),
            )
            for i, (start, end) in enumerate(zip(starts, [*starts[1:], None]), 1)
        ]
    )
    return wide.select(F.inline(bins)).orderBy("bin")


def resolution_time_bins(df: DataFrame) -> DataFrame:
    """Counts of resolution hours between fixed edges, zeros included, so that tables can be added up."""
    hours = F.col("resolution_time_hours")
    return finish_fixed_bins(
        _resolved(df).groupBy(fixed_bin(hours).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    )


# --- aging -------------------------------------------------------------------


def _count_buckets(df: DataFrame, bucket: Column) -> DataFrame:
    df = with_absent_columns(df)
    counts = df.select(bucket.alias("aging_bucket")).where("aging_bucket is not null")
    return finish_buckets(
        counts.groupBy("aging_bucket").agg(F.count(F.lit(1)).alias("count"))
    )


def finish_buckets(counts: DataFrame) -> DataFrame:
    """All five buckets in order, zeros included; no rows when every count is zero."""
    wide = counts.agg(
        *[
            F.coalesce(
                F.sum(F.when(F.col("aging_bucket") == label, F.col("count"))), F.lit(0)
            ).alias(label)
            for label in BUCKET_LABELS
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("aging_bucket"), F.col(f"`{label}`").alias("count")
            )
            for label in BUCKET_LABELS
        ]
    )
    total = sum((F.col(f"`{label}`") for label in BUCKET_LABELS), F.lit(0))
    # The labels sort in bucket order.
    return wide.where(total > 0).select(F.inline(rows)).orderBy("aging_bucket")


def open_aging_bucket() -> Column:
    """Bucket of an open ticket, null for all others."""
    return F.when(~is_closed(F.col("Status")), aging_bucket(F.col("aging_hours")))


def pending_aging_bucket(pattern: str = PENDING_CLIENT) -> Column:
    """Bucket of a ticket that waits for the client, null for all others."""
    return F.when(
        is_pending_client(F.col("Status"), pattern), aging_bucket(F.col("aging_hours"))
    )


def aging_buckets_open_tickets(df: DataFrame) -> DataFrame:
    """Open tickets per aging bucket, empty buckets included."""
    return _count_buckets(df, open_aging_bucket())


def client_pending_aging(df: DataFrame, pattern: str = PENDING_CLIENT) -> DataFrame:
    """Aging and bucket of every ticket that waits for the client."""
    df = with_absent_columns(df)
    waiting = is_pending_client(F.col("Status"), pattern)
    return df.where(waiting & F.col("aging_hours").isNotNull()).select(
        "aging_hours", aging_bucket(F.col("aging_hours")).alias("aging_bucket")
    )


def client_pending_aging_buckets(
    df: DataFrame, pattern: str = PENDING_CLIENT
) -> DataFrame:
    """Tickets that wait for the client per aging bucket, empty buckets included."""
    return _count_buckets(df, pending_aging_bucket(pattern))
