"""All tables of the operational report from two passes over the tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.operators import metrics as m
from ticketlens.schema import MONTH_COLUMN
from ticketlens.session import reliable_checkpoint

ROLLUP_KEYS = [
    "Date",
    "Tipo",
    "Reporter",
    "Status",
    "Agencia",
    "ResolvedDate",
    "open_bucket",
    "pending_bucket",
    "raw_tipo",
]
TOP_REPORTERS = 15
TOP_AGENCIAS = 20


STATE_KEYS = [*ROLLUP_KEYS, "hours_bin"]
#: How the columns of two states of the same key become one.
MERGES = {
    "tickets": F.sum,
    "open_tickets": F.sum,
    "resolved_count": F.sum,
    "within_sla_count": F.sum,
    "hours_sum": F.sum,
    "lo": F.min,
    "hi": F.max,
}


def _grouped(
    df: DataFrame, keys: list[str], sla_threshold_hours: float, within: dict[str, Column]
) -> DataFrame:
    hours = F.col("resolution_time_hours")
    df = m.with_absent_columns(df)
    pruned = df.select(
        *[column.alias(name) for name, column in within.items()],
        "Date",
        *[F.coalesce(c, F.lit("Unknown")).alias(c) for c in m.FACETS],
        F.when(F.col("resolution_effective_dt").isNotNull(), F.col("ResolvedDate")).alias(
            "ResolvedDate"
        ),
        m.open_aging_bucket().alias("open_bucket"),
        m.pending_aging_bucket().alias("pending_bucket"),
        # Counts take a missing type as Unknown, means leave it out.
        F.col("Tipo").alias("raw_tipo"),
        m.fixed_bin(hours).cast("string").alias("hours_bin"),
        hours,
        (~m.is_closed(F.col("Status"))).alias("is_open"),
    )
    return m.grouped_by_each(
        pruned,
        keys,
        F.count(F.lit(1)).alias("tickets"),
        F.count_if("is_open").alias("open_tickets"),
        F.count(hours).alias("resolved_count"),
        F.count_if(hours <= float(sla_threshold_hours)).alias("within_sla_count"),
        F.sum(hours).alias("hours_sum"),
        F.min(hours).alias("lo"),
        F.max(hours).alias("hi"),
        within=within,
    )


def _with_means(states: DataFrame) -> DataFrame:
    mean = F.try_divide(F.col("hours_sum"), F.col("resolved_count"))
    return states.withColumn("avg_resolution_time_hours", mean)


def report_rollup(df: DataFrame, sla_threshold_hours: float = 48.0) -> DataFrame:
    """Everything the report counts or averages, grouped once.

    The result has a row per day, type, reporter, status, branch and bucket, and one of
    totals; partial aggregation shrinks it before the shuffle.
    """
    return _with_means(_grouped(df, ROLLUP_KEYS, sla_threshold_hours, {}))


def report_states(df: DataFrame, sla_threshold_hours: float = 48.0) -> DataFrame:
    """The rollup of each month of creation, in counts, sums and extremes that can be merged.

    Resolution hours are also counted between fixed edges. Tickets without a time of creation
    form a month of their own, null; no tickets give no rows.
    """
    created = F.col("Created_dt")
    month = {MONTH_COLUMN: F.year(created) * 100 + F.month(created)}
    return _grouped(df, STATE_KEYS, sla_threshold_hours, month).withColumn(
        "sla_threshold_hours", F.lit(float(sla_threshold_hours))
    )


def write_report_states(df: DataFrame, path: str, sla_threshold_hours: float = 48.0) -> None:
    """Write the states of the months in `df`, in place of those that `path` holds for them.

    Other months stay as they are, and none of them is read. `df` has to hold these months
    whole. Open tickets age: write the months of `open_months` again for buckets of today.
    """
    states = report_states(df, sla_threshold_hours).hint("rebalance", MONTH_COLUMN)
    writer = states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(MONTH_COLUMN).parquet(path)


def open_months(states: DataFrame) -> DataFrame:
    """Months with tickets that are not closed, whose aging buckets go out of date."""
    still_open = (F.col("slice") == "") & (F.col("open_tickets") > 0)
    return states.where(still_open).select(MONTH_COLUMN, "open_tickets").orderBy(MONTH_COLUMN)


def merge_states(states: DataFrame) -> DataFrame:
    """The rollup of all tickets behind `states`; fails if they have more than one SLA threshold.

    Sums of hours are added in no fixed order, so means may differ in their last bits.
    """
    merged = states.groupBy("slice", "key").agg(
        *[merge(name).alias(name) for name, merge in MERGES.items()],
        F.min("sla_threshold_hours").alias("least"),
        F.max("sla_threshold_hours").alias("most"),
    )
    differs = F.raise_error(F.lit("The states have more than one SLA threshold."))
    within = F.when(F.col("least") == F.col("most"), F.col("within_sla_count")).otherwise(differs)
    return _with_means(merged.withColumn("within_sla_count", within).drop("least", "most"))


def report_from_states(states: DataFrame) -> dict[str, DataFrame]:
    """The tables of the report from stored months, without the tickets.

    The histogram's edges depend on all tickets; `resolution_time_bins`, with fixed edges,
    stands in its place.
    """
    rollup = reliable_checkpoint(merge_states(states))
    bins = rollup.where(F.col("slice") == "hours_bin").select(
        F.col("key").cast("int").alias("bin"), F.col("tickets").alias("count")
    )
    return _tables(rollup) | {"resolution_time_bins": m.finish_fixed_bins(bins)}


def report_tables(
    df: DataFrame,
    sla_threshold_hours: float = 48.0,
    bins: int = m.HISTOGRAM_BINS,
    rollup: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The tables of the report by name.

    The rollup is computed at once and checkpointed; all tables are read off it, and only
    the histogram goes over the tickets again. A rollup computed before can be passed in.
    """
    if rollup is None:
        rollup = reliable_checkpoint(report_rollup(df, sla_threshold_hours))
    bounds = rollup.where(F.col("slice") == "").select("lo", "hi")
    histogram = m.resolution_time_histogram(df, bins, bounds)
    return _tables(rollup) | {"resolution_time_histogram": histogram}


def _tables(rollup: DataFrame) -> dict[str, DataFrame]:
    """All tables that can be read off the rollup."""

    def cut(name: str) -> DataFrame:
        return rollup.where(F.col("slice") == name)

    def counts(name: str, key: str, count: str) -> DataFrame:
        return cut(name).select(
            F.col("key").alias(key), F.col("tickets").alias(count)
        )

    def means(name: str, column: str) -> DataFrame:
        return (
            cut(name)
            .where(F.col("resolved_count") > 0)
            .select(F.col("key").alias(column), "avg_resolution_time_hours")
        )

    # Totals are re-aggregated so that an empty table still gives its row of zeros.
    sla = cut("").agg(
        F.coalesce(F.sum("resolved_count"), F.lit(0)).alias("resolved_count"),
        F.coalesce(F.sum("within_sla_count"), F.lit(0)).alias("within_sla_count"),
    )
    created = F.col("slice") == "Date"
    tickets = F.col("tickets")
    days = (
        rollup.where(F.col("slice").isin("Date", "ResolvedDate"))
        .groupBy(F.col("key").alias("Date"))
        .agg(
            F.sum(F.when(created, tickets).otherwise(0)).alias("created"),
            F.sum(F.when(created, 0).otherwise(tickets)).alias("resolved"),
        )
    )

    def by(column: str, top_n: int | None = None) -> DataFrame:
        return m.finish_count_by_column(counts(column, column, "count"), column, top_n)

    return {
        "kpis": m.finish_kpis(rollup),
        "sla_compliance": m.finish_sla(sla),
        "tickets_per_day": m.finish_tickets_per_day(counts("Date", "Date", "tickets")),
        "count_by_tipo": by("Tipo"),
        "count_by_reporter": by("Reporter", TOP_REPORTERS),
        "count_by_status": by("Status"),
        "count_by_agencia": by("Agencia", TOP_AGENCIAS),
        "client_pending_aging_buckets": m.finish_buckets(
            counts("pending_bucket", "aging_bucket", "count")
        ),
        "avg_resolution_time_over_time": m.finish_avg_over_time(means("ResolvedDate", "ResolvedDate")),
        "resolution_time_by_tipo": m.finish_by_tipo(means("raw_tipo", "Tipo")),
        "aging_buckets_open_tickets": m.finish_buckets(
            counts("open_bucket", "aging_bucket", "count")
        ),
        "created_vs_resolved_per_day": m.finish_created_vs_resolved(days),
    }


def write_report(
    df: DataFrame,
    path: str,
    sla_threshold_hours: float = 48.0,
    bins: int = m.HISTOGRAM_BINS,
) -> None:
    """Write every report table to its own Parquet folder under `path`."""
    for name, table in report_tables(df, sla_threshold_hours, bins).items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
