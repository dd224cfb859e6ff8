"""Data preparation: load, clean, enrich."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketlens.operators.cleaning import clean_tickets
from ticketlens.operators.metrics import add_time_metrics, apply_filters
from ticketlens.schema import NULL_DEFAULTS
from ticketlens.sources.sinks import write_themes, write_tickets
from ticketlens.sources.tickets import normalize_tickets, read_tickets_csv


def enrich_tickets(tickets: DataFrame, now_ts=None) -> DataFrame:
    """Normalised tickets to cleaned tickets with time metrics."""
    return tickets.transform(clean_tickets).transform(add_time_metrics, now_ts)


def _prepared(tickets: DataFrame, now_ts, filters: dict | None) -> DataFrame:
    """Filters (arguments of `apply_filters`) go first: Spark does not move them below the cleaning."""
    if filters:
        names = {"statuses": "Status", "tipos": "Tipo", "reporters": "Reporter", "agencias": "Agencia"}
        filled = {
            names[key]: NULL_DEFAULTS[names[key]]
            for key, wanted in filters.items()
            if key in names and NULL_DEFAULTS[names[key]] in list(wanted or [])
        }
        # A missing value is asked for by the name that cleaning gives it.
        tickets = apply_filters(tickets.fillna(filled) if filled else tickets, **filters)
    return enrich_tickets(tickets, now_ts)


def prepare_tickets(
    spark: SparkSession,
    csv_path: str,
    id_column: str | None = None,
    now_ts=None,
    filters: dict | None = None,
) -> DataFrame:
    """One CSV export to cleaned and enriched tickets, as one lazy plan."""
    return _prepared(read_tickets_csv(spark, csv_path, id_column), now_ts, filters)


def prepare_frame(
    raw: DataFrame,
    id_column: str | None = None,
    now_ts=None,
    filters: dict | None = None,
) -> DataFrame:
    """As `prepare_tickets`, for raw tickets that are already a DataFrame."""
    return _prepared(normalize_tickets(raw, id_column), now_ts, filters)


def run_batch(
    spark: SparkSession,
    csv_path: str,
    output_dir: str,
    id_column: str | None = None,
    now_ts=None,
    **theme_options,
):
    """The batch job: cleaned tickets as Parquet, then themes as CSV.

    Themes are built from the written tickets, so the text is cleaned only once.
    """
    from ticketlens.plans.themes import build_themes

    cleaned_path = f"{output_dir}/cleaned_tickets.parquet"
    write_tickets(prepare_tickets(spark, csv_path, id_column, now_ts), cleaned_path)
    result = build_themes(spark.read.parquet(cleaned_path), **theme_options)
    write_themes(result.themes, f"{output_dir}/themes.csv")
    return result
