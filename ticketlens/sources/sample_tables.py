"""Ticket views over generic order and document tables, used by queries, bench and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.session import spread

NOW = "2001-08-01 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_tickets(
    spark: SparkSession,
    sf_dir: str,
    with_updates: bool = True,
    with_people: bool = False,
) -> DataFrame:
    """Orders as tickets.

    Last updates (an aggregate of line items) and people (customer and nation)
    cost a join each, so they are joined in only when asked for.
    """
    key = F.col("o_orderkey")
    typo = F.when(key % 10 == 0, "PENDEINTE CLIENTE").otherwise("PENDIENTE CLIENTE")
    status = (
        F.when(F.col("o_orderstatus") == "F", "Done")
        .when(F.col("o_orderstatus") == "O", "In Progress")
        .otherwise(typo)
    )
    tickets = table(spark, sf_dir, "orders").select(
        key.alias("ticket_id"),
        F.col("o_orderdate").alias("Created_dt"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"),
        status.alias("Status"),
        F.col("o_orderpriority").alias("Tipo"),
        "o_custkey",
    )
    if with_updates:
        updates = (
            table(spark, sf_dir, "lineitem")
            .groupBy(F.col("l_orderkey").alias("ticket_id"))
            .agg(F.max("l_shipdate").alias("Last_Updated_dt"))
        )
        resolved = (F.col("Status") == "Done") & (F.col("ticket_id") % 3 != 0)
        tickets = tickets.join(updates, "ticket_id", "left").withColumn(
            "Resolution_dt", F.when(resolved, F.col("Last_Updated_dt"))
        )
    if with_people:
        people = (
            table(spark, sf_dir, "customer")
            .join(
                table(spark, sf_dir, "nation"),
                F.col("c_nationkey") == F.col("n_nationkey"),
            )
            .select(
                F.col("c_custkey").alias("o_custkey"),
                F.col("c_name").alias("Reporter"),
                F.col("n_name").alias("Agencia"),
            )
        )
        tickets = tickets.join(people, "o_custkey")
    return tickets.drop("o_custkey")


def document_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tickets with a summary and a description."""
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("ticket_id"),
        F.concat_ws(" ", "source", "lang", F.col("doc_id").cast("string")).alias("Summary"),
        F.col("text").alias("Description"),
        F.col("lang").alias("Tipo"),
        F.col("source").alias("Agencia"),
    )
