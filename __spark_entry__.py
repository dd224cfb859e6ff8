"""Registered queries over the sample tables, and the SQL each must agree with.

Orders stand in for tickets in the metric queries (see
`ticketlens.sources.sample_tables`), documents in the text queries. Doubles are rounded to six
places on both sides.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ticketlens import functions as fn  # noqa: E402
from ticketlens.operators import cleaning, clusters, metrics, terms  # noqa: E402
from ticketlens.operators import theme_tables as tables  # noqa: E402
from ticketlens.operators.vectors import semantic_vectors  # noqa: E402
from ticketlens.plans.pipeline import enrich_tickets  # noqa: E402
from ticketlens.plans.report import report_from_states, report_tables, write_report_states  # noqa: E402
from ticketlens.plans.themes import ThemeResult, build_themes  # noqa: E402
from ticketlens.session import scratch_path, spread, stored  # noqa: E402
from ticketlens.sources import (  # noqa: E402
    normalize_tickets,
    read_tickets_csv,
    write_themes,
    write_tickets,
)
from ticketlens.sources.sample_tables import (  # noqa: E402
    NOW,
    document_tickets,
    order_tickets,
    table,
)

SMOKE_DIR = os.environ.get("SMOKE_SF_DIR", "/root/testdata/sf0.001")
Query = Callable[[SparkSession, str], DataFrame]


def entry(spark: SparkSession) -> DataFrame:
    """Tickets per day with the seven-row mean."""
    return queries()["tickets_per_day"](spark, SMOKE_DIR)


# --- inputs ------------------------------------------------------------------


def _timed(spark: SparkSession, sf_dir: str, with_people: bool = False) -> DataFrame:
    return metrics.add_time_metrics(
        order_tickets(spark, sf_dir, with_people=with_people), NOW
    )


def _created(spark: SparkSession, sf_dir: str, with_people: bool = False) -> DataFrame:
    return order_tickets(spark, sf_dir, with_updates=False, with_people=with_people)


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_tickets(document_tickets(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts that are long enough for themes."""
    return terms.eligible_texts(_cleaned(spark, sf_dir))


def _stored_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Ids, cleaned texts and `columns` of the same, cleaned once and written, for queries that read the texts several times."""
    return stored(_documents(spark, sf_dir).select("ticket_id", *columns, "Description_clean"), "documents")


def _with_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with links, image markup, greetings and attributes around their text."""
    key = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit("Hola, ["),
        F.col("lang"),
        F.lit("|https://example.org/"),
        key,
        F.lit("|smart-link] "),
        F.col("text"),
        F.lit(" !captura "),
        key,
        F.lit(".png|thumbnail! luego ![una foto](foto"),
        key,
        F.lit(".jpg) y <img src='"),
        key,
        F.lit("'> con Foto-"),
        key,
        F.lit(".GIF o width = "),
        F.col("n_chars").cast("string"),
        F.lit(" height=\"10\" en WWW.example.org/t/"),
        key,
        F.lit(" la Imagen que dice: Buenos dias; "),
        F.col("source"),
    )
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("ticket_id"), text.alias("text")
    )


def _raw_export(spark: SparkSession, sf_dir: str, second_layout: bool) -> DataFrame:
    """Order tickets as the text cells of an export, in either layout."""
    written = "M/d/yyyy H:mm"
    tickets = order_tickets(spark, sf_dir, with_people=True)
    raw = tickets.select(
        F.col("ticket_id").cast("string").alias("Issue key"),
        F.concat(F.lit("Ticket "), F.col("ticket_id")).alias("Summary"),
        "Reporter",
        "Status",
        F.when(F.col("ticket_id") % 7 != 0, F.col("Tipo")).alias("Tipo"),
        F.date_format("Created_dt", written).alias("Created"),
        F.lit(None).cast("string").alias("Description"),
        F.date_format("Resolution_dt", "yyyy-MM-dd HH:mm").alias("Resolution"),
        F.date_format("Last_Updated_dt", written).alias("Updated"),
        "Agencia",
    )
    if not second_layout:
        return raw.drop("Agencia")
    return raw.withColumns(
        {
            "Resolved": F.when(F.col("Status") == "Done", F.col("Updated")),
            "Last Viewed": F.lit("  "),
        }
    ).withColumnsRenamed(
        {
            "Tipo": "Custom field (Tipo de solicitud)",
            "Agencia": "Custom field (Agencia que reporta)",
        }
    )


def _given_groups(spark: SparkSession, sf_dir: str, *columns: str) -> dict[str, DataFrame]:
    """Theme tables of all texts, grouped by their source in place of learned clusters.

    Representatives are taken from the texts that have an embedding. Cleaned texts are written once, with `columns`.
    """
    docs = _stored_documents(spark, sf_dir, "Summary", "Agencia", *columns)
    number = F.regexp_extract("Agencia", r"([0-9]+)$", 1).cast("int") % 10
    groups = docs.select("ticket_id", number.alias("theme_id"))
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("ticket_id"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"),
    )
    unit = Normalizer(p=2.0, inputCol="raw", outputCol="features")
    assigned = unit.transform(vectors).join(groups, "ticket_id")
    top = tables.top_themes(terms.theme_sizes(groups))
    similarities = clusters.theme_similarities(assigned, clusters.mean_centers(assigned))
    return {
        "docs": docs,
        "groups": groups,
        "top": top,
        "representatives": clusters.theme_representatives(similarities),
    }


def _theme_term_weights(docs: DataFrame, groups: DataFrame) -> DataFrame:
    dictionary = terms.term_dictionary(docs, docs.count())
    weights = terms.weighted_texts(docs, dictionary)
    return terms.theme_term_weights(weights, groups, dictionary=dictionary)


def _given_themes(given: dict[str, DataFrame]) -> DataFrame:
    weights = _theme_term_weights(given["docs"], given["groups"])
    examples = tables.theme_examples(given["representatives"], given["docs"])
    keywords = terms.theme_keywords(weights)
    return tables.themes_table(given["top"], keywords, examples)


def _given_ticket_themes(given: dict[str, DataFrame]) -> DataFrame:
    parts = ("docs", "groups", "top", "representatives")
    return tables.ticket_themes_table(*[given[name] for name in parts])


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with texts that only tell the group: ten groups of sources without a common word."""
    letter = F.element_at(F.split(F.lit("abcdefghij"), ""), F.col("theme_group") + 1)
    words = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("topic"), letter, i))
    number = F.regexp_extract("Agencia", r"([0-9]+)$", 1).cast("int") % 10
    docs = document_tickets(spark, sf_dir).withColumn("theme_group", number)
    path = scratch_path(spark, "planted")
    docs.select("ticket_id", "Summary", "Description", "theme_group").withColumn(
        "Description_clean", F.array_join(words, " ")
    ).write.parquet(path)
    return spark.read.parquet(path)


def _theme_facts(result: ThemeResult) -> DataFrame:
    """One row of what must hold for the result of any clustering."""
    tickets = result.ticket_themes
    ranks = tickets.where("representative_rank is not null").groupBy("theme_id").agg(
        F.array_sort(
            F.collect_list(F.struct("representative_rank", "representative_similarity"))
        ).alias("ranked")
    )
    in_order = F.forall(
        F.sequence(F.lit(1), F.size("ranked")),
        lambda i: (F.get(F.col("ranked"), i - 1)["representative_rank"] == i)
        & (
            F.get(F.col("ranked"), i - 1)["representative_similarity"]
            >= F.coalesce(F.get(F.col("ranked"), i)["representative_similarity"], F.lit(-2.0))
        ),
    )
    checked = ranks.agg(F.bool_and(in_order).alias("ranks_in_order"))
    sums = result.themes.agg(F.sum("count").alias("tickets_in_themes"))
    rows = tickets.agg(
        F.count(F.lit(1)).alias("ticket_rows"), F.count_distinct("ticket_id").alias("tickets")
    )
    stats = result.stats().select(
        "total_descriptions",
        "eligible_descriptions",
        "excluded_short_descriptions",
        F.col("selected_k").between(8, 25).alias("k_in_range"),
    )
    # Every frame has one row.
    for part in (checked, sums, rows):
        stats = stats.join(part, F.lit(True))
    return stats


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(
        [
            F.round(f"`{name}`", 6).alias(name) if kind == "double" else f"`{name}`"
            for name, kind in df.dtypes
        ]
    )


#: Text and number columns of every table of the report.
REPORT_COLUMNS = {
    "tickets_per_day": (["Date"], ["tickets", "rolling_7d"]),
    "count_by_tipo": (["Tipo"], ["count"]),
    "count_by_reporter": (["Reporter"], ["count"]),
    "count_by_status": (["Status"], ["count"]),
    "count_by_agencia": (["Agencia"], ["count"]),
    "client_pending_aging_buckets": (["aging_bucket"], ["count"]),
    "avg_resolution_time_over_time": (["ResolvedDate"], ["avg_resolution_time_hours"]),
    "resolution_time_histogram": (["bin"], ["count", "bin_start", "bin_end"]),
    "resolution_time_by_tipo": (["Tipo"], ["avg_resolution_time_hours"]),
    "aging_buckets_open_tickets": (["aging_bucket"], ["count"]),
    "created_vs_resolved_per_day": (["Date"], ["created", "resolved"]),
    "kpis": (
        ["top_tipo", "top_agencia"],
        ["total_tickets", "open_tickets", "pct_done", "avg_tickets_day"],
    ),
    "sla_compliance": ([], ["sla_pct", "resolved_count", "within_sla_count"]),
}


# --- queries -----------------------------------------------------------------


def _metric_queries() -> dict[str, Query]:
    def filtered(spark, sf_dir):
        return metrics.apply_filters(
            _created(spark, sf_dir, with_people=True),
            date_range=("1996-03-01", "1998-06-30"),
            statuses=["Done", "PENDIENTE CLIENTE"],
            tipos=["1-URGENT", "2-HIGH"],
            agencias=["NATION_1", "NATION_7", "NATION_19"],
        ).select("ticket_id", "Created_dt", "Status", "Tipo", "Reporter", "Agencia")

    def time_metrics(spark, sf_dir):
        return _timed(spark, sf_dir).select(
            "ticket_id",
            "resolution_effective_dt",
            "ResolvedDate",
            "resolution_time_hours",
            "aging_hours",
            "touch_time_hours",
        )

    def amounts_of(report, columns):
        """Every number of the report as (table_name, item, amount)."""
        parts = [
            report[name].select(
                F.lit(f"{name}.{amount}").alias("table_name"),
                (F.concat_ws(" ", *key) if key else F.lit("")).alias("item"),
                F.col(amount).cast("double").alias("amount"),
            )
            for name, (key, amounts) in columns.items()
            for amount in amounts
        ]
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        return union

    def report(spark, sf_dir):
        tickets = _timed(spark, sf_dir, with_people=True)
        return amounts_of(report_tables(tickets), REPORT_COLUMNS)

    def report_by_month(spark, sf_dir):
        """The report of stored months, half of which were replaced after the first write."""
        path = scratch_path(spark, "states")
        tickets = _timed(spark, sf_dir, with_people=True)
        even = F.month("Created_dt") % 2 == 0
        write_report_states(tickets.where(~even | (F.col("Tipo") != "")), path)
        write_report_states(tickets.where(even), path)
        columns = REPORT_COLUMNS | {"resolution_time_bins": (["bin"], ["count"])}
        del columns["resolution_time_histogram"]
        return amounts_of(report_from_states(spark.read.parquet(path)), columns)

    def by_column(column, top_n=None, with_people=False):
        return lambda spark, sf_dir: metrics.count_by_column(
            _created(spark, sf_dir, with_people), column, top_n
        )

    def on_created(operator, with_people=False):
        return lambda spark, sf_dir: operator(_created(spark, sf_dir, with_people))

    def on_timed(operator):
        return lambda spark, sf_dir: operator(_timed(spark, sf_dir))

    return {
        "tickets_per_day": on_created(metrics.tickets_per_day),
        "kpis": on_created(metrics.kpis, with_people=True),
        "count_by_tipo": by_column("Tipo"),
        "count_by_status": by_column("Status"),
        "count_by_reporter_top15": by_column("Reporter", 15, with_people=True),
        "count_by_agencia_top20": by_column("Agencia", 20, with_people=True),
        "apply_filters": filtered,
        "facet_values": on_created(metrics.all_facet_values, with_people=True),
        "facet_values_reporter": on_created(
            lambda t: metrics.facet_values(t, "Reporter"), with_people=True
        ),
        "date_bounds": on_created(metrics.date_bounds),
        "time_metrics": time_metrics,
        "avg_resolution_time_over_time": on_timed(metrics.avg_resolution_time_over_time),
        "resolution_time_distribution": on_timed(metrics.resolution_time_distribution),
        "resolution_time_histogram": on_timed(metrics.resolution_time_histogram),
        "resolution_time_by_tipo": on_timed(metrics.resolution_time_by_tipo),
        "aging_buckets_open_tickets": on_timed(metrics.aging_buckets_open_tickets),
        "client_pending_aging": on_timed(metrics.client_pending_aging),
        "client_pending_aging_buckets": on_timed(metrics.client_pending_aging_buckets),
        "created_vs_resolved_per_day": on_timed(metrics.created_vs_resolved_per_day),
        "client_pending_aging_literal": on_timed(
            lambda t: metrics.client_pending_aging(t, metrics.PENDING_CLIENT_LITERAL)
        ),
        "sla_compliance": on_timed(metrics.sla_compliance),
        "report_tables": report,
        "report_by_month": report_by_month,
    }


def _ingest_queries() -> dict[str, Query]:
    def parse(spark, sf_dir):
        """Event times written in each accepted layout, read back."""
        layouts = [
            "M/d/yyyy H:mm",
            "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
            "yyyy-MM-dd HH:mm",
            "dd/MMM/yy h:mm a",
            "M/d/yyyy",
            "'no date' H",
        ]
        turn = F.col("event_id") % len(layouts)
        text = F.coalesce(
            *[F.when(turn == i, F.date_format("ts", f)) for i, f in enumerate(layouts)]
        )
        parsed = fn.parse_ticket_ts(text).cast("timestamp_ntz")
        return table(spark, sf_dir, "events").select("event_id", parsed.alias("parsed"))

    def normalized(second_layout):
        def run(spark, sf_dir):
            raw = _raw_export(spark, sf_dir, second_layout)
            return _ticket_columns(normalize_tickets(raw, "Issue key"))

        return run

    def from_csv(spark, sf_dir):
        path = scratch_path(spark, "export")
        raw = _raw_export(spark, sf_dir, second_layout=True)
        raw.write.option("header", True).option("escape", '"').csv(path)
        return _ticket_columns(read_tickets_csv(spark, path, "Issue key"))

    def texts_from_csv(spark, sf_dir):
        """Multi-line texts with quotes through a CSV export and the whole preparation."""
        path = scratch_path(spark, "texts")
        day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("ticket_id") % 365).cast("int"))
        later = F.date_add(day, (F.col("ticket_id") % 9).cast("int"))
        document_tickets(spark, sf_dir).withColumns(
            {
                "Created": F.date_format(day, "M/d/yyyy H:mm"),
                "Resolved": F.when(F.col("ticket_id") % 3 == 0, F.date_format(later, "M/d/yyyy H:mm")),
                "Updated": F.date_format(later, "M/d/yyyy H:mm"),
                "Status": F.when(F.col("ticket_id") % 2 == 0, "Done").otherwise("Open"),
            }
        ).write.option("header", True).option("escape", '"').csv(path)
        prepared = enrich_tickets(read_tickets_csv(spark, path, "ticket_id"), NOW)
        return prepared.select(
            F.col("ticket_id").cast("long").alias("ticket_id"),
            "Date",
            "DayOfWeek",
            "ResolvedDate",
            "Description",
            "Description_clean",
            "Description_clean_len",
            "NLP_Eligible",
            F.col("resolution_effective_dt").cast("timestamp_ntz").alias("resolution_effective_dt"),
            "resolution_time_hours",
            "aging_hours",
            "touch_time_hours",
        )

    def parquet_round_trip(spark, sf_dir):
        path = scratch_path(spark, "tickets")
        write_tickets(_created(spark, sf_dir), path, by_month=True)
        kept = metrics.apply_filters(
            spark.read.parquet(path), date_range=("1997-01-15", "1997-03-10")
        )
        return kept.select("ticket_id", "Created_dt", "Status", "created_month")

    def themes_round_trip(spark, sf_dir):
        path = scratch_path(spark, "themes")
        write_themes(_given_themes(_given_groups(spark, sf_dir)), path)
        themes = spark.read.option("header", True).option("escape", '"')
        themes = themes.option("multiLine", True).csv(path)
        return themes.withColumns(
            {
                "theme_id": F.col("theme_id").cast("int"),
                "count": F.col("count").cast("long"),
                "example_summaries": F.coalesce("example_summaries", F.lit("")),
            }
        )

    def defaults(spark, sf_dir):
        raw = _raw_export(spark, sf_dir, second_layout=False)
        filled = cleaning.fill_defaults(normalize_tickets(raw, "Issue key"))
        return filled.select(
            F.col("ticket_id").cast("long").alias("ticket_id"),
            F.col("Issue Type").alias("issue_type"),
            "Agencia",
            "Tipo",
            "Resolution",
            "Description",
        )

    return {
        "parse_ticket_ts": parse,
        "normalize_legacy_layout": normalized(False),
        "normalize_second_layout": normalized(True),
        "read_tickets_csv": from_csv,
        "prepare_tickets": texts_from_csv,
        "fill_defaults": defaults,
        "write_tickets": parquet_round_trip,
        "write_themes": themes_round_trip,
    }


def _ticket_columns(tickets: DataFrame) -> DataFrame:
    return tickets.select(
        F.col("ticket_id").cast("long").alias("ticket_id"),
        "Summary",
        "Tipo",
        "Agencia",
        F.col("Created_dt").cast("timestamp_ntz").alias("Created_dt"),
        F.col("Resolution_dt").cast("timestamp_ntz").alias("Resolution_dt"),
        F.col("Last_Updated_dt").cast("timestamp_ntz").alias("Last_Updated_dt"),
        "Date",
        "ResolvedDate",
        "DayOfWeek",
    )


MARKUP_STEPS: dict[str, Callable[[Column], Column]] = {
    "strip_smart_links": fn.strip_smart_links,
    "strip_image_embeds": fn.strip_image_embeds,
    "strip_markdown_images": fn.strip_markdown_images,
    "strip_img_tags": fn.strip_img_tags,
    "strip_image_filenames": fn.strip_image_filenames,
    "strip_image_attrs": fn.strip_image_attrs,
    "strip_urls": fn.strip_urls,
    "strip_image_words": fn.strip_image_words,
    "fold_text": fn.fold_text,
    "strip_greetings": fn.strip_greetings,
    "drop_first_words": fn.drop_first_words,
    "clean_markup": fn.clean_description,
}


def _text_queries() -> dict[str, Query]:
    def step(function):
        return lambda spark, sf_dir: _with_markup(spark, sf_dir).select(
            "ticket_id", function(F.col("text")).alias("text")
        )

    def clean(spark, sf_dir):
        return _cleaned(spark, sf_dir).select(
            "ticket_id", "Description_clean", "Description_clean_len", "NLP_Eligible"
        )

    def truncate(spark, sf_dir):
        return document_tickets(spark, sf_dir).select(
            "ticket_id", fn.truncate_text(F.col("Description"), 350).alias("text")
        )

    def trim_lower(spark, sf_dir):
        return document_tickets(spark, sf_dir).select(
            "ticket_id", fn.trim_lower(F.col("Description")).alias("text")
        )

    def tokens(spark, sf_dir):
        found = document_tickets(spark, sf_dir).select(
            "ticket_id", terms.tokens(F.col("Description")).alias("tokens")
        )
        return found.select(
            "ticket_id",
            F.size("tokens").cast("long").alias("n"),
            F.array_join("tokens", " ").alias("tokens"),
        )

    def ngrams(spark, sf_dir):
        found = document_tickets(spark, sf_dir).select(
            "ticket_id", terms.tokens(F.col("Description")).alias("tokens")
        )
        return terms.with_ngrams(found).select(
            "ticket_id",
            F.size("terms").cast("long").alias("n"),
            F.array_join("terms", "|").alias("terms"),
        )

    def noise(spark, sf_dir):
        """Words of the marked-up texts that are noise, with their counts."""
        words = _with_markup(spark, sf_dir).select(
            F.explode(F.split(F.lower("text"), r"[^a-z0-9_\-]+")).alias("word")
        )
        return (
            words.where(fn.is_noise(F.col("word")) & (F.col("word") != ""))
            .groupBy("word")
            .agg(F.count(F.lit(1)).alias("count"))
        )

    return {
        **{name: step(function) for name, function in MARKUP_STEPS.items()},
        "clean_description": clean,
        "truncate_text": truncate,
        "trim_lower": trim_lower,
        "tokens": tokens,
        "ngrams": ngrams,
        "noise_keywords": noise,
    }


def _theme_queries() -> dict[str, Query]:
    def coverage(spark, sf_dir):
        return terms.coverage(_cleaned(spark, sf_dir))

    def eligible(spark, sf_dir):
        return _documents(spark, sf_dir).select("ticket_id", "Description_clean")

    def tfidf(spark, sf_dir):
        return terms.tfidf(_stored_documents(spark, sf_dir))

    def by_language(spark, sf_dir):
        docs = _stored_documents(spark, sf_dir, "Tipo")
        groups = docs.select("ticket_id", F.col("Tipo").alias("theme_id"))
        return _theme_term_weights(docs, groups)

    def keywords(spark, sf_dir):
        found = terms.theme_keywords(by_language(spark, sf_dir))
        return found.select(
            "theme_id",
            F.array_join("keywords", ", ").alias("keywords"),
            fn.keyword_label(F.col("keywords"), 4).alias("label"),
        )

    def sizes(spark, sf_dir):
        return terms.theme_sizes(_given_groups(spark, sf_dir)["groups"])

    def representatives(spark, sf_dir):
        return _given_groups(spark, sf_dir)["representatives"]

    def themes(spark, sf_dir):
        return _given_themes(_given_groups(spark, sf_dir))

    def ranked(spark, sf_dir):
        return tables.rank_themes(_given_groups(spark, sf_dir)["top"])

    def ticket_themes(spark, sf_dir):
        return _given_ticket_themes(_given_groups(spark, sf_dir, "Description"))

    def sentences(spark, sf_dir):
        given = _given_groups(spark, sf_dir, "Description")
        return tables.theme_example_sentences(
            _given_themes(given), _given_ticket_themes(given)
        )

    def top_sentence(spark, sf_dir):
        given = _given_groups(spark, sf_dir, "Description")
        return tables.top_theme_sentence(
            _given_themes(given), _given_ticket_themes(given)
        )

    def vectors(spark, sf_dir):
        """Cosines of every planted text to one text of its own group and to one of the next group."""
        docs = _planted(spark, sf_dir)
        n_docs = docs.count()
        dictionary = terms.term_dictionary(docs, n_docs)
        weights = terms.weighted_texts(docs, dictionary)
        found = semantic_vectors(weights, docs, n_docs, dictionary.count())
        found = found.withColumnRenamed("features", "v")
        found = found.join(docs.select("ticket_id", "theme_group"), "ticket_id")
        first = found.groupBy("theme_group").agg(F.min_by("v", "ticket_id").alias("first"))
        following = first.select(
            ((F.col("theme_group") + 9) % 10).alias("theme_group"), F.col("first").alias("next")
        )
        both = found.join(first, "theme_group").join(following, "theme_group")

        def cosine(name):
            products = F.zip_with("v", name, lambda x, y: x * y)
            total = F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
            return F.round(F.abs(total), 5)

        return both.select("ticket_id", cosine("first").alias("own"), cosine("next").alias("other"))

    def text_cosines(spark, sf_dir):
        """Cosine of each real text to the next by the 40 most widespread terms, and whether the vectors agree.

        Every term stands there twice, so the directions are more than the rank and the vectors exact.
        """
        docs = _stored_documents(spark, sf_dir)
        widest = F.desc("texts"), "term"
        weights = terms.tfidf(docs)
        # Weights are several times the text: they are made twice rather than written.
        top = weights.groupBy("term").agg(F.count(F.lit(1)).alias("texts")).orderBy(*widest).limit(40)
        top = stored(top, "widest-terms")
        few = weights.join(F.broadcast(top.select("term")), "term").select("ticket_id", "term", "weight")
        few = stored(few, "few-weights")
        twice = few.union(few.withColumn("term", F.concat("term", F.lit(" again"))))
        found = semantic_vectors(twice, docs, docs.count(), 2 * top.count())

        def beside(df, *names):
            """`df` with the columns of the following ticket under other names."""
            return df.withColumn("ticket_id", F.col("ticket_id") - 1).withColumnsRenamed({n: f"next_{n}" for n in names})

        norms = few.groupBy("ticket_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
        dots = few.join(beside(few, "weight"), ["ticket_id", "term"]).groupBy("ticket_id").agg(
            F.sum(F.col("weight") * F.col("next_weight")).alias("dot")
        )
        both = found.join(beside(found, "features"), "ticket_id")
        for part in (dots, norms, beside(norms, "norm")):
            both = both.join(part, "ticket_id", "left")
        exact = F.coalesce(F.col("dot") / (F.col("norm") * F.col("next_norm")), F.lit(0.0))
        products = F.zip_with("features", "next_features", lambda x, y: x * y)
        learned = F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
        return both.select("ticket_id", exact.alias("cosine"), (F.abs(exact - learned) < 1e-4).alias("same"))

    def learned(spark, sf_dir):
        path = scratch_path(spark, "cleaned")
        write_tickets(_cleaned(spark, sf_dir), path)
        return _theme_facts(build_themes(spark.read.parquet(path), top_n=25))

    def planted(spark, sf_dir):
        """Size and least ticket of every planted group, of the tickets whose theme has no other group.

        k-means may cut a group in two, but a theme that mixes groups loses its tickets here.
        """
        docs = _planted(spark, sf_dir)
        tickets = build_themes(docs, top_n=25).ticket_themes.select("ticket_id", "theme_id")
        placed = tickets.join(docs.select("ticket_id", "theme_group"), "ticket_id")
        mixed = placed.groupBy("theme_id").agg(
            F.min("theme_group").alias("x"), F.max("theme_group").alias("y")
        )
        pure = placed.join(mixed.where("x = y").select("theme_id"), "theme_id", "left_semi")
        return pure.groupBy("theme_group").agg(
            F.count(F.lit(1)).alias("count"), F.min("ticket_id").alias("least_ticket")
        )

    return {
        "theme_coverage": coverage,
        "eligible_texts": eligible,
        "tfidf": tfidf,
        "theme_term_weights": by_language,
        "theme_keywords": keywords,
        "theme_sizes": sizes,
        "theme_representatives": representatives,
        "themes_table": themes,
        "rank_themes": ranked,
        "ticket_themes": ticket_themes,
        "theme_example_sentences": sentences,
        "top_theme_sentence": top_sentence,
        "semantic_vectors": vectors,
        "text_cosines": text_cosines,
        "build_themes": learned,
        "planted_themes": planted,
    }


def queries() -> dict[str, Query]:
    """One entry per operator; doubles come rounded to six places."""
    every = {
        **_metric_queries(),
        **_ingest_queries(),
        **_text_queries(),
        **_theme_queries(),
    }

    def rounded(query: Query) -> Query:
        return lambda spark, sf_dir: _rounded(query(spark, sf_dir))

    return {name: rounded(query) for name, query in every.items()} | _corpus_queries()[0]


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB that gives the same rows."""
    from expected_sql import EXPECTED

    return dict(EXPECTED) | _corpus_queries()[1]


def _corpus_queries() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of the corpus operators, where that part of the library is present."""
    try:
        import corpus_pipeline
        from ticketlens.llm import queries as corpus
    except ModuleNotFoundError as error:
        if error.name not in ("corpus_pipeline", "ticketlens.llm"):
            raise
        return {}, {}
    sql = corpus.oracle_sql()
    if corpus_pipeline.ORACLE_SQL is not None:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return corpus.queries() | {"pipeline": corpus_pipeline.run}, sql
