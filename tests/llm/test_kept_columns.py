"""Operators that drop rows give back the rows that stay as they were, whatever the names of their columns."""

import pytest
from pyspark.sql import functions as F

from ticketlens.llm import decontaminate, exact_dedup, near_dedup, quality, token_files
from ticketlens.llm.common import tokenizer_path
from ticketlens.session import scratch_path

CLASHING = ["mark", "Mark_", "digest", "gone", "__mark", "__row", "__digest", "__id", "__gone", "__statistics",
            "statistics", "size", "node", "keep_id", "kept", "text_sha256", "component", "score", "row"]

TEXTS = [
    (1, "one two three four five six seven eight nine ten eleven"),
    (2, "one two  three four five six seven eight nine ten eleven"),
    (2, "one two  three four five six seven eight nine ten eleven"),
    (3, None), (4, ""), (None, None), (None, "one two three four five six seven eight nine ten eleven"),
    (5, "one two three four five six seven eight nine ten eleven twelve"),
    (6, "something else entirely, in a sentence of its own that no other text here repeats at all"),
]


@pytest.fixture
def documents(spark):
    rows = [(i, t, *[f"{name}-{n}" for name in CLASHING]) for n, (i, t) in enumerate(TEXTS)]
    schema = "doc_id long, text string, " + ", ".join(f"`{name}` string" for name in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([(1, "a sentence of its own that no other text here repeats at all")],
                                 "item_id long, text string")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def stayed(left, documents):
    """The ids that stayed, after checking that every row came back whole and no more often than it was there."""
    assert left.columns == documents.columns
    before = rows_of(documents)
    after = rows_of(left)
    assert len(set(after)) == len(after) and set(after) <= set(before)
    return sorted([r[0] for r in after], key=repr)


def test_exact_copies(documents):
    assert stayed(exact_dedup.drop_exact_copies(documents), documents) == [1, 3, 5, 6]


def test_near_copies(documents):
    left = near_dedup.drop_near_copies(documents, near_dedup.Links(words=2, percent=80))
    assert stayed(left, documents) == sorted([1, 3, 4, 6, None, None], key=repr)


def test_contaminated(documents, benchmark):
    assert stayed(decontaminate.drop_contaminated(documents, benchmark), documents) == sorted(
        [1, 2, 2, 3, 4, 5, None, None], key=repr
    )
    assert decontaminate.drop_contaminated(documents, benchmark.limit(0)).count() == len(TEXTS)


def test_rejected(documents, spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (5, 1), (None, 1), (6, None)],
                                   "doc_id long, quality int")
    model = quality.fit_quality(documents, labels)
    ids = stayed(model.filter(documents), documents)
    assert len(ids) <= len(TEXTS)
    everything = quality.QualityModel(model.rules, threshold=0.0).filter(documents)
    assert len(stayed(everything, documents)) == len(TEXTS)


def test_empty_tables(documents, benchmark, spark):
    none = documents.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for left in (
        exact_dedup.drop_exact_copies(none),
        near_dedup.drop_near_copies(none),
        decontaminate.drop_contaminated(none, benchmark),
        quality.fit_quality(none, labels).filter(none),
    ):
        assert left.columns == documents.columns and left.count() == 0


def test_stages_with_odd_rows(documents, benchmark, spark):
    """Every stage of the pipeline takes nulls, repeats, clashing columns and empty side tables."""
    import corpus_pipeline

    folder = scratch_path(spark, "odd-stages")
    docs = documents.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for name, side, items in (("full", labels, benchmark), ("bare", labels.limit(0), benchmark.limit(0))):
        side.write.parquet(f"{folder}/{name}/labels.parquet")
        items.write.parquet(f"{folder}/{name}/benchmark.parquet")
        for stage, function in corpus_pipeline.STAGES:
            for given in (docs, docs.limit(0)):
                left = function(spark, given, f"{folder}/{name}")
                rows = left.collect()
                assert len(rows) <= given.count()
                assert stage == corpus_pipeline.STAGES[-1][0] or left.columns == docs.columns


@pytest.mark.parametrize("ids", [[None], [None, None, 4], [None, 4, 5], [4, 4, 5]])
def test_token_segments_with_null_ids(spark, ids, monkeypatch):
    path = scratch_path(spark, "null-ids")
    docs = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id long, text string")
    token_files.write_token_files(docs.coalesce(1), path, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    assert token_files.read_token_digests(spark, path).count() == len(ids)
    found = [r.doc_id for r in token_files.read_documents(spark, path, [4, 5, 99, None, 4]).collect()]
    assert sorted(found) == sorted(i for i in ids if i is not None)
