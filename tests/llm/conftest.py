import pytest

#: Columns whose names the operators use inside; they must not clash.
EXTRA = "digest string, mark long, size int, node long, statistics string, hits int, __mark string"
LONG = "word " * 30_000 + "x" * 40_000


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns with the operators' own names."""
    texts = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi."),
        (2, "Alpha beta gamma  delta epsilon\tzeta eta theta iota kappa lambda mu nu xi."),
        (2, "Alpha beta gamma  delta epsilon\tzeta eta theta iota kappa lambda mu nu xi."),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (6, "one"),
        (7, "One"),
        (8, LONG),
        (None, "A row without an id, mail me@example.com, é\U0001f600 twice."),
        (None, None),
        (9, "trailing space \n"),
        (10, "a  b\n\n c <|endoftext|> d  "),
    ]
    rows = [(i, t, "x", 1, 2, 3, "y", 4, "z") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, " + EXTRA).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, " + EXTRA)


@pytest.fixture(scope="session")
def sample():
    import os

    import __spark_entry__ as registered

    if not os.path.isdir(registered.SMOKE_DIR):
        pytest.skip("no sample tables")
    return registered.SMOKE_DIR


@pytest.fixture(scope="session")
def sample_texts(spark, sample):
    rows = spark.read.parquet(f"{sample}/documents.parquet").select("doc_id", "text").collect()
    return {row.doc_id: row.text or "" for row in rows}
