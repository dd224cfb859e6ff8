"""Exact and near duplicates, and decontamination."""

import random

import pytest
from pyspark.sql import functions as F

from ticketlens.llm import common, decontaminate, exact_dedup, graphs, near_dedup, queries
from ticketlens.llm.graphs import components


def _same_as_sql(name, spark, sample):
    import duckdb

    connection = duckdb.connect()
    for table in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sample}/{table}.parquet'")
    wanted = connection.sql(queries.oracle_sql()[name])
    found = queries.queries()[name](spark, sample)
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    wanted = wanted.project(", ".join(columns)).fetchall()
    assert wanted
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(wanted)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(name, spark, sample):
    _same_as_sql(name, spark, sample)


# --- exact --------------------------------------------------------------------


def test_exact_odd_rows(odd_documents, no_documents):
    found = {}
    for row in exact_dedup.exact_groups(odd_documents).collect():
        found.setdefault(row.doc_id, []).append((row.keep_id, row.group_size, row.kept))
    assert found[1] == [(1, 3, True)]
    assert found[2] == [(1, 3, False)] * 2
    assert found[3] == [(3, 3, True)]  # null, empty and the null text without an id
    assert found[4] == [(3, 3, False)]
    assert found[5] == [(5, 1, True)]
    assert found[8] == [(8, 1, True)]
    assert sorted(found[None], key=repr) == sorted([(3, 3, False), (None, 1, True)], key=repr)
    assert exact_dedup.exact_groups(no_documents).collect() == []


def test_exact_drop_keeps_one_row_and_all_columns(odd_documents, no_documents):
    left = exact_dedup.drop_exact_copies(odd_documents)
    assert left.columns == odd_documents.columns
    ids = [row.doc_id for row in left.collect()]
    assert sorted(ids, key=repr) == sorted([1, 3, 5, 6, 7, 8, None, 9, 10], key=repr)
    assert exact_dedup.drop_exact_copies(no_documents).collect() == []


def test_repeated_kept_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a  b"), (1, "c")], "doc_id long, text string")
    rows = exact_dedup.drop_exact_copies(docs).collect()
    assert sorted(" ".join(r.text.split()) for r in rows) == ["a b", "c"]


def test_exact_drop_shuffles_whole_rows_once(spark, odd_documents):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        node = exact_dedup.drop_exact_copies(odd_documents)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    node = node.initialPlan() if node.nodeName() == "AdaptiveSparkPlan" else node
    dealt = []  # on the way from the result down to the rows of the table
    while node.children().size():
        if node.nodeName() == "Exchange":
            dealt.append(node.outputPartitioning().toString())
        node = node.children().apply(0)
    assert len([x for x in dealt if "hashpartitioning" in x]) == 1


def test_exact_drop_of_repeats_with_and_without_id(spark):
    rows = [(None, "x"), (None, "x"), (None, "x "), (1, "y"), (1, "y"), (2, "y"), (2, "y"), (None, "y"), (3, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    left = sorted(map(tuple, exact_dedup.drop_exact_copies(docs).collect()), key=repr)
    assert left == sorted([(None, "x"), (None, "x "), (1, "y"), (3, None)], key=repr)


def test_large_groups_are_broadcast_with_the_same_result(spark, odd_documents, monkeypatch):
    plain = exact_dedup.exact_groups(odd_documents).collect()
    monkeypatch.setattr(common, "LARGE_GROUP_ROWS", 1)
    assert sorted(exact_dedup.exact_groups(odd_documents).collect(), key=repr) == sorted(plain, key=repr)


# --- near ---------------------------------------------------------------------


def _brute_components(texts, words, percent=80):
    sets = {}
    for doc_id, text in texts.items():
        tokens = (text or "").encode().lower().split()
        width = min(words, len(tokens))
        sets[doc_id] = {tuple(tokens[i : i + width]) for i in range(len(tokens) - width + 1)} if tokens else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            shared = len(sets[a] & sets[b])
            if shared and shared * 100 >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def _crowd(n_groups, copies, seed, edits):
    """Groups of edited copies of one text; with many edits most copies are not linked with one another."""
    made = random.Random(seed)
    texts, doc_id = {}, 0
    for group in range(n_groups):
        base = [f"w{group}x{made.randint(0, 60)}" for _ in range(80)]
        for _ in range(copies):
            words = list(base)
            for _ in range(made.randint(0, edits)):
                words[made.randrange(len(words))] = f"e{made.randint(0, 10**6)}"
            texts[doc_id] = " ".join(words)
            doc_id += 1
    return texts


@pytest.mark.parametrize("words,edits,small", [(2, 8, 12), (2, 8, 2), (5, 3, 2), (1, 14, 2)])
def test_near_groups_equal_brute_force(spark, monkeypatch, words, edits, small):
    """Also with every bucket but pairs taken through the prefix filter."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small)
    texts = _crowd(4, 40, 7 + words, edits) | {1000: "", 1001: "one", 1002: "One", 1003: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = near_dedup.near_groups(docs, near_dedup.Links(words=words)).collect()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert found == _brute_components(texts, words)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_prefix_filter_alone_finds_every_link(spark):
    texts = _crowd(3, 25, 3, 10)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    links = near_dedup.Links(words=2)
    crowd = docs.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component"))
    pairs = near_dedup._by_prefix(crowd, docs, links)
    confirmed = {(r.a, r.b) for r in near_dedup._confirmed(pairs, docs, links).collect()}
    sets = {i: set(near_dedup.shingles(t, 2).tolist()) for i, t in texts.items()}
    wanted = {
        (a, b)
        for a in sets
        for b in sets
        if a > b and len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b])
    }
    assert confirmed == wanted
    assert pairs.count() < len(sets) * (len(sets) - 1) / 4


def test_near_odd_rows(odd_documents, no_documents):
    rows = near_dedup.near_groups(odd_documents, near_dedup.Links(words=2)).collect()
    found = {}
    for row in rows:
        found.setdefault(row.doc_id, set()).add((row.component_id, row.kept))
    assert found[2] == {(1, False)} and found[1] == {(1, True)}
    assert found[7] == {(6, False)}  # the same word in lower case
    assert found[3] == {(3, True)} and found[4] == {(4, True)} and found[5] == {(5, True)}
    assert found[None] == {(None, True)}
    assert len(rows) == odd_documents.count()
    assert near_dedup.near_groups(no_documents).collect() == []
    left = near_dedup.drop_near_copies(odd_documents, near_dedup.Links(words=2))
    assert left.columns == odd_documents.columns
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == [1, 3, 4, 5, 6, 8, 9, 10]


def test_rows_with_one_id_are_one_document(spark):
    texts = [(1, "a b c d"), (5, "e f g h"), (5, "a b c d"), (7, "e f g h")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = near_dedup.near_groups(docs, near_dedup.Links(words=2)).collect()
    assert {r.component_id for r in rows} == {1}


def test_components(spark):
    made = random.Random(4)
    pairs = [(made.randint(0, 300), made.randint(0, 300)) for _ in range(180)]
    pairs += [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5050)]
    label = {}

    def root(i):
        label.setdefault(i, i)
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    wanted = {i: root(i) for pair in pairs if pair[0] != pair[1] for i in pair}
    edges = spark.createDataFrame(pairs, "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == wanted
    assert components(edges.where("false")).collect() == []


def test_components_read_few_edges_in_few_tasks(spark, monkeypatch):
    pairs = [(i, i + 1) for i in range(0, 300, 1) if i % 10 != 9] + [(7, 3), (5, 5)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(16)
    wanted = {i: i - i % 10 for i in range(301) if i != 300}
    monkeypatch.setattr(graphs, "TASK_EDGES", 100)
    written = graphs._packed(edges, edges.count())
    assert written.rdd.getNumPartitions() == 3
    for most in (100, 50_000):
        monkeypatch.setattr(graphs, "TASK_EDGES", most)
        assert {r.node: r.component for r in components(edges).collect()} == wanted


# --- decontamination ----------------------------------------------------------


def _overlap(text, item):
    import re

    split = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    words, wanted = split(text), split(item)
    n = len(wanted)
    if n < 5:
        return None
    width = min(n, 13)
    needed = width - 2 if n >= 10 else width
    best = 0
    for shift in range(-n + 1, len(words)):
        same = [0 <= shift + j < len(words) and words[shift + j] == w for j, w in enumerate(wanted)]
        best = max(best, *(sum(same[s : s + width]) for s in range(n - width + 1)))
    return best if best >= needed else None


def test_decontamination_equals_brute_force(spark):
    made = random.Random(9)
    word = lambda: f"w{made.randint(0, 400)}"
    items = [(i, " ".join(word() for _ in range(made.choice([3, 5, 7, 9, 10, 11, 13, 20, 40])))) for i in range(40)]
    docs = []
    for doc_id in range(150):
        words = [word() for _ in range(60)]
        passage = items[made.randrange(40)][1].split()
        passage = passage[made.randint(0, 3) : len(passage) - made.randint(0, 3)]
        for _ in range(made.randint(0, 4)):
            if passage:
                passage[made.randrange(len(passage))] = word()
        at = made.randint(0, 60)
        words[at:at] = passage
        docs.append((doc_id, ", ".join(words).upper()))
    found = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    wanted = {
        (d, i): k for d, text in docs for i, item in items if (k := _overlap(text, item)) is not None
    }
    assert {(r.doc_id, r.item_id): r.n_matched for r in found} == wanted
    assert wanted


def test_masks_find_every_window_with_two_substitutions():
    from itertools import combinations

    for width in range(10, 14):
        for bad in combinations(range(width), 2):
            assert any(
                all(at + place not in bad for place in mask)
                for mask in decontaminate.MASKS
                for at in range(width - mask[-1])
            )


def test_decontamination_odd_rows(spark, odd_documents, no_documents):
    items = [(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (None, "a row without an id mail me")]
    items += [(1, "alpha beta gamma delta epsilon zeta"), (4, "word word word word word word")]
    benchmark = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, mark string")
    found = decontaminate.contaminated(odd_documents, benchmark).collect()
    assert sorted(((r.doc_id, r.item_id) for r in found), key=repr) == sorted(
        [(1, 1), (2, 1), (None, None), (8, 4)], key=repr
    )
    left = decontaminate.drop_contaminated(odd_documents, benchmark)
    assert left.columns == odd_documents.columns
    assert {r.doc_id for r in left.collect()} == {3, 4, 5, 6, 7, 9, 10}
    assert decontaminate.contaminated(no_documents, benchmark).collect() == []
    assert decontaminate.contaminated(odd_documents, benchmark.where("false")).collect() == []


def test_decontamination_runs_no_python(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    plan = decontaminate.contaminated(docs, spark.read.parquet(f"{sample}/benchmark.parquet"))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
