"""Themes: exact steps against brute force, learned steps on planted groups."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from __spark_entry__ import queries as entry_queries
from ticketlens.operators import clusters as cl
from ticketlens.operators import terms as tm
from ticketlens.operators import theme_tables as tt
from ticketlens.operators import vectors as vc
from ticketlens.plans.themes import build_themes
from ticketlens.schema import THEME_SCHEMA

TOPICS = {
    "red": ["router", "cable", "switch", "internet", "wifi", "señal"],
    "impresora": ["impresora", "papel", "toner", "tinta", "bandeja", "rodillo"],
    "clave": ["clave", "usuario", "acceso", "bloqueo", "cuenta", "permiso"],
    "correo": ["correo", "buzon", "outlook", "firma", "spam", "mensaje"],
}


def planted(per_topic, seed=3):
    rng = random.Random(seed)
    names = sorted(TOPICS)
    docs = []
    for i in range(per_topic * len(names)):
        topic = names[i % len(names)]
        text = " ".join(rng.choices(TOPICS[topic], k=10))
        docs.append((i, topic, f"{topic} {i}", "Texto: " + text, text))
    return docs


SCHEMA = """ticket_id long, topic string, Summary string, Description string,
    Description_clean string"""


@pytest.fixture
def tickets(spark):
    return lambda docs: spark.createDataFrame(docs, SCHEMA)


def brute_tfidf(texts):
    """{id: {term: weight}} in plain Python."""
    grams = {}
    for key, text in texts.items():
        words, word = [], ""
        for c in text.lower() + " ":
            if c.isalnum() or c == "_":
                word += c
                continue
            ascii_word = word.isascii() and word[:1].isalpha() and len(word) >= 3
            if ascii_word and word not in tm.STOPWORDS:
                words.append(word)
            word = ""
        grams[key] = Counter(
            " ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)
        )
    n = len(texts)
    df = Counter(term for counts in grams.values() for term in counts)
    least = 2 if n >= 80 else 1
    keep = {t for t, d in df.items() if d >= least and (d <= 0.95 * n or n == 1)}
    weights = {}
    for key, counts in grams.items():
        raw = {
            t: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[t])) + 1)
            for t, c in counts.items()
            if t in keep
        }
        norm = math.sqrt(sum(x * x for x in raw.values()))
        weights[key] = {t: x / norm for t, x in raw.items()}
    return weights


@pytest.mark.parametrize("n_docs", [1, 2, 79, 80])
def test_tfidf(n_docs, tickets):
    docs = planted(20)[:n_docs]
    docs[0] = docs[0][:4] + ("para el señal1 1abc ab _abc abc_1 router, router; x",)
    got = {d[0]: {} for d in docs}
    for row in tm.tfidf(tickets(docs)).collect():
        got[row.ticket_id][row.term] = row.weight
    expected = brute_tfidf({d[0]: d[4] for d in docs})
    assert {k: set(v) for k, v in got.items()} == {k: set(v) for k, v in expected.items()}
    for key, weights in expected.items():
        for term, weight in weights.items():
            assert got[key][term] == pytest.approx(weight)


@pytest.mark.parametrize("held", [0, 7, 1 << 16])
def test_weights_whatever_terms_tasks_hold(held, tickets, monkeypatch):
    """Numbers are dense and fall in frequency; weights equal brute force; a hot term and odd texts."""
    monkeypatch.setattr(tm, "HELD_TERMS", held)
    docs = planted(20)
    docs += [(2000 + i, "x", "s", "d", text) for i, text in enumerate(["", "12 34", "router " * 3000, "Router router"])]
    expected = brute_tfidf({d[0]: d[4] for d in docs})
    frame = tickets(docs)
    dictionary = tm.term_dictionary(frame, len(docs)).orderBy("term_no").collect()
    assert [r.term_no for r in dictionary] == list(range(len(dictionary)))
    assert [(r.idf, r.term) for r in dictionary] == sorted((r.idf, r.term) for r in dictionary)
    assert {r.term for r in dictionary} == {t for weights in expected.values() for t in weights}
    texts = tm.weighted_texts(frame, tm.term_dictionary(frame, len(docs))).collect()
    got = {r.ticket_id: {dictionary[c.term_no].term: c.weight for c in r.cells} for r in texts}
    assert got == {i: pytest.approx(weights) for i, weights in expected.items() if weights}
    assert all([c.term_no for c in r.cells] == sorted({c.term_no for c in r.cells}) for r in texts)
    named = {}
    for r in tm.tfidf(frame).collect():
        named.setdefault(r.ticket_id, {})[r.term] = r.weight
    assert named == {i: pytest.approx(weights) for i, weights in got.items()}
    none = frame.where("false")
    assert tm.weighted_texts(none, tm.term_dictionary(none, 0)).collect() == []


def test_held_dictionary_leaves_one_shuffle(tickets):
    frame = tickets(planted(3))
    found = tm.weighted_texts(frame, tm.term_dictionary(frame, frame.count()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(ticket_id") == 1 and "hashpartitioning(term" not in plan
    assert "Window" not in plan


def test_theme_term_weights_by_number(tickets):
    frame = tickets(planted(8))
    groups = frame.selectExpr("ticket_id", "ticket_id % 3 as theme_id")
    dictionary = tm.term_dictionary(frame, frame.count())
    by_number = tm.theme_term_weights(tm.weighted_texts(frame, dictionary), groups, dictionary=dictionary)
    by_name = tm.theme_term_weights(tm.tfidf(frame), groups)
    rows = lambda df: sorted((r.theme_id, r.term, round(r.mean_weight, 9)) for r in df.collect())
    assert rows(by_number) == rows(by_name) != []


def test_texts_are_taken_apart_once(tickets):
    """No filter repeats the tokenising below the shuffle of the texts."""
    plan = tm.term_counts(tickets(planted(2)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert plan.count("Exchange") == 1


def brute_representatives(sims, keep):
    """{theme: [(id, rank)]} by the rules, over whole themes."""
    chosen = {}
    for theme, members in sims.items():
        ranked = sorted(members, key=lambda m: (-m[1], m[0]))
        values = [s for _, s in ranked]
        if len(ranked) > 3:
            cutoff = max(0.5, float(np.quantile(values, 0.7)), 0.78 * values[0])
            ranked = [m for m in ranked if m[1] >= cutoff] or ranked
        chosen[theme] = [(i, r) for r, (i, _) in enumerate(ranked[: max(1, keep)], 1)]
    return chosen


@pytest.mark.parametrize("keep", [0, 1, 3, 10])
def test_representatives(keep, spark):
    rng = random.Random(keep)
    sims, flat = {}, []
    for theme, size in enumerate([1, 2, 3, 4, 5, 9, 11, 12, 13, 20, 33, 36, 37, 60, 200]):
        top = rng.choice([0.3, 0.6, 1.0])
        sims[theme] = [(i, round(rng.uniform(-0.2, top), 2)) for i in range(size)]
        flat += [(theme, i, s) for i, s in sims[theme]]
    df = spark.createDataFrame(flat, "theme_id int, ticket_id long, similarity double")
    got = {}
    for r in cl.theme_representatives(df, keep).orderBy("representative_rank").collect():
        got.setdefault(r.theme_id, []).append((r.ticket_id, r.representative_rank))
    assert got == brute_representatives(sims, keep)


def test_similarities(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((40, 5))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[7] = 0
    theme = [i % 3 for i in range(40)]
    rows = [(i, theme[i], Vectors.dense(v)) for i, v in enumerate(vectors)]
    assigned = spark.createDataFrame(rows, ["ticket_id", "theme_id", "features"])
    got = cl.theme_similarities(assigned, cl.mean_centers(assigned)).collect()
    for r in got:
        center = vectors[[t == r.theme_id for t in theme]].mean(axis=0)
        expected = vectors[r.ticket_id] @ center / (np.linalg.norm(center) + 1e-12)
        assert r.similarity == pytest.approx(expected, abs=1e-9)


def test_select_k():
    assert cl.select_k({8: 0.30, 9: 0.315, 10: 0.33, 11: 0.2}) == 9
    assert cl.select_k({8: -0.5}) == 8


@pytest.fixture
def corpus(tickets):
    """Planted texts, two of them without terms, with weights and their matrix."""
    docs = planted(30)
    docs += [(1000 + i, "none", "s", "d", text) for i, text in enumerate(["12 34 " * 5, "1 " * 20])]
    frame = tickets(docs)
    weights = tm.tfidf(frame).cache()
    vocab = sorted(r.term for r in weights.select("term").distinct().collect())
    column = {t: j for j, t in enumerate(vocab)}
    matrix = np.zeros((len(docs), len(vocab)))
    row = {d[0]: i for i, d in enumerate(docs)}
    for r in weights.collect():
        matrix[row[r.ticket_id], column[r.term]] = r.weight
    return frame, weights, matrix


def test_vectors_of_packed_weights(corpus, spark):
    frame, long, matrix = corpus
    n_docs, n_terms = matrix.shape
    dictionary = tm.term_dictionary(frame, n_docs)
    packed = tm.weighted_texts(frame, dictionary)
    assert dictionary.count() == n_terms
    found = gram_of(vc.semantic_vectors(packed, frame, n_docs, n_terms))
    assert np.abs(found - exact_gram(matrix)).max() < 0.05  # as for long weights
    two = frame.limit(2)
    few = tm.term_dictionary(two, 2)
    plain = gram_of(vc.semantic_vectors(tm.weighted_texts(two, few), two, 2, few.count()))
    assert np.allclose(np.diag(plain), 1)


def gram_of(vectors):
    features = [r.features for r in vectors.orderBy("ticket_id").collect()]
    return np.array(features) @ np.array(features).T


def exact_gram(matrix):
    k = max(2, min(100, matrix.shape[0] - 1, matrix.shape[1] - 1))
    u, s, _ = np.linalg.svd(matrix, full_matrices=False)
    dense = u[:, :k] * s[:k]
    norm = np.linalg.norm(dense, axis=1, keepdims=True)
    dense = np.divide(dense, norm, out=np.zeros_like(dense), where=norm > 1e-9)
    return dense @ dense.T


@pytest.fixture(params=["one block", "many blocks"])
def blocks(request, monkeypatch):
    if request.param == "many blocks":
        for name, value in (("RUN_TEXTS", 16), ("RUN_TERMS", 40), ("BLOCK_CELLS", 100), ("PART_ROWS", 5), ("CELLS_AT_ONCE", 7)):
            monkeypatch.setattr(vc, name, value)


def test_vectors_match_the_exact_decomposition(corpus, blocks):
    frame, weights, matrix = corpus
    n_docs, n_terms = matrix.shape
    found = gram_of(vc.semantic_vectors(weights, frame, n_docs, n_terms))
    assert np.abs(found - exact_gram(matrix)).max() < 0.05
    assert not found[-2:].any()
    projection = vc.project(weights, frame, n_docs, n_terms)
    exact = np.linalg.svd(matrix, compute_uv=False)[: len(projection.values)]
    assert np.allclose(projection.values[:60], exact[:60], rtol=1e-3)
    assert np.allclose(projection.values, exact, rtol=0.05, atol=0.02)


def test_low_rank_is_exact(corpus, blocks):
    """As many directions as the rank: all products of rows come back."""
    frame, weights, matrix = corpus
    few = weights.where(F.length("term") < 8)
    terms = few.select("term").distinct().count()
    assert 3 < terms < 60
    twice = few.union(few.withColumn("term", F.concat("term", F.lit(" again"))))
    rows = vc.project(twice, frame, len(matrix), 2 * terms).rows.orderBy("ticket_id").collect()
    dense = np.array([r.dense for r in rows])
    column = {t: j for j, t in enumerate(sorted(r.term for r in few.select("term").distinct().collect()))}
    exact = np.zeros((len(matrix), terms))
    order = {i: n for n, i in enumerate(sorted(r.ticket_id for r in frame.select("ticket_id").collect()))}
    for r in few.collect():
        exact[order[r.ticket_id], column[r.term]] = r.weight
    assert np.abs(dense @ dense.T - 2 * exact @ exact.T).max() < 1e-5


def test_themes_do_not_depend_on_the_partitioning(spark):
    rng = np.random.default_rng(8)
    points = rng.standard_normal((300, 7)) + 4 * rng.standard_normal((6, 7))[np.arange(300) % 6]
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "ticket_id long, features array<double>")
    seen = set()
    for parts in (1, 8, 64):
        vectors = rows.orderBy(F.xxhash64("ticket_id", F.lit(parts))).repartition(parts)
        clustering = cl.choose_k(vectors, 300, 2, 12)
        themes = cl.assign_themes(vectors, clustering).orderBy("ticket_id").select("theme_id").collect()
        seen.add((clustering.k, tuple(sorted(clustering.scores.items())), tuple(t.theme_id for t in themes)))
    assert len(seen) == 1


def test_every_k_equals_lloyds_and_the_silhouette_by_definition(spark):
    rng = np.random.default_rng(9)
    points = rng.standard_normal((150, 4))
    points[:20] = points[0]
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "ticket_id long, features array<double>")
    seeds = cl._seed_points(rows, "ticket_id")
    clustering = cl.choose_k(rows, 150, 2, 9)
    for k, score in clustering.scores.items():
        centers = cl._start(seeds, k, 42) / cl.GRID
        for _ in range(300):
            near = ((points[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([points[near == c].mean(axis=0) if (near == c).any() else centers[c] for c in range(k)])
            moved, centers = np.sqrt(((new - centers) ** 2).sum(axis=1)).max(), new
            if moved < cl.SETTLED:
                break
        near = ((points[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
        away = ((points[:, None] - points) ** 2).sum(axis=2)
        total = 0.0
        for i, own in enumerate(near):
            size = (near == own).sum()
            if size > 1:
                a = away[i][near == own].sum() / (size - 1)
                b = min(away[i][near == c].mean() for c in set(near) - {own})
                total += (b - a) / max(a, b)
        assert score == pytest.approx(total / len(points), abs=2e-3)
    assert clustering.k == cl.select_k(clustering.scores)


def purity(result, docs):
    topic = {d[0]: d[1] for d in docs}
    themes = {}
    for r in result.ticket_themes.collect():
        themes.setdefault(r.theme_id, []).append(topic[r.ticket_id])
    total = sum(len(t) for t in themes.values())
    return sum(max(Counter(t).values()) for t in themes.values()) / total


def test_planted_groups_are_found(tickets):
    docs = planted(25)
    docs.append((500, "short", "short", "short", "corto"))
    result = build_themes(tickets(docs), k_min=2, k_max=6, top_representatives=4)
    assert result.used_silhouette and 2 <= result.selected_k <= 6
    assert (result.total_descriptions, result.eligible_descriptions) == (101, 100)
    assert result.excluded_short_descriptions == 1
    assert result.stats().first().selected_k == result.selected_k
    assert purity(result, docs) > 0.95 or result.selected_k < 4

    themes = result.themes.collect()
    assert result.themes.dtypes == [(f.name, f.dataType.simpleString()) for f in THEME_SCHEMA]
    assert [t["count"] for t in themes] == sorted((t["count"] for t in themes), reverse=True)
    assert sum(t["count"] for t in themes) == 100
    for t in themes:
        words = t.keywords.split(", ")
        assert 0 < len(words) <= 12 and t.label == ", ".join(words[:4])[:80]

    chosen = {}
    for r in result.ticket_themes.orderBy("theme_id", "representative_rank").collect():
        assert (r.representative_rank is None) == (r.Description_trimmed is None)
        if r.representative_rank is not None:
            chosen.setdefault(r.theme_id, []).append(r)
    for t in themes:
        reps = chosen[t.theme_id]
        assert [r.representative_rank for r in reps] == list(range(1, len(reps) + 1))
        similar = [r.representative_similarity for r in reps]
        assert similar == sorted(similar, reverse=True) and len(reps) <= 4
        assert t.example_summaries == " | ".join(r.Summary for r in reps)


@pytest.mark.parametrize(
    "n_docs, k, silhouette",
    [(1, 1, False), (2, 2, False), (8, 8, False), (9, 8, True)],
)
def test_number_of_themes_for_few_texts(n_docs, k, silhouette, tickets):
    result = build_themes(tickets(planted(4)[:n_docs]))
    assert result.selected_k == k
    assert result.used_silhouette == silhouette
    assert result.themes.agg(F.sum("count")).first()[0] == n_docs
    assert result.ticket_themes.count() == n_docs


def test_nothing_to_group(tickets):
    for frame in (
        tickets([]),
        tickets(planted(1)).withColumn("Description_clean", F.lit("corto")),
        tickets(planted(1)).drop("Description_clean"),
        tickets(planted(1)).withColumn("Description_clean", F.lit("12 34 56 78 90 12 34 56")),
    ):
        result = build_themes(frame)
        assert result.selected_k == 0 and not result.used_silhouette
        assert result.themes.dtypes == [(f.name, f.dataType.simpleString()) for f in THEME_SCHEMA]
        assert result.themes.count() == result.ticket_themes.count() == 0
        assert "theme_id" in result.ticket_themes.columns
    sentence = tt.top_theme_sentence(result.themes, result.ticket_themes).first().sentence
    assert sentence == "No hay temas disponibles para resumir."


def test_equal_tickets_stay_single_rows(tickets):
    """A third of all tickets being copies of one changes no count."""
    docs = planted(10)
    docs += [(100 + i, "red", docs[0][2], docs[0][3], docs[0][4]) for i in range(20)]
    result = build_themes(tickets(docs), k_min=2, k_max=4)
    assert result.ticket_themes.count() == len(docs)
    assert result.themes.agg(F.sum("count")).first()[0] == len(docs)


THEMES = "theme_id int, label string, count long, keywords string, example_summaries string"


def test_sentences(spark):
    themes = spark.createDataFrame(
        [
            (0, "uno", 9, "a, b, c, d", ""),
            (1, "dos", 5, "", ""),
            (2, " ", 1, "", ""),
            (3, "tres", 2, "x", ""),
        ],
        THEMES,
    )
    members = spark.createDataFrame(
        [(0, 1, "  "), (0, 2, "- Falla\nsegunda"), (0, 3, "otra"), (0, 4, "más")]
        + [(1, i, None) for i in range(5)]
        + [(1, 9, "sexta"), (2, 1, ""), (3, 1, "---")],
        "theme_id int, ticket_id long, Summary string",
    )
    got = {r.theme_id: r.sentence for r in tt.theme_example_sentences(themes, members).collect()}
    assert got == {0: "Casos como: Falla.", 1: "dos", 2: "Casos diversos.", 3: "tres"}
    assert tt.generate_theme_example_sentence(0, themes, members) == "Casos como: Falla."
    assert tt.generate_theme_example_sentence(7, themes, members) == "Sin descripción disponible."
    top = tt.top_theme_sentence(themes, members).first().sentence
    assert top == (
        "El tema principal (9 tickets) trata sobre 'uno', con foco en a, b, c "
        "y casos como: - Falla\nsegunda; otra."
    )
    second = tt.top_theme_sentence(themes.where("theme_id = 1"), members).first().sentence
    assert second == (
        "El tema principal (5 tickets) es 'dos', con casos como: sin ejemplos destacados."
    )


def test_ranks_and_parameters(spark):
    themes = spark.createDataFrame([(4, 1), (2, 7), (3, 7)], "theme_id int, count long")
    ranked = tt.rank_themes(themes).collect()
    assert [(r["rank"], r.theme_id) for r in ranked] == [(1, 2), (2, 3), (3, 4)]
    assert [r.theme_id for r in tt.top_themes(themes, 2).collect()] == [2, 3]
    assert tt.theme_params(12) == {"top_keywords": 12, "label_terms": 6, "top_representatives": 6}
    assert tt.theme_params(20) == {"top_keywords": 20, "label_terms": 8, "top_representatives": 10}
    assert tt.theme_params(4) == {"top_keywords": 4, "label_terms": 3, "top_representatives": 3}


def test_repeated_ids_and_odd_rows_in_batches(tickets, monkeypatch):
    """Texts of one id are weighted together, a null id is an id, and n-grams never cross texts; in many batches."""
    docs = planted(20)
    docs += [(3, "x", "s", "d", "router cable"), (3, "x", "s", "d", "cable router"), (None, "x", "s", "d", "router clave"),
             (None, "x", "s", "d", "clave papel"), (5000, "x", "s", "d", None)]
    frame = tickets(docs)
    dictionary = tm.term_dictionary(frame, len(docs))

    def cells(texts):
        return {r.ticket_id: {c.term_no: pytest.approx(c.weight) for c in r.cells} for r in texts.collect()}

    held = cells(tm.weighted_texts(frame, dictionary))
    monkeypatch.setattr(tm, "HELD_TERMS", 0)
    monkeypatch.setattr(tm, "BATCH_CHARS", 500)
    monkeypatch.setattr(tm, "TOKENS_AT_ONCE", 30)
    rows = tm.weighted_texts(frame, dictionary).collect()
    assert len(rows) == len(held) and None in held
    assert {r.ticket_id: {c.term_no: c.weight for c in r.cells} for r in rows} == held
    again = tm.term_dictionary(frame, len(docs)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, dictionary.collect()))


def test_tasks_of_terms_grow_with_the_texts(tickets, monkeypatch):
    """No task of the vocabulary, the weights or the sums of themes grows with the table."""
    frame = tickets(planted(20))
    exchanges = lambda df: re.findall(r"(?:hash|range)partitioning\((.*?), (\d+)\)", df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(tm, "BATCH_CHARS", 100)
    monkeypatch.setattr(tm, "TERMS_PER_TASK", 5)
    monkeypatch.setattr(tm, "HELD_TERMS", 0)
    chars = sum(len(d[4]) for d in planted(20))
    dictionary = tm.term_dictionary(frame, frame.count())
    texts = tm.weighted_texts(frame, dictionary)
    groups = frame.selectExpr("ticket_id", "ticket_id % 3 as theme_id")
    sums = tm.theme_term_weights(texts, groups, dictionary=dictionary)
    least = {"vocabulary": chars // 100, "texts": chars // 100, "sums": chars // 100}
    for name, df in (("vocabulary", tm.vocabulary(frame, frame.count())), ("texts", texts)):
        found = exchanges(df)
        assert found and all(int(n) >= least[name] for _, n in found), name
    assert any("term_no" in key and int(n) > dictionary.count() // 5 for key, n in exchanges(sums))


def test_few_terms_are_not_cut_where_texts_are(monkeypatch):
    """All texts are sent to each run of terms, so there are no more runs than the cores need."""
    assert vc._Grid.of(3_000_000, 330, 3_000_000 * 33, 12).term_runs == 1
    assert vc._Grid.of(49_453, 3_508_091, 30_000_000, 8).text_runs == 1
    assert vc._Grid.of(1000, 80, 20_000, 8).term_runs == 8


def _scratch_bytes(spark):
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(folder) for name in names)


def _random_texts(n_texts, n_words, n_different):
    """Texts in which most runs of words occur once; the last text is a copy of the first."""
    random = np.random.default_rng(5)
    words = ["w" + "".join(random.choice(list("abcdefgh"), 5)) for _ in range(n_different)]
    texts = [" ".join(words[i] for i in random.integers(0, n_different, n_words)) for _ in range(n_texts - 1)]
    return [*texts, texts[0]]


def test_terms_of_one_text_are_neither_written_nor_asked_for(spark, tickets, monkeypatch):
    """Weights of many texts equal brute force; what is written for them is less than the texts, not all their terms."""
    monkeypatch.setattr(tm, "HELD_TERMS", 0)
    monkeypatch.setattr(tm, "BATCH_CHARS", 200_000)
    texts = _random_texts(200, 300, 4000)
    frame = tickets([(i, "x", "s", "d", text) for i, text in enumerate(texts)]).cache()
    dictionary = tm.term_dictionary(frame, len(texts)).cache()
    terms = {r.term_no: r.term for r in dictionary.collect()}
    before = _scratch_bytes(spark)
    rows = tm.weighted_texts(frame, dictionary).collect()
    assert _scratch_bytes(spark) - before < sum(map(len, texts))
    expected = brute_tfidf(dict(enumerate(texts)))
    assert set(terms.values()) == {term for weights in expected.values() for term in weights}
    assert {r.ticket_id: {terms[c.term_no]: pytest.approx(c.weight) for c in r.cells} for r in rows} == expected


def test_hashes_of_spelled_terms_and_of_numbered_ones_agree():
    lists = pa.array([["aaa", "bbb", "aaa", "bbb"], [], ["bbb", "aaa", "ccc"]])
    *_, terms = tm._terms_of(*tm._numbered(lists), np.arange(3))
    spelled = terms.spelled(np.arange(len(terms)))
    assert sorted(spelled.to_pylist()) == sorted(
        ["aaa", "bbb", "ccc", "aaa bbb", "bbb aaa", "aaa ccc", "aaa bbb aaa", "bbb aaa bbb", "bbb aaa ccc"]
    )
    assert terms.spelled(np.array([1, 4, 7])).to_pylist() == [spelled[i].as_py() for i in (1, 4, 7)]
    assert (tm._hashes_of(spelled) == terms.hashes()).all() and len(set(terms.hashes())) == len(terms)


def test_groups_are_sent_to_the_weights(tickets, monkeypatch):
    """Weights, many times larger than the groups, are not shuffled to meet them; beyond the bound the rows are the same."""
    monkeypatch.setattr(tm, "HELD_TERMS", 0)
    frame = tickets(planted(8))
    groups = frame.selectExpr("ticket_id", "ticket_id % 3 as theme_id").where("ticket_id != 5")
    dictionary = tm.term_dictionary(frame, frame.count())
    weights = tm.weighted_texts(frame, dictionary)
    sums = tm.theme_term_weights(weights, groups, dictionary=dictionary)
    assert "hashpartitioning(ticket_id" not in sums._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(tm, "HELD_GROUPS", 0)
    apart = tm.theme_term_weights(weights, groups, dictionary=dictionary)
    assert "hashpartitioning(ticket_id" in apart._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted((r.theme_id, r.term, round(r.mean_weight, 9)) for r in df.collect())
    assert rows(sums) == rows(apart) != []


def test_text_cosines_do_not_write_all_weights(spark, tmp_path):
    """Only the weights of the most widespread terms are written, although every text has hundreds of others."""
    texts = [f"{text} {i // 2}" for i, text in enumerate(t for t in _random_texts(150, 300, 4000) for _ in range(2))]
    rows = [(i, text, "en", f"src{i % 3}", len(text)) for i, text in enumerate(texts)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    before = _scratch_bytes(spark)
    found = entry_queries()["text_cosines"](spark, str(tmp_path)).collect()
    assert len(found) == len(texts) - 1 and all(r.same for r in found)
    assert _scratch_bytes(spark) - before < 5 * sum(map(len, texts))


def test_rows_of_many_terms_are_not_shuffled(corpus, monkeypatch):
    """With many texts and terms each task has all texts, some columns at a time; products of rows come back exactly."""
    grid = vc._Grid.of(512_000, 15_000_000, 240_000_000, 6)
    assert grid.whole and grid.tasks == 8 and grid.text_runs == 1
    frame, weights, matrix = corpus
    for name, value in (("RUN_TEXTS", 16), ("RUN_TERMS", 5), ("PART_ROWS", 5), ("CELLS_AT_ONCE", 7)):
        monkeypatch.setattr(vc, name, value)
    monkeypatch.setattr(vc._Grid, "of", lambda n_docs, n_terms, *_: vc._Grid(n_docs, n_terms, n_docs, 8, True, 3))
    sent, products = [], vc._whole_products
    monkeypatch.setattr(vc, "_whole_products", lambda *given: sent.append(given[3]) or products(*given))
    few = weights.where(F.length("term") < 8)
    words = sorted(r.term for r in few.select("term").distinct().collect())
    rows = vc.project(few, frame, len(matrix), len(words)).rows.orderBy("ticket_id").collect()
    assert max(sent) < len(words) and sum(sent) > (vc.POWER_ITERATIONS + 1) * max(sent)
    exact = np.zeros((len(matrix), len(words)))
    order = {row.ticket_id: at for at, row in enumerate(rows)}
    for r in few.collect():
        exact[order[r.ticket_id], words.index(r.term)] = r.weight
    k = max(2, len(words) - 1)
    u, s, v = np.linalg.svd(exact, full_matrices=False)
    nearest = (u[:, :k] * s[:k]) @ v[:k]
    dense = np.array([r.dense for r in rows])
    assert np.abs(dense @ dense.T - nearest @ nearest.T).max() < 1e-3
