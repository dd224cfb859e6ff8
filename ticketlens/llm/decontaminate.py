"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

A seed mask names the token positions that are hashed; the others are ignored, so a substituted
token at an ignored position does not hide an overlap. Hashes of all masks at all positions of documents are
joined with those of the test items; each hit names a document, an item and how they are aligned. The
tokens of the item are then compared with the aligned tokens of the document. The masks are chosen so
that every window of 10 to 13 tokens with at most two substitutions has a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import ids_and_texts
from ticketlens.session import free_name, reliable_checkpoint

#: Token positions that count, by mask.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
#: Tokens of the window that is compared, or all tokens of an item with fewer.
WINDOW = 13
SUBSTITUTIONS = 2
#: Items with fewer tokens must occur unchanged.
SHORTEST_INEXACT = 10
#: Items with fewer tokens than the least mask cannot be told from chance and are not looked for.
SHORTEST = 5
#: Seeds of test items that every executor may hold (a long and two ints each).
BROADCAST_SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda word: word != "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda word: F.xxhash64(word))


def _seeds(hashes: Column) -> Column:
    """Array of (hash, at) of every mask at every position."""

    def seed(number: int, mask: tuple[int, ...]):
        def at_place(at: Column) -> Column:
            picked = [F.get(hashes, at + place) for place in mask]
            return F.struct(F.xxhash64(F.lit(number), *picked).alias("seed"), at.alias("at"))

        return at_place

    found = []
    none = F.array().cast("array<struct<seed:bigint,at:int>>")
    for number, mask in enumerate(MASKS):
        last = F.size(hashes) - mask[-1] - 1
        places = F.transform(F.sequence(F.lit(0), last), seed(number, mask))
        found.append(F.when(last >= 0, places).otherwise(none))
    return F.concat(*found)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_matched, n_window, first_token, item_tokens): documents that hold test items.

    One row for each document and item with an overlap: a window of 13 item tokens (or the whole item when it has 10
    to 12) of which at most two differ from the aligned tokens of the document; items of 5 to 9 tokens
    must occur unchanged, shorter ones are not looked for. `n_matched` counts the equal tokens of the best
    window, `first_token` is the document token that the item's first token is aligned with (negative
    when the document starts inside the item); of equally good places the first. Null texts and items are
    empty. Rows that repeat id and text give one row, as do such items; null ids stay null. No row of
    either table that has no overlap comes out. Other columns play no part.
    """
    # Which rows meet is told by id and text, as ids may repeat or be null.
    mark = F.xxhash64("text")
    texts = ids_and_texts(docs, id_col, text_col).withColumn("mark", mark)
    items = ids_and_texts(benchmark, item_id_col, item_text_col).withColumnRenamed("doc_id", "item_id")
    items = items.withColumn("item_tokens", tokens(F.col("text"))).where(F.size("item_tokens") >= SHORTEST)
    items = items.select("item_id", mark.alias("item_mark"), "item_tokens").dropDuplicates(["item_id", "item_mark"])
    items = reliable_checkpoint(items)
    of_items = items.withColumn("hashes", _hashes(F.col("item_tokens"))).select(
        "item_id", "item_mark", F.size("item_tokens").alias("n"), F.explode(_seeds(F.col("hashes"))).alias("s")
    )
    of_items = reliable_checkpoint(
        of_items.select("item_id", "item_mark", "n", F.col("s.seed").alias("seed"), F.col("s.at").alias("item_at"))
    )
    hashed = texts.withColumn("hashes", _hashes(tokens(F.col("text"))))
    of_docs = hashed.select("doc_id", "mark", F.explode(_seeds(F.col("hashes"))).alias("s"))
    of_docs = of_docs.select("doc_id", "mark", F.col("s.seed").alias("seed"), F.col("s.at").alias("at"))
    small = of_items.count() <= BROADCAST_SEEDS
    hits = of_docs.join(F.broadcast(of_items) if small else of_items, "seed").select(
        "doc_id", "mark", "item_id", "item_mark", "n", (F.col("at") - F.col("item_at")).alias("shift")
    )
    # As many alignments as the document's own tokens can have; a document's come together.
    alignments = hits.groupBy("doc_id", "mark").agg(
        F.collect_set(F.struct("item_id", "item_mark", "n", "shift")).alias("hits")
    )
    alignments = reliable_checkpoint(alignments.withColumnsRenamed({"doc_id": "d", "mark": "m"}))
    same = texts["doc_id"].eqNullSafe(F.col("d")) & (texts["mark"] == F.col("m"))
    met = texts.join(alignments, same).dropDuplicates(["doc_id", "mark"])
    words = met.select("doc_id", "hits", tokens(F.col("text")).alias("words"))
    part = F.transform(
        "hits",
        lambda hit: F.struct(
            hit["item_id"].alias("item_id"),
            hit["item_mark"].alias("item_mark"),
            hit["shift"].alias("shift"),
            F.transform(
                F.sequence(F.lit(0), hit["n"] - 1), lambda j: F.get(F.col("words"), hit["shift"] + j)
            ).alias("words"),
        ),
    )
    parts = words.select("doc_id", F.explode(part).alias("hit")).select("doc_id", "hit.*")
    item = items.withColumnsRenamed({"item_id": "i", "item_mark": "k"})
    aligned = parts.join(item, parts["item_id"].eqNullSafe(F.col("i")) & (parts["item_mark"] == F.col("k")))
    equal = F.zip_with(
        "words", "item_tokens", lambda x, y: F.when(x.eqNullSafe(y), F.lit(1)).otherwise(F.lit(0))
    )
    n = F.size("item_tokens")
    width = F.least(n, F.lit(WINDOW))
    window = F.transform(
        F.sequence(F.lit(1), n - width + 1),
        lambda at: F.aggregate(F.slice("equal", at, width), F.lit(0), lambda total, x: total + x),
    )
    needed = F.when(n >= SHORTEST_INEXACT, width - SUBSTITUTIONS).otherwise(width)
    compared = aligned.withColumn("equal", equal).select(
        "doc_id",
        "item_id",
        F.array_max(window).alias("n_matched"),
        width.alias("n_window"),
        needed.alias("needed"),
        "shift",
        n.alias("item_tokens"),
    )
    good = compared.where(F.col("n_matched") >= F.col("needed"))
    best = F.max(F.struct("n_matched", "n_window", (-F.col("shift")).alias("back"), "item_tokens")).alias("best")
    return good.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id",
        "item_id",
        F.col("best.n_matched").cast("long").alias("n_matched"),
        F.col("best.n_window").cast("long").alias("n_window"),
        (-F.col("best.back")).cast("long").alias("first_token"),
        F.col("best.item_tokens").cast("long").alias("item_tokens"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str
) -> DataFrame:
    """`docs` without the documents that hold test items; a null id is dropped if any null id is.

    Rows that repeat an id stay or go together; null and empty texts hold nothing and stay, as all do
    when `benchmark` is empty. An empty table stays empty; all columns are kept, whatever their names.
    """
    gone = free_name("gone", docs)
    found = contaminated(docs, benchmark, id_col, text_col, **columns)
    found = found.select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(F.col(gone)), "left_anti")
