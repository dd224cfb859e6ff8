"""Exact deduplication that no group of copies can slow down.

Texts are merged in three steps, each of which compares whole texts: inside a task (the partial
aggregation), among rows of the same digest and salt, then among the winners of all salts. What
remains of a repeated text is a row of under a hundred bytes. Rows find their group by the
digest and a second fingerprint of the text; groups with very many rows, of which there can only be
few, are broadcast instead of shuffled, so no task receives all rows of such a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import WHITE_SPACE, attach_groups, ids_and_texts
from ticketlens.session import free_name, reliable_checkpoint

#: Parts that copies of one text are dealt to before the winners meet.
SALTS = 64


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(text, WHITE_SPACE + "+", " ")


def _digest(text: Column) -> dict[str, Column]:
    return {"digest": F.unhex(F.sha2(text, 256)), "mark": F.xxhash64(text)}


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row for each row of `docs`.

    Texts are equal when identical after `normalised`; a null text counts as empty. The row with the smallest
    id of a group stays; a null id is larger than every other and is `keep_id` only of a group of null
    ids. Rows that repeat both id and text all count, and all are `kept` if one is. An empty
    table gives no rows. Other columns of `docs` play no part.
    """
    texts = ids_and_texts(docs, id_col, text_col).withColumn("text", normalised(F.col("text")))
    hashed = texts.withColumns(_digest(F.col("text")))
    winners = reliable_checkpoint(_repeated(hashed, salts))
    rows = hashed.select("doc_id", "digest", "mark")
    found = attach_groups(rows, winners, ["digest", "mark"], "group_size", docs.count())
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    numbered = found.select(
        "doc_id",
        "digest",
        F.coalesce("keep", own).alias("keep"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
    )
    return numbered.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep.doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _repeated(hashed: DataFrame, salts: int) -> DataFrame:
    """(digest, mark, keep, group_size) of texts with more than one row."""
    salted = hashed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    parts = salted.groupBy("digest", "mark", "salt", "text").agg(
        least.alias("keep"), F.count(F.lit(1)).alias("n")
    )
    groups = parts.groupBy("digest", "mark", "text").agg(
        F.min("keep").alias("keep"), F.sum("n").alias("group_size")
    )
    return groups.where("group_size > 1").drop("text")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts, all columns kept, whatever their names.

    The row with the smallest id stays, a null id only if the whole group has none; of rows that repeat id and text,
    one. Null texts are empty. An empty table stays empty.
    """
    own, mark, gone, digest = (free_name(name, docs) for name in ("own", "mark", "gone", "digest"))
    groups = exact_groups(docs, id_col, text_col)
    # Structs of null are equal, so ids that are null are joined like all others.
    dropped = groups.where(~F.col("kept")).select(
        F.struct(F.col("doc_id").alias("id")).alias(gone), F.unhex("text_sha256").alias(digest)
    )
    text = normalised(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    marked = docs.withColumns(
        {own: F.struct(F.col(f"`{id_col}`").alias("id")), mark: F.unhex(F.sha2(text, 256))}
    )
    # Repeats of a row are combined in each task before they meet. What is left is dealt by the keys of the
    # join, so whole rows are shuffled once.
    single = marked.dropDuplicates([own, mark])
    same = (F.col(own) == F.col(gone)) & (F.col(mark) == F.col(digest))
    return single.join(dropped.distinct(), same, "left_anti").drop(own, mark)
