"""Token counts without token ids: pieces are counted once per distinct pre-token.

First pass: all pre-tokens of all texts with their frequencies; the tokenizer counts the pieces of each
distinct one. Second pass: a text's pre-token frequencies meet these counts. The most frequent
pre-tokens, 2^18 at most, are added up inside the tasks; all others are joined through a shuffle,
where none of them can be a hot key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import (
    frequent_from,
    ids_and_texts,
    read_bytes,
    single_threaded,
    sql_type,
)
from ticketlens.llm.pretokens import ChunkCache, parts_and_chunks, piece_finder
from ticketlens.session import reliable_checkpoint

#: So many of the most frequent pre-tokens are held by every task, at most.
HELD = 1 << 18
#: Distinct chunks that a task gathers before it hands their pre-tokens on.
CHUNKS_AT_ONCE = 300_000


def piece_splitter(content: bytes, pattern: str) -> Callable[[str], list[str]]:
    """Function that cuts a chunk into pre-tokens; special strings stand alone.

    `content` is a tokenizer file whose pre-tokenizer is byte-level, with the given pattern.
    """
    import json

    described = json.loads(content)
    before = described.get("pre_tokenizer") or {}
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
        raise ValueError("the tokenizer's pre-tokens are not byte-level words")
    if described.get("normalizer") is not None:
        raise ValueError("the tokenizer rewrites texts before cutting them")
    specials = sorted((t["content"] for t in described["added_tokens"]), key=len, reverse=True)
    pieces = piece_finder(pattern)
    if not specials:
        return pieces
    special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")")

    def split(chunk: str) -> list[str]:
        for text in specials:
            if text in chunk:
                break
        else:
            return pieces(chunk)
        found = []
        for i, part in enumerate(special.split(chunk)):
            found.extend([part] if i % 2 else pieces(part))
        return found

    return split


def pretoken_counts(texts: DataFrame, content: bytes, pattern: str) -> DataFrame:
    """(piece, count) of all pre-tokens of the column `text`."""
    shared = texts.sparkSession.sparkContext.broadcast(content)
    names = ["piece", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = piece_splitter(shared.value, pattern)
        spaced: Counter[str] = Counter()  # without their leading space
        others: Counter[str] = Counter()

        def pieces() -> pa.RecordBatch:
            counts: dict[str, int] = {}
            get = counts.get
            for chunks, before in ((spaced, " "), (others, "")):
                for chunk, n in chunks.items():
                    for piece in split(before + chunk):
                        counts[piece] = get(piece, 0) + n
                chunks.clear()
            columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for rows in batches:
            for text in rows.column(0):
                parts, chunks = parts_and_chunks(text.as_py())
                spaced.update(parts)
                others.update(chunks)
                if len(spaced) + len(others) > CHUNKS_AT_ONCE:
                    yield pieces()
        yield pieces()

    found = texts.select("text").mapInArrow(run, "piece string, count long")
    return found.groupBy("piece").agg(F.sum("count").alias("count"))


def _with_tokens(pieces: DataFrame, content: bytes) -> DataFrame:
    """(piece, count, n): how many tokens the tokenizer makes of each distinct piece."""
    shared = pieces.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_buffer(shared.value)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        for rows in batches:
            n = []
            for at in range(0, rows.num_rows, 1000):
                texts = rows.column(0).slice(at, 1000).to_pylist()
                found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
                n.extend(map(len, found))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(n, pa.int32())], names=["piece", "count", "n"]
            )

    return pieces.mapInArrow(run, "piece string, count long, n int")


def token_counts(
    docs: DataFrame,
    path: str,
    pattern: str,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row for each row of `docs`, whole texts.

    `path` is a byte-level tokenizer file, read on the driver; special strings in texts count as one
    token, none are added, nothing is cut or padded. Null and empty texts have 0 bytes and 0 tokens.
    Rows may repeat, also with null ids; each gives its row. An empty table gives none.
    """
    content = read_bytes(path)
    texts = ids_and_texts(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    pieces = reliable_checkpoint(_with_tokens(pretoken_counts(texts, content, pattern), content))
    hot = pieces.where(F.col("count") >= frequent_from(pieces, HELD)).select("piece", "n").toArrow()
    held = texts.sparkSession.sparkContext.broadcast(
        (content, dict(zip(hot.column(0).to_pylist(), hot.column(1).to_pylist())))
    )
    kind = sql_type(texts, "doc_id")
    names = ["doc_id", "mark", "n_bytes", "held", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, known = held.value
        split, get = piece_splitter(content, pattern), known.get

        def value(chunk: str) -> int | tuple[int, list[str]]:
            pieces = split(chunk)
            counts = [get(piece) for piece in pieces]
            if None not in counts:
                return sum(counts)
            rest = [piece for piece, n in zip(pieces, counts) if n is None]
            return sum(n for n in counts if n is not None), rest

        cache = ChunkCache(lambda chunks: list(map(value, chunks)))
        element = pa.struct([("piece", pa.string()), ("times", pa.int32())])
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                part = rows.slice(at, 256)
                sizes, sums, rests = [], [], []
                for text in part.column(1).to_pylist():
                    n, rest = 0, []
                    for found in cache.values(text):
                        if type(found) is int:
                            n += found
                        else:
                            n += found[0]
                            rest += found[1]
                    sizes.append(len(text.encode()))
                    sums.append(n)
                    rests.append([{"piece": p, "times": t} for p, t in Counter(rest).items()])
                columns = [
                    part.column(0),
                    part.column(2),
                    pa.array(sizes, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array(rests, pa.list_(element)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    found = texts.mapInArrow(
        run,
        f"doc_id {kind}, mark long, n_bytes long, held long, rest array<struct<piece:string,times:int>>",
    )
    # A text without rest keeps one row; its key is its own, so that such rows do not meet in one task.
    rest = found.select("doc_id", "mark", "n_bytes", "held", F.posexplode_outer("rest").alias("at", "rest"))
    rest = rest.select(
        "doc_id",
        "mark",
        # Kept once for each text; zeros take next to no room in a shuffle.
        *[F.when(F.coalesce("at", F.lit(0)) == 0, F.col(c)).otherwise(0).alias(c) for c in ("n_bytes", "held")],
        F.coalesce(F.col("at"), F.lit(0)).alias("at"),
        F.coalesce("rest.piece", F.concat(F.lit("\0 "), F.col("mark"))).alias("piece"),
        F.col("rest.times").alias("times"),
    )
    joined = rest.join(pieces.select("piece", "n"), "piece", "left")
    # Equal rows give equal numbers, so the sum over all of them is shared out again.
    rows = joined.groupBy("doc_id", "mark").agg(
        F.max("n_bytes").alias("n_bytes"),
        F.max("held").alias("held"),
        F.sum(F.when(F.col("at") == 0, 1).otherwise(0)).alias("copies"),
        F.sum(F.coalesce(F.col("times") * F.col("n"), F.lit(0)).cast("long")).alias("rest"),
    )
    n_tokens = (F.col("held") + F.expr("rest div copies")).cast("long")
    return rows.select(
        "doc_id",
        "n_bytes",
        n_tokens.alias("n_tokens"),
        (n_tokens > limit).alias("over_limit"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")
