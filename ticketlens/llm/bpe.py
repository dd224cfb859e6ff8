"""Byte-level BPE by rank, as the public rank files define it, encoded and decoded in tasks.

A segment tree over the byte positions of a pre-token holds the rank of the pair that starts at each
live position; its root is the leftmost pair of least rank. A merge retires one position and
changes the pairs of the two neighbours that stay, so it costs three updates of logarithmic depth,
whatever the length of the pre-token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from ticketlens.llm.common import batch, ids_and_texts, read_bytes, sql_type, worker_cache
from ticketlens.llm.pretokens import (
    LONGEST_CACHED,
    ChunkCache,
    piece_finder,
)

_NO_PAIR = 1 << 62
#: Chunks and pre-tokens that a worker remembers, about 150 MB of each.
CODEC_ENTRIES = 600_000


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks by token of a rank file: a base64 token and its rank in each line."""
    return {
        base64.b64decode(token): int(rank)
        for token, rank in (line.split() for line in content.splitlines() if line.strip())
    }


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: pairs of least rank are merged first, the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if not piece:
        return []
    n = len(piece)
    rank = ranks.get
    bits = (n - 1).bit_length()
    size = 1 << bits
    at = size - 1
    # Leaf i: the rank of the pair that starts at byte i, with i below it to break ties.
    tree = [_NO_PAIR] * (2 * size)
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << bits | i
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    after = list(range(1, n + 1))  # start of the next live token, n at the end
    before = list(range(-1, n - 1))

    while tree[1] != _NO_PAIR:
        i = tree[1] & at
        gone = after[i]
        follow = after[gone]
        after[i] = follow
        tree[size + gone] = _NO_PAIR
        r = None
        if follow < n:
            before[follow] = i
            r = rank(piece[i : after[follow]])
        tree[size + i] = _NO_PAIR if r is None else r << bits | i
        back = before[i]
        if back >= 0:
            r = rank(piece[back:follow])
            tree[size + back] = _NO_PAIR if r is None else r << bits | back
        else:
            back = i
        # The three leaves go up together; where their paths have met, a node is computed once.
        x, y, z = size + back >> 1, size + i >> 1, size + gone >> 1
        while z:
            left, right = tree[z + z], tree[z + z + 1]
            tree[z] = left if left < right else right
            if y != z:
                left, right = tree[y + y], tree[y + y + 1]
                tree[y] = left if left < right else right
            if x != y:
                left, right = tree[x + x], tree[x + x + 1]
                tree[x] = left if left < right else right
            x >>= 1
            y >>= 1
            z >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Codec:
    """Encodes texts by a rank table and a pre-token pattern, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = piece_finder(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.cache = ChunkCache(self._encode_chunks, CODEC_ENTRIES)
        self.known: dict[str, list[int]] = {}  # by pre-token; bounded like the chunks

    def _encode_chunks(self, chunks: Sequence[str]) -> list[tuple[int, ...]]:
        if len(self.known) > CODEC_ENTRIES:
            self.known.clear()
        return [tuple(chain.from_iterable(map(self._encode_piece, self.pieces(c)))) for c in chunks]

    def _encode_piece(self, piece: str) -> list[int]:
        ids = self.known.get(piece)
        if ids is None:
            ids = encode_piece(piece.encode(), self.ranks)
            if len(piece) <= LONGEST_CACHED:
                self.known[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.cache.values(text)))

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _codec(content: bytes, pattern: str) -> Codec:
    """The codec of a rank file; a worker keeps the last one, with its cache, from task to task."""
    key = (hashlib.sha256(content).digest(), pattern)
    kept = worker_cache()
    if kept.get("codec", (None, None))[0] != key:
        kept["codec"] = (key, Codec(read_ranks(content), pattern))
    return kept["codec"][1]


def encode_texts(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids): the token ids of each row's whole text, special strings as plain text.

    A null or empty text has no ids. Rows map to rows: repeated or null ids stay as they are, an empty
    table gives none, other columns are left out. `path` is read on the driver.
    """
    texts = ids_and_texts(docs, id_col, text_col)
    content = docs.sparkSession.sparkContext.broadcast(read_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value, pattern)
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                part = rows.slice(at, 256)
                ids = [codec.encode(text) for text in part.column(1).to_pylist()]
                column = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), column], names=["doc_id", "ids"])

    return texts.mapInArrow(run, f"doc_id {sql_type(texts, 'doc_id')}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of (doc_id, ids); null ids give empty bytes."""
    content = encoded.sparkSession.sparkContext.broadcast(read_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value, pattern)
        for rows in batches:
            texts = [codec.decode(ids or ()) for ids in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(texts, pa.binary())], names=["doc_id", "bytes"]
            )

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {sql_type(rows, 'doc_id')}, bytes binary")


def round_trip(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each row's ids and of their decoding.

    Encoded and decoded in the same task, so that ids never leave it. `ids_sha256` is of the decimal
    ids joined by commas. Null and empty texts have 0 tokens and the digests of nothing.
    """
    texts = ids_and_texts(docs, id_col, text_col)
    content = docs.sparkSession.sparkContext.broadcast(read_bytes(path))
    schema = (
        f"doc_id {sql_type(texts, 'doc_id')}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value, pattern)
        kind = pa.schema(
            [("n", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())]
        )
        for rows in batches:
            counts, digests, decoded = [], [], []
            for text in rows.column(1):
                ids = codec.encode(text.as_py())
                counts.append(len(ids))
                digests.append(hashlib.sha256(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            found = batch(kind, counts, digests, decoded)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *found.columns],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts.mapInArrow(run, schema)
