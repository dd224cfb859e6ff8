"""Token ids in files: each document is compressed alone with a shared dictionary and can be read alone.

A file set is a Parquet folder of segments. A segment holds the compressed documents of a range of
ids, one after the other, with the index of their ids, token counts and offsets and the hash of the
dictionary; the dictionary itself lies in a folder beside them. Segments come in ascending order
of `doc_id`: (part, seq) orders them. Ids are little-endian, 2 bytes wide if the vocabulary fits, else 4.
Spark's own writer commits the files, so a lost task leaves nothing half written.
"""

from __future__ import annotations

import hashlib
import string
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ticketlens.llm.common import ids_and_texts, read_bytes, single_threaded, sql_type, worker_cache
from ticketlens.llm.pretokens import ChunkCache, WordCache
from ticketlens.session import reliable_checkpoint

#: The dictionary is trained on so many documents, of at most so many characters each.
DICTIONARY_DOCUMENTS = 1000
DICTIONARY_DOCUMENT_CHARS = 16_384
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
#: A segment is closed at so many compressed bytes or documents.
SEGMENT_BYTES = 4 << 20
SEGMENT_DOCUMENTS = 4096
#: Index rows that every executor may hold when files are read.
BROADCAST_SEGMENTS = 500_000
#: Chunks of which a worker remembers the ids, about 200 MB.
CHUNKS = 1_000_000
#: Texts of so many bytes are taken apart at a time; a longer one alone.
SLICE_BYTES = 8 << 20


class Encoder:
    """Ids of texts by a tokenizer file, as bytes of the given width, an end id after each text."""

    def __init__(self, content: bytes, end_id: int):
        single_threaded()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(content)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        largest = max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id)
        self.kind = np.dtype("<u2" if largest < 1 << 16 else "<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        before = self.tokenizer.pre_tokenizer
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.by_chunk = (
            type(before).__name__ == "ByteLevel"
            and not before.add_prefix_space
            and self.tokenizer.normalizer is None
            and not any(t.lstrip or t.rstrip or len(t.content.split()) != 1 for t in added)
        )
        # Bytes that an id stands for: a byte-level token has a character for each, a special one is plain text.
        self.lengths = np.zeros(largest + 1, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.lengths[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.lengths[i] = len(token.content.encode())
        # What may be cut from a word: no mark that an added token holds.
        marks = "".join(char for char in string.punctuation if not any(char in t.content for t in added))
        words = self.by_chunk and before.use_regex and not any(t.single_word for t in added)
        self.cache = WordCache(self._encode, CHUNKS, marks) if words else ChunkCache(self._encode, CHUNKS)

    def _ids(self, text: str) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found[0].ids, self.kind)

    def _encode(self, chunks: Sequence[str]) -> list[bytes]:
        """The ids of each chunk; all are encoded as one text, which is cut by the lengths of its tokens."""
        ids = self._ids("".join(chunks))
        ends = np.cumsum([len(chunk.encode()) for chunk in chunks])
        cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
        content, width = ids.tobytes(), self.kind.itemsize
        cuts = (cuts * width).tolist()
        return [content[start:end] for start, end in zip([0, *cuts], cuts)]

    def encode(self, text: str) -> bytes:
        if not self.by_chunk:
            return self._ids(text).tobytes() + self.end
        return b"".join(self.cache.values(text)) + self.end

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text (none is null) in order; words of many texts are taken apart, looked up and put together at once."""
        if not self.by_chunk:
            for text in texts:
                yield self.encode(text.as_py())
            return
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(texts):
            before = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            yield from self._encode_slice(texts.slice(begin, end - begin))
            begin = end

    def _encode_slice(self, texts: pa.Array) -> Iterator[bytes]:
        parts = pc.split_pattern(texts, " ")
        sizes = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        lasts = np.cumsum(sizes)
        firsts = lasts - sizes
        # A word without end, or with white space there, joins what follows: texts with one are encoded alone.
        closing = [word[-1:] for word in words]
        spaces = {char for char in set(closing) if not char or char.isspace()}
        plain = np.zeros(len(texts), bool)
        if spaces:
            open_ended = np.array([char in spaces for char in closing], bool)[codes]
            empty = np.array([not char for char in closing], bool)[codes[firsts]]
            before = np.concatenate([[0], np.cumsum(open_ended)])
            plain = (before[lasts] > before[firsts + 1]) | (open_ended[firsts] & ~empty)
        inner = np.repeat(~plain, sizes)
        inner[firsts] = False
        asked = np.zeros(len(words), bool)
        asked[codes[inner]] = True
        asked = np.flatnonzero(asked)
        values = self.cache.of_parts([words[i] for i in asked])
        ids = np.frombuffer(b"".join(values), self.kind)
        counts, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        counts[asked] = np.fromiter(map(len, values), np.int64, len(values)) // self.kind.itemsize
        starts[asked] = np.cumsum(counts[asked]) - counts[asked]
        # Each word of the texts stands for a run of `ids`; there are fewer than bytes in the slice.
        found = codes[inner]
        lengths = counts[found]
        filled = np.concatenate([[0], np.cumsum(lengths)])
        places = np.arange(filled[-1], dtype=np.int32)
        places += np.repeat((starts[found] - filled[:-1]).astype(np.int32), lengths)
        ids = ids[places]
        of_text = np.concatenate([[0], np.cumsum(np.where(plain, 0, sizes - 1))])
        bounds = filled[of_text].tolist()
        for i, alone in enumerate(plain.tolist()):
            if alone:
                yield self.encode(texts[i].as_py())
                continue
            first = words[codes[firsts[i]]]
            opening = self.cache.opening(first) if first else b""
            yield opening + ids[bounds[i] : bounds[i + 1]].tobytes() + self.end


def _encoder(content: bytes, end_id: int) -> Encoder:
    """A worker keeps its last encoder, with the cache, from task to task."""
    key = (hashlib.sha256(content).digest(), end_id)
    kept = worker_cache()
    if kept.get("encoder", (None, None))[0] != key:
        kept["encoder"] = (key, Encoder(content, end_id))
    return kept["encoder"][1]


def train_dictionary(docs: DataFrame, content: bytes, end_id: int) -> bytes:
    """A zstandard dictionary from the ids of a bounded sample, the documents of least id hash.

    Empty when there is too little to train on. It only affects how small files get.
    """
    sample = (
        docs.where(F.length("text") <= DICTIONARY_DOCUMENT_CHARS)
        .select("text", F.xxhash64("doc_id").alias("order"))
        .orderBy("order", "text")
        .limit(DICTIONARY_DOCUMENTS)
        .select("text")
    )
    encoder = Encoder(content, end_id)
    samples = [encoder.encode(text) for text in sample.toArrow().column(0).to_pylist()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


SEGMENT = (
    "part int, seq int, first_id {id}, last_id {id}, dictionary string, width int, tokens long, "
    "doc_ids array<{id}>, n_tokens array<long>, offsets array<long>, payload binary"
)


def write_token_files(
    docs: DataFrame,
    out: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Writes the ids of all rows to `out`/segments in ascending id order, and `out`/dictionary.

    `tokenizer` is a file of the tokenizers library, read on the driver. A null text is empty: only its
    end id is written. Repeated ids stand side by side, ordered by text; null ids come first.
    Other columns are left out. An empty table gives no segments.
    """
    content = read_bytes(tokenizer)
    texts = ids_and_texts(docs, id_col, text_col)
    dictionary = train_dictionary(texts, content, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark = docs.sparkSession
    spark.createDataFrame([(digest, dictionary)], "digest string, content binary").coalesce(1).write.parquet(
        f"{out}/dictionary"
    )
    shared = spark.sparkContext.broadcast((content, dictionary))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    schema = SEGMENT.format(id=id_type)
    names = [field.split(" ")[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, dictionary = shared.value
        encoder = _encoder(content, end_id)
        shape = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        compress = zstandard.ZstdCompressor(level=LEVEL, **shape).compress
        part, seq, width = TaskContext.get().partitionId(), 0, encoder.kind.itemsize
        ids, counts, offsets, blocks, size = [], [], [], [], 0

        def segment() -> pa.RecordBatch:
            # Null ids come first; the bounds are those of the others, null when there are none.
            first = next((i for i in ids if i is not None), None)
            values = [part, seq, first, ids[-1], digest, width, sum(counts), ids, counts, offsets]
            kinds = [pa.int32(), pa.int32(), kind, kind, pa.string(), pa.int32(), pa.int64()]
            kinds += [pa.list_(kind), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = [pa.array([v], k) for v, k in zip(values, kinds)]
            columns.append(pa.array([b"".join(blocks)], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, names=names)

        for rows in batches:
            kind = rows.column(0).type
            for key, encoded in zip(rows.column(0).to_pylist(), encoder.encode_all(rows.column(1))):
                block = compress(encoded)
                ids.append(key)
                counts.append(len(encoded) // width)
                offsets.append(size)
                blocks.append(block)
                size += len(block)
                if size >= SEGMENT_BYTES or len(ids) >= SEGMENT_DOCUMENTS:
                    yield segment()
                    seq += 1
                    ids, counts, offsets, blocks, size = [], [], [], [], 0
        if ids:
            yield segment()

    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, schema).write.parquet(f"{out}/segments")


def _decompressor(spark: SparkSession, path: str):
    """Broadcast of the dictionaries of a file set by digest; there is one for each time it was written."""
    rows = spark.read.parquet(f"{path}/dictionary").collect()
    return spark.sparkContext.broadcast({row.digest: bytes(row.content) for row in rows})


def _open(dictionaries: dict[str, bytes]):
    """Function (digest, block) -> ids; it fails when the dictionary is not the one written with."""
    opened = {}

    def ids(digest: str, block: bytes, width: int) -> np.ndarray:
        if digest not in opened:
            content = dictionaries[digest]
            if hashlib.sha256(content).hexdigest() != digest:
                raise ValueError("the dictionary does not match its hash")
            shape = {"dict_data": zstandard.ZstdCompressionDict(content)} if content else {}
            opened[digest] = zstandard.ZstdDecompressor(**shape).decompress
        return np.frombuffer(opened[digest](block), "<u2" if width == 2 else "<u4")

    return ids


def segment_starts(segments: DataFrame) -> DataFrame:
    """`segments` with `start`: how many ids all earlier segments hold.

    Sums are taken per part first. Only one row for each part goes through the ordered window, so
    it has as many rows as the writing job had tasks.
    """
    parts = segments.groupBy("part").agg(F.sum("tokens").alias("of_part"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("of_part").over(earlier), F.lit(0)).alias("before"))
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    within = segments.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return within.join(starts, "part").withColumn("start", F.col("before") + F.col("inside"))


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a file set, from its files.

    `ids_crc32` is over the ids as little-endian unsigned 32-bit integers, the end id included. Null and repeated
    ids, null and empty texts have their rows as they were written; files of an empty table give none.
    """
    segments = spark.read.parquet(f"{path}/segments")
    index = segment_starts(segments.select("part", "seq", "tokens")).select("part", "seq", "start")
    index = reliable_checkpoint(index)
    # Three numbers for each segment of megabytes; payloads stay where they are read while they fit.
    small = index.count() <= BROADCAST_SEGMENTS
    rows = segments.join(F.broadcast(index) if small else index, ["part", "seq"]).select(
        "start", "dictionary", "width", "doc_ids", "n_tokens", "offsets", "payload"
    )
    dictionaries = _decompressor(spark, path)
    kind = segments.schema["first_id"].dataType.simpleString()
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _open(dictionaries.value)
        for rows in batches:
            for i in range(rows.num_rows):
                start, digest, width, _, counts, offsets, payload = (
                    None if j == 3 else rows.column(j)[i].as_py() for j in range(7)
                )
                starts, checks = [], []
                for n, at, end in zip(counts, offsets, [*offsets[1:], len(payload)]):
                    ids = read(digest, payload[at:end], width)
                    if len(ids) != n:
                        raise ValueError("a document's ids do not match the index")
                    starts.append(start)
                    checks.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    start += n
                columns = [rows.column(3)[i].values, *(pa.array(x, pa.int64()) for x in (starts, counts, checks))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, doc_ids: Sequence) -> DataFrame:
    """(doc_id, ids) of the given documents; only their segments and blocks are read and opened.

    Ids that are not in the files give no row, repeated ones a row for each document; null cannot be asked for.
    """
    wanted = sorted({i for i in doc_ids if i is not None})
    segments = spark.read.parquet(f"{path}/segments")
    kind = segments.schema["first_id"].dataType.simpleString()
    if not wanted:
        return spark.createDataFrame([], f"doc_id {kind}, ids array<long>")
    near = segments.where((F.col("first_id") <= wanted[-1]) & (F.col("last_id") >= wanted[0]))
    ids = F.array(*[F.lit(x).cast(kind) for x in wanted])
    near = near.where(F.arrays_overlap("doc_ids", ids))
    dictionaries = _decompressor(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, chosen = _open(dictionaries.value), set(wanted)
        for rows in batches:
            for row in rows.to_pylist():
                ends = [*row["offsets"][1:], len(row["payload"])]
                for key, at, end in zip(row["doc_ids"], row["offsets"], ends):
                    if key in chosen:
                        ids = read(row["dictionary"], row["payload"][at:end], row["width"])
                        columns = [pa.array([key], rows.column(3).values.type), pa.array([ids.astype(np.int64)])]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids"])

    rows = near.select("dictionary", "width", "offsets", "doc_ids", "payload")
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<long>")
