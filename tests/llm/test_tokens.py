"""Encoding, token files and token counts against the public libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ticketlens.llm import bpe, queries, token_counts, token_files
from ticketlens.llm.pretokens import BYTE_LEVEL, ChunkCache, parts_and_chunks, split_chunks
from ticketlens.session import scratch_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [" ", "  ", "\n", "\t", "a", "Bc", "é", "ñx", "12", "'s", "'ll", "!", ".", "\x1c", "\x85"]
PIECES += ["日本", "\U0001f600", "<|endoftext|>", "<|", "\r\n", " ", " ", " the", " word,"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def random_texts():
    made = random.Random(5)
    return ["".join(made.choice(PIECES) for _ in range(made.randint(0, 40))) for _ in range(1500)]


def test_pattern_is_the_published_one():
    assert BYTE_LEVEL == public_tokenizers.PATTERN


def test_chunks_join_to_the_text(random_texts):
    for text in random_texts:
        assert "".join(split_chunks(text)) == text
        parts, chunks = parts_and_chunks(text)
        assert sorted([" " + p for p in parts] + chunks) == sorted(split_chunks(text))


def test_cache_gives_values_in_order_whatever_its_size(random_texts):
    for entries in (1, 10, 10_000):
        cache = ChunkCache(list, entries)
        for text in random_texts[:300]:
            assert cache.values(text) == split_chunks(text)


@pytest.mark.parametrize("entries", [3, 100_000])
def test_codec_equals_library(reference, random_texts, entries):
    codec = bpe.Codec(bpe.read_ranks(open(RANKS, "rb").read()), public_tokenizers.PATTERN)
    codec.cache.entries = entries
    for text in [*random_texts, "ab" * 3000, "x" * 5000, "ñ" * 700]:
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_tree_equals_plain_merging(reference):
    """Merging the leftmost least pair over and over, without a tree."""
    ranks = bpe.read_ranks(open(RANKS, "rb").read())
    made = random.Random(2)
    for _ in range(400):
        piece = bytes(made.choice(b"abcdehinort \xc3\xa9") for _ in range(made.randint(1, 24)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while piece not in ranks:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                break
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        wanted = [ranks[piece]] if piece in ranks else [ranks[p] for p in parts]
        assert bpe.encode_piece(piece, ranks) == wanted


def test_op2_on_sample(spark, sample, sample_texts, reference):
    rows = queries.op2_bpe(spark, sample).collect()
    assert sorted(r.doc_id for r in rows) == sorted(sample_texts)
    for row in rows:
        text = sample_texts[row.doc_id]
        ids = reference.encode_ordinary(text)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_op2_odd_rows(odd_documents, no_documents, reference):
    pattern = public_tokenizers.PATTERN
    wanted = sorted(
        (str(r.doc_id), len(reference.encode_ordinary(r.text or ""))) for r in odd_documents.collect()
    )
    found = bpe.round_trip(odd_documents, RANKS, pattern).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in found) == wanted
    assert bpe.round_trip(no_documents, RANKS, pattern).collect() == []
    decoded = bpe.decode_ids(bpe.encode_texts(odd_documents, RANKS, pattern), RANKS, pattern).collect()
    texts = sorted((r.text or "").encode() for r in odd_documents.collect())
    assert sorted(bytes(r.bytes) for r in decoded) == texts


def test_op6_on_sample(spark, sample, sample_texts, tokenizer):
    rows = {r.doc_id: r for r in queries.op6_token_files(spark, sample).collect()}
    start = 0
    for doc_id in sorted(sample_texts):
        ids = tokenizer.encode(sample_texts[doc_id], add_special_tokens=False).ids + [2]
        row = rows.pop(doc_id)
        assert (row.start, row.n_tokens) == (start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert not rows


def test_op6_chunks_equal_whole_texts(tokenizer, random_texts):
    encoder = token_files.Encoder(open(JSON, "rb").read(), 2)
    assert encoder.by_chunk
    for text in random_texts:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert encoder.encode(text) == np.array(ids, "<u2").tobytes()


@pytest.mark.parametrize("entries", [40, 100_000])
def test_op6_takes_words_of_many_texts_apart_at_once(tokenizer, random_texts, monkeypatch, entries):
    """Each word is looked for once in a slice, and a mark behind a known word asks the library for nothing."""
    odd = ["", " ", "  ", "a", " a", "a ", "a  b", "a\t b", "\t a b", "é\u3000 é", "x<|endoftext|>, y", "it's, it's. 'tis'",
           "word,\u0301 end", "ß!? \u0250, \u01c5; 7, 7", "\x1c a\x1f b"]
    texts = odd + random_texts + ["Thonre, queci. Thonre. queci! queci,", "Thonre### queci### Thonre queci"]
    for size in (1, 60, 8 << 20):
        monkeypatch.setattr(token_files, "SLICE_BYTES", size)
        monkeypatch.setattr(token_files, "CHUNKS", entries)
        encoder = token_files.Encoder(open(JSON, "rb").read(), 2)
        for kind in (pa.string(), pa.large_string()):
            found = list(encoder.encode_all(pa.array(["", *texts], kind).slice(1)))
            ids = [np.frombuffer(x, encoder.kind).tolist() for x in found]
            assert ids == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    asked = []
    compute = encoder.cache.compute
    encoder.cache.known.clear()
    encoder.cache.older.clear()
    encoder.cache.compute = lambda chunks: asked.extend(chunks) or compute(chunks)
    list(encoder.encode_all(pa.array(["a wholly, a wholly. wholly a wholly, newly."])))
    assert sorted(c for c in asked if len(c) > 2) == [" newly", " wholly"]
    assert list(encoder.encode_all(pa.array([], pa.string()))) == []


def test_op6_odd_rows_and_single_documents(spark, odd_documents, no_documents, tokenizer):
    path = scratch_path(spark, "odd")
    token_files.write_token_files(odd_documents, path, JSON, end_id=2)
    rows = token_files.read_token_digests(spark, path).collect()
    texts = [(r.doc_id, r.text or "") for r in odd_documents.collect()]
    assert len(rows) == len(texts)
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids + [2] for i, t in texts if i is not None}
    total = sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts)
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted([i for i, _ in texts], key=lambda i: (i is not None, i))
    assert ordered[-1].start + ordered[-1].n_tokens == total
    alone = {r.doc_id: list(r.ids) for r in token_files.read_documents(spark, path, [8, 10, 99]).collect()}
    assert alone == {8: ids[8], 10: ids[10]}
    assert token_files.read_documents(spark, path, []).collect() == []
    empty = scratch_path(spark, "none")
    token_files.write_token_files(no_documents, empty, JSON, end_id=2)
    assert token_files.read_token_digests(spark, empty).collect() == []


def test_op6_several_segments(spark, odd_documents, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_DOCUMENTS", 2)
    path = scratch_path(spark, "segments")
    token_files.write_token_files(odd_documents, path, JSON, end_id=2)
    assert spark.read.parquet(f"{path}/segments").count() >= 6
    rows = sorted(token_files.read_token_digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]


def test_op6_wrong_dictionary_is_refused(spark, sample):
    path = scratch_path(spark, "dictionary")
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    token_files.write_token_files(docs, path, JSON, end_id=2)
    kept = spark.read.parquet(f"{path}/dictionary").collect()[0]
    assert hashlib.sha256(kept.content).hexdigest() == kept.digest
    opened = token_files._open({kept.digest: b"other"})
    with pytest.raises(ValueError, match="dictionary"):
        opened(kept.digest, b"", 2)


def test_op9_on_sample(spark, sample, sample_texts, tokenizer):
    rows = queries.op9_token_counts(spark, sample).collect()
    assert sorted(r.doc_id for r in rows) == sorted(sample_texts)
    for row in rows:
        text = sample_texts[row.doc_id]
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 1024)


@pytest.mark.parametrize("held", [0, 5, 1 << 18])
def test_op9_odd_rows_with_few_held_pieces(odd_documents, no_documents, tokenizer, monkeypatch, held):
    monkeypatch.setattr(token_counts, "HELD", held)
    rows = token_counts.token_counts(odd_documents, JSON, public_tokenizers.PATTERN).collect()
    count = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    wanted = sorted((str(r.doc_id), count(r.text or "")) for r in odd_documents.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == wanted
    assert token_counts.token_counts(no_documents, JSON, public_tokenizers.PATTERN).collect() == []


def test_frequent_rows_are_bounded(spark):
    from ticketlens.llm.common import frequent_from

    counts = spark.range(1, 1000).select(F.col("id").alias("count"))
    for most in (0, 1, 10, 500, 5000):
        kept = counts.where(F.col("count") >= frequent_from(counts, most)).count()
        assert kept <= most
        assert most < 10 or kept >= min(999, most) * 0.5
    assert frequent_from(counts.where("false"), 5) > 0
