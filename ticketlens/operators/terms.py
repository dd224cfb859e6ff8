"""Terms of eligible texts: tokens, n-grams, TF-IDF weights, theme keywords."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.ml.feature import NGram
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ticketlens.functions.text import is_noise
from ticketlens.session import release, stored, with_numbers

# --- Fixed values: words that never become terms -----------------------------
STOPWORDS = [
    "de", "la", "el", "los", "las", "un", "una", "unos", "unas", "y", "o", "u",
    "a", "ante", "con", "contra", "desde", "en", "entre", "hacia", "hasta", "para",
    "por", "sin", "sobre", "tras", "que", "se", "su", "sus", "al", "del", "lo",
    "le", "les", "como", "ya", "si", "no", "mas", "muy", "favor", "gracias",
    "buen", "buenos", "buenas", "dia", "dias", "tarde", "tardes", "noche", "noches",
    "estimado", "estimados", "adjunto", "adjunta", "quedo", "pendiente", "cordial",
    "saludo", "saludos", "hola", "ticket", "jira",
]

# --- Fixed values: vocabulary rules ------------------------------------------
TOKEN = r"(?<![\p{L}\p{N}_])[a-zA-Z][a-zA-Z0-9_]{2,}(?![\p{L}\p{N}_])"
MAX_NGRAM = 3
SMALL_CORPUS = 80  # below this many texts a term may occur in only one
MAX_DF = 0.95

#: A dictionary of so many terms, at most, is held whole by every task.
HELD_TERMS = 1 << 16
#: Characters of text that make one batch, of about a million terms; the number of batches and of the tasks that
#: terms are dealt to follows from it.
BATCH_CHARS = 4_000_000
#: Terms of the dictionary for each task that sorts it or adds up their weights.
TERMS_PER_TASK = 200_000
#: Tokens whose terms are counted together on the way to the vocabulary.
TOKENS_AT_ONCE = 1_000_000
#: So many (id, theme_id), at most, are held by every executor.
HELD_GROUPS = 1 << 22
#: Bits of the hash of a term, and of a filter of such hashes, at most (32 MB).
HASH_BITS, FILTER_BITS = 36, 28
#: Batches whose hashes one task compares.
BATCHES_PER_PART = 4
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def coverage(
    df: DataFrame, text_col: str = "Description_clean", min_chars: int = 20
) -> DataFrame:
    """One row: all texts, those long enough for themes, and those left out."""
    enough = F.length(F.coalesce(text_col, F.lit(""))) >= min_chars
    return df.agg(
        F.count(F.lit(1)).alias("total_descriptions"),
        F.count_if(enough).alias("eligible_descriptions"),
        F.count_if(~enough).alias("excluded_short_descriptions"),
    )


def eligible_texts(
    df: DataFrame, text_col: str = "Description_clean", min_chars: int = 20
) -> DataFrame:
    """Rows whose text, null taken as empty, has at least `min_chars` characters."""
    # A filter would go below the column and compute it a second time; a generator stays above.
    long = F.filter(F.array(F.coalesce(text_col, F.lit(""))), lambda text: F.length(text) >= min_chars)
    return df.withColumn(text_col, F.explode_outer(long)).where(F.col(text_col).isNotNull())


def tokens(text: Column) -> Column:
    """Lower-case words of three or more ASCII characters, without stopwords."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def with_ngrams(
    df: DataFrame, tokens_col: str = "tokens", output_col: str = "terms"
) -> DataFrame:
    """Adds all runs of one to three tokens, stopwords already removed."""
    parts = [tokens_col]
    for n in range(2, MAX_NGRAM + 1):
        parts.append(f"__{n}grams")
        df = NGram(n=n, inputCol=tokens_col, outputCol=parts[-1]).transform(df)
    return df.withColumn(output_col, F.concat(*parts)).drop(*parts[1:])


def _exploded(terms: DataFrame, *keys: str) -> DataFrame:
    """One row per element of `terms`.

    The outer explode keeps Spark from testing for empty arrays first, which would take
    every text apart twice.
    """
    rows = terms.select(*keys, F.explode_outer("terms").alias("term"))
    return rows.where(F.col("term").isNotNull())


def term_counts(
    docs: DataFrame, id_col: str = "ticket_id", text_col: str = "Description_clean"
) -> DataFrame:
    """(id, term, tf) for every distinct term of every text.

    The texts are partitioned by id before they are taken apart; counting per (id, term)
    then needs no shuffle of the much larger n-grams.
    """
    texts = docs.select(id_col, text_col).repartition(id_col)
    split = texts.select(id_col, tokens(F.col(text_col)).alias("tokens"))
    rows = _exploded(with_ngrams(split), id_col)
    return rows.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


class _Terms:
    """The different terms of some texts by their number, spelled out only when asked for.

    A term of several words is one of a word less (its head) and its last word.
    """

    def __init__(self, words: pa.Array):
        self.words = words
        self.heads: list[np.ndarray] = []
        self.tails: list[np.ndarray] = []
        self.firsts = [0, len(words)]

    def add(self, heads: np.ndarray, tails: np.ndarray) -> None:
        """Terms of one word more than the last ones; heads are places among those."""
        self.heads.append(heads)
        self.tails.append(tails)
        self.firsts.append(self.firsts[-1] + len(heads))

    def __len__(self) -> int:
        return self.firsts[-1]

    def hashes(self) -> np.ndarray:
        """A number below 2^HASH_BITS for each term, from its words alone."""
        own = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words.to_pylist()], np.uint64)
        found = [_mixed(own)]
        for heads, tails in zip(self.heads, self.tails):
            found.append(_mixed(found[-1][heads] ^ own[tails]))
        return np.concatenate(found) >> np.uint64(64 - HASH_BITS)

    def spelled(self, numbers: np.ndarray) -> pa.Array:
        """The terms of rising numbers."""
        cuts = np.searchsorted(numbers, self.firsts)
        found = []
        for level in range(len(self.firsts) - 1):
            at = numbers[cuts[level] : cuts[level + 1]] - self.firsts[level]
            parts = []
            for heads, tails in zip(self.heads[:level][::-1], self.tails[:level][::-1]):
                parts.append(tails[at])
                at = heads[at]
            words = [self.words.take(pa.array(x)) for x in (at, *reversed(parts))]
            found.append(pc.binary_join_element_wise(*words, " ") if level else words[0])
        return pa.concat_arrays(found)


def _mixed(numbers: np.ndarray) -> np.ndarray:
    numbers = numbers * _SPREAD
    return (numbers ^ (numbers >> np.uint64(29))) * _SPREAD


def _numbered(lists: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Runs of tokens as (number of each token, words by number, tokens of each run)."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    found = pc.dictionary_encode(lists.flatten())
    return found.indices.to_numpy().astype(np.int64), found.dictionary, lengths


def _terms_of(
    number: np.ndarray, words: pa.Array, lengths: np.ndarray, texts: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, _Terms]:
    """(text, term, tf) of each different term of each text in order, and the terms by their number.

    The first three are those of `_numbered`; `texts` is the number of the text that each run of tokens belongs to.
    """
    row = np.repeat(np.arange(len(lengths)), lengths)
    terms = _Terms(words)
    runs, numbers = np.arange(len(row)), number
    starts, all_numbers = [runs], [numbers]
    for n in range(2, MAX_NGRAM + 1):
        inside = runs + n - 1 < len(row)
        inside[inside] = row[runs[inside]] == row[runs[inside] + n - 1]
        runs, numbers = runs[inside], numbers[inside]
        different, back = np.unique(numbers * len(words) + number[runs + n - 1], return_inverse=True)
        terms.add(*np.divmod(different, max(1, len(words))))
        numbers = back.reshape(-1)
        starts.append(runs)
        all_numbers.append(numbers + terms.firsts[n - 1])
    text = np.asarray(texts)[row[np.concatenate(starts)]].astype(np.int64)
    pairs, tf = np.unique(text * max(1, len(terms)) + np.concatenate(all_numbers), return_counts=True)
    text, term = np.divmod(pairs, max(1, len(terms)))
    return text, term, tf, terms


class _Filter:
    """Bits of the hashes of some terms: says of any of them that it may be one, and of few others."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(HASH_BITS - int(len(self.bits) * 8).bit_length() + 1)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


#: Hashes of a part, rising: the lower 16 bits of each, how often the upper ones rise, and whether it is marked.
_MARKS = "part int, low binary, high binary, marked binary"


def _marks(hashes: np.ndarray, marked: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows of _MARKS: a little over two bytes for each hash."""
    order = np.argsort(hashes, kind="stable")
    hashes, marked = hashes[order], marked[order]
    cuts = np.searchsorted(hashes, np.array(_cuts(parts), np.uint64))
    rows = []
    for part in range(parts):
        mine = hashes[cuts[part] : cuts[part + 1]]
        if len(mine):
            first = np.uint64(_cuts(parts)[part] >> 16)
            rises = ((mine >> np.uint64(16)) - first).astype(np.int64) + np.arange(len(mine))
            bits = np.zeros(rises[-1] + 1, bool)
            bits[rises] = True
            low = (mine & np.uint64(0xFFFF)).astype("<u2").tobytes()
            packed = [np.packbits(x).tobytes() for x in (bits, marked[cuts[part] : cuts[part + 1]])]
            rows.append((part, low, *packed))
    columns = [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))]
    return pa.RecordBatch.from_arrays(columns, names=["part", "low", "high", "marked"])


def _cuts(parts: int) -> list[int]:
    """Where the hashes of each part begin, and the end of the last."""
    return [part * (1 << HASH_BITS) // parts for part in range(parts + 1)]


def _filter(marks: DataFrame, parts: int, n: int) -> Broadcast:
    """The `_Filter` of all hashes that are marked or stand in several rows of a part, for `n` batches of text.

    Each part gives its slice of the bits; all of them together are at most 2^FILTER_BITS bits.
    """
    shift = HASH_BITS - min(FILTER_BITS, FILTER_BITS - 4 + n.bit_length())

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        first = np.uint64(_cuts(parts)[part] >> 16)
        found, again = [], []
        for low, high, marked in zip(*(table.column(i).combine_chunks() for i in (1, 2, 3))):
            low = np.frombuffer(low.as_buffer(), "<u2").astype(np.uint64)
            rises = np.flatnonzero(np.unpackbits(np.frombuffer(high.as_buffer(), np.uint8)))
            upper = (rises - np.arange(len(low))).astype(np.uint64) + first
            found.append(upper << np.uint64(16) | low)
            marked = np.unpackbits(np.frombuffer(marked.as_buffer(), np.uint8), count=len(low)).astype(bool)
            again.append(found[-1][marked])
        hashes = np.sort(np.concatenate(found))
        again.append(hashes[1:][hashes[1:] == hashes[:-1]])
        start = _cuts(parts)[part] >> shift >> 3
        bits = np.zeros(((_cuts(parts)[part + 1] - 1 >> shift) - start * 8) // 8 * 8 + 8, bool)
        bits[(np.concatenate(again) >> np.uint64(shift)) - np.uint64(start * 8)] = True
        return pa.table({"start": [start], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    slices = marks.repartition(parts, "part").groupBy("part").applyInArrow(run, "start long, bits binary").toArrow()
    bits = np.zeros((1 << HASH_BITS - shift) // 8, np.uint8)
    for start, packed in zip(slices.column("start").to_pylist(), slices.column("bits")):
        found = np.frombuffer(packed.as_buffer(), np.uint8)
        bits[start : start + len(found)] |= found
    release(marks.sparkSession)
    return marks.sparkSession.sparkContext.broadcast(bits)


def _batches(docs: DataFrame, text_col: str) -> int:
    """How many batches the texts make."""
    chars = docs.agg(F.sum(F.length(text_col).cast("long"))).first()[0] or 0
    return 1 + chars // BATCH_CHARS


def _tasks(df: DataFrame, wanted: int) -> int:
    """As many tasks as usual, and more where the table asks for them, so that none grows with it."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted)


def vocabulary(
    docs: DataFrame, n_docs: int | Column, text_col: str = "Description_clean"
) -> DataFrame:
    """(term, idf) of the terms that are neither too rare nor too common.

    Tasks count the texts of each term for a bounded number of tokens at a time, so what they hold does not grow with
    the table and a hot term is one row for each. Where a term must occur in two texts, hashes of all terms tell first
    which ones may; only those are counted by name. Counts are added up in as many tasks as the text asks for.
    """
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    batches = _batches(docs, text_col)
    lists = docs.select(tokens(F.col(text_col)).alias("tokens"))
    held = None
    if batches > 1 and not isinstance(n_docs, Column) and n_docs >= SMALL_CORPUS:
        held = _repeated(lists, batches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for terms, texts in _text_counts(batches):
            kept = np.arange(len(terms)) if held is None else np.flatnonzero(_Filter(held.value).has(terms.hashes()))
            spelled, texts = terms.spelled(kept), pa.array(texts[kept], pa.int64())
            order = pc.sort_indices(spelled)  # neighbours begin alike, so a shuffle of them is smaller
            yield pa.RecordBatch.from_arrays([spelled.take(order), texts.take(order)], names=["term", "n"])

    rows = lists.mapInArrow(run, "term string, n long")
    df = F.col("df")
    frequent = df >= F.when(n >= SMALL_CORPUS, 2).otherwise(1)
    # With a single text the upper bound would remove every term.
    rare = (df <= MAX_DF * n) | (n <= 1)
    return (
        rows.repartition(_tasks(docs, batches), "term")
        .groupBy("term")
        .agg(F.sum("n").alias("df"))
        .where(frequent & rare)
        .select("term", (F.log((1 + n) / (1 + df)) + 1).alias("idf"))
    )


def _text_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Terms, np.ndarray]]:
    """The terms of a bounded number of tokens, and how many texts have each."""
    for batch in batches:
        for lists in _pieces(batch.column(0)):
            _, term, _, terms = _terms_of(*_numbered(lists), np.arange(len(lists)))
            yield terms, np.bincount(term, minlength=len(terms))


def _repeated(lists: DataFrame, n: int) -> Broadcast:
    """A `_Filter` of the terms that occur in several texts."""
    parts = _tasks(lists, 1 + n // BATCHES_PER_PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for terms, texts in _text_counts(batches):
            yield _marks(terms.hashes(), texts > 1, parts)

    return _filter(lists.mapInArrow(run, _MARKS), parts, n)


def _pieces(lists: pa.Array) -> Iterator[pa.Array]:
    """`lists` in slices of about TOKENS_AT_ONCE tokens; a longer list is alone."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    at = 0
    while at < len(lists):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + TOKENS_AT_ONCE, side="right")))
        yield lists.slice(at, to - at)
        at = to


def term_dictionary(
    docs: DataFrame, n_docs: int | Column, text_col: str = "Description_clean"
) -> DataFrame:
    """(term_no, term, idf): the vocabulary, numbered from 0 by falling frequency, then by term.

    Written once. Range partitions are ordered each for itself and numbered by sums of their sizes. The vocabulary is
    written before, as finding the ranges would count it a second time.
    """
    found = stored(vocabulary(docs, n_docs, text_col), "vocabulary")
    tasks = _tasks(docs, 1 + found.count() // TERMS_PER_TASK)
    in_order = found.repartitionByRange(tasks, "idf", "term").sortWithinPartitions("idf", "term")
    return with_numbers(in_order, "term_no").select("term_no", "term", "idf")


def weighted_texts(
    docs: DataFrame,
    dictionary: DataFrame,
    id_col: str = "ticket_id",
    text_col: str = "Description_clean",
    label: str = "term_no",
) -> DataFrame:
    """(id, cells): the terms of each text as (`label`, weight), in order of the label.

    Weights are log term frequency times idf, of unit length per text; texts without a term
    are left out. `label` is a column of the dictionary. A dictionary that tasks hold whole leaves only the
    shuffle of the texts; a larger one is met by batches of texts.
    """
    if dictionary.count() > HELD_TERMS:
        return _weighted_batches(docs, dictionary, id_col, text_col, label)
    held = dictionary.select("term", F.col(label).alias("label"), "idf")
    met = term_counts(docs, id_col, text_col).join(F.broadcast(held), "term")
    cell = F.struct(F.col("label").alias(label), ((1 + F.log("tf")) * F.col("idf")).alias("raw"))
    packed = met.groupBy(id_col).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    length = F.sqrt(F.aggregate("cells", F.lit(0.0), lambda total, c: total + c["raw"] * c["raw"]))

    def divided(by: Column) -> Column:
        return F.transform("cells", lambda c: F.struct(c[label].alias(label), (c["raw"] / by).alias("weight")))

    # The length is an element of an array, so that it is not computed again for each cell.
    return packed.select(id_col, F.get(F.transform(F.array(length), divided), 0).alias("cells"))


def _weighted_batches(docs: DataFrame, dictionary: DataFrame, id_col: str, text_col: str, label: str) -> DataFrame:
    """`weighted_texts` for a dictionary of any size.

    Texts are dealt by id to batches of bounded size, which are written once as numbered words; terms are made of these
    whenever they are needed. Each batch asks for those of its different terms that the filter of the dictionary lets through, so
    a hot term is asked for once by a batch. Terms are asked for by hash range and in order of their hashes, all of a range in
    one row; answers are numbers in the same order.
    """
    n = _batches(docs, text_col)
    id_type, label_type = docs.schema[id_col].dataType, dictionary.schema[label].dataType
    named = label == "term"
    batch = F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("batch")
    tasks, parts = _tasks(docs, n), _tasks(docs, 1 + n // BATCHES_PER_PART)
    # Texts are dealt before they are taken apart: they are smaller than their tokens.
    texts = docs.select(batch, F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition(tasks, "batch")
    texts = texts.select("batch", "id", tokens(F.col("text")).alias("tokens"))

    def pack(rows: pa.Table) -> pa.Table:
        ids = pc.dictionary_encode(rows.column("id").combine_chunks(), null_encoding="encode")
        number, words, lengths = _numbered(rows.column("tokens").combine_chunks())
        numbers = [pa.array([_squeezed(x, "<i4")], pa.binary()) for x in (number, lengths, ids.indices.to_numpy())]
        columns = [rows.column("batch")[:1].combine_chunks(), _one_list(ids.dictionary), _one_list(words), *numbers]
        columns += [pa.array([len(x)], pa.int32()) for x in (number, lengths)]
        return pa.Table.from_arrays(columns, names=["batch", "ids", "words", "tokens", "lengths", "texts", "n", "rows"])

    def unpacked(row: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, _Terms]:
        sizes = {name: row.column(size)[0].as_py() for name, size in (("tokens", "n"), ("lengths", "rows"), ("texts", "rows"))}
        number, lengths, texts = (_spread_out(row.column(x)[0], "<i4", size) for x, size in sizes.items())
        return _terms_of(number.astype(np.int64), row.column("words").combine_chunks().flatten(), lengths, texts)

    def asked_for(terms: _Terms) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the terms to ask for in order of their hashes, and where each part begins."""
        hashes = terms.hashes()
        code = np.flatnonzero(_Filter(held.value).has(hashes))
        code = code[np.argsort(hashes[code], kind="stable")]
        return code, np.searchsorted(hashes[code], np.array(_cuts(parts), np.uint64))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                row = pa.Table.from_batches([rows.slice(i, 1)])
                terms = unpacked(row)[3]
                code, cuts = asked_for(terms)
                order = np.argsort(code)
                place = np.empty(len(code), np.int64)
                place[order] = np.arange(len(code))
                spelled = terms.spelled(code[order]).take(pa.array(place))
                mine = [part for part in range(parts) if cuts[part] < cuts[part + 1]]
                lines = [pc.binary_join(_one_list(spelled[cuts[x] : cuts[x + 1]]), "\n")[0].as_buffer() for x in mine]
                columns = [pa.array(mine, pa.int32()), pa.array([row.column("batch")[0].as_py()] * len(mine), pa.int32())]
                columns += [pa.array([len(x) for x in lines], pa.int32())]
                columns += [pa.array([pa.compress(x, "zstd", asbytes=True) for x in lines], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "batch", "size", "terms"])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        names = ["batch", "part", "n", "idf", "label"]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        lists = []
        for size, terms in zip(asked.column("size").to_pylist(), asked.column("terms")):
            lines = pa.array([pa.decompress(terms.as_buffer(), size, "zstd", asbytes=True)], pa.string())
            lists.append(pc.split_pattern(lines, "\n").flatten())
        if not lists:
            return pa.Table.from_arrays([pa.array([], kind) for kind in types], names=names)
        at = pc.index_in(pa.concat_arrays(lists), known.column("term").combine_chunks())
        at = pc.fill_null(at, known.num_rows).to_numpy()
        idf = np.append(known.column("idf").to_numpy(), np.nan)[at]
        number = np.append(known.column("label").to_numpy(), -1)[at]
        sizes = [len(x) for x in lists]
        cuts = np.cumsum([0, *sizes])
        columns = [asked.column("batch"), asked.column("part"), pa.array(sizes, pa.int32())]
        for values, kind in ((idf, "<f8"), (number, "<i8")):
            columns.append(pa.array([_squeezed(values[x:y], kind) for x, y in zip(cuts, cuts[1:])], pa.binary()))
        return pa.Table.from_arrays(columns, names=names)

    schema = (
        f"batch int, ids array<{id_type.simpleString()}>, words array<string>, tokens binary, lengths binary,"
        " texts binary, n int, rows int"
    )
    packed = stored(texts.groupBy("batch").applyInArrow(pack, schema), "batches")
    held = _known(dictionary, n)
    asked = packed.mapInArrow(ask, "part int, batch int, size int, terms binary").repartition(parts, "part")
    number = F.lit(0).cast("long") if named else F.col(label).cast("long")
    known = _in_parts(dictionary.select("term", "idf", number.alias("label")), parts).repartition(parts, "part")
    answers = asked.groupBy("part").cogroup(known.groupBy("part"))
    answers = answers.applyInArrow(answer, "batch int, part int, n int, idf binary, label binary")
    answers = stored(answers, "answers")

    def weigh(given: pa.Table, met: pa.Table) -> pa.Table:
        kind = pa.string() if named else pa.int64()
        if given.num_rows == 0 or met.num_rows == 0:
            ids = given.column("ids").combine_chunks().flatten()[:0]
            cells = pa.array([], pa.list_(pa.struct([(label, kind), ("weight", pa.float64())])))
            return pa.Table.from_arrays([ids, cells], names=["id", "cells"])
        text, code, tf, terms = unpacked(given)
        ids = given.column("ids").combine_chunks().flatten()
        met = met.sort_by("part")
        idfs, numbers = (
            np.concatenate([_spread_out(x, form, n) for x, n in zip(met.column(name), met.column("n").to_pylist())])
            for name, form in (("idf", "<f8"), ("label", "<i8"))
        )
        found = ~np.isnan(idfs)
        at = asked_for(terms)[0][found]
        idf, place = np.zeros(len(terms)), np.full(len(terms), -1, np.int64)
        idf[at] = idfs[found]
        if named:
            at = np.sort(at)
            labels = terms.spelled(at)
            order = pc.sort_indices(labels)
            labels = labels.take(order)
            place[at[order.to_numpy()]] = np.arange(len(at))
        else:
            place[at] = numbers[found]
        kept = place[code] >= 0
        text, code, tf = text[kept], code[kept], tf[kept]
        order = np.lexsort((place[code], text))
        text, code, tf = text[order], code[order], tf[order]
        raw = (1 + np.log(tf)) * idf[code]
        length = np.sqrt(np.bincount(text, raw * raw, len(ids)))
        number = labels.take(pa.array(place[code])) if named else pa.array(place[code])
        counts = np.bincount(text, minlength=len(ids))
        used = np.flatnonzero(counts)
        ends = np.concatenate([[0], np.cumsum(counts[used])]).astype(np.int32)
        cell = pa.StructArray.from_arrays([number, pa.array(raw / length[text])], names=[label, "weight"])
        columns = [ids.take(pa.array(used)), pa.ListArray.from_arrays(pa.array(ends), cell)]
        return pa.Table.from_arrays(columns, names=["id", "cells"])

    cell = f"struct<{label}:{label_type.simpleString()},weight:double>"
    # Dealt to so many tasks that each has about one batch.
    weighed = packed.repartition(tasks, "batch").groupBy("batch").cogroup(answers.repartition(tasks, "batch").groupBy("batch"))
    found = weighed.applyInArrow(weigh, f"id {id_type.simpleString()}, cells array<{cell}>")
    return found.withColumnRenamed("id", id_col)


def _squeezed(numbers: np.ndarray, kind: str) -> bytes:
    return pa.compress(numbers.astype(kind).tobytes(), "zstd", asbytes=True)


def _spread_out(value: pa.Scalar, kind: str, n: int) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(value.as_buffer(), size, "zstd") if n else b"", kind)


def _one_list(values: pa.Array) -> pa.Array:
    """One row that holds all `values`."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _hashes_of(terms: pa.Array) -> np.ndarray:
    """What `_Terms.hashes` says of spelled terms."""
    number, words, lengths = _numbered(pc.split_pattern(terms, " "))
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()], np.uint64)
    first = np.cumsum(lengths) - lengths
    found = _mixed(own[number[first]])
    for n in range(1, MAX_NGRAM):
        more = np.flatnonzero(lengths > n)
        found[more] = _mixed(found[more] ^ own[number[first[more] + n]])
    return found >> np.uint64(64 - HASH_BITS)


def _known(dictionary: DataFrame, n: int) -> Broadcast:
    """A `_Filter` of the terms of the dictionary, for `n` batches of text."""
    parts = _tasks(dictionary, 1 + n // BATCHES_PER_PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One row for each part and task, as hashes take little room.
        hashes = [_hashes_of(batch.column(0)) for batch in batches if batch.num_rows]
        if hashes:
            hashes = np.concatenate(hashes)
            yield _marks(hashes, np.ones(len(hashes), bool), parts)

    return _filter(dictionary.select("term").mapInArrow(run, _MARKS), parts, n)


def _in_parts(dictionary: DataFrame, parts: int) -> DataFrame:
    """(part, term, idf, label): the hash range of each term beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.searchsorted(np.array(_cuts(parts), np.uint64), _hashes_of(batch.column(0)), side="right") - 1
            columns = [pa.array(part, pa.int32()), *batch.columns]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "term", "idf", "label"])

    return dictionary.mapInArrow(run, "part int, term string, idf double, label long")


def cells(texts: DataFrame, id_col: str = "ticket_id") -> DataFrame:
    """(id, label, weight), one row for each cell of `weighted_texts`."""
    return texts.select(id_col, F.explode("cells").alias("cell")).select(id_col, "cell.*")


def tfidf(
    docs: DataFrame,
    id_col: str = "ticket_id",
    text_col: str = "Description_clean",
    n_docs: int | None = None,
) -> DataFrame:
    """TF-IDF as a long table (id, term, weight)."""
    n = docs.count() if n_docs is None else n_docs
    dictionary = term_dictionary(docs, n, text_col)
    return cells(weighted_texts(docs, dictionary, id_col, text_col, "term"), id_col)


def theme_sizes(groups: DataFrame) -> DataFrame:
    """(theme_id, count)."""
    return groups.groupBy("theme_id").agg(F.count(F.lit(1)).alias("count"))


def theme_term_weights(
    weights: DataFrame,
    groups: DataFrame,
    id_col: str = "ticket_id",
    sizes: DataFrame | None = None,
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """Mean weight of each term over all texts of its theme, texts without it included.

    Means are rounded to twelve places: sums differ in their last digits with the order
    of addition, and equal means must stay equal to be ranked by term. `sizes`
    (theme_id, count) saves counting the groups again. With a `dictionary`, `weights` are
    the rows of `weighted_texts`; numbers are added up, and only the sums are given their terms. Groups of up to HELD_GROUPS
    texts are sent to the weights, which are many times larger.
    """
    if sizes is None:
        sizes = theme_sizes(groups)
    placed_in = groups.select(id_col, "theme_id")
    if dictionary is None:
        placed = weights.join(placed_in, id_col)
        sums = placed.groupBy("theme_id", "term").agg(F.sum("weight").alias("total"))
    else:
        tasks = _tasks(weights, 1 + dictionary.count() // TERMS_PER_TASK)
        if groups.count() <= HELD_GROUPS:
            placed = weights.join(F.broadcast(placed_in), id_col)
        else:
            placed = weights.repartition(tasks, id_col).join(placed_in.repartition(tasks, id_col), id_col)
        numbers = _added_up(placed.select("theme_id", "cells")).repartition(tasks, "term_no")
        sums = numbers.groupBy("theme_id", "term_no").agg(F.sum("weight").alias("total"))
        sums = sums.join(dictionary.repartition(tasks, "term_no").hint("shuffle_hash"), "term_no")
    return sums.join(sizes, "theme_id").select(
        "theme_id",
        "term",
        F.round(F.col("total") / F.col("count"), 12).alias("mean_weight"),
    )


def _added_up(placed: DataFrame) -> DataFrame:
    """(theme_id, term_no, weight): sums over the texts of a batch, so that a hot term is one row for each batch."""
    kind = placed.schema["theme_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            themes = pc.dictionary_encode(batch.column(0), null_encoding="encode")
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
            cell = batch.column(1).flatten()
            number, weight = cell.field("term_no").to_numpy(), cell.field("weight").to_numpy()
            many = max(1, len(themes.dictionary))
            keys = number * many + np.repeat(themes.indices.to_numpy(), sizes)
            different, back = np.unique(keys, return_inverse=True)
            sums = np.bincount(back.reshape(-1), weight, len(different))
            columns = [themes.dictionary.take(pa.array(different % many)), pa.array(different // many), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["theme_id", "term_no", "weight"])

    return placed.mapInArrow(run, f"theme_id {kind}, term_no long, weight double")


def theme_keywords(term_weights: DataFrame, top_keywords: int = 12) -> DataFrame:
    """(theme_id, keywords): heaviest terms of each theme in order of weight, noise removed.

    Noise goes after the cut, so a theme may have fewer keywords than asked for.
    The rank filter lets Spark keep only the first terms of each task before the shuffle.
    """
    heaviest = W.partitionBy("theme_id").orderBy(F.desc("mean_weight"), "term")
    top = term_weights.withColumn("rank", F.row_number().over(heaviest)).where(
        F.col("rank") <= top_keywords
    )
    clean = (F.col("mean_weight") > 0) & ~is_noise(F.col("term"))
    ranked = F.collect_list(F.when(clean, F.struct("rank", "term")))
    return top.groupBy("theme_id").agg(
        F.transform(F.sort_array(ranked), lambda x: x["term"]).alias("keywords")
    )
