"""Phrases whose words occur together more often than chance, from exact counts of frequent n-grams.

Counting every n-gram of a corpus would shuffle several times the corpus. Two searches find the few that can be
frequent, a third counts only those:

1. N-grams of one and two words, then those of three and more of which all pairs of neighbours passed, are summed up by
   hash partition. A task sends, for each hash partition, a summary of (32-bit key, count). The partition merges them as
   Misra-Gries summaries (Agarwal et al. 2013) with a capacity above its mass divided by the threshold, so
   all cuts together stay below the threshold and no frequent n-gram is lost. A task's own summaries are never
   cut, as their errors would add up over tasks.
2. What survives becomes a bit filter, a slice for each hash partition, of a bounded size in all. Keys that collide only
   make candidates more.
3. The corpus is read again, and n-grams that pass the filter are counted exactly, by their words.

Scores and nesting are joins of the counted phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ticketlens.session import reliable_checkpoint


@dataclass(frozen=True)
class Phrases:
    """Phrases of 2 to `longest` words with a count of at least `least`; the first `top` per language.

    A phrase goes when a longer candidate around it has at least `inside` percent of its count.
    """

    least: int = 100
    longest: int = 5
    top: int = 2000
    inside: int = 100


#: Bytes of text for each hash partition, about 1.4 million n-grams of one and two words.
PARTITION_BYTES = 1 << 22
#: Distinct keys that a task holds before it sends its summaries.
HELD_KEYS = 2_000_000
#: Phrases that a task holds before it sends their counts.
HELD_PHRASES = 200_000
#: Bytes of text that a task takes apart at a time (at least one text).
SLICE_BYTES = 4 << 20
#: Bits of the filter for a hash partition, and for all of them (32 MB).
SLICE_BITS, FILTER_BITS = 1 << 17, 1 << 28
#: Languages whose totals are broadcast; more are joined by a shuffle.
BROADCAST_LANGUAGES = 100_000
#: Parts in which the phrases of a language are ranked before the first of each part meet.
RANK_PARTS = 64

# --- Fixed values: what separates words and pieces -------------------------------
BLANKS = b" \t"
BREAKS = b".,;:!?\n\x0b\x0c\r"
NO_LANGUAGE = "und"
# ------------------------------------------------------------------------------

_SPREAD, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(31)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower, kind = np.arange(256, dtype=np.uint8), np.zeros(256, np.uint8)
    lower[65:91] += 32
    kind[list(BLANKS)], kind[list(BREAKS)] = 1, 2
    return lower, kind


@dataclass
class Words:
    """The words of some texts in order: number of the word, its piece and its text; the distinct words."""

    ids: np.ndarray
    piece: np.ndarray
    row: np.ndarray
    values: list[bytes]


def words_of(texts: pa.Array) -> Words:
    """A-Z in lower case; pieces end at BREAKS and with the text."""
    lower, kinds = _tables()
    kind = pa.large_string()
    ended = pc.binary_join_element_wise(texts.cast(kind), pa.scalar("", kind), pa.scalar("\n", kind))
    offsets = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
    data = np.frombuffer(ended.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = kinds[data]
    inside = kind == 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    packed = lower[data[inside]]
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(packed)]
    ).dictionary_encode()
    return Words(
        words.indices.to_numpy().astype(np.int64),
        np.searchsorted(np.flatnonzero(kind == 2), starts),
        np.searchsorted(offsets, starts, side="right") - 1,
        words.dictionary.to_pylist(),
    )


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        if rows.num_rows == 0:
            continue
        sizes = np.cumsum(pc.binary_length(rows.column(1)).to_numpy())
        at = 0
        while at < rows.num_rows:
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, side="right")))
            yield rows.slice(at, to - at)
            at = to


def _grams(words: Words, languages: list[str], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, hashes) of the n-grams inside pieces, hashed with their language, n = 1, 2, ..."""
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in words.values], np.uint64)
    seeds = np.array([xxhash.xxh3_64_intdigest(x.encode(), seed=1) for x in languages], np.uint64)
    own = own[words.ids]
    hashes = seeds[words.row]
    for n in range(1, longest + 1):
        count = max(0, len(own) - n + 1)
        hashes = (hashes[:count] ^ own[n - 1 :]) * _SPREAD
        hashes ^= hashes >> _SHIFT
        places = np.flatnonzero(words.piece[:count] == words.piece[n - 1 :])
        yield n, places, hashes[places]


def _codes(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Hash partition in the upper, key in the lower 32 bits."""
    half = np.uint64(32)
    return ((hashes >> half) * np.uint64(parts) >> half << half) | (hashes & np.uint64(0xFFFFFFFF))


@dataclass(frozen=True)
class Filter:
    """Bits of the keys that may be frequent."""

    bits: np.ndarray
    width: int

    def has(self, codes: np.ndarray) -> np.ndarray:
        at = (codes >> np.uint64(32)) * np.uint64(self.width) + (codes & np.uint64(self.width - 1))
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def _counted(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, int)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def _ones(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with how often they occur."""
    found = np.concatenate([np.zeros(0, np.uint64), *codes])
    found.sort()
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, int)
    return found[first], np.diff(np.append(first, len(found)))


def _summaries(texts: DataFrame, parts: int, longest: int, pairs=None) -> DataFrame:
    """(part, mass, keys, counts): summaries of n-grams of up to `longest` words.

    With a filter of `pairs`, of those of three and more words all pairs of which pass.
    """

    def sent(codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = (codes >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = np.append(first, len(codes)).astype(np.int32) * 4
        blobs = [
            pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())])
            for values in ((codes & np.uint64(0xFFFFFFFF)).astype("<u4"), counts.astype("<u4"))
        ]
        mass = pa.array(np.add.reduceat(counts, first))
        yield pa.RecordBatch.from_arrays([pa.array(part[first]), mass, *blobs], names=["part", "mass", "keys", "counts"])

    def merged(held: tuple[np.ndarray, np.ndarray], fresh: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        codes, counts = _ones(fresh)
        return _counted(np.concatenate([held[0], codes]), np.concatenate([held[1], counts]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        fresh, waiting = [], 0
        for rows in _slices(batches):
            words = words_of(rows.column(1))
            for n, places, hashes in _grams(words, rows.column(0).to_pylist(), longest):
                codes = _codes(hashes, parts)
                if pairs is not None:
                    if n == 2:
                        passed = np.zeros(len(words.ids), bool)
                        passed[places[pairs.value.has(codes)]] = True
                        alive = passed
                    if n <= 2:
                        continue
                    # The last pair of the n-gram at a place stands n - 2 words further on.
                    alive = alive[: len(passed) - n + 2] & passed[n - 2 :]
                    codes = codes[alive[places]]
                fresh.append(codes)
                waiting += len(codes)
            if waiting >= HELD_KEYS:
                held = merged(held, fresh)
                fresh, waiting = [], 0
                if len(held[0]) >= HELD_KEYS:
                    yield from sent(*held)
                    held = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        held = merged(held, fresh)
        if len(held[0]):
            yield from sent(*held)

    return texts.mapInArrow(run, "part long, mass long, keys binary, counts binary")


class Summary:
    """Misra-Gries counters: at most `capacity`; a counter falls short of the true count by `cut` at most."""

    def __init__(self, capacity: int):
        self.capacity, self.cut = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add counters up; beyond the capacity, take the largest count that does not fit off all of them."""
        keys, counts = _counted(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        if len(keys) > self.capacity:
            over = len(keys) - self.capacity - 1
            off = int(np.partition(counts, over)[over])
            self.cut += off
            counts = counts - off
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts

    def may_reach(self, least: int) -> np.ndarray:
        return self.keys[self.counts + self.cut >= least]


def _survivors(summaries: DataFrame, least: int, width: int) -> DataFrame:
    """(part, bits): the slice of the filter of each hash partition."""

    def run(table: pa.Table) -> pa.Table:
        mass = sum(table.column("mass").to_pylist())
        summary = Summary(mass // least + 1)
        keys, counts, waiting = [], [], 0

        def merge() -> None:
            summary.merge(np.concatenate(keys).astype(np.uint64), np.concatenate(counts).astype(np.int64))

        for key, count in zip(table.column("keys"), table.column("counts")):
            keys.append(np.frombuffer(key.as_buffer(), "<u4"))
            counts.append(np.frombuffer(count.as_buffer(), "<u4"))
            waiting += len(keys[-1])
            if waiting >= 2 * summary.capacity:
                merge()
                keys, counts, waiting = [], [], 0
        if waiting:
            merge()
        bits = np.zeros(width, bool)
        bits[summary.may_reach(least) & np.uint64(width - 1)] = True
        packed = np.packbits(bits, bitorder="little").tobytes()
        part = table.column("part")[0].as_py()
        return pa.table({"part": [part], "bits": pa.array([packed], pa.binary())})

    return summaries.groupBy("part").applyInArrow(run, "part long, bits binary")


def _filter(summaries: DataFrame, parts: int, least: int) -> Filter:
    """The filter of all hash partitions; at most FILTER_BITS come to the driver."""
    width = SLICE_BITS
    while width > 8 and width * parts > FILTER_BITS:
        width //= 2
    bits = np.zeros(parts * width // 8, np.uint8)
    rows = _survivors(summaries, least, width).toArrow()
    for part, packed in zip(rows.column("part").to_pylist(), rows.column("bits")):
        at = part * width // 8
        bits[at : at + width // 8] = np.frombuffer(packed.as_buffer(), np.uint8)
    return Filter(bits, width)


def _exact(texts: DataFrame, parts: int, short, long, options: Phrases) -> DataFrame:
    """(lang, words, phrase, f): exact counts of n-grams that pass and are frequent; words 0 counts all words.

    A task sends the counts of a hash partition together; there they are added up by language and words.
    """
    longest, least = options.longest, options.least
    names, kinds = ("lang", "words", "phrase", "f"), (pa.string(), pa.int32(), pa.string(), pa.int64())
    fields = "lang string, words int, phrase string, f long"

    def sent(held: dict) -> pa.RecordBatch:
        langs, words, phrases = zip(*held)
        seeds = {language: xxhash.xxh3_64_intdigest(language.encode(), seed=2) for language in set(langs)}
        part = np.array([(xxhash.xxh3_64_intdigest(p) ^ seeds[x]) % parts for x, p in zip(langs, phrases)], np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        offsets = pa.array(np.append(first, len(part)), pa.int32())
        columns = (langs, words, pa.array(phrases, pa.binary()).cast(pa.string()), list(held.values()))
        lists = [
            pa.ListArray.from_arrays(offsets, pa.array(values, kind).take(pa.array(order)))
            for values, kind in zip(columns, kinds)
        ]
        return pa.RecordBatch.from_arrays([pa.array(part[first]), *lists], names=["part", *names])

    def merge(table: pa.Table) -> pa.Table:
        flat = pa.table({name: table.column(name).combine_chunks().flatten() for name in names})
        total = flat.group_by(list(names[:3])).aggregate([("f", "sum")]).rename_columns(list(names))
        return total.filter(pc.or_(pc.equal(total["words"], 0), pc.greater_equal(total["f"], least)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, bytes], int] = {}

        def add(language: str, n: int, phrase: bytes, count: int) -> None:
            key = (language, n, phrase)
            held[key] = held.get(key, 0) + count

        for rows in _slices(batches):
            words = words_of(rows.column(1))
            languages, values, ids = rows.column(0).to_pylist(), words.values, words.ids
            in_row = np.bincount(words.row, minlength=len(languages)).tolist()
            for language, count in zip(languages, in_row):
                add(language, 0, b"", count)
            for n, places, hashes in _grams(words, languages, longest):
                passes = (short if n <= 2 else long).value.has(_codes(hashes, parts))
                places, hashes = places[passes], hashes[passes]
                if len(places) == 0:
                    continue
                _, first, group, counts = np.unique(
                    hashes, return_index=True, return_inverse=True, return_counts=True
                )
                # Equal hashes must be equal words; an occurrence for which that fails counts alone.
                shown = places[first][group]
                same = np.ones(len(places), bool)
                for i in range(n):
                    same &= ids[places + i] == ids[shown + i]
                alone = np.flatnonzero(~same)
                counts = counts - np.bincount(group[alone], minlength=len(counts))
                grams = np.concatenate([places[first], places[alone]])
                counts = [*counts.tolist(), *[1] * len(alone)]
                terms = np.stack([ids[grams + i] for i in range(n)], axis=1).tolist()
                for row, term, count in zip(words.row[grams].tolist(), terms, counts):
                    add(languages[row], n, b" ".join([values[i] for i in term]), count)
            if len(held) >= HELD_PHRASES:
                yield sent(held)
                held = {}
        if held:
            yield sent(held)

    lists = "part long, lang array<string>, words array<int>, phrase array<string>, f array<long>"
    return texts.mapInArrow(run, lists).groupBy("part").applyInArrow(merge, fields)


def phrase_counts(
    docs: DataFrame, options: Phrases = Phrases(), text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(lang, words, phrase, f): exact counts of all phrases of 1 to `longest` words that reach `least`.

    The row with 0 words is the number of all words of a language.
    """
    texts = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = size // PARTITION_BYTES + 1
    context, longest = docs.sparkSession.sparkContext, options.longest
    short = context.broadcast(_filter(_summaries(texts, parts, 2), parts, options.least))
    long = short
    if longest > 2:
        summaries = _summaries(texts, parts, longest, short)
        long = context.broadcast(_filter(summaries, parts, options.least))
    return _exact(texts, parts, short, long, options)


def _big(number: Column) -> Column:
    return number.cast("decimal(19,0)")


def collocations(
    docs: DataFrame, options: Phrases = Phrases(), text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language.

    a, l, r and n count the phrase, its two parts at the lowest-scoring cut (the first of equal ones) and all words;
    the score is floor(1000 * a * n / (l * r)), exact. Ranks go by score and a, both falling, then phrase. A null language is
    `und`, a null text is empty; texts without words give nothing, nor does an empty table. Repeated rows
    count as often as they stand there. Other columns play no part.
    """
    counts = reliable_checkpoint(phrase_counts(docs, options, text_col, lang_col))
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    parts = counts.where(f"words between 1 and {options.longest - 1}")
    found = counts.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    terms = F.split("phrase", " ")
    cut = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang",
        "phrase",
        "a",
        "cut",
        F.array_join(F.slice(terms, F.lit(1), F.col("cut")), " ").alias("left"),
        F.array_join(F.slice(terms, F.col("cut") + 1, F.col("words")), " ").alias("right"),
    )
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(
            parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side]
        )
    few = totals.count() <= BROADCAST_LANGUAGES
    cut = cut.join(F.broadcast(totals) if few else totals, "lang")
    above, below = _big(F.col("a") * 1000) * _big(F.col("n")), _big(F.col("l")) * _big(F.col("r"))
    cut = cut.withColumn("above", above).withColumn("below", below).withColumn("score", F.expr("above div below"))
    best = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    inner = found.where("words > 2").select(
        "lang", F.col("a").alias("longer"), "words", terms.alias("terms"),
        F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"),
    )
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    around = inner.groupBy("lang", F.array_join(F.slice("terms", F.col("at"), F.col("size")), " ").alias("phrase")).agg(
        F.max("longer").alias("longer")
    )
    held = best.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * options.inside)
    )
    held = held.select(
        "lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n",
        F.col("best.score").cast("long").alias("score"),
    )
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("part")
    first = F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))
    held = held.select("*", part).withColumn("first", first).where(F.col("first") <= options.top)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")
    ranked = held.withColumn("rank", rank).where(F.col("rank") <= options.top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
