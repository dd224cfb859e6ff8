"""Near-duplicate groups by MinHash with tensored banding, every link confirmed on full sets.

Plain banding computes all minimum hashes of every table apart. Here two collections of `tables` short
band values are computed, and each pair of values, one of either collection, is the key of a table:
tables^2 keys from 2 * tables * width minimum hashes (Andoni, Indyk 2006; Dahlgaard et al. 2017).

What shares a key is not compared pair by pair:

1. Equal sets are one node. In every bucket each node meets only the leader, the node that meets most others.
2. Components of the confirmed links. Buckets in which several components are left are done
   pair by pair across components when they are small.
3. Nodes of the large ones go through an exact prefix filter with sizes in narrow bands (Xiao et al. 2008):
   it finds every link between them, whatever the bucket, and gives no pairs for sets that only share what
   the whole bucket shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import attach_groups, ids_and_texts, sql_type
from ticketlens.llm.graphs import components
from ticketlens.session import free_name, reliable_checkpoint

#: Buckets of at most so many nodes are compared pair by pair; others take the prefix filter.
SMALL_BUCKET = 12
#: Ratio of neighbouring size bands in the prefix filter.
BAND = 1.02


@dataclass(frozen=True)
class Links:
    """Which documents are linked: `percent` of the union of their `words`-word shingles is shared.

    `tables` and `width` set the search: a link at the threshold t is missed by the keys with
    probability 2 * (1 - t^width)^tables, 4e-4 at 0.8.
    """

    words: int = 5
    percent: int = 80
    tables: int = 12
    width: int = 3

    @property
    def hashes(self) -> int:
        return 2 * self.tables * self.width

    def enough(self, shared: Column, a: Column, b: Column) -> Column:
        return shared * 100 >= (a + b - shared) * self.percent

    def least_shared(self, sizes: Column) -> Column:
        """What two sets must share whose sizes add up to `sizes`."""
        p = self.percent
        return F.ceil(sizes * p / (100 + p)).cast("int")

    def bits_apart(self) -> int:
        """How many of the one-bit hashes of two linked sets may differ; 4.5 deviations of room."""
        p = (1 - self.percent / 100) / 2
        return int(self.hashes * p + 4.5 * (self.hashes * p * (1 - p)) ** 0.5) + 1


_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(31)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the `words`-word shingles of `text`.

    Words are runs of non-space characters (ASCII white space), A-Z in lower case. Fewer words than
    a shingle takes form one shingle of all of them; no words, an empty set.
    """
    hashes = list(map(xxhash.xxh3_64_intdigest, text.encode().lower().split()))
    if not hashes:
        return np.zeros(0, np.uint64)
    known = np.array(hashes, np.uint64)
    width = min(words, len(known))
    found = np.full(len(known) - width + 1, len(known) if width < words else 0, np.uint64)
    for i in range(width):
        found = (found ^ known[i : len(known) - width + 1 + i]) * _SPREAD
        found ^= found >> _SHIFT
    return np.unique(found)


def _functions(links: Links) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    random = np.random.default_rng(20_240_801)
    factors = random.integers(0, 1 << 63, (3, links.hashes), dtype=np.uint64)
    return factors[0] * np.uint64(2) + np.uint64(1), factors[1], factors[2] * np.uint64(2) + np.uint64(1)


def minimum_hashes(found: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        part = found[at : at + 2048, None] * factors + shifts
        np.minimum(least, part.min(axis=0), out=least)
    return least


def _sketches(texts: DataFrame, links: Links) -> DataFrame:
    """(doc_id, n, set_a, set_b, halves, bits): set size and digest, band values, one-bit hashes."""
    kind = sql_type(texts, "doc_id")
    names = ["doc_id", "n", "set_a", "set_b", "halves", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts, mix = _functions(links)
        places = np.uint64(1) << (np.arange(links.hashes, dtype=np.uint64) % np.uint64(64))
        for rows in batches:
            for at in range(0, rows.num_rows, 500):
                part = rows.slice(at, 500)
                sizes, digests, halves, bits = [], [], [], []
                for text in part.column(1):
                    found = shingles(text.as_py(), links.words)
                    sizes.append(len(found))
                    digest = xxhash.xxh3_128_digest(found.tobytes())
                    digests.append(np.frombuffer(digest, np.int64))
                    least = minimum_hashes(found, factors, shifts)
                    values = (least * mix).reshape(-1, links.width).sum(axis=1, dtype=np.uint64)
                    halves.append((values ^ values >> _SHIFT).astype(np.int64))
                    odd = places * (least >> np.uint64(40) & np.uint64(1))
                    groups = [np.bitwise_or.reduce(odd[i : i + 64]) for i in range(0, len(odd), 64)]
                    bits.append(np.array(groups, np.uint64).astype(np.int64))
                pairs = np.array(digests).reshape(-1, 2)
                lists = pa.list_(pa.int64())
                columns = [
                    part.column(0),
                    pa.array(sizes, pa.int32()),
                    pa.array(pairs[:, 0]),
                    pa.array(pairs[:, 1]),
                    pa.array(halves, lists),
                    pa.array(bits, lists),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.mapInArrow(
        run,
        f"doc_id {kind}, n int, set_a long, set_b long, halves array<long>, bits array<long>",
    )


def _sets(texts: DataFrame, nodes: DataFrame, links: Links) -> DataFrame:
    """(node, set) of the documents that are nodes."""
    kind = sql_type(texts, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, 500):
                part = rows.slice(at, 500)
                found = [shingles(x.as_py(), links.words).astype(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "set"]
                )

    wanted = texts.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    return wanted.mapInArrow(run, f"node {kind}, set array<long>")


def _confirmed(pairs: DataFrame, texts: DataFrame, links: Links) -> DataFrame:
    """The pairs (a, b) that are links, compared on full sets."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _sets(texts, nodes, links)
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "set": "set_a"}), "a").join(
        sets.withColumnsRenamed({"node": "b", "set": "set_b"}), "b"
    )
    shared = F.size(F.array_intersect("set_a", "set_b"))
    good = links.enough(shared, F.size("set_a"), F.size("set_b"))
    return reliable_checkpoint(both.where(good).select("a", "b"))


def _close(links: Links) -> Column:
    """Sizes and one-bit hashes of a pair (n_a, bits_a, n_b, bits_b) allow a link."""
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    words = -(-links.hashes // 64)
    apart = sum(
        F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(words)
    )
    return (small * 100 >= large * links.percent) & (apart <= links.bits_apart())


def near_groups(
    docs: DataFrame, links: Links = Links(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of `docs`.

    `component_id` is the smallest id that can be reached over links, `kept` whether it is the row's own.
    Null texts and texts without words have an empty set and are linked with nothing. Rows with the
    same id are one document: what links one of them links all. A row with a null id takes no part; its
    component is null and it is kept. An empty table gives no rows; other columns play no part.
    """
    texts = ids_and_texts(docs, id_col, text_col)
    rows = reliable_checkpoint(_sketches(texts, links))
    named = rows.where("doc_id is not null and n > 0")
    groups = reliable_checkpoint(
        named.groupBy("set_a", "set_b").agg(
            F.min("doc_id").alias("node"),
            F.first("n").alias("n"),
            F.first("halves").alias("halves"),
            F.first("bits").alias("bits"),
            F.count(F.lit(1)).alias("size"),
        )
    )
    same_id = named.select(F.col("doc_id").alias("a"), "set_a", "set_b")
    repeated = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    repeated = repeated.select(F.col("doc_id").alias("a"))
    same_id = same_id.join(repeated, "a").join(groups, ["set_a", "set_b"]).select("a", F.col("node").alias("b"))
    found = _links(groups.select("node", "n", "halves", "bits"), texts, links)
    labels = components(found.union(same_id.where("a != b")))
    named_groups = groups.join(labels, "node", "left").select(
        "set_a", "set_b", F.coalesce("component", "node").alias("component"), "size"
    )
    plain = rows.select("doc_id", "n", "set_a", "set_b")
    joined = attach_groups(plain, reliable_checkpoint(named_groups), ["set_a", "set_b"], "size", rows.count())
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component"))
    component = F.coalesce(component, F.col("doc_id"))
    return joined.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def _buckets(nodes: DataFrame, links: Links) -> DataFrame:
    """(key, node, size) of all table keys that more than one node has.

    Nodes share the key of a pair of halves only if they share both halves, so keys are made of those
    halves alone that another node has too. Most nodes have none.
    """
    halves = nodes.select("node", F.posexplode("halves").alias("at", "half"))
    met = halves.groupBy("at", "half").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    shared = halves.join(met.select("at", "half"), ["at", "half"])
    lists = shared.groupBy("node").agg(F.collect_list(F.struct("at", "half")).alias("halves"))
    first = F.filter("halves", lambda x: x["at"] < links.tables)
    second = F.filter("halves", lambda x: x["at"] >= links.tables)
    keys = F.flatten(
        F.transform(
            first,
            lambda x: F.transform(
                second,
                lambda y: F.xxhash64(x["half"], y["half"], x["at"] * links.tables + y["at"] - links.tables),
            ),
        )
    )
    # A row for each node that has a half of either collection in common with another one.
    members = reliable_checkpoint(lists.select("node", F.explode(keys).alias("key")))
    repeated = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return reliable_checkpoint(members.join(repeated, "key"))


def _pairs(pairs: DataFrame, nodes: DataFrame, links: Links) -> DataFrame:
    """Distinct pairs (a, b) that sizes and one-bit hashes do not rule out."""
    about = nodes.select("node", "n", "bits")
    for side in ("a", "b"):
        names = {"node": side, "n": f"n_{side}", "bits": f"bits_{side}"}
        pairs = pairs.join(about.withColumnsRenamed(names), side)
    return pairs.where(_close(links)).select("a", "b")


def _links(nodes: DataFrame, texts: DataFrame, links: Links) -> DataFrame:
    """Confirmed links (a, b) that connect whatever is connected."""
    members = _buckets(nodes, links)
    met = members.groupBy("node").agg(F.sum("size").alias("met"))
    best = members.join(met, "node").groupBy("key").agg(
        F.max_by("node", F.struct("met", F.xxhash64("node"))).alias("leader")
    )
    stars = members.join(best, "key").where("node != leader")
    stars = stars.select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b"))
    first = _confirmed(reliable_checkpoint(_pairs(stars.distinct(), nodes, links)), texts, links)
    labels = components(first)
    placed = members.where("size > 2").join(labels, "node", "left")
    placed = placed.select("key", "node", "size", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    left = reliable_checkpoint(placed.join(mixed.where("x != y").select("key"), "key"))
    small = left.where(F.col("size") <= SMALL_BUCKET)
    across = small.select("key", F.col("node").alias("a"), F.col("component").alias("x")).join(
        small.select("key", F.col("node").alias("b"), F.col("component").alias("y")), "key"
    )
    across = across.where("a > b and x != y").select("a", "b").distinct()
    crowd = left.where(F.col("size") > SMALL_BUCKET).select("node", "component").distinct()
    rest = _pairs(across, nodes, links).union(_by_prefix(reliable_checkpoint(crowd), texts, links))
    second = _confirmed(reliable_checkpoint(rest.distinct()), texts, links)
    return first.union(second)


def _by_prefix(crowd: DataFrame, texts: DataFrame, links: Links) -> DataFrame:
    """Pairs (a, b) across components of `crowd` that an exact prefix filter cannot rule out."""
    sets = _sets(texts, crowd.select("node"), links)
    tokens = reliable_checkpoint(
        sets.select("node", F.size("set").alias("n"), F.explode("set").alias("token"))
    )
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # Rare tokens first. Tokens of one set alone match nothing but count as places.
    ordered = tokens.join(common, "token").groupBy("node", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens")
    )
    placed = ordered.join(crowd, "node").select(
        "node", "n", "component", F.posexplode(F.slice("tokens", 1, F.col("n"))).alias("at", "token")
    )
    placed = placed.where("token.df > 1").withColumn("token", F.col("token.token"))
    p = links.percent
    prefix = lambda other: F.col("n") - links.least_shared(F.col("n") + other) + 1
    band = lambda size: F.floor(F.log(size.cast("double")) / float(np.log(BAND))).cast("int")
    least = F.ceil(F.col("n") * p / 100)
    reach = placed.where(F.col("at") < prefix(least))
    index = reliable_checkpoint(
        placed.where(F.col("at") < prefix(F.col("n"))).withColumn("band", band(F.col("n")))
    )
    probes = reach.withColumn("band", F.explode(F.sequence(band(least) - 1, band(F.col("n")))))
    lowest = F.greatest(least, F.floor(F.pow(F.lit(BAND), F.col("band"))) - 1)
    probes = reliable_checkpoint(probes.where(F.col("at") < prefix(lowest)))
    # Two sides of one component need not meet: the largest component of a list meets only the others.
    sizes = index.groupBy("token", "band", "component").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("token", "band").agg(F.max_by("component", F.struct("k", "component")).alias("main"))
    entries, asked = index.join(main, ["token", "band"]), probes.join(main, ["token", "band"])
    other = F.col("component") != F.col("main")

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        x = x.withColumnsRenamed({"node": "a", "n": "n_a", "at": "at_a", "component": "x"}).drop("main")
        y = y.withColumnsRenamed({"node": "b", "n": "n_b", "at": "at_b", "component": "y"}).drop("main")
        both = x.join(y, ["token", "band"])
        possible = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
        shorter = (F.col("n_b") < F.col("n_a")) | (
            (F.col("n_b") == F.col("n_a")) & (F.col("b") < F.col("a"))
        )
        fits = F.col("n_b") * 100 >= F.col("n_a") * p
        enough = possible >= links.least_shared(F.col("n_a") + F.col("n_b"))
        return both.where((F.col("x") != F.col("y")) & shorter & fits & enough).select("a", "b")

    pairs = meet(asked, entries.where(other)).union(meet(asked.where(other), entries.where(~other)))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def drop_near_copies(
    docs: DataFrame, links: Links = Links(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`docs` with one document of each group of near copies, the one with the smallest id.

    Rows without an id, without a text or without words stay. Rows that repeat an id are one document: they stay
    or go together. An empty table stays empty; all columns are kept, whatever their names.
    """
    groups = near_groups(docs, links, id_col, text_col)
    gone = free_name("gone", docs)
    dropped = groups.where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, docs[id_col] == F.col(gone), "left_anti")
