"""Quality classifier: a sparse ensemble of rules, compiled into column expressions.

Statistics of whole texts go through a small forest; every path from a root becomes a rule, a conjunction of
comparisons (RuleFit; Friedman, Popescu 2008). A logistic regression with an L1 penalty weighs the rules, most
of which get no weight. What is left is a sum of a few conditions, which Spark evaluates as plain columns.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ticketlens.llm.common import held_out
from ticketlens.session import free_name, reliable_checkpoint

#: Statistics of a text, in the order of the array `statistics`.
STATISTICS = (
    "log_bytes",
    "log_words",
    "word_bytes",
    "upper",
    "digits",
    "sentence_marks",
    "exclamations",
    "symbols",
    "bars",
    "spaces",
    "line_ends",
    "beyond_ascii",
    "distinct_words",
    "top_word",
    "repeated_neighbours",
    "distinct_lines",
    "words_per_line",
    "marked_words",
    "compressed",
)

_PLACES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digits": b"0123456789",
    "sentence_marks": b".,;:?'\"-()",
    "exclamations": b"!",
    "symbols": b"#$%&*+/<=>@[\\]^_`{}~",
    "bars": b"|",
    "spaces": b" \t",
    "line_ends": b"\n",
}
_GROUPS = [np.frombuffer(places, np.uint8) for places in _PLACES.values()]


def statistics(text: str) -> list[float]:
    """The numbers named in STATISTICS; all are finite, also for an empty text."""
    content = text.encode()
    n = max(1, len(content))
    counts = np.bincount(np.frombuffer(content, np.uint8), minlength=256)
    words = content.split()
    lines = content.split(b"\n")
    n_words = max(1, len(words))
    top = max(Counter(words).values(), default=0)
    distinct = len(set(words))
    repeated = sum(map(operator.eq, words, words[1:]))
    marked = sum(not word[-1:].isalnum() for word in words if word[-1] < 128)
    return [
        math.log1p(len(content)),
        math.log1p(len(words)),
        sum(map(len, words)) / n_words,
        *(float(counts[group].sum()) / n for group in _GROUPS),
        float(counts[128:].sum()) / n,
        distinct / n_words,
        top / n_words,
        repeated / n_words,
        len(set(lines)) / len(lines),
        len(words) / len(lines),
        marked / n_words,
        len(zlib.compress(content, 1)) / n,
    ]


def with_statistics(docs: DataFrame, text_col: str = "text", name: str = "statistics") -> DataFrame:
    """`docs` with the array of statistics of its text column; a null text counts as empty."""
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [statistics(text.as_py() or "") for text in rows.column(at)]
            column = pa.array(found, pa.list_(pa.float64()))
            names = [*rows.schema.names, name]
            yield pa.RecordBatch.from_arrays([*rows.columns, column], names=names)

    return docs.mapInArrow(run, schema)


#: (statistic, whether it must be at most the threshold, threshold)
Condition = tuple[int, bool, float]


@dataclass(frozen=True)
class Rules:
    """Weighted rules; their log-odds add up to the score. Without rules the share of good texts."""

    intercept: float
    weights: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self, name: str = "statistics") -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(_holds(rule, name), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def __str__(self) -> str:
        def shown(rule: tuple[Condition, ...]) -> str:
            return " and ".join(f"{STATISTICS[i]} {'<=' if le else '>'} {t:.6g}" for i, le, t in rule)

        lines = [f"{weight:+.3f}  {shown(rule)}" for rule, weight in self.weights]
        return "\n".join([f"{self.intercept:+.3f}", *lines])


def _holds(rule: tuple[Condition, ...], name: str) -> Column:
    held = F.lit(True)
    for i, at_most, threshold in rule:
        value = F.get(F.col(name), F.lit(i))
        held = held & (value <= threshold if at_most else value > threshold)
    return held


def paths(described: str) -> set[tuple[Condition, ...]]:
    """Conjunctions on the way to every node below the root, from a tree's description."""
    found, way = set(), []
    for line in described.splitlines():
        test = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if test:
            depth = len(test[1])
            way = [w for w in way if w[0] < depth]
            way.append((depth, (int(test[3]), test[4] == "<=", float(test[5]))))
            found.add(_shortened([condition for _, condition in way]))
    return found


def _shortened(conditions: list[Condition]) -> tuple[Condition, ...]:
    """Of several bounds on one statistic from one side, the narrowest."""
    bounds: dict[tuple[int, bool], float] = {}
    for i, at_most, threshold in conditions:
        old = bounds.get((i, at_most), threshold)
        bounds[i, at_most] = min(old, threshold) if at_most else max(old, threshold)
    return tuple((i, at_most, t) for (i, at_most), t in sorted(bounds.items()))


def fit_rules(
    labelled: DataFrame, trees: int = 24, depth: int = 3, penalty: float = 0.001, seed: int = 7
) -> Rules:
    """Rules from all rows of (statistics, label) with label 0 or 1."""
    rows = labelled.where("label in (0, 1)").select(
        array_to_vector("statistics").alias("features"), F.col("label").cast("double").alias("label"), "statistics"
    )
    rows = reliable_checkpoint(rows)
    n, good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < good < n:
        share = (good + 1) / (n + 2)
        return Rules(math.log(share / (1 - share)), ())
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, seed=seed
    ).fit(rows)
    rules = sorted(set().union(*(paths(tree.toDebugString) for tree in forest.trees)))
    if not rules:
        return Rules(math.log(good / (n - good)), ())
    held = F.array(*[_holds(rule, "statistics").cast("double") for rule in rules])
    ruled = rows.select("label", array_to_vector(held).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=100).fit(ruled)
    weights = lasso.coefficients.toArray()
    kept = tuple((rule, float(w)) for rule, w in zip(rules, weights) if abs(w) > 1e-9)
    return Rules(float(lasso.intercept), kept)


@dataclass(frozen=True)
class QualityModel:
    rules: Rules
    threshold: float = 0.7

    def filter(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The rows of `docs` whose text scores at least the threshold; their columns stay, whatever their names.

        Null texts are empty, and empty texts are scored like all others; repeated rows stay or go together. An empty
        table stays empty.
        """
        name = free_name("statistics", docs)
        scored = with_statistics(docs, text_col, name)
        kept = scored.where(self.rules.score(name) >= self.threshold)
        return kept.select([f"`{c}`" for c in docs.columns])


def _labelled(stats: DataFrame, labels: DataFrame, parts: int, part: int) -> DataFrame:
    """(statistics, label) of the labelled rows whose id is not held out."""
    known = labels.select(F.col("doc_id").alias("labelled_id"), F.col("quality").alias("label"))
    known = known.where(F.col("label").isNotNull() & ~held_out("labelled_id", parts, part))
    return stats.join(known, F.col("doc_id") == F.col("labelled_id")).select("statistics", "label")


def fit_quality(
    docs: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2, **options
) -> QualityModel:
    """A model from `labels` (doc_id, quality) of `docs` (doc_id, text).

    Rows with null labels, ids that are held out or not in both tables teach nothing; repeated ones count each
    time. Without rows of both classes every text gets the share of good ones.
    """
    known = labels.where("quality is not null").select(F.col("doc_id").alias("labelled_id")).distinct()
    texts = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("labelled_id"), "left_semi")
    return QualityModel(fit_rules(_labelled(with_statistics(texts), labels, parts, part), **options))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.7,
    parts: int = 4,
    part: int = 2,
    **options,
) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of `docs` (doc_id, text).

    Labels of rows whose crc32(doc_id as text) leaves `part` when divided by `parts` are not learned from.
    Null texts are empty; empty texts are scored like all others. Ids may repeat or be null. An empty table
    gives no rows. Only statistics of the text enter a score.
    """
    stats = with_statistics(docs.select("doc_id", "text")).select("doc_id", "statistics")
    stats = reliable_checkpoint(stats)
    rules = fit_rules(_labelled(stats, labels, parts, part), **options)
    return stats.select(
        "doc_id",
        held_out("doc_id", parts, part).alias("held_out"),
        rules.score().alias("score"),
    ).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
