"""Whitening of embeddings along their leading components, found by contour integration.

Vectors are put on a grid of whole numbers, so equal ones are equal exactly and sums are exact. The
covariance of the distinct vectors is summed up in tasks. Its leading eigenvectors come from FEAST
(Polizzi 2009): inertia counts of shifted covariances (Sylvester's law, by symmetric elimination) bracket an
interval that holds exactly the wanted eigenvalues; a quadrature of complex shifted solves on a circle around it
projects random vectors onto their span; Rayleigh-Ritz extracts the components, and the number found must be the one
that the inertia counted. The driver holds matrices of the dimension squared only, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import sql_type
from ticketlens.session import reliable_checkpoint

#: Steps of the grid in one unit of an embedding.
GRID = 256
#: Components that are returned.
COMPONENTS = 4
#: Points of the quadrature on the upper half of the circle.
POINTS = 8
#: Rows that a task turns into a matrix at a time.
BLOCK = 4096
_LONG = 1 << 63


def whole_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(256 * entry) of every vector without null and non-finite entries."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")

    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))

    rows = embeddings.select(F.col(f"`{id_col}`").alias("vec_id"), vector.alias("e"))
    rows = rows.where(F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", finite))
    return rows.select("vec_id", F.transform("e", lambda c: F.floor(c * F.lit(float(GRID))).cast("long")).alias("x"))


def _common_length(rows: DataFrame) -> int | None:
    counts = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("k"))
    first = counts.orderBy(F.desc("k"), "d").first()
    return first and first["d"]


def _blocks(batches: Iterator[pa.RecordBatch], at: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for rows in batches:
        for begin in range(0, rows.num_rows, BLOCK):
            part = rows.slice(begin, BLOCK)
            yield part, part.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max())))


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""
    exact = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for _, x in _blocks(batches, 0, d):
            n += len(x)
            total += x.sum(axis=0) if _largest(x) * len(x) < _LONG else x.astype(object).sum(axis=0)
        values = pa.array([Decimal(int(v)) for v in (n, *total)], exact)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), values], names=["at", "v"])

    parts = fit.mapInArrow(run, "at int, v decimal(38,0)")
    found = {row["at"]: int(row["v"]) for row in parts.groupBy("at").agg(F.sum("v").alias("v")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(d)]


def _covariance(fit: DataFrame, mean: np.ndarray, n: int) -> np.ndarray:
    """Covariance with divisor n; vectors are centred before they are multiplied."""
    d = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for _, x in _blocks(batches, 0, d):
            centred = x.astype(np.float64) - mean
            total += centred.T @ centred
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"]
        )

    parts = fit.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    cells = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    covariance = np.zeros((d, d))
    i, j = (cells.column(name).to_numpy() for name in ("i", "j"))
    covariance[i, j] = cells.column("v").to_numpy()
    return (covariance + covariance.T) / (2 * n)


def inertia_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are larger than `shift`.

    By Sylvester's law it is the number of positive eigenvalues of D in L D L' = matrix - shift, by
    elimination with complete pivoting on blocks of one or two (Bunch, Parlett 1971).
    """
    a = matrix - shift * np.eye(len(matrix))
    ratio, above = (1 + 17**0.5) / 8, 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        off = np.abs(a - np.diag(np.diag(a)))
        one = int(diagonal.argmax())
        i, j = np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[one] == 0 and off[i, j] == 0:
            return above
        pivots = [one] if diagonal[one] >= ratio * off[i, j] else [int(i), int(j)]
        block = a[np.ix_(pivots, pivots)]
        # A block of two is chosen only when its determinant is negative: one eigenvalue on either side.
        above += 1 if len(pivots) == 2 or block[0, 0] > 0 else 0
        rest = np.delete(np.arange(len(a)), pivots)
        side = a[np.ix_(rest, pivots)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return above


def _edge(matrix: np.ndarray, low: float, high: float, least: int) -> tuple[float, float]:
    """Narrow (low, high) down around the point where `least` eigenvalues are above low, fewer above high."""
    for _ in range(60):
        middle = (low + high) / 2
        if not low < middle < high or high - low < 1e-13:
            break
        if inertia_above(matrix, middle) >= least:
            low = middle
        else:
            high = middle
    return low, high


def interval_above(matrix: np.ndarray, wanted: int) -> tuple[float, int]:
    """(lower end, count): the eigenvalues above the end are the `wanted` largest, and any equal to the last.

    The end lies in the middle of the gap below them. `matrix` has norm 1 at most; eigenvalues that rounding
    alone could make count as zero and are left out.
    """
    nothing = 4 * len(matrix) * np.finfo(float).eps
    positive = inertia_above(matrix, nothing)
    wanted = min(wanted, positive)
    if wanted == 0:
        return 1.0, 0
    last, _ = _edge(matrix, nothing, 1.0 + nothing, wanted)
    count = inertia_above(matrix, last)
    if count == positive:
        return (nothing + last) / 2 if inertia_above(matrix, (nothing + last) / 2) == count else last, count
    below, above = _edge(matrix, nothing, last, count + 1)
    return (above + last) / 2, count


def feast(matrix: np.ndarray, wanted: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest positive eigenvalues, falling, and their unit eigenvectors as columns."""
    scale = np.abs(matrix).sum(axis=1).max() if len(matrix) else 0.0
    if scale == 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    a = matrix / scale
    low, count = interval_above(a, wanted)
    if count == 0:
        return np.zeros(0), np.zeros((len(a), 0))
    high = 1.0 + 1e-9
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    turns = np.exp(1j * np.pi / 2 * (1 - nodes))
    d = len(a)
    space = np.random.default_rng(7).standard_normal((d, min(d, max(2 * count, count + 4))))
    best = None
    for _ in range(rounds):
        filtered = np.zeros_like(space)
        for turn, weight in zip(turns, weights):
            solved = np.linalg.solve((centre + radius * turn) * np.eye(d) - a, space.astype(complex))
            filtered += weight / 2 * (radius * turn * solved).real
        basis = np.linalg.qr(filtered)[0]
        values, small = np.linalg.eigh(basis.T @ a @ basis)
        space = basis @ small
        inside = np.flatnonzero(values > low)[::-1]
        error = np.linalg.norm(a @ space[:, inside] - space[:, inside] * values[inside], axis=0).max(initial=0.0)
        if len(inside) == count and (best is None or error < best[0]):
            best = (error, values[inside], space[:, inside])
        elif best is not None:
            break  # rounding is reached
    if best is None or best[0] > 1e-9:
        raise ArithmeticError("the contour integration did not find all eigenvalues that the inertia counts")
    return best[1][:wanted] * scale, best[2][:, :wanted]


def whiten(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Vectors that are null, empty or hold null or non-finite entries are left out; so are vectors whose length is not
    the most frequent one (the smaller of two as frequent). The fit takes each distinct vector on the grid
    once; ids may repeat or be null, each row gives its own. `deviation` is null where it exceeds a long.
    Components without variance are not returned, so a single distinct vector gives no rows; neither does an
    empty table. Other columns play no part.
    """
    kind = sql_type(embeddings.select(F.col(f"`{id_col}`").alias("vec_id")), "vec_id")
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double"
    rows = whole_vectors(embeddings, id_col, vector_col)
    d = _common_length(rows)
    none = embeddings.sparkSession.createDataFrame([], schema + ", identity_error double")
    if d is None:
        return none
    rows = rows.where(F.size("x") == d)
    fit = reliable_checkpoint(rows.select("x").distinct())
    n, sums = _sums(fit, d)
    mean = np.array([float(Fraction(s, n)) for s in sums])
    covariance = _covariance(fit, mean, n)
    values, vectors = feast(covariance, components)
    if len(values) == 0:
        return none
    explained = values / np.trace(covariance)
    scaled, found = vectors / np.sqrt(values), len(values)
    most = max(map(abs, sums))
    names = [field.split(" ")[0] for field in schema.split(", ")]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _blocks(batches, 0, d):
            white = (x.astype(np.float64) - mean) @ scaled
            yield pa.RecordBatch.from_arrays([pa.array(list(white), pa.list_(pa.float64()))], names=["w"])

    def deviations(x: np.ndarray) -> list[int | None]:
        if (n * _largest(x) + most) ** 2 * d < _LONG:
            away = n * x - np.array(sums, np.int64)
            return (away * away).sum(axis=1).tolist()
        away = n * x.astype(object) - np.array(sums, object)
        return [v if v < _LONG else None for v in (away * away).sum(axis=1).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, 1, d):
            white = (x.astype(np.float64) - mean) @ scaled
            each = pa.array(np.repeat(np.arange(len(x)), found))
            columns = [
                part.column(0).take(each),
                pa.array(np.tile(np.arange(1, found + 1), len(x)), pa.int32()),
                pa.array(np.full(len(x) * found, n), pa.int64()),
                pa.array(deviations(x), pa.int64()).take(each),
                pa.array(white.ravel()),
                pa.array(np.tile(explained, len(x))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    white = fit.mapInArrow(project, "w array<double>").select(*[F.get("w", i).alias(f"w{i}") for i in range(found)])
    pairs = [(i, j) for i in range(found) for j in range(i, found)]
    spread = white.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    error = max(abs(v - (i == j)) for v, (i, j) in zip(spread, pairs))
    return rows.mapInArrow(run, schema).withColumn("identity_error", F.lit(float(error)))
