"""Records of CSV files whose quoted cells hold line breaks, read by many tasks.

A line break ends a record only outside quotes, which a task that starts in the middle of a file cannot know. Each
line is therefore described by what it does to either state, outside or inside a quoted cell: it keeps the state, turns
it round, or ends in the same one from both. Such steps can be put together, so a first pass gives one step for
each block of a file and prefix sums over blocks give the state that each block starts in. The second pass cuts
records; the pieces of records that reach over a block's end, at most two for each block, meet in a shuffle.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ticketlens.session import reliable_checkpoint

#: Options that every reader of records shares.
OPTIONS = {"escape": '"', "multiLine": "true"}

# A cell: quoted, with doubled quotes and what follows the closing one, or plain, or empty.
_IN_QUOTES = r'(?:[^"]|"")*+'
_AFTER = r'"(?!")[^,]*+'
_CELL = rf'(?:"{_IN_QUOTES}{_AFTER}|[^",][^,]*+|)'
_OPENED = rf'(?:{_CELL},)*+"{_IN_QUOTES}'
#: From outside, the line ends in a quoted cell.
OPENS = rf"(?s)\A{_OPENED}\z"
#: From inside a quoted cell, the line ends in one: in the same, or in a later one.
STAYS = rf"(?s)\A{_IN_QUOTES}(?:{_AFTER},{_OPENED})?\z"


class Layout(NamedTuple):
    """Files with the same header row and the same line ends."""

    header: str
    carriage_returns: bool
    files: list[str]


def _file_lines(spark: SparkSession, paths: list[str], carriage_returns: bool = False) -> DataFrame:
    """(file, block, value): the lines of the files in order, without their ends; a block is a split of a file."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    value = F.regexp_replace("value", r"\r\z", "") if carriage_returns else F.col("value")
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        value.alias("value"),
    )


def line_steps(line: Column) -> dict[str, Column]:
    """Whether the end of a line is in a quoted cell: `from_out` when its start is not, `from_in` when it is."""
    quoted = F.contains(line, F.lit('"'))
    return {
        "from_out": quoted & F.rlike(line, F.lit(OPENS)),
        "from_in": ~quoted | F.rlike(line, F.lit(STAYS)),
    }


def _runs(rows: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(file, block, begin, end) of the consecutive rows of each block."""
    if rows.num_rows == 0:
        return
    blocks = rows.column(1).to_numpy()
    files = rows.column(0).dictionary_encode()
    numbers = files.indices.to_numpy()
    changed = (numbers[1:] != numbers[:-1]) | (blocks[1:] != blocks[:-1])
    edges = [0, *(np.flatnonzero(changed) + 1).tolist(), rows.num_rows]
    for begin, end in zip(edges, edges[1:]):
        yield files.dictionary[int(numbers[begin])].as_py(), int(blocks[begin]), begin, end


def _states(from_out: np.ndarray, from_in: np.ndarray, start: bool) -> np.ndarray:
    """Whether each line, and what follows the last, starts in a quoted cell."""
    turns = np.cumsum(from_out & ~from_in) & 1
    fixed = from_out == from_in
    # The state behind a line: that of the last line that leaves no choice, turned round as often as since then.
    last = np.maximum.accumulate(np.where(fixed, np.arange(1, len(fixed) + 1), 0))
    known = np.concatenate([[int(start)], from_out.astype(int) ^ turns])[last]
    return np.concatenate([[start], (known ^ turns).astype(bool)])


def _block_steps(lines: DataFrame) -> DataFrame:
    """(file, block, from_out, from_in): what each block does to either state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def row() -> pa.RecordBatch:
            columns = [pa.array([held[0]]), pa.array([held[1]], pa.int64())]
            columns += [pa.array([value], pa.bool_()) for value in held[2:]]
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "from_out", "from_in"])

        for rows in batches:
            steps = [rows.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (2, 3)]
            for file, block, begin, end in _runs(rows):
                if held is None or held[:2] != [file, block]:
                    if held is not None:
                        yield row()
                    held = [file, block, False, True]
                part = [step[begin:end] for step in steps]
                held[2:] = [bool(_states(*part, start)[-1]) for start in held[2:]]
        if held is not None:
            yield row()

    steps = lines.select("file", "block", *[c.alias(name) for name, c in line_steps(F.col("value")).items()])
    return steps.mapInArrow(run, "file string, block long, from_out boolean, from_in boolean")


def quoted_blocks(lines: DataFrame) -> DataFrame:
    """(file, block) of the blocks that start inside a quoted cell."""
    order = W.partitionBy("file").orderBy("block")
    turns = F.sum((F.col("from_out") & ~F.col("from_in")).cast("int")).over(order) % 2
    fixed = F.col("from_out") == F.col("from_in")
    steps = _block_steps(lines).withColumn("turns", turns)
    known = F.when(fixed, F.col("from_out").cast("int").bitwiseXOR(F.col("turns").cast("int")))
    steps = steps.withColumn("known", F.last(known, ignorenulls=True).over(order))
    behind = F.coalesce("known", F.lit(0)).bitwiseXOR(F.col("turns").cast("int"))
    states = steps.withColumn("behind", behind).withColumn("inside", F.lag("behind", 1, 0).over(order))
    return states.where("inside = 1").select("file", "block")


def csv_records(spark: SparkSession, paths: list[str], carriage_returns: bool = False) -> DataFrame:
    """(file, first, record): every record of CSV files as it stands there, `first` for the first one of a file.

    Any task can read any block of a file. Line ends come as single line feeds, also inside cells. Empty records are left out, as CSV readers do. A quoted cell
    that the file never closes reaches to its end. The blocks that start inside a quoted cell are sent
    to all tasks, at most one for each block of a file.
    """
    lines = _file_lines(spark, paths, carriage_returns)
    inside = {(row.file, row.block) for row in quoted_blocks(lines).collect()}
    shared = spark.sparkContext.broadcast(inside)
    names = ["file", "block", "kind", "first", "record"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Lines of a record that has not ended yet, whether it began in this block and is the file's first.
        at, state, begun, first, waiting = None, False, False, False, []

        def rows(kinds, firsts, records) -> pa.RecordBatch:
            n = len(records)
            columns = [pa.array([at[0]] * n), pa.array([at[1]] * n, pa.int64()), pa.array(kinds, pa.int32())]
            columns += [pa.array(firsts, pa.bool_()), pa.array(records, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def rest() -> Iterator[pa.RecordBatch]:
            """The piece behind the last cut: a whole record, the begin of one, or the middle of one."""
            if waiting:
                kind = (2 if state else 0) if begun else 1
                yield rows([kind], [first and begun], ["\n".join(waiting)])

        for batch in batches:
            steps = [batch.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (3, 4)]
            for file, block, begin, end in _runs(batch):
                if at != (file, block):
                    yield from rest()
                    at, state = (file, block), (file, block) in shared.value
                    begun, first, waiting = False, block == 0 and not state, []
                states = _states(steps[0][begin:end], steps[1][begin:end], state)
                state = bool(states[-1])
                starts = np.flatnonzero(~states[:-1])
                texts = batch.column(2).slice(begin, end - begin)
                if len(starts) == 0:
                    waiting += texts.to_pylist()
                    continue
                waiting += texts.slice(0, int(starts[0])).to_pylist()
                # What waited ends where the first new record begins.
                if waiting:
                    yield rows([0 if begun else 1], [first and begun], ["\n".join(waiting)])
                    first = first and not begun
                if len(starts) > 1:
                    offsets = pa.array((starts - starts[0]).astype(np.int32))
                    whole = pa.ListArray.from_arrays(offsets, texts.slice(int(starts[0])))
                    records = pc.binary_join(whole, "\n")
                    flags = np.zeros(len(records), bool)
                    flags[0] = first
                    first = False
                    yield rows(np.zeros(len(records), np.int32), flags, records)
                begun, waiting = True, texts.slice(int(starts[-1])).to_pylist()
        yield from rest()

    steps = line_steps(F.col("value"))
    pieces = lines.select("file", "block", "value", steps["from_out"].alias("o"), steps["from_in"].alias("i"))
    pieces = pieces.mapInArrow(run, "file string, block long, kind int, first boolean, record string")
    return _joined(pieces)


def _joined(pieces: DataFrame) -> DataFrame:
    """Whole records as they are, and those whose begin (2) and further pieces (1) lie in several blocks put together.

    The latter, at most one for each block, are stored: their shuffle is not repeated by each reader of the records.
    """
    whole = pieces.where("kind = 0").select("file", "first", "record")
    parts = pieces.where("kind > 0")
    order = W.partitionBy("file").orderBy("block", "kind")
    owner = F.last(F.when(F.col("kind") == 2, F.col("block")), ignorenulls=True).over(order)
    parts = parts.withColumn("owner", owner)
    texts = F.array_sort(F.collect_list(F.struct("block", "kind", "record")))
    longer = parts.groupBy("file", "owner").agg(
        F.max("first").alias("first"), F.array_join(F.transform(texts, lambda x: x["record"]), "\n").alias("record")
    )
    longer = reliable_checkpoint(longer.select("file", "first", "record"))
    return whole.union(longer).where("record != ''")


def header_names(header: str) -> list[str]:
    """Column names of a header record, as Spark's CSV reader gives them: repeated ones with their place."""
    cells = next(csv.reader([header.lstrip("\ufeff")], strict=False), [])
    lower = [cell.lower() for cell in cells]
    names = []
    for place, cell in enumerate(cells):
        if not cell:
            names.append(f"_c{place}")
        else:
            names.append(f"{cell}{place}" if lower.count(cell.lower()) > 1 else cell)
    return names


def read_split_csv(spark: SparkSession, layout: Layout) -> DataFrame:
    """The rows of CSV files of one layout as columns of text; every file may be read by many tasks."""
    names = header_names(layout.header)
    ddl = ", ".join("`" + name.replace("`", "``") + "` string" for name in names)
    records = csv_records(spark, layout.files, layout.carriage_returns)
    cells = records.where(~F.col("first")).select(F.from_csv("record", ddl, OPTIONS).alias("cells"))
    return cells.select(*[F.col("cells").getField(name).alias(name) for name in names])


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, carriage_returns): the first line of every file under `path`.

    Lines are passed over where they are read, in as many tasks as files have splits. A Python task that stops after
    its first row would be sent the others all the same, and in small batches for many times the cost.
    """
    split = "spark.sql.files.maxPartitionBytes"
    cost = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(cost)
    try:
        # For this one job each split is a partition of its own, so the first row of the first one is the header.
        spark.conf.set(cost, spark.conf.get(split))
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        found = _file_lines(spark, [path]).withColumn("row", row).where("block = 0 and row = 0")
        header = F.regexp_replace("value", r"\A\x{FEFF}|\r\z", "").alias("header")
        ends = F.endswith("value", F.lit("\r")).alias("carriage_returns")
        return reliable_checkpoint(found.select("file", header, ends))
    finally:
        spark.conf.set(cost, before)


def layouts(spark: SparkSession, path: str) -> list[Layout]:
    """The layouts of the files under `path`; the driver gets a row for each."""
    keys = ["header", "carriage_returns"]
    rows = first_lines(spark, path).groupBy(*keys).agg(F.array_sort(F.collect_list("file")).alias("files"))
    return [Layout(*row) for row in rows.select(*keys, "files").orderBy(*keys).collect()]
