"""What the text operators share: reading rows, packing files for tasks, building Arrow batches."""

from __future__ import annotations

import math
import os
import sys
import types

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: space and the bytes 9 to 13.
WHITE_SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text) of `docs`, a null text as an empty one; other columns cannot clash."""
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def sql_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


#: A group is large when it holds more than a 10,000th of all rows, so at most 10,000 are.
LARGE_GROUPS = 10_000
#: And it has more than so many rows.
LARGE_GROUP_ROWS = 20_000


def attach_groups(
    rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, n_rows: int
) -> DataFrame:
    """`rows` left-joined with the one row of `groups` (no null in it) that has their keys.

    The few groups of very many rows are broadcast, at most LARGE_GROUPS of them; rows of all others
    are shuffled, where no key is hot.
    """
    large = max(LARGE_GROUP_ROWS, n_rows // LARGE_GROUPS)
    added = [name for name in groups.columns if name not in keys]
    hot = groups.where(F.col(size_col) > large)
    hot = hot.withColumnsRenamed({name: f"hot_{name}" for name in added})
    found = rows.join(F.broadcast(hot), keys, "left")
    in_hot = F.col(f"hot_{size_col}").isNotNull()
    names = [*rows.columns, *added]
    large_ones = found.where(in_hot).withColumnsRenamed({f"hot_{name}": name for name in added})
    others = found.where(~in_hot).select(*rows.columns)
    others = others.join(groups.where(F.col(size_col) <= large), keys, "left")
    return others.select(*names).unionByName(large_ones.select(*names))


#: Parts that the counts of one step are cut into at a time.
COUNT_PARTS = 1024


def frequent_from(counts: DataFrame, most: int, steps: int = 16) -> int:
    """The least count for which at most `most` rows of `counts` have that count or a larger one.

    Rounded up to a `steps`-th of a power of two, so a few hundred sums decide, whatever the table. When that
    leaves more than half of `most` unused, the step in between is cut finer until the count is exact.
    """
    step = F.floor(F.log2(F.col("count")) * steps).cast("int")
    sums = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()
    total, least, low = 0, 1 << 62, None
    for row in sorted(sums, key=lambda row: -row["step"]):
        if total + row["rows"] > most:
            # A little more room than the step, as logarithms are rounded.
            low = max(0, math.floor(2 ** (row["step"] / steps) * (1 - 1e-9)))
            break
        total += row["rows"]
        least = max(1, math.ceil(2 ** (row["step"] / steps) * (1 - 1e-9)))
    high = least if least < 1 << 62 else (low or 0) * 2 + 4
    while low is not None and 2 * total < most and high - low > 1:
        width = -(-(high - low) // COUNT_PARTS)
        part = F.floor((F.col("count") - low) / width).cast("int")
        within = counts.where((F.col("count") >= low) & (F.col("count") < high))
        sums = within.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).collect()
        base = low
        for row in sorted(sums, key=lambda row: -row["part"]):
            if total + row["rows"] > most:
                low, high = base + row["part"] * width, min(high, base + (row["part"] + 1) * width)
                break
            total += row["rows"]
            least = base + row["part"] * width
        else:
            break
        if width == 1:
            break
    return least


def held_out(id_column: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves `part` when divided by `parts`; false for null."""
    digest = F.crc32(F.col(id_column).cast("string").cast("binary"))
    return F.coalesce(digest % parts == part, F.lit(False))


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, f.type)
        for c, f in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def single_threaded() -> None:
    """A task has one core: its libraries start no threads of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def worker_cache() -> dict:
    """What a Python worker keeps from task to task; each entry must bound its own size."""
    name = "_ticketlens_worker"
    module = sys.modules.setdefault(name, types.ModuleType(name))
    return vars(module).setdefault("kept", {})
