"""Session helpers: reliable checkpoints that survive the loss of an executor."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if shared:
        sc.setCheckpointDir(shared)
    else:
        # A folder beside the warehouse, on the warehouse's own file system.
        jvm = sc._jvm
        warehouse = jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir"))
        fs = warehouse.getFileSystem(sc._jsc.hadoopConfiguration())
        beside = fs.makeQualified(warehouse).getParent()
        if beside.toUri().getScheme() == "file" and not sc.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors can reach.")
        folder = jvm.org.apache.hadoop.fs.Path(beside, f"spark-warehouse-scratch-{uuid.uuid4().hex}")
        fs.deleteOnExit(folder)  # removed when the session's process ends
        sc.setCheckpointDir(folder.toString())


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Write `df` to the session's checkpoint folder and continue from there."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written under the checkpoint folder and read again: smaller than a checkpoint, and kept as long as the session."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have the shuffles and checkpoints removed that no frame refers to any more.

    Spark does so after a collection of the driver's garbage, which may be long in coming while tasks do all the work.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def with_numbers(rows: DataFrame, name: str) -> DataFrame:
    """`rows` with the numbers 0, 1, 2, ... in column `name`.

    The rows are written once; sizes are summed up over partitions, so the ordered window has one row for each.
    """
    kept = reliable_checkpoint(rows)
    part, at = free_name("part", rows), free_name("at", rows)
    place = F.monotonically_increasing_id()
    placed = kept.withColumn(at, place)
    sizes = placed.groupBy(F.shiftright(at, 33).alias(part)).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    firsts = reliable_checkpoint(sizes.select(part, F.coalesce(before, F.lit(0)).alias("first")))
    numbered = placed.withColumn(part, F.shiftright(at, 33)).join(F.broadcast(firsts), part)
    inside = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return numbered.select(*columns, (F.col("first") + inside).alias(name))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the session's checkpoint folder, which every executor can reach."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def free_name(name: str, *frames: DataFrame) -> str:
    """`name`, with more underscores until no column of `frames` is called so, in any case."""
    taken = {column.lower() for frame in frames for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(scan: DataFrame) -> DataFrame:
    """Share a scan of few partitions among all cores; a scan with enough is left as it is.

    Meant for bare scans: counting the partitions of a plan with shuffles would run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() < cores:
        return scan.repartition(cores)
    return scan
