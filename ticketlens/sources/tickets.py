"""Ticket ingest: CSV exports of either layout into the fixed ticket schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.functions.dates import parse_ticket_ts, with_date_parts
from ticketlens.functions.text import strip_whitespace
from ticketlens.schema import (
    COLUMN_ALIASES,
    NA_STRINGS,
    OPTIONAL_COLUMNS,
    REQUIRED_COLUMNS,
)
from ticketlens.session import free_name, reliable_checkpoint, spread
from ticketlens.sources.records import layouts, read_split_csv

COPIES_PER_TASK = 100_000
#: Repeated keys and digests, of a few dozen bytes each, that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1 << 18


def _name(column: str) -> Column:
    return F.col(f"`{column}`")


def read_tickets_csv(
    spark: SparkSession,
    path: str,
    id_column: str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Read one CSV export (a file or a folder of files) as normalised tickets.

    All cells are read as text. Files of a folder may differ in their columns and their order. Files larger than
    a split (`spark.sql.files.maxPartitionBytes`) are read by many tasks, also when quoted cells hold line breaks;
    pass `multi_line=False` when no cell does, which saves the pass that finds where records end.
    """
    parts = [_first_of_repeated_headers(part) for part in _layout_frames(spark, path, multi_line)]
    raw = parts[0]
    for part in parts[1:]:
        raw = raw.unionByName(part, allowMissingColumns=True)
    raw = raw.select(
        [
            F.when(~_name(c).isin(NA_STRINGS), _name(c)).alias(c)
            for c in raw.columns
        ]
    )
    return normalize_tickets(raw, id_column)


def _layout_frames(spark: SparkSession, path: str, multi_line: bool) -> list[DataFrame]:
    """One frame for each header row that the files under `path` have.

    A reader takes the columns of all its files by the position of the first header, so files of
    another layout or column order are read apart. Scans of whole files are shared among the cores; files read by
    splits are so already, and counting their partitions would run the shuffle of their pieces.
    """
    reader = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("multiLine", multi_line)
        .option("escape", '"')
    )
    # Only the list of files is read: their contents are not asked for.
    files = spark.read.format("binaryFile").load(path).select("length")
    known = files.agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("largest")).first()
    split = _bytes(spark, "spark.sql.files.maxPartitionBytes")
    large = multi_line and (known["largest"] or 0) > split
    if not large and known["n"] < 2:
        return [spread(reader.csv(path))]
    found = layouts(spark, path)
    if large:
        return [read_split_csv(spark, layout) for layout in found]
    if len(found) < 2:
        return [spread(reader.csv(path))]
    return [spread(reader.csv(layout.files)) for layout in found]


def _bytes(spark: SparkSession, name: str) -> int:
    return spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))


def _first_of_repeated_headers(raw: DataFrame) -> DataFrame:
    """Spark numbers repeated headers by position (`Tipo3`, `Tipo7`); keep the first as `Tipo`."""
    known = REQUIRED_COLUMNS + OPTIONAL_COLUMNS + list(COLUMN_ALIASES) + ["Resolved"]
    renames = {}
    for wanted in known:
        if wanted not in raw.columns:
            numbered = [
                c
                for position, c in enumerate(raw.columns)
                if c == f"{wanted}{position}"
            ]
            if numbered:
                renames[numbered[0]] = wanted
    return raw.withColumnsRenamed(renames)


def apply_aliases(df: DataFrame) -> DataFrame:
    """Rename the columns of the second layout; a standard column wins where it has a value."""
    for alias, standard in COLUMN_ALIASES.items():
        if alias not in df.columns:
            continue
        if standard in df.columns:
            df = df.withColumn(
                standard, F.coalesce(_name(standard), _name(alias))
            ).drop(_name(alias))
        else:
            df = df.withColumnRenamed(alias, standard)
    return df


def ensure_columns(df: DataFrame) -> DataFrame:
    """Add absent required and optional columns as empty text."""
    absent = [c for c in REQUIRED_COLUMNS + OPTIONAL_COLUMNS if c not in df.columns]
    return df.withColumns({c: F.lit("") for c in absent})


def merge_text_dates(df: DataFrame, first: str, second: str) -> Column:
    """First non-blank of two text columns, trimmed; an absent column counts as blank."""
    present = [c for c in (first, second) if c in df.columns]
    return F.coalesce(
        F.lit(None).cast("string"),
        *[F.nullif(strip_whitespace(_name(c)), F.lit("")) for c in present],
    )


def with_ticket_id(df: DataFrame, id_column: str | None = None) -> DataFrame:
    """Add `ticket_id`, stable under any partitioning and different for every row.

    With a key column the id is its value. Rows whose key is null or blank are named by their
    content, rows that share a key by the key and their content.
    Content names are the digest of all cells and a copy number. Keys (or digests) are counted at once, combined in
    tasks; a table without repeats gets its ids in the scan that reads it, with nothing shuffled.
    Otherwise the repeated keys and the copies are looked up in that scan.
    """
    if "ticket_id" in df.columns:
        given = free_name("given_id", df)
        id_column = given if id_column == "ticket_id" else id_column
        renamed = df.withColumnRenamed("ticket_id", given)
        return with_ticket_id(renamed, id_column).drop(given)
    cells = [_name(c) for c in df.columns]
    key, again, digest = (free_name(name, df) for name in ("key", "again", "digest"))
    content = F.md5(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}))
    if id_column is None:
        rows = df.withColumn(digest, content)
        return _copies_numbered(rows, rows, cells, digest, F.col(digest), None)
    blank_as_null = F.nullif(strip_whitespace(_name(id_column).cast("string")), F.lit(""))
    keyed = df.withColumn(key, F.coalesce(blank_as_null, F.lit("")))
    counted = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    suspects = reliable_checkpoint(counted.where((F.col("n") > 1) | (F.col(key) == "")).select(key))
    found = suspects.count()
    if found == 0:
        return df.withColumn("ticket_id", _name(id_column))
    # A blank key is told by itself; only repeated keys are looked up.
    repeated = suspects.where(F.col(key) != "").withColumn(again, F.lit(True))
    small = found <= BROADCAST_KEYS
    marked = keyed.join(F.broadcast(repeated) if small else repeated, key, "left")
    marked = marked.withColumn(again, F.col(again).isNotNull() | (F.col(key) == ""))
    rows = marked.withColumn(digest, F.when(F.col(again), content))
    name = F.concat_ws("-", F.nullif(F.col(key), F.lit("")), digest)
    plain = F.when(~F.col(again), _name(id_column).cast("string"))
    return _copies_numbered(rows, rows.where(again), cells, digest, name, plain)


def _copies_numbered(
    rows: DataFrame, doubtful: DataFrame, cells: list[Column], digest: str, name: Column, plain: Column | None
) -> DataFrame:
    """`cells` of `rows` with `ticket_id`: `plain` where that is given, else `name` and the copy's number.

    Among the `doubtful` rows, digests are counted. Rows with copies are counted whole and then written out
    again; groups of very many copies are first cut into bounded runs spread over tasks, so a group of any
    size never sits in one task.
    """
    number = lambda copy: F.concat_ws("-", name, copy)
    counted = doubtful.groupBy(digest).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(digest)
    repeated = reliable_checkpoint(counted)
    found = repeated.count()
    single = number(F.lit("0"))
    own = (single if plain is None else F.coalesce(plain, single)).alias("ticket_id")
    if found == 0:
        return rows.select(*cells, own)
    repeated = F.broadcast(repeated) if found <= BROADCAST_KEYS else repeated
    kept = [c for c in rows.columns]
    copies = free_name("copies", rows)
    several = doubtful.join(repeated, digest, "left_semi").groupBy(*[_name(c) for c in kept])
    several = reliable_checkpoint(several.agg(F.count(F.lit(1)).alias(copies)))
    n, copy, run = F.col(copies), free_name("copy", rows), free_name("run", rows)
    few = several.where(n <= COPIES_PER_TASK).withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    runs = F.sequence(F.lit(0).cast("long"), ((n - 1) / COPIES_PER_TASK).cast("long"))
    first = F.col(run) * COPIES_PER_TASK
    last = F.least(n, first + COPIES_PER_TASK) - 1
    many = (
        several.where(n > COPIES_PER_TASK)
        .withColumn(run, F.explode(runs))
        .repartition(digest, run)
        .withColumn(copy, F.explode(F.sequence(first, last)))
        .drop(run)
    )
    copied = few.unionByName(many).select(*cells, number(F.col(copy).cast("string")).alias("ticket_id"))
    return rows.join(repeated, digest, "left_anti").select(*cells, own).unionByName(copied)


def normalize_tickets(df: DataFrame, id_column: str | None = None) -> DataFrame:
    """Any ticket frame to the fixed schema: aliases, defaults, dates, date parts.

    Rows whose creation date does not parse are dropped.
    """
    df = df.select(
        [
            _name(f.name)
            if isinstance(f.dataType, T.StringType)
            else _name(f.name).cast("string").alias(f.name)
            for f in df.schema
        ]
    )
    if id_column is not None or "ticket_id" not in df.columns:
        df = with_ticket_id(df, id_column)
    df = ensure_columns(apply_aliases(df))
    df = df.withColumns(
        {
            "Created_dt": parse_ticket_ts(F.col("Created")),
            "Resolution_dt": parse_ticket_ts(
                merge_text_dates(df, "Resolved", "Resolution")
            ),
            "Last_Updated_dt": parse_ticket_ts(
                merge_text_dates(df, "Last Updated", "Updated")
            ),
        }
    ).dropna(subset=["Created_dt"])
    return with_date_parts(df)
