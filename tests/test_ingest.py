"""CSV exports of both layouts, defaults, ids, sinks."""

import csv
import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from ticketlens.functions import parse_ticket_ts
from ticketlens.operators.metrics import apply_filters
from ticketlens.plans.pipeline import prepare_frame, prepare_tickets, run_batch
from ticketlens.schema import NA_STRINGS, TICKET_SCHEMA
from ticketlens.session import spread
from ticketlens.sources import (
    normalize_tickets,
    read_tickets_csv,
    with_ticket_id,
    write_tickets,
)
from ticketlens.sources import records
from ticketlens.sources import tickets as ticket_source

LEGACY = ["Issue key", "Summary", "Reporter", "Status", "Tipo", "Resolution", "Created",
          "Description", "Last Updated", "Updated"]


def write_csv(path, header, records):
    with open(path, "w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file)
        writer.writerow(header)
        writer.writerows(records)
    return str(path)


@pytest.fixture
def legacy(tmp_path):
    return write_csv(
        tmp_path / "legacy.csv",
        LEGACY,
        [
            ["T-1", "Printer", "Ana", "Done", "Incident", "01/15/2024 19:03", "1/5/2024 9:03",
             'He said "no";\nthen, it stopped', "", "01/16/2024 10:00"],
            ["T-2", "NA", "null", "None", "N/A", "", "2024-01-05 10:00:01", "", "01/07/2024 08:00",
             "01/16/2024 10:00"],
            ["T-3", "no date", "x", "x", "x", "", "", "x", "", ""],
            ["T-4", "no date", "x", "x", "x", "", "nan", "x", "", ""],
            ["T-5", "no date", "x", "x", "x", "", "foo", "x", "", ""],
        ],
    )


def test_legacy_layout(spark, legacy):
    got = {r.ticket_id: r for r in read_tickets_csv(spark, legacy, "Issue key").collect()}
    assert set(got) == {"T-1", "T-2"}
    first, second = got["T-1"], got["T-2"]
    assert first.Description == 'He said "no";\nthen, it stopped'
    assert first.Created_dt == dt.datetime(2024, 1, 5, 9, 3)
    assert first.Resolution_dt == dt.datetime(2024, 1, 15, 19, 3)
    assert first.Last_Updated_dt == dt.datetime(2024, 1, 16, 10)
    assert (first.Date, first.ResolvedDate, first.DayOfWeek) == ("2024-01-05", "2024-01-15", "Fri")
    assert first["Issue Type"] == "" and first.Agencia == ""
    assert second.Created_dt == dt.datetime(2024, 1, 5, 10, 0, 1)
    assert (second.Summary, second.Reporter, second.Status, second.Tipo) == (None,) * 4
    assert second.Last_Updated_dt == dt.datetime(2024, 1, 7, 8)


def test_second_layout(spark, tmp_path):
    path = write_csv(
        tmp_path / "second.csv",
        ["Summary", "Created", "Resolved", "Resolution", "Last Viewed", "Updated",
         "Custom field (Agencia que reporta)", "Custom field (Tipo de solicitud)"],
        [
            ["a", "01/05/2024 09:00", " 01/06/2024 09:00 ", "01/09/2024 09:00", "  ",
             "01/08/2024 09:00", "North", "Incident"],
            ["b", "01/05/2024 09:00", "", "01/09/2024 09:00", "01/07/2024 09:00", "", "", ""],
        ],
    )
    got = {r.Summary: r for r in prepare_tickets(spark, path, now_ts="2024-02-01").collect()}
    assert got["a"].Resolution_dt == dt.datetime(2024, 1, 6, 9)
    assert got["a"].Last_Updated_dt == dt.datetime(2024, 1, 8, 9)
    assert (got["a"].Agencia, got["a"].Tipo) == ("North", "Incident")
    assert got["b"].Resolution_dt == dt.datetime(2024, 1, 9, 9)
    assert got["b"].Last_Updated_dt == dt.datetime(2024, 1, 7, 9)
    # An absent column is empty, a null cell takes the default.
    assert (got["b"].Agencia, got["b"].Reporter) == ("Unknown", "")


def test_enriched_schema(spark, legacy):
    got = {f.name: f.dataType for f in prepare_tickets(spark, legacy, "Issue key").schema}
    for field in TICKET_SCHEMA:
        assert got[field.name] == field.dataType, field.name


def test_missing_file(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_tickets_csv(spark, str(tmp_path / "nothing.csv"))


def test_na_strings_and_repeated_headers(spark, tmp_path):
    path = write_csv(
        tmp_path / "na.csv",
        ["Created", "Summary", "Tipo", "Comment", "Tipo", "Comment"],
        [["1/5/2024 9:03", na, f"t{i}", "x", "second", "y"] for i, na in enumerate(NA_STRINGS)],
    )
    got = read_tickets_csv(spark, path).collect()
    assert len(got) == len(NA_STRINGS)
    assert {r.Summary for r in got} == {None}
    assert {r.Tipo for r in got} == {f"t{i}" for i in range(len(NA_STRINGS))}


def test_alias_beside_standard_column(spark):
    raw = spark.createDataFrame(
        [("1/5/2024 9:03", None, "alias"), ("1/5/2024 9:03", "own", "alias")],
        "Created string, Agencia string, `Custom field (Agencia que reporta)` string",
    )
    assert {r.Agencia for r in normalize_tickets(raw).collect()} == {"alias", "own"}


def test_date_layouts(spark):
    cases = {
        "1/5/2024 9:03": dt.datetime(2024, 1, 5, 9, 3),
        "01/15/2024 19:03": dt.datetime(2024, 1, 15, 19, 3),
        "2024-01-05": dt.datetime(2024, 1, 5),
        "2024-01-05T10:00:01": dt.datetime(2024, 1, 5, 10, 0, 1),
        "2024-01-05 10:00": dt.datetime(2024, 1, 5, 10),
        "05/Jan/24 3:07 PM": dt.datetime(2024, 1, 5, 15, 7),
        "1/5/2024": dt.datetime(2024, 1, 5),
        "\t1/5/2024 9:03\n": dt.datetime(2024, 1, 5, 9, 3),
        "13/45/2024 9:03": None,
        "10:00": None,
        "": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "text string")
    got = df.select("text", parse_ticket_ts(F.col("text")).alias("ts")).collect()
    assert {r.text: r.ts for r in got} == cases


def test_ids_of_equal_rows(spark, monkeypatch):
    """Copies of one row are numbered, in runs, and numbering ignores the partitioning."""
    monkeypatch.setattr(ticket_source, "COPIES_PER_TASK", 7)
    records = [("a", None)] * 100 + [("b", "x")] * 7 + [("c", "y"), (None, "y")]
    raw = spark.createDataFrame(records, "Summary string, Tipo string")
    ids = with_ticket_id(raw).collect()
    assert len(ids) == len(records) == len({r.ticket_id for r in ids})
    assert sorted(((r.Summary, r.Tipo) for r in ids), key=repr) == sorted(records, key=repr)
    again = with_ticket_id(raw.repartition(11)).collect()
    assert {r.ticket_id for r in again} == {r.ticket_id for r in ids}


def test_by_month_prunes_partitions(spark, tmp_path):
    raw = spark.createDataFrame(
        [(f"{month}/5/2024 9:03",) for month in range(1, 13)], "Created string"
    )
    path = str(tmp_path / "by_month")
    write_tickets(prepare_frame(raw), path, by_month=True)
    assert "created_month=202403" in os.listdir(path)
    kept = apply_filters(spark.read.parquet(path), ("2024-03-01", "2024-04-30"))
    assert kept.count() == 2
    plan = kept._jdf.queryExecution().toString()
    assert "(created_month#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_spread(spark, tmp_path):
    few = spark.range(0, 10, 1, 1)
    cores = spark.sparkContext.defaultParallelism
    assert spread(few).rdd.getNumPartitions() == cores
    many = spark.range(0, 100, 1, cores + 1)
    assert spread(many) is many


def test_batch_job(spark, tmp_path):
    words = ["printer", "paper", "network", "cable", "password", "account"]
    path = write_csv(
        tmp_path / "batch.csv",
        ["Issue key", "Summary", "Created", "Description"],
        [
            [f"T-{i}", f"Summary {i}", "1/5/2024 9:03",
             f"please look at {words[i % 6]} {words[(i + 1) % 6]} again today"]
            for i in range(12)
        ],
    )
    out = str(tmp_path / "out")
    result = run_batch(spark, path, out, "Issue key", now_ts="2024-02-01")
    stored = spark.read.parquet(f"{out}/cleaned_tickets.parquet")
    assert stored.count() == 12
    themes = spark.read.option("header", True).csv(f"{out}/themes.csv")
    assert themes.columns == result.themes.columns
    assert themes.count() == result.themes.count() > 0


def test_more_date_layouts(spark):
    day = dt.datetime(2024, 1, 5)
    cases = {
        "1/5/2024 9:03:22": day.replace(hour=9, minute=3, second=22),
        "1/5/2024 9:03 PM": day.replace(hour=21, minute=3),
        "1/5/24 9:03": day.replace(hour=9, minute=3),
        "2024/01/05 10:00": day.replace(hour=10),
        "05-Jan-2024": day,
        "Jan 5, 2024": day,
        "Friday, January 5, 2024 3:04:05 pm": day.replace(hour=15, minute=4, second=5),
        "Fri, 05 Jan 2024 10:00:00 +0000": day.replace(hour=10),
        "Fri, 05 Jan 2024 10:00:00 +0530": day.replace(hour=4, minute=30),
        "20240105": day,
        "1234567890": None,
        "9:03": None,
        "Jan 45, 2024": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "text string")
    got = df.select("text", parse_ticket_ts(F.col("text")).alias("ts")).collect()
    assert {r.text: r.ts for r in got} == cases


def test_files_of_a_folder_in_different_column_order(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    write_csv(folder / "a.csv", ["Summary", "Status", "Created"], [["one", "Open", "1/5/2024 9:03"]])
    write_csv(folder / "b.csv", ["Status", "Created", "Summary"], [["Done", "1/6/2024 9:03", "two"]])
    write_csv(
        folder / "c.csv",
        ["Created", "Custom field (Tipo de solicitud)", "Summary"],
        [["1/7/2024 9:03", "Incident", "three\nlines, here"]],
    )
    got = {(r.Summary, r.Status, r.Tipo, r.Date) for r in read_tickets_csv(spark, str(folder)).collect()}
    assert got == {
        ("one", "Open", None, "2024-01-05"),
        ("two", "Done", None, "2024-01-06"),
        ("three\nlines, here", None, "Incident", "2024-01-07"),
    }


def test_repeated_null_and_blank_keys_stay_apart(spark):
    records = [("1", "a"), ("1", "b"), ("1", "b"), ("2", "c"), (None, "d"), ("", "e"), (" ", "e"), (None, "d")]
    raw = spark.createDataFrame(records, "key string, Summary string")
    ids = with_ticket_id(raw, "key").collect()
    assert sorted([(r.key, r.Summary) for r in ids], key=repr) == sorted(records, key=repr)
    assert len({r.ticket_id for r in ids}) == len(records)
    assert {r.ticket_id for r in ids if r.key == "2"} == {"2"}
    again = with_ticket_id(raw.repartition(7), "key").collect()
    assert {r.ticket_id for r in again} == {r.ticket_id for r in ids}


def test_filters_reach_the_reader_below_cleaning(spark, tmp_path):
    raw = spark.createDataFrame(
        [("1/5/2024 9:03", "en", "text"), ("1/6/2024 9:03", "de", "text"), ("1/6/2024 9:03", None, "text")],
        "Created string, Tipo string, Description string",
    )
    path = str(tmp_path / "raw")
    raw.withColumn("ticket_id", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    kept = prepare_frame(stored, now_ts="2024-02-01", filters={"tipos": ["en"]})
    assert [r.Tipo for r in kept.collect()] == ["en"]
    plan = kept._jdf.queryExecution().toString()
    assert "EqualTo(Tipo,en)" in plan or "In(Tipo, [en])" in plan
    unknown = prepare_frame(stored, now_ts="2024-02-01", filters={"tipos": ["Unknown"]})
    assert [r.Tipo for r in unknown.collect()] == ["Unknown"]


# --- records of large files ------------------------------------------------------


def random_csv(path, rng, rows, newline="\n"):
    """Cells with quotes, doubled quotes, line breaks and commas, quoted and bare, some lines empty."""
    cells = ["", "plain", "a b", '"quoted"', '"with ""two"" quotes"', '"line\nbreak"', '"comma, in"', 'inch 5" pipe',
             '""', '"\n\n"', '"ends in quote"""', '"""starts"', "ñandú", '"l\n""x""\n, y"']
    lines = ["key,Summary,Tipo"]
    for i in range(rows):
        lines.append(",".join([str(i), rng.choice(cells), rng.choice(cells)]))
        if rng.random() < 0.1:
            lines.append("")
    text = "\n".join(lines) + rng.choice(["", "\n"])
    with open(path, "w", encoding="utf-8", newline="") as file:
        file.write(text.replace("\n", newline))


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_split_files_equal_the_whole_file_reader(spark, tmp_path, newline):
    rng = random.Random(11)
    random_csv(tmp_path / "a.csv", rng, 300, newline)
    random_csv(tmp_path / "b.csv", rng, 40, newline)
    path = str(tmp_path)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    wanted = sorted(map(tuple, reader.csv(path).collect()), key=repr)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64b", "257b", "3000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            [layout] = records.layouts(spark, path)
            assert layout.carriage_returns == (newline == "\r\n")
            frame = records.read_split_csv(spark, layout)
            assert frame.columns == ["key", "Summary", "Tipo"]
            assert sorted(map(tuple, frame.collect()), key=repr) == wanted
            if size != "3000b":
                assert records._file_lines(spark, layout.files).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_large_export_is_read_by_many_tasks(spark, tmp_path):
    rows = [[f"T-{i}", f"line\n{i}, \"x\"", "1/5/2024 9:03"] for i in range(200)]
    path = write_csv(tmp_path / "large.csv", ["key", "Summary", "Created"], rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
        got = read_tickets_csv(spark, path, "key").select("ticket_id", "Summary").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got)) == sorted((r[0], r[1]) for r in rows)


def test_header_names_are_those_of_the_reader(spark, tmp_path):
    header = ["Tipo", "a b", "", "tipo", "x", 'q"q', "x"]
    path = write_csv(tmp_path / "h.csv", header, [["1"] * 7])
    with open(path, encoding="utf-8") as file:
        first = file.readline().rstrip("\n")
    assert records.header_names(first) == spark.read.option("header", True).option("escape", '"').csv(path).columns


def test_headers_are_found_without_reading_on(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(12):
        columns = ["Summary", "Created", "key"][:: 1 if i % 3 else -1]
        write_csv(folder / f"{i}.csv", columns, [[str(n)] * 3 for n in range(20_000)])
    (folder / "empty.csv").write_text("")
    settings = [spark.conf.get(f"spark.sql.{n}") for n in ("files.maxPartitionBytes", "execution.arrow.maxRecordsPerBatch")]
    found = records.layouts(spark, str(folder))
    assert settings == [spark.conf.get(f"spark.sql.{n}") for n in ("files.maxPartitionBytes", "execution.arrow.maxRecordsPerBatch")]
    assert [(x.header, len(x.files)) for x in found] == [("Summary,Created,key", 8), ("key,Created,Summary", 4)]


def test_headers_are_found_without_python_tasks(spark, tmp_path, monkeypatch):
    """Also where a file has many splits: only its first one holds the header."""
    folder = tmp_path / "few"
    folder.mkdir()
    for i in range(3):
        write_csv(folder / f"{i}.csv", ["key", "Summary"] if i else ["Summary", "key"], [[str(n)] * 2 for n in range(200)])
    (folder / "marked.csv").write_bytes(b"\xef\xbb\xbfkey,Summary\n1,2\n")
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", None)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64b", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = records.layouts(spark, str(folder))
            assert [(x.header, x.carriage_returns, len(x.files)) for x in found] == [
                ("Summary,key", True, 1), ("key,Summary", False, 1), ("key,Summary", True, 2)
            ]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_split_files_are_shuffled_once(spark, tmp_path, monkeypatch):
    """The pieces at the ends of blocks meet once, not each time that the records are read."""
    rows = [[f"T-{i}", f"line\n{i}, \"x\"", "1/5/2024 9:03"] for i in range(200)]
    path = write_csv(tmp_path / "large.csv", ["key", "Summary", "Created"], rows)
    monkeypatch.setattr(ticket_source, "spread", None)  # it would count partitions, which runs the shuffle
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
        tickets = read_tickets_csv(spark, path, "key")
        assert scans_and_exchanges(tickets) == (1, 0)
        assert tickets.count() == 200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def scans_and_exchanges(df):
    executed = df._jdf.queryExecution().executedPlan().toString()
    return executed.count("FileScan"), executed.count("Exchange hashpartitioning")


def test_plan_reads_an_export_once(spark, tmp_path):
    """Distinct keys: one scan, nothing shuffled. Repeated keys: lookups in that one scan."""
    rows = [[f"T-{i}", "text", "1/5/2024 9:03"] for i in range(50)]
    path = write_csv(tmp_path / "once.csv", ["key", "Summary", "Created"], rows)
    assert scans_and_exchanges(read_tickets_csv(spark, path, "key")) == (1, 0)
    again = write_csv(tmp_path / "again.csv", ["key", "Summary", "Created"], rows + rows[:3] + [["T-9", "b", "1/5/2024 9:03"]])
    repeated = read_tickets_csv(spark, again, "key")
    scans, exchanges = scans_and_exchanges(repeated)
    assert scans <= 2 and exchanges <= 3
    ids = [r.ticket_id for r in repeated.collect()]
    assert len(ids) == len(set(ids)) == 54 and {f"T-{i}" for i in range(3, 50) if i != 9} <= set(ids)


@pytest.mark.parametrize("held", [1 << 18, 0])
def test_ids_with_and_without_broadcast(spark, monkeypatch, held):
    monkeypatch.setattr(ticket_source, "BROADCAST_KEYS", held)
    records = [(str(i), "x") for i in range(20)] + [("5", "x"), ("5", "y"), (None, "z"), (" ", "z"), ("", "z"), (" 7 ", "w")]
    raw = spark.createDataFrame([(*r, "c") for r in records], "key string, Summary string, again string")
    ids = with_ticket_id(raw, "key").collect()
    assert sorted([(r.key, r.Summary) for r in ids], key=repr) == sorted(records, key=repr)
    assert len({r.ticket_id for r in ids}) == len(records)
    assert {r.ticket_id for r in ids if r.key == "3"} == {"3"}
    assert {r.ticket_id for r in with_ticket_id(raw.repartition(5), "key").collect()} == {r.ticket_id for r in ids}
    bare = with_ticket_id(raw).collect()
    assert len({r.ticket_id for r in bare}) == len(records)
