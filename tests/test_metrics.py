"""Metric operators on the edge rows of a ticket table."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_DIR
from ticketlens.functions import BUCKET_LABELS, aging_bucket
from ticketlens.operators import metrics as m
from ticketlens.plans.report import (
    merge_states,
    open_months,
    report_from_states,
    report_states,
    report_tables,
    write_report,
    write_report_states,
)
from ticketlens.sources import sample_tables
from ticketlens.sources.sample_tables import order_tickets

NOW = dt.datetime(2024, 1, 31, 12)
DAY = dt.timedelta(days=1)
SCHEMA = """ticket_id long, Created_dt timestamp_ntz, Resolution_dt timestamp_ntz,
    Last_Updated_dt timestamp_ntz, Status string, Tipo string, Reporter string,
    Agencia string, Date string"""


def ticket(i, created, resolved=None, updated=None, status="Open", tipo="A", **more):
    return (
        i,
        created,
        resolved,
        updated,
        status,
        tipo,
        more.get("reporter", "R"),
        more.get("agencia", "N"),
        created.strftime("%Y-%m-%d"),
    )


@pytest.fixture
def frame(spark):
    return lambda tickets: spark.createDataFrame(tickets, SCHEMA)


@pytest.fixture
def timed(frame):
    return lambda tickets: m.add_time_metrics(frame(tickets), NOW)


def hours_before(hours):
    return NOW - dt.timedelta(hours=hours)


def test_effective_resolution(timed):
    day = dt.datetime(2024, 1, 5, 9)
    got = {
        r.ticket_id: r
        for r in timed(
            [
                ticket(1, day, resolved=day + DAY, status="Done", updated=day + 5 * DAY),
                ticket(2, day, status="Done", updated=day + 2 * DAY),
                ticket(3, day, status=" done ", updated=day + 2 * DAY),
                ticket(4, day, status="Open", updated=day + 2 * DAY),
                ticket(5, day, resolved=day + DAY, status="Open"),
                ticket(6, day, resolved=day - DAY, status="Done"),
                ticket(7, NOW + DAY),
            ]
        ).collect()
    }
    assert got[1].resolution_time_hours == 24
    assert got[2].resolution_time_hours == 48 and got[2].ResolvedDate == "2024-01-07"
    assert got[3].resolution_time_hours == 48 and got[3].aging_hours is None
    assert got[4].resolution_effective_dt is None and got[4].touch_time_hours == 48
    assert got[5].resolution_time_hours == 24 and got[5].aging_hours is not None
    assert got[6].resolution_time_hours is None and got[6].ResolvedDate == "2024-01-04"
    assert got[7].aging_hours is None


def test_absent_columns(spark):
    bare = spark.createDataFrame([(NOW,)], "Created_dt timestamp_ntz")
    row = m.add_time_metrics(bare, NOW).first()
    assert row.aging_hours == 0 and row.resolution_time_hours is None
    assert m.count_by_column(bare, "Tipo").columns == ["Tipo", "count"]
    assert m.count_by_column(bare, "Tipo").count() == 0


def test_buckets(spark):
    edges = [0, 23.9, 24, 48, 72, 168, 1e6, -1.0, None]
    df = spark.createDataFrame([(x if x is None else float(x),) for x in edges], "h double")
    got = [r[0] for r in df.select(aging_bucket(F.col("h"))).collect()]
    assert got == ["0-24h", "0-24h"] + BUCKET_LABELS[1:] + ["7d+", None, None]


def test_open_and_pending_buckets(timed, rows):
    statuses = ["PENDIENTE CLIENTE", "PENDEINTE CLIENTE", "Pendiente", " done ", "Done"]
    tickets = timed(
        [ticket(i, hours_before(24 * i), status=s) for i, s in enumerate(statuses)]
    )
    assert rows(m.aging_buckets_open_tickets(tickets)) == [
        ("0-24h", 1),
        ("24-48h", 1),
        ("48-72h", 1),
        ("72h-7d", 0),
        ("7d+", 0),
    ]
    assert [r[1] for r in rows(m.client_pending_aging_buckets(tickets))] == [1, 1, 0, 0, 0]
    literal = m.client_pending_aging(tickets, pattern="pende.*cliente")
    assert rows(literal) == [(24.0, "24-48h")]
    none = tickets.where("Status = 'Done'")
    assert m.aging_buckets_open_tickets(none).count() == 0
    assert m.client_pending_aging_buckets(none).count() == 0


def test_kpis(frame, rows):
    day = dt.datetime(2024, 1, 5)
    tickets = frame(
        [
            ticket(1, day, status="Done", tipo="B"),
            ticket(2, day, status=" done ", tipo="A"),
            ticket(3, day + DAY, status=None, tipo="A", agencia="Z"),
            ticket(4, day + 9 * DAY, tipo="B", agencia="Y"),
        ]
    )
    assert rows(m.kpis(tickets)) == [(4, 3, 25.0, 1.33, "A", "N")]
    assert rows(m.kpis(tickets.limit(0))) == [(0, 0, 0.0, 0.0, "N/A", "N/A")]
    assert m.kpis(tickets.drop("Agencia")).first().top_agencia == "N/A"


def test_sla(timed, rows):
    day = dt.datetime(2024, 1, 1)
    spans = [47.0, 48.0, 48.001]
    tickets = timed(
        [ticket(i, day, resolved=day + dt.timedelta(hours=h)) for i, h in enumerate(spans)]
    )
    assert rows(m.sla_compliance(tickets)) == [(66.67, 3, 2)]
    assert rows(m.sla_compliance(tickets, 1)) == [(0.0, 3, 0)]
    assert rows(m.sla_compliance(tickets.limit(0))) == [(0.0, 0, 0)]


def test_rolling_mean_counts_rows_not_days(frame):
    start = dt.datetime(2024, 1, 1)
    days = [0, 1, 2, 3, 10, 11, 12, 13, 30]
    tickets = [
        ticket(d * 100 + i, start + d * DAY) for n, d in enumerate(days) for i in range(n + 1)
    ]
    got = m.tickets_per_day(frame(tickets)).collect()
    counts = [r.tickets for r in got]
    assert counts == list(range(1, 10))
    for i, r in enumerate(got):
        last = counts[max(0, i - 6) : i + 1]
        assert r.rolling_7d == pytest.approx(sum(last) / len(last))


def test_date_range_ends(frame, rows):
    times = [
        dt.datetime(2024, 1, 4, 23, 59, 59),
        dt.datetime(2024, 1, 5),
        dt.datetime(2024, 1, 6, 23, 59, 59),
        dt.datetime(2024, 1, 6, 23, 59, 59, 500_000),
    ]
    tickets = frame([ticket(i, t) for i, t in enumerate(times)])
    window = (dt.date(2024, 1, 5), dt.date(2024, 1, 6))
    kept = m.apply_filters(tickets, window).select("ticket_id")
    assert rows(kept) == [(1,), (2,)]


def test_filters(frame):
    day = dt.datetime(2024, 1, 5)
    tickets = frame(
        [
            ticket(1, day, status="Done", tipo="A"),
            ticket(2, day, status="Open", tipo="A"),
            ticket(3, day, status="Open", tipo="B"),
        ]
    )

    def ids(**filters):
        return {r.ticket_id for r in m.apply_filters(tickets, **filters).collect()}

    assert ids() == ids(statuses=[]) == ids(tipos=None) == {1, 2, 3}
    assert ids(statuses=["Open"], tipos=["A"]) == {2}
    assert ids(reporters=["nobody"]) == set()


def test_count_order_and_top(frame, rows):
    day = dt.datetime(2024, 1, 5)
    tipos = ["B", "B", "A", "A", None, "C"]
    tickets = frame([ticket(i, day, tipo=t) for i, t in enumerate(tipos)])
    everything = [("A", 2), ("B", 2), ("C", 1), ("Unknown", 1)]
    assert rows(m.count_by_column(tickets, "Tipo")) == everything
    assert rows(m.count_by_column(tickets, "Tipo", 3)) == everything[:3]
    assert rows(m.facet_values(tickets, "Tipo")) == [("A",), ("B",), ("C",)]


def test_created_vs_resolved_counts_negative_spans(timed, rows):
    day = dt.datetime(2024, 1, 5)
    tickets = timed(
        [
            ticket(1, day, resolved=day - 2 * DAY),
            ticket(2, day, resolved=day + DAY),
            ticket(3, day),
        ]
    )
    assert rows(m.created_vs_resolved_per_day(tickets)) == [
        (dt.date(2024, 1, 3), 0, 1),
        (dt.date(2024, 1, 5), 3, 0),
        (dt.date(2024, 1, 6), 0, 1),
    ]


def test_histogram(timed, rows):
    day = dt.datetime(2024, 1, 1)

    def resolved(hours):
        return timed(
            [ticket(i, day, resolved=day + dt.timedelta(hours=h)) for i, h in enumerate(hours)]
        )

    got = rows(m.resolution_time_histogram(resolved([0, 1, 5, 9.5, 10]), bins=5))
    assert [r[3] for r in got] == [2, 0, 1, 0, 2]
    assert got[0][1] == 0 and got[-1][2] == 10
    same = rows(m.resolution_time_histogram(resolved([4, 4]), bins=3))
    assert [r[3] for r in same] == [2, 0, 0]
    assert m.resolution_time_histogram(resolved([]), bins=3).count() == 0


def test_report_equals_single_operators(timed, rows, tmp_path, spark):
    start = dt.datetime(2023, 12, 1)
    statuses = ["Done", "PENDIENTE CLIENTE", "Open", None]
    tickets = timed(
        [
            ticket(
                i,
                start + dt.timedelta(hours=7 * i),
                resolved=start + dt.timedelta(hours=11 * i - 40) if i % 3 == 0 else None,
                updated=start + dt.timedelta(hours=9 * i),
                status=statuses[i % 4],
                tipo=[None, "A", "B"][i % 3],
                reporter=f"R{i % 23}",
                agencia=f"N{i % 31}",
            )
            for i in range(200)
        ]
    )
    single = {
        "kpis": m.kpis(tickets),
        "sla_compliance": m.sla_compliance(tickets, 24),
        "tickets_per_day": m.tickets_per_day(tickets),
        "count_by_tipo": m.count_by_column(tickets, "Tipo"),
        "count_by_reporter": m.count_by_column(tickets, "Reporter", 15),
        "count_by_status": m.count_by_column(tickets, "Status"),
        "count_by_agencia": m.count_by_column(tickets, "Agencia", 20),
        "resolution_time_by_tipo": m.resolution_time_by_tipo(tickets),
        "client_pending_aging_buckets": m.client_pending_aging_buckets(tickets),
        "avg_resolution_time_over_time": m.avg_resolution_time_over_time(tickets),
        "resolution_time_histogram": m.resolution_time_histogram(tickets),
        "aging_buckets_open_tickets": m.aging_buckets_open_tickets(tickets),
        "created_vs_resolved_per_day": m.created_vs_resolved_per_day(tickets),
    }
    together = report_tables(tickets, 24)
    assert set(together) == set(single)
    for name, table in single.items():
        assert together[name].columns == table.columns, name
        assert rows(together[name]) == rows(table), name

    write_report(tickets, str(tmp_path / "report"), 24)
    for name, table in single.items():
        stored = spark.read.parquet(str(tmp_path / "report" / name))
        assert sorted(rows(stored), key=repr) == sorted(rows(table), key=repr), name


def test_stored_months_give_the_report_of_the_whole_table(timed, rows, tmp_path, spark):
    start = dt.datetime(2023, 11, 20)
    every = [
        ticket(
            i,
            start + dt.timedelta(hours=9 * i),
            resolved=start + dt.timedelta(hours=12 * i) if i % 3 else None,
            status=["Done", "PENDIENTE CLIENTE", "Open"][i % 3 if i > 60 else 0],
            tipo=[None, "A", "B"][i % 3],
            reporter=f"R{i % 23}",
            agencia=f"N{i % 31}",
        )
        for i in range(300)
    ]
    tickets, path = timed(every), str(tmp_path / "states")
    month = F.date_format("Created_dt", "yyyyMM").cast("int")
    # First with a late month that lacks tickets, then that month alone.
    write_report_states(tickets.where((month < 202402) | (F.col("Tipo") == "A")), path, 24)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "states").rglob("*=202312/*.parquet")}
    write_report_states(tickets.where(month >= 202402), path, 24)
    assert before and all(f.stat().st_mtime_ns == time for f, time in before.items())
    states = spark.read.parquet(path)

    whole, merged = report_tables(tickets, 24), report_from_states(states)
    assert set(merged) ^ set(whole) == {"resolution_time_histogram", "resolution_time_bins"}
    for name in set(merged) & set(whole):
        assert merged[name].columns == whole[name].columns
        for got, want in zip(rows(merged[name]), rows(whole[name]), strict=True):
            numbers = [pytest.approx(v, rel=1e-12) if isinstance(v, float) else v for v in want]
            assert list(got) == numbers, name
    bins = rows(merged["resolution_time_bins"])
    assert bins == rows(m.resolution_time_bins(tickets))
    assert len(bins) == len(m.HOUR_EDGES) + 1 and bins[-1][2] is None
    hours = [r[0] for r in rows(tickets.select("resolution_time_hours")) if r[0] is not None]
    for _, least, until, count in bins:
        assert count == sum(least <= h and (until is None or h < until) for h in hours)

    known = {r.created_month for r in open_months(states).collect()}
    assert known == {r[0] for r in tickets.where("Status <> 'Done'").select(month).distinct().collect()}
    assert 202311 not in known

    write_report_states(tickets.where(month == 202312), path, 48)
    with pytest.raises(Exception, match="more than one SLA threshold"):
        merge_states(spark.read.parquet(path)).collect()


def test_states_of_no_tickets(timed, rows):
    tables = report_from_states(report_states(timed([])))
    assert rows(tables["kpis"]) == [(0, 0, 0.0, 0.0, "N/A", "N/A")]
    assert rows(tables["sla_compliance"]) == [(0.0, 0, 0)]
    for name in set(tables) - {"kpis", "sla_compliance"}:
        assert tables[name].count() == 0, name


def test_report_of_no_tickets(timed, rows):
    tables = report_tables(timed([]))
    assert rows(tables["kpis"]) == [(0, 0, 0.0, 0.0, "N/A", "N/A")]
    assert rows(tables["sla_compliance"]) == [(0.0, 0, 0)]
    for name in set(tables) - {"kpis", "sla_compliance"}:
        assert tables[name].count() == 0, name


def test_partitioning_changes_nothing(timed, rows):
    start = dt.datetime(2024, 1, 1)
    tickets = timed([ticket(i, start + i * dt.timedelta(hours=5)) for i in range(60)])
    for operator in (m.tickets_per_day, m.kpis, m.aging_buckets_open_tickets):
        assert rows(operator(tickets)) == rows(operator(tickets.repartition(13)))


def test_date_range_reaches_the_reader(spark, frame, tmp_path):
    path = str(tmp_path / "tickets")
    frame([ticket(1, dt.datetime(2024, 1, 5))]).write.parquet(path)
    kept = m.apply_filters(spark.read.parquet(path), ("2024-01-01", "2024-02-01"))
    plan = kept.select("ticket_id")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(Created_dt" in plan
    assert "ReadSchema: struct<ticket_id:bigint,Created_dt:timestamp_ntz>" in plan


@pytest.fixture(scope="module")
def sample(spark):
    if not os.path.isdir(SMOKE_DIR):
        pytest.skip("no sample tables")
    tickets = order_tickets(spark, SMOKE_DIR, with_people=True)
    return m.add_time_metrics(tickets, sample_tables.NOW).cache()


def test_parts_add_up(sample):
    """Sums over any breakdown give the totals."""
    kpis, sla = m.kpis(sample).first(), m.sla_compliance(sample).first()
    total = sample.count()
    assert kpis.total_tickets == total
    assert 0 <= sla.within_sla_count <= sla.resolved_count <= total

    def sum_of(table, column):
        return table.agg(F.sum(column)).first()[0]

    for column in ("Status", "Tipo", "Reporter", "Agencia"):
        assert sum_of(m.count_by_column(sample, column), "count") == total
    assert sum_of(m.tickets_per_day(sample), "tickets") == total
    balance = m.created_vs_resolved_per_day(sample)
    assert sum_of(balance, "created") == total
    effective = sample.where("resolution_effective_dt is not null").count()
    assert sum_of(balance, "resolved") == effective
    assert sum_of(m.resolution_time_histogram(sample, 7), "count") == sla.resolved_count
    still_open = sample.where("Status <> 'Done' and aging_hours is not null").count()
    assert sum_of(m.aging_buckets_open_tickets(sample), "count") == still_open


def test_filters_commute(sample):
    window, statuses = ("1996-01-01", "1997-12-31"), ["Done", "In Progress"]
    one = m.apply_filters(m.apply_filters(sample, window), statuses=statuses)
    other = m.apply_filters(m.apply_filters(sample, statuses=statuses), window)
    both = m.apply_filters(sample, window, statuses)
    assert m.kpis(one).first() == m.kpis(other).first() == m.kpis(both).first()


def test_tables_without_the_derived_columns(spark, rows):
    """Empty tables or zeros of the usual schema, as for columns of nulls."""
    bare = spark.createDataFrame(
        [("2024-01-05", "Done", "a", "x"), ("2024-01-05", "Open", None, "y")],
        "Date string, Status string, Tipo string, Reporter string",
    )
    assert rows(m.sla_compliance(bare)) == [(0.0, 0, 0)]
    for operator in (
        m.avg_resolution_time_over_time,
        m.resolution_time_distribution,
        m.resolution_time_by_tipo,
        m.resolution_time_histogram,
        m.aging_buckets_open_tickets,
        m.client_pending_aging,
        m.client_pending_aging_buckets,
    ):
        found = operator(bare)
        assert found.columns and rows(found) == [], operator.__name__
    assert [r[1:] for r in rows(m.created_vs_resolved_per_day(bare))] == [(2, 0)]
    tables = report_tables(bare)
    assert rows(tables["count_by_agencia"]) == [("Unknown", 2)]
    assert rows(tables["sla_compliance"]) == [(0.0, 0, 0)]
