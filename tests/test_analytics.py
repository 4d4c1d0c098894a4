from __future__ import annotations

import json
import math
import random

import pytest
from log_samples import SAMPLE_LOG
from pyspark.sql import functions as F

from querylens.operators import timing, workload
from querylens.operators.events import typed_events
from querylens.operators.percentiles import value_profile
from querylens.plans import documents
from querylens.plans.investigate import executions_of


def rank(values, p):
    values = sorted(values)
    return values[min(int(len(values) * p), len(values) - 1)]


def test_profile_of_random_groups(spark):
    rng = random.Random(4)
    rows = []
    for group, size in [("a", 1), ("b", 7), ("c", 500), ("d", 2000)]:
        rows += [(group, round(rng.expovariate(0.01), 3), rng.randint(0, 1)) for _ in range(size)]
    rows += [("d", 5.0, 1)] * 700 + [("d", None, 1)] * 3 + [("e", None, 0)] * 2
    rows += [("f", v, 0) for v in (-5.0, 0.0, -0.25, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double, flag bigint")
    points = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r.g: r for r in value_profile(df, ["g"], "v", points, ["flag"]).collect()}
    assert set(got) == set("abcdef")
    for group, row in got.items():
        mine = [r for r in rows if r[0] == group]
        values = [r[1] for r in mine if r[1] is not None]
        assert (row.row_count, row.value_count) == (len(mine), len(values))
        assert row.flag == sum(r[2] for r in mine)
        if not values:
            assert row.p95 is None
            continue
        assert math.isclose(row.value_total, sum(values), rel_tol=1e-9)
        assert (row.value_min, row.value_max) == (min(values), max(values))
        for name, p in points.items():
            assert row[name] == rank(values, p), (group, name)


def test_percentile_list(spark):
    # Seven values in no order; ranks floor(7 * p): 0, 2, 4 and the last.
    df = spark.createDataFrame([(v,) for v in (9.5, -1.0, 4.0, 4.0, 30.25, 7.0, 2.5)], "v double")
    rows = timing.percentiles(df, "v", [0.1, 0.3, 0.6, 1.0]).collect()
    assert [tuple(r) for r in rows] == [(0.1, -1.0), (0.3, 4.0), (0.6, 7.0), (1.0, 30.25)]
    with pytest.raises(ValueError, match="Invalid percentile"):
        timing.percentiles(df, "v", [1.5])
    with pytest.raises(Exception, match="No response times"):
        timing.percentiles(df.where("v < -5"), "v", [0.5]).collect()


def test_metrics(spark):
    values = [3.5] * 18 + [0.25, 81.0, 640.5, 7.0, 7.0, 12.0]  # 24 values; ranks 22 and 23
    df = spark.createDataFrame([(v,) for v in values], "duration_ms double")
    row = workload.duration_metrics(df).first()
    assert tuple(row) == (0.25, 640.5, 810.75 / 24, 81.0, 640.5, 24, 810.75)
    empty = workload.duration_metrics(df.where("duration_ms < 0")).first()
    assert tuple(empty) == (0.0, 0.0, 0.0, 0.0, 0.0, 0, 0.0)


def test_sample_log_report(parse):
    entries = parse(SAMPLE_LOG)
    events = typed_events(entries)
    executions = executions_of(entries)
    document = documents.workload_document(
        executions, events, entries.agg(F.count(F.lit(1))), temporal=True
    )
    report = json.loads(document.first()[0])
    assert report["metadata"]["total_log_entries"] == 9
    assert report["summary"] == {
        "total_queries": 4, "total_duration_ms": 71.0, "avg_duration_ms": 17.75,
        "error_count": 1, "connection_count": 0}
    analysis = report["query_analysis"]
    assert analysis["by_type"] == {"SELECT": 3, "UPDATE": 1}
    assert analysis["slowest_queries"] == []
    assert analysis["most_frequent"][0] == {
        "query": "SELECT title, price FROM books WHERE isbn = ?", "count": 2, "avg_duration_ms": 17.75}
    assert report["temporal_analysis"] == {
        "hourly_stats": [{"hour": 7, "total_duration_ms": 71.0}],
        "average_response_time_ms": 17, "p95_response_time_ms": 24, "p99_response_time_ms": 24}
    assert workload.error_rate(events).first()[0] == pytest.approx(1 / 9)


def test_slowest_joins_its_frequency(parse):
    lines = [
        f"2024-01-15 10:00:0{i}.000 UTC [1] a@d p: LOG:  duration: {ms} ms  statement: {sql}"
        for i, (ms, sql) in enumerate(
            [(1500, "SELECT 1"), (1000, "SELECT 2"), (3000, "BEGIN; SELECT 3"), (1500, "SELECT 4")]
        )
    ]
    entries = parse(lines)
    executions = executions_of(entries)
    slow = workload.slowest_queries(executions).collect()
    assert [(r.query, r.duration_ms, r.record_index) for r in slow] == [
        ("BEGIN;SELECT ?", 3000.0, 2), ("SELECT ?", 1500.0, 0), ("SELECT ?", 1500.0, 3)]
    parts = documents.workload_parts(executions, typed_events(entries))
    assert {(r.query, r.query_count) for r in parts["slowest"].collect()} == {
        ("BEGIN;SELECT ?", 1), ("SELECT ?", 4)}


def test_nothing_to_summarise(parse):
    entries = parse(["no log line"])
    row = workload.workload_summary(executions_of(entries)).first()
    assert tuple(row) == (0, 0.0, 0.0, 0.0, 0.0)
    assert timing.timing_summary(typed_events(entries)).first().total_queries == 0
    assert workload.error_rate(typed_events(entries)).first()[0] == 0.0


ENTRIES = [
    "2024-01-15 10:00:00.000 UTC [1] a@d p: LOG:  duration: 100 ms  statement: SELECT 1",
    "2024-01-15 10:00:10.000 UTC [1] a@d p: LOG:  duration: 300 ms  statement: SELECT 'connection'",
    "2024-01-15 10:00:20.900 UTC [1] a@d p: LOG:  statement: SELECT 3",
    "2024-01-16 11:00:00.000 UTC [1] a@d p: LOG:  duration: 50.9 ms",
    "2024-01-16 11:30:00.000 UTC [1] a@d p: ERROR:  Connection lost",
    "2024-01-21 11:31:00.000 UTC [1] a@d p: FATAL:  connection refused",
    "2024-01-21 12:31:00.000 UTC [1] a@d p: LOG:  duration: 1 ms  bind connection_1: SELECT 1",
]


def test_timing_views(parse):
    entries = parse(ENTRIES)
    events = typed_events(entries)
    hours = {r.hour: r.total_duration_ms for r in timing.hourly_duration(events).collect()}
    assert hours == {10: 400.0, 11: 50.9, 12: 1.0}
    days = {r.weekday: r.total_duration_ms for r in timing.weekday_duration(events).collect()}
    assert days == {0: 400.0, 1: 50.9, 6: 1.0}
    links = {r.hour: r.connection_count for r in timing.hourly_connections(events).collect()}
    assert links == {10: 1, 11: 2}
    assert [r.hour for r in timing.peak_hours(events).collect()] == [10]
    summary = timing.timing_summary(events).first()
    assert tuple(summary)[:4] == (112, 300, 300, 4)


def test_connection_views(parse):
    views = {
        (r.scope, r.bucket): (r.connection_count, r.error_count)
        for r in timing.connection_views(parse(ENTRIES)).collect()
    }
    assert views[("total", -1)] == (4, 1)
    assert views[("hour", 11)] == (2, 1) and views[("hour", 12)] == (1, 0)
    assert views[("weekday", 6)] == (2, 0)
    assert views[("total", -1)][1] / views[("total", -1)][0] == 0.25


def test_hourly_distribution_and_peak_usage(parse):
    entries = parse(ENTRIES)
    row = timing.hourly_distribution(entries).first()
    assert (row.hour, row.query_count, row.total_duration) == (10, 3, 400.0)
    assert (row.min_duration, row.max_duration) == (0.0, 300.0)
    assert row.queries_per_second == pytest.approx(3 / 20)
    peak = timing.peak_usage(entries).first()
    assert tuple(peak) == (10, 10, 3, 400.0, 3)


def test_error_and_connection_counts(parse):
    row = workload.error_connection_counts(typed_events(parse(ENTRIES))).first()
    assert tuple(row) == (1, 2)
    assert workload.slow_statement_entries(parse(ENTRIES), 100.0).count() == 1
