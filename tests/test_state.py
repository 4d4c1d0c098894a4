"""States that later logs are added to, against one pass over all logs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_correlate import line, rendered, stream

from querylens.operators import correlate, state, workload
from querylens.operators.correlate import correlate_by_process_order
from querylens.operators.diff import window_family_metrics
from querylens.operators.events import typed_events
from querylens.operators.families import family_totals
from querylens.operators.parse import parse_lines
from querylens.plans.investigate import executions_from_lines


def cut(lines, seed, parts):
    """Lines cut into ``parts`` logs, some of them maybe empty."""
    at = sorted(random.Random(seed).choices(range(len(lines) + 1), k=parts - 1))
    return [lines[a:b] for a, b in zip([0, *at], [*at, len(lines)])]


def plain(df, columns):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("seed, parts", [(1, 2), (2, 3), (3, 4)])
def test_sum_of_logs_equals_one_pass(parse, tmp_path, seed, parts):
    lines = rendered(stream(seed, 150))
    lines[7] = lines[7].split("LOG:")[0] + "ERROR:  connection lost"
    lines[20] = lines[20].split("LOG:")[0] + "LOG:  connection received"
    logs = cut(lines, seed, parts)
    sums = state.new_state(typed_events(parse(logs[0])), str(tmp_path / "0"))
    for i, log in enumerate(logs[1:], 1):
        sums = state.added(sums, typed_events(parse(log)), str(tmp_path / str(i)))
    events = typed_events(parse(lines))
    whole = correlate_by_process_order(events)
    totals = family_totals(whole)
    assert plain(state.state_totals(sums), totals.columns) == plain(totals, totals.columns)
    metrics = window_family_metrics(whole)
    assert plain(state.state_metrics(sums), metrics.columns) == plain(metrics, metrics.columns)
    summary = workload.workload_summary(whole)
    got = state.state_summary(sums)
    assert {r for r in plain(got, summary.columns)} == set(plain(summary, summary.columns))
    assert (got.first().error_count, got.first().connection_count) == tuple(workload.error_connection_counts(events).first())
    assert sums.seen.first().entries == len(lines)


def test_waiting_statement_is_closed_by_the_next_log(parse):
    first = state.new_state(typed_events(parse([line(0, 1, "statement: SELECT 1"), line(1, 2, "statement: SELECT 2")])))
    assert [r.record_index for r in first.waiting.orderBy("record_index").collect()] == [0, 1]
    assert first.counts.count() == 0
    assert state.state_totals(first).first().uncorrelated_execution_count == 2
    second = state.added(first, typed_events(parse([line(5, 2, "duration: 8 ms"), line(6, 2, "statement: SELECT 3")])))
    row = state.state_totals(second).first()
    assert (row.execution_count, row.correlated_execution_count, row.total_duration_ms) == (3, 1, 8.0)
    assert [(r.process_id, r.record_index, r.event_id) for r in second.waiting.orderBy("process_id").collect()] == [
        ("1", 0, "stderr:0"), ("2", 3, "stderr:3")]


def test_counts_stay_small(parse):
    """As many rows as there are families, classes and durations, however many executions."""
    lines = [line(i, i % 5, f"duration: {i % 3} ms  statement: SELECT {i}") for i in range(300)]
    sums = state.new_state(typed_events(parse(lines)))
    assert sums.counts.count() == 3 and sums.counts.agg(F.sum("n")).first()[0] == 300


def test_state_is_read_back(spark, parse, tmp_path):
    path = str(tmp_path / "s")
    state.new_state(typed_events(parse([line(0, 1, "duration: 2 ms  statement: SELECT 1")])), path)
    assert state.state_summary(state.read_state(spark, path)).first().total_queries == 1
    plan = state.state_totals(state.read_state(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan and "Python" not in plan


def counted_lines(spark, lines):
    """The lines as a frame, and the number of times any of them is read."""
    reads = spark.sparkContext.accumulator(0)

    def seen(row):
        reads.add(1)
        return row

    rows = spark.sparkContext.parallelize([("target", i, text) for i, text in enumerate(lines)], 2).map(seen)
    return spark.createDataFrame(rows, "source_window string, record_index bigint, value string"), reads


def test_each_log_is_parsed_once(spark):
    lines = rendered(stream(9, 60))
    first, first_reads = counted_lines(spark, lines[:40])
    second, second_reads = counted_lines(spark, lines[40:])
    sums = state.added(state.new_state(typed_events(parse_lines(first))), typed_events(parse_lines(second)))
    assert sums.seen.first().entries == len(lines)
    assert (first_reads.value, second_reads.value) == (40, len(lines) - 40)


def test_search_for_hot_backends_does_not_parse_again(spark):
    lines = rendered(stream(10, 60))
    frame, reads = counted_lines(spark, lines)
    found = executions_from_lines(frame, hot_rows=50, line_count=len(lines))
    whole = executions_from_lines(frame, hot_rows=1000, line_count=len(lines))
    assert found.count() > 0
    assert reads.value == len(lines)
    columns = ("record_index", "duration_ms", "confidence")
    assert plain(found, columns) == plain(whole, columns)


def test_kept_events_carry_identity_for_statements_only(spark, monkeypatch):
    """Durations and other entries are kept for pairing and counting: nothing else of them is written down."""
    logs, really_kept = [], state.kept

    def seen(df, label):
        if label == "state-events":
            logs.append([r.asDict() for r in df.collect()])
        return really_kept(df, label)

    monkeypatch.setattr(state, "kept", seen)
    lines = rendered(stream(11, 60))
    events = typed_events(parse_lines(spark.createDataFrame([("target", i, t) for i, t in enumerate(lines)], "source_window string, record_index bigint, value string")))
    sums = state.new_state(events)
    own = ("source_kind", "event_id", "user", "database", "client_host", "application_name")
    others = [r for r in logs[0] if r["kind"] != "Statement"]
    assert others and all(r[c] is None for r in others for c in own)
    assert all(r["event_id"] == f"stderr:{r['record_index']}" for r in logs[0] if r["kind"] == "Statement")
    whole = family_totals(correlate_by_process_order(events))
    columns = ("family_id", "execution_count", "max_duration_ms", "correlated_execution_count")
    assert plain(state.state_totals(sums), columns) == plain(whole, columns)


def test_executions_are_counted_as_they_are_paired(parse, monkeypatch):
    """What is kept after pairing are groups and statements still open, not a row per execution."""
    rows, really_kept = {}, state.kept

    def seen(df, label):
        table = really_kept(df, label)
        rows[label] = table.count()
        return table

    monkeypatch.setattr(state, "kept", seen)
    lines = [line(i, i % 5, f"duration: {i % 3} ms  statement: SELECT {i}") for i in range(300)]
    sums = state.new_state(typed_events(parse([*lines, line(300, 7, "statement: SELECT 1"), line(301, 8, "statement: SELECT 2")])))
    assert rows.pop("state-events") == 302
    assert sum(rows.values()) == 3 + 2
    assert sums.counts.agg(F.sum("n")).first()[0] == 300 and sums.waiting.count() == 2


def test_hot_backends_are_looked_for_where_a_crowd_is_large(parse, monkeypatch):
    """Counting by crowd settles that no backend is hot; a large crowd has its backends looked at, and nothing is lost."""
    searched, really_search = [], correlate.hot_backends
    monkeypatch.setattr(correlate, "hot_backends", lambda *a: searched.append(1) or really_search(*a))
    lines = rendered(stream(12, 150))
    first, second = (typed_events(parse(part)) for part in (lines[:80], lines[80:]))
    calm = state.added(state.new_state(first, hot_rows=1000), second, hot_rows=1000)
    assert not searched
    hot = state.added(state.new_state(first, hot_rows=5), second, hot_rows=5)
    assert searched
    totals = family_totals(correlate_by_process_order(typed_events(parse(lines)), None))
    expected = plain(totals, totals.columns)
    assert plain(state.state_totals(calm), totals.columns) == expected
    assert plain(state.state_totals(hot), totals.columns) == expected


def test_empty_log_adds_nothing(parse):
    empty = typed_events(parse([]))
    sums = state.added(state.new_state(empty), empty)
    assert tuple(sums.seen.first()) == (0, 0, 0) and sums.counts.count() == 0 and sums.waiting.count() == 0
