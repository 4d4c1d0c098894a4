from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from querylens.operators.correlate import (
    REFINED,
    correlate_by_process_order,
    histogram,
    hot_backends,
    lane_table,
    sliced,
)
from querylens.operators.events import typed_events, with_shapes

START = datetime(2022, 4, 9, 21, 15)


def line(ms, pid, message):
    stamp = (START + timedelta(milliseconds=ms)).strftime("%Y-%m-%d %H:%M:%S.%f")
    return f"{stamp} UTC [{pid}] miller@grain scale-2: LOG:  {message}"


def pair(parse, lines, hot_rows=None):
    df = correlate_by_process_order(typed_events(parse(lines)), hot_rows)
    rows = df.orderBy("ts", "emit_index", "emit_part", "record_index").collect()
    return [
        (r.record_index, r.duration_ms, r.confidence, tuple(e.record_index for e in r.evidence))
        for r in rows
    ]


def test_pairs_with_following_duration(parse):
    got = pair(parse, [line(0, 1, "statement: SELECT 1"), line(1, 1, "duration: 42.5 ms")])
    assert got == [(0, 42.5, "Exact", (0, 1))]


def test_other_process_does_not_pair(parse):
    got = pair(parse, [line(0, 1, "statement: SELECT 1"), line(1, 2, "duration: 42.5 ms")])
    assert got == [(0, None, "StatementOnly", (0,))]


def test_next_statement_flushes(parse):
    lines = [
        line(0, 1, "statement: SELECT 1"),
        line(1, 1, "statement: SELECT 2"),
        line(2, 1, "duration: 12 ms"),
        line(3, 1, "duration: 13 ms"),
    ]
    assert pair(parse, lines) == [
        (0, None, "StatementOnly", (0,)),
        (1, 12.0, "Exact", (1, 2)),
    ]


def test_earlier_duration_is_dropped(parse):
    lines = [
        line(5, 1, "statement: SELECT 1"),
        line(4, 1, "duration: 1 ms"),
        line(5, 1, "duration: 2 ms"),
    ]
    assert pair(parse, lines) == [(0, 2.0, "Exact", (0, 2))]


def test_inline_duration_leaves_nothing_waiting(parse):
    lines = [
        line(0, 1, "statement: SELECT 1"),
        line(1, 1, "duration: 7 ms  statement: SELECT 2"),
        line(2, 1, "duration: 9 ms"),
    ]
    assert pair(parse, lines) == [(0, None, "StatementOnly", (0,)), (1, 7.0, "Exact", (1,))]


def test_statement_level_context_line_flushes(parse):
    lines = [
        line(0, 1, "statement: SELECT 1"),
        line(1, 1, "").replace("LOG:  ", "STATEMENT:  SELECT  raw"),
        line(2, 1, "duration: 1.2.3 ms"),
    ]
    df = with_shapes(correlate_by_process_order(typed_events(parse(lines)), None)).orderBy("record_index")
    rows = df.select("shape", "parsed", "duration_ms").collect()
    assert [tuple(r) for r in rows] == [("SELECT ?", True, None), ("SELECT  raw", False, 0.0)]


def machine(events):
    """The pairing rule as a loop over the records."""
    waiting, done = {}, []
    for i, (pid, kind, ts, ms) in enumerate(events):
        if kind == "S":
            if pid in waiting:
                j = waiting.pop(pid)
                done.append((events[j][2], len(done), j, None, None))
            if ms is not None:
                done.append((ts, len(done), i, ms, None))
            else:
                waiting[pid] = i
        elif pid in waiting and ts >= events[waiting[pid]][2]:
            j = waiting.pop(pid)
            done.append((events[j][2], len(done), j, ms, i))
    for j in sorted(waiting.values(), key=lambda j: (events[j][2], j)):
        done.append((events[j][2], len(done), j, None, None))
    return [
        (j, ms, "StatementOnly" if ms is None else "Exact", (j,) if d is None else (j, d))
        for _, _, j, ms, d in sorted(done, key=lambda e: e[:2])
    ]


def stream(seed, size, hot_share=0.35, statement_share=0.5):
    rng = random.Random(seed)
    events = []
    for i in range(size):
        pid = 1 if rng.random() < hot_share else rng.randint(2, 9)
        ts = i + rng.choice([0, 0, 0, -3, -8])
        if rng.random() < statement_share:
            inline = float(rng.randint(1, 99)) if rng.random() < 0.2 else None
            events.append((pid, "S", ts, inline))
        else:
            events.append((pid, "D", ts, float(rng.randint(1, 99))))
    return events


def rendered(events):
    out = []
    for pid, kind, ts, ms in events:
        if kind == "D":
            text = f"duration: {ms} ms"
        elif ms is not None:
            text = f"duration: {ms} ms  statement: SELECT 1"
        else:
            text = "statement: SELECT 1"
        out.append(line(ts, pid, text))
    return out


@pytest.mark.parametrize("hot_rows", [None, 40])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_streams(parse, seed, hot_rows):
    events = stream(seed, 400)
    assert pair(parse, rendered(events), hot_rows) == machine(events)


@pytest.mark.parametrize("hot_rows", [3, 15])
def test_hot_backend_that_rarely_logs_statements(parse, hot_rows):
    events = stream(7, 500, hot_share=0.8, statement_share=0.03)
    assert pair(parse, rendered(events), hot_rows) == machine(events)


def test_lanes_split_the_hot_backend(parse):
    events = typed_events(parse(rendered(stream(5, 600)))).where(
        F.col("kind").isin("Statement", "Duration")
    )
    hot = hot_backends(events, 60)
    assert "1" in {r.process_id for r in hot.collect()}
    lanes = lane_table(sliced(events, hot, 60)).where("process_id = '1'").orderBy("slice").collect()
    assert len(lanes) >= 3
    firsts = [r.first_statement for r in lanes if r.first_statement is not None]
    assert firsts == sorted(firsts)
    assert [r.next_cut for r in lanes if r.first_statement is not None] == firsts[1:] + [None]


def burst(seed, size):
    """One early record of backend 1 and, after a long silence, nothing but its records."""
    rng = random.Random(seed)
    quiet = [(rng.randint(2, 9), rng.choice("SD"), i, None if rng.random() < 0.5 else 4.0) for i in range(size * 3)]
    quiet = [(pid, kind, ts, ms if kind == "S" else 4.0) for pid, kind, ts, ms in quiet]
    loud = [(1, "S" if rng.random() < 0.6 else "D", 3 * size + i, None) for i in range(size)]
    loud = [(pid, kind, ts, None if kind == "S" else 7.0) for pid, kind, ts, _ in loud]
    return [(1, "S", 0, None), *quiet, *loud]


@pytest.mark.parametrize("hot_rows", [7, 50])
def test_late_burst_is_cut_evenly(parse, hot_rows):
    events = burst(3, 300)
    assert pair(parse, rendered(events), hot_rows) == machine(events)
    typed = typed_events(parse(rendered(events))).where(F.col("kind").isin("Statement", "Duration"))
    counts = sliced(typed, hot_backends(typed, hot_rows), hot_rows).where("process_id = '1'").groupBy("slice").count().collect()
    assert sum(r["count"] for r in counts) == 301
    assert max(r["count"] for r in counts) <= 1.5 * hot_rows
    assert len(counts) <= 301 / hot_rows + 1


def test_bins_follow_rows_not_the_range(spark):
    """A range of 2 ** 40 records with a burst at its end: few bins, none too full."""
    rows = [("w", "1", 0), ("w", "1", 77)] + [("w", "1", (1 << 40) + i) for i in range(400)] + [("w", "2", i) for i in range(30)]
    df = spark.createDataFrame(rows, "source_window string, process_id string, record_index bigint")
    bins = histogram(df, hot_backends(df, 40), 40)
    counted = [r.rows for _, level in bins for r in level.collect()]
    assert sum(counted) == 402 and max(counted) <= 20 and len(counted) <= 2**REFINED * 402 / 20
