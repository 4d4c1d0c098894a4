"""The investigations a user runs, from log source to findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.operators.correlate import HOT_ROWS, Correlator, correlate_by_process_order, lean, pairing_events
from querylens.operators.diff import DiffOptions, slow_query_diff
from querylens.operators.events import typed_events, with_shapes
from querylens.operators.families import top_query_families
from querylens.operators.parse import parse_lines
from querylens.session import kept
from querylens.sources.files import head_sample, log_entries, window_lines


def executions_of(
    entries: DataFrame,
    correlator: Correlator | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Events paired into executions; ``correlator`` replaces the default pairing."""
    events = typed_events(entries)
    if correlator is not None:
        return correlator(events)
    return correlate_by_process_order(events, hot_rows)


def executions_from_lines(
    lines: DataFrame,
    log_format: str = "auto",
    hot_rows: int = HOT_ROWS,
    line_count: int | None = None,
) -> DataFrame:
    """Executions of lines that already carry ``record_index``.

    A log of at most ``hot_rows`` lines cannot hold a hot backend; counting lines
    parses nothing, so that is settled before looking at backends.
    """
    line_count = lines.count() if line_count is None else line_count
    entries = parse_lines(lines, log_format)
    if line_count <= hot_rows:
        return executions_of(entries, hot_rows=None)
    # Looking for hot backends is a pass of its own: both read lines that were parsed once.
    return correlate_by_process_order(kept(lean(pairing_events(typed_events(entries))), "events"), hot_rows)


def shaped_log(entries: DataFrame) -> DataFrame:
    """Events of a log kept for findings, with the shapes of statements in place of their text.

    However many findings are looked for, the log is parsed and its statements are blanked out once.
    """
    shaped = with_shapes(lean(pairing_events(typed_events(entries))))
    return kept(shaped.drop("statement", "is_sql"), "shaped-events")


def shaped_executions(log: DataFrame, line_count: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Executions of a ``shaped_log`` of at most ``line_count`` lines; they have no statement text."""
    none = {"statement": F.lit(None).cast("string"), "is_sql": F.lit(None).cast("boolean")}
    return correlate_by_process_order(log.withColumns(none), hot_rows if line_count > hot_rows else None)


def top_families(
    entries: DataFrame, limit: int = 10, correlator: Correlator | None = None
) -> DataFrame:
    return top_query_families(executions_of(entries, correlator), limit)


def slow_query_changes(
    spark: SparkSession,
    baseline: str,
    target: str,
    log_format: str = "auto",
    sample_size: int | None = None,
    options: DiffOptions = DiffOptions(),
) -> tuple[DataFrame, DataFrame]:
    """(findings, entries of both windows); a bad file in either one fails."""
    # Each window is sampled by itself: a path may be in both.
    before, after = (
        head_sample(window_lines(spark, path, window), sample_size)
        for path, window in ((baseline, "baseline"), (target, "target"))
    )
    entries = log_entries(
        before.unionByName(after), log_format, on_bad_file="fail", in_order=sample_size is None
    )
    return slow_query_diff(executions_of(entries), options), entries
