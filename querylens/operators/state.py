"""Investigations that go on: what a log adds up to, kept as tables that later logs are added to.

A state holds enough to answer family totals, window metrics with exact percentiles, and workload summaries without
the logs it came from, and is small beside them:

* ``counts``: executions by family, nine-way class, duration and whether they were paired. Counts of equal values
  add up, so nothing is lost to a sketch;
* ``waiting``: the last statement of a backend while no duration has closed it. The next log may bring that
  duration, so these executions are not in ``counts`` yet; a summary counts them as unpaired;
* ``seen``: entries so far (the next log's first record number), errors and connections.

Adding a log to a state gives the same tables as one pass over both logs. Adding reads the log, the waiting
statements (one per backend at most) and the counts; the old log is not read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.functions.classify import nine_way_class
from querylens.functions.fingerprint import family_sql
from querylens.operators.correlate import HOT_ROWS, correlate_by_process_order, crowds, lean
from querylens.operators.diff import METRICS, family_profile
from querylens.operators.events import mentions_connection, with_shapes
from querylens.operators.families import IDENTITY, with_id
from querylens.operators.workload import duration_metrics
from querylens.session import beside, computed_once, drop_scratch, kept, measured, scratch_path, settled

# What an execution that nothing has completed is ordered by.
STILL_WAITING = 2**63 - 1
TABLES = ("counts", "waiting", "seen")
GROUP = ("source_window", *IDENTITY, "normalized_sql", "query_class", "duration_ms", "exact")
WAITING = (
    "source_window", "record_index", "source_kind", "ts", "process_id", "user", "database", "client_host",
    "application_name", "event_id", "kind", "queryid", "statement", "is_sql", "duration_ms",
)
RECORD = ("source_window", "process_id", "record_index")


@dataclass(frozen=True)
class State:
    counts: DataFrame
    waiting: DataFrame
    seen: DataFrame


def _shaped(executions: DataFrame, *others: Column) -> DataFrame:
    """Executions counted by GROUP with shapes in place of canonical texts, and by ``others``; each task combines its own."""
    rows = with_shapes(executions).select(
        "source_window",
        *IDENTITY,
        "parsed",
        "shape",
        nine_way_class(F.col("statement")).alias("query_class"),
        "duration_ms",
        (F.col("confidence") == "Exact").cast("bigint").alias("exact"),
        *others,
    )
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def _counted(executions: DataFrame) -> DataFrame:
    """Executions by GROUP: first by shape, which each task combines, then by canonical text."""
    named = computed_once(_shaped(executions), normalized_sql=family_sql())
    return named.groupBy(*GROUP).agg(F.sum("n").alias("n"))


def _named(shaped: DataFrame) -> DataFrame:
    """``_shaped`` rows that were kept, by GROUP: one shape has many durations, and its text is printed once."""
    shapes = shaped.select(F.col("parsed").alias("_parsed"), F.col("shape").alias("_shape")).distinct()
    texts = measured(shapes.select("*", family_sql("_shape", "_parsed").alias("normalized_sql")))
    same = F.col("parsed").eqNullSafe(F.col("_parsed")) & F.col("shape").eqNullSafe(F.col("_shape"))
    return shaped.join(texts, same).select(*GROUP, "n")


def _stored(state: State, path: str) -> State:
    spark = state.counts.sparkSession
    for name in TABLES:
        getattr(state, name).write.mode("overwrite").parquet(f"{path}/{name}")
    return read_state(spark, path)


def read_state(spark: SparkSession, path: str) -> State:
    return State(*(spark.read.parquet(f"{path}/{name}") for name in TABLES))


def new_state(events: DataFrame, path: str | None = None, hot_rows: int | None = HOT_ROWS) -> State:
    """The state of a first log, written to ``path`` (by default to the shared folder)."""
    return _from(events, None, path, hot_rows)


def added(state: State, events: DataFrame, path: str | None = None, hot_rows: int | None = HOT_ROWS) -> State:
    """The state after one more log, whose records are numbered from 0.

    ``path`` must not be the one that ``state`` is read from.
    """
    return _from(events, state, path, hot_rows)


def _from(events: DataFrame, before: State | None, path: str | None, hot_rows: int | None) -> State:
    spark = events.sparkSession
    # Parsed once: the counters, the search for hot backends, the pairing and the waiting statements read what is kept.
    connects = mentions_connection(F.col("text")).alias("connects")
    log = events = kept(lean(events.select(*WAITING, connects)), "state-events")
    error = F.col("kind") == "Error"
    counters = {"error_count": F.count_if(error), "connection_count": F.count_if(~error & F.col("connects"))}
    crowded = settled(crowds(log, entries=F.count(F.lit(1)), **counters))
    seen = crowded.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("entries", *counters)])
    if before is not None:
        first = F.lit(before.seen.first().entries)
        numbered = F.concat_ws(":", F.substring_index("event_id", ":", 1), (F.col("record_index") + first).cast("string"))
        events = events.withColumns({"record_index": F.col("record_index") + first, "event_id": numbered})
        events = events.select(*WAITING).unionByName(before.waiting)
        seen = seen.unionByName(before.seen).agg(*[F.sum(c).alias(c) for c in seen.columns])
    if hot_rows and crowded.where(F.col("pairing_rows") >= hot_rows).isEmpty():
        hot_rows = None  # a backend has the records of its crowd at most, and the one that waited
    # Paired once and counted as it is paired: what is kept has a row for each statement still open and each group.
    still = F.col("emit_index") == STILL_WAITING
    open_at = F.when(still, F.struct("process_id", "record_index")).alias("open_at")
    grouped = kept(_shaped(correlate_by_process_order(events.select(*WAITING), hot_rows), open_at), "state-grouped")
    counts = _named(grouped.where("open_at IS NULL"))
    if before is not None:
        counts = counts.unionByName(before.counts)
    counts = counts.groupBy(*GROUP).agg(F.sum("n").alias("n"))
    # At most one per backend: the record it is waiting with.
    still = grouped.where("open_at IS NOT NULL").select("source_window", "open_at.*")
    waiting = events.where("kind = 'Statement' AND duration_ms IS NULL").select(*WAITING).join(still, list(RECORD), "left_semi")
    stored = _stored(State(counts, waiting.select(*WAITING), seen), path or scratch_path(spark, "state"))
    for table in (log, grouped):
        drop_scratch(spark, table)
    return stored


def executions_in(state: State) -> DataFrame:
    """All executions so far by GROUP with their number ``n``; waiting statements are unpaired ones."""
    waiting = state.waiting.withColumn("confidence", F.lit("StatementOnly"))
    return state.counts.unionByName(_counted(waiting)).groupBy(*GROUP).agg(F.sum("n").alias("n"))


def state_totals(state: State) -> DataFrame:
    """Family totals, as ``family_totals`` gives them for the executions themselves."""
    rows = with_id(executions_in(state))
    exact = F.sum(F.col("exact") * F.col("n"))
    return rows.groupBy("family_id", *IDENTITY, "normalized_sql").agg(
        F.sum("n").alias("execution_count"),
        F.coalesce(F.sum(F.col("duration_ms") * F.col("n")), F.lit(0.0)).alias("total_duration_ms"),
        F.coalesce(F.max("duration_ms"), F.lit(0.0)).alias("max_duration_ms"),
        exact.alias("correlated_execution_count"),
        (F.sum("n") - exact).alias("uncorrelated_execution_count"),
    )


def state_metrics(state: State, window: str | None = None) -> DataFrame:
    """Window metrics per family with exact percentiles; ``window`` renames the state's window."""
    rows = executions_in(state)
    if window is not None:
        rows = rows.withColumn("source_window", F.lit(window))
    return family_profile(rows, weight="n")


def state_summary(state: State) -> DataFrame:
    """Nine-way class counts beside the overall durations, errors and connections so far."""
    rows = executions_in(state).select("query_class", F.coalesce("duration_ms", F.lit(0.0)).alias("ms"), "n")
    overall = duration_metrics(rows, "ms", "n").select(
        "total_queries", "total_duration", "average_duration", "p95_duration", "p99_duration"
    )
    classes = rows.groupBy(F.col("query_class").alias("query_type")).agg(F.sum("n").alias("query_count"))
    return beside(classes, overall, state.seen.select("error_count", "connection_count"))


__all__ = [
    "METRICS", "State", "added", "executions_in", "new_state", "read_state", "state_metrics", "state_summary", "state_totals",
]
