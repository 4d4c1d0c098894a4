"""Workload summaries over executions, events and entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.functions.classify import nine_way_class, statement_class
from querylens.functions.fingerprint import canonical_sql, family_sql, split_statements
from querylens.operators.correlate import EXECUTION_ORDER
from querylens.operators.events import is_query, mentions_connection, with_shapes
from querylens.operators.percentiles import value_profile
from querylens.session import beside, computed_once

SLOW_MS = 1000.0
MAX_SLOW = 10
MAX_FREQUENT = 20
TAILS = {"p95": 0.95, "p99": 0.99}


def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def one_row(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """The single row of ``df``, or the defaults when it has none."""
    return df.agg(*[F.coalesce(F.max(name), value).alias(name) for name, value in defaults.items()])


def duration_metrics(
    df: DataFrame, value: str = "duration_ms", weight: str | None = None
) -> DataFrame:
    """One row: min, max (never below 0), average, p95, p99, count, total; zeros if empty."""
    profile = value_profile(df, [], value, TAILS, weight=weight).select(
        F.col("value_min").alias("min_duration"),
        F.greatest(F.col("value_max"), F.lit(0.0)).alias("max_duration"),
        F.try_divide("value_total", "value_count").alias("average_duration"),
        F.col("p95").alias("p95_duration"),
        F.col("p99").alias("p99_duration"),
        F.col("value_count").alias("total_queries"),
        F.col("value_total").alias("total_duration"),
    )
    return one_row(
        profile,
        {
            name: F.lit(0).cast("bigint") if name == "total_queries" else F.lit(0.0)
            for name in profile.columns
        },
    )


def workload_summary(executions: DataFrame) -> DataFrame:
    """One row over all executions; one without a duration counts as 0 ms."""
    timed = executions.select(_zero(F.col("duration_ms")).alias("duration_ms"))
    return duration_metrics(timed).select(
        "total_queries", "total_duration", "average_duration", "p95_duration", "p99_duration"
    )


def _statements_by_shape(rows: DataFrame) -> DataFrame:
    """Occurrences per (shape, statement in it); unparsed text has no statements."""
    shaped = with_shapes(rows).where(F.col("parsed")).groupBy("shape").agg(F.count(F.lit(1)).alias("n"))
    return shaped.select("n", F.explode(split_statements("shape")).alias("sql"))


def query_type_counts(rows: DataFrame) -> DataFrame:
    """Statements per class, over executions or over statement events."""
    return (
        _statements_by_shape(rows)
        .groupBy(statement_class(F.col("sql")).alias("query_type"))
        .agg(F.sum("n").alias("query_count"))
    )


def event_type_distribution(events: DataFrame) -> DataFrame:
    return query_type_counts(events.where(F.col("kind") == "Statement"))


def slowest_queries(
    executions: DataFrame, threshold_ms: float = SLOW_MS, limit: int = MAX_SLOW
) -> DataFrame:
    """Longest executions above the threshold, earlier ones first among equals."""
    best = (
        executions.where(_zero(F.col("duration_ms")) > threshold_ms)
        .orderBy(F.desc("duration_ms"), *EXECUTION_ORDER)
        .limit(limit)
    )
    return computed_once(
        with_shapes(best).select("shape", "parsed", "duration_ms", *EXECUTION_ORDER),
        query=family_sql(),
    ).select("query", "duration_ms", *EXECUTION_ORDER)


def most_frequent_queries(executions: DataFrame, limit: int = MAX_FREQUENT) -> DataFrame:
    """Canonical statements by number of executions; ties by text."""
    named = computed_once(_statements_by_shape(executions), query=canonical_sql("sql"))
    return (
        named.groupBy("query")
        .agg(F.sum("n").alias("query_count"))
        .orderBy(F.desc("query_count"), "query")
        .limit(limit)
    )


def error_connection_counts(events: DataFrame) -> DataFrame:
    """One row: ERROR events, and other events that mention a connection."""
    error = F.col("kind") == "Error"
    return events.agg(
        F.count_if(error).alias("error_count"),
        F.count_if(~error & mentions_connection(F.col("text"))).alias("connection_count"),
    )


def error_rate(events: DataFrame) -> DataFrame:
    return events.agg(
        F.coalesce(
            F.try_divide(F.count_if(F.col("kind") == "Error"), F.count(F.lit(1))), F.lit(0.0)
        ).alias("error_rate")
    )


def slow_statement_entries(entries: DataFrame, threshold_ms: float = SLOW_MS) -> DataFrame:
    """Statement entries whose own duration is above the threshold."""
    return entries.where(is_query() & (F.col("duration_ms") > threshold_ms))


def rate_per_second(count: Column, first: Column, last: Column) -> Column:
    """Count over the whole seconds between first and last; 0 below one second."""
    seconds = F.timestamp_diff("SECOND", first, last)
    return F.when((count > 1) & (seconds > 0), count / seconds).otherwise(F.lit(0.0))


def hourly_execution_stats(executions: DataFrame) -> DataFrame:
    """Executions per hour of day, all dates pooled.

    Every statement event yields one execution with the same timestamp, so the
    span of the hour's statements is the span of its executions.
    """
    return (
        executions.groupBy(F.hour("ts").alias("hour"))
        .agg(
            F.count(F.lit(1)).alias("query_count"),
            _zero(F.sum("duration_ms")).alias("total_duration"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
        .select(
            "hour",
            "query_count",
            rate_per_second(F.col("query_count"), F.col("first_ts"), F.col("last_ts")).alias(
                "queries_per_second"
            ),
            "total_duration",
            (F.col("total_duration") / F.col("query_count")).alias("average_duration"),
        )
    )


def nine_way_summary(queries: DataFrame, sql: str = "sql", value: str = "duration_ms") -> DataFrame:
    """Per nine-way class: its count beside the overall totals.

    ``queries`` holds one (sql, duration) pair per added query.
    """
    rows = (
        queries.groupBy(
            nine_way_class(F.col(sql)).alias("query_type"), _zero(F.col(value)).alias("ms")
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    overall = duration_metrics(rows, "ms", "n").select(
        "total_queries", "total_duration", "average_duration", "p95_duration", "p99_duration"
    )
    return beside(rows.groupBy("query_type").agg(F.sum("n").alias("query_count")), overall)


def accumulated_summary(queries: DataFrame, events: DataFrame, sql: str = "sql", value: str = "duration_ms") -> DataFrame:
    """``nine_way_summary`` with the errors and connections that were added beside the queries."""
    return beside(nine_way_summary(queries, sql, value), error_connection_counts(events))
