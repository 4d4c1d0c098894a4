"""Timing patterns over events and entries; nothing here pairs statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylens.operators.events import is_error, is_query, mentions_connection
from querylens.operators.percentiles import check_probabilities, value_profile
from querylens.operators.workload import duration_metrics, rate_per_second

PEAK_FACTOR = 1.5
NEAR_MAXIMUM = 0.8


def timing_summary(events: DataFrame) -> DataFrame:
    """One row over every event that has a duration; averages and tails in whole ms."""
    metrics = duration_metrics(events)
    return metrics.select(
        F.col("average_duration").cast("bigint").alias("average_response_time_ms"),
        F.col("p95_duration").cast("bigint").alias("p95_response_time_ms"),
        F.col("p99_duration").cast("bigint").alias("p99_response_time_ms"),
        "total_queries",
        "total_duration",
    )


def _duration_by(events: DataFrame, part: Column, name: str) -> DataFrame:
    return (
        events.where(F.col("duration_ms").isNotNull())
        .groupBy(part.alias(name))
        .agg(F.sum("duration_ms").alias("total_duration_ms"))
    )


def hourly_duration(events: DataFrame) -> DataFrame:
    return _duration_by(events, F.hour("ts"), "hour")


def weekday_duration(events: DataFrame) -> DataFrame:
    """Monday is 0."""
    return _duration_by(events, F.weekday("ts"), "weekday")


def hourly_connections(events: DataFrame) -> DataFrame:
    """Events per hour, errors included, whose text mentions a connection."""
    return (
        events.where(mentions_connection(F.col("text")))
        .groupBy(F.hour("ts").alias("hour"))
        .agg(F.count(F.lit(1)).alias("connection_count"))
    )


def _over_hours(aggregate: Column) -> Column:
    # At most 24 rows: one per hour of day.
    return aggregate.over(Window.partitionBy())


def peak_hours(events: DataFrame, factor: float = PEAK_FACTOR) -> DataFrame:
    """Hours whose total is above ``factor`` times the mean of the hour totals."""
    totals = hourly_duration(events)
    mean = _over_hours(F.sum("total_duration_ms")) / _over_hours(F.count(F.lit(1)))
    return (
        totals.withColumn("mean", mean)
        .where(F.col("total_duration_ms") > F.col("mean") * factor)
        .select("hour", "total_duration_ms")
        .orderBy("hour")
    )


def percentiles(df: DataFrame, value: str, points: Sequence[float]) -> DataFrame:
    """One row per requested point in [0, 1]; an error when nothing has a value."""
    if not points:
        return df.sparkSession.createDataFrame([], "percentile double, value double")
    named = {f"point_{i}": float(p) for i, p in enumerate(points)}
    check_probabilities(named)
    profile = value_profile(df, [], value, named)
    counted = profile.agg(
        F.coalesce(F.max("value_count"), F.lit(0)).alias("value_count"),
        *[F.max(name).alias(name) for name in named],
    )
    rows = F.array(
        *[
            F.struct(F.lit(p).alias("percentile"), F.col(name).alias("value"))
            for name, p in named.items()
        ]
    )
    checked = F.when(
        F.col("value_count") == 0, F.raise_error(F.lit("No response times provided"))
    ).otherwise(rows)
    return counted.select(F.inline(checked))


def hourly_distribution(entries: DataFrame) -> DataFrame:
    """Statement entries per hour of day; one without its own duration counts as 0 ms."""
    duration = F.coalesce(F.col("duration_ms"), F.lit(0.0))
    return (
        entries.where(is_query())
        .groupBy(F.hour("ts").alias("hour"))
        .agg(
            F.count(F.lit(1)).alias("query_count"),
            F.sum(duration).alias("total_duration"),
            F.avg(duration).alias("average_duration"),
            F.min(duration).alias("min_duration"),
            F.greatest(F.max(duration), F.lit(0.0)).alias("max_duration"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
        .withColumn(
            "queries_per_second",
            rate_per_second(F.col("query_count"), F.col("first_ts"), F.col("last_ts")),
        )
        .drop("first_ts", "last_ts")
    )


def connection_analysis(entries: DataFrame) -> DataFrame:
    """Connection mentions per hour and weekday cell with their error count.

    Rolling the cells up by hour, by weekday or in full gives the three views;
    there are at most 168 of them.
    """
    return (
        entries.where(mentions_connection(F.col("message")))
        .groupBy(F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"))
        .agg(
            F.count(F.lit(1)).alias("connection_count"),
            F.count_if(is_error()).alias("error_count"),
        )
    )


def connection_views(entries: DataFrame) -> DataFrame:
    """Long form: (scope, bucket, connection_count, error_count, error_rate)."""
    cells = connection_analysis(entries)

    views = F.array(
        F.struct(F.lit("total").alias("scope"), F.lit(-1).alias("bucket")),
        F.struct(F.lit("hour").alias("scope"), F.col("hour").alias("bucket")),
        F.struct(F.lit("weekday").alias("scope"), F.col("weekday").alias("bucket")),
    )
    return (
        cells.select("connection_count", "error_count", F.inline(views))
        .groupBy("scope", "bucket")
        .agg(
            F.sum("connection_count").alias("connection_count"),
            F.sum("error_count").alias("error_count"),
        )
        .withColumn("error_rate", F.col("error_count") / F.col("connection_count"))
    )


def peak_usage(entries: DataFrame) -> DataFrame:
    """Hours near the maximum count or total, with the maxima and the busiest hour."""
    hours = hourly_distribution(entries).select("hour", "query_count", "total_duration")
    busiest = F.max(F.struct(F.col("query_count").alias("n"), (-F.col("hour")).alias("h")))
    return (
        hours.select(
            "*",
            _over_hours(F.max("query_count")).alias("max_queries_per_hour"),
            F.greatest(_over_hours(F.max("total_duration")), F.lit(0.0)).alias(
                "max_duration_per_hour"
            ),
            _over_hours(F.sum("query_count")).alias("_sum"),
            _over_hours(F.count(F.lit(1))).alias("_hours"),
            _over_hours(busiest).alias("_busiest"),
        )
        .where(
            (F.col("query_count") >= F.col("max_queries_per_hour") * NEAR_MAXIMUM)
            | (F.col("total_duration") >= F.col("max_duration_per_hour") * NEAR_MAXIMUM)
        )
        .select(
            F.col("hour").alias("peak_hour"),
            (-F.col("_busiest.h")).alias("busiest_hour"),
            "max_queries_per_hour",
            "max_duration_per_hour",
            F.expr("_sum div _hours").alias("average_queries_per_hour"),
        )
        .orderBy("peak_hour")
    )
