"""JSON documents: findings, workload reports, and reading findings back.

A document is one row with one JSON text.  It only ever gathers rows that a
limit or the clock bounds: ranked findings, top lists, classes, hours.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querylens import __version__
from querylens.operators import timing, workload
from querylens.operators.events import with_shapes
from querylens.schemas import FINDINGS
from querylens.session import beside, broadcast_if_small, kept, settled

SIDES = ("baseline", "target", "delta")
KEEP_NULLS = {"ignoreNullFields": "false"}


def metadata(entry_count: DataFrame, version: str = __version__) -> DataFrame:
    """One row of run metadata; ``entry_count`` is a one-row, one-column frame."""
    return entry_count.select(
        F.struct(
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(
                "analysis_timestamp"
            ),
            F.lit(version).alias("tool_version"),
            F.array().cast("array<string>").alias("log_files_processed"),
            F.col(entry_count.columns[0]).cast("bigint").alias("total_log_entries"),
        ).alias("metadata")
    )


def finding_json(findings: DataFrame) -> DataFrame:
    """(rank, finding): each finding as JSON text.

    Absent identity fields print as null; baseline, target and delta are left
    out where a finding has none, so they join the text only when present.
    """
    plain = F.to_json(
        F.struct(*[c for c in FINDINGS.fieldNames() if c not in SIDES]), KEEP_NULLS
    )
    sides = F.to_json(F.struct(*SIDES))
    return findings.select(
        "rank",
        F.when(sides == "{}", plain)
        .otherwise(F.concat(F.substring(plain, 1, F.length(plain) - 1), F.lit(","), F.substring(sides, 2, F.length(sides))))
        .alias("finding"),
    )


def findings_document(findings: DataFrame, entry_count: DataFrame) -> DataFrame:
    """The whole findings file as one row (column ``value``); at most ``limit`` findings."""
    texts = finding_json(findings).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "finding"))), lambda f: f["finding"]
            ),
            ",",
        ).alias("findings")
    )
    return beside(texts, metadata(entry_count)).select(
        F.concat(
            F.lit('{"metadata":'), F.to_json("metadata"),
            F.lit(',"schema_version":1,"findings":['), F.col("findings"), F.lit("]}"),
        ).alias("value")
    )


def write_findings(findings: DataFrame, entry_count: DataFrame, path: str) -> None:
    findings_document(findings, entry_count).coalesce(1).write.mode("overwrite").text(path)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a findings document, one row each."""
    document = T.StructType(
        [
            T.StructField("schema_version", T.IntegerType()),
            T.StructField("findings", T.ArrayType(FINDINGS)),
        ]
    )
    pages = spark.read.schema(document).option("multiLine", "true").json(path)
    return pages.select(F.inline("findings"))


def store_findings(findings: DataFrame, run: str, path: str) -> None:
    """Keep the findings of one run in a Parquet store; storing a run again replaces it and no other."""
    (
        findings.select(*FINDINGS.fieldNames())
        .withColumn("run", F.lit(run))
        .repartition(1)
        .sortWithinPartitions("rank")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run")
        .parquet(path)
    )


def stored_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of all runs in a store.  Runs are folders; filters on id and rank reach the Parquet files."""
    schema = T.StructType([*FINDINGS.fields, T.StructField("run", T.StringType())])
    return spark.read.schema(schema).parquet(path)


def select_finding(
    findings: DataFrame, finding_id: str | None = None, rank: int | None = None
) -> DataFrame:
    """The finding with this exact id, or else with this rank, and its follow-up SQL."""
    if finding_id is None and rank is None:
        raise ValueError("Specify either --finding-id or --rank")
    if finding_id is None and rank <= 0:
        raise ValueError("Rank must be greater than 0")
    if finding_id is not None:
        chosen, missing = F.col("finding_id") == finding_id, f"Finding id not found: {finding_id}"
    else:
        chosen, missing = F.col("rank") == rank, f"Finding rank not found: {rank}"
    wanted = ("finding_id", "rank", "kind", "title", "next_sql")
    found = findings.where(chosen).select(*wanted).limit(1)
    if found.isEmpty():
        raise ValueError(missing)
    return found


def _gathered(rows: DataFrame, name: str, order: list[str], item: Column) -> DataFrame:
    """One row: the (bounded) rows as an ordered array of JSON items."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, item.alias("_item"))))
    return rows.agg(F.transform(pairs, lambda p: p["_item"]).alias(name))


@dataclass(frozen=True)
class ReportOptions:
    """From which duration on an execution is slow, and how long the lists are."""

    slow_ms: float = workload.SLOW_MS
    max_slow: int = workload.MAX_SLOW
    max_frequent: int = workload.MAX_FREQUENT


def workload_parts(
    executions: DataFrame, events: DataFrame, options: ReportOptions = ReportOptions()
) -> dict[str, DataFrame]:
    """The report's tables: summary, by_type, slowest and most_frequent."""
    summary = beside(
        workload.workload_summary(executions), workload.error_connection_counts(events)
    )
    frequent = workload.most_frequent_queries(executions, options.max_frequent)
    slowest = (
        workload.slowest_queries(executions, options.slow_ms, options.max_slow)
        .join(broadcast_if_small(settled(frequent)), "query", "left")
        .select(
            "query",
            "duration_ms",
            F.coalesce("query_count", F.lit(1)).alias("query_count"),
            *workload.EXECUTION_ORDER,
        )
    )
    # Every row shows the overall average: there is no per-query distribution here.
    frequent = beside(
        frequent, summary.select(F.col("average_duration").alias("avg_duration_ms"))
    )
    return {
        "summary": summary,
        "by_type": workload.query_type_counts(executions),
        "slowest": slowest,
        "most_frequent": frequent,
    }


def workload_document(
    executions: DataFrame,
    events: DataFrame,
    entry_count: DataFrame,
    temporal: bool = False,
    options: ReportOptions = ReportOptions(),
) -> DataFrame:
    """Workload report as one JSON row, with hourly totals and tails on request.

    The report has many sections over the same executions, so the columns they
    share are paired once and kept; give it events over entries that were kept
    too (``log_entries`` keeps them).
    """
    executions = kept(
        with_shapes(executions).select("shape", "parsed", "duration_ms", *workload.EXECUTION_ORDER),
        "executions",
    )
    parts = workload_parts(executions, events, options)
    summary = parts["summary"].select(
        F.struct(
            "total_queries",
            F.col("total_duration").alias("total_duration_ms"),
            F.col("average_duration").alias("avg_duration_ms"),
            "error_count",
            "connection_count",
        ).alias("summary")
    )
    by_type = parts["by_type"].agg(
        F.map_from_entries(F.collect_list(F.struct("query_type", "query_count"))).alias("by_type")
    )
    slowest = _gathered(
        parts["slowest"].withColumn("_down", -F.col("duration_ms")),
        "slowest_queries",
        ["_down", *workload.EXECUTION_ORDER],
        F.struct("query", "duration_ms", F.col("query_count").alias("count")),
    )
    frequent = _gathered(
        parts["most_frequent"].withColumn("_down", -F.col("query_count")),
        "most_frequent",
        ["_down", "query"],
        F.struct("query", F.col("query_count").alias("count"), "avg_duration_ms"),
    )
    rows = [metadata(entry_count), summary, by_type, slowest, frequent]
    fields = [
        F.col("metadata"),
        F.col("summary"),
        F.struct("by_type", "slowest_queries", "most_frequent").alias("query_analysis"),
    ]
    if temporal:
        hours = _gathered(
            timing.hourly_duration(events),
            "hourly_stats",
            ["hour"],
            F.struct("hour", "total_duration_ms"),
        )
        rows += [hours, timing.timing_summary(events)]
        fields.append(
            F.struct(
                "hourly_stats",
                "average_response_time_ms",
                "p95_response_time_ms",
                "p99_response_time_ms",
            ).alias("temporal_analysis")
        )
    return beside(*rows).select(F.to_json(F.struct(*fields), KEEP_NULLS).alias("value"))
