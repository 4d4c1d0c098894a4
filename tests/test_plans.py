"""Plan shapes that the engine's cost at scale depends on."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from querylens.catalog import QUERIES
from querylens.operators.events import typed_events, with_shapes
from querylens.operators.parse import parse_lines
from querylens.session import spread
from querylens.sources import derived

SF = "/root/testdata/sf0.001"


def executed(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def test_time_window_reaches_the_scan(spark):
    plan = executed(QUERIES["src_time_window"](spark, SF))
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_filters_do_not_repeat_the_prefix_regex(spark):
    lines = derived.log_lines(spark, SF)
    errors = typed_events(parse_lines(lines)).where(F.col("kind") == "Error").select("text")
    plan = errors._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\[(\\d+)\\] ([^@]+)@([^ ]+) ([^:]+): ") == 1


def test_summary_reads_and_pairs_once(spark):
    df = QUERIES["workload_summary"](spark, SF)
    df.collect()
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode).split("== Initial Plan ==")[0]
    assert "Cartesian" not in plan


@pytest.mark.parametrize("name", ["top_query_families", "slow_query_diff"])
def test_findings_pair_once_and_exchange_keys(spark, name, monkeypatch):
    """The log is paired for one table; what follows exchanges hash keys, no statement text of executions."""
    from querylens.operators import families

    written = []
    monkeypatch.setattr(families, "kept", lambda df, label: written.append(label) or families_kept(df, label))
    from querylens.session import kept as families_kept

    plan = executed(QUERIES[name](spark, SF))
    assert written == ["paired"]
    assert "events.parquet" not in plan
    assert not re.search(r"Exchange hashpartitioning\([^)]*shape#", plan)
    assert "Cartesian" not in plan


def test_evidence_is_pruned_before_the_exchange(spark):
    plan = QUERIES["family_evidence"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("row_number(), 3, Partial") == 2


def test_store_lookups_reach_the_files(spark, tmp_path):
    from querylens.operators.families import top_query_families
    from querylens.plans import documents
    from querylens.plans.investigate import executions_of

    path = str(tmp_path / "store")
    findings = top_query_families(executions_of(parse_lines(derived.log_lines(spark, SF))))
    for run in ("a", "b", "a"):
        documents.store_findings(findings, run, path)
    stored = documents.stored_findings(spark, path)
    assert stored.count() == 20 and {r.run for r in stored.select("run").distinct().collect()} == {"a", "b"}
    plan = executed(stored.where("run = 'b' AND rank = 3").select("title"))
    assert "EqualTo(rank,3)" in plan and "(run#" in plan.split("PartitionFilters")[1].split("\n")[0]
    some = stored.where("run = 'a'").first().finding_id
    plan = executed(stored.where(F.col("finding_id") == some).select("title"))
    assert "EqualTo(finding_id," in plan


def test_ordered_parts_are_even_and_follow_each_other(spark, tmp_path):
    """Ten thousand executions with the same time are spread over the parts all the same."""
    from querylens.operators.correlate import EXECUTION_ORDER, read_in_order, write_in_order

    df = spark.range(10_000).selectExpr(
        "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id * 7919 % 10007 AS emit_index", "0 AS emit_part", "id AS record_index"
    )
    write_in_order(df, str(tmp_path / "out"), 5)
    back = read_in_order(spark, str(tmp_path / "out"))
    rows = sorted(back.collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(10_000))
    keys = [tuple(r[c] for c in EXECUTION_ORDER) for r in rows]
    assert keys == sorted(keys)
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("_metadata.file_name").count().collect()]
    assert len(sizes) == 5 and max(sizes) <= 2 * 2_000


def test_timing_plans_hold_no_fingerprint(spark):
    from querylens.functions.fingerprint import TO_NEXT_LITERAL

    for name in ("event_kinds", "timing_summary", "percentiles", "workload_summary"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert TO_NEXT_LITERAL[:30] not in plan, name


def test_dictionary_hashes_executions(spark):
    """Statement text is never sorted to find the distinct shapes."""
    from querylens.catalog import executions
    from querylens.operators.families import landed

    shapes = landed(executions(spark, SF)).select("shape_key", "parsed", "shape").distinct()
    plan = shapes._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_opaque_parts_of_a_shape_are_replaced_once(spark):
    rows = spark.createDataFrame([("SELECT 1 FROM t WHERE a = 'x'", True)], "statement string, is_sql boolean")
    plan = with_shapes(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(",  q , 1)") == 1, plan


def test_uneven_splits_are_dealt_out(spark, tmp_path):
    spark.range(4000).coalesce(1).write.parquet(str(tmp_path / "one"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        source = spark.read.parquet(str(tmp_path / "one"))
        # Many splits, and all rows in one of them.
        assert source.rdd.getNumPartitions() >= 8
        used = spread(source, "id").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert used >= 8
