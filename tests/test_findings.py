from __future__ import annotations

import json

import pytest
from log_samples import BASELINE_LOG, RDS_LOG, SAMPLE_LOG, TARGET_LOG
from pyspark.sql import functions as F

from querylens.operators.diff import DiffOptions, slow_query_diff
from querylens.operators.families import family_totals, top_query_families
from querylens.operators.next_sql import next_sql
from querylens.plans import documents
from querylens.plans.investigate import executions_of, slow_query_changes, top_families


def activity(database, user, application):
    return (
        "select pid, usename, datname, application_name, state, wait_event_type, wait_event, query_start, query "
        f"from pg_stat_activity where datname = '{database}' and usename = '{user}' and application_name = "
        f"'{application}' order by query_start desc nulls last limit 20;"
    )


def expected(rank, sql, identity, count, total, peak, records):
    """A finding of the sample log, worked out by hand."""
    database, user, application = identity
    pattern = sql.replace("_", "\\_")  # underscores are wildcards there
    family = f"queryid=|db={database}|user={user}|app={application}|sql={sql}"
    return {
        "schema_version": 1, "finding_id": f"query_family:{family}", "kind": "query_family", "rank": rank,
        "title": "Query family with high total runtime",
        "reason": f"{count} executions contributed {total:.3f} ms total runtime; max execution was {peak:.3f} ms",
        "reason_codes": ["high_total_duration", "high_max_duration", "correlated_duration"], "score": total,
        "query_family": {
            "query_family_id": family, "normalized_sql": sql, "queryid": None, "database": database, "user": user,
            "application_name": application,
        },
        "metrics": {
            "execution_count": count, "total_duration_ms": total, "avg_duration_ms": total / count,
            "max_duration_ms": peak, "correlated_execution_count": count, "uncorrelated_execution_count": 0,
        },
        "evidence": [{"source_kind": "Stderr", "record_index": i} for i in records], "confidence": "high",
        "next_sql": [
            "select queryid, calls, total_exec_time, mean_exec_time, rows, query from pg_stat_statements where query "
            f"ilike '%{pattern}%' order by total_exec_time desc limit 20;",
            activity(database, user, application),
        ],
    }


def test_sample_log_document(parse, spark, tmp_path):
    entries = parse(SAMPLE_LOG)
    count = entries.agg(F.count(F.lit(1)))
    documents.write_findings(top_families(entries), count, str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*"))
    document = json.loads(part.read_text())
    assert document["metadata"].pop("analysis_timestamp") and document["metadata"].pop("tool_version")
    assert document["metadata"] == {"log_files_processed": [], "total_log_entries": 9}
    assert document["schema_version"] == 1
    assert document["findings"] == [
        expected(1, "SELECT title, price FROM books WHERE isbn = ?", ("store", "shop", "web"), 2, 44.0, 24.0, [0, 1, 2]),
        expected(2, "SELECT max(day) FROM visits WHERE day >= ?", ("analytics", "etl", "loader"), 1, 18.0, 18.0, [6, 7]),
        expected(3, "UPDATE carts SET touched = CLOCK() WHERE cart_id = ?", ("store", "shop", "jobs"), 1, 9.0, 9.0, [4, 5]),
    ]
    findings = documents.read_findings(spark, str(tmp_path / "out"))
    assert findings.count() == 3
    chosen = documents.select_finding(findings, rank=2).first()
    assert "analytics" in chosen.finding_id and len(chosen.next_sql) == 2
    by_id = documents.select_finding(findings, finding_id=chosen.finding_id, rank=1).first()
    assert by_id.rank == 2
    for bad in ({}, {"rank": 0}, {"rank": 9}, {"finding_id": "nope"}):
        with pytest.raises(ValueError):
            documents.select_finding(findings, **bad)


def test_rds_log(parse):
    rows = top_families(parse(RDS_LOG, "rds")).collect()
    got = [
        (r.rank, r.query_family.database, r.metrics.execution_count, r.metrics.total_duration_ms,
         r.metrics.max_duration_ms, r.query_family.application_name)
        for r in rows
    ]
    assert got == [(1, "analytics", 1, 120.0, 120.0, None), (2, "store", 2, 69.0, 44.0, None)]
    assert [(e.source_kind, e.record_index) for e in rows[1].evidence] == [
        ("AwsRds", 0), ("AwsRds", 1), ("AwsRds", 2)]


def test_repeated_line_is_one_low_confidence_family(parse):
    entries = parse([SAMPLE_LOG.split("\n")[0]] * 50)
    row = top_families(entries).first()
    assert (row.confidence, row.metrics.execution_count, row.score) == ("low", 50, 0.0)
    assert row.reason_codes == ["high_total_duration", "high_max_duration", "partial_correlation"]
    assert [e.record_index for e in row.evidence] == [0, 1, 2]


def test_partly_paired_family_is_medium(parse):
    lines = SAMPLE_LOG.split("\n")
    row = top_families(parse([lines[0], lines[1], lines[2]])).first()
    assert row.confidence == "medium"
    assert row.reason_codes[2:] == ["correlated_duration", "partial_correlation"]
    assert (row.metrics.avg_duration_ms, row.metrics.execution_count) == (10.0, 2)


def test_limit_ranks_by_total_then_id(parse):
    lines = [
        f"2024-01-15 10:00:0{i}.000 UTC [{i}] {u}@d a: LOG:  duration: {ms} ms  statement: SELECT 1"
        for i, (u, ms) in enumerate([("b", 5), ("a", 5), ("c", 9)])
    ]
    rows = top_families(parse(lines), limit=2).collect()
    assert [(r.rank, r.query_family.user) for r in rows] == [(1, "c"), (2, "a")]


def test_shapes_of_one_family_are_merged(parse):
    head = "2024-01-15 10:00:00.000 UTC [1] a@d p: LOG:  duration: 2 ms  statement: "
    sqls = ["SELECT 1 FROM t", "select  2  from t", "SELECT 'x' FROM t;"]
    totals = family_totals(executions_of(parse([head + s for s in sqls]))).collect()
    assert [(r.normalized_sql, r.execution_count) for r in totals] == [("SELECT ? FROM t", 3)]
    row = top_query_families(executions_of(parse([head + s for s in sqls]))).first()
    assert [e.record_index for e in row.evidence] == [0, 1, 2]


def diff(spark, tmp_path, options=DiffOptions(), baseline=BASELINE_LOG, target=TARGET_LOG):
    (tmp_path / "b.log").write_text(baseline)
    (tmp_path / "t.log").write_text(target)
    return slow_query_changes(
        spark, str(tmp_path / "b.log"), str(tmp_path / "t.log"), options=options
    )


def test_diff_logs(spark, tmp_path):
    findings, entries = diff(spark, tmp_path)
    first, second = findings.collect()
    assert entries.count() == 10
    assert (first.rank, first.score, first.query_family.normalized_sql) == (
        1, 400.0, "DELETE FROM baskets WHERE basket = ?")
    assert first.reason_codes == [
        "meets_eligibility_thresholds", "absent_in_baseline", "p95_regressed",
        "runtime_contribution_increased", "correlated_duration"]
    assert first.reason == (
        "absent in baseline; p95 increased by 200.000 ms; total runtime increased by 200.000 ms")
    assert tuple(first.baseline) == (0, 0.0, 0.0, 0.0, 0.0)
    assert (second.score, second.kind) == (320.0, "slow_query_regression")
    assert tuple(second.baseline) == (2, 50.0, 25.0, 30.0, 30.0)
    assert tuple(second.target) == (2, 250.0, 125.0, 150.0, 150.0)
    assert tuple(second.delta) == (0, 200.0, 100.0, 120.0, 120.0)
    assert second.confidence == "high"
    assert [e.record_index for e in second.evidence] == [0, 1, 2]


def test_diff_thresholds(spark, tmp_path):
    assert diff(spark, tmp_path, DiffOptions(min_target_count=3))[0].count() == 0
    assert diff(spark, tmp_path, DiffOptions(min_target_total_ms=250.0))[0].count() == 1
    only = diff(spark, tmp_path, DiffOptions(min_p95_delta_ms=150.0, limit=1))[0].first()
    assert only.rank == 1 and "p95_regressed" in only.reason_codes


def test_unchanged_family_is_no_finding(spark, tmp_path):
    assert diff(spark, tmp_path, target=BASELINE_LOG)[0].count() == 0


def test_family_without_durations(spark, tmp_path):
    line = TARGET_LOG.split("\n")[0]
    findings = diff(spark, tmp_path, DiffOptions(min_target_count=0), target=line)[0]
    assert findings.count() == 0  # the baseline knows it, and nothing rose
    lonely = "2024-01-15 10:00:00.000 UTC [3001] z@store web: LOG:  statement: SELECT 7"
    row = diff(spark, tmp_path, DiffOptions(min_target_count=0), target=lonely)[0].first()
    assert (row.score, row.reason, row.confidence) == (0.0, "absent in baseline", "low")
    assert row.metrics.uncorrelated_execution_count == 1


def test_missing_and_empty_windows(spark, tmp_path):
    (tmp_path / "b.log").write_text(BASELINE_LOG)
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="does not exist"):
        slow_query_changes(spark, str(tmp_path / "b.log"), str(tmp_path / "x.log"))
    with pytest.raises(ValueError, match="No log files"):
        slow_query_changes(spark, str(tmp_path / "none"), str(tmp_path / "b.log"))


def test_diff_of_executions_needs_both_windows_only_by_column(parse):
    entries = parse(TARGET_LOG)
    assert slow_query_diff(executions_of(entries)).count() == 2


def test_next_sql_escapes(spark):
    df = spark.createDataFrame(
        [("SELECT pot FROM shed WHERE label LIKE '5%_x\\'", None, "garden", "o'neil", "till_7%"),
         ("SELECT ?", "42", None, None, None)],
        "sql string, queryid string, db string, usr string, app string",
    )
    texts = df.select(
        next_sql(*[F.col(c) for c in ("sql", "queryid", "db", "usr", "app")]).alias("n")
    ).collect()
    first, second = [r.n for r in texts]
    assert "label LIKE ''5\\%\\_x\\\\''%' order by" in first[0]
    assert "where datname = 'garden' and usename = 'o''neil' and application_name = 'till_7%' order" in first[1]
    assert second[0].endswith("from pg_stat_statements where queryid = 42;")
    assert "where state <> 'idle' order by" in second[1]


SF = "/root/testdata/sf0.001"


def test_two_runs_in_a_store_parse_one_log_once(spark, monkeypatch):
    from querylens import catalog
    from querylens.plans import investigate

    parsed, parse_lines = [], catalog.parse_lines
    for module in (catalog, investigate):
        monkeypatch.setattr(module, "parse_lines", lambda *args: parsed.append(1) or parse_lines(*args))
    assert {r.run for r in catalog.findings_store_lookup(spark, SF).collect()} == {"families", "changes"}
    assert len(parsed) == 1


def test_changes_keep_shapes_and_no_statement_text(spark, monkeypatch):
    from querylens import catalog
    from querylens.plans import investigate

    written, kept = [], investigate.kept
    monkeypatch.setattr(investigate, "kept", lambda df, label: written.append(df.columns) or kept(df, label))
    lines = catalog.slow_query_diff(spark, SF).collect()
    whole = catalog._flat_changes(slow_query_diff(catalog.both_windows(spark, SF), catalog.DIFF_OPTIONS)).collect()
    assert lines == whole
    assert len(written) == 1 and "shape" in written[0] and "statement" not in written[0]
