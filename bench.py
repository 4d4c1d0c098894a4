"""Wall time of the headline queries; prints one JSON line.

``queries`` holds seconds per registered query at $BENCH_SF_DIR (100,000 log
limits for, with the same line counts and lengths of lists: one statement repeated
for the runs end to end, distinct entries over ten tables for parsing, analysis and
the report.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from querylens.catalog import QUERIES  # noqa: E402
from querylens.operators import workload  # noqa: E402
from querylens.operators.events import typed_events  # noqa: E402
from querylens.operators.parse import parse_lines  # noqa: E402
from querylens.plans.investigate import executions_of, top_families  # noqa: E402
from querylens.plans.documents import ReportOptions, workload_document  # noqa: E402
from querylens.session import beside, kept, local_session  # noqa: E402
from querylens.sources import files  # noqa: E402

HEADLINE = (
    "top_query_families",
    "slow_query_diff",
    "family_totals",
    "family_evidence",
    "window_family_metrics",
    "correlate_executions",
    "event_kinds",
    "parse_default_prefix",
    "parse_rds_prefix",
    "parse_auto_format",
    "sql_fingerprint",
    "sql_fingerprint_regex",
    "sql_multi_statement",
    "workload_summary",
    "slowest_queries",
    "most_frequent_queries",
    "hourly_execution_stats",
    "timing_summary",
    "percentiles",
    "peak_usage",
    "connection_analysis",
    "src_record_index",
    "src_sample_lines",
    "src_cloudwatch_json",
    "report_timing_json",
)

# Fixed value: the statement line that the runs end to end repeat.
LINE = (
    "2024-01-15 10:00:00.123 UTC [1234] testuser@testdb psql: "
    "LOG: statement: SELECT * FROM users WHERE id = 1;"
)


def timed(run) -> float:
    started = time.perf_counter()
    run()
    return round(time.perf_counter() - started, 3)


def finish(df) -> None:
    """Run the whole plan without moving the rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def ceilings(spark) -> dict[str, float]:
    folder = tempfile.mkdtemp(prefix="spark-")

    def log_of(lines: int) -> str:
        path = f"{folder}/log_{lines}.log"
        with open(path, "w") as out:
            out.write((LINE + "\n") * lines)
        return path

    def distinct(lines: int) -> str:
        path = f"{folder}/distinct_{lines}.log"
        with open(path, "w") as out:
            for i in range(lines):
                out.write(
                    f"2025-03-02 {i // 3600 % 24:02d}:{i // 60 % 60:02d}:{i % 60:02d}.000 UTC [{1000 + i}] shop@store web: "
                    f"LOG:  duration: {i % 900 + 0.5} ms  statement: SELECT c{i} FROM table_{i % 10} WHERE id = {i}\n"
                )
        return path

    def parse(lines: int):
        return parse_lines(files.read_lines(spark, distinct(lines)))

    def top(lines: int, sample: int | None = None) -> None:
        entries = files.log_entries(files.read_lines(spark, log_of(lines)), sample_size=sample)
        finish(top_families(entries))

    def analysed(lines: int):
        entries = kept(
            parse(lines).withColumn("record_index", F.monotonically_increasing_id()), "bench"
        )
        return executions_of(entries, hot_rows=None), typed_events(entries), entries

    def analysis() -> None:
        executions, events, _ = analysed(1000)
        finish(beside(workload.workload_summary(executions), workload.error_connection_counts(events)))

    def report() -> None:
        executions, events, entries = analysed(1000)
        options = ReportOptions(slow_ms=-1.0, max_slow=1000, max_frequent=1000)
        count = entries.agg(F.count(F.lit(1)))
        finish(workload_document(executions, events, count, options=options))

    return {
        "parse_1000_lines": timed(lambda: finish(parse(1000))),
        "analyse_1000_entries": timed(analysis),
        "json_report_1000_and_1000_rows": timed(report),
        "top_families_1000_lines": timed(lambda: top(1000)),
        "top_families_5000_lines": timed(lambda: top(5000)),
        "top_families_10000_lines_sample_100": timed(lambda: top(10_000, 100)),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("OFF")
    # Start the JVM's compilers on small inputs; their first seconds are not ours.
    warm = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    for name in ("top_query_families", "slow_query_diff", "percentiles"):
        finish(QUERIES[name](spark, warm if os.path.isdir(warm) else sf_dir))
    seconds = {}
    for name in HEADLINE:
        seconds[name] = timed(lambda: finish(QUERIES[name](spark, sf_dir)))
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline query wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "ceilings": ceilings(spark),
                "sf": os.path.basename(sf_dir),
            }
        )
    )


if __name__ == "__main__":
    main()
