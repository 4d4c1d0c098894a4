"""Pair statements with the durations logged after them by the same backend.

Per (window, process id), in record order: a statement without its own duration
waits for the first later duration whose timestamp is not before its own; the
next statement of the backend ends the wait; an earlier-stamped duration is
ignored.  Every statement yields exactly one execution.

The plan is one exchange on the backend, one sort by record and two windows that
share it, then a filter to the statement rows; nothing is aggregated.

A backend with very many records would make that one task.  Such backends are
cut into lanes at statement boundaries, where no wait can cross: the records of
a backend are cut into slices of about equally many rows (``sliced``), a lane runs
from the first statement of one slice to the first statement of the next slice that
has any.  The side tables have some tens of (all records / ``HOT_ROWS``) rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylens.session import broadcast_if_small, kept, running_rows, settled

BACKEND = ("source_window", "process_id")
HOT_ROWS = 4_000_000
# Each refinement of a histogram cuts a bin into 2 ** REFINED.
REFINED = 5
# Backends fall into this many crowds per window; no crowd up to ``HOT_ROWS`` records has a backend above it.
CROWDS = 1024
PAIRING_KINDS = ("Statement", "Duration")

Correlator = Callable[[DataFrame], DataFrame]


def _is_statement() -> Column:
    return F.col("kind") == "Statement"


def hot_backends(paired: DataFrame, hot_rows: int) -> DataFrame:
    """Backends above ``hot_rows`` records, with their records' range."""
    return (
        paired.groupBy(*BACKEND)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("record_index").alias("first"),
            F.max("record_index").alias("last"),
        )
        .where(F.col("rows") > hot_rows)
    )


def crowds(events: DataFrame, **counters: Column) -> DataFrame:
    """Records that pairing looks at (``pairing_rows``) and other counters, by window and crowd of backends.

    One narrow pass with few groups, however many backends there are: most logs need no other search for hot ones.
    """
    crowd = F.pmod(F.xxhash64("process_id"), F.lit(CROWDS)).alias("crowd")
    pairing = F.count_if(F.col("kind").isin(*PAIRING_KINDS)).alias("pairing_rows")
    return events.groupBy("source_window", crowd).agg(pairing, *[c.alias(name) for name, c in counters.items()])


def histogram(paired: DataFrame, hot: DataFrame, hot_rows: int) -> list[tuple[int, DataFrame]]:
    """Bins of the hot backends' record ranges with their rows, by bin width (2 ** shift): no bin over hot_rows / 2.

    Bins start wide, and what is too full is counted again ``REFINED`` times finer, so records that come late in
    one burst are told apart as well as evenly spread ones, and a backend has bins in proportion to its rows.
    """
    reach = hot.agg(F.max("last")).first()[0]
    shift = max(int(reach or 0).bit_length() - REFINED, 0)
    full = hot.select(*BACKEND, F.lit(0).cast("bigint").alias("within"))
    within = F.lit(0).cast("bigint")
    bins = []
    while True:
        inside = paired.select(*BACKEND, "record_index", within.alias("within")).join(
            broadcast_if_small(full), [*BACKEND, "within"]
        )
        counted = settled(
            inside.groupBy(*BACKEND, F.shiftright("record_index", shift).alias("bin")).agg(
                F.count(F.lit(1)).alias("rows")
            )
        )
        over = (2 * F.col("rows") > hot_rows) & F.lit(shift > 0)
        bins.append((shift, counted.where(~over)))
        full = counted.where(over).select(*BACKEND, F.col("bin").alias("within"))
        if full.isEmpty():
            return bins
        within, shift = F.shiftright("record_index", shift), max(shift - REFINED, 0)


def sliced(paired: DataFrame, hot: DataFrame, hot_rows: int) -> DataFrame:
    """Records with the slice they are in; NULL for backends that are not hot.

    Slices follow the running count of the bins, so each has at most one and a half times ``hot_rows`` records.
    """
    bins = histogram(paired, hot, hot_rows)
    every = None
    for shift, level in bins:
        level = level.withColumns({"shift": F.lit(shift), "low": F.shiftleft("bin", shift)})
        every = level if every is None else every.unionByName(level)
    before = Window.partitionBy(*BACKEND).orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("rows").over(before), F.lit(0))
    slices = settled(every.select(*BACKEND, "shift", "bin", F.floor(ahead / hot_rows).alias("in_slice")))
    found = F.lit(None).cast("bigint")
    for shift, _ in bins:
        level = slices.where(F.col("shift") == shift).select(*BACKEND, "bin", F.col("in_slice").alias(f"_slice_{shift}"))
        paired = paired.withColumn("bin", F.shiftright("record_index", shift)).join(
            broadcast_if_small(level), [*BACKEND, "bin"], "left"
        )
        found = F.coalesce(found, F.col(f"_slice_{shift}"))
    return paired.withColumn("slice", found).drop("bin", *[f"_slice_{shift}" for shift, _ in bins])


def lane_table(records: DataFrame) -> DataFrame:
    """How the slices of hot backends make lanes; one row per slice.  ``records`` carry their slice.

    Two narrow passes over the records of the hot backends:

    1. per slice the first statement (the cut), the timestamp of the statement
       still open when the slice begins, and the next cut;
    2. per slice the one duration ahead of its first statement that could close
       that open statement; all other durations there can never pair, so a run
       of millions of durations without a statement adds one row per slice.
    """
    busy = records.where("slice IS NOT NULL").select(*BACKEND, "record_index", "ts", "kind", "slice")
    slices = busy.groupBy(*BACKEND, "slice").agg(
        F.min(F.when(_is_statement(), F.col("record_index"))).alias("first_statement"),
        F.max_by("ts", F.when(_is_statement(), F.col("record_index"))).alias("last_ts"),
    )
    backend = Window.partitionBy(*BACKEND).orderBy("slice")
    earlier = backend.rowsBetween(Window.unboundedPreceding, -1)
    with_statement = F.when(F.col("first_statement").isNotNull(), F.col("slice"))
    cuts = settled(
        slices.select(
            *BACKEND,
            "slice",
            "first_statement",
            F.last(with_statement, ignorenulls=True).over(earlier).alias("open_slice"),
            F.last("last_ts", ignorenulls=True).over(earlier).alias("open_ts"),
            F.expr(
                "lead(first_statement) IGNORE NULLS OVER "
                f"(PARTITION BY {', '.join(BACKEND)} ORDER BY slice)"
            ).alias("next_cut"),
        )
    )
    closers = (
        busy.join(broadcast_if_small(cuts), [*BACKEND, "slice"])
        .where(~_is_statement() & (F.col("ts") >= F.col("open_ts")) & _in_front())
        .groupBy(*BACKEND, "slice")
        .agg(F.min("record_index").alias("closer"))
    )
    return settled(cuts.join(closers, [*BACKEND, "slice"], "left").drop("open_ts"))


def _in_front() -> Column:
    """Ahead of the first statement of its slice."""
    return F.col("first_statement").isNull() | (
        F.col("record_index") < F.col("first_statement")
    )


def _with_lane(paired: DataFrame, hot_rows: int | None) -> DataFrame:
    """Records with the lane they are paired in; lane -1 is a whole backend."""
    if not hot_rows or hot_backends(paired, hot_rows).isEmpty():
        return paired.withColumns(
            {"lane": F.lit(-1).cast("bigint"), "next_cut": F.lit(None).cast("bigint")}
        )
    # Several more passes follow, so the records are parsed once and kept.
    paired = kept(paired, "paired-records")
    records = sliced(paired, settled(hot_backends(paired, hot_rows)), hot_rows)
    lanes = broadcast_if_small(lane_table(records))
    return (
        records.join(lanes, [*BACKEND, "slice"], "left")
        .where(
            F.col("slice").isNull() | ~_in_front() | (F.col("record_index") == F.col("closer"))
        )
        .withColumn(
            "lane",
            F.when(F.col("slice").isNull(), F.lit(-1))
            .when(_in_front(), F.col("open_slice"))
            .otherwise(F.col("slice")),
        )
        .select(*paired.columns, "lane", "next_cut")
    )


def pairing_events(events: DataFrame) -> DataFrame:
    """The events that pairing looks at, without the columns it does not."""
    return events.where(F.col("kind").isin(*PAIRING_KINDS)).drop("level", "entry_message", "text")


# What is asked of statements only.
OF_STATEMENTS = ("source_kind", "event_id", "queryid", "user", "database", "client_host", "application_name")


def lean(events: DataFrame) -> DataFrame:
    """Events to be kept for pairing: what nothing asks of other events than statements is left empty there."""
    return events.withColumns({c: F.when(_is_statement(), F.col(c)) for c in OF_STATEMENTS})


def correlate_by_process_order(events: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Executions, one per statement event.

    ``hot_rows=None`` skips the check for hot backends.  ``emit_index`` and
    ``emit_part`` order executions with equal timestamps the way a pass over
    the records would finish them.  Events that have shapes (``with_shapes``)
    give executions that have them.
    """
    paired = _with_lane(pairing_events(events), hot_rows)
    # Rows are sorted by these columns in this order: the window has few values, so it does not come first.
    keys = (*reversed(BACKEND), "lane")
    backend = Window.partitionBy(*keys).orderBy("record_index")
    so_far = backend.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY record_index)"

    waiting = F.struct(
        F.col("record_index").alias("record"),
        F.col("ts").alias("since"),
        F.col("duration_ms").isNull().alias("open"),
    )
    rows = paired.withColumn(
        "_waiting", F.last(F.when(_is_statement(), waiting), ignorenulls=True).over(so_far)
    ).withColumn(
        "_closes",
        ~_is_statement() & F.col("_waiting.open") & (F.col("ts") >= F.col("_waiting.since")),
    )
    rows = rows.select(
        "*",
        F.expr(
            "lead(CASE WHEN _closes THEN named_struct('statement', _waiting.record,"
            f" 'record', record_index, 'ms', duration_ms) END) IGNORE NULLS {over}"
        ).alias("_closer"),
        F.expr(
            f"lead(CASE WHEN kind = 'Statement' THEN record_index END) IGNORE NULLS {over}"
        ).alias("_next"),
    ).where(_is_statement())

    inline = F.col("duration_ms").isNotNull()
    closed = ~inline & (F.col("_closer.statement") == F.col("record_index"))
    closer_record = F.when(closed, F.col("_closer.record"))
    reference = lambda record: F.struct(
        F.col("source_kind").alias("source_kind"), record.alias("record_index")
    )
    return rows.select(
        "source_window",
        "record_index",
        F.col("event_id").alias("execution_id"),
        "ts",
        "process_id",
        "user",
        "database",
        "client_host",
        "application_name",
        "queryid",
        "statement",
        "is_sql",
        *[c for c in ("parsed", "shape") if c in rows.columns],
        F.when(inline, F.col("duration_ms")).when(closed, F.col("_closer.ms")).alias("duration_ms"),
        closer_record.alias("duration_record"),
        F.when(inline | F.coalesce(closed, F.lit(False)), "Exact")
        .otherwise("StatementOnly")
        .alias("confidence"),
        F.array_compact(
            F.array(
                reference(F.col("record_index")),
                F.when(closer_record.isNotNull(), reference(closer_record)),
            )
        ).alias("evidence"),
        F.when(inline, F.col("record_index"))
        .otherwise(
            F.coalesce(
                closer_record, F.col("_next"), F.col("next_cut"), F.lit(2**63 - 1)
            )
        )
        .alias("emit_index"),
        F.when(inline, 1).otherwise(0).alias("emit_part"),
    )


EXECUTION_ORDER = ("ts", "emit_index", "emit_part", "record_index")


def write_in_order(executions: DataFrame, path: str, parts: int | None = None) -> None:
    """Write executions so that parts follow each other in execution order and each is in order itself.

    Ranges are cut by the whole order, not by time alone, so that equal timestamps do not gather in one part.
    """
    parts = parts or int(executions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = executions.repartitionByRange(parts, *EXECUTION_ORDER)
    ranged.sortWithinPartitions(*EXECUTION_ORDER).write.mode("overwrite").parquet(path)


def read_in_order(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_in_order`` wrote, with ``position`` (from 0) in the whole order; nothing is sorted again."""
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("bigint")
    rows = spark.read.parquet(path).select("*", part.alias("_part"), F.col("_metadata.row_index").alias("_row"))
    counted = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("rows")).withColumn("_all", F.lit(0))
    places = running_rows(counted, ("_all",), ("_part",)).select("_part", "in_log")
    placed = rows.join(broadcast_if_small(settled(places)), "_part")
    return placed.withColumn("position", F.col("in_log") + F.col("_row")).drop("_part", "_row", "in_log")
