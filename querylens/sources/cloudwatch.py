"""Exported CloudWatch Logs responses as lines, and their time window."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.schemas import CLOUDWATCH_RESPONSE
from querylens.operators.parse import source_kind
from querylens.sources.files import landed_heads, log_entries, placed, row_in_task, split_table

# Units of a relative start.
UNITS = {"m": timedelta(minutes=1), "h": timedelta(hours=1), "d": timedelta(days=1)}


def _instant(text: str, field: str) -> datetime:
    try:
        moment = datetime.fromisoformat(text)
    except ValueError:
        moment = None
    if moment is None or moment.tzinfo is None:
        raise ValueError(f"Invalid --{field} time `{text}`")
    return moment.astimezone(timezone.utc)


def time_bounds(
    since: str, until: str | None = None, now: datetime | None = None
) -> tuple[int, int]:
    """(start, end) in epoch milliseconds.

    ``since`` is relative to now (``15m``, ``2h``, ``1d``) or an RFC 3339 time,
    ``until`` an RFC 3339 time or now.
    """
    now = now or datetime.now(timezone.utc)
    relative = re.fullmatch(r"([+-]?\d+)([mhd])", since)
    start = (
        now - int(relative[1]) * UNITS[relative[2]] if relative else _instant(since, "since")
    )
    end = _instant(until, "until") if until else now
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    start_ms, end_ms = ((m - epoch) // timedelta(milliseconds=1) for m in (start, end))
    if end_ms <= start_ms:
        raise ValueError("--until must be after --since")
    return start_ms, end_ms


def read_responses(
    spark: SparkSession, paths: str | Sequence[str], one_per_file: bool = True
) -> DataFrame:
    """One row per log event, in page order: epoch milliseconds and message.

    A response (a page of the API) is a JSON document: one per file, or one per
    line, which lets large exports be split between tasks.
    """
    pages = (
        spark.read.schema(CLOUDWATCH_RESPONSE)
        .option("multiLine", str(one_per_file).lower())
        .json(paths if isinstance(paths, str) else list(paths))
    )
    return pages.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.inline("events"),
    )


def zone_map(responses: DataFrame) -> DataFrame:
    """(file, first_ms, last_ms): the time span of every file of responses, from one pass over them.

    Write it beside an export once; ``responses_between`` then reads the files of a window only.
    """
    spans = responses.groupBy("file").agg(F.min("timestamp").alias("first_ms"), F.max("timestamp").alias("last_ms"))
    return spans.where("first_ms IS NOT NULL")


def responses_between(
    spark: SparkSession, zones: DataFrame, start_ms: int, end_ms: int, one_per_file: bool = True
) -> DataFrame:
    """Response events of the window, both ends included, from the files whose span meets it.

    The scan takes its files as an argument, so the driver holds the paths of the window's files.
    """
    meets = (F.col("last_ms") >= start_ms) & (F.col("first_ms") <= end_ms)
    path = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    paths = [r.path for r in zones.where(meets).select(path.alias("path")).orderBy("path").collect()]
    if not paths:
        return spark.createDataFrame([], "file string, block_start bigint, timestamp bigint, message string")
    return in_time_window(read_responses(spark, paths, one_per_file), start_ms, end_ms)


def in_time_window(events: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Response events of the window, both ends included."""
    return events.where(F.col("timestamp").between(start_ms, end_ms))


def entries_in_window(entries: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """The same window on the ``ts`` column of entries or other tables.

    Compares the bare column with literals, so a Parquet scan prunes row groups.
    """

    def wall_clock(ms: int):
        moment = datetime(1970, 1, 1) + timedelta(milliseconds=ms)
        return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")

    return entries.where(
        (F.col("ts") >= wall_clock(start_ms)) & (F.col("ts") < wall_clock(end_ms + 1))
    )


def response_lines(responses: DataFrame, window: str = "target") -> DataFrame:
    """Lines of all messages in page, event and line order."""
    text = F.regexp_replace("message", r"\n$", "")
    lines = responses.where(F.col("message").isNotNull() & (F.col("message") != "")).select(
        F.lit(window).alias("source_window"),
        "file",
        "block_start",
        F.explode(F.split(text, "\n")).alias("value"),
    )
    return lines.withColumn("_row", row_in_task())


def response_entries(
    responses: DataFrame,
    log_format: str = "auto",
    sample_size: int | None = None,
    window: str = "target",
) -> DataFrame:
    """Entries of exported responses.

    The sample is the first lines over ALL pages, unlike the per-file sample of
    log files; a line with an impossible timestamp fails the whole read.
    """
    lines = response_lines(responses, window)
    if sample_size is not None:
        heads = landed_heads(lines, sample_size)
        place = (
            F.col("_row") - F.col("first_row") + F.col("before_split") + F.col("before_file")
        )
        lines = placed(heads, split_table(heads)).where(place < sample_size).select(*lines.columns)
    return log_entries(
        lines,
        log_format,
        on_bad_file="fail",
        kind=source_kind(log_format, cloudwatch=True),
        in_order=sample_size is None,
    )
