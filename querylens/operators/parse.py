"""Raw log lines -> typed log entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.functions import logline
from querylens.functions.text import strip, white_space_in

SOURCE_KINDS = {"Stderr": "stderr", "AwsRds": "aws-rds", "Csvlog": "csvlog", "Jsonlog": "jsonlog"}


def source_kind(log_format: str, cloudwatch: bool = False) -> str:
    """Kind reported for a source; CloudWatch with an open format means RDS."""
    if log_format == "rds" or (cloudwatch and log_format == "auto"):
        return "AwsRds"
    return "Stderr"


def candidate_lines(lines: DataFrame) -> DataFrame:
    """Trimmed lines that can start an entry.

    Blank lines and continuation lines (no leading ASCII digit) go; continuation
    text is not stitched to the statement above it.
    """
    text = strip(F.col("value"))
    return lines.withColumn("line", text).where(F.col("line").rlike("^[0-9]"))


def line_pieces(lines: DataFrame, log_format: str = "auto") -> DataFrame:
    """Add ``pieces`` (prefix fields), ``rds``, ``names`` (trimmed) and ``parts`` (message); drop misses.

    The regex results leave through a generator.  Optimizer rules push filters
    below projections by copying the expressions they use, which would run the
    regexes a second time; nothing is copied through a generator.
    """
    if log_format not in logline.FORMATS:
        raise ValueError(f"unknown log format: {log_format}")
    keep = [F.col(c) for c in lines.columns if c != "value"]
    # Both prefixes start with digits, so the patterns themselves turn away what
    # candidate_lines drops, at their first character.
    cut = lines.withColumn("_kinds", white_space_in(F.col("value")))
    cut = cut.withColumn("line", strip(F.col("value"), F.col("_kinds")))
    if log_format == "rds":
        cut = cut.withColumn("_default", F.array().cast("array<string>"))
    else:
        cut = cut.withColumn("_default", logline.default_pieces(F.col("line")))
    is_default = logline.matched(F.col("_default"))
    if log_format == "default":
        cut = cut.withColumn("_pieces", F.when(is_default, F.col("_default")))
    else:
        cut = cut.withColumn(
            "_pieces",
            F.when(is_default, F.col("_default")).otherwise(logline.rds_pieces(F.col("line"))),
        )
    message = F.col("_message")
    cut = (
        cut.withColumn("_message", F.get(F.col("_pieces"), F.lit(6)))
        .withColumn("_timed", logline.timed_statement(message))
        .withColumn("_executed", logline.executed_statement(message))
    )
    found = F.struct(
        F.col("_pieces").alias("pieces"),
        (~is_default).alias("rds"),
        # Each name is compared and shown; here it is trimmed once.
        F.struct(*[strip(_piece(i, "_pieces"), F.col("_kinds")).alias(f"n{i}") for i in (2, 3, 4)]).alias("names"),
        logline.message_parts(message, F.col("_timed"), F.col("_executed")).alias("parts"),
    )
    hits = F.when(logline.matched(F.col("_pieces")), F.array(found))
    return cut.select(*keep, F.inline(hits))


def _piece(i: int, pieces: str = "pieces") -> Column:
    return F.get(F.col(pieces), F.lit(i))


def entry_columns() -> dict[str, Column]:
    """Named entry columns over the output of :func:`line_pieces`."""
    form = F.col("parts.form")
    message = _piece(6)
    return {
        "ts": logline.timestamp(_piece(0)),
        "process_id": _piece(1),
        "user": logline.present(F.col("names.n2")),
        "database": logline.present(F.col("names.n3")),
        "client_host": F.when(F.col("rds"), logline.rds_host(_piece(4))),
        "application_name": F.when(~F.col("rds"), logline.present(F.col("names.n4"))),
        "level": F.when(form == "statement", "STATEMENT")
        .when(form == "duration", "DURATION")
        .otherwise(F.upper(_piece(5))),
        "message": F.when(
            form == "statement", F.concat(F.lit("statement: "), F.col("parts.statement"))
        ).otherwise(message),
        "statement": F.col("parts.statement"),
        "duration_ms": F.col("parts.duration_text").try_cast("double"),
    }


def parse_lines(lines: DataFrame, log_format: str = "auto", kind: str | None = None) -> DataFrame:
    """Parse lines into entries, keeping the caller's position columns.

    A line whose prefix matches but whose timestamp is no calendar date keeps a
    NULL ``ts``; ``sources.files`` turns such lines into a file-level error.
    """
    passed = [c for c in lines.columns if c != "value"]
    pieces = line_pieces(lines, log_format)
    return pieces.select(
        *passed,
        F.lit(kind or source_kind(log_format)).alias("source_kind"),
        *[column.alias(name) for name, column in entry_columns().items()],
    )
