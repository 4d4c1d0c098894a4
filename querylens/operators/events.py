"""Log entries -> typed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.functions.fingerprint import bare_text, literal_shape, plausible_bare
from querylens.operators.parse import SOURCE_KINDS
from querylens.session import computed_once


def is_query() -> Column:
    return F.col("level") == "STATEMENT"


def is_duration() -> Column:
    return F.col("level") == "DURATION"


def is_error() -> Column:
    """ERROR only: FATAL and PANIC entries are log events."""
    return F.col("level") == "ERROR"


def event_kind() -> Column:
    return (
        F.when(is_query(), "Statement")
        .when(is_duration(), "Duration")
        .when(is_error(), "Error")
        .otherwise("Log")
    )


def event_id() -> Column:
    """Stable id such as ``stderr:12``."""
    label = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, name in SOURCE_KINDS.items():
        label = label.when(F.col("source_kind") == kind, name)
    return F.concat_ws(":", label, F.col("record_index").cast("string"))


def typed_events(entries: DataFrame) -> DataFrame:
    """One event per entry.

    ``text`` is what message searches see: the statement without its prefix,
    nothing for durations, the message otherwise.  A duration entry without a
    readable number counts as 0 ms.  ``is_sql`` separates SQL statements from
    STATEMENT-level context lines.
    """
    statement = F.when(is_query(), F.coalesce(F.col("statement"), F.col("message")))
    return entries.select(
        "source_window",
        "record_index",
        "source_kind",
        "ts",
        "process_id",
        "user",
        "database",
        "client_host",
        "application_name",
        "level",
        F.col("message").alias("entry_message"),
        event_id().alias("event_id"),
        event_kind().alias("kind"),
        F.lit(None).cast("string").alias("queryid"),
        statement.alias("statement"),
        F.when(is_query(), F.col("statement").isNotNull()).alias("is_sql"),
        F.when(is_query(), F.col("duration_ms"))
        .when(is_duration(), F.coalesce(F.col("duration_ms"), F.lit(0.0)))
        .alias("duration_ms"),
        F.when(is_query(), statement)
        .when(is_duration(), F.lit(""))
        .otherwise(F.col("message"))
        .alias("text"),
    )


def with_shapes(rows: DataFrame) -> DataFrame:
    """Add ``parsed`` and ``shape`` to rows that carry ``statement`` and ``is_sql``.

    ``parsed`` separates SQL statements from context lines and from text that cannot be
    SQL, which keep their text as shape.  Generators are never pruned, so only what
    reads shapes calls this.
    """
    if "shape" in rows.columns:
        return rows
    blanked = F.when(F.col("is_sql"), literal_shape(F.col("statement")))
    rows = computed_once(rows, _blanked=blanked)
    # A generator computes an expression as often as it occurs, so what occurs often is a column of its own.
    rows = computed_once(rows, _bare=bare_text(F.col("_blanked")))
    rows = computed_once(rows, _plausible=F.coalesce(plausible_bare(F.col("_bare")), F.lit(False)))
    named = {
        "parsed": F.when(F.col("statement").isNotNull(), F.col("_plausible")),
        "shape": F.when(F.col("_plausible"), F.col("_blanked")).otherwise(F.col("statement")),
    }
    return rows.withColumns(named).drop("_blanked", "_bare", "_plausible")


def mentions_connection(text: Column) -> Column:
    return F.lower(text).contains("connection")
