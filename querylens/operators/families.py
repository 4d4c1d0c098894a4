"""Query families: grouping, totals, evidence and ranked findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylens.functions.fingerprint import family_sql
from querylens.operators.correlate import EXECUTION_ORDER
from querylens.operators.events import with_shapes
from querylens.operators.next_sql import next_sql
from querylens.session import bounded, computed_once, kept, measured, settled

SCHEMA_VERSION = 1
IDENTITY = ("database", "user", "application_name")
EVIDENCE_LIMIT = 3


def family_id(database: Column, user: Column, application: Column, sql: Column) -> Column:
    """Readable group key; absent parts print as nothing."""
    blank = F.lit("")
    return F.concat(
        F.lit("queryid=|db="), F.coalesce(database, blank),
        F.lit("|user="), F.coalesce(user, blank),
        F.lit("|app="), F.coalesce(application, blank),
        F.lit("|sql="), sql,
    )


def with_family(shaped: DataFrame) -> DataFrame:
    """Add normalized_sql and family_id to rows that carry identity and shape."""
    return with_id(computed_once(shaped, normalized_sql=family_sql()))


def with_id(named: DataFrame) -> DataFrame:
    """Add family_id to rows that carry identity and canonical text."""
    return named.withColumn(
        "family_id",
        family_id(
            F.col("database"), F.col("user"), F.col("application_name"), F.col("normalized_sql")
        ),
    )


def shape_key() -> Column:
    """128-bit stand-in for (parsed, shape) in exchanges over executions."""
    return F.struct(
        F.xxhash64("parsed", "shape").alias("a"), F.xxhash64("shape", "parsed", F.lit(1)).alias("b")
    )


def landed(executions: DataFrame) -> DataFrame:
    """What findings need of the executions, paired once and kept, with their shape keys."""
    columns = ("source_window", *IDENTITY, "parsed", "shape", "duration_ms", "confidence")
    rows = with_shapes(executions).select(*columns, *EXECUTION_ORDER, "evidence")
    return kept(rows.withColumn("shape_key", shape_key()), "paired")


def shape_dictionary(paired: DataFrame) -> DataFrame:
    """Canonical text per distinct shape of landed executions, computed once and kept.

    Each task sends a shape once, however many executions have it: grouped without an
    aggregate, so rows are hashed and not sorted with their text.
    """
    shapes = paired.select("shape_key", "parsed", "shape").distinct()
    return measured(shapes.select("shape_key", family_sql().alias("normalized_sql")))


def labelled(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add normalized_sql through the shape dictionary.

    The dictionary (``shape_dictionary``) is broadcast while it is small, else both sides
    are shuffled by the key; rows carry no text there.
    """
    return rows.join(dictionary, "shape_key")


def family_totals(executions: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Counts and durations per family.

    Aggregated by shape first (combined before the exchange, so a family holding
    most rows costs a few rows per task), then by canonical text.  With a
    ``dictionary`` the executions are landed ones, and no text is exchanged but
    that of the aggregated families.
    """
    exact = (F.col("confidence") == "Exact").cast("bigint")
    shape = ("parsed", "shape") if dictionary is None else ("shape_key",)
    executions = with_shapes(executions) if dictionary is None else executions
    shaped = executions.groupBy(*IDENTITY, *shape).agg(
        F.count(F.lit(1)).alias("execution_count"),
        F.sum("duration_ms").alias("total_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"),
        F.sum(exact).alias("correlated_execution_count"),
    )
    named = with_family(shaped) if dictionary is None else with_id(labelled(shaped, dictionary))
    return (
        named
        .groupBy("family_id", *IDENTITY, "normalized_sql")
        .agg(
            F.sum("execution_count").alias("execution_count"),
            F.coalesce(F.sum("total_duration_ms"), F.lit(0.0)).alias("total_duration_ms"),
            F.coalesce(F.max("max_duration_ms"), F.lit(0.0)).alias("max_duration_ms"),
            F.sum("correlated_execution_count").alias("correlated_execution_count"),
        )
        .withColumn(
            "uncorrelated_execution_count",
            F.col("execution_count") - F.col("correlated_execution_count"),
        )
    )


def first_by(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], n: int) -> DataFrame:
    """First ``n`` rows per group; each task drops the others before the exchange."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(window)).where(F.col("_row") <= n).drop("_row")


def family_evidence(executions: DataFrame, limit: int = EVIDENCE_LIMIT) -> DataFrame:
    """First source references per family, in execution order.

    ``limit`` executions always cover ``limit`` references.
    """
    shaped = with_shapes(executions).select(*IDENTITY, "parsed", "shape", *EXECUTION_ORDER, "evidence")
    early = first_by(shaped, (*IDENTITY, "parsed", "shape"), EXECUTION_ORDER, limit)
    early = first_by(with_family(early), ("family_id",), EXECUTION_ORDER, limit)
    return gathered_evidence(early, limit)


def confidence() -> Column:
    return (
        F.when(F.col("uncorrelated_execution_count") == 0, "high")
        .when(F.col("correlated_execution_count") > 0, "medium")
        .otherwise("low")
    )


def correlation_codes() -> list[Column]:
    return [
        F.when(F.col("correlated_execution_count") > 0, "correlated_duration"),
        F.when(F.col("uncorrelated_execution_count") > 0, "partial_correlation"),
    ]


def family_struct() -> Column:
    return F.struct(
        F.col("family_id").alias("query_family_id"),
        F.col("normalized_sql"),
        F.lit(None).cast("string").alias("queryid"),
        *IDENTITY,
    )


def follow_up() -> Column:
    return next_sql(
        F.col("normalized_sql"),
        F.lit(None).cast("string"),
        *[F.col(c) for c in IDENTITY],
    )


def ranked(df: DataFrame, score: str, limit: int) -> DataFrame:
    """Best ``limit`` rows by score, ties by family id, numbered from 1."""
    best = df.orderBy(F.desc(score), F.asc("family_id")).limit(limit)
    numbering = Window.orderBy(F.desc(score), F.asc("family_id"))
    return best.withColumn("rank", F.row_number().over(numbering))


def evidence_of(best: DataFrame, limit: int, paired: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Evidence of the chosen families (at most ``limit``) only.

    Their shapes are found in the dictionary first, so executions of other
    families are dropped where they are read.
    """
    null_safe = [F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in IDENTITY]
    few = bounded(best.select("normalized_sql", "family_id", *null_safe), limit)
    chosen = measured(
        dictionary.join(few, "normalized_sql").select("shape_key", "family_id", *[f"_{c}" for c in IDENTITY])
    )
    rows = paired.select("shape_key", *null_safe, *EXECUTION_ORDER, "evidence").join(
        chosen, ["shape_key", *[f"_{c}" for c in IDENTITY]]
    )
    early = first_by(rows, ("family_id",), EXECUTION_ORDER, EVIDENCE_LIMIT)
    return gathered_evidence(early, EVIDENCE_LIMIT)


def gathered_evidence(early: DataFrame, limit: int) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(*EXECUTION_ORDER, "evidence")))
    return early.groupBy("family_id").agg(
        F.slice(F.flatten(F.transform(ordered, lambda e: e["evidence"])), 1, limit).alias(
            "evidence"
        )
    )


def top_query_families(executions: DataFrame, limit: int = 10) -> DataFrame:
    """Findings: families ranked by total runtime.

    Executions are paired once and kept; totals, dictionary and evidence read that table.
    """
    paired = landed(executions)
    dictionary = shape_dictionary(paired)
    best = settled(ranked(family_totals(paired, dictionary), "total_duration_ms", limit))
    total, peak = F.col("total_duration_ms"), F.col("max_duration_ms")
    reason = F.format_string(
        "%d executions contributed %.3f ms total runtime; max execution was %.3f ms",
        F.col("execution_count"), total, peak,
    )
    codes = F.array_compact(
        F.array(F.lit("high_total_duration"), F.lit("high_max_duration"), *correlation_codes())
    )
    missing = F.lit(None).cast(
        "struct<execution_count:bigint,total_duration_ms:double,avg_duration_ms:double,"
        "p95_duration_ms:double,max_duration_ms:double>"
    )
    return (
        evidence_of(best, limit, paired, dictionary)
        .join(bounded(best, limit), "family_id")
        .select(
            F.lit(SCHEMA_VERSION).alias("schema_version"),
            F.concat(F.lit("query_family:"), F.col("family_id")).alias("finding_id"),
            F.lit("query_family").alias("kind"),
            "rank",
            F.lit("Query family with high total runtime").alias("title"),
            reason.alias("reason"),
            codes.alias("reason_codes"),
            total.alias("score"),
            family_struct().alias("query_family"),
            F.struct(
                "execution_count",
                "total_duration_ms",
                (total / F.col("execution_count")).alias("avg_duration_ms"),
                "max_duration_ms",
                "correlated_execution_count",
                "uncorrelated_execution_count",
            ).alias("metrics"),
            missing.alias("baseline"),
            missing.alias("target"),
            missing.alias("delta"),
            "evidence",
            confidence().alias("confidence"),
            follow_up().alias("next_sql"),
        )
        .orderBy("rank")
    )
