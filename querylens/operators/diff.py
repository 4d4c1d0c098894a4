"""Baseline against target: which query families got slower."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.operators.families import (
    IDENTITY,
    SCHEMA_VERSION,
    confidence,
    correlation_codes,
    evidence_of,
    family_id,
    family_struct,
    follow_up,
    labelled,
    landed,
    ranked,
    shape_dictionary,
)
from querylens.operators.percentiles import value_profile
from querylens.session import bounded, settled

FAMILY = (*IDENTITY, "normalized_sql")
METRICS = ("execution_count", "total_duration_ms", "avg_duration_ms", "p95_duration_ms",
           "max_duration_ms")


@dataclass(frozen=True)
class DiffOptions:
    limit: int = 10
    min_target_count: int = 1
    min_target_total_ms: float = 0.0
    min_p95_delta_ms: float = 0.0


def window_family_metrics(executions: DataFrame) -> DataFrame:
    """Per window and family: metrics over the executions that have a duration,
    plus how many executions were paired and how many were not."""
    paired = landed(executions)
    return landed_metrics(paired, shape_dictionary(paired))


def landed_metrics(paired: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The same over landed executions.

    Families are told apart by a 128-bit key of identity and canonical text, which
    is what the exchanges carry; the text joins the finished rows.
    """
    texts = dictionary.withColumns(
        {"text_a": F.xxhash64("normalized_sql"), "text_b": F.xxhash64(F.lit(1), "normalized_sql")}
    )
    named = labelled(paired, texts.drop("normalized_sql"))
    rows = named.select(
        "source_window",
        *IDENTITY,
        "text_a",
        "text_b",
        "duration_ms",
        (F.col("confidence") == "Exact").cast("bigint").alias("exact"),
    )
    by_text = texts.select("text_a", "text_b", "normalized_sql").distinct()
    return family_profile(rows, ("text_a", "text_b")).join(by_text, ["text_a", "text_b"]).select(
        "source_window", *FAMILY, *METRICS, "correlated_execution_count", "uncorrelated_execution_count"
    )


def family_profile(rows: DataFrame, text: tuple[str, ...] = ("normalized_sql",), weight: str | None = None) -> DataFrame:
    """Metrics per window, identity and ``text`` of rows with ``duration_ms`` and ``exact``; ``weight`` as in ``value_profile``."""
    # Absent identity fields are never '' themselves, so '' can stand for NULL in join keys.
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in IDENTITY})
    profile = value_profile(
        rows, ["source_window", *IDENTITY, *text], "duration_ms", {"p95": 0.95}, ["exact"], weight
    )

    def or_zero(column: Column) -> Column:
        return F.coalesce(column, F.lit(0.0))

    return profile.select(
        "source_window",
        *[F.nullif(F.col(c), F.lit("")).alias(c) for c in IDENTITY],
        *text,
        F.col("value_count").alias("execution_count"),
        or_zero(F.col("value_total")).alias("total_duration_ms"),
        or_zero(F.try_divide("value_total", "value_count")).alias("avg_duration_ms"),
        or_zero(F.col("p95")).alias("p95_duration_ms"),
        or_zero(F.col("value_max")).alias("max_duration_ms"),
        F.col("exact").alias("correlated_execution_count"),
        (F.col("row_count") - F.col("exact")).alias("uncorrelated_execution_count"),
    )


def family_deltas(metrics: DataFrame) -> DataFrame:
    """Target families beside their baseline (zeros when the baseline has none).

    A left outer join of the windows on the family, written as one conditional
    aggregation so that the log is read and paired once for both windows.
    """

    def of(window: str, metric: str) -> Column:
        return F.max(F.when(F.col("source_window") == window, F.col(metric)))

    sides = (
        metrics.groupBy(*FAMILY)
        .agg(
            F.max((F.col("source_window") == "target").cast("int")).alias("in_target"),
            *[
                F.coalesce(
                    of(window, metric), F.lit(0 if metric == "execution_count" else 0.0)
                ).alias(f"{window}_{metric}")
                for window in ("baseline", "target")
                for metric in METRICS
            ],
            of("target", "correlated_execution_count").alias("correlated_execution_count"),
            of("target", "uncorrelated_execution_count").alias("uncorrelated_execution_count"),
        )
        .where(F.col("in_target") == 1)
        .drop("in_target")
    )
    return sides.select(
        family_id(*[F.col(c) for c in FAMILY]).alias("family_id"),
        "*",
        *[
            (F.col(f"target_{metric}") - F.col(f"baseline_{metric}")).alias(f"delta_{metric}")
            for metric in METRICS
        ],
    )


def flagged(deltas: DataFrame, options: DiffOptions) -> DataFrame:
    """Eligible families that are new, slower at p95 or costlier in total."""
    eligible = deltas.where(
        (F.col("target_execution_count") >= options.min_target_count)
        & (F.col("target_total_duration_ms") >= options.min_target_total_ms)
    )
    rise, p95_rise = F.col("delta_total_duration_ms"), F.col("delta_p95_duration_ms")
    flags = eligible.select(
        "*",
        (F.col("baseline_execution_count") == 0).alias("absent_in_baseline"),
        (
            (p95_rise >= options.min_p95_delta_ms)
            & (F.col("target_p95_duration_ms") > F.col("baseline_p95_duration_ms"))
        ).alias("p95_regressed"),
        (rise > 0).alias("runtime_increased"),
    )
    score = F.when(
        F.col("absent_in_baseline"),
        F.col("target_total_duration_ms") + F.col("target_p95_duration_ms"),
    ).otherwise(F.greatest(rise, F.lit(0.0)) + F.greatest(p95_rise, F.lit(0.0)))
    return flags.where("absent_in_baseline OR p95_regressed OR runtime_increased").withColumn(
        "score", score
    )


def slow_query_diff(executions: DataFrame, options: DiffOptions = DiffOptions()) -> DataFrame:
    """Findings: families that regressed from the baseline to the target window.

    Executions are paired once and kept; metrics, dictionary and evidence read that table.
    """
    paired = landed(executions)
    dictionary = shape_dictionary(paired)
    deltas = family_deltas(landed_metrics(paired, dictionary))
    best = settled(ranked(flagged(deltas, options), "score", options.limit))
    reason = F.concat_ws(
        "; ",
        F.when(F.col("absent_in_baseline"), "absent in baseline"),
        F.when(
            F.col("p95_regressed"),
            F.format_string("p95 increased by %.3f ms", F.col("delta_p95_duration_ms")),
        ),
        F.when(
            F.col("runtime_increased"),
            F.format_string(
                "total runtime increased by %.3f ms", F.col("delta_total_duration_ms")
            ),
        ),
    )
    codes = F.array_compact(
        F.array(
            F.lit("meets_eligibility_thresholds"),
            F.when(F.col("absent_in_baseline"), "absent_in_baseline"),
            F.when(F.col("p95_regressed"), "p95_regressed"),
            F.when(F.col("runtime_increased"), "runtime_contribution_increased"),
            *correlation_codes(),
        )
    )

    def side(name: str) -> Column:
        return F.struct(*[F.col(f"{name}_{m}").alias(m) for m in METRICS]).alias(name)

    target = paired.where(F.col("source_window") == "target")
    return (
        evidence_of(best, options.limit, target, dictionary)
        .join(bounded(best, options.limit), "family_id")
        .select(
            F.lit(SCHEMA_VERSION).alias("schema_version"),
            F.concat(F.lit("slow_query_diff:"), F.col("family_id")).alias("finding_id"),
            F.lit("slow_query_regression").alias("kind"),
            "rank",
            F.lit("Query family regressed in target window").alias("title"),
            reason.alias("reason"),
            codes.alias("reason_codes"),
            "score",
            family_struct().alias("query_family"),
            F.struct(
                F.col("target_execution_count").alias("execution_count"),
                F.col("target_total_duration_ms").alias("total_duration_ms"),
                F.col("target_avg_duration_ms").alias("avg_duration_ms"),
                F.col("target_max_duration_ms").alias("max_duration_ms"),
                "correlated_execution_count",
                "uncorrelated_execution_count",
            ).alias("metrics"),
            side("baseline"),
            side("target"),
            side("delta"),
            "evidence",
            confidence().alias("confidence"),
            follow_up().alias("next_sql"),
        )
        .orderBy("rank")
    )
