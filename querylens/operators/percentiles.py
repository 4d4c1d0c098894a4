"""Exact nearest-rank percentiles that never sort a whole group in one task.

The rank rule is ``sorted[min(floor(n * p), n - 1)]``, which none of the built-in
percentile functions follows.  Steps, for any number of groups of any size:

1. count equal values (map-side combined, spread over groups AND values);
2. add the counts up per bin of a fixed monotone scale; a group has at most some
   hundred thousand bins however many rows it holds;
3. a running sum over the bins of each group finds the bin of each rank;
4. only the values of those bins are ranked.

The same bins give count, total, minimum and maximum, so a metrics query needs no
second aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylens.session import beside, computed_once, settled

BINS_PER_E_FOLD = 16384.0


def scale_bin(value: Column) -> Column:
    """Monotone bin number: 0.006 % wide, plain steps around zero."""
    magnitude = F.least(F.log1p(F.abs(value)) * F.lit(BINS_PER_E_FOLD), F.lit(1e9))
    return F.floor(F.when(value < 0, -magnitude).otherwise(magnitude)).cast("bigint")


def check_probabilities(probabilities: Mapping[str, float]) -> None:
    for p in probabilities.values():
        if not 0.0 <= p <= 1.0:
            raise ValueError(f"Invalid percentile: {p}")


def value_profile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    flags: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Per group: row_count, value_count, value_total, value_min, value_max, one
    column per named probability, and the number of rows with each 0/1 flag set.

    Keys must not be NULL.  NULL values count for row_count and flags only.  With
    no keys the result is one row, or none for an empty input.  ``weight`` names a column
    that says how many rows a row stands for.

    Flags take part in the first grouping and bins pass a generator, so both uses
    of the value counts have the same plan below.  Whether they then read one
    exchange is up to the optimizer: with keys that a projection renames it plans
    two, so callers with large inputs hand in rows that were kept.
    """
    check_probabilities(probabilities)
    keys, flags = list(keys), list(flags)
    group = keys or ["_all"]
    if not keys:
        df = df.withColumn("_all", F.lit(0))

    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = df.groupBy(*group, F.col(value).alias("_value"), *flags).agg(rows.alias("_n"))
    counted = computed_once(counted, _bin=scale_bin(F.col("_value")))
    counted = settled(counted)
    bars = counted.groupBy(*group, "_bin").agg(
        F.sum("_n").alias("_rows"),
        F.sum(F.when(F.col("_value").isNotNull(), F.col("_n")).otherwise(F.lit(0))).alias("_n"),
        F.sum(F.col("_value") * F.col("_n")).alias("_total"),
        F.min("_value").alias("_min"),
        F.max("_value").alias("_max"),
        *[F.sum(F.col(flag) * F.col("_n")).alias(flag) for flag in flags],
    )
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bars = bars.withColumn("_count", F.sum("_n").over(whole)).withColumn(
        "_reached", F.sum("_n").over(upto)
    )
    aims = []
    for name, p in probabilities.items():
        rank = F.least(
            F.floor(F.col("_count") * F.lit(float(p))).cast("bigint"), F.col("_count") - 1
        )
        here = (F.col("_reached") > rank) & (F.col("_reached") - F.col("_n") <= rank)
        aims += [
            F.max(F.when(here, F.col("_bin"))).alias(f"_bin_{name}"),
            F.max(F.when(here, rank - (F.col("_reached") - F.col("_n")))).alias(f"_skip_{name}"),
        ]
    heads = bars.groupBy(*group).agg(
        F.sum("_rows").alias("row_count"),
        F.sum("_n").alias("value_count"),
        F.sum("_total").alias("value_total"),
        F.min("_min").alias("value_min"),
        F.max("_max").alias("value_max"),
        *[F.sum(flag).alias(flag) for flag in flags],
        *aims,
    )
    wanted = heads.select(
        *group,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("_name"),
                        F.col(f"_bin_{name}").alias("_bin"),
                        F.col(f"_skip_{name}").alias("_skip"),
                    )
                    for name in probabilities
                ]
            )
        ),
    ).where(F.col("_bin").isNotNull())
    if not keys:
        # One row for each probability.
        wanted = F.broadcast(wanted)
    inside = (
        Window.partitionBy(*group, "_name")
        .orderBy("_value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    picked = (
        counted.select(*group, "_bin", "_value", "_n")
        .join(wanted, [*group, "_bin"])
        .withColumn("_reached", F.sum("_n").over(inside))
        .where(
            (F.col("_reached") > F.col("_skip"))
            & (F.col("_reached") - F.col("_n") <= F.col("_skip"))
        )
        .groupBy(*group)
        .agg(
            *[
                F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name)
                for name in probabilities
            ]
        )
    )
    if not keys:
        # Both sides are one row: a scalar beside the other needs no regrouping.
        one = picked.agg(*[F.max(name).alias(name) for name in probabilities])
        columns = ["row_count", "value_count", "value_total", "value_min", "value_max"]
        return beside(heads.drop("_all"), one).select(*columns, *probabilities, *flags)
    named = [*keys, "row_count", "value_count", "value_total", "value_min", "value_max"]
    named += [*probabilities, *flags]
    return (
        heads.select(*group, *[c for c in named if c in heads.columns and c not in group])
        .unionByName(picked, allowMissingColumns=True)
        .groupBy(*group)
        .agg(*[F.max(c).alias(c) for c in named if c not in group])
        .select(*named)
    )
