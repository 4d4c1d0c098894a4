"""Mixing sources to target weights: bounded raking of token weights, then sampling by calibrated probabilities.

Documents fall into cells by source, language and topic. Iterative proportional fitting scales a sampling
probability per cell until the expected tokens of every source, of every language and of every topic meet
targets; probabilities never pass 1, so a category that is too rare to meet its target is taken whole. A
document is then sampled when a uniform number drawn from its id lies below its cell's probability, so the
sample does not depend on partitioning or on other documents.

A target is a share of the kept tokens: a given weight, or else the observed share to the power ``EVENNESS``
(1 keeps the mix, 0 makes categories alike). The cells are as many as there are combinations of categories,
whatever the number of documents; they stay distributed all the same. Null and empty categories are one
category, ''. Null and empty texts have no tokens and are sampled with their cell. Repeated rows are sampled
alike. A null doc_id draws like the id ''. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylens.llm.common import WORD, documents, join_groups, kept, whole_text
from querylens.session import computed_once

MARGINS = ("source", "lang", "topic")
KEEP, EVENNESS = 0.8, 0.7
ROUNDS, ROUNDS_A_JOB = 12, 4
SEED = "mix-1"


def topic_of(text: Column, tokens: Column) -> Column:
    """Topic by surface form, for tables without one: the first rule that holds."""
    return (
        F.when(F.contains(F.lower(text), F.lit("license")), "legal")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(F.contains(text, F.lit("http")), "web")
        .when(F.contains(text, F.lit(" | ")), "tables")
        .when(tokens < 150, "notes")
        .when(tokens < 600, "articles")
        .otherwise("books")
    )


def tokens_and_cells(docs: DataFrame) -> DataFrame:
    """doc_id, the three categories and the number of tokens (words)."""
    category = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in MARGINS[:2]]
    counted = computed_once(
        docs.select(F.col("doc_id").cast("bigint"), *category, whole_text().alias("_text")),
        n_tokens=F.regexp_count("_text", F.lit(WORD)).cast("bigint"),
    )
    return counted.select("doc_id", *MARGINS[:2], topic_of(F.col("_text"), F.col("n_tokens")).alias("topic"), "n_tokens")


def _target(margin: str, weights: Mapping[str, float] | None, evenness: float) -> Column:
    """A category's weight, not yet a share."""
    if weights is None:
        return F.pow(F.col(f"has_{margin}"), F.lit(evenness))
    value = F.lit(0.0)
    for category, weight in weights.items():
        value = F.when(F.col(margin) == category, F.lit(float(weight))).otherwise(value)
    return value


def raked_cells(
    tokens: DataFrame,
    keep: float = KEEP,
    evenness: float = EVENNESS,
    weights: Mapping[str, Mapping[str, float]] | None = None,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per cell: its categories, documents, tokens and sampling probability."""
    weights = weights or {}
    cells = tokens.groupBy(*MARGINS).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").cast("double").alias("tokens"))
    for m in MARGINS:
        cells = cells.withColumn(f"has_{m}", F.sum("tokens").over(Window.partitionBy(m)))
    for m in MARGINS:
        cells = cells.withColumn(f"want_{m}", _target(m, weights.get(m), evenness))
    cells = kept(cells, "cells")
    # Each cell counts for its share of a category, so a category counts once.
    sums = cells.agg(
        F.sum("tokens").alias("all"),
        *[F.sum(F.col(f"want_{m}") * F.col("tokens") / F.greatest(F.col(f"has_{m}"), F.lit(1e-9))).alias(m) for m in MARGINS],
    ).first()
    total = (sums["all"] or 0.0) * keep
    for m in MARGINS:
        cells = cells.withColumn(f"want_{m}", F.col(f"want_{m}") * F.lit(total / (sums[m] or 1.0)))
    cells = cells.withColumn("p", F.lit(float(keep)))
    for done in range(1, rounds + 1):
        for m in MARGINS:
            now = F.sum(F.col("tokens") * F.col("p")).over(Window.partitionBy(m))
            cells = cells.withColumn("p", F.when(now > 0, F.least(F.lit(1.0), F.col("p") * F.col(f"want_{m}") / now)).otherwise(F.col("p")))
        if done % ROUNDS_A_JOB == 0 or done == rounds:
            cells = kept(cells, "raked")
    return cells.select(*MARGINS, "n_docs", "tokens", F.col("p").alias("probability"))


def draw(seed: str = SEED) -> Column:
    """Uniform number in [0, 1) from the first 52 bits of an id's digest."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def sampled(docs: DataFrame, **settings) -> DataFrame:
    """Per row: doc_id, categories, n_tokens, its cell's probability, and whether it is sampled."""
    tokens = kept(tokens_and_cells(docs), "tokens")
    cells = raked_cells(tokens, **settings)
    total = cells.agg(F.sum("n_docs")).first()[0] or 0
    rows = join_groups(tokens, cells.select(*MARGINS, "n_docs", "probability"), MARGINS, "n_docs", total)
    return rows.select(
        "doc_id", *MARGINS, "n_tokens", F.round("probability", 6).alias("probability"), (draw() < F.col("probability")).alias("sampled")
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(documents(spark, sf_dir))


def _sql() -> str:
    parts = [
        r"""d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents)""",
        """t AS (
  SELECT doc_id, source, lang, n_tokens, CASE WHEN contains(lower(text), 'license') THEN 'legal'
    WHEN contains(text, '@') THEN 'contact' WHEN contains(text, 'http') THEN 'web' WHEN contains(text, ' | ') THEN 'tables'
    WHEN n_tokens < 150 THEN 'notes' WHEN n_tokens < 600 THEN 'articles' ELSE 'books' END AS topic FROM d)""",
        "c0 AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM t GROUP BY ALL)",
        "c1 AS (SELECT *, " + ", ".join(f"sum(tokens) OVER (PARTITION BY {m}) AS has_{m}" for m in MARGINS) + " FROM c0)",
        "s AS (SELECT sum(tokens) AS al, "
        + ", ".join(f"sum(pow(has_{m}, {EVENNESS}) * tokens / greatest(has_{m}, 1e-9)) AS s_{m}" for m in MARGINS)
        + " FROM c1)",
        "r0 AS (SELECT c1.*, "
        + ", ".join(f"pow(has_{m}, {EVENNESS}) * al * {KEEP} / s_{m} AS want_{m}" for m in MARGINS)
        + f", {KEEP}::DOUBLE AS p FROM c1, s)",
    ]
    k = 0
    for _ in range(ROUNDS):
        for m in MARGINS:
            now = f"sum(tokens * p) OVER (PARTITION BY {m})"
            parts.append(
                f"r{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (p), CASE WHEN {now} > 0 THEN least(1.0::DOUBLE, p * want_{m} / {now}) ELSE p END AS p FROM r{k})"
            )
            k += 1
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {1 << 52}::DOUBLE < p AS sampled
FROM t JOIN r{k} USING (source, lang, topic)"""
    )


OP1_SQL = _sql()
