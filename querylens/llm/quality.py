"""Quality classifier: a sparse rule ensemble over text statistics, compiled into column expressions.

Statistics of whole texts are column expressions. On a bounded sample of labelled rows small trees are grown in
numpy; every path from a root is a conjunctive rule; a lasso logistic regression keeps few of them with weights;
and the score is a column expression over the statistics again, so no Python runs on the executors.

Labels come only from rows outside the held-out third, at most ``SAMPLE_ROWS`` of them, chosen by a hash of the
id. Null and empty texts have all statistics 0 and are scored like any others. Documents with conflicting or
repeated labels count once, with the lowest. Without labels of both classes every score is the share of label 1
(0.5 without any). Each row of the table gives one row; other columns than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.llm.common import WORD, bucket_of, documents, whole_text
from querylens.session import computed_once

SAMPLE_ROWS = 6000
FOLDS, HELD_OUT = 3, 1
TREES, DEPTH, LEAST_LEAF = 24, 3, 15
PENALTY = 0.002

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, above, threshold), all of which must hold


def statistics() -> dict[str, Column]:
    """Statistics of a text column named ``_text``."""
    text = F.col("_text")
    n = F.greatest(F.length(text), F.lit(1))
    words = F.regexp_count(text, F.lit(WORD))
    some = F.greatest(words, F.lit(1))
    parts, lines = F.split(text, " "), F.split(text, "\n")

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / n

    return {
        "log_chars": F.log10(n),
        "word_chars": (n - share(r"[\x20\x09-\x0D]") * n) / some,
        "upper": share("[A-Z]"),
        "bangs": share("[!?]"),
        "bars": share(r"[|<>{}\[\]\\/_*#=]"),
        "digits": share("[0-9]"),
        "stops": F.regexp_count(text, F.lit(r"[.!?](?=[\s]|$)")) / some,
        "commas": share("[,;:]"),
        "lines": F.size(lines) / some,
        # On a log scale, so that long texts, which repeat words anyway, are not set apart by length.
        "distinct_words": F.log1p(F.size(F.array_distinct(parts)).cast("double")) / F.log1p(F.size(parts).cast("double")),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``stats``, a struct, computed once for each row."""
    columns = statistics()
    bare = docs.select("doc_id", whole_text().alias("_text"))
    return computed_once(bare, stats=F.struct(*[c.cast("double").alias(n) for n, c in columns.items()])).select("doc_id", "stats")


def training_labels(labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids outside the held-out third, the same ones every time."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (bucket_of("doc_id", FOLDS) != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )


def _grown(x: np.ndarray, y: np.ndarray, rows: np.ndarray, features: np.ndarray, depth: int, path: tuple) -> list[tuple]:
    """Paths below a node: each split that lowers the Gini impurity most, and so on down."""
    best = (1e-6, None, None)
    for f in features:
        order = rows[np.argsort(x[rows, f], kind="stable")]
        v, ones = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        cut = cut[(cut >= LEAST_LEAF) & (len(rows) - cut >= LEAST_LEAF)]
        if not len(cut):
            continue
        left, right = ones[cut - 1], ones[-1] - ones[cut - 1]
        p, q = left / cut, right / (len(rows) - cut)
        after = cut * p * (1 - p) + (len(rows) - cut) * q * (1 - q)
        share = ones[-1] / len(rows)
        gain = len(rows) * share * (1 - share) - after
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, (v[cut[k] - 1] + v[cut[k]]) / 2)
    _, f, t = best
    if f is None:
        return []
    out = []
    for above in (False, True):
        here = (*path, (int(f), above, float(t)))
        out.append(here)
        if depth > 1:
            out += _grown(x, y, rows[(x[rows, f] > t) == above], features, depth - 1, here)
    return out


def grown_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[tuple]:
    """Distinct paths of trees on random halves of rows and features."""
    random, rules = np.random.default_rng(seed), {}
    for _ in range(TREES):
        rows = random.permutation(len(x))[: max(len(x) // 2, min(len(x), 4 * LEAST_LEAF))]
        features = random.permutation(x.shape[1])[: max(3, x.shape[1] // 2)]
        for path in _grown(x, y, rows, features, DEPTH, ()):
            rules.setdefault(tuple(sorted(path)))
    return list(rules)


def satisfied(x: np.ndarray, rules: list[tuple]) -> np.ndarray:
    return np.stack([np.all([(x[:, f] > t) == above for f, above, t in r], axis=0) for r in rules], 1).astype(float)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 1500) -> tuple[float, np.ndarray]:
    """Weights by accelerated proximal gradient steps; the bias is free. Classes weigh alike."""
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    size = 4 / max(np.linalg.eigvalsh((z * weight[:, None]).T @ z)[-1] + 1, 1e-9)
    bias, w = 0.0, np.zeros(z.shape[1])
    at_bias, at, t = bias, w, 1.0
    for _ in range(steps):
        error = weight * (1 / (1 + np.exp(-np.clip(z @ at + at_bias, -40, 40))) - y)
        new_bias = at_bias - size * error.sum()
        step = at - size * (z.T @ error)
        new = np.sign(step) * np.maximum(np.abs(step) - size * penalty, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        at = new + (t - 1) / t_new * (new - w)
        at_bias = new_bias + (t - 1) / t_new * (new_bias - bias)
        bias, w, t = new_bias, new, t_new
    return bias, w


@dataclass(frozen=True)
class RuleEnsemble:
    """A bias and weighted conjunctive rules over named statistics."""

    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stats: str = "stats") -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, above, threshold in rule:
                value = F.col(f"{stats}.{name}")
                holds = holds & (value > threshold if above else value <= threshold)
            total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(names: list[str], x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y) or not (rules := grown_rules(x, y)):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    bias, weights = lasso_logistic(satisfied(x, rules), y)
    named = [(tuple((names[f], a, t) for f, a, t in r), float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-4]
    return RuleEnsemble(float(bias), tuple(named))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Fit on the sample: at most ``rows`` rows of a dozen numbers come to the driver."""
    sample = training_labels(labels, "quality", rows)
    stats = with_statistics(docs.join(F.broadcast(sample), "doc_id").select("doc_id", "text"))
    table = stats.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "stats.*").orderBy("doc_id").limit(rows).toPandas()
    names = list(statistics())
    return fit(names, table[names].to_numpy(float), table["label"].to_numpy(float))


def quality_scores(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    held_out = F.coalesce(bucket_of("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return (
        with_statistics(docs)
        .select("doc_id", held_out.alias("held_out"), model.score().alias("score"))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def accepted(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """The rows, with all their columns, that the model scores 0.5 or more."""
    rows = docs.select(F.struct("*").alias("_row"), whole_text().alias("_text"))
    stats = F.struct(*[c.cast("double").alias(n) for n, c in statistics().items()])
    return computed_once(rows, _stats=stats).where(model.score("_stats") >= 0.5).select("_row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_scores(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
