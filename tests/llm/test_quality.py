from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest

from querylens.llm import quality as q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    rows = q.op2_quality(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return rows, labels


def test_held_out_accuracy(scored):
    rows, labels = scored
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_odd_rows_and_labels(spark, odd):
    rows, df = odd
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(1, 19) if i] + [(1, 0), (1, 1), (None, 1), (2, None)], "doc_id bigint, quality int"
    )
    model = q.fit_quality(df, labels)
    assert q.quality_scores(df, model).count() == len(rows)
    kept = q.accepted(df, model)
    assert kept.columns == df.columns and kept.count() <= len(rows)


def test_without_labels(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id bigint, quality int")
    model = q.fit_quality(odd[1], empty)
    assert {r.score for r in q.quality_scores(odd[1], model).collect()} == {0.5}
    assert q.quality_scores(none, q.fit_quality(none, empty)).collect() == []
    ones = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id bigint, quality int")
    assert all(r.predicted == 1 for r in q.quality_scores(odd[1], q.fit_quality(odd[1], ones)).collect())


def test_compiled_score_equals_numpy(spark):
    random = np.random.default_rng(1)
    x = random.normal(size=(400, 3))
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5)).astype(float)
    model = q.fit(["a", "b", "c"], x, y)
    assert model.rules
    from pyspark.sql import functions as F

    df = spark.createDataFrame(x[:50].tolist(), "a double, b double, c double").select(F.struct("a", "b", "c").alias("stats"), "a")
    got = [r[0] for r in df.select(model.score()).collect()]
    total = np.full(50, model.bias)
    for rule, weight in model.rules:
        holds = np.all([(x[:50, "abc".index(n)] > t) == above for n, above, t in rule], axis=0)
        total += weight * holds
    assert np.allclose(sorted(got), sorted(1 / (1 + np.exp(-total))))
    assert np.mean((np.array(sorted(got)) >= 0.5)) == pytest.approx(y[:50].mean(), abs=0.1)


def brute_statistics(text):
    n = max(len(text), 1)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    some = max(len(words), 1)

    def share(pattern):
        return len(re.findall(pattern, text)) / n

    parts, lines = text.split(" "), text.split("\n")
    return {
        "log_chars": math.log10(n), "word_chars": (n - share(r"[\x20\x09-\x0D]") * n) / some, "upper": share("[A-Z]"),
        "bangs": share("[!?]"), "bars": share(r"[|<>{}\[\]\\/_*#=]"), "digits": share("[0-9]"),
        "stops": len(re.findall(r"[.!?](?=[ \t\n\x0b\f\r]|\Z|\n\Z)", text)) / some, "commas": share("[,;:]"), "lines": len(lines) / some,
        "distinct_words": math.log1p(len(set(parts))) / math.log1p(len(parts)), "distinct_lines": len(set(lines)) / len(lines),
    }


def test_scores_of_documents_by_rules_in_python(spark, small, odd):
    """Statistics and the compiled score of every document against loops over the same rules."""
    model = q.fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert model.rules
    for rows, df in (small, odd):
        texts = [(i, t or "") for i, t, *_ in rows]
        want = []
        for i, text in texts:
            stats = brute_statistics(text)
            total = model.bias + sum(w for rule, w in model.rules if all((stats[n] > v) == above for n, above, v in rule))
            want.append((i, 1 / (1 + math.exp(-total))))
        got = sorted(((r.doc_id, r.score) for r in q.quality_scores(df, model).collect()), key=repr)
        for (i, a), (j, b) in zip(got, sorted(want, key=repr)):
            assert i == j and abs(a - b) < 1e-6
