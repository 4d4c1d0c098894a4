from __future__ import annotations

from conftest_llm import canonical_rows, duck_rows
from pyspark.sql import functions as F

from querylens.llm import mixing as m

COLUMNS = "doc_id, source, lang, topic, n_tokens, probability, sampled"


def test_odd_rows_equal_sql(odd):
    rows, df = odd
    assert canonical_rows(m.sampled(df).collect()) == canonical_rows(duck_rows(rows, m.OP1_SQL, COLUMNS))


def test_no_rows(none):
    assert m.sampled(none).collect() == []


def test_margins_meet_their_targets(small):
    """Where no probability is cut at 1, expected tokens have the wanted shares."""
    tokens = m.tokens_and_cells(small[1]).cache()
    want = {"source": {f"src{i}": 1.0 + i % 2 for i in range(20)}, "lang": {"en": 4.0, "de": 1.0, "fr": 1.0, "es": 1.0}}
    cells = m.raked_cells(tokens, keep=0.05, evenness=0.9, weights=want, rounds=40).cache()
    assert cells.agg(F.max("probability")).first()[0] < 1
    for margin, weights in want.items():
        got = dict(cells.groupBy(margin).agg(F.sum(F.expr("tokens * probability"))).collect())
        seen = sum(weights[k] for k in got)
        for key, value in got.items():
            assert abs(value / sum(got.values()) - weights[key] / seen) < 0.01, (margin, key)


def test_sample_follows_probabilities(small):
    rows = m.sampled(small[1], keep=0.5).collect()
    expected = sum(r.probability for r in rows)
    assert abs(sum(r.sampled for r in rows) - expected) < 4 * len(rows) ** 0.5
    assert all(0 <= r.probability <= 1 for r in rows)
