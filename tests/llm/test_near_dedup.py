from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pytest
from conftest_llm import canonical_rows

from querylens.llm import near_dedup as n

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, percent):
    sets = []
    for i, t, *_ in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda c: c.group().lower(), t or ""))
        sets.append((i, frozenset(zip(*[w[j:] for j in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations([s for s in sets if s[0] is not None and s[1]], 2):
        same = len(a & b)
        if 100 * same >= percent * (len(a) + len(b) - same):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return canonical_rows(
        (i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets
    )


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_tables(odd, small, k, percent):
    for rows, df in (odd, small):
        assert canonical_rows(n.near_classes(df, k, percent).collect()) == brute(rows, k, percent)


def test_no_rows(none):
    assert n.near_classes(none).collect() == []


def chained(count, seed=1):
    """Texts in which each has a few words other than the one before: long chains of links, none between far ones."""
    random = np.random.default_rng(seed)
    words = [f"w{x}" for x in random.integers(0, 10**6, 60)]
    rows = []
    for i in range(count):
        rows.append((i, " ".join(words)))
        words[int(random.integers(0, 60))] = f"v{random.integers(0, 10**6)}"
    return rows


@pytest.mark.parametrize("small", [400, 4, 1])
def test_chains_need_more_rounds(spark, monkeypatch, small):
    """All links are found whether open buckets are compared whole or hub by hub."""
    monkeypatch.setattr(n, "SMALL", small)
    rows = chained(40)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert canonical_rows(n.near_classes(df, 3, 85).collect()) == brute(rows, 3, 85)


def family(count, seed=2):
    """Pages of one template that are alike by less than the limit, and a few pairs and chains that are linked."""
    random = np.random.default_rng(seed)
    template = [f"t{i}" for i in range(80)]
    rows = []
    for i in range(count):
        own = [f"p{x}" for x in random.integers(0, 10**9, 16)]
        rows.append((i, " ".join(template + own)))
        if i % 90 == 0:
            rows.append((count + i, " ".join(template + own[:-1] + [f"q{i}"])))
            rows.append((count + i + 1, " ".join(template + own[:-3] + [f"r{i}", "s", f"q{i}"])))
    return rows


def test_many_unlinked_members(spark, monkeypatch):
    """A thousand members of a bucket that are linked with nearly nobody: a fixed number of rounds."""
    rows = family(1000)
    rounds = [0]
    verified = n.verified
    monkeypatch.setattr(n, "verified", lambda *a: rounds.append(1) or verified(*a))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    sets = n.full_sets(df, df.select(df.doc_id.alias("id")), 3)
    labels = n.linked_nodes(df, sets.selectExpr("7L AS key", "id"), len(rows), 3, 85)
    found = {r.id: r.label for r in labels.collect()}
    expected = {i: c for i, _, c, _ in brute(rows, 3, 85)}
    assert {i: found.get(i, i) for i in expected} == expected
    assert len(set(expected.values())) < len(rows)
    assert sum(rounds) <= 2


def test_grid_compares_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(n, "SMALL", 4)
    pairs = n.in_grid(spark.range(60).selectExpr("7L AS key", "id", "60L AS n_in")).groupBy("key").agg({"id": "collect_set"}).collect()
    met = {p for r in pairs for p in combinations(sorted(r[1]), 2)}
    assert met == set(combinations(range(60), 2))


def test_signature_estimates_similarity():
    random = np.random.default_rng(5)
    x = random.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = np.unique(x[:3000]), np.unique(x[1000:])
    assert abs((n.signature(a) == n.signature(b)).mean() - 0.5) < 0.12


def test_bands_follow_the_limit():
    for percent in (50, 70, 80, 85, 95, 100):
        bands, rows = n.bands_for(percent)
        assert (1 - min(percent / 100, 0.999) ** rows) ** bands <= n.MISSED and bands * rows <= n.COORDINATES
    assert n.bands_for(85) == (32, 6) and n.bands_for(80) == (38, 5)
