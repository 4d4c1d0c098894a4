from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from conftest_llm import SMALL, WORD, canonical_rows

from querylens.llm import periodic_runs as p


def stretches(ids, d):
    i = 0
    while i < len(ids) - d:
        j = i
        while j < len(ids) - d and ids[j] == ids[j + d]:
            j += 1
        if j > i:
            yield i, j - i + d
        i = max(j, i) + 1


def brute_runs(ids, least=24):
    """Every period, shortest first; a stretch found with a shorter one is not a run of a longer."""
    found, seen = [], set()
    for d in range(1, len(ids) // 3 + 1):
        for start, length in stretches(ids, d):
            if length >= max(least, 3 * d) and (start, length) not in seen:
                seen.add((start, length))
                found.append((start, length, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def with_periods(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a, g = (h // 10) % n, h // 10
    q = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % q] for i in range(a, n)]


def brute(rows):
    out = []
    for doc_id, text, *_ in rows:
        words = with_periods(doc_id, WORD.findall(text or ""))
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (
            "".join(f"{s},{length},{q}\n" for s, length, q in runs),
            " ".join(w for i, w in enumerate(words) if i not in dropped))]
        numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        out.append((doc_id, len(runs), *numbers, *digest))
    return canonical_rows(out)


def contract(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    columns = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    return canonical_rows(p.op13_periodic_runs(spark, str(tmp_path)).select(*columns).collect())


def test_smallest_table(spark, small):
    columns = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    found = canonical_rows(p.op13_periodic_runs(spark, SMALL).select(*columns).collect())
    assert found == brute(small[0])
    assert sum(r[1] for r in found) > 10


def test_odd_rows(spark, odd, none, tmp_path):
    rows, df = odd
    assert contract(spark, df, tmp_path / "odd") == brute(rows)
    assert contract(spark, none, tmp_path / "none") == []


@pytest.mark.parametrize("letters, size", [(1, 100), (2, 300), (2, 60), (3, 200), (4, 120)])
def test_random_words(letters, size):
    random = np.random.default_rng(letters * 1000 + size)
    for _ in range(40):
        ids = random.integers(0, letters, size)
        # Copy stretches, so that long periods and runs inside runs come up.
        for _ in range(3):
            q, at = int(random.integers(1, size // 4)), int(random.integers(0, size // 2))
            n = int(random.integers(1, size - at))
            ids[at : at + n] = np.resize(ids[at : at + q], n)
        assert p.runs_of(ids) == brute_runs(ids.tolist())
        assert p.runs_of(ids, 6, 2) == brute_runs(ids.tolist(), 6)


def test_runs_inside_runs():
    unit = [0] * 20 + [1] + [0, 2] * 13
    ids = np.array(unit * 7 + [5] + unit[:3])
    found = p.runs_of(ids)
    assert found == brute_runs(ids.tolist())
    assert (0, 7 * len(unit), len(unit)) in found and len(found) == 8


def test_every_period_at_every_place():
    random = np.random.default_rng(3)
    for q in range(1, 70):
        for at in (0, 1, 7, 30):
            n = max(24, 3 * q)
            core = np.resize(random.permutation(q) + 1000, n)
            ids = np.concatenate([np.arange(at) + 5000, core, np.arange(9) + 7000])
            assert p.runs_of(ids) == [(at, n, q)]
            assert p.runs_of(np.delete(ids, at + n - 1)) == []


def test_blocks_too_long_for_the_least_run():
    with pytest.raises(ValueError, match="whole block"):
        p.runs_of(np.zeros(9, np.int64), 20)


def test_transform_counts_squares():
    random = np.random.default_rng(8)
    for width in (1, 2, 8, 64):
        blocks, windows = random.integers(0, 900, (5, width)), random.integers(0, 900, (5, 2 * width))
        blocks[0] = windows[0, width : 2 * width]
        expected = [[((b - w[j : j + width]) ** 2).sum() for j in range(width + 1)] for b, w in zip(blocks, windows)]
        assert p.squared_differences(blocks, windows).tolist() == (np.array(expected) % p.PRIME).tolist()


def test_long_text_of_one_word_and_of_many():
    assert p.runs_of(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert p.runs_of(np.arange(200_000)) == []
    ids = np.tile(np.arange(50_000), 4)
    assert p.runs_of(ids) == [(0, 200_000, 50_000)]


def test_operator_collapses(spark):
    words = [f"w{i}" for i in range(10)]
    rows = [(1, "a b " + " ".join(words * 4) + " z"), (None, "x " * 40), (3, None)]
    found = {r.doc_id: r for r in p.periodic_runs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[1].collapsed == "a b " + " ".join(words) + " z" and [tuple(r) for r in found[1].runs] == [(2, 40, 10)]
    assert found[None].collapsed == "x" and found[None].n_kept == 1
    assert (found[3].collapsed, found[3].runs) == ("", [])
