from __future__ import annotations

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest_llm import SMALL, canonical_rows, duck_rows

from querylens.llm import spelling as s

RUN = re.compile("[A-Za-zÀ-ÿ]+")
COLUMNS = "word, form, root, n, n_near, form_n"


def brute_counts(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def edited(word, letters):
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            yield from (word[:i] + c + word[i + 1 :] for c in letters)


def brute_groups(counts):
    letters = set("".join(counts))
    near = {w: {x for x in edited(w, letters) if x in counts and x != w} for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), None if form[w] is None else counts[form[w]]))
    return canonical_rows(out)


def of(df):
    return canonical_rows(s.spelling_groups(s.counted_words(s.occurrences(df))).collect())


def test_tables(odd, small, none):
    for rows, df in (odd, small):
        assert of(df) == brute_groups(brute_counts(rows))
    assert of(none) == []


def test_query(spark, small):
    found = s.op12_spelling(spark, SMALL)
    assert found.columns == COLUMNS.split(", ")
    rows = canonical_rows(found.collect())
    assert rows == canonical_rows(duck_rows(small[0], s.OP12_SQL, COLUMNS))
    assert any(r[1] for r in rows)


@pytest.mark.parametrize("parts", [3, 4, 6])
def test_random_words(spark, parts):
    """Few letters, so that many words are near, and long and accented ones."""
    random = np.random.default_rng(parts)
    words = {"".join(random.choice(list("abé÷"), int(random.integers(7, 10)))) for _ in range(1500)}
    base = "lengthyword" * 40
    words |= {base, base[:200] + base[201:], base[:-1] + "ß", "x" + base, "aaaaaaa" * 30, "aaaaaaa" * 30 + "a"}
    counts = {w: int(random.choice([2, 3, 25, 40, 300, 4000])) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    assert canonical_rows(s.spelling_groups(df, parts).collect()) == brute_groups(counts)


def test_chains_reach_the_last_form(spark):
    word = "abcdefghijklmnop"
    counts = {word[: 16 - k]: 10**k for k in range(10)} | {"zzzzzzz": 5}
    df = spark.createDataFrame([(w, n) for w, n in counts.items()], "word string, n bigint")
    rows = canonical_rows(s.spelling_groups(df).collect())
    assert rows == brute_groups(counts)
    assert {r[2] for r in rows} == {"abcdefg", "zzzzzzz"}


def test_near_words_share_a_key():
    """Every kind of edit at every place, whatever parts the letters fall to."""
    random = np.random.default_rng(2)
    for _ in range(20):
        w = "".join(random.choice(list("abcdefghijklmnopqrstuvwxyzé"), int(random.integers(7, 15))))
        others = list({x for x in edited(w, "aqé") if len(x) >= 7 and x != w})
        keys = s.signature_keys([w, *others])
        half = keys.shape[1] // 2
        for k, x in enumerate(others, 1):
            shorter, longer = sorted(((len(w), 0), (len(x), k)))
            ours, theirs = keys[shorter[1]], keys[longer[1]]
            assert set(ours[:half]) & set(theirs[half:] if shorter[0] < longer[0] else theirs[:half])


def test_sql_crc_is_the_contracts():
    found = duckdb.sql("WITH documents AS (SELECT 17 AS doc_id, 'Elephants elephants elephantz' AS text) " + "SELECT * FROM (" + s.OP12_SQL + ")")
    assert canonical_rows(found.fetchall()) == brute_groups(brute_counts([(17, "Elephants elephants elephantz")]))
