from __future__ import annotations

import re
from collections import Counter

import pytest
from conftest_llm import WORD, canonical_rows, duck_rows

from querylens.llm import quality_rules as q

BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(rows):
    out = []
    for i, text, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        seen = Counter(windows)
        hit = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        n = len(words)
        out.append(
            (i, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
             n < 50 or 100 * len(hit) > 50 * n)
        )
    return canonical_rows(out)


def test_counts(odd, small, none):
    for rows, df in (odd, small):
        assert canonical_rows(q.rule_verdicts(df).select(*BASE).collect()) == brute(rows)
    assert q.rule_verdicts(none).collect() == []


def test_sql(odd, small):
    columns = "doc_id, n_words, n_lines, n_exclamations, n_letter_words, n_stop_words, n_bullet_lines, n_open_lines, failed, kept"
    for rows, df in (odd, small):
        got = q.rule_verdicts(df).select(*columns.split(", ")).collect()
        clean = [r for r in rows if "\x00" not in (r[1] or "")]
        assert len(clean) >= len(rows) - 1
        odd_ids = {r[0] for r in rows} - {r[0] for r in clean}
        assert canonical_rows(r for r in got if r.doc_id not in odd_ids) == canonical_rows(duck_rows(clean, q.OP11_SQL, columns))


CLEAN = "the river and a house in it is that of the day " + " ".join(f"word{'abcdefghij'[i % 10]}{'klmnop'[i // 10]}" for i in range(60))


@pytest.mark.parametrize(
    "text, failed",
    [
        (CLEAN, ""),
        (" ".join(w + "###" for w in CLEAN.split()), "symbols,stop_words"),
        (CLEAN.replace(" ", "!! "), "exclamations"),
        (" ".join(str(k) for k in range(100)), "word_length,letters,stop_words"),
        (CLEAN.replace("word", "an" * 12), "word_length"),
        ("\n".join([CLEAN, "a", "b", "a", "b", "a", "b"]), "repeated_lines"),
        ("\n".join("- the line of " + w for w in CLEAN.split()), "bullets"),
        ("\n".join("the end of " + w + "..." for w in CLEAN.split()), "open_ends"),
        ("日本語 " * 3 + CLEAN, ""),
    ],
)
def test_rules(spark, text, failed):
    row = q.rule_verdicts(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row.failed == failed
    assert row.kept == (not failed and not row.base_failed)


def test_own_table(spark):
    df = spark.createDataFrame([(1, CLEAN), (2, CLEAN + " <b>")], "doc_id bigint, text string")
    strict = q.rule_verdicts(df, table=[("tags", "n_symbols", "n_words", None, 0)])
    assert {r.doc_id: r.failed for r in strict.collect()} == {1: "", 2: "tags"}


def test_repeated_windows_at_all_distances(spark):
    """Overlaps count once, windows of other texts do not count, and one text may be one word only."""
    texts = ["a b c a b c", "a a a a", "a b c d a b c d x y z", "x y z", "a b a b a", "p q r s q r s", "k " * 5000]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert canonical_rows(q.rule_verdicts(df).select(*BASE).collect()) == brute(rows)


def test_one_projection(small):
    """Neither shuffle nor Python in the plan."""
    plan = q.rule_verdicts(small[1])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Pandas|Window", plan)
