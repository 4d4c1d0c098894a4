from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import SMALL  # noqa: E402

# Names that the operators use inside, as columns of the caller's table.
CLASHES = ("shard", "unit", "stats", "p", "kept", "id", "label", "ids", "key", "held_out", "_text", "_row", "_key", "fp", "topic")


def words(seed: int, n: int) -> str:
    random_ = random.Random(seed)
    return " ".join("".join(random_.choice("abcdeilnorstu") for _ in range(random_.randint(2, 9))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empty and long texts, copies, near copies, ties, repeated rows and odd characters."""
    a, b, c = words(1, 80), words(2, 70), words(3, 6000)
    near = a.split(" ")
    near[40] = "changed"
    texts = [
        (1, a), (2, a), (3, a.replace(" ", "\n\t", 7)), (4, " ".join(near)), (5, None), (6, ""), (7, "word"),
        (8, " \n\t \x0b"), (9, f"{c} {a} {c[:9000]} {a}\n{b}"), (10, "Ünïcode ▁ 日本語 🙂 text. Zwei  Sätze! " + b[:200]),
        (11, a + " " + b), (12, b), (12, b), (13, "WORD"), (14, "x" * 20_000), (15, b.upper()), (16, a + "\n" + a),
        (None, a), (-7, b + "\x00\x1f " + b), (17, "two words"), (18, " " + a + " " + a), (19, a[:120]),
    ]
    sources, langs = ["s0", "s0", "s1", None, ""], ["en", "de", None]
    return [(i, t, langs[k % 3], sources[k % 5], None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    """(rows, DataFrame with more columns, some with names used inside)."""
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df = df.repartition(3).selectExpr("*", *[f"'clash' AS `{name}`" for name in CLASHES])
    return rows, df


@pytest.fixture(scope="session")
def none(odd):
    return odd[1].limit(0)


@pytest.fixture(scope="session")
def small(spark):
    """(rows, DataFrame) of the smallest table."""
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    return [tuple(r) for r in df.collect()], df
