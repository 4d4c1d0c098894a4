from __future__ import annotations

import hashlib
import re
import struct

import xxhash
from pyspark.sql import functions as F

from querylens.llm import fingerprints as f


def edited(rows):
    """doc_id -> (n, digest of the edited text), by brute force."""
    texts = {}
    for i, t, *_ in rows:
        if i is not None:
            texts[i] = max(texts.get(i, ""), t or "")
    ids = sorted(texts)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    out = []
    for i, t, *_ in rows:
        t = t or ""
        half = len(t) // 2
        new = t[: len(t) - half] + (texts[after[i]][:half] if i is not None else "")
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), t))
    return sorted(out, key=repr)


def check(rows, df):
    got = sorted(f.edited_fingerprints(df).collect(), key=repr)
    want = edited(rows)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted((w[:3] for w in want), key=repr)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    return got


def test_odd_rows(odd):
    rows, df = odd
    got = check(rows, df)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[5].fingerprint == by_id[6].fingerprint
    assert by_id[5].near_next == 1.0  # two empty texts
    assert by_id[None].near_next == 0.0


def test_small_table(small):
    rows, df = small
    got = check(rows, df)
    texts = {r[0]: r[1] for r in rows}
    same = {}
    for r in got:
        same.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(prints) == 1 for prints in same.values())
    assert len({p for prints in same.values() for p in prints}) == len(same)
    long = [r for r in got if r.n_chars > 500]
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)
    assert 0.3 < sum(r.near_edited for r in long) / len(long) < 0.7


def test_no_rows(none):
    assert f.edited_fingerprints(none).collect() == []


def test_order_insertion_and_deletion(spark):
    rows = [(1, "One line.\nTwo here. Three\nTwo here."), (2, "Three\nTwo here.\nOne line. Two here."), (3, "One line.\nTwo here."),
            (4, "Two here.\nThree"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    v = f.with_vector(df.withColumn("_text", F.col("text")), "_text", "vector").select("doc_id", "vector", f.as_text("vector").alias("fp"))
    got = {r.doc_id: r.fp for r in v.collect()}
    assert got[1] == got[2] and len(set(got.values())) == 4 and set(got[5]) == {"0"}
    pair = v.where("doc_id = 3").select(F.col("vector").alias("a")).crossJoin(v.where("doc_id = 4").select(F.col("vector").alias("b")))
    whole = v.where("doc_id = 1").select(F.col("vector").alias("w"))
    sums = pair.withColumn("both", f.combined("a", "b")).crossJoin(whole).withColumn("rest", f.combined("w", "b", -1))
    row = sums.select(f.as_text("both").alias("both"), f.as_text("rest").alias("rest"), f.as_text("a").alias("a")).first()
    assert row.both == got[1] and row.rest == row.a


def test_native(odd):
    plan = f.edited_fingerprints(odd[1])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute_vector(text):
    """(n, lanes, counters of 128 bits) with the hashes worked out from their definition: seeded by their number."""
    lanes, counters, n = [0] * (2 * f.HASH_LANES), [0] * (64 * f.COUNT_HASHES), 0
    for paragraph in re.split(r"\n+|(?<=[.!?])[ \t]+", text):
        if not paragraph:
            continue
        n += 1
        for i in range(f.HASH_LANES + f.COUNT_HASHES):
            seed = xxhash.xxh64(struct.pack("<i", i), seed=42).intdigest()
            h = xxhash.xxh64(paragraph.encode(), seed=seed).intdigest()
            if i < f.HASH_LANES:
                lanes[2 * i] += h % 2**32
                lanes[2 * i + 1] += h >> 32
            else:
                for k in range(64):
                    counters[64 * (i - f.HASH_LANES) + k] += h >> k & 1
    return n, [x % 2**32 for x in lanes], counters


def printed(vector):
    _, lanes, counters = vector
    words = [counters[k : k + 64] for k in range(0, len(counters), 64)]
    pairs = [(w[k + 32], w[k]) for w in words for k in range(32)]
    return "".join(f"{x:08x}" for x in lanes) + "".join(f"{high:08x}{low:08x}" for high, low in pairs)


def alike(a, b):
    if a[1] == b[1]:
        return 1.0
    x, y = ([2 * c - v[0] for c in v[2]] for v in (a, b))
    both = sum(c * c for c in x) + sum(c * c for c in y)
    return min(1.0, max(0.0, 1 - sum((c - d) ** 2 for c, d in zip(x, y)) / both)) if both else 0.0


def test_fingerprints_and_likeness_by_definition(odd, small):
    """What is printed, and the likeness of what is printed, for whole tables; also beyond 255 paragraphs."""
    for rows, df in (odd, small):
        texts = {}
        for i, t, *_ in rows:
            if i is not None:
                texts[i] = max(texts.get(i, ""), t or "")
        ids = sorted(texts)
        after = dict(zip(ids, ids[1:] + ids[:1]))
        prints = {}
        for r in f.edited_fingerprints(df).collect():
            prints.setdefault(r.doc_id, []).append(r)
        for i, t, *_ in rows:
            t = t or ""
            half = len(t) // 2
            mine, new = brute_vector(t), brute_vector(t[: len(t) - half] + (texts[after[i]][:half] if i is not None else ""))
            near_next = alike(mine, brute_vector(texts[after[i]])) if i is not None else 0.0
            want = (printed(mine), printed(new), alike(mine, new), near_next)
            assert any(
                (r.fingerprint, r.edited_fingerprint) == want[:2] and abs(r.near_edited - want[2]) < 1e-9 and abs(r.near_next - want[3]) < 1e-9
                for r in prints[i]
            )


def test_many_paragraphs(spark):
    texts = ["\n".join(f"line {i % 400}" for i in range(3000)), "\n".join(f"line {i % 390}" for i in range(2000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    v = f.with_vector(df.withColumnRenamed("text", "_text"), "_text", "vector").select("doc_id", f.as_text("vector").alias("fp"))
    assert {r.doc_id: r.fp for r in v.collect()} == {i: printed(brute_vector(t)) for i, t in enumerate(texts)}


def test_texts_are_shuffled_once(spark):
    docs = spark.createDataFrame([(i, f"text {i}.\nand more") for i in range(50)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = f.edited_fingerprints(docs)
        assert len(frame.collect()) == 50
        plan = frame._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("ReusedExchange") == 1, plan


def test_smallest_id_is_no_missing_id(spark):
    lowest = -(1 << 63)
    rows = [(lowest, "first text. one"), (None, "text without an id"), (5, "second text. two")]
    got = f.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == sorted((i is None, i or 0, len(t)) for i, t in rows)
    assert [r.near_next for r in got if r.doc_id is None] == [0.0]
