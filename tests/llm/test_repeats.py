"""Substring and phrase dedup against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from conftest_llm import canonical_rows

from querylens.llm import exchange, phrases, substrings

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LAST = float("inf")


def brute_substrings(rows, length=50):
    first = {}
    texts = [(LAST if i is None else i, i, (t or "").encode()) for i, t, *_ in rows]
    for order, _, t in texts:
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            first[s] = min(first.get(s, LAST), order)
    out = []
    for order, i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < order:
                gone[k : k + length] = True
        gone = gone[: len(t)]
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return canonical_rows(out)


def brute_phrases(rows, window=20):
    first = {}
    texts = [(LAST if i is None else i, i, WORDS.findall((t or "").encode())) for i, t, *_ in rows]
    for order, _, w in texts:
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            first[s] = min(first.get(s, (LAST, LAST)), (order, k))
    out = []
    for order, i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (order, k):
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return canonical_rows(out)


def test_substrings_odd_rows(odd):
    rows, df = odd
    assert canonical_rows(substrings.cut(df).collect()) == brute_substrings(rows)


def test_substrings_small_table(small):
    rows, df = small
    assert canonical_rows(substrings.cut(df).collect()) == brute_substrings(rows)


def test_phrases_odd_rows(odd):
    rows, df = odd
    assert canonical_rows(phrases.deduplicated(df).collect()) == brute_phrases(rows)


def test_phrases_small_table(small):
    rows, df = small
    assert canonical_rows(phrases.deduplicated(df).collect()) == brute_phrases(rows)


def test_no_rows(none):
    assert substrings.cut(none).collect() == [] and phrases.deduplicated(none).collect() == []


def test_near_repeats(spark):
    """Passages that begin and end at every distance, so that surroundings of an anchor differ."""
    random = np.random.default_rng(4)
    letters = np.array(list("abc d"))
    body = "".join(random.choice(letters, 400))
    rows = []
    for i in range(60):
        a, b = sorted(random.integers(0, 400, 2).tolist())
        rows.append((i, "".join(random.choice(letters, int(random.integers(0, 60)))) + body[a:b] + "".join(random.choice(letters, 30))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert canonical_rows(substrings.cut(df).collect()) == brute_substrings(rows)
    assert canonical_rows(phrases.deduplicated(df).collect()) == brute_phrases(rows)


def test_suffix_array():
    random = np.random.default_rng(3)
    for _ in range(400):
        t = random.integers(0, random.integers(1, 5), random.integers(0, 60)).astype(np.int16)
        assert substrings.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_hot_anchor(spark, monkeypatch):
    """Thousands of documents with their own text on both sides of one passage: no shard compares all of them."""
    random = np.random.default_rng(6)
    letters = np.array(list("abcdefgh "))
    body = "".join(random.choice(letters, 150))
    own = ["".join(random.choice(letters, 60)) for _ in range(9000)]
    # A third have half of the text of another one beside the passage too.
    rows = [(i, own[2 * i] + body + (own[2 * i + 1] if i % 3 else own[i] + own[i + 1])) for i in range(4200)]
    rows += [(None, own[8] + body + own[9]), (7, own[0] + body)]
    expected = brute_substrings(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert canonical_rows(substrings.cut(df).collect()) == expected

    groups = [0]
    parts = substrings.shared_parts
    monkeypatch.setattr(substrings, "shared_parts", lambda group, *a: groups.append(len(group)) or parts(group, *a))
    monkeypatch.setattr(substrings, "units", lambda docs, size: (docs, 16))
    monkeypatch.setattr(substrings, "rounds", here)
    tables = [
        pa.table({"doc_id": pa.array([r[0] for r in rows[u::5]], pa.int64()), "text": [r[1] for r in rows[u::5]], "unit": [u] * len(rows[u::5])})
        for u in range(5)
    ]
    found = pa.concat_tables(substrings.cut(tables))
    assert canonical_rows(zip(*(found.column(c).to_pylist() for c in found.column_names))) == expected
    assert max(groups) <= substrings.ARRAY_BYTES // 80


def here(tables, ask, answer, ask_again, answer_again, finish, *_, **__):
    """Both rounds in this process."""
    dealt = [exchange.Unit(t) for t in tables]

    def answers(rows, answer):
        shards, out = {}, {u.number: {} for u in dealt}
        for row in rows:
            shards.setdefault(row[0], []).append(row)
        for s, asked in shards.items():
            for _, unit, *parts in answer(s, asked):
                out[unit][s] = parts
        return out

    first = answers([r for u in dealt for r in ask(u)], answer)
    asked, state = [], {}
    for u in dealt:
        rows, state[u.number] = ask_again(u, first[u.number])
        asked += rows
    second = answers(asked, answer_again)
    return [finish(u, second[u.number], state[u.number]) for u in dealt]


def test_relays_give_the_same(odd, small, monkeypatch):
    """Many tiny units, by way of relays: results as before."""
    monkeypatch.setattr(exchange, "DIRECT", 4)
    for module in (substrings, phrases):
        monkeypatch.setattr(module, "UNIT_BYTES", 20_000)
    for rows, df in (odd, small):
        assert canonical_rows(substrings.cut(df).collect()) == brute_substrings(rows)
        assert canonical_rows(phrases.deduplicated(df).collect()) == brute_phrases(rows)


def test_relayed_rows_grow_by_less_than_a_square(spark):
    """Packed rows between n units and n shards: n ** 1.5 on either side of a relay, all of them delivered."""
    sent = {}
    for n in (16, 64, 256):
        block = int(n**0.5)
        messages = [[(s, u, bytes([u % 251])) for s in range(n)] for u in range(n)]
        hop = pa.concat_tables([exchange._packed(m, block, "shard") for m in messages])
        groups = {}
        for k, row in enumerate(zip(hop.column("block_s").to_pylist(), hop.column("block_u").to_pylist())):
            groups.setdefault(row, []).append(k)
        relayed = pa.concat_tables([exchange._sorted_by("shard")(hop.take(pa.array(k))) for k in groups.values()])
        sent[n] = (hop.num_rows, relayed.num_rows)
        by_shard = {}
        for shard, data in zip(relayed.column("shard").to_pylist(), relayed.column("rows")):
            by_shard.setdefault(shard, []).append(data)
        for shard in (0, n // 2, n - 1):
            rows = exchange._unpacked(pa.table({"rows": by_shard[shard]}))
            assert sorted(rows) == [(shard, u, bytes([u % 251])) for u in range(n)]
        assert max(len(k) for k in groups.values()) == block and len(by_shard[0]) == block
    assert all(a == b == n**1.5 for n, (a, b) in sent.items())


def test_missing_and_shared_ids_are_spread(spark):
    """A third of the rows have no id and a third share one: no unit gets more than its part."""
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text {i} " * 30) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    dealt, count = exchange.units(df, 10_000)
    sizes = [r["count"] for r in dealt.groupBy("unit").count().collect()]
    assert count > 50 and max(sizes) < 3 * len(rows) / count
    few = rows[:60] + [(5, rows[1][1] + rows[4][1])]
    small = spark.createDataFrame(few, "doc_id bigint, text string")
    assert canonical_rows(substrings.cut(small).collect()) == brute_substrings(few)
    assert canonical_rows(phrases.deduplicated(small).collect()) == brute_phrases(few)
