from __future__ import annotations

import hashlib
import re

from conftest_llm import canonical_rows, duck_rows

from querylens.llm import exact_dedup as e


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(bare, []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for bare, members in groups.items():
        keep = min(members)[3]
        digest = hashlib.sha256(bare.encode()).hexdigest()
        out += [(i, keep, len(members), i == keep, digest) for *_, i in members]
    return canonical_rows(out)


def test_odd_rows(odd):
    rows, df = odd
    got = e.exact_groups(df).collect()
    assert canonical_rows(got) == brute(rows)


def test_small_chunks(odd):
    rows, df = odd
    assert canonical_rows(e.exact_groups(df, chunk_chars=7).collect()) == brute(rows)


def test_collisions_do_not_merge(odd, monkeypatch):
    rows, df = odd

    def colliding(docs):
        from pyspark.sql import functions as F

        return e_fingerprints(docs).withColumns({"fp": F.lit(1).cast("bigint"), "n_bare": F.lit(1).cast("bigint")})

    e_fingerprints = e.fingerprints
    monkeypatch.setattr(e, "fingerprints", colliding)
    rows_with_id = [r for r in rows if r[0] is not None]
    got = e.exact_groups(df.where("doc_id IS NOT NULL")).collect()
    assert canonical_rows(got) == brute(rows_with_id)


def test_no_rows(none):
    assert e.exact_groups(none).collect() == []


def test_small_table_equals_sql(small):
    rows, df = small
    assert canonical_rows(e.exact_groups(df).collect()) == canonical_rows(duck_rows(rows, e.OP10_SQL, "doc_id, keep_id, group_size, kept, text_sha256"))


def test_hashes_combine():
    text = bytes(range(256)) * 900
    whole = e.fingerprint(text)
    for cut in (0, 1, 70_000, len(text)):
        parts = [text[:cut], text[cut:]]
        values = []
        for part in parts:
            value = (0, 0)
            for at in range(0, len(part), e.CHUNK):
                chunk = part[at : at + e.CHUNK]
                value = e.combined(value, e.chunk_hash(chunk), len(chunk))
            values.append(value)
        a, b = e.combined(values[0], values[1], len(parts[1]))
        assert a << 31 | b == whole
    assert e.fingerprint(b"ab") != e.fingerprint(b"ba") and e.fingerprint(b"\0") != e.fingerprint(b"\0\0")
