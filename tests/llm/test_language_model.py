from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np

from querylens.llm import language_model as m

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORDS.findall(re.sub("[A-Z]", lambda c: c.group().lower(), text or "")) + [None]


def held(ident):
    return ident is not None and zlib.crc32(str(ident).encode()) % 7 == 2


def check(rows, df):
    texts = [(i, tokens(t)) for i, t, *_ in rows]
    train = [t for i, t in texts if not held(i)]
    c = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["\0start"] + t, t))
    total, distinct = sum(c.values()), len(c)
    want = []
    for i, t in texts:
        base = sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in t)
        score = 0.0
        for before, w in zip(["\0start"] + t, t):
            n = len(train) if before == "\0start" else c[before]
            score += math.log10((pairs[before, w] + m.MASS * max(c[w], 1) / (total + 1)) / (n + m.MASS))
        want.append((i, held(i), len(t), sum(c[w] > 0 for w in t), total, base, score))
    got = m.scored(df).collect()
    key = lambda r: (repr(r[0]), r[2])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert tuple(g[:5]) == w[:5]
        assert math.isclose(g.base_score, w[5], rel_tol=1e-9)
        assert abs(g.score - w[6]) <= 0.5 * m.STEP * w[2] + 1e-9  # quantised to half a step a token
    return got


def test_odd_rows(odd):
    check(*odd)


def test_small_table(small):
    got = check(*small)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_no_rows(none):
    assert m.scored(none).collect() == []


def test_frequent_contexts_are_split(odd, monkeypatch):
    """The same scores when nearly every context is split over many shards."""
    first = {(r.doc_id, r.n_tokens): r.score for r in m.scored(odd[1]).collect()}
    original = m.Bigrams.__init__
    monkeypatch.setattr(m.Bigrams, "__init__", lambda self, t, c, s, k, heavy: original(self, t, c, s, k, 1.0))
    assert {(r.doc_id, r.n_tokens): r.score for r in m.scored(odd[1]).collect()} == first


def test_elias_fano_and_trie():
    random = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 5), (500, 40), (500, 10**12)):
        values = np.sort(random.integers(0, top, n))
        assert m.EliasFano(values).decoded().tolist() == values.tolist()
    pairs = sorted({(int(a), int(b)) for a, b in zip(random.integers(0, 50, 400), random.integers(0, 60, 400))})
    c, w = (np.array(x, np.int64) for x in zip(*pairs))
    trie = m.Trie(c, w, np.arange(len(pairs)) % 250)
    asked = [(a, b) for a in range(52) for b in range(62)]
    ca, wa = (np.array(x, np.int64) for x in zip(*asked))
    where = {p: i % 250 for i, p in enumerate(pairs)}
    assert trie.look_up(ca, wa).tolist() == [where.get(p, 255) for p in asked]
    assert trie.size < 0.4 * 16 * len(pairs)
