from __future__ import annotations

import zlib

import numpy as np

from querylens.llm import toxicity as t

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = t.op8_toxicity(spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.9
    clean = [r.predicted for r in held if not labels[r.doc_id]]
    assert sum(clean) <= 0.02 * len(clean)
    toxic = [r.score for r in held if labels[r.doc_id]]
    assert np.mean(toxic) > 0.3 + np.mean([r.score for r in held if not labels[r.doc_id]])


def test_odd_rows_and_labels(spark, odd):
    rows, df = odd
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 19)] + [(1, 1), (None, 1), (2, None)], "doc_id bigint, toxic int")
    got = t.toxicity_scores(df, t.fit_toxicity(df, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    alike = {r.score for r in got if r.doc_id in (1, 2, 3)}
    assert len(alike) == 1


def test_without_labels(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = t.toxicity_scores(odd[1], t.fit_toxicity(odd[1], empty)).collect()
    assert all(r.predicted == 0 and r.score < 0.01 for r in got)
    assert t.toxicity_scores(none, t.fit_toxicity(none, empty)).collect() == []


def test_gradients_lower_the_loss():
    random = np.random.default_rng(0)
    bad = np.array([[7, t.WORD_BUCKETS + 3]], np.int32)
    texts, y = [], []
    for i in range(200):
        w = np.stack([random.integers(100, 5000, 30), t.WORD_BUCKETS + random.integers(10, 900, 30)], 1).astype(np.int32)
        texts.append(np.concatenate([w, bad]) if i % 2 else w)
        y.append(i % 2)
    net = t.trained(texts, np.array(y, float))
    scores = np.array([net.score(w) for w in texts])
    assert scores[1::2].min() > scores[0::2].max()
    # Whole texts count: the word is found wherever it stands.
    long = np.concatenate([np.tile(texts[0], (9000, 1)), bad])
    assert net.score(long) > scores[0::2].max()


def test_long_texts_do_not_displace_others(spark):
    """A huge labelled text and a repeated id: the other labelled documents are learnt from, the same each time."""
    words = [f"word{i}" for i in range(50)]
    rows = [(i, " ".join(words[i % 40 :] + ["vile"] * (i % 2)), "en") for i in range(400)]
    rows += [(-i, "long text " * 40_000, "en") for i in range(1, 20)] + [(3, "another " * 60, "en")] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, abs(i) % 2) for i in range(-19, 400)], "doc_id bigint, toxic int")
    net = t.fit_toxicity(df, labels, size=4 << 20)
    scores = {(r.doc_id, r.predicted) for r in t.toxicity_scores(df.where("doc_id > 3"), net).collect()}
    assert np.mean([p == i % 2 for i, p in scores]) > 0.95
    again = t.fit_toxicity(df.repartition(7), labels, size=4 << 20)
    assert net.thresholds == again.thresholds and np.array_equal(net.weights, again.weights)


def test_forward_pass_against_loops(small):
    """Pooled responses and the score, filter by filter and word by word."""
    random = np.random.default_rng(4)
    words = np.stack([random.integers(0, t.WORD_BUCKETS, 40), t.WORD_BUCKETS + random.integers(0, t.HEAD_BUCKETS, 40)], 1).astype(np.int32)
    net = t.trained([words, words[:7], words[3:], words[::2]] * 6, np.array([0.0, 1, 0, 1] * 6))
    for text in (words, words[:2], words[:1]):
        vectors = [net.embedding[a].astype(float) + net.embedding[b] for a, b in text]
        pooled = []
        for k, size in enumerate(t.SIZES):
            for f in range(t.FILTERS):
                best = 0.0
                for i in range(len(text) - size + 1):
                    response = np.concatenate(vectors[i : i + size]) @ net.filters[k][:, f] + net.offsets[k * t.FILTERS + f]
                    best = max(best, float(response))
                pooled.append(best)
        assert np.allclose(net.pooled(text), pooled, atol=1e-4)
        raw = np.array(pooled) @ net.weights + net.bias
        assert abs(net.score(text) - 1 / (1 + np.exp(-(net.scale * raw + net.shift)))) < 1e-4
