"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words (ASCII letters lower-cased, punctuation left out) are hashed to rows of an embedding table, once whole and
once by their first bytes, and the two rows are added. Filters of one, two and three words
slide over the whole text, each filter keeps its highest response (max pooling), and a logistic layer turns the
pooled responses into a probability. Embeddings start from how much likelier a bucket's words make label 1,
seen in the training sample, and everything is then trained together: filters and weights by Adam, the embedding
rows, of which a step touches few, by plain gradient steps; gradients of max pooling touch only the winning places. Scores are calibrated on a part of the sample that training does not see, where a
threshold for each language is chosen too (column ``flagged``; the contract's ``predicted`` is score >= 0.7).

Labels come only from rows outside the held-out third, at most ``SAMPLE_ROWS`` of them, chosen by a hash of the
id; a document with conflicting labels counts as toxic, and one with several texts is learnt from the shortest. A text
of more than ``SAMPLE_BYTES / LONGEST`` is scored like others but not learnt from. The model has a fixed size, so it travels with the
tasks. Null and empty texts have no words: all responses are 0 and the score is the classifier's at that point.
Without labels of both classes every score is the share of label 1 (0 without any). Repeated rows are scored
alike; columns other than doc_id, text and lang are not read, and lang only picks the threshold.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylens.llm.common import bucket_of, documents, text_buffers, whole_text
from querylens.llm.words import BYTE_VALUES, blocks, lowered, spans_hashed, word_spans

SAMPLE_ROWS = 6000
# Sampled texts come to the driver, so their number of bytes is bounded too; whole texts, never cut.
SAMPLE_BYTES = 64 << 20
LONGEST = 64
FOLDS, HELD_OUT = 3, 1
WORD_BUCKETS, HEAD_BUCKETS, HEAD_BYTES = 1 << 18, 1 << 16, 4
BUCKETS, WIDTH = WORD_BUCKETS + HEAD_BUCKETS, 8
# What separates words here: everything in ASCII but letters and digits.
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
FILTERS, SIZES = 8, (1, 2, 3)
EPOCHS, STEP = 6, 0.01
# Documents whose responses are computed at a time.
SPAN = 1 << 16


def buckets_of(array: pa.Array) -> list[np.ndarray]:
    """The two buckets of every word of each text."""
    data, offsets = text_buffers(array)
    out: list[np.ndarray] = []
    for low, high in blocks(offsets):
        part = data[offsets[low] : offsets[high]]
        starts, ends, counts = word_spans(part, offsets[low : high + 1] - offsets[low], BETWEEN)
        values = BYTE_VALUES[lowered(part)]
        word = spans_hashed(values, starts, ends) % np.uint64(WORD_BUCKETS)
        head = spans_hashed(values, starts, np.minimum(ends, starts + HEAD_BYTES)) % np.uint64(HEAD_BUCKETS)
        both = np.stack([word.astype(np.int32), head.astype(np.int32) + WORD_BUCKETS], 1)
        out += [both[i:j] for i, j in zip(counts[:-1], counts[1:])]
    return out


@dataclass
class Network:
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each size: (size * WIDTH, FILTERS)
    offsets: np.ndarray
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, words: np.ndarray, places: bool = False):
        """Highest response of every filter over a text, at least 0, and where it is."""
        best = np.zeros(len(SIZES) * FILTERS, np.float32)
        where = np.full(len(best), -1)
        for low in range(0, max(len(words), 1), SPAN):
            span = words[low : low + SPAN + max(SIZES) - 1]
            part = self.embedding[span[:, 0]] + self.embedding[span[:, 1]]
            for k, size in enumerate(SIZES):
                n = len(part) - size + 1
                if n <= 0:
                    continue
                response = sum(part[i : i + n] @ self.filters[k][i * WIDTH : (i + 1) * WIDTH] for i in range(size))
                at = response.argmax(0)
                top = response[at, np.arange(FILTERS)] + self.offsets[k * FILTERS : (k + 1) * FILTERS]
                mine = slice(k * FILTERS, (k + 1) * FILTERS)
                better = top > best[mine]
                best[mine][better] = top[better]
                where[mine][better] = low + at[better]
        return (best, where) if places else best

    def score(self, words: np.ndarray) -> float:
        raw = float(self.pooled(words) @ self.weights + self.bias)
        return float(1 / (1 + np.exp(-np.clip(self.scale * raw + self.shift, -40, 40))))


def _started(texts: list[np.ndarray], y: np.ndarray, random: np.random.Generator) -> Network:
    """Embeddings whose first number is the shrunken log-likelihood ratio of a bucket, the others small noise."""
    seen = np.zeros((2, BUCKETS))
    for words, label in zip(texts, y):
        seen[int(label), np.unique(words)] += 1
    n1, n0 = max(y.sum(), 1), max(len(y) - y.sum(), 1)
    ratio = np.log(((seen[1] + 0.5) / (n1 + 1)) / ((seen[0] + 0.5) / (n0 + 1)))
    both = seen.sum(0)
    embedding = random.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    embedding[:, 0] = ratio * both / (both + 20)
    filters = []
    for size in SIZES:
        f = random.normal(0, 0.1, (size * WIDTH, FILTERS)).astype(np.float32)
        f[::WIDTH] += 1 / size
        filters.append(f)
    count = len(SIZES) * FILTERS
    return Network(embedding, filters, np.full(count, -0.5, np.float32), np.full(count, 2 / count, np.float32), -1.0)


def trained(texts: list[np.ndarray], y: np.ndarray, seed: int = 11) -> Network:
    """Adam over single documents in batches of 32; classes weigh alike."""
    random = np.random.default_rng(seed)
    net = _started(texts, y, random)
    values = [*net.filters, net.offsets, net.weights]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    bias_moments = [0.0, 0.0]
    weigh = np.where(y == 1, 0.5 * len(y) / max(y.sum(), 1), 0.5 * len(y) / max((1 - y).sum(), 1))
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(texts))
        for low in range(0, len(order), 32):
            batch = order[low : low + 32]
            grads = [np.zeros_like(v) for v in values]
            bias_grad, rows, row_grads = 0.0, [], []
            for d in batch:
                words = texts[d]
                best, where = net.pooled(words, places=True)
                p = 1 / (1 + np.exp(-np.clip(best @ net.weights + net.bias, -40, 40)))
                error = np.float32((p - y[d]) * weigh[d] / len(batch))
                grads[-1] += error * best
                bias_grad += error
                for j in np.flatnonzero(where >= 0):
                    k, f = divmod(int(j), FILTERS)
                    window = words[where[j] : where[j] + SIZES[k]]
                    g = error * net.weights[j]
                    grads[len(SIZES)][j] += g
                    grads[k][:, f] += g * net.embedding[window].sum(1).ravel()
                    rows.append(window.ravel())
                    row_grads.append(np.repeat(g * net.filters[k][:, f].reshape(-1, WIDTH), 2, axis=0))
            step += 1
            grads[-1] += 1e-3 * net.weights
            for v, g, (m, s) in zip(values, grads, moments):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= STEP * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            bias_moments[0] += 0.1 * (bias_grad - bias_moments[0])
            bias_moments[1] += 0.001 * (bias_grad**2 - bias_moments[1])
            net.bias -= STEP * (bias_moments[0] / (1 - 0.9**step)) / (np.sqrt(bias_moments[1] / (1 - 0.999**step)) + 1e-8)
            if rows:
                np.add.at(net.embedding, np.concatenate(rows), -STEP * np.concatenate(row_grads))
    return net


def calibrate(net: Network, texts: list[np.ndarray], y: np.ndarray, langs: list[str]) -> None:
    """Scale and shift of the score by Newton steps; for each language the threshold with the best F1."""
    raw = np.array([float(net.pooled(t) @ net.weights + net.bias) for t in texts])
    if 0 < y.sum() < len(y):
        target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        w = np.array([1.0, 0.0])
        x = np.stack([raw, np.ones_like(raw)], 1)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
            w = w - np.clip(np.linalg.solve(hessian, x.T @ (p - target) + 0.1 * (w - [1, 0])), -0.5, 0.5)
        if w[0] > 0:
            net.scale, net.shift = float(w[0]), float(w[1])
    scores = 1 / (1 + np.exp(-np.clip(net.scale * raw + net.shift, -40, 40)))
    for lang in sorted(set(langs)):
        mine = np.array([v == lang for v in langs])
        best = (0.0, 0.7)
        for t in np.arange(0.2, 0.91, 0.05):
            hit = ((scores >= t) & (y == 1) & mine).sum()
            f1 = 2 * hit / max(((scores >= t) & mine).sum() + ((y == 1) & mine).sum(), 1)
            if f1 > best[0] + 1e-9:
                best = (f1, float(round(t, 2)))
        net.thresholds[lang] = best[1]


def fit(texts: list[np.ndarray], y: np.ndarray, langs: list[str]) -> Network:
    y = np.asarray(y, float)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        net = _started([], np.zeros(0), np.random.default_rng(0))
        net.weights[:] = 0
        net.bias = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        return net
    part = np.arange(len(texts)) % 5 == 4
    net = trained([t for t, p in zip(texts, part) if not p], y[~part])
    calibrate(net, [t for t, p in zip(texts, part) if p], y[part], [v for v, p in zip(langs, part) if p])
    return net


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Network:
    """Fit on the sample; the tasks send hashed words (eight bytes each) of at most ``size`` bytes of text."""
    order = F.xxhash64("doc_id")
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (bucket_of("doc_id", FOLDS) != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label"))
        .orderBy(order, "doc_id")
        .limit(rows)
    )

    def hashed(batches):
        for batch in batches:
            words = [b.tobytes() for b in buckets_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "lang", "label", "bytes")), pa.array(words, pa.binary())],
                ["doc_id", "lang", "label", "bytes", "words"],
            )

    sampled = docs.select("doc_id", "lang", "text").join(F.broadcast(sample), "doc_id").select(
        "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "label",
        F.octet_length(whole_text()).cast("bigint").alias("bytes"), whole_text().alias("text"),
    )
    # One text of an id, so that the sample is the same each time; one long text does not take the place of many.
    least = F.min(F.struct("bytes", "text", "lang", "label")).alias("_least")
    texts = sampled.where(F.col("bytes") <= size // LONGEST).groupBy("doc_id").agg(least).select("doc_id", "_least.*")
    before = F.sum("bytes").over(Window.orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    words = texts.mapInArrow(hashed, "doc_id bigint, lang string, label int, bytes bigint, words binary")
    table = words.limit(rows).withColumn("_so_far", before).where(F.col("_so_far") <= size).orderBy(order, "doc_id").collect()
    return fit([np.frombuffer(r.words, np.int32).reshape(-1, 2) for r in table], np.array([r.label for r in table]), [r.lang for r in table])


def toxicity_scores(docs: DataFrame, net: Network) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, and flagged (score at least its language's threshold)."""
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))  # a fixed size, about 10 MB

    def run(batches):
        model = pickle.loads(blob.value)
        for batch in batches:
            scores = [model.score(w) for w in buckets_of(batch.column("text"))]
            langs = pc.fill_null(batch.column("lang"), "").to_pylist()
            flagged = [s >= model.thresholds.get(v, 0.7) for s, v in zip(scores, langs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.7) for s in scores], pa.int32()), pa.array(flagged, pa.bool_())],
                ["doc_id", "held_out", "score", "predicted", "flagged"],
            )

    held_out = F.coalesce(bucket_of("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return docs.select(
        F.col("doc_id").cast("bigint"), held_out.alias("held_out"), F.col("lang").cast("string").alias("lang"), whole_text().alias("text")
    ).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, flagged boolean")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity_scores(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
