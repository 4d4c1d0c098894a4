"""Language-model scoring with Elias-Fano n-gram tries.

The model is a bigram model: the probability of a word after another is (n(c, w) + M * p(w)) / (n(c) + M), with
counts of the training documents and p(w) = c(w) / (N + 1), or 1 / (N + 1) for a word never seen. Counts grow
with the corpus, so the model is held in shards of a hash space and never in one place:

1. Units of documents send the distinct words they hold, with their training counts, to shards; each shard adds
   them up and answers with exact counts.
2. Units send their distinct bigrams to the shards of the contexts. A context so frequent that it would weigh on
   its shard is split by the following word; all units know its count, so all split alike. A shard builds its
   trie: sorted contexts, pointers to their successors and the successors themselves as monotone sequences in
   Elias-Fano coding (successors made monotone by adding the greatest id so far), and the first term of each
   probability quantised to 8 bits on a log scale. The levels are one memory-mapped file, and each bigram is
   looked up by a successor search relative to its context's range.
3. Units add up the scores of their documents.

Training documents are those whose crc32(doc_id) modulo 7 is not 2 (a null id counts for training). Every text
ends with an end token; the first word follows a start mark. Null and empty texts have the end token only. Words
that differ only in A-Z case are the same. Rows repeated with the same id are counted as often as they come.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.llm.common import WORD, bucket_of, documents, kept, whole_text
from querylens.llm.exchange import Unit, from_planes, planes, rounds, runs, units
from querylens.llm.words import blocks, mixed, word_hashes

FOLDS, HELD_OUT = 7, 2
UNIT_BYTES = 16 << 20
MASS = 2.0  # M: how much the unigram model weighs against a context's count
CONTEXT_BYTES, WORD_BYTES = 6, 5
START, END = np.uint64(3), np.uint64(5)
# Quantised log10 probabilities lie between -STEPS * STEP and 0.
STEP, STEPS = 12 / 254, 254
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_counts", pa.float64()), ("score", pa.float64()), ("distinct", pa.int64())]
)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary, with sampled places for access."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint64)
        self.n = len(values)
        top = int(values[-1]) + 1 if self.n else 1
        self.low_bits = max(0, (top // max(self.n, 1)).bit_length() - 1)
        low = values & np.uint64((1 << self.low_bits) - 1)
        bits = ((low[:, None] >> np.arange(self.low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        self.low = np.packbits(bits.ravel(), bitorder="little")
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        unary = np.zeros(int(high[-1]) + self.n + 1 if self.n else 1, np.uint8)
        unary[high + np.arange(self.n)] = 1
        self.high = np.packbits(unary, bitorder="little")

    def decoded(self) -> np.ndarray:
        """All values (a shard's searches touch most of a level, so a level is decoded once for a pass)."""
        if not self.n:
            return np.zeros(0, np.int64)
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        padded = np.zeros((self.n, 64), np.uint8)
        padded[:, : self.low_bits] = bits
        low = np.packbits(padded, axis=1, bitorder="little").view(np.int64).ravel()
        return high << self.low_bits | low


class Trie:
    """Contexts, pointers, successors and quantised values of one shard, in a memory-mapped file."""

    def __init__(self, contexts: np.ndarray, words: np.ndarray, values: np.ndarray):
        """Sorted by context, then word; (context, word) distinct."""
        new = np.ones(len(contexts), bool)
        new[1:] = contexts[1:] != contexts[:-1]
        starts = np.flatnonzero(new)
        pointers = np.append(starts, len(contexts))
        # The k-th context's successors are shifted by k times the word space, so all successors ascend.
        rank = np.cumsum(new) - 1
        levels = [EliasFano(contexts[starts]), EliasFano(pointers), EliasFano((rank << (8 * WORD_BYTES)) + words.astype(np.int64))]
        self.levels = levels
        parts = [a for level in levels for a in (level.low, level.high)] + [values.astype(np.uint8)]
        with tempfile.TemporaryFile() as file:
            for part in parts:
                file.write(part.tobytes())
            file.flush()
            self.size = sum(len(p) for p in parts)
            self.map = mmap.mmap(file.fileno(), max(self.size, 1), access=mmap.ACCESS_READ) if self.size else b""
        at = 0
        views = []
        for part in parts:
            views.append(np.frombuffer(self.map, np.uint8, len(part), at) if len(part) else part)
            at += len(part)
        for k, level in enumerate(levels):
            level.low, level.high = views[2 * k], views[2 * k + 1]
        self.values = views[-1]

    def look_up(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Quantised value of each (context, word), 255 where there is none."""
        known, pointers, successors = (level.decoded() for level in self.levels)
        out = np.full(len(contexts), 255, np.uint8)
        if not len(known):
            return out
        rank = np.minimum(np.searchsorted(known, contexts), len(known) - 1)
        wanted = (rank << (8 * WORD_BYTES)) + words
        # The next successor at or after the word; it counts if it lies in the context's range.
        place = np.searchsorted(successors, wanted)
        inside = (known[rank] == contexts) & (place >= pointers[rank]) & (place < pointers[rank + 1])
        hit = np.flatnonzero(inside)
        hit = hit[successors[place[hit]] == wanted[hit]]
        out[hit] = self.values[place[hit]]
        return out


def quantised(probability: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(probability) / STEP), 0, STEPS).astype(np.uint8)


def answer_counts(shard: int, rows: list[tuple]) -> list[tuple]:
    """Exact counts of words in all units. Parts: hashes, counts. The first row's unit also hears how many are known."""
    hashes = [from_planes(r[2], np.uint64) for r in rows]
    counts = np.concatenate([from_planes(r[3], np.uint32) for r in rows]).astype(np.int64)
    distinct, each = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(each, counts, len(distinct)).astype(np.int64)  # exact below 2**53
    reporter = min(r[1] for r in rows)
    out, at = [], 0
    for row, h in zip(rows, hashes):
        mine = planes(total[each[at : at + len(h)]])
        out.append((shard, row[1], mine, int((total > 0).sum()).to_bytes(8, "little") if row[1] == reporter else b""))
        at += len(h)
    return out


def answer_bigrams(shard: int, rows: list[tuple]) -> list[tuple]:
    """Quantised n(c, w) / (n(c) + M). Parts: distinct contexts, their successors' number and count; words, counts."""
    contexts, words, counts, totals = [], [], [], []
    for r in rows:
        n = from_planes(r[3], np.uint32)
        contexts.append(np.repeat(from_planes(r[2], np.int64, CONTEXT_BYTES), n))
        totals.append(np.repeat(from_planes(r[4], np.int64), n))
        words.append(from_planes(r[5], np.int64, WORD_BYTES))
        counts.append(from_planes(r[6], np.uint32))
    sizes = [len(w) for w in words]
    c, w, n, t = (np.concatenate(x) for x in (contexts, words, counts, totals))
    order = np.lexsort((w, c))
    seen = order[n[order] > 0]
    if len(seen):
        new = np.ones(len(seen), bool)
        new[1:] = (c[seen][1:] != c[seen][:-1]) | (w[seen][1:] != w[seen][:-1])
        at = np.flatnonzero(new)
        joint = np.add.reduceat(n[seen].astype(np.float64), at)
        trie = Trie(c[seen][at], w[seen][at], quantised(joint / (t[seen][at] + MASS)))
    else:
        trie = Trie(c[:0], w[:0], np.zeros(0))
    found = np.empty(len(c), np.uint8)
    found[order] = trie.look_up(c[order], w[order])
    out, at = [], 0
    for row, size in zip(rows, sizes):
        out.append((shard, row[1], found[at : at + size].tobytes()))
        at += size
    return out


class Tokens:
    """Tokens of a unit: each document's words and its end, and the token before each."""

    def __init__(self, unit: Unit):
        hashes, counts = [], [np.zeros(1, np.int64)]
        for low, high in blocks(unit.offsets):
            base = unit.offsets[low]
            h, _, _, c = word_hashes(unit.data[base : unit.offsets[high]], unit.offsets[low : high + 1] - base, lower=True)
            counts.append(c[1:] + counts[-1][-1])
            hashes.append(h)
        h = np.concatenate([np.zeros(0, np.uint64), *hashes])
        counts = np.concatenate(counts)
        self.tokens = np.insert(h, counts[1:], END)
        self.at = counts + np.arange(len(counts))
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.at[:-1]] = START
        self.document = np.repeat(np.arange(len(counts) - 1), np.diff(self.at))
        held = unit.extra.column("held_out").to_numpy(zero_copy_only=False)
        self.held = held
        self.trains = ~held[self.document]
        self.words, self.word = np.unique(self.tokens, return_inverse=True)
        self.known_in = np.bincount(self.word, self.trains, len(self.words)).astype(np.uint32)

    def by_shard(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the distinct words by shard, and their shards in that order."""
        shard = (mixed(self.words) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return order, shard[order]


class Bigrams:
    """Distinct bigrams of a unit in order of shard, context and word."""

    def __init__(self, t: Tokens, counts: np.ndarray, starts: int, shards: int, heavy: float):
        """counts: of the distinct words in training; heavy: a context's count from which on it is split."""
        base = np.zeros(len(t.tokens), np.int64)
        base[1:] = counts[t.word[:-1]]
        base[t.at[:-1]] = starts
        word = (t.tokens >> np.uint64(64 - 8 * WORD_BYTES)).astype(np.int64)
        context = (mixed(t.before) >> np.uint64(64 - 8 * CONTEXT_BYTES)).astype(np.int64)
        splits = 1 + (base / heavy).astype(np.int64)
        site = (word % splits).astype(np.uint64)
        shard = (mixed(context.astype(np.uint64) ^ (site << np.uint64(48))) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((word, context, shard))
        s, c, w = shard[order], context[order], word[order]
        new = np.ones(len(order), bool)
        new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1]) | (w[1:] != w[:-1])
        at = np.flatnonzero(new)
        self.shard, self.context, self.word, self.total = s[at], c[at], w[at], base[order][at]
        self.each = np.empty(len(order), np.int64)
        self.each[order] = np.cumsum(new) - 1
        self.count = np.bincount(self.each, t.trains, len(at)).astype(np.uint32)
        self.base = base


def scored(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held_out = F.coalesce(bucket_of("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    marked = docs.select(F.col("doc_id").cast("bigint"), whole_text().alias("text"), held_out.alias("held_out"))
    words = F.regexp_count("text", F.lit(WORD))
    sums = marked.where(~F.col("held_out")).agg(F.count(F.lit(1)).alias("documents"), F.sum(words).alias("words")).first()
    n_docs, total = sums.documents, (sums.words or 0) + sums.documents
    dealt, shards = units(marked, UNIT_BYTES, "held_out")
    heavy = max(total / (4 * shards), 1.0)

    def ask(unit: Unit):
        t = Tokens(unit)
        order, to = t.by_shard(shards)
        for s, a, b in runs(to):
            yield s, unit.number, planes(t.words[order[a:b]]), planes(t.known_in[order[a:b]])

    def ask_again(unit: Unit, answers: dict):
        t = Tokens(unit)
        order, to = t.by_shard(shards)
        counts = np.zeros(len(t.words), np.int64)
        for s, a, b in runs(to):
            counts[order[a:b]] = from_planes(answers[s][0], np.int64)
        known = sum(int.from_bytes(parts[1], "little") for parts in answers.values() if parts[1])
        g = Bigrams(t, counts, n_docs, shards, heavy)
        rows = []
        for s, a, b in runs(g.shard):
            context = g.context[a:b]
            at = np.concatenate([[0], np.flatnonzero(np.diff(context)) + 1])
            size = np.diff(np.append(at, b - a)).astype(np.uint32)
            rows.append(
                (s, unit.number, planes(context[at], CONTEXT_BYTES), planes(size), planes(g.total[a:b][at]), planes(g.word[a:b], WORD_BYTES), planes(g.count[a:b]))
            )
        return rows, [planes(counts), known.to_bytes(8, "little")]

    def finish(unit: Unit, answers: dict, state: list[bytes]) -> pa.Table:
        t = Tokens(unit)
        counts = from_planes(state[0], np.int64)
        g = Bigrams(t, counts, n_docs, shards, heavy)
        codes = np.concatenate([np.frombuffer(answers[s][0], np.uint8) for s, _, _ in runs(g.shard)])[g.each]
        count = counts[t.word]
        unigram = np.maximum(count, 1) / (total + 1)
        first = np.where(codes == 255, 0.0, 10.0 ** (-STEP * codes))
        score = np.log10(first + MASS / (g.base + MASS) * unigram)
        n = len(t.held)
        distinct = [int.from_bytes(state[1], "little")] + [0] * (n - 1)
        return pa.table(
            [
                unit.column,
                pa.array(t.held),
                pa.array(np.diff(t.at), pa.int64()),
                pa.array(np.bincount(t.document, count > 0, n).astype(np.int64)),
                pa.array(np.bincount(t.document, np.log10(count + 1.0), n)),
                pa.array(np.bincount(t.document, score, n)),
                pa.array(distinct, pa.int64()),
            ],
            schema=_SCHEMA,
        )

    found = kept(
        rounds(
            dealt, ask, answer_counts, ask_again, answer_bigrams, finish,
            "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, log_counts double, score double, distinct bigint",
            _SCHEMA.empty_table(),
            shards,
        ),
        "scores",
    )
    vocabulary = found.agg(F.sum("distinct")).first()[0] or 0
    base = F.col("log_counts") - F.col("n_tokens") * F.log10(F.lit(float(total + vocabulary + 1)))
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score"
    )


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))
