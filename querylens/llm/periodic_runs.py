"""Periodic runs of words by block convolution: dyadic blocks, exact integer NTT of squared differences, extension.

A run is a stretch of consecutive words in which words ``q`` apart are equal, ``q`` being its smallest period, that is
at least ``max(LEAST, 3 * q)`` words long and that neither neighbour extends. All runs of a text are found:

* at scale B (8, 16, 32, ...) the words are cut into aligned blocks of B. A run of period q has at least 2 * q words
  beyond its last period (17 when q is below 8), so one whole block of the scale with B <= q < 2 * B (8 for small
  periods) lies in it and occurs again q words later;
* a block's zero-mismatch occurrences in the window that follows are the places where the sum of squared differences
  of word numbers is zero. The sum is a convolution, taken for many blocks at once by a number-theoretic transform
  modulo ``PRIME``, so it is exact modulo the prime; a place where it is zero only modulo the prime is turned away
  when it is extended;
* each distance found seeds an extension to both sides. Scales and distances ascend, so a stretch's smallest period
  comes first and its multiples, which give the same stretch, are told by that.

Two exact shortcuts: a block can only occur again within the window if each of its words does, so others are not
transformed; and a window inside a run found before holds multiples of its period only.

Rows are worked on one by one, by n log^2 n operations at most and memory in proportion to the text; a text is a
row and is never spread or cut. Null counts as empty text, without words and runs. Repeated rows and null ids are
treated alike, each giving a row. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.llm.common import WORD, documents, whole_text
from querylens.session import computed_once

LEAST, TIMES = 24, 3
SMALLEST = 8  # words in a block of the first scale
# 15 * 2**27 + 1, with the primitive root 31: transforms of up to 2**27 numbers, products below 2**62.
PRIME, ROOT, MOST_TWOS = 2_013_265_921, 31, 27
# Numbers transformed at a time.
CHUNK = 1 << 18
_P = np.uint64(PRIME)
_twiddles: dict[tuple[int, bool], np.ndarray] = {}

Run = tuple[int, int, int]  # start, length, period


def _powers(half: int, inverse: bool) -> np.ndarray:
    """Powers 0 .. half - 1 of a root of unity of order 2 * half (or of its inverse)."""
    have = _twiddles.get((half, inverse))
    if have is None:
        base = pow(ROOT, (PRIME - 1) // (2 * half), PRIME)
        base = pow(base, -1, PRIME) if inverse else base
        have = np.ones(1, np.uint64)
        while len(have) < half:  # doubling: x**(k + m) = x**k * x**m
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), PRIME)) % _P])
        _twiddles[half, inverse] = have
    return have


def transformed(rows: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of every row, in bit-reversed order."""
    a = rows.astype(np.uint64)
    count, n = a.shape
    half = n // 2
    while half:
        pairs = a.reshape(count, -1, 2, half)
        u, v = pairs[:, :, 0], pairs[:, :, 1]
        low, high = (u + v) % _P, (u + _P - v) % _P * _powers(half, False) % _P
        pairs[:, :, 0], pairs[:, :, 1] = low, high
        half //= 2
    return a


def transformed_back(rows: np.ndarray) -> np.ndarray:
    """Inverse of ``transformed``; takes bit-reversed order."""
    a = rows.copy()
    count, n = a.shape
    half = 1
    while half < n:
        pairs = a.reshape(count, -1, 2, half)
        u, v = pairs[:, :, 0], pairs[:, :, 1] * _powers(half, True) % _P
        low, high = (u + v) % _P, (u + _P - v) % _P
        pairs[:, :, 0], pairs[:, :, 1] = low, high
        half *= 2
    return a * np.uint64(pow(n, -1, PRIME)) % _P


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sum over i of (block[i] - window[j + i]) ** 2 modulo PRIME, for j = 0 .. B; windows are twice as long as blocks."""
    width = blocks.shape[1]
    x = np.zeros_like(windows, dtype=np.uint64)
    x[:, :width] = blocks[:, ::-1]
    t = windows.astype(np.uint64)
    # Cyclic, as long as the window: what wraps round falls on places before the first whole overlap.
    cross = transformed_back(transformed(x) * transformed(t) % _P)[:, width - 1 :]
    squares = np.zeros((len(t), 2 * width + 1), np.uint64)
    np.cumsum(t * t % _P, axis=1, out=squares[:, 1:])
    theirs = squares[:, width:] - squares[:, : width + 1]
    mine = (blocks.astype(np.uint64) ** 2 % _P).sum(1, keepdims=True)
    return (mine + theirs + 2 * (_P - cross)) % _P


def next_distances(ids: np.ndarray) -> np.ndarray:
    """Words to go until the same word comes again; the text's length where it does not."""
    n = len(ids)
    order = np.argsort(ids.astype(np.uint16) if n < 1 << 16 else ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    ahead = np.full(n, n, np.int64)
    ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return ahead


def _equal_stretch(ids: np.ndarray, low: int, high: int, d: int) -> tuple[int, int]:
    """The longest [l, r) around [low, high) with ids[i] == ids[i + d] for all i in it, or (low, low) if not all are equal there."""
    n = len(ids) - d
    if not np.array_equal(ids[low:high], ids[low + d : high + d]):
        return low, low
    step = 16
    while high < n:
        end = min(high + step, n)
        apart = np.flatnonzero(ids[high:end] != ids[high + d : end + d])
        if len(apart):
            high += int(apart[0])
            break
        high, step = end, 2 * step
    step = 16
    while low > 0:
        start = max(low - step, 0)
        apart = np.flatnonzero(ids[start:low] != ids[start + d : low + d])
        if len(apart):
            low = start + int(apart[-1]) + 1
            break
        low, step = start, 2 * step
    return low, high


class _Runs:
    """Runs found so far, and whether a stretch lies in one."""

    def __init__(self) -> None:
        self.found: list[Run] = []
        self.stretches: set[tuple[int, int]] = set()
        self.spans: list[tuple[int, int]] = []  # in order
        self.arrays: tuple[np.ndarray, np.ndarray] | None = None

    def add(self, run: Run) -> None:
        self.found.append(run)
        self.stretches.add(run[:2])
        insort(self.spans, (run[0], run[0] + run[1]))
        self.arrays = None

    def hold(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether [low, high) lies in one run: some run that starts no later reaches as far."""
        if not self.spans:
            return np.zeros(len(low), bool)
        if self.arrays is None:
            starts, ends = np.array(self.spans, np.int64).T
            self.arrays = starts, np.maximum.accumulate(ends)
        starts, reach = self.arrays
        at = np.searchsorted(starts, low, "right") - 1
        return (at >= 0) & (reach[np.maximum(at, 0)] >= high)


def _seeds(ids: np.ndarray, at: np.ndarray, width: int, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block starts, distances) of the occurrences of blocks ``shift`` to ``shift + width`` words later."""
    n = len(ids)
    padded = np.concatenate([ids, np.full(shift + 2 * width, ids.max() + 1 if n else 0)])  # a word that no text has
    many = max(1, CHUNK // (2 * width))
    for k in range(0, len(at), many):
        part = at[k : k + many]
        blocks = padded[part[:, None] + np.arange(width)]
        windows = padded[part[:, None] + shift + np.arange(2 * width)]
        row, j = np.nonzero(squared_differences(blocks, windows) == 0)
        keep = shift + j > 0
        yield part[row[keep]], (shift + j)[keep]


def runs_of(ids: np.ndarray, least: int = LEAST, smallest: int = SMALLEST) -> list[Run]:
    """All runs of a sequence of word numbers, by start and then period."""
    if least < 3 * smallest - 2:
        raise ValueError("a run of a small period must hold a whole block of the first scale")
    n, runs = len(ids), _Runs()
    if n < least:
        return []
    ids = ids.astype(np.int64)
    width, furthest = smallest, next_distances(ids)[: n // smallest * smallest].reshape(-1, smallest).max(1)
    while width <= max(n // TIMES, smallest):
        # All words of the block come again soon enough; windows inside a run have been dealt with.
        at = np.flatnonzero(furthest <= 2 * width) * width
        at = at[~runs.hold(at, np.minimum(at + 3 * width, n))]
        for shift in (0, width) if width == smallest else (width,):
            found = list(_seeds(ids, at, width, shift)) if len(at) else []
            if not found:
                continue
            starts, distances = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((starts, distances))
            starts, distances = starts[order], distances[order]
            for k in np.flatnonzero(np.diff(distances, prepend=-1)).tolist():
                d = int(distances[k])
                mine = starts[k : np.searchsorted(distances, d, "right")]
                mine = mine[~runs.hold(mine, mine + d + width)]
                done = -1  # stretches of one distance come in order; seeds before ``done`` gave one
                for b in mine.tolist():
                    if b < done:
                        continue
                    low, done = _equal_stretch(ids, b, b + width, d)
                    length = done - low + d
                    if done > low and length >= max(least, TIMES * d) and (low, length) not in runs.stretches:
                        runs.add((low, length, d))
        width *= 2
        even = len(furthest) // 2 * 2
        furthest = np.maximum(furthest[0:even:2], furthest[1:even:2])
    return sorted(runs.found, key=lambda r: (r[0], r[2]))


def numbered(words: Sequence[bytes]) -> np.ndarray:
    """Words as numbers, equal ones alike, by first occurrence."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def kept_words(n: int, runs: Sequence[Run]) -> np.ndarray:
    """Which of n words stay when every run is cut down to its first period."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return keep


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
    for batch in batches:
        runs, counts, texts = [], [], []
        for text in batch.column("text"):
            words = text.as_py().encode().split()  # bytes split at the same characters as the contracts' words
            mine = runs_of(numbered(words))
            if mine:
                words = [words[i] for i in np.flatnonzero(kept_words(len(words), mine)).tolist()]
            counts.append(len(words))
            texts.append(b" ".join(words).decode())
            runs.append([dict(zip(("start", "length", "period"), r)) for r in mine])
        columns = [pa.array(runs, kind), pa.array(counts, pa.int64()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "runs", "n_kept", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, runs (array of start, length, period), n_kept, collapsed (text without repeated periods)."""
    return docs.select(F.col("doc_id").cast("bigint"), whole_text().alias("text")).mapInArrow(
        _collapsed, "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, n_kept bigint, collapsed string"
    )


def best_run(runs: Column) -> Column:
    """The run with the greatest length / period, the first of equals; null without runs."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")

    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    return F.aggregate(runs, none, better)


def with_periods(docs: DataFrame) -> DataFrame:
    """The contract's texts: in every tenth document, by crc32 of the id, words from one on repeat with one period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    n = F.size("_words")
    bare = docs.select(F.col("doc_id").cast("bigint"), whole_text().alias("text"))
    chosen = bare.withColumn("_g", F.floor(h / 10)).withColumn("_chosen", F.coalesce(h % 10 == 0, F.lit(False)))
    words = F.when(F.col("_chosen"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    split = computed_once(chosen, _words=words).withColumn("_a", F.when(n > 0, F.pmod("_g", n)).cast("int"))
    period = (1 + F.floor((n - F.col("_a")) / (3 + F.pmod("_g", F.lit(8))))).cast("int")
    a, p = F.col("_a"), F.col("_p")
    repeated = F.transform("_words", lambda w, i: F.when(i < a, w).otherwise(F.get("_words", a + (i - a) % p)))
    text = F.when(F.col("_chosen") & (n > 0), F.array_join(repeated, " ")).otherwise(F.col("text"))
    return split.withColumn("_p", period).select("doc_id", text.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periods(documents(spark, sf_dir)))
    best = found.withColumn("_best", best_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    start, length, period = (F.col(f"_best.{c}") for c in ("start", "length", "period"))
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_kept",
    )
