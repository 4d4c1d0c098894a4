"""Repeated passages removed by automata of recurring phrases.

A window is ``WINDOW`` consecutive words of a document; a word is removed when some window over it also starts
earlier (in a document with a smaller id, or earlier in the same one). The work is in three steps:

1. Every window has an anchor, its ``PHRASE``-word phrase with the least hash, so equal windows have equal
   anchors. Units of documents ask the shards of the hash space which anchors recur anywhere.
2. A unit compiles the recurring phrases that it holds into an Aho-Corasick automaton (its shard of the whole
   dictionary; no unit needs phrases it does not hold) and streams all its documents through it, which locates
   every occurrence. Windows around occurrences are the candidates; all other windows are unique.
3. Candidate windows, one entry for each distinct one of a unit, go to shards by hash (96 bits), which tell
   whose occurrence is first. Everything else of the window's occurrences is covered and removed.

Null and empty texts have no words; their digest is that of the empty text. Rows repeated with the same doc_id
and text are alike and do not remove each other; rows without doc_id come after all others and count as one
document. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from querylens.llm.common import documents
from querylens.llm.exchange import Unit, anchors, from_planes, planes, rounds, runs, units
from querylens.llm.words import blocks, mixed, spans_hashed, word_hashes

WINDOW, PHRASE = 20, 6
UNIT_BYTES = 8 << 20
ANCHOR_BYTES = 6
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


class Words:
    """Words of a unit: hashes, byte spans, documents, and where phrases and windows may start."""

    def __init__(self, unit: Unit):
        hashes, starts, ends, counts = [], [], [], [np.zeros(1, np.int64)]
        for low, high in blocks(unit.offsets):
            base = unit.offsets[low]
            h, s, e, c = word_hashes(unit.data[base : unit.offsets[high]], unit.offsets[low : high + 1] - base)
            counts.append(c[1:] + counts[-1][-1])
            hashes.append(h)
            starts.append(s + base)
            ends.append(e + base)
        empty = np.zeros(0, np.int64)
        self.hashes = np.concatenate([empty.astype(np.uint64), *hashes])
        self.starts, self.ends = np.concatenate([empty, *starts]), np.concatenate([empty, *ends])
        self.counts = np.concatenate(counts)
        n = len(self.hashes)
        self.left = np.repeat(self.counts[1:], np.diff(self.counts)) - np.arange(n)  # words to the document's end
        self.window = self.left >= WINDOW

    def spans(self, values: np.ndarray, length: int) -> np.ndarray:
        """Hash of ``length`` words from each word on (to the end of all words at most)."""
        n = len(values)
        out = np.zeros(n, np.uint64)
        for low in range(0, n, 1 << 21):  # powers are kept for spans of this many words
            part = values[low : low + (1 << 21) + length]
            at = np.arange(min(1 << 21, n - low))
            out[low : low + len(at)] = spans_hashed(part, at, np.minimum(at + length, len(part)))
        return out

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the phrase from each word on, and which are anchors."""
        hashes = np.where(self.left >= PHRASE, self.spans(self.hashes, PHRASE) | np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
        return hashes, anchors(hashes, WINDOW - PHRASE + 1, self.window)


def _asked(words: Words, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors in order of shard and hash: a place of each, their hash, shard and whether several."""
    hashes, is_anchor = words.phrases()
    at = np.flatnonzero(is_anchor)
    short = hashes[at] >> np.uint64(64 - 8 * ANCHOR_BYTES)
    distinct, first, count = np.unique(short, return_index=True, return_counts=True)
    shard = (mixed(distinct) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return at[first[order]], distinct[order], shard[order], count[order] > 1


def answer_recurring(shard: int, rows: list[tuple]) -> list[tuple]:
    """Which of a unit's anchors occur more than once in all units. Parts: hashes, flags."""
    hashes = [from_planes(r[2], np.uint64, ANCHOR_BYTES) for r in rows]
    flags = np.concatenate([np.frombuffer(r[3], np.uint8) for r in rows])
    _, each, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    several = np.bincount(each, flags) + count > 1
    out, at = [], 0
    for row, h in zip(rows, hashes):
        out.append((shard, row[1], np.packbits(several[each[at : at + len(h)]]).tobytes()))
        at += len(h)
    return out


def answer_first(shard: int, rows: list[tuple]) -> list[tuple]:
    """Whether a unit's first occurrence of a window is the first of all. Parts: two hashes, ids, starts."""
    sizes = [len(r[3]) // 4 for r in rows]
    h1 = np.concatenate([from_planes(r[2], np.uint64) for r in rows])
    h2 = np.concatenate([from_planes(r[3], np.uint32) for r in rows])
    ids = np.concatenate([from_planes(r[4], np.int64) for r in rows])
    starts = np.concatenate([from_planes(r[5], np.int64, 5) for r in rows])
    order = np.lexsort((starts, ids, h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # the first occurrence of each entry's window
    first = np.zeros(len(order), bool)
    first[order] = (ids[order] == ids[head]) & (starts[order] == starts[head])
    out, at = [], 0
    for row, n in zip(rows, sizes):
        out.append((shard, row[1], np.packbits(first[at : at + n]).tobytes()))
        at += n
    return out


def located(unit: Unit, words: Words, recurring: np.ndarray) -> np.ndarray:
    """Where recurring phrases occur, found by an automaton over all documents. recurring: a place of each."""
    out = np.zeros(len(words.hashes) + 1, np.int64)
    if not len(recurring):
        return out
    raw = unit.data.tobytes()

    def plain(i: int, j: int) -> str:
        """Words i to j with a space before and after each."""
        return f" {b' '.join(raw[words.starts[i] : words.ends[j - 1]].split()).decode()} "

    automaton = ahocorasick.Automaton()
    for place in recurring.tolist():
        automaton.add_word(plain(place, place + PHRASE), 1)
    automaton.make_automaton()
    heads = np.concatenate([[0], np.cumsum((unit.data & 0xC0) != 0x80)])
    length = heads[words.ends] - heads[words.starts] + 1
    for i, j in zip(words.counts[:-1].tolist(), words.counts[1:].tolist()):
        if j - i < WINDOW:
            continue
        found = [end for end, _ in automaton.iter(plain(i, j))]
        if found:
            out[i + np.searchsorted(np.cumsum(length[i:j]), found) - PHRASE + 1] = 1
    return out


def candidates(words: Words, occurs: np.ndarray) -> np.ndarray:
    """Starts of windows that hold an occurrence of a recurring phrase."""
    so_far = np.concatenate([[0], np.cumsum(occurs)])
    n = len(words.hashes)
    at = np.flatnonzero(words.window)
    return at[so_far[np.minimum(at + WINDOW - PHRASE + 1, n)] > so_far[at]]


def _firsts(unit: Unit, words: Words, at: np.ndarray, shards: int):
    """Distinct candidate windows in order of shard: hashes, shard, id and start of the first, and each one's."""
    h1 = words.spans(words.hashes, WINDOW)[at]
    h2 = (words.spans(mixed(words.hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), WINDOW)[at] >> np.uint64(32)).astype(np.uint32)
    document = np.searchsorted(words.counts, at, "right") - 1
    ids, starts = unit.ids[document], at - words.counts[document]
    order = np.lexsort((starts, ids, h2, h1))
    new = np.ones(len(at), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    heads = order[new]
    group = np.zeros(len(at), np.int64)
    group[order] = np.cumsum(new) - 1
    shard = (mixed(h1[heads]) % np.uint64(shards)).astype(np.int64)
    by_shard = np.argsort(shard, kind="stable")
    place = np.zeros(len(heads), np.int64)
    place[by_shard] = np.arange(len(heads))
    return h1, h2, ids, starts, heads[by_shard], shard[by_shard], place[group]


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256."""
    dealt, shards = units(docs, UNIT_BYTES)

    def ask(unit: Unit):
        words = Words(unit)
        _, hashes, shard, several = _asked(words, shards)
        for s, a, b in runs(shard):
            yield s, unit.number, planes(hashes[a:b], ANCHOR_BYTES), several[a:b].astype(np.uint8).tobytes()

    def told(shard: np.ndarray, answers: dict) -> np.ndarray:
        bits = [np.unpackbits(np.frombuffer(answers[s][0], np.uint8), count=b - a) for s, a, b in runs(shard)]
        return np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)

    def ask_again(unit: Unit, answers: dict):
        words = Words(unit)
        place, _, shard, _ = _asked(words, shards)
        at = candidates(words, located(unit, words, place[told(shard, answers)]))
        h1, h2, ids, starts, heads, to, _ = _firsts(unit, words, at, shards)
        rows = []
        for s, a, b in runs(to):
            h = heads[a:b]
            rows.append((s, unit.number, planes(h1[h]), planes(h2[h]), planes(ids[h]), planes(starts[h], 5)))
        mark = np.zeros(len(words.hashes), np.uint8)
        mark[at] = 1
        return rows, [np.packbits(mark).tobytes()]

    def finish(unit: Unit, answers: dict, state: list[bytes]) -> pa.Table:
        words = Words(unit)
        n = len(words.hashes)
        at = np.flatnonzero(np.unpackbits(np.frombuffer(state[0], np.uint8), count=n))
        _, _, ids, starts, heads, to, group = _firsts(unit, words, at, shards)
        first = told(to, answers)
        head = heads[group]
        gone = at[~first[group] | (ids != ids[head]) | (starts != starts[head])] if len(at) else at
        edges = np.zeros(n + WINDOW + 1, np.int64)
        np.add.at(edges, gone, 1)
        np.add.at(edges, gone + WINDOW, -1)
        removed = np.cumsum(edges)[:n] > 0
        raw = unit.data.tobytes()
        so_far = np.concatenate([[0], np.cumsum(removed)])
        out = []
        for i, j in zip(words.counts[:-1].tolist(), words.counts[1:].tolist()):
            if so_far[i] == so_far[j]:
                text = b" ".join(raw[words.starts[i] : words.ends[j - 1]].split()) if j > i else b""
            else:
                text = b" ".join([raw[words.starts[w] : words.ends[w]] for w in (i + np.flatnonzero(~removed[i:j])).tolist()])
            out.append((j - i, int(so_far[j] - so_far[i]), hashlib.sha256(text).hexdigest()))
        counts, lost, digests = list(zip(*out))
        return pa.table([unit.column, pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(digests)], schema=_SCHEMA)

    return rounds(
        dealt, ask, answer_recurring, ask_again, answer_first, finish,
        "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string", _SCHEMA.empty_table(), shards,
    )


def op9_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir))
