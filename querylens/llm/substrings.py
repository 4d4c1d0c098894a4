"""Suffix-array dedup of repeated byte strings, sorted by linear grouping.

A byte is removed when some ``LENGTH``-byte string over it also starts in a document with a smaller id. Texts are
taken as UTF-8 and strings never cross documents. The work is in three steps:

1. Every string of LENGTH bytes has an anchor, its ``ANCHOR``-byte string with the least hash, so equal strings
   have equal anchors. Units of documents ask the shards of the hash space which anchors occur in several
   documents.
2. For every such anchor a unit sends its surroundings (all strings with this anchor lie in them), each distinct
   one once with the smallest id that has it. A shard joins equal surroundings, and where an anchor has different
   ones it sorts their suffixes (``suffix_array``): strings with equal beginnings become neighbours, and every
   run of neighbours gets its smallest id. It answers, for each string of a surrounding, whether a smaller id has it.
   An anchor with more than ``SURROUNDINGS`` of them, counted in step 1, is hot: units send its strings themselves,
   by the strings' own hash and each distinct one once with its smallest id, so they spread over all shards at one
   entry per unit and string.
3. Units mark the strings and cut the bytes.

The suffix array is built by grouping: suffixes are grouped by their Lyndon prefix, the longest Lyndon word they
begin with. Groups are processed from the greatest to the least; the members of a group extend the words of
their previous smaller suffixes, which are moved behind their old groups. When all groups are done, suffixes are
put in order within their groups in one pass from the least suffix on, each one placing the suffixes whose
Lyndon prefix ends where it begins. No rank is ever assigned anew by recursion.

Null and empty texts have no bytes. Rows repeated with the same doc_id are one document and do not remove each
other; rows without doc_id come after all others and count as one document. Columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from querylens.llm.common import documents
from querylens.llm.exchange import Unit, anchors, from_planes, planes, rounds, runs, units
from querylens.llm.words import BYTE_VALUES, mixed, spans_hashed

LENGTH, ANCHOR = 50, 20
REACH = LENGTH - ANCHOR
UNIT_BYTES = 8 << 20
ANCHOR_BYTES = 6
SLICE = 1 << 20
# Text sorted at a time. An anchor's surroundings stay together, and those of one that is not hot always fit.
ARRAY_BYTES = 1 << 18
SURROUNDINGS = ARRAY_BYTES // (REACH + LENGTH)
# Bytes of a count of surroundings in a unit.
COUNT_BYTES = 4
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of a sequence of small numbers in ascending order (a shorter one before those it begins).

    Groups are intervals of ``order``; ``head`` gives the first place of a suffix's group, which names it.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    first = np.argsort(text, kind="stable")
    value = text[first]
    starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    sizes = np.diff(np.append(starts, n))
    heads = np.empty(n, np.int64)
    heads[first] = np.repeat(starts, sizes)
    order, head = first.tolist(), heads.tolist()
    place = np.empty(n, np.int64)
    place[first] = np.arange(n)
    place = place.tolist()
    size = np.zeros(n, np.int64)
    size[starts] = sizes
    size = size.tolist()
    previous = [-1] * n  # the previous smaller suffix, once a suffix's group is processed
    end = n
    while end > 0:
        at = head[order[end - 1]]
        grown: dict[int, int] = {}  # suffix -> how many words of this group it takes on
        for s in sorted(order[at:end]):
            p = s - 1
            while p >= 0 and head[p] >= at:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                grown[p] = grown.get(p, 0) + 1
        end = at
        by_group: dict[int, list[int]] = {}
        for p in grown:
            by_group.setdefault(head[p], []).append(p)
        for h, moved in by_group.items():
            # Behind what stays in the group; those that take on more words come later, in groups of their own.
            if len(moved) > 1:
                moved.sort(key=grown.__getitem__)
            slot = h + size[h]
            start = slot - len(moved)
            for p in reversed(moved):
                slot -= 1
                q, was = order[slot], place[p]
                order[slot], order[was] = p, q
                place[p], place[q] = slot, was
            size[h] = start - h
            words = -1
            for k, p in enumerate(moved, start):
                if grown[p] != words:
                    words, new = grown[p], k
                    size[new] = 0
                head[p] = new
                size[new] += 1
    result, free, placed = [0] * n, list(range(n)), bytearray(n)
    for i in range(-1, n):
        s = n - 1 if i < 0 else result[i] - 1
        while s >= 0 and not placed[s]:
            h = head[s]
            result[free[h]] = s
            free[h] += 1
            placed[s] = 1
            s = previous[s]
    return np.array(result)


class Strings:
    """Anchors of a unit's documents and the surroundings they are sent with."""

    def __init__(self, unit: Unit, place: np.ndarray | None = None):
        """``place``: where the anchors are, if that is known already."""
        self.unit = unit
        self.place, hashes = self.found() if place is None else (place, self.at(place))
        self.anchor = hashes >> np.uint64(64 - 8 * ANCHOR_BYTES)
        self.document = np.searchsorted(unit.offsets, self.place, "right") - 1

    def at(self, place: np.ndarray) -> np.ndarray:
        """Hashes of the anchors at given places."""
        hashes, data = np.zeros(len(place), np.uint64), self.unit.data
        for low in range(0, len(data), SLICE):
            i, j = np.searchsorted(place, [low, low + SLICE])
            if j > i:
                mine = place[i:j] - low
                hashes[i:j] = spans_hashed(BYTE_VALUES[data[low : low + SLICE + ANCHOR]], mine, mine + ANCHOR) | np.uint64(1)
        return hashes

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all anchors."""
        unit, n = self.unit, len(self.unit.data)
        places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for low in range(0, n, SLICE):
            a, b = max(low - LENGTH, 0), min(low + SLICE + 2 * LENGTH, n)
            at = np.arange(a, b)
            document = np.searchsorted(unit.offsets, [a, b], "right") - 1
            edges = np.clip(unit.offsets[document[0] : document[1] + 2], a, b)
            ends = np.repeat(unit.offsets[document[0] + 1 : document[1] + 2][: len(edges) - 1], np.diff(edges))
            left = np.minimum(ends, b) - at
            reach = np.minimum(np.arange(b - a) + ANCHOR, b - a)
            h = spans_hashed(BYTE_VALUES[unit.data[a:b]], np.arange(b - a), reach) | np.uint64(1)
            h = np.where(left >= ANCHOR, h, np.uint64(0xFFFFFFFFFFFFFFFF))
            mine = np.flatnonzero(anchors(h, REACH + 1, left >= LENGTH)) + a
            mine = mine[(mine >= low) & (mine < low + SLICE)]
            places.append(mine)
            hashes.append(h[mine - a])
        return np.concatenate(places), np.concatenate(hashes)

    def asked(self, shards: int):
        """Distinct anchors in order of shard: hash, shard, whether in several documents, and each place's."""
        distinct, first, each = np.unique(self.anchor, return_index=True, return_inverse=True)
        several = np.zeros(len(distinct), bool)
        ids = self.unit.ids[self.document]
        several[each[ids != ids[first][each]]] = True
        shard = (mixed(distinct) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return distinct[order], shard[order], several[order], rank[each]

    def around(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the surroundings of the chosen places begin and end."""
        place, document = self.place[chosen], self.document[chosen]
        return np.maximum(place - REACH, self.unit.offsets[document]), np.minimum(place + LENGTH, self.unit.offsets[document + 1])

    def hashed(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of spans no longer than a surrounding."""
        data = self.unit.data
        content = np.zeros(len(begin), np.uint64)
        for low in range(0, len(data), SLICE):
            mine = np.flatnonzero((begin >= low) & (begin < low + SLICE))
            if len(mine):
                part = BYTE_VALUES[data[low : low + SLICE + REACH + LENGTH]]
                content[mine] = spans_hashed(part, begin[mine] - low, end[mine] - low)
        return content

    def varied(self, each: np.ndarray, count: int) -> np.ndarray:
        """How many different surroundings each of the unit's ``count`` anchors has here; each: a place's anchor."""
        often = np.flatnonzero(np.bincount(each, minlength=count)[each] > 1)
        begin, end = self.around(often)
        kind = (each[often] * (LENGTH + 1) + self.place[often] - begin).astype(np.uint64)
        _, first = np.unique(mixed(kind) ^ self.hashed(begin, end), return_index=True)
        return np.maximum(np.bincount(each[often[first]], minlength=count), 1)

    def strings(self, hot: np.ndarray, shards: int):
        """Starts of the strings whose anchor is at one of the hot places, and the distinct strings in order of shard.

        Other strings around a hot place have another anchor, with a smaller hash, and are compared there.
        """
        u = self.unit
        begin, end = self.around(hot)
        low, high = begin, end - LENGTH
        for step in range(1, REACH + 1):
            near = np.zeros(len(hot), bool)
            for other in (hot - step, hot + step):
                there = (other >= 0) & (other < len(self.place))
                other = np.where(there, other, hot)
                away = self.place[other] - self.place[hot]
                there &= np.abs(away) <= REACH
                near |= there
                less = there & (self.anchor[other] < self.anchor[hot])
                low = np.where(less & (away < 0), np.maximum(low, self.place[other] + 1), low)
                high = np.where(less & (away > 0), np.minimum(high, self.place[other] - REACH - 1), high)
            if not near.any():
                break
        n = np.maximum(high - low + 1, 0)
        start = np.unique(np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum()))
        content = self.hashed(start, start + LENGTH)
        # Starts are in order of document, so the first of equal strings has the smallest id.
        _, head, each = np.unique(content, return_index=True, return_inverse=True)
        shard = (mixed(content[head]) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        document = np.searchsorted(u.offsets, start, "right") - 1
        return start, document, head[order], shard[order], rank[each]

    def surroundings(self, chosen: np.ndarray, shards: int):
        """Distinct surroundings of the chosen places in order of shard and anchor, with their first document."""
        place, document, anchor = self.place[chosen], self.document[chosen], self.anchor[chosen]
        begin, end = self.around(chosen)
        content = self.hashed(begin, end)
        shard = (mixed(anchor) % np.uint64(shards)).astype(np.int64)
        # Places are in order of document, so the first of equal surroundings has the smallest id.
        order = np.lexsort((content, place - begin, anchor, shard))
        new, o = np.ones(len(order), bool), order
        new[1:] = (content[o][1:] != content[o][:-1]) | ((place - begin)[o][1:] != (place - begin)[o][:-1]) | (anchor[o][1:] != anchor[o][:-1])
        head = o[new]
        each = np.empty(len(o), np.int64)
        each[o] = np.cumsum(new) - 1
        return begin, end, document, place, head, shard[head], each


def answer_recurring(shard: int, rows: list[tuple]) -> list[tuple]:
    """Which of a unit's anchors are in several documents, and which are hot. Parts: hashes, flags, surroundings."""
    hashes = [from_planes(r[2], np.uint64, ANCHOR_BYTES) for r in rows]
    flags = np.concatenate([np.frombuffer(r[3], np.uint8) for r in rows])
    _, each, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    several = np.bincount(each, flags) + count > 1
    varied = np.concatenate([from_planes(r[4], np.uint32, COUNT_BYTES) for r in rows])
    hot = several & (np.bincount(each, varied) > SURROUNDINGS)
    out, at = [], 0
    for row, h in zip(rows, hashes):
        mine = each[at : at + len(h)]
        out.append((shard, row[1], np.packbits(several[mine]).tobytes(), np.packbits(hot[mine]).tobytes()))
        at += len(h)
    return out


def answer_hot(rows: list[tuple]) -> list[bytes]:
    """For each string of a hot anchor whether a smaller id has it."""
    least: dict[bytes, int] = {}
    asked = []
    for row in rows:
        ids = from_planes(row[6], np.int64)
        texts = [row[7][a : a + LENGTH] for a in range(0, len(row[7]), LENGTH)]
        for text, i in zip(texts, ids.tolist()):
            if i < least.setdefault(text, i):
                least[text] = i
        asked.append((ids, texts))
    return [np.packbits(np.array([least[t] for t in texts], np.int64) < ids).tobytes() for ids, texts in asked]


def _most_shared(sides: list[bytes]) -> list[int]:
    """For each text the longest beginning that it has in common with another one."""
    padded = [int.from_bytes(x.ljust(REACH, b"\0"), "big") for x in sides]
    order = sorted(range(len(sides)), key=padded.__getitem__)
    out = [0] * len(sides)
    for i, j in zip(order, order[1:]):
        same = REACH - ((padded[i] ^ padded[j]).bit_length() + 7) // 8
        same = min(same, len(sides[i]), len(sides[j]))
        out[i], out[j] = max(out[i], same), max(out[j], same)
    return out


Part = tuple[bytes, int, list[tuple[int, int]]]  # text, smallest id, and the (surrounding, place) that have it


def shared_parts(group: list[int], texts: list[bytes], left_of: np.ndarray, least: np.ndarray) -> list[Part]:
    """Distinct parts of an anchor's surroundings that can hold a string of two of them.

    To either side of the anchor no further than any other surrounding agrees.
    """
    lefts = [int(left_of[j]) for j in group]
    left = _most_shared([texts[j][:n][::-1] for j, n in zip(group, lefts)])
    right = _most_shared([texts[j][n + ANCHOR :] for j, n in zip(group, lefts)])
    found: dict[tuple[int, bytes], tuple[list[int], list[tuple[int, int]]]] = {}
    for j, n, a, b in zip(group, lefts, left, right):
        if a + ANCHOR + b >= LENGTH:
            ids, owners = found.setdefault((a, texts[j][n - a : n + ANCHOR + b]), ([], []))
            ids.append(int(least[j]))
            owners.append((j, n - a))
    return [(text, min(ids), owners) for (_, text), (ids, owners) in found.items()]


def smaller_elsewhere(contexts: list[bytes], least: np.ndarray) -> np.ndarray:
    """For each surrounding and each of its strings, the smallest id that has the string.

    A matrix with a column for each start, NO_ID past the last one.
    """
    sizes = np.array([len(c) for c in contexts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    text = np.zeros(int((sizes + 1).sum()), np.int16)  # 0 between surroundings, below all bytes
    body = np.ones(len(text), bool)
    body[starts + sizes] = False
    text[body] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int16) + 1
    order = suffix_array(text)
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)[order]
    begin = order - starts[owner]
    strings = begin <= sizes[owner] - LENGTH
    order, owner, begin = order[strings], owner[strings], begin[strings]
    out = np.full((len(contexts), REACH + 1), np.iinfo(np.int64).max)
    if not len(order):
        return out
    new = np.ones(len(order), bool)
    for low in range(1, len(order), 1 << 16):  # neighbours with equal strings
        high = min(low + (1 << 16), len(order))
        rows = text[order[low - 1 : high][:, None] + np.arange(LENGTH)]
        new[low:high] = (rows[1:] != rows[:-1]).any(1)
    smallest = np.minimum.reduceat(least[owner], np.flatnonzero(new))[np.cumsum(new) - 1]
    out[owner, begin] = smallest
    return out


def answer_strings(shard: int, rows: list[tuple]) -> list[tuple]:
    """For each surrounding a bit for each of its strings: a smaller id has it, and the same for strings of hot anchors.

    Parts: ids, lefts, sizes and bytes of surroundings, ids and bytes of strings.
    """
    ids = np.concatenate([from_planes(r[2], np.int64) for r in rows])
    lefts = np.concatenate([np.frombuffer(r[3], np.uint8) for r in rows]).astype(np.int64)
    sizes = np.concatenate([np.frombuffer(r[4], np.uint8) for r in rows]).astype(np.int64)
    raw = b"".join(r[5] for r in rows)
    ends = np.cumsum(sizes)
    known: dict[tuple[int, bytes], int] = {}
    texts: list[bytes] = []
    least, left_of = [], []
    each = np.empty(len(ids), np.int64)
    for k, (i, left, b, size) in enumerate(zip(ids.tolist(), lefts.tolist(), ends.tolist(), sizes.tolist())):
        text = raw[b - size : b]
        j = known.setdefault((left, text), len(texts))
        if j == len(texts):
            texts.append(text)
            least.append(i)
            left_of.append(left)
        elif i < least[j]:
            least[j] = i
        each[k] = j
    least, left_of = np.array(least, np.int64), np.array(left_of, np.int64)
    # Surroundings by anchor: an anchor with a single distinct one needs no comparison.
    groups: dict[bytes, list[int]] = {}
    for j, (text, left) in enumerate(zip(texts, left_of.tolist())):
        groups.setdefault(text[left : left + ANCHOR], []).append(j)
    smallest = np.repeat(least[:, None], REACH + 1, 1)
    part: list[Part] = []
    # Anchors are sorted some at a time, which bounds the memory of a suffix array.
    for group in [*(g for g in groups.values() if len(g) > 1), []]:
        if part and (not group or (len(part) + len(group)) * (REACH + LENGTH) > ARRAY_BYTES):
            found = smaller_elsewhere([text for text, _, _ in part], np.array([i for _, i, _ in part]))
            for (text, _, owners), row in zip(part, found):
                for j, at in owners:
                    smallest[j, at : at + len(text) - LENGTH + 1] = row[: len(text) - LENGTH + 1]
            part = []
        shared = shared_parts(group, texts, left_of, least)
        if len(shared) > 1:
            part += shared
        elif shared:  # all agree as far as they are shared
            ((text, smallest_id, owners),) = shared
            for j, at in owners:
                smallest[j, at : at + len(text) - LENGTH + 1] = smallest_id
    bits = (smallest[each] < ids[:, None]) & (np.arange(REACH + 1) <= (sizes - LENGTH)[:, None])
    packed = (bits << np.arange(REACH + 1)).sum(1).astype(np.uint32)
    out, at = [], 0
    for row, hot in zip(rows, answer_hot(rows)):
        n = len(row[3])
        out.append((shard, row[1], planes(packed[at : at + n]), hot))
        at += n
    return out


def cut(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    dealt, shards = units(docs, UNIT_BYTES)

    def ask(unit: Unit):
        strings = Strings(unit)
        hashes, shard, several, each = strings.asked(shards)
        varied = strings.varied(each, len(hashes)).astype(np.uint32)
        for s, a, b in runs(shard):
            yield s, unit.number, planes(hashes[a:b], ANCHOR_BYTES), several[a:b].astype(np.uint8).tobytes(), planes(varied[a:b], COUNT_BYTES)

    def ask_again(unit: Unit, answers: dict):
        strings = Strings(unit)
        _, shard, _, each = strings.asked(shards)
        bits = [[np.unpackbits(np.frombuffer(answers[s][i], np.uint8), count=b - a) for s, a, b in runs(shard)] for i in range(2)]
        chosen, hot = (np.concatenate([np.zeros(0, np.uint8), *x]).astype(bool)[each] for x in bits)
        chosen &= ~hot
        begin, end, document, place, head, to, _ = strings.surroundings(np.flatnonzero(chosen), shards)
        raw = unit.data.tobytes()
        rows: dict[int, list[bytes]] = {}
        for s, a, b in runs(to):
            h = head[a:b]
            text = b"".join([raw[i:j] for i, j in zip(begin[h].tolist(), end[h].tolist())])
            left, size = (place[h] - begin[h]).astype(np.uint8), (end[h] - begin[h]).astype(np.uint8)
            rows[s] = [planes(unit.ids[document[h]]), left.tobytes(), size.tobytes(), text, b"", b""]
        start, document, head, to, _ = strings.strings(np.flatnonzero(hot), shards)
        for s, a, b in runs(to):
            h = head[a:b]
            text = b"".join([raw[i : i + LENGTH] for i in start[h].tolist()])
            rows[s] = [*rows.get(s, [b""] * 4)[:4], planes(unit.ids[document[h]]), text]
        rows = [(s, unit.number, *parts) for s, parts in rows.items()]
        # Most gaps fit a byte, so a unit's places are told by a byte each, and looked for only twice.
        gaps = np.diff(strings.place, prepend=0)
        return rows, [np.packbits(chosen).tobytes(), np.packbits(hot).tobytes(), planes(gaps.astype(np.int64), 5)]

    def finish(unit: Unit, answers: dict, state: list[bytes]) -> pa.Table:
        strings = Strings(unit, np.cumsum(from_planes(state[2], np.int64, 5)))
        chosen, hot = (np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), count=len(strings.place))) for x in state[:2])
        begin, end, document, _, head, to, each = strings.surroundings(chosen, shards)
        packed = np.concatenate([np.zeros(0, np.uint32), *[from_planes(answers[s][0], np.uint32) for s, _, _ in runs(to)]])
        edges = np.zeros(len(unit.data) + 1, np.int32)
        # A later document has every string of its surrounding again; the first one may have some.
        later = unit.ids[document] != unit.ids[document[head]][each] if len(each) else np.zeros(0, bool)
        np.add.at(edges, begin[later], 1)
        np.add.at(edges, end[later], -1)
        rest = np.flatnonzero(~later & (packed[each] > 0)) if len(each) else np.zeros(0, np.int64)
        for k in range(REACH + 1):
            hit = rest[(packed[each[rest]] >> np.uint32(k)) & np.uint32(1) > 0]
            np.add.at(edges, begin[hit] + k, 1)
            np.add.at(edges, begin[hit] + k + LENGTH, -1)
        start, document, head, to, each = strings.strings(hot, shards)
        if len(start):
            bits = np.concatenate([np.unpackbits(np.frombuffer(answers[s][1], np.uint8), count=b - a) for s, a, b in runs(to)])
            hit = start[(unit.ids[document] != unit.ids[document[head]][each]) | (bits[each] > 0)]
            np.add.at(edges, hit, 1)
            np.add.at(edges, hit + LENGTH, -1)
        gone = np.cumsum(edges)[:-1] > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        first = unit.offsets[:-1][np.diff(unit.offsets) > 0]
        opens[first] = gone[first]
        lost, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, opens))
        raw = unit.data.tobytes()
        out = []
        for a, b in zip(unit.offsets[:-1].tolist(), unit.offsets[1:].tolist()):
            text = raw[a:b] if lost[a] == lost[b] else unit.data[a:b][~gone[a:b]].tobytes()
            out.append((b - a, int(lost[b] - lost[a]), int(spans[b] - spans[a]), hashlib.sha256(text).hexdigest()))
        columns = list(zip(*out))
        return pa.table([unit.column, *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3])], schema=_SCHEMA)

    return rounds(
        dealt, ask, answer_recurring, ask_again, answer_strings, finish,
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", _SCHEMA.empty_table(), shards,
    )


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(documents(spark, sf_dir))
