"""SentencePiece BPE with source alignment: encode, project pieces to original bytes, decode.

Normalisation reads the model's compiled character map (a double-array trie and its replacement strings): at
each place the longest prefix with a rule is replaced, and every normalised byte records the original byte it
came from. Pieces are merged by score, leftmost first, within stretches no piece of the vocabulary can cross,
and kept in a bounded cache; a piece's original byte span is read off the alignment at its two ends. Unknown
characters fall back on byte pieces, one per byte.

Each row is worked on by itself, so repeated rows give repeated results; null and empty texts give only the
begin and end ids. Other columns than ``doc_id`` and ``text`` are not read. The model (under a megabyte) travels
with the task, so its path is only read on the driver.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.llm.common import documents, text_buffers, whole_text
from querylens.llm.words import BYTE_VALUES, blocks, spans_hashed

SPACE_MARK = "▁"
CACHE_ENTRIES = 400_000
# Pieces after which encoded rows are handed on; a longer text makes a batch of its own.
BATCH_PIECES = 1 << 16
# Bytes of text encoded at a time, which bounds what a worker holds beside its input.
BLOCK_BYTES = 1 << 19
_NEVER = 1 << 60
# Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: number and value (int, or bytes)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """Compiled character map: longest-prefix rules in a double-array trie."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = struct.unpack(f"<{size // 4}I", blob[4 : 4 + size])
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest rule that begins here, and its replacement."""
        units = self.units
        found = None
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


def _lone_bytes(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("each-byte", _lone_bytes)


class Pieces(dict):
    """Stretch of normalised text -> (ids as packed uint32, bytes of each piece); a bounded cache."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, stretch: str) -> tuple[bytes, bytes]:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids, sizes = self.model.pieces_of(stretch)
        value = struct.pack(f"<{len(ids)}I", *ids), bytes(sizes)
        if len(stretch) <= 64:
            self[stretch] = value
        return value


class Model:
    def __init__(self, blob: bytes):
        pieces, normalizer = [], b""
        for number, value in _fields(blob):
            if number == 1:
                pieces.append(dict(_fields(value)))
            elif number == 3:
                normalizer = value
        spec = dict(_fields(normalizer))
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy_prefix = bool(spec.get(3, 1))
        self.squeeze = bool(spec.get(4, 1))
        self.escape = bool(spec.get(5, 1))
        texts = [p[1].decode() for p in pieces]
        kinds = [p.get(3, NORMAL) for p in pieces]
        if USER_DEFINED in kinds or UNUSED in kinds:
            raise ValueError("user-defined and unused pieces are not handled")
        scores = [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces]
        normal = [i for i, kind in enumerate(kinds) if kind == NORMAL]
        place = {s: r for r, s in enumerate(sorted({scores[i] for i in normal}, reverse=True))}
        self.rank = {texts[i]: place[scores[i]] for i in normal}
        self.ids = {texts[i]: i for i in normal}
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = {int(texts[i][3:5], 16): i for i, kind in enumerate(kinds) if kind == BYTE}
        self.begin, self.end = texts.index("<s>"), texts.index("</s>")
        # No merge crosses from a character to a following space mark, nor a character that is in no longer piece.
        crossing = any(SPACE_MARK in t.lstrip(SPACE_MARK) for t in self.rank)
        line = "" if any("\n" in t and len(t) > 1 for t in self.rank) else "\n"
        self.stretches = re.compile("(?s).+" if crossing else f"{SPACE_MARK}+[^{SPACE_MARK}{line}]*|{line or '(?!)'}|[^{SPACE_MARK}{line}]+")
        self.surface = [
            b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else bytes([int(t[3:5], 16)]) if kind == BYTE
            else t.replace(SPACE_MARK, " ").encode()
            for t, kind in zip(texts, kinds)
        ]
        self.control = {i for i, kind in enumerate(kinds) if kind == CONTROL}
        self.byte_ids = set(self.bytes.values())
        self.cache = Pieces(self)
        self.batch = Batch(self) if Batch.plain(self) else None

    # Normalisation.

    def normalized(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its bytes (and its end) the original byte offset."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze and self.escape:
            wide = np.where(np.frombuffer(data, np.uint8) == 32, 3, 1)
            source = np.repeat(np.arange(len(data)), wide)
            head = [np.zeros(3, np.int64)] if self.dummy_prefix else []
            body = text.replace(" ", SPACE_MARK)
            return SPACE_MARK * self.dummy_prefix + body, np.concatenate([*head, source, [len(data)]])
        out, source = bytearray(), []
        mark = SPACE_MARK.encode() if self.escape else b" "
        at, spaced = 0, self.squeeze

        def prefix(at: int) -> tuple[int, bytes]:
            found = self.map.longest(data, at) if self.map.units else None
            if found is None:
                byte = data[at]
                size = 1 if byte < 0x80 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                found = size, data[at : at + size]
            return found

        while self.squeeze and at < len(data):
            size, new = prefix(at)
            if new != b" ":
                break
            at += size
        if at == len(data):
            return "", np.array([at])
        if self.dummy_prefix:
            out += mark
            source += [at] * len(mark)
        while at < len(data):
            size, new = prefix(at)
            if spaced:
                new = new.lstrip(b" ")
            for byte in new:
                piece = mark if byte == 32 else bytes([byte])
                out += piece
                source += [at] * len(piece)
            if new:
                spaced = self.squeeze and new.endswith(b" ")
            at += size
        while self.squeeze and out.endswith(mark):
            at = source[-len(mark)]
            del out[-len(mark) :], source[-len(mark) :]
        return out.decode(), np.array([*source, at])

    # Merging.

    def merged(self, symbols: list[str]) -> list[str]:
        """Best-scored neighbours become one, leftmost first, until no pair is a piece."""
        get = self.rank.get
        if len(symbols) > 100:
            return self._merged_long(symbols)
        ranks = [get(a + b, _NEVER) for a, b in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(symbols[i - 1] + symbols[i], _NEVER)
            if i < len(ranks):
                ranks[i] = get(symbols[i] + symbols[i + 1], _NEVER)
        return symbols

    def _merged_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap and linked neighbours, for long stretches."""
        n, get = len(symbols), self.rank.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (rank := get(pair := symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (rank, i, j, pair))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, pair = heapq.heappop(heap)
            if after[i] != j or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -2
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s]

    def pieces_of(self, stretch: str) -> tuple[list[int], list[int]]:
        ids, sizes = [], []
        for symbol in self.merged(list(stretch)):
            known = self.ids.get(symbol)
            raw = symbol.encode()
            if known is not None or not self.bytes:
                ids.append(self.unknown if known is None else known)
                sizes.append(len(raw))
            else:
                ids += [self.bytes[b] for b in raw]
                sizes += [1] * len(raw)
        return ids, sizes

    # The whole way.

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the original byte offset where each piece begins (with one more: where the last ends)."""
        plain, source = self.normalized(text)
        found = [self.cache[s] for s in self.stretches.findall(plain)]
        ids = np.frombuffer(b"".join([f[0] for f in found]), "<u4")
        ends = np.cumsum(np.frombuffer(b"".join([f[1] for f in found]), np.uint8), dtype=np.int64)
        return ids, source[np.concatenate([[0], ends])]

    def decode(self, ids: list[int]) -> str:
        surface, control = self.surface, self.control
        parts = [surface[i] for i in ids]
        if self.dummy_prefix or self.squeeze:
            for k, i in enumerate(ids):  # the first piece loses the space put before the text
                if i not in control:
                    if i not in self.byte_ids and i != self.unknown and parts[k].startswith(b" "):
                        parts[k] = parts[k][1:]
                    break
        return b"".join(parts).decode("utf-8", "each-byte")


class Batch:
    """Many texts at once, for models whose normalisation only marks spaces: each distinct stretch is merged once.

    Stretches are told apart by a 64-bit hash; merges run over all distinct stretches of a length together, the
    best pair of every stretch in each step, exactly as one by one.
    """

    LONGEST = 48

    def __init__(self, model: Model):
        self.model = model
        alone = {c for t in model.rank for c in t} - set(model.ids)
        symbols = dict(model.ids) | {c: len(model.surface) + i for i, c in enumerate(sorted(alone))}
        self.n_symbols = len(model.surface) + len(alone)
        pairs = {
            (symbols[t[:i]], symbols[t[i:]]): t
            for t in model.rank
            for i in range(1, len(t))
            if t[:i] in symbols and t[i:] in symbols
        }
        self.bits = max(8, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NEVER, np.int64)
        self.into = np.zeros(1 << self.bits, np.int64)
        for (a, b), t in pairs.items():
            slot = self._slot(np.int64(a << 32 | b))
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.ranks[slot], self.into[slot] = a << 32 | b, model.rank[t], model.ids[t]
        singles = sorted((ord(t), i) for t, i in symbols.items() if len(t) == 1)
        self.chars = np.array([c for c, _ in singles])
        self.char_ids = np.array([i for _, i in singles])
        self.in_source = np.array([len(x) for x in model.surface])
        self.surface_at = np.concatenate([[0], np.cumsum(self.in_source)])
        self.surface = np.frombuffer(b"".join(model.surface), np.uint8)
        self.byte_ids = np.array([model.bytes.get(b, model.unknown) for b in range(256)])

    @staticmethod
    def plain(model: Model) -> bool:
        one_line = model.stretches.match("a\n").end() == 1
        return not model.map.units and not model.squeeze and model.escape and model.dummy_prefix and one_line and bool(model.bytes)

    def _slot(self, key):
        with np.errstate(over="ignore"):
            return (np.uint64(key) if np.isscalar(key) else key.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)

    def found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Table slot of each pair; an empty slot where the pair is no piece."""
        key = left << 32 | right
        slot = self._slot(key).astype(np.int64)
        open_ = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            now = self.keys[slot[open_]]
            open_ = open_[(now != key[open_]) & (now >= 0)]
        return slot

    def merged_all(self, table: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows of symbols of one length -> for each final length, which rows and their symbols."""
        rows = np.arange(len(table))
        ranks = self.ranks[self.found(table[:, :-1].ravel(), table[:, 1:].ravel())].reshape(len(table), -1)
        done = []
        while True:
            width = table.shape[1]
            if width == 1:
                done.append((rows, table))
                return done
            at = ranks.argmin(1)
            each = np.arange(len(table))
            ended = ranks[each, at] == _NEVER
            if ended.any():
                done.append((rows[ended], table[ended]))
                rows, table, ranks, at = rows[~ended], table[~ended], ranks[~ended], at[~ended]
                each = np.arange(len(table))
            if not len(rows):
                return done
            table[each, at] = self.into[self.found(table[each, at], table[each, at + 1])]
            column = np.arange(width - 1)
            table = np.take_along_axis(table, column + (column > at[:, None]), 1)
            if width == 2:
                continue
            column = column[:-1]
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), 1)
            left = each[at > 0]
            ranks[left, at[left] - 1] = self.ranks[self.found(table[left, at[left] - 1], table[left, at[left]])]
            right = each[at < width - 2]
            ranks[right, at[right]] = self.ranks[self.found(table[right, at[right]], table[right, at[right] + 1])]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin."""
        full = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][full], 32)
        offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        space, line = data == 32, data == 10
        opens = line.copy()
        opens[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        opens[offsets[:-1][full]] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(data))
        hashes = spans_hashed(BYTE_VALUES[data], starts, ends)
        _, first, each = np.unique(hashes, return_index=True, return_inverse=True)
        ids, at = self._encode_distinct(data, starts[first], ends[first])
        sizes = np.diff(at)[each]
        into = np.concatenate([[0], np.cumsum(sizes)])
        picked = np.arange(into[-1]) + np.repeat(at[each] - into[:-1], sizes)
        return ids[picked], into[np.searchsorted(starts, offsets)]

    def _encode_distinct(self, data, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        sizes = ends - starts
        where = np.concatenate([[0], np.cumsum(sizes)])
        raw = data[np.arange(where[-1]) + np.repeat(starts - where[:-1], sizes)]
        heads = (raw & 0xC0) != 0x80
        chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64)
        chars[chars == 32] = ord(SPACE_MARK)
        char_at = np.concatenate([[0], np.cumsum(heads)])[where]
        slot = np.minimum(np.searchsorted(self.chars, chars), len(self.chars) - 1)
        # A character without a piece keeps its code point, past all symbols.
        symbols = np.where(self.chars[slot] == chars, self.char_ids[slot], self.n_symbols + chars)
        lengths = np.diff(char_at)
        parts, owners = [], []
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            table = symbols[char_at[rows][:, None] + np.arange(n)]
            if n <= self.LONGEST:
                done = self.merged_all(table)
            else:
                done = [(np.array([k]), np.array([self._alone(chars[char_at[r] : char_at[r] + n])])) for k, r in enumerate(rows)]
            for some, out in done:
                parts.append(out.ravel())
                owners.append(np.repeat(rows[some], out.shape[1]))
        flat, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        flat, owner = flat[order], owner[order]
        lacking = np.flatnonzero(flat >= len(self.model.surface))
        if len(lacking):
            real = {v: t for t, v in zip(self.chars.tolist(), self.char_ids.tolist())}
            spelt = [self.byte_ids[list(chr(real.get(v, v - self.n_symbols)).encode())] for v in flat[lacking].tolist()]
            count = np.ones(len(flat), np.int64)
            count[lacking] = [len(x) for x in spelt]
            flat, owner = np.repeat(flat, count), np.repeat(owner, count)
            begin = np.concatenate([[0], np.cumsum(count)])[lacking]
            flat[np.concatenate([np.arange(b, b + len(x)) for b, x in zip(begin, spelt)])] = np.concatenate(spelt)
        return flat, np.searchsorted(owner, np.arange(len(starts) + 1))

    def _alone(self, chars: np.ndarray) -> list[int]:
        merged = self.model.merged([chr(c) for c in chars.tolist()])
        known = self.model.ids
        single = dict(zip(self.chars.tolist(), self.char_ids.tolist()))
        return [known[t] if t in known else single.get(ord(t), self.n_symbols + ord(t)) for t in merged]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes that ids stand for, before the space put in front is taken away."""
        sizes = self.in_source[ids]
        into = np.cumsum(sizes)
        return self.surface[np.arange(into[-1] if len(into) else 0) + np.repeat(self.surface_at[ids] - into + sizes, sizes)].tobytes()


_models: dict[bytes, Model] = {}


def loaded(blob: bytes) -> Model:
    """One model for a worker process."""
    key = hashlib.sha256(blob).digest()
    if key not in _models:
        _models[key] = Model(blob)
    return _models[key]


def texts_encoded(m: Model, array: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """For each text its ids, the original byte offsets between its pieces, and whether the fast way was taken."""
    data, offsets = text_buffers(array)
    fast = m.batch
    for low, high in blocks(offsets, BLOCK_BYTES):
        at = offsets[low : high + 1] - offsets[low]
        part = data[offsets[low] : offsets[high]]
        raw = part.tobytes()
        if fast is None or SPACE_MARK.encode() in raw:
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                yield *m.encode(raw[a:b].decode()), False
            continue
        flat, begins = fast.encode(part, at)
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
            ids = flat[a:b]
            # The mark put in front of a text has no source byte.
            yield ids, np.concatenate([[0], np.cumsum(fast.in_source[ids]) - 1]) if b > a else np.zeros(1, np.int64), True


def decoded_bytes(m: Model, ids: np.ndarray, fast: bool) -> bytes:
    """The decoded text of ids with begin and end; ``fast``: they were encoded the fast way."""
    return m.batch.decode(ids[~np.isin(ids, sorted(m.control))])[1:] if fast else m.decode(ids.tolist()).encode()


def encoded(docs: DataFrame, model: bytes, spans: bool = True, decoded: bool = False) -> DataFrame:
    """Per row: its columns but text, ids (with begin and end), each piece's original byte span, and the decoded text."""

    def run(batches):
        m = loaded(model)
        for batch in batches:
            done, pieces, rows = 0, 0, []
            for row in texts_encoded(m, batch.column("_text")):
                rows.append(row)
                pieces += len(row[0])
                if pieces >= BATCH_PIECES:
                    yield told(m, batch.column("_row").slice(done, len(rows)), rows)
                    done, pieces, rows = done + len(rows), 0, []
            if rows:
                yield told(m, batch.column("_row").slice(done), rows)

    def told(m: Model, others: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        ids = [np.concatenate([[m.begin], i, [m.end]]).astype(np.int32) for i, _, _ in rows]
        columns = [others, pa.array(ids, pa.list_(pa.int32()))]
        if spans:
            columns += [pa.array([e[:-1] for _, e, _ in rows], pa.list_(pa.int64())), pa.array([e[1:] for _, e, _ in rows], pa.list_(pa.int64()))]
        if decoded:
            columns.append(pa.array([decoded_bytes(m, i, fast).decode() for i, (_, _, fast) in zip(ids, rows)], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names)

    names = ["_row", "ids", *["begins", "ends"] * spans, *["decoded"] * decoded]
    others = [c for c in docs.columns if c not in ("text", *names[1:])]
    rows = docs.select(F.struct(*[F.col(c) for c in others]).alias("_row"), whole_text().alias("_text"))
    kinds = rows.schema["_row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"_row {kinds}, ids array<int>" + ", begins array<bigint>, ends array<bigint>" * spans + ", decoded string" * decoded)
    return out.select("_row.*", *names[1:])


def digests(docs: DataFrame, model: bytes) -> DataFrame:
    """Per row: doc_id, n_tokens, digests of ids, of the decoded text and of the pieces' byte spans."""

    def run(batches):
        m = loaded(model)
        for batch in batches:
            counts, id_digests, text_digests, spans = [], [], [], []
            for ids, edges, fast in texts_encoded(m, batch.column("text")):
                ids = np.concatenate([[m.begin], ids, [m.end]])
                text = decoded_bytes(m, ids, fast)
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_digests.append(hashlib.sha256(text).hexdigest())
                spans.append(hashlib.sha256(edges.astype("<i8").tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), *(pa.array(x, pa.string()) for x in (id_digests, text_digests, spans))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), whole_text().alias("text")).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    )


def model_bytes(path: str | None = None) -> bytes:
    """The model file, by default the public 32k BPE model."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        return file.read()


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), model_bytes())
