"""Two rounds of questions and answers between groups of documents and shards of a hash space.

Documents are dealt to units, a few megabytes of text each, by a hash of their id and text (so neither a missing
nor a shared id gathers rows; only rows repeated whole meet). A unit asks about hashed strings (one entry per
distinct string of the unit, however often it occurs there), every shard answers for its part of the hash space,
and the unit goes on with the answers. Texts are shuffled once; questions carry hashes. So no string, however
common, makes a task larger than an entry per unit, and nothing is gathered whole. Entries are grouped into one row
per unit and shard.

With n units and as many shards that would be n * n rows. From ``DIRECT`` units on, rows go by way of relays: units and
shards are both taken in blocks of about the square root of n. A unit sends one row per block of shards; the relay
of a block of units and a block of shards sorts what it got by shard, and sends one row per shard; answers come
back the same way. So there are n ** 1.5 rows, which carry kilobytes each even at 100 TB.

Rows may come in any order in every stage, so a unit sorts its documents by id (and text), which makes what it
asks and how it reads the answers the same each time, also when an executor is lost.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.llm.common import kept, text_buffers, whole_text

PARTS = 6
ROWS = "shard bigint, unit bigint, " + ", ".join(f"p{i} binary" for i in range(PARTS))
_SCHEMA = pa.schema([("shard", pa.int64()), ("unit", pa.int64()), *((f"p{i}", pa.binary()) for i in range(PARTS))])
# Units up to which each sends a row to every shard.
DIRECT = 4096
PACKED = "block_s bigint, block_u bigint, shard bigint, unit bigint, rows binary"
_PACKED = pa.schema([*((c, pa.int64()) for c in ("block_s", "block_u", "shard", "unit")), ("rows", pa.binary())])
# A document without id comes after all others.
NO_ID = np.iinfo(np.int64).max

Row = tuple  # (shard, unit, parts...)


def planes(values: np.ndarray, size: int | None = None) -> bytes:
    """Values byte by byte: first all low bytes, then all next ones. Compresses well where high bytes repeat."""
    return values.view(np.uint8).reshape(len(values), values.dtype.itemsize)[:, :size].T.tobytes()


def from_planes(data: bytes, kind: type, size: int | None = None) -> np.ndarray:
    width = np.dtype(kind).itemsize
    size = size or width
    raw = np.frombuffer(data, np.uint8).reshape(size, -1)
    out = np.zeros((raw.shape[1], width), np.uint8)
    out[:, :size] = raw.T
    return out.view(kind).ravel()


def runs(shards: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of runs of equal values in a sorted array."""
    if len(shards):
        at = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield int(shards[a]), a, b


class Unit:
    """The documents of a unit, in order of id: UTF-8 bytes one after the other, and where each begins."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")]))
        self.column = table.column("doc_id")
        self.ids = pc.fill_null(self.column, int(NO_ID)).to_numpy().astype(np.int64)
        self.number = table.column("unit")[0].as_py() if table.num_rows else -1
        self.data, self.offsets = text_buffers(table.column("text"))
        self.extra = table


def _rows(found: Iterable[Row]) -> pa.Table:
    columns = list(zip(*[(*row, *[None] * (2 + PARTS - len(row))) for row in found])) or [[]] * (2 + PARTS)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _by_shard(table: pa.Table) -> dict[int, tuple]:
    """Answers of a unit: shard -> parts."""
    columns = [table.column(f"p{i}").to_pylist() for i in range(PARTS)]
    return {s: parts for s, *parts in zip(table.column("shard").to_pylist(), *columns)}


def units(docs: DataFrame, bytes_each: int, *more: str) -> tuple[DataFrame, int]:
    """doc_id, text (and more columns) with the number of the unit; the number of shards to use.

    What a unit holds of a document may be any of its rows: ids decide, not which unit a row is in.
    """
    total = docs.agg(F.sum(F.octet_length(whole_text()))).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = max(2 * tasks, -(-total // bytes_each))
    dealt = docs.select(
        F.col("doc_id").cast("bigint"), whole_text().alias("text"), *more,
        F.pmod(F.xxhash64(F.col("doc_id").cast("bigint"), whole_text()), F.lit(count)).alias("unit"),
    )
    return dealt.repartition(tasks, "unit"), count


def _packed(found: Iterable[Row], block: int, to: str) -> pa.Table:
    """Rows by block of shards and units; ``to`` is the side that a packed row is for, the other side's block is one row."""
    groups: dict[tuple[int, int, int], list[Row]] = {}
    for row in found:
        shard, unit = row[0], row[1]
        alone = unit if to == "shard" else shard
        groups.setdefault((shard // block, unit // block, alone), []).append(row)
    keys = list(groups)
    sides = [[k[2] for k in keys] if side != to else [None] * len(keys) for side in ("shard", "unit")]
    columns = [[k[0] for k in keys], [k[1] for k in keys], *sides, [pickle.dumps(rows) for rows in groups.values()]]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _PACKED)], schema=_PACKED)


def _sorted_by(to: str) -> Callable[[pa.Table], pa.Table]:
    """A relay: packed rows of one pair of blocks, packed anew by what they are for."""

    def relay(table: pa.Table) -> pa.Table:
        groups: dict[int, list[Row]] = {}
        for data in table.column("rows").to_pylist():
            for row in pickle.loads(data):
                groups.setdefault(row[0] if to == "shard" else row[1], []).append(row)
        keys, n = sorted(groups), len(groups)
        blocks = [[table.column(c)[0].as_py()] * n for c in ("block_s", "block_u")]
        sides = [keys if side == to else [None] * n for side in ("shard", "unit")]
        columns = [*blocks, *sides, [pickle.dumps(groups[k]) for k in keys]]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _PACKED)], schema=_PACKED)

    return relay


def _unpacked(table: pa.Table) -> list[Row]:
    return [row for data in table.column("rows").to_pylist() for row in pickle.loads(data)]


def rounds(
    dealt: DataFrame,
    ask: Callable[[Unit], Iterable[Row]],
    answer: Callable[[int, list[Row]], Iterable[Row]],
    ask_again: Callable[[Unit, dict], tuple[Iterable[Row], list[bytes]]],
    answer_again: Callable[[int, list[Row]], Iterable[Row]],
    finish: Callable[[Unit, dict, list[bytes]], pa.Table],
    schema: str,
    empty: pa.Table,
    shards: int = 0,
) -> DataFrame:
    """Run both rounds. What ``ask_again`` returns beside its questions comes back to the same unit at the end."""
    if shards > DIRECT:
        return _relayed(dealt, ask, answer, ask_again, answer_again, finish, schema, empty, math.isqrt(shards - 1) + 1)

    def asked(table: pa.Table) -> pa.Table:
        return _rows(ask(Unit(table)))

    def listed(table: pa.Table) -> list[Row]:
        return list(zip(*(table.column(c).to_pylist() for c in _SCHEMA.names)))

    def answered(table: pa.Table) -> pa.Table:
        return _rows(answer(table.column("shard")[0].as_py(), listed(table)))

    def asked_again(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows([])
        unit = Unit(docs)
        rows, state = ask_again(unit, _by_shard(answers))
        return _rows([*rows, (-1 - unit.number, unit.number, *state)])

    def answered_again(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        return table if shard < 0 else _rows(answer_again(shard, listed(table)))

    def finished(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return empty
        unit, by_shard = Unit(docs), _by_shard(answers)
        return finish(unit, by_shard, by_shard.pop(-1 - unit.number))

    first = dealt.groupBy("unit").applyInArrow(asked, ROWS).groupBy("shard").applyInArrow(answered, ROWS)
    second = dealt.groupBy("unit").cogroup(first.groupBy("unit")).applyInArrow(asked_again, ROWS)
    second = second.groupBy("shard").applyInArrow(answered_again, ROWS)
    return dealt.groupBy("unit").cogroup(second.groupBy("unit")).applyInArrow(finished, schema)


def relays(sent: DataFrame, to: str) -> DataFrame:
    """Packed rows, one per member of a block, made one per member of the other side's block."""
    return sent.groupBy("block_s", "block_u").applyInArrow(_sorted_by(to), PACKED)


def _relayed(dealt, ask, answer, ask_again, answer_again, finish, schema, empty, block: int) -> DataFrame:
    """Both rounds by way of relays; questions and answers are those of ``rounds``."""

    def padded(rows: Iterable[Row]) -> list[Row]:
        return [(*row, *[None] * (2 + PARTS - len(row))) for row in rows]

    def asked(table: pa.Table) -> pa.Table:
        return _packed(ask(Unit(table)), block, "shard")

    def answering(reply: Callable[[int, list[Row]], Iterable[Row]]) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            rows = padded(_unpacked(table))
            return _packed(reply(rows[0][0], rows), block, "unit")

        return run

    def heard(answers: pa.Table) -> dict[int, tuple]:
        return {row[0]: row[2:] for row in padded(_unpacked(answers))}

    def asked_again(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _PACKED.empty_table()
        return _packed(ask_again(Unit(docs), heard(answers))[0], block, "shard")

    def remembered(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """The state that ``ask_again`` leaves, as a row for the unit itself."""
        if not docs.num_rows:
            return _PACKED.empty_table()
        unit = Unit(docs)
        state = pickle.dumps([(-1, unit.number, *ask_again(unit, heard(answers))[1])])
        return pa.table([pa.array([x], f.type) for x, f in zip((None, None, None, unit.number, state), _PACKED)], schema=_PACKED)

    def finished(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return empty
        by_shard = heard(answers)
        return finish(Unit(docs), by_shard, by_shard.pop(-1))

    def round_trip(sent: DataFrame, reply: Callable) -> DataFrame:
        replies = relays(sent, "shard").groupBy("shard").applyInArrow(answering(reply), PACKED)
        return relays(replies, "unit")

    first = kept(round_trip(dealt.groupBy("unit").applyInArrow(asked, PACKED), answer), "answers")
    pairs = dealt.groupBy("unit").cogroup(first.groupBy("unit"))
    second = round_trip(pairs.applyInArrow(asked_again, PACKED), answer_again).unionByName(pairs.applyInArrow(remembered, PACKED))
    return dealt.groupBy("unit").cogroup(second.groupBy("unit")).applyInArrow(finished, schema)


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Least of values[i : i + width] for every i (shorter at the end)."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        ahead = out[step:]
        out[: len(ahead)] = np.minimum(out[: len(ahead)], ahead)
        have += step
    return out


def anchors(values: np.ndarray, width: int, valid: np.ndarray) -> np.ndarray:
    """Whether each value is the least of some valid window values[i : i + width]; valid marks windows' starts.

    Equal windows have their anchors at equal places, whatever surrounds them.
    """
    least = np.where(valid, least_in_windows(values, width), np.uint64(0))
    # The greatest of these minima over the windows that hold a place; it is the value where it is an anchor.
    most = ~least_in_windows(~least[::-1], width)[::-1]
    return (most == values) & (most > 0)
