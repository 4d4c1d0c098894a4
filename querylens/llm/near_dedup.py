"""MinHash near-dedup by circulant permutations, with exact Jaccard confirmation and connected components.

A document's set is its distinct k-word shingles (ASCII letters lower-cased), as 64-bit hashes. All signature
coordinates come from two permutations: the first, s, scatters shingles over 2**32 places, and coordinate k is
the least p(s(x) + k mod 2**32) over the set, one second permutation p shifted circularly. Documents that agree
in all coordinates of one of the bands meet in a bucket; bands and their rows are chosen so that two documents at
the limit of similarity miss every bucket at most once in 1 / ``MISSED`` pairs (``bands_for``).

Links are confirmed on full sets, without comparing all pairs of a bucket:

* documents with equal sets are one node;
* in every bucket all members are compared with its hub, the member with most company in all buckets. Members
  are dealt to sites of bounded size and the hub's set is copied to each site;
* linked members share the hub's component. Jaccard distance is a metric, so a member at distance over twice
  the limit is linked with none of them. Members in between that are not yet in the component are its
  outliers: all outliers of a component are compared with all its members, in a grid of bounded tasks;
* members that are not linked with the hub may still be linked with each other. They make a bucket again, and one
  of at most ``SMALL`` members compares all its pairs in one task. Members of larger ones meet anew by their
  rarest shingles (``rare_buckets``): linked sets share one of so many that their sizes and the limit tell. These
  buckets take a hub once more, and what is large even then compares all its pairs in a grid of tasks. So the
  number of rounds is fixed. No link between different texts is lost, and no cap applies.

Components are then labelled by their smallest doc_id. Null and empty texts have the empty set and are linked
with nothing. Rows repeated with the same doc_id and text are alike. A row without doc_id takes no part:
component null, kept. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylens.llm.common import documents, join_groups, kept, text_buffers, whole_text
from querylens.llm.words import blocks, mixed, word_hashes

# Coordinates at most, and how rarely a pair at the limit may share no bucket.
COORDINATES, MISSED = 192, 3e-7
SMALL = 400
# Shingles sent to one site, and distinct shared shingles of a small bucket handled at a time.
SITE_SHINGLES = 150_000
COLUMNS = 1 << 14
# Outliers compared in one task of the grid.
OUTLIERS = 256
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingle_sets(array: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    data, offsets = text_buffers(array)
    out: list[np.ndarray] = []
    weights = np.array([mixed(_ODD[i % 5 : i % 5 + 1] + np.uint64(i))[0] | np.uint64(1) for i in range(k)])
    for low, high in blocks(offsets):
        h, _, _, counts = word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], lower=True)
        n = max(len(h) - k + 1, 0)
        joint = np.zeros(n, np.uint64)
        for i in range(k):
            joint += h[i : i + n] * weights[i]
        joint = mixed(joint)
        for a, b in zip(counts[:-1].tolist(), counts[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(joint[a : b - k + 1]))
            elif b > a:  # too short: the whole sequence is one shingle
                out.append(mixed((h[a:b] * weights[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band may have for a limit of percent / 100, and as many bands as that takes."""
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(MISSED) / math.log(1 - min(percent / 100, 0.999) ** rows))
        if bands * rows <= COORDINATES or rows == 1:
            return bands, rows
    raise AssertionError


def signature(shingles: np.ndarray, n: int = COORDINATES) -> np.ndarray:
    """n coordinates of a non-empty set."""
    places = (mixed(shingles ^ _ODD[0]) >> np.uint64(32)).astype(np.uint32)
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(places), 4096):
        part = places[at : at + 4096]
        step = max(1, min(n, (1 << 17) // len(part)))
        for k in range(0, n, step):
            x = part[None, :] + np.arange(k, min(k + step, n), dtype=np.uint32)[:, None]
            x ^= x >> np.uint32(16)
            x *= np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(13)
            x *= np.uint32(0xC2B2AE35)
            x ^= x >> np.uint32(16)
            np.minimum(least[k : k + step], x.min(1), out=least[k : k + step])
    return least


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    rows = least.reshape(bands, -1).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _ODD[1]
    for i in range(rows.shape[1]):
        key = mixed(key ^ (rows[:, i] + np.uint64(1)) * _ODD[2])
    return key.view(np.int64)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128-bit key of a set: sums of two hashes of its members."""
    a = mixed(shingles ^ _ODD[3]).sum(dtype=np.uint64)
    b = mixed(shingles ^ _ODD[4]).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def signatures(docs: DataFrame, k: int, n_bands: int, n_rows: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text"), k)
            keys = [set_key(s) for s in sets]
            bands = [band_keys(signature(s, n_bands * n_rows), n_bands) if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([a for a, _ in keys], pa.int64()),
                    pa.array([b for _, b in keys], pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), whole_text().alias("text")).mapInArrow(
        run, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>"
    )


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(id, size, shingles) of the wanted ids, as packed sorted hashes."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text"), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["id", "size", "shingles"],
            )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), whole_text().alias("text"))
    return texts.join(wanted, "id").mapInArrow(run, "id bigint, size bigint, shingles binary").dropDuplicates(["id"])


def verified(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(hub, id, linked, far) for pairs of a hub and another node; far: beyond twice the limit of distance."""
    sizes = sets.select("id", "size")
    sized = kept(edges.join(sizes, "id"), "sized")
    hubs = kept(
        sized.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("size") / SITE_SHINGLES).alias("sites")), "hubs"
    )
    total = hubs.agg(F.sum("n")).first()[0] or 0
    dealt = join_groups(sized, hubs, ["hub"], "n", total)
    site = F.pmod(F.xxhash64("id"), F.col("sites"))
    members = dealt.select("hub", "id", site.alias("site")).join(sets.select("id", "shingles"), "id")
    copies = hubs.select("hub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("sites") - 1)).alias("site"))
    copies = copies.join(sets.select(F.col("id").alias("hub"), F.col("shingles").alias("hub_shingles")), "hub")
    far_percent = 2 * percent - 100

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if right.num_rows and left.num_rows:
            hub = np.frombuffer(right.column("hub_shingles")[0].as_py(), np.uint64)
            hub_id = right.column("hub")[0].as_py()
            for ident, raw in zip(left.column("id").to_pylist(), left.column("shingles").to_pylist()):
                other = np.frombuffer(raw, np.uint64)
                at = np.searchsorted(hub, other)
                at[at == len(hub)] = 0
                same = int((hub[at] == other).sum())
                union = len(hub) + len(other) - same
                rows.append((hub_id, ident, 100 * same >= percent * union, 100 * same < far_percent * union))
        columns = list(zip(*rows)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["hub", "id", "linked", "far"])

    return members.groupBy("hub", "site").cogroup(copies.groupBy("hub", "site")).applyInArrow(
        run, "hub bigint, id bigint, linked boolean, far boolean"
    )


def all_pairs(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (hub, id) inside buckets of at most SMALL members, all pairs of a bucket in one task.

    The members' intersections are products of a 0/1 matrix of the shingles that several members share.
    """

    def run(table: pa.Table) -> pa.Table:
        ids = np.array(table.column("id").to_pylist(), np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        place = np.cumsum(shared) - 1
        keep = shared[column]
        owner, column = owner[keep], place[column[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        same = np.zeros((len(sets), len(sets)), np.float64)
        for low in range(0, int(shared.sum()), COLUMNS):
            a, b = np.searchsorted(column, [low, low + COLUMNS])
            m = np.zeros((len(sets), COLUMNS), np.float32)
            m[owner[a:b], column[a:b] - low] = 1
            same += m @ m.T
        union = sizes[:, None] + sizes[None, :] - same
        i, j = np.nonzero(np.triu(100 * same >= percent * union, 1))
        root = list(range(len(sets)))
        tree = []
        for a, b in zip(i.tolist(), j.tolist()):  # links that join members not yet joined are enough
            x, y = a, b
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            if x != y:
                root[y] = x
                tree.append((a, b))
        i, j = np.array(tree, np.int64).reshape(-1, 2).T
        return pa.table({"hub": pa.array(ids[i], pa.int64()), "id": pa.array(ids[j], pa.int64())})

    return buckets.join(sets.select("id", "shingles"), "id").select("key", "id", "shingles").groupBy("key").applyInArrow(
        run, "hub bigint, id bigint"
    )


def rare_buckets(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, id): members by each of their rarest shingles, so that any two linked members have a key in common.

    Linked sets have at least percent / 100 of either's shingles in common, so when all sets are in one order, less
    than the rest of each set comes before its first common shingle.
    """

    def run(batches):
        for batch in batches:
            found = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
            for ident, size, mine in zip(batch.column("id").to_pylist(), batch.column("size").to_pylist(), found):
                n = len(mine)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, ident)), pa.array(np.full(n, size)), pa.array(mine)], ["id", "size", "token"]
                )

    mine = sets.join(members, "id", "left_semi").select("id", "size", "shingles")
    tokens = kept(mine.mapInArrow(run, "id bigint, size bigint, token bigint"), "tokens")
    counted = kept(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n_with")), "counted")
    ranked = join_groups(tokens, counted, ["token"], "n_with", tokens.count())
    place = F.row_number().over(Window.partitionBy("id").orderBy("n_with", "token"))
    least = F.floor((F.col("size") * percent + 99) / 100)
    rare = ranked.withColumn("place", place).where((F.col("place") <= F.col("size") - least + 1) & (F.col("n_with") > 1))
    return rare.select(F.xxhash64("token", F.lit("rare")).alias("key"), "id")


def in_grid(buckets: DataFrame) -> DataFrame:
    """(key, id) of buckets of about SMALL members in which all pairs of each larger bucket meet."""
    parts = F.ceil(2 * F.col("n_in") / SMALL)
    dealt = buckets.select("key", "id", parts.alias("parts"), F.pmod(F.xxhash64("id"), parts).alias("part"))
    dealt = dealt.select("key", "id", "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other"))
    cell = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    return dealt.where("part != other").select(cell.alias("key"), "id")


def outlying_links(outliers: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (hub, id) of each component's outliers with its members; both are (component, id), distinct.

    Members are dealt to sites by their total size, outliers to groups by number, and every site meets every group.
    One link of an outlier at a site is enough.
    """
    sized = kept(members.join(sets.select("id", "size"), "id"), "sized")
    sites = sized.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("size") / SITE_SHINGLES).alias("sites"))
    groups = outliers.groupBy("component").agg(F.count(F.lit(1)).alias("n_out"), F.ceil(F.count(F.lit(1)) / OUTLIERS).alias("groups"))
    grid = kept(sites.join(groups, "component"), "grid")
    n_members, n_outliers = grid.agg(F.sum("n"), F.sum("n_out")).first()
    none = F.lit(0).cast("bigint")

    def dealt(rows: DataFrame, size: str, total: int, mine: str, other: str) -> DataFrame:
        to = F.pmod(F.xxhash64("id"), F.col(mine)).alias(mine)
        placed = join_groups(rows.select("component", "id"), grid, ["component"], size, total or 0)
        copies = placed.select("component", "id", to, F.explode(F.sequence(none, F.col(other) - 1)).alias(other))
        return copies.join(sets.select("id", "shingles"), "id").select("component", "sites", "groups", "id", "shingles")

    left = dealt(sized, "n", n_members, "sites", "groups")
    right = dealt(outliers, "n_out", n_outliers, "groups", "sites").toDF("component", "sites", "groups", "out_id", "out_shingles")

    def run(near: pa.Table, out: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        if near.num_rows and out.num_rows:
            near_ids, out_ids = near.column("id").to_pylist(), out.column("out_id").to_pylist()
            near_sets = [np.frombuffer(x, np.uint64) for x in near.column("shingles").to_pylist()]
            sizes = np.array([len(x) for x in near_sets])
            flat = np.concatenate(near_sets)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            out_sets = [np.frombuffer(x, np.uint64) for x in out.column("out_shingles").to_pylist()]
            known = np.unique(np.concatenate(out_sets))
            place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            place[known[place] != flat] = len(known)  # a place that no outlier has
            for ident, mine in zip(out_ids, out_sets):
                has = np.zeros(len(known) + 1, bool)
                has[np.searchsorted(known, mine)] = True
                same = np.add.reduceat(has[place], starts, dtype=np.int64)
                linked = np.flatnonzero(100 * same >= percent * (sizes + len(mine) - same))
                if len(linked):
                    links.append((ident, near_ids[linked[0]]))
        columns = list(zip(*links)) or [[], []]
        return pa.table({"hub": pa.array(columns[0], pa.int64()), "id": pa.array(columns[1], pa.int64())})

    by = ["component", "sites", "groups"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, "hub bigint, id bigint")


def connected(links: DataFrame) -> DataFrame:
    """(id, label) of all nodes with links: the smallest id that each can reach, by label spreading and jumping."""
    both = links.select("hub", "id").union(links.select(F.col("id").alias("hub"), F.col("hub").alias("id"))).where("hub != id").distinct()
    both = kept(both.select(F.col("hub").alias("at"), F.col("id").alias("near")), "links")
    degrees = both.groupBy("at").agg(F.count(F.lit(1)).alias("degree"), F.min("near").alias("least"))
    labels = kept(degrees.select(F.col("at").alias("id"), "degree", F.least("at", "least").alias("label")), "labels")
    total = labels.agg(F.sum("degree")).first()[0] or 0
    while True:
        # Neighbours hear a node's label; every node then takes the label of its label.
        told = join_groups(both, labels.select(F.col("id").alias("at"), "degree", "label"), ["at"], "degree", total)
        heard = told.groupBy(F.col("near").alias("id")).agg(F.min("label").alias("heard"))
        spread = labels.join(heard, "id").select("id", "degree", "label", F.least("label", "heard").alias("now"))
        spread = kept(spread, "spread")
        group = spread.groupBy("now").agg(F.count(F.lit(1)).alias("n_now"))
        ahead = group.join(spread.select(F.col("id").alias("now"), F.col("now").alias("ahead")), "now")
        jumped = join_groups(spread, ahead, ["now"], "n_now", total).select(
            "id", "degree", F.least("now", "ahead").alias("label"), (F.least("now", "ahead") != F.col("label")).alias("moved")
        )
        jumped = kept(jumped, "labels")
        labels = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return labels.select("id", "label")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.drop("label").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _open(rows: DataFrame) -> DataFrame:
    """Rows of buckets whose members are not yet in one component, each set of members once."""
    state = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_in"), F.min("label").alias("low"), F.max("label").alias("high"), F.bit_xor(F.xxhash64("id")).alias("mark")
    )
    state = state.where("low != high").groupBy("n_in", "mark").agg(F.min("key").alias("key"))
    state = kept(state.select("key", "n_in"), "open")
    total = state.agg(F.sum("n_in")).first()[0] or 0
    return kept(join_groups(rows.drop("n_in"), state, ["key"], "n_in", total), "open_rows")


def linked_nodes(docs: DataFrame, rows: DataFrame, n_rows: int, k: int, percent: int) -> DataFrame | None:
    """(id, label) of nodes in components of several nodes; rows: (key, id), one for each node and band."""
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_in")).where("n_in > 1")
    met = kept(join_groups(rows, kept(buckets, "buckets"), ["key"], "n_in", n_rows), "met")
    company = met.groupBy("id").agg(F.sum("n_in").alias("company"))
    active = kept(met.join(company, "id").withColumn("label", F.col("id")), "active")
    active = _open(active)
    if active.isEmpty():
        return None
    sets = kept(full_sets(docs, company.select("id"), k), "sets")
    found: list[DataFrame] = []

    def joined() -> DataFrame:
        links = found[0]
        for more in found[1:]:
            links = links.union(more)
        return connected(links)

    for last in (False, True):
        hubs = kept(
            active.groupBy("key").agg(F.max_by("id", F.struct("company", -F.col("id"))).alias("hub"), F.count(F.lit(1)).alias("n_in")),
            "hub_of",
        )
        total = hubs.agg(F.sum("n_in")).first()[0]
        starred = kept(join_groups(active.drop("n_in"), hubs, ["key"], "n_in", total).where("id != hub"), "starred")
        told = kept(verified(starred.select("hub", "id").distinct(), sets, percent), "verified")
        found.append(told.where("linked").select("hub", "id"))
        labels = joined()
        judged = kept(_labelled(starred.join(told, ["hub", "id"]), labels), "judged")

        # Between the limit and twice the limit of distance from a hub: outliers, unless in its component already.
        homes = hubs.join(labels.select(F.col("id").alias("hub"), F.col("label").alias("component")), "hub", "left")
        homes = homes.select("key", "n_in", F.coalesce("component", "hub").alias("component"))
        near = join_groups(judged.where("NOT far").select("key", "id", "label"), homes, ["key"], "n_in", total)
        outside = F.col("label") != F.col("component")
        outliers = kept(near.where(outside).select("component", "id").distinct(), "outliers")
        if not outliers.isEmpty():
            with_outliers = outliers.select("component").distinct()
            members = near.where(~outside).select("component", "id").distinct().join(with_outliers, "component", "left_semi")
            found.append(kept(outlying_links(outliers, members, sets, percent), "outlying"))
            labels = joined()

        rest = judged.where("NOT linked").select(F.xxhash64("key", F.lit("apart")).alias("key"), "id", "company", "label")
        active = _open(_labelled(rest, labels))
        small = active.where(F.col("n_in") <= SMALL)
        if not small.isEmpty():
            found.append(kept(all_pairs(small, sets, percent).distinct(), "pairs"))
            labels = joined()
            active = _open(_labelled(active.where(F.col("n_in") > SMALL), labels))
        large = kept(active.where(F.col("n_in") > SMALL), "large")
        if large.isEmpty():
            return labels
        if last:
            found.append(kept(all_pairs(in_grid(large), sets, percent).distinct(), "grid_pairs"))
            return joined()
        members = kept(large.select("id", "company", "label").distinct(), "members")
        active = _open(rare_buckets(members.select("id"), sets, percent).join(members, "id"))
        if active.isEmpty():
            return labels


def near_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept. Links: Jaccard similarity of at least percent / 100."""
    key = ["n_shingles", "set_a", "set_b"]
    n_bands, n_rows = bands_for(percent)
    prints = kept(signatures(docs, k, n_bands, n_rows), "signatures")
    named = prints.where("doc_id is not null")
    nodes = kept(
        named.groupBy(*key).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n_same"), F.first("bands").alias("bands")), "nodes"
    )
    sized = nodes.where("n_shingles > 0")
    n_nodes = sized.count()
    labels = linked_nodes(docs, sized.select(F.explode("bands").alias("key"), "id"), n_nodes * n_bands, k, percent)
    if labels is None:
        labels = nodes.limit(0).select("id", F.col("id").alias("label"))
    full = nodes.drop("bands").join(labels, "id", "left").withColumn("component_id", F.coalesce("label", "id"))
    total = prints.count()
    alone = F.col("n_shingles") == 0
    result = join_groups(named.drop("bands"), full.select(*key, "n_same", "component_id"), key, "n_same", total).select(
        "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    nameless = prints.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("bigint").alias("component_id"))
    return result.unionByName(nameless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir), k=3, percent=85)
