"""What the operators of this package share: tables, scratch tables, and joins with large groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.session import kept

# The contracts' white space and words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
# A group that holds at least one row in so many is heavy: there are at most so many of them.
HEAVY_SHARE = 1000

__all__ = [
    "HEAVY_SHARE", "SPACE", "WORD", "bucket_of", "documents", "join_groups", "kept", "text_buffers",
    "whole_text", "with_row_ids",
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bucket_of(key: str | Column, n: int) -> Column:
    """crc32 of a key's text, modulo ``n``: the split of the contracts."""
    return F.crc32((F.col(key) if isinstance(key, str) else key).cast("string")) % n


def whole_text(column: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def text_buffers(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, one after the other, and where each row begins and ends."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = array.buffers()
    at = np.frombuffer(at, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with one row per group, however unevenly the rows fall to groups.

    ``size`` names the number of rows of a group, ``total`` all rows. Groups with at least one row in
    HEAVY_SHARE are at most HEAVY_SHARE many, so they can be broadcast whatever the size of the input,
    and their rows stay where they are. Every other group is small enough for one task. Which way a row takes is
    a condition on the hash of its key, the same on both sides, so rows are read for it but not joined.
    """
    keys = list(keys)
    heavy = F.col(size) * HEAVY_SHARE >= F.lit(max(int(total), 1))
    place = F.xxhash64(*keys)
    places = [r[0] for r in groups.where(heavy).select(place).collect()]  # at most HEAVY_SHARE numbers
    if not places:
        return rows.join(groups, keys)
    few = place.isin(places)
    at_home = rows.where(few).join(F.broadcast(groups.where(few)), keys)
    moved = rows.where(~few).join(groups.where(~few), keys)
    return at_home.unionByName(moved.select(*at_home.columns))


def with_row_ids(docs: DataFrame, name: str = "_row_id") -> DataFrame:
    """Add a bigint that no other row has: doc_id, but for rows whose doc_id is null or not theirs alone.

    Those rows get numbers beyond all ids, so that they come last where the smallest id is preferred. The numbers
    are drawn once and written down with the rows; where every id is unique nothing is written.
    """
    ident = F.col("doc_id").cast("bigint")
    counts = docs.groupBy(ident.alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    shared = kept(counts.where("_id IS NULL OR _n > 1"), "shared-ids")
    if shared.isEmpty():
        return docs.withColumn(name, ident)
    total, high = docs.agg(F.count(F.lit(1)), F.max(ident)).first()
    beyond = max(high or 0, 0) + 1
    if beyond >= 1 << 62:
        raise ValueError("no room for row numbers beyond the ids")
    # Ids of at least one row in HEAVY_SHARE, and null, are few; their rows stay where they are.
    heavy = shared.where((F.col("_id").isNotNull()) & (F.col("_n") * HEAVY_SHARE >= total)).select("_id").collect()
    at_home = ident.isNull() | (ident.isin([r[0] for r in heavy]) if heavy else F.lit(False))
    at_home = F.coalesce(at_home, F.lit(True))
    known = shared.where("_id IS NOT NULL").select("_id", F.lit(True).alias("_shared"))
    moved = docs.where(~at_home).withColumn("_id", ident).join(known, "_id", "left").drop("_id")
    every = docs.where(at_home).withColumn("_shared", F.lit(True)).unionByName(moved)
    drawn = F.lit(beyond) + F.monotonically_increasing_id()
    return kept(every.withColumn(name, F.when(F.col("_shared"), drawn).otherwise(ident)).drop("_shared"), "numbered")
