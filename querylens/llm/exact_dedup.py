"""Exact dedup by composable polynomial fingerprints, confirmed chunk by chunk.

A text is normalised by deleting white space. Its bytes are hashed in chunks, each chunk on its own, as
polynomials modulo two primes, and chunk hashes combine by length: H(ab) = H(a) * B**len(b) + H(b). So a huge
document can be hashed in any division, and the result is the same. Texts with equal fingerprint and length
are then compared with the smallest document of their group in chunks that are rows of their own; a text that
differs after all (a collision) falls back on its SHA-256, so no group rests on the fingerprint alone.

Rows that share a doc_id are decided alike, each giving a row; a null doc_id sorts last; null texts are empty,
and all empty texts are one group. Only ``doc_id`` and ``text`` are read, other columns never clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.llm.common import SPACE, documents, join_groups, kept, text_buffers, whole_text

CHUNK = 1 << 16
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)
_DELETED = bytes([32, *range(9, 14)])


def _powers(base: int, prime: int) -> np.ndarray:
    out, x = np.empty(CHUNK, np.uint64), 1
    for i in range(CHUNK):
        out[CHUNK - 1 - i], x = x, x * base % prime
    return out


_POWERS = [_powers(b, p) for b, p in zip(BASES, PRIMES)]


def chunk_hash(chunk: bytes) -> tuple[int, ...]:
    """Hashes of at most CHUNK bytes. Terms are below 2**39, so their sum needs no reduction on the way."""
    digits = np.frombuffer(chunk, np.uint8).astype(np.uint64) + np.uint64(1)
    return tuple(int(np.dot(digits, w[CHUNK - len(digits) :])) % p for w, p in zip(_POWERS, PRIMES))


def combined(left: tuple[int, ...], right: tuple[int, ...], right_length: int) -> tuple[int, ...]:
    """Hashes of the concatenation of two byte strings."""
    return tuple((a * pow(b, right_length, p) + c) % p for a, c, b, p in zip(left, right, BASES, PRIMES))


def fingerprint(text: bytes) -> int:
    """Both hashes of a byte string, packed into 62 bits."""
    value: tuple[int, ...] = (0, 0)
    for at in range(0, len(text), CHUNK):
        chunk = text[at : at + CHUNK]
        value = combined(value, chunk_hash(chunk), len(chunk))
    return value[0] << 31 | value[1]


def _fingerprinted(batches):
    for batch in batches:
        texts, at = text_buffers(batch.column("text"))
        raw = texts.tobytes()
        rows = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            text = raw[a:b]
            bare = text.translate(None, _DELETED)
            rows.append((len(text.decode()), len(bare), fingerprint(bare), hashlib.sha256(bare).hexdigest()))
        columns = list(zip(*rows)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            ["doc_id", "n_code", "n_bare", "fp", "text_sha256"],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, code points, bytes without white space, their fingerprint and SHA-256."""
    return docs.select(F.col("doc_id").cast("bigint"), whole_text().alias("text")).mapInArrow(
        _fingerprinted, "doc_id bigint, n_code bigint, n_bare bigint, fp bigint, text_sha256 string"
    )


def exact_groups(docs: DataFrame, chunk_chars: int = CHUNK) -> DataFrame:
    """Per row: doc_id, keep_id (longest original text, then smallest doc_id), group_size, kept, text_sha256."""
    key = ["fp", "n_bare"]
    prints = kept(fingerprints(docs), "prints")
    total = prints.count()
    groups = kept(
        prints.groupBy(*key).agg(F.count(F.lit(1)).alias("n_alike"), F.min("doc_id").alias("first_id")).where("n_alike > 1"),
        "alike",
    )
    alone = prints.join(groups, key, "left_anti")
    alike = join_groups(prints, groups, key, "n_alike", total)

    # Every copy against the first of its group, chunk by chunk. Copies of a large group are dealt to sites,
    # and the first one's chunks to each site.
    site = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n_alike") / 1000))
    copies = alike.select("doc_id", "first_id", "n_alike").where("doc_id > first_id").distinct()
    firsts = groups.select(F.col("first_id").alias("doc_id"), "n_alike").where("doc_id is not null")
    wanted = copies.select("doc_id", "first_id", "n_alike").unionByName(
        firsts.select("doc_id", F.lit(None).cast("bigint").alias("first_id"), "n_alike")
    )
    bare = F.regexp_replace(whole_text(), SPACE, "")
    texts = docs.select(F.col("doc_id").cast("bigint"), "text")
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.length("bare"), F.lit(1)) - 1) / chunk_chars)),
        lambda i: F.struct(i.alias("chunk_no"), F.col("bare").substr(i.cast("int") * chunk_chars + 1, F.lit(chunk_chars)).alias("chunk")),
    )
    chunks = texts.join(wanted, "doc_id").withColumn("bare", bare).select("doc_id", "first_id", "n_alike", F.inline(pieces))
    theirs = chunks.where("first_id is null").select(
        F.col("doc_id").alias("first_id"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n_alike") / 1000) - 1)).alias("site"),
        "chunk_no",
        F.col("chunk").alias("first_chunk"),
    )
    compared = (
        chunks.where("first_id is not null")
        .select("doc_id", "first_id", site.alias("site"), "chunk_no", "chunk")
        .join(theirs, ["first_id", "site", "chunk_no"], "left")
    )
    differing = compared.where(~F.col("chunk").eqNullSafe(F.col("first_chunk"))).select("doc_id").distinct()
    # Fingerprints collide about once in 2**61 pairs, so the rows of this table are few.
    differing = kept(differing.withColumn("collided", F.lit(True)), "collided")

    settled = alike.join(differing, "doc_id", "left") if not differing.isEmpty() else alike.withColumn("collided", F.lit(None).cast("boolean"))
    settled = kept(settled.withColumn("other", F.when(F.col("collided"), F.col("text_sha256")).otherwise("")), "confirmed")
    best = F.min_by("doc_id", F.struct(-F.col("n_code"), F.col("doc_id").isNull(), F.col("doc_id")))
    members = settled.drop("n_alike", "first_id").groupBy(*key, "other").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    full = join_groups(settled.drop("n_alike", "first_id"), members, [*key, "other"], "group_size", total)
    result = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    is_kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return full.select("doc_id", "keep_id", "group_size", is_kept, "text_sha256").unionByName(
        alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    ).select(*result)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, arg_min(doc_id, {'a': -n, 'b': doc_id}) AS keep_id, count(*) AS group_size
  FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
