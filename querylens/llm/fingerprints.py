"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text is cut into paragraphs (lines, cut again after sentence ends). Every paragraph is hashed to a wide
vector, and a document's fingerprint is the sum of the vectors of its paragraphs modulo powers of two. So
texts with the same paragraphs in any order have equal fingerprints, and a paragraph is inserted or deleted by
adding or subtracting its vector. The vector has two parts:

* 8 lanes modulo 2**32, halves of four 64-bit hashes: these decide equality;
* 128 counting lanes, one for each bit of two more hashes: how many paragraphs have that bit set. Counted as
  +1 and -1, they are random projections of the multiset, so the distance of two fingerprints estimates the
  share of paragraphs that two texts have in common (``likeness``; standard error about 0.12).

Everything is column expressions. Null texts are empty and have no paragraphs: fingerprint 0, like each other
with likeness 1 and like nothing else. Empty paragraphs do not count. Rows that share a doc_id count as one
document when the next document is looked for (the greatest text); a row without doc_id has no next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylens.llm.common import documents, kept, whole_text
from querylens.session import computed_once

PARAGRAPH_END = r"\n+|(?<=[.!?])[ \t]+"
HASH_LANES, COUNT_HASHES = 4, 2
_LOW = (1 << 32) - 1
# Stands for a missing id where ids are text.
NO_ID = ""
_TWO = (1 << 32) | 1


def paragraph_hashes(text: Column) -> Column:
    """For each non-empty paragraph of a text its hashes, one for each pair of lanes or word of counters.

    A hash's number comes first, as its seed, so that each one reads the paragraph anew.
    """
    parts = F.filter(F.split(text, PARAGRAPH_END), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(*[F.xxhash64(F.lit(i), p).alias(f"h{i}") for i in range(HASH_LANES + COUNT_HASHES)]),
    )


def summed(hashes: str) -> Column:
    """The vector of a column of paragraph hashes: struct of n, lanes (mod 2**32) and counters (two in a long)."""
    h = F.col(hashes)

    def total(part) -> Column:
        return F.aggregate(h, F.lit(0).cast("bigint"), lambda a, x: a + part(x))

    def counter(name: str, k: int) -> Column:
        return total(lambda x: F.shiftrightunsigned(x[name], k).bitwiseAND(F.lit(_TWO)))

    lanes, counters = [], []
    for i in range(HASH_LANES):
        lanes.append(total(lambda x: x[f"h{i}"].bitwiseAND(F.lit(_LOW))))
        lanes.append(total(lambda x: F.shiftrightunsigned(x[f"h{i}"], 32)))
    for i in range(HASH_LANES, HASH_LANES + COUNT_HASHES):
        counters += [counter(f"h{i}", k) for k in range(32)]
    return F.struct(
        F.size(h).cast("bigint").alias("n"),
        F.array(*[x.bitwiseAND(F.lit(_LOW)) for x in lanes]).alias("lanes"),
        F.array(*counters).alias("counters"),
    )


def with_vector(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the vector of a text column. Each step is computed once, however often the next refers to it."""
    hashed = computed_once(df, _hashes=paragraph_hashes(F.col(text)))
    return computed_once(hashed, **{name: summed("_hashes")}).drop("_hashes")


def combined(a: str, b: str, sign: int = 1) -> Column:
    """Vector of the union of two multisets of paragraphs, or (sign -1) of the first without the second."""
    def each(field: str, modulus: int | None) -> Column:
        def add(x: Column, y: Column) -> Column:
            z = x + F.lit(sign) * y
            return F.pmod(z, F.lit(modulus)) if modulus else z

        return F.zip_with(F.col(f"{a}.{field}"), F.col(f"{b}.{field}"), add)

    return F.struct(
        (F.col(f"{a}.n") + F.lit(sign) * F.col(f"{b}.n")).alias("n"),
        each("lanes", 1 << 32).alias("lanes"),
        each("counters", None).alias("counters"),
    )


def as_text(vector: str) -> Column:
    """Fingerprint as text: lanes and counters, all modulo 2**32, in hexadecimal: what ``likeness`` compares, whole."""
    lanes = F.transform(F.col(f"{vector}.lanes"), lambda x: F.lpad(F.hex(x), 8, "0"))
    counters = F.transform(F.col(f"{vector}.counters"), lambda x: F.lpad(F.hex(x), 16, "0"))
    return F.lower(F.concat(F.array_join(lanes, ""), F.array_join(counters, "")))


def _signed(counters: Column, n: Column) -> Column:
    """Counters as +1 and -1 sums, in twos."""
    return F.transform(
        counters,
        lambda x: F.struct(
            (2 * F.shiftrightunsigned(x, 32) - n).cast("double").alias("a"),
            (2 * x.bitwiseAND(F.lit(_LOW)) - n).cast("double").alias("b"),
        ),
    )


def likeness(a: str, b: str) -> Column:
    """Share of paragraphs in common, estimated from two fingerprints: 1 for equal ones, about 0 for disjoint ones."""
    left, right = _signed(F.col(f"{a}.counters"), F.col(f"{a}.n")), _signed(F.col(f"{b}.counters"), F.col(f"{b}.n"))

    def squares(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x["a"] * x["a"] + x["b"] * x["b"])

    apart = squares(
        F.zip_with(left, right, lambda x, y: F.struct((x["a"] - y["a"]).alias("a"), (x["b"] - y["b"]).alias("b")))
    )
    both = squares(left) + squares(right)
    same = F.col(f"{a}.lanes") == F.col(f"{b}.lanes")
    value = F.when(both > 0, F.greatest(F.lit(0.0), 1 - apart / F.nullif(both, F.lit(0.0)))).otherwise(0.0)
    return F.when(same, F.lit(1.0)).otherwise(F.least(F.lit(1.0), value))


def next_documents(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, previous_id, need) for each id: whose text its first ``need`` code points end; and if ids repeat.

    Ids are sorted by ranges, each range written with its number; the ranges' first ids (one row each) link them.
    """
    ids = kept(
        docs.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max(F.floor(F.length(whole_text()) / 2)).alias("half"), F.count(F.lit(1)).alias("rows")),
        "ids",
    )
    repeated = not ids.where("rows > 1").isEmpty()
    ranged = kept(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ranges")
    firsts = ranged.groupBy("part").agg(F.min("doc_id").alias("first_id"))
    following = F.lead("first_id").over(Window.orderBy("part"))
    overall = F.min("first_id").over(Window.partitionBy())
    firsts = firsts.select("part", F.coalesce(following, overall).alias("after_part"))
    after = F.coalesce(F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")), F.col("after_part"))
    linked = ranged.join(firsts, "part").select("doc_id", "half", after.alias("next_id"))
    return linked.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("previous_id"), F.col("half").alias("need")), repeated


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars and the vector of its text."""
    bare = docs.select(F.col("doc_id").cast("bigint"), whole_text().alias("_text"))
    return with_vector(bare, "_text", "vector").select("doc_id", F.length("_text").cast("bigint").alias("n_chars"), "vector")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts, of texts edited with the next document's beginning, and their likenesses."""
    # Both joins take texts by this key, which is never null and tells the id: with the same columns on both sides,
    # and dealt out before either join, the texts are shuffled once.
    key = F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit(NO_ID))
    bare = docs.select(key.alias("_key"), whole_text().alias("_text")).repartition("_key")
    links, repeated = next_documents(docs)
    links = kept(links, "links").select(F.col("doc_id").cast("string").alias("_key"), "previous_id", "need")
    source = bare.groupBy("_key").agg(F.max("_text").alias("_text")) if repeated else bare
    heads = with_vector(source.join(links, "_key"), "_text", "next_vector").select(
        F.col("previous_id").cast("string").alias("_key"),
        F.substring("_text", F.lit(1), F.col("need").cast("int")).alias("_head"),
        "next_vector",
    )
    half = F.floor(F.length("_text") / 2)
    kept_part = F.substring("_text", F.lit(1), (F.length("_text") - half).cast("int"))
    head = F.coalesce(F.substring("_head", F.lit(1), half.cast("int")), F.lit(""))
    joined = with_vector(bare.join(heads, "_key", "left"), "_text", "vector").select(
        F.nullif("_key", F.lit(NO_ID)).cast("bigint").alias("doc_id"),
        F.length("_text").cast("bigint").alias("n_chars"),
        "vector",
        "next_vector",
        F.concat(kept_part, head).alias("_edited"),
    )
    both = with_vector(joined, "_edited", "edited_vector")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        as_text("vector").alias("fingerprint"),
        as_text("edited_vector").alias("edited_fingerprint"),
        likeness("vector", "edited_vector").alias("near_edited"),
        F.when(F.col("next_vector").isNotNull(), likeness("vector", "next_vector")).otherwise(0.0).alias("near_next"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
