"""Spelling variants: words at edit distance one, found by PartEnum signatures of their letters.

A word's letters are a multiset, taken as a binary vector: the dimension (letter, k) is 1 if the word has the letter
at least k times. One inserted or deleted letter changes one dimension, a replaced one at most two, so near words
are at Hamming distance at most two. PartEnum: dimensions are dealt to ``PARTS`` parts by a hash, and of every
choice of ``PARTS - 2`` parts the word's vector on these parts is a signature. Two vectors that differ in at most
two dimensions differ in at most two parts, so they share the signature of all other parts: an equi-join of
signatures misses no pair. What it brings together is verified by edit distance.

One edit leaves either the first or the last half of a word as it is, so a signature's key also holds the shorter
word's length and one of the halves; a word takes part as the shorter (or equally long) one, and as the one that is
longer by one. This only parts words that can't be near. Keys are 64-bit hashes, and a collision only adds a pair
to verify. Pairs of the same key are joined by a sort-merge join, which spills, and whose large partitions Spark splits.

Words are counted by Spark where they are read, before anything is shuffled, so a frequent word is one row per
task. A word's form is its near word of largest count (the first of equals in code-point order) if that is at
least ``TIMES`` times its own, so chains of forms are at most as many steps as the largest count has digits; roots are
found by pointer doubling.

Null texts have no words. Every row counts, repeated ones too; a null id counts as the empty text. Columns other
than ``doc_id`` and ``text`` are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.llm.common import documents, kept, whole_text
from querylens.llm.words import mixed, spans_hashed

PARTS = 4
LEAST_LENGTH, LEAST_COUNT = 7, 2
TIMES = 10
# One occurrence in so many loses a letter, by the contract.
ONE_IN = 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What is A-Z in the contract's runs is in lower case by then.
_LETTERS = r"[a-zÀ-ÿ]"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def occurrences(docs: DataFrame) -> DataFrame:
    """word: one row per occurrence of at least LEAST_LENGTH letters, with the contract's letters deleted."""
    # A run shorter than the least word can't give one; longer runs are matched whole.
    runs = F.regexp_extract_all(F.translate(whole_text(), UPPER, LOWER), F.lit(f"{_LETTERS}{{{LEAST_LENGTH},}}"), F.lit(0))
    ident = F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit(""))
    each = docs.select(ident.alias("_id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat_ws(":", "_id", "run"))
    each = each.withColumn("_h", h).withColumn("_at", F.pmod("_h", F.length("run").cast("bigint")).cast("int"))
    without = F.concat(F.substring("run", 1, F.col("_at")), F.substring("run", F.col("_at") + 2, F.length("run")))
    word = F.when(F.col("_h") % ONE_IN == 0, without).otherwise(F.col("run"))
    return each.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH)


def counted_words(words: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: distinct words with at least ``least`` occurrences."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def letter_parts(points: np.ndarray, lengths: np.ndarray, parts: int) -> np.ndarray:
    """For each word and part, a sum of hashes of the word's dimensions in the part. ``points``: all words' letters."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((points, owner))
    owner, points = owner[order], points[order].astype(np.uint64)
    first = np.r_[True, (owner[1:] != owner[:-1]) | (points[1:] != points[:-1])]
    place = np.arange(len(points))
    k = place - np.maximum.accumulate(np.where(first, place, 0))  # how many of the same letter came before
    dimension = mixed(points * _ODD + k.astype(np.uint64) + np.uint64(1))
    sums = np.zeros((parts, len(lengths)), np.uint64)
    np.add.at(sums, ((mixed(dimension) % np.uint64(parts)).astype(np.int64), owner), dimension)
    return sums


def signature_keys(words: list[str], parts: int = PARTS) -> np.ndarray:
    """Keys by word (row): all signatures with either half, first as the shorter word, then as the longer by one."""
    lengths = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    hashed = mixed(points.astype(np.uint64) + np.uint64(1))
    halves = []
    for role in (0, 1):
        shorter = lengths - role
        middle = shorter // 2
        for side, (a, b) in enumerate(((starts, starts + middle), (ends - (shorter - middle), ends))):
            halves.append(mixed(spans_hashed(hashed, a, b) + shorter.astype(np.uint64) * _ODD + np.uint64(side)))
    sums = letter_parts(points, lengths, parts)
    signatures = [
        mixed(sums[list(chosen)].sum(0, dtype=np.uint64) * _ODD + np.uint64(i))
        for i, chosen in enumerate(combinations(range(parts), parts - 2))
    ]
    return np.stack([mixed(s ^ h) for h in halves for s in signatures], 1).view(np.int64)


def signed(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(key, word, n, shorter): one row per word and key."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = signature_keys(batch.column("word").to_pylist(), parts)
            many = keys.shape[1]
            rows = np.repeat(np.arange(batch.num_rows), many)
            shorter = np.tile(np.arange(many) < many // 2, batch.num_rows)
            columns = [pa.array(keys.ravel()), batch.column("word").take(pa.array(rows)), batch.column("n").take(pa.array(rows))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shorter)], ["key", "word", "n", "shorter"])

    return words.select("word", "n").mapInArrow(run, "key bigint, word string, n bigint, shorter boolean")


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(a, n_a, b, n_b): every pair of words at edit distance one, once, in either order."""
    keyed = signed(words, parts)
    left = keyed.where("shorter").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = keyed.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "shorter")
    met = left.join(right, "key").where(~F.col("shorter") | (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: where following forms ends. Steps double, until none moves."""
    links = kept(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = links.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        moved = kept(moved, "links")
        links = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return links


def spelling_groups(words: DataFrame, parts: int = PARTS, times: int = TIMES) -> DataFrame:
    """Per word of (word, n): word, form, root, n, n_near, form_n."""
    words = kept(words, "words")
    pairs = near_pairs(words, parts)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n_other"))
    )
    best: Column = F.min(F.struct((-F.col("n_other")).alias("n"), F.col("other").alias("word")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left").withColumn("form_n", -F.col("best.n"))
    has_form = F.col("form_n") >= F.col("n") * times
    found = kept(
        found.select(
            "word",
            F.when(has_form, F.col("best.word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(has_form, F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(counted_words(occurrences(documents(spark, sf_dir))))


# The contract's crc32 has no function in this dialect: bytes are folded over the table that the polynomial gives.
OP12_SQL = rf"""
WITH RECURSIVE steps(b, k, c) AS (
  SELECT range, 0, range::UBIGINT FROM range(256) UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
run AS (
  SELECT id, run, count(*) AS times FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS id,
      unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]{{{LEAST_LENGTH},}}')) AS run
    FROM documents) GROUP BY ALL),
digits AS (SELECT *, hex(encode(id || ':' || run)) AS x FROM run),
hashed AS (
  SELECT run, times, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i : i + 1])::UBIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b)::BIGINT + 1]))) AS h
  FROM digits, crc),
word AS (
  SELECT CASE WHEN h % {ONE_IN} = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
    ELSE run END AS word, sum(times)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= {LEAST_LENGTH} AND n >= {LEAST_COUNT}),
gap AS (SELECT word, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM word)),
pair AS (
  SELECT w.word AS word, g.word AS other FROM word w JOIN gap g ON w.word = g.rest UNION
  SELECT g.word, w.word FROM word w JOIN gap g ON w.word = g.rest UNION
  SELECT a.word, b.word FROM gap a JOIN gap b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word),
near AS (
  SELECT pair.word, count(*) AS n_near, arg_min(other, {{'n': -o.n, 'w': other}}) AS best, max(o.n) AS best_n
  FROM pair JOIN word o ON o.word = other GROUP BY pair.word),
found AS (
  SELECT w.word, CASE WHEN best_n >= {TIMES} * n THEN best END AS form, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN best_n >= {TIMES} * n THEN best_n END AS form_n
  FROM word w LEFT JOIN near ON w.word = near.word),
chain(word, root, step) AS (
  SELECT word, word, 0 FROM found UNION ALL
  SELECT c.word, f.form, step + 1 FROM chain c JOIN found f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, form, r.root, n, n_near, form_n
FROM found f JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) r ON r.word = f.word
"""
