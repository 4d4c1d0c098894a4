"""Quality rules: a table of thresholds compiled into one projection of counts and ratios of a text.

Every count of a text is a column expression over the text itself, every rule of ``TABLE`` bounds a ratio of two
counts, and the verdict is one boolean column. No user function, no shuffle and no second pass: a row is judged
where it is read. Ratios are compared as integers (thousandths), so no rounding decides.

Words in repeated windows are counted without a join: the windows of three words of a text are sorted together
with their places, windows beside an equal one are repeated, and the places they cover are summed in order. That
takes time in proportion to n log n of the words and memory in proportion to the text, however often a window repeats.

Null counts as empty text. A text without words has all counts 0 and fails for its length, as does any under
``LEAST_WORDS``. Rows are judged one by one, so repeated rows and null ids are judged alike; an empty table gives
an empty result. Columns other than ``doc_id`` and ``text`` are not read. The stop words are those of the four
languages of ``STOP_WORDS``; for texts in others give a table without that rule or with words of your own.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.llm.common import WORD, documents, whole_text
from querylens.session import computed_once

WINDOW = 3
LEAST_WORDS = 50
# Words in repeated windows, at most so many of a hundred.
MOST_REPEATED = 50
# Name of the rule, count, count it is divided by, least and most in thousandths (None: no bound).
TABLE: tuple[tuple[str, str, str, int | None, int | None], ...] = (
    ("word_length", "word_chars", "n_words", 2000, 15000),
    ("symbols", "n_symbols", "n_words", None, 100),
    ("exclamations", "n_exclamations", "n_words", None, 300),
    ("letters", "n_letter_words", "n_words", 700, None),
    ("stop_words", "n_stop_words", "n_words", 50, None),
    ("repeated_lines", "n_dup_lines", "n_lines", None, 300),
    ("bullets", "n_bullet_lines", "n_lines", None, 900),
    ("open_ends", "n_open_lines", "n_lines", None, 300),
)
# The commonest function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for was on with be by as this are at from or an not have had has but which you "
    "der die und den von zu das mit sich auf des für ist nicht im dem ein eine als auch es an er hat aus bei "
    "de la le et les un du une que pour est qui par dans sur pas au avec ce il plus ne se sont "
    "el y los se del las por no con su para al lo como más pero sus en"
).split()
# What a bullet line begins with, and what ends a line that is cut short.
BULLETS = r"^[\x20\t]*(?:[-*•‣◦–]|[0-9]{1,3}[.)])[\x20\t]"
OPEN_END = r"(?:\.\.\.|…)[\x20\t\r]*$"
SYMBOLS = r"[#*$%&|<>]"
_SPACES = " \t\n\x0b\x0c\r"
_LETTER_WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]*\p{L}"


def repeated_words(words: Column, window: int = WINDOW) -> tuple[Column, Column, Column]:
    """Three steps, each over the column of the one before: windows, ``_starts``, words in repeated windows."""

    def at(i: Column) -> Column:
        parts = [F.get(words, i + k) for k in range(window)]
        return F.struct(F.concat_ws(" ", *parts).alias("w"), i.alias("i"))

    none = F.array().cast("array<struct<w:string,i:int>>")
    last = F.size(words) - window
    windows = F.when(last > 0, F.sort_array(F.transform(F.sequence(F.lit(0), last), at))).otherwise(none)

    def repeated(x: Column, j: Column) -> Column:
        before, after = (F.get(F.col("_windows"), j + k)["w"] for k in (-1, 1))
        return x["w"].eqNullSafe(before) | x["w"].eqNullSafe(after)

    starts = F.sort_array(F.transform(F.filter("_windows", repeated), lambda x: x["i"]))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "_starts",
        zero,
        lambda done, p: F.struct(
            (done["n"] + window - F.greatest(done["end"] - p, F.lit(0))).alias("n"), (p + window).alias("end")
        ),
        lambda done: done["n"],
    )
    return windows, starts, covered


def counts(stop_words: Collection[str] = tuple(STOP_WORDS)) -> dict[str, Column]:
    """Counts of a text ``_text`` with its words ``_words`` and its lines that have a word, ``_lines``."""
    text = F.col("_text")

    def is_stop(word: Column) -> Column:
        return F.lower(F.btrim(word, F.lit(".,;:!?\"'()"))).isin(list(stop_words))

    def lines_like(pattern: str) -> Column:
        return F.size(F.filter("_lines", lambda line: line.rlike(pattern)))

    return {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.translate(text, _SPACES, "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_lines": F.size("_lines"),
        "n_exclamations": F.regexp_count(text, F.lit("!")),
        "n_letter_words": F.regexp_count(text, F.lit(_LETTER_WORD)),
        "n_stop_words": F.size(F.filter("_words", is_stop)),
        "n_bullet_lines": lines_like(BULLETS),
        "n_open_lines": lines_like(OPEN_END),
    }


def failed_rules(table: Sequence[tuple] = TABLE) -> Column:
    """Names of the rules that the counts break, in the table's order."""
    broken = []
    for name, of, to, least, most in table:
        ratio, whole = F.col(of) * 1000, F.col(to)
        low = F.lit(False) if least is None else ratio < whole * least
        high = F.lit(False) if most is None else ratio > whole * most
        broken.append(F.when(low | high, F.lit(name)))
    return F.concat_ws(",", *broken)


def rule_verdicts(docs: DataFrame, table: Sequence[tuple] = TABLE, stop_words: Collection[str] = tuple(STOP_WORDS)) -> DataFrame:
    """Per row: doc_id, the counts, ``failed`` (names of broken rules), base_failed, kept."""
    bare = docs.select(F.col("doc_id").cast("bigint"), whole_text().alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD))
    split = computed_once(bare, _words=F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), _lines=lines)
    windows, starts, covered = repeated_words(F.col("_words"))
    found = computed_once(computed_once(split, _windows=windows), _starts=starts).drop("_windows")
    each = {name: count.cast("bigint") for name, count in counts(stop_words).items()}
    counted = computed_once(found, **each, n_repeat_words=covered).select("doc_id", *each, "n_repeat_words")
    base_failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    judged = counted.withColumn("failed", failed_rules(table)).withColumn("base_failed", base_failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("failed") == ""))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_verdicts(documents(spark, sf_dir))


def _sql() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    broken = []
    for name, of, to, least, most in TABLE:
        bounds = [f"{of} * 1000 < {to} * {least}"] * (least is not None) + [f"{of} * 1000 > {to} * {most}"] * (most is not None)
        broken.append(f"CASE WHEN {' OR '.join(bounds)} THEN '{name}' END")
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
w3 AS (
  SELECT r, i, word, CASE WHEN lead(i, 2) OVER p IS NOT NULL
    THEN word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p END AS three
  FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i, word, CASE WHEN three IS NOT NULL THEN count(*) OVER (PARTITION BY r, three) > 1 ELSE false END AS two FROM w3),
covered AS (
  SELECT r, word, two OR coalesce(lag(two, 1) OVER p, false) OR coalesce(lag(two, 2) OVER p, false) AS hit
  FROM again WINDOW p AS (PARTITION BY r ORDER BY i)),
by_word AS (
  SELECT r, count(*) FILTER (hit) AS n_repeat_words, sum(length(word))::BIGINT AS word_chars,
    count(*) FILTER (lower(trim(word, '.,;:!?"''()')) IN ({stops})) AS n_stop_words,
    count(*) FILTER (regexp_matches(word, '\p{{L}}')) AS n_letter_words FROM covered GROUP BY r),
c AS (
  SELECT doc_id, len(words) AS n_words, coalesce(word_chars, 0) AS word_chars,
    len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(lines) AS n_lines, len(regexp_extract_all(t, '!')) AS n_exclamations,
    coalesce(n_letter_words, 0) AS n_letter_words, coalesce(n_stop_words, 0) AS n_stop_words,
    len(list_filter(lines, lambda x: regexp_matches(x, '{BULLETS}'))) AS n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '{OPEN_END}'))) AS n_open_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN by_word USING (r)),
f AS (
  SELECT *, concat_ws(',', {', '.join(broken)}) AS failed,
    n_words < {LEAST_WORDS} OR n_repeat_words * 100 > n_words * {MOST_REPEATED} AS base_failed FROM c)
SELECT *, NOT base_failed AND failed = '' AS kept FROM f
"""


OP11_SQL = _sql()
