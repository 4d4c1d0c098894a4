"""Statement classes: one by grammar form, two by leading word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querylens.functions.text import BLOCK_COMMENT, LINE_COMMENT, strip

# Leading words per class.
QUERY_WORDS = ("SELECT", "WITH", "VALUES", "TABLE")
WRITE_WORDS = ("INSERT", "UPDATE", "DELETE")
SCHEMA_CHANGE = (
    r"^(?:CREATE\s+(?:(?:OR\s+REPLACE|TEMP|TEMPORARY|GLOBAL|LOCAL|UNLOGGED|UNIQUE"
    r"|MATERIALIZED|RECURSIVE|EXTERNAL)\s+)*(?:TABLE|VIEW|INDEX|SCHEMA|DATABASE)"
    r"|DROP\s+(?:TABLE|VIEW|MATERIALIZED\s+VIEW|INDEX|SCHEMA|ROLE|SEQUENCE|TYPE)"
    r"|ALTER\s+TABLE|TRUNCATE)\b"
)
PREFIX_DDL = ("CREATE", "DROP", "ALTER", "TRUNCATE", "GRANT", "REVOKE")
TRANSACTION_WORDS = ("BEGIN", "COMMIT", "ROLLBACK")


def _any_prefix(text: Column, words: tuple[str, ...]) -> Column:
    test = text.startswith(words[0])
    for word in words[1:]:
        test = test | text.startswith(word)
    return test


def statement_class(sql: Column) -> Column:
    """Class by statement form, behind comments: WITH and VALUES are queries, GRANT is not DDL."""
    head = F.upper(F.regexp_replace(sql, rf"^(?:[\s(]|{LINE_COMMENT}|{BLOCK_COMMENT})++", ""))
    word = F.regexp_extract(head, r"^[A-Z]+", 0)
    by_word = F.when(word.isin(*QUERY_WORDS), "SELECT")
    for write in WRITE_WORDS:
        by_word = by_word.when(word == write, write)
    return by_word.when(
        word.isin("CREATE", "DROP", "ALTER", "TRUNCATE") & head.rlike(SCHEMA_CHANGE), "DDL"
    ).otherwise("OTHER")


def prefix_class(sql: Column) -> Column:
    """Class by leading letters only: GRANT and REVOKE are DDL, WITH is other."""
    text = F.upper(strip(sql))
    by_word = F.when(text.startswith("SELECT"), "SELECT")
    for write in WRITE_WORDS:
        by_word = by_word.when(text.startswith(write), write)
    return by_word.when(_any_prefix(text, PREFIX_DDL), "DDL").otherwise("OTHER")


def nine_way_class(sql: Column) -> Column:
    # No class word is longer than its first letters, so the rest of the text is left alone.
    text = F.upper(F.substring(strip(sql), 1, max(map(len, TRANSACTION_WORDS))))
    by_word = F.when(text.startswith("SELECT"), "SELECT")
    for word in (*WRITE_WORDS, "CREATE", "DROP", "ALTER"):
        by_word = by_word.when(text.startswith(word), word)
    return by_word.when(_any_prefix(text, TRANSACTION_WORDS), "TRANSACTION").otherwise("OTHER")
