"""SQL fingerprints as Catalyst expressions.

Two steps, because printing canonical SQL costs far more than blanking out its
literals:

* ``literal_shape`` replaces the literals of a statement by ``?`` in one regex
  pass.  It is cheap, runs inside generated code and is applied to every row.
* ``canonical_sql`` tokenizes a shape, prints keywords in upper case and
  re-spaces the tokens.  Callers aggregate by shape first, so it only ever runs
  once per distinct shape, not once per execution.

``regex_fingerprint`` is the separate four-replacement fingerprint.
Group repeats in the patterns are possessive, which keeps Java's matcher from
recursing on long statements.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querylens.functions.classify import statement_class
from querylens.functions.text import BLOCK_COMMENT, LINE_COMMENT, WHITE_SPACE, strip

# Words printed in upper case and followed by a blank before "(".
KEYWORDS = frozenset(
    """
    ALL ALTER ANALYZE AND ANY AS ASC BEGIN BETWEEN BY CASCADE CASE CHECK COLUMN
    COMMIT CONFLICT CONSTRAINT CREATE CROSS DATABASE DEFAULT DELETE DESC DISTINCT
    DO DROP ELSE END EXCEPT EXISTS EXPLAIN FETCH FIRST FOR FOREIGN FROM FULL GRANT
    GROUP HAVING IF ILIKE IN INDEX INNER INSERT INTERSECT INTERVAL INTO IS JOIN KEY
    LAST LATERAL LEFT LIKE LIMIT NATURAL NOT NOTHING NULL NULLS OFFSET ON OR ORDER
    OUTER OVER PARTITION PRIMARY RECURSIVE REFERENCES RETURNING REVOKE RIGHT
    ROLLBACK SCHEMA SELECT SET SIMILAR TABLE THEN TO TRUNCATE UNION UNIQUE UPDATE
    USING VALUES VIEW WHEN WHERE WINDOW WITH
    """.split()
)
# Printed in upper case with no blank before "(".
CALL_WORDS = frozenset("CAST CEIL EXTRACT FLOOR POSITION SUBSTRING TRIM ARRAY".split())
# Type words printed in upper case right after a cast.
CAST_TYPES = frozenset(
    """
    BIGINT BOOLEAN BYTEA CHAR DATE DECIMAL DOUBLE FLOAT INT INTEGER JSON JSONB
    NUMERIC REAL SMALLINT TEXT TIME TIMESTAMP TIMESTAMPTZ UUID VARCHAR
    """.split()
)
TYPED_LITERAL_WORDS = ("DATE", "TIME", "TIMESTAMP")
TRUTH_WORDS = ("TRUE", "FALSE")
PLAIN_STATEMENT_WORDS = ("SELECT", "WITH", "INSERT", "UPDATE", "DELETE")

# Lexical shapes.
STRING = r"'(?:[^']|'')*+'"
# Escape, national, bit and dollar strings are part of the text, not literals to blank out.
ESCAPE_STRING = r"[eE]'(?:[^'\\]|''|\\.)*+'"
PREFIXED_STRING = r"[nNbBxX]'(?:[^']|'')*+'"
DOLLAR_STRING = r"\$((?:[\p{L}_]\w*)?)\$.*?\$\{ref}\$"
QUOTED_NAME = r'"(?:[^"]|"")*+"'
NUMBER = r"(?:\d++\.?\d*+|\.\d++)(?:[eE][+-]?\d++)?"
NAME = r"[\p{L}_][\p{L}\p{N}_$]*+"


def _dollar(ref: int) -> str:
    return DOLLAR_STRING.replace("{ref}", str(ref))


# What may stand between two literals ...
NEUTRAL = "|".join(
    (
        # The usual stretch comes first: a name that is no prefix of a string, and what is neutral after it.
        rf"{NAME}(?!\s*+')[^'\"$\d.\p{{L}}_/-]*+",
        r"(?i:date|time|timestamp)\s*+'(?:[^']|'')*+'",
        ESCAPE_STRING,
        PREFIXED_STRING,
        _dollar(2),
        NAME,
        QUOTED_NAME,
        LINE_COMMENT,
        BLOCK_COMMENT,
        r"[^'\"$\d.\p{L}_/-]++",
        r"/(?!\*)",
        r"-(?!-)",
        r"\.(?!\d)",
        r"\$(?!\d|(?:[\p{L}_]\w*+)?\$)",
    )
)
# ... and a literal: one match swallows both, starting where the last one ended.
TO_NEXT_LITERAL = (
    rf"(?s)\G((?:{NEUTRAL})*+)(?:{STRING}|\$\d++|{NUMBER})"
)
TOKEN = (
    rf"(?s){LINE_COMMENT}|{BLOCK_COMMENT}|{ESCAPE_STRING}|{PREFIXED_STRING}|{STRING}|{_dollar(1)}"
    rf"|{QUOTED_NAME}"
    rf"|\$\d++|{NUMBER}|{NAME}"
    r"|::|<=|>=|<>|!=|\|\||->>|->|#>>|#>|@>|<@|&&|~\*|!~\*|!~|\S"
)
STATEMENT = (
    rf"(?s)(?:(?:(?!(?<![\p{{L}}\p{{N}}_$])[eE]')[^;'\"$/-])++|{ESCAPE_STRING}|{STRING}|{QUOTED_NAME}|{_dollar(1)}|\$"
    rf"|{LINE_COMMENT}|{BLOCK_COMMENT}|[/-])++"
)
LITERAL = r"^(?:[eEnNbBxX]?'|\$|\.?[0-9]|\?$)"
KEPT_STRING = r"^(?:[eEnNbBxX]'|\$(?!\d))"
WORD = r"^[\p{L}_]"
# Words that begin a statement, and words that cannot end one.
FIRST_WORDS = (
    "SELECT WITH VALUES TABLE INSERT UPDATE DELETE MERGE CREATE ALTER DROP TRUNCATE GRANT REVOKE BEGIN START COMMIT "
    "ROLLBACK END ABORT SAVEPOINT RELEASE EXPLAIN ANALYZE VACUUM SET SHOW RESET COPY LOCK DECLARE FETCH MOVE CLOSE "
    "PREPARE EXECUTE DEALLOCATE LISTEN NOTIFY UNLISTEN COMMENT CLUSTER REINDEX REFRESH CHECKPOINT CALL DO DISCARD "
    "SECURITY REASSIGN IMPORT LOAD"
).split()
OPEN_WORDS = (
    "WHERE AND OR NOT FROM JOIN ON BY SET INTO VALUES SELECT IN LIKE ILIKE BETWEEN HAVING UNION EXCEPT INTERSECT AS "
    "WHEN THEN ELSE CASE USING LIMIT OFFSET RETURNING UPDATE INSERT GROUP ORDER LEFT RIGHT INNER FULL CROSS WITH"
).split()
# Ends on such a word that are whole all the same.
WHOLE_ENDS = r"FOR\s+(?:NO\s+KEY\s+)?UPDATE|DEFAULT\s+VALUES|(?:VACUUM|IDENTITY)(?:\s+[A-Z]+)*?\s+FULL|(?:TO|=)\s*ON"


def _text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _words(words) -> str:
    return ", ".join(_text(w) for w in sorted(words))


def literal_shape(sql: Column) -> Column:
    """Statement text with every literal replaced by ``?``; layout is kept."""
    return F.regexp_replace(sql, TO_NEXT_LITERAL, "$1?")


# The token expressions below are SQL text: lambdas nest three deep here, and one
# parsed string costs far less to build than hundreds of Column calls.

# Token -> (raw, upper, kind); kind is keyword, call, truth, name, value or mark.
DESCRIBED = f"""
  transform(
    filter(
      regexp_extract_all(STATEMENT_TEXT, {_text(TOKEN)}, 0),
      t -> NOT (startswith(t, '--') OR startswith(t, '/*') OR t = ';')),
    t -> named_struct(
      'raw', t,
      'upper', upper(t),
      'kind', CASE
        WHEN rlike(t, {_text(WORD)}) AND NOT endswith(t, "'") THEN CASE
          WHEN upper(t) IN ({_words(KEYWORDS)}) THEN 'keyword'
          WHEN upper(t) IN ({_words(CALL_WORDS)}) THEN 'call'
          WHEN upper(t) IN ({_words(TRUTH_WORDS)}) THEN 'truth'
          ELSE 'name' END
        WHEN startswith(t, '"') THEN 'name'
        WHEN t <> '.' AND rlike(t, {_text(LITERAL)}) THEN 'value'
        ELSE 'mark' END))
"""

# A token among its neighbours: n.token, n.prev, n.prev2, n.typed, n.first.
_START = "named_struct('raw', '', 'upper', '', 'kind', 'start')"
NEIGHBOURS = f"""
  transform(tokens, (t, i) -> named_struct(
    'token', t,
    'prev', coalesce(get(tokens, i - 1), {_START}),
    'prev2', coalesce(get(tokens, i - 2), {_START}),
    'typed', startswith(coalesce(get(tokens, i + 1), {_START}).raw, "'"),
    'first', get(tokens, 0).upper))
"""

PRINTED_TEXT = f"""CASE
  WHEN n.token.kind = 'value' AND rlike(n.token.raw, {_text(KEPT_STRING)})
    THEN concat(upper(substr(n.token.raw, 1, 1)), substr(n.token.raw, 2))
  WHEN n.token.kind = 'value'
    AND NOT (n.prev.upper IN ({_words(TYPED_LITERAL_WORDS)}) AND startswith(n.token.raw, "'"))
    THEN '?'
  WHEN n.token.kind = 'truth'
    AND NOT (n.prev.upper = 'IS' OR (n.prev.upper = 'NOT' AND n.prev2.upper = 'IS')) THEN '?'
  WHEN n.token.upper = 'NULL' AND n.prev.upper NOT IN ('IS', 'NOT', 'SET') THEN '?'
  WHEN n.token.kind IN ('keyword', 'call', 'truth') THEN n.token.upper
  WHEN n.token.upper = 'NO' AND n.prev.upper = 'FOR' THEN 'NO'
  WHEN n.prev.upper = '::' AND n.token.upper IN ({_words(CAST_TYPES)}) THEN n.token.upper
  WHEN n.typed AND n.token.upper IN ({_words(TYPED_LITERAL_WORDS)}) THEN n.token.upper
  WHEN n.token.raw = '!=' THEN '<>'
  ELSE n.token.raw END"""

# No blank: at the start, around dots and casts, inside brackets, before commas,
# between a function and its "(", after a sign.
NO_BLANK = """(
  n.prev.kind = 'start'
  OR n.token.raw IN (',', ')', '.', '::', ']', '[')
  OR n.prev.raw IN ('(', '.', '::', '[')
  OR (n.token.raw = '('
      AND n.prev.kind NOT IN ('keyword', 'value', 'truth', 'mark')
      AND n.prev2.upper NOT IN ('INTO', 'TABLE', 'EXISTS', 'WITH'))
  OR (n.prev.raw IN ('-', '+') AND n.token.kind <> 'mark'
      AND (n.prev2.kind IN ('start', 'keyword')
           OR (n.prev2.kind = 'mark' AND n.prev2.raw NOT IN (')', ']')))))"""

# A name right after a name, a value or a closing bracket is an alias.
IS_ALIAS = f"""(
  n.token.kind = 'name'
  AND (n.prev.kind IN ('name', 'value') OR n.prev.upper IN (')', ']', 'END'))
  AND n.first IN ({_words((*PLAIN_STATEMENT_WORDS, '('))}))"""

CANONICAL = f"""
  array_join(transform(
    get(transform(
      array(filter({DESCRIBED}, t -> t.upper NOT IN ('INNER', 'OUTER'))),
      tokens -> {NEIGHBOURS}), 0),
    n -> concat(
      CASE WHEN {NO_BLANK} THEN '' WHEN {IS_ALIAS} THEN ' AS ' ELSE ' ' END,
      {PRINTED_TEXT})), '')
"""

# Non-blank statements of a text, cut at semicolons outside quotes.
PIECES = f"""
  filter(
    transform(
      regexp_extract_all(WHOLE_TEXT, {_text(STATEMENT)}, 0),
      s -> btrim(s, {_text(WHITE_SPACE)})),
    s -> s <> '')
"""


def canonical_sql(column: str) -> Column:
    """Canonical text of ONE statement held in ``column``.

    Rules: values, booleans and NULL values become ``?`` (IS NULL, NOT NULL and
    SET NULL stay, as do typed literals such as DATE '…'); comments and the
    closing semicolon go; INNER and OUTER before JOIN go; ``!=`` prints as
    ``<>``; an implicit alias gets its AS.
    """
    return F.expr(CANONICAL.replace("STATEMENT_TEXT", column))


def split_statements(column: str) -> Column:
    """Non-blank statements of the text in ``column``."""
    return F.expr(PIECES.replace("WHOLE_TEXT", column))


def parsed_queries(column: str) -> Column:
    """ARRAY<STRUCT<sql, query_type, normalized_query>> for a statement text."""
    canonical = CANONICAL.replace("STATEMENT_TEXT", "s")
    pieces = PIECES.replace("WHOLE_TEXT", column)
    return F.transform(
        F.expr(
            f"transform({pieces}, s -> named_struct('sql', s, 'normalized_query', {canonical}))"
        ),
        lambda q: F.struct(
            q["sql"].alias("sql"),
            statement_class(q["sql"]).alias("query_type"),
            q["normalized_query"].alias("normalized_query"),
        ),
    )


def family_sql(shape: str = "shape", parsed: str = "parsed") -> Column:
    """Family text: canonical statements joined by ``;``, or the raw text."""
    canonical = CANONICAL.replace("STATEMENT_TEXT", "s")
    pieces = PIECES.replace("WHOLE_TEXT", shape)
    return F.expr(
        f"CASE WHEN {parsed} THEN coalesce(nullif("
        f"array_join(transform({pieces}, s -> {canonical}), ';'), ''), {shape}) ELSE {shape} END"
    )


def plausible(shape: Column) -> Column:
    """Whether a shape could be SQL: a truncated first line is the usual one that could not.

    Closed quotes and brackets, a first word that begins statements, and no end
    on an operator, a comma or a word that wants more (but for the few forms that
    end on one).  This is no grammar: what
    passes may still be wrong SQL.
    """
    return plausible_bare(bare_text(shape))


def bare_text(shape: Column) -> Column:
    """A shape with ``q`` in place of its strings, quoted names and comments."""
    opaque = rf"(?s){ESCAPE_STRING}|{PREFIXED_STRING}|{_dollar(1)}|{STRING}|{QUOTED_NAME}|{LINE_COMMENT}|{BLOCK_COMMENT}"
    # Each of them begins or goes on with one of these marks; most shapes have none.
    return F.when(_has_any(shape, "'", '"', "$", "--", "/*"), F.regexp_replace(shape, opaque, " q ")).otherwise(shape)


def _has_any(text: Column, *marks: str) -> Column:
    found = text.contains(marks[0])
    for mark in marks[1:]:
        found = found | text.contains(mark)
    return found


def plausible_bare(bare: Column) -> Column:
    """``plausible`` of a shape whose ``bare_text`` is given: it is looked at five times, so rows compute it first."""
    without = lambda bracket: F.octet_length(F.replace(bare, F.lit(bracket)))
    balanced = (without("(") == without(")")) & ~_has_any(bare, "'", '"', "/*")
    begins = bare.rlike(rf"(?i)^[\s(;]*+(?:q\s++)*+[(\s]*+(?:{'|'.join(FIRST_WORDS)})\b")
    # Looking for the end tries every position; a value or a closing bracket there is no such end.
    closed = bare.endswith("?") | bare.endswith(")")
    ends = ~closed & bare.rlike(rf"(?i)(?:[,=<>+(|~!%^&@#]|(?<!\*)/|\b(?:{'|'.join(OPEN_WORDS)}))[\s;]*+$")
    whole = bare.rlike(rf"(?i)(?:\b|(?=[=]))(?:{WHOLE_ENDS})[\s;]*+$")
    return balanced & begins & (~ends | whole)


def regex_fingerprint(sql: Column) -> Column:
    """``$n`` to ?, numbers to N, quoted strings to S, white space squeezed."""
    text = F.regexp_replace(strip(sql), r"\$(\d+)", "?")
    text = F.regexp_replace(text, r"\b\d+(?:\.\d+)?\b", "N")
    text = F.regexp_replace(text, r"'[^']*'", "S")
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))
