"""Small string helpers shared by the parsing and reporting columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode White_Space code points (fixed values).
WHITE_SPACE = (
    "\t\n\u000b\f\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

ASCII_WHITE_SPACE = "".join(c for c in WHITE_SPACE if c.isascii())

# SQL comments (fixed values). Block comments nest; three levels are followed.
LINE_COMMENT = r"--[^\n]*+"
COMMENT_DEPTH = 3


def _block_comment(depth: int) -> str:
    inner = f"|{_block_comment(depth - 1)}" if depth > 1 else ""
    return rf"/\*(?:[^*/]|\*(?!/)|/(?!\*){inner})*+\*/"


BLOCK_COMMENT = _block_comment(COMMENT_DEPTH)


def strip(text: Column, kinds: Column | None = None) -> Column:
    """Trim Unicode white space; SQL ``trim`` alone removes blanks only.  ``kinds``: see ``white_space_in``."""
    return F.btrim(text, F.lit(WHITE_SPACE) if kinds is None else kinds)


def white_space_in(text: Column) -> Column:
    """The kinds of white space that the text and its parts may have.

    Trimming compares both ends with each of them, and ASCII text can have few.
    """
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lit(ASCII_WHITE_SPACE)).otherwise(F.lit(WHITE_SPACE))


def groups_of(text: Column, pattern: str, *groups: int) -> Column:
    """Capture groups as an array after ONE regex pass.

    The match is rewritten to its groups joined by a newline, which a log line
    cannot contain, and cut there.  A text that does not match keeps a single
    element, so ``size(...) == len(groups)`` is the match test.
    """
    rewritten = F.regexp_replace(text, pattern, "\n".join(f"${g}" for g in groups))
    return F.split(rewritten, "\n", len(groups))


def quote_literal(text: Column) -> Column:
    """Body of a single-quoted SQL literal."""
    return F.replace(text, F.lit("'"), F.lit("''"))


def quote_like(text: Column) -> Column:
    """Body of a single-quoted LIKE pattern that matches ``text`` itself."""
    quoted = quote_literal(text)
    for special in ("\\", "%", "_"):
        quoted = F.replace(quoted, F.lit(special), F.lit("\\" + special))
    return quoted
