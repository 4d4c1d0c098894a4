"""Column expressions that take one log line apart.

Every regex runs once per line (``groups_of``); the pieces travel as arrays
and the named columns are cheap element reads on top of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querylens.functions.text import groups_of, strip

# The two supported line prefixes and the message shapes.
# (?d) makes "." stop at "\n" only.
DEFAULT_PREFIX = (
    r"(?d)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?) ([A-Za-z0-9_+\-:/]+) "
    r"\[(\d+)\] ([^@]+)@([^ ]+) ([^:]+): (\w+):\s*(.+)$"
)
RDS_PREFIX = (
    r"(?d)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?)(?: ([^:]+))?:(.*):"
    r"([^@]+)@([^:]+):\[(\d+)\]:(\w+):\s*(.+)$"
)
DURATION_STATEMENT = (
    r"(?d)^duration:\s*([\d.]+)\s*ms\s+(?:statement|execute\s+[^:]+):\s*(.+)$"
)
DURATION = r"duration:\s*([\d.]+)\s*ms"
EXECUTE = r"(?d)^execute\s+[^:]+:\s*(.+)$"
ABSENT_METADATA = ("", "[unknown]", "-")

FORMATS = ("auto", "default", "rds")
PIECES = 7  # timestamp, process id, user, database, app or host, level, message


def default_pieces(line: Column) -> Column:
    return groups_of(line, DEFAULT_PREFIX, 1, 3, 4, 5, 6, 7, 8)


def rds_pieces(line: Column) -> Column:
    return groups_of(line, RDS_PREFIX, 1, 6, 4, 5, 3, 7, 8)


def matched(pieces: Column) -> Column:
    return F.size(pieces) == PIECES


def timestamp(text: Column) -> Column:
    """Wall-clock UTC; NULL marks a value that is no calendar date."""
    return text.try_cast("timestamp_ntz")


def metadata(text: Column) -> Column:
    return present(strip(text))


def present(trimmed: Column) -> Column:
    return F.when(~trimmed.isin(*ABSENT_METADATA), trimmed)


def rds_host(text: Column) -> Column:
    """Client host without the ``(port)`` suffix."""
    trimmed = strip(text)
    bare = F.regexp_replace(trimmed, r"(?d)^(.+)\([^(]*\)$", "$1")
    return F.when(~trimmed.isin(*ABSENT_METADATA), metadata(bare))


def timed_statement(message: Column) -> Column:
    """[duration, statement] of a statement logged together with its duration."""
    return F.when(message.startswith("duration:"), groups_of(message, DURATION_STATEMENT, 1, 2))


def executed_statement(message: Column) -> Column:
    return F.when(message.startswith("execute"), F.regexp_extract(message, EXECUTE, 1))


def message_parts(message: Column, timed: Column, executed: Column) -> Column:
    """Struct (form, statement, duration_text) of a message.

    form: 'statement' (with or without inline duration), 'duration' or 'other'.
    ``timed`` and ``executed`` are the two expressions above, already computed;
    only messages that begin with the right word pay for a regex.
    """
    none = F.lit(None).cast("string")

    def parts(form: str, statement: Column, duration: Column) -> Column:
        return F.struct(
            F.lit(form).alias("form"),
            statement.alias("statement"),
            duration.alias("duration_text"),
        )

    readable = F.get(timed, F.lit(0)).try_cast("double").isNotNull()
    return (
        F.when(
            (F.size(timed) == 2) & readable,
            parts("statement", F.get(timed, F.lit(1)), F.get(timed, F.lit(0))),
        )
        .when(
            message.startswith("statement: "),
            parts("statement", F.substring(message, 12, 2_147_483_647), none),
        )
        .when(executed != "", parts("statement", executed, none))
        .when(
            message.startswith("duration: "),
            parts("duration", none, F.regexp_extract(message, DURATION, 1)),
        )
        .otherwise(parts("other", none, none))
    )
