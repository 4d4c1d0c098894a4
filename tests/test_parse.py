from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from querylens.functions.text import ASCII_WHITE_SPACE, WHITE_SPACE, strip, white_space_in

P = "2023-11-05 04:07:09.250 UTC [707] miller@grain scale-2: "


def one(parse, line, log_format="auto"):
    rows = parse([line], log_format).collect()
    assert len(rows) == 1
    return rows[0]


def test_statement_line(parse):
    row = one(parse, P + "LOG:  statement: SELECT weight FROM sacks WHERE dry;")
    assert (row.process_id, row.user, row.database) == ("707", "miller", "grain")
    assert (row.application_name, row.client_host) == ("scale-2", None)
    assert (row.level, row.statement) == (
        "STATEMENT", "SELECT weight FROM sacks WHERE dry;")
    assert row.message == "statement: SELECT weight FROM sacks WHERE dry;"
    assert row.ts == datetime(2023, 11, 5, 4, 7, 9, 250000)
    assert row.duration_ms is None and row.source_kind == "Stderr"


@pytest.mark.parametrize(
    "message, level, statement, duration",
    [
        ("LOG:  duration: 8.064 ms", "DURATION", None, 8.064),
        ("LOG: duration: 8.064 ms", "DURATION", None, 8.064),
        ("LOG:  duration: 1.5 ms  parse <unnamed>: SELECT 1", "DURATION", None, 1.5),
        ("LOG:  duration: 1.5 ms  bind s1: SELECT 1", "DURATION", None, 1.5),
        ("LOG:  duration: 1.5 ms  statement: SELECT 1", "STATEMENT", "SELECT 1", 1.5),
        ("LOG:  duration: 1.5 ms  execute <unnamed>: SELECT 1", "STATEMENT", "SELECT 1", 1.5),
        ("LOG:  duration: 1.2.3 ms", "DURATION", None, None),
        ("LOG:  duration: 1.2.3 ms  statement: SELECT 1", "DURATION", None, None),
        ("LOG:  duration: unknown", "DURATION", None, None),
        ("LOG:  execute s1: SELECT 1", "STATEMENT", "SELECT 1", None),
        ("LOG:  executed", "LOG", None, None),
        ("ERROR:  statement: SELECT 1", "STATEMENT", "SELECT 1", None),
        ("STATEMENT:  SELECT 1", "STATEMENT", None, None),
        ("DURATION:  odd", "DURATION", None, None),
        ('ERROR:  relation "x" does not exist', "ERROR", None, None),
        ("warning:  careful", "WARNING", None, None),
        ("hint:  try", "HINT", None, None),
    ],
)
def test_message_forms(parse, message, level, statement, duration):
    row = one(parse, P + message)
    assert (row.level, row.statement, row.duration_ms) == (level, statement, duration)


def test_lines_that_are_not_entries(parse):
    lines = [
        "",
        "   ",
        "no digit comes first",
        "    FROM sacks s",
        "2023-11-05 04:07:09 UTC [1]: LOG:  background process",
        "2023-11-05 04:07:09 UTC [1] a@b : LOG:  no application",
        "2023-11-05",
    ]
    assert parse(lines).count() == 0


def test_multi_line_statement_keeps_its_first_line(parse):
    rows = parse(
        [P + "LOG:  statement: SELECT s.mill, s.weight", "    FROM sacks s", P + "LOG:  duration: 1 ms"]
    ).collect()
    assert [r.statement for r in rows] == ["SELECT s.mill, s.weight", None]


def test_surrounding_white_space_and_carriage_return(parse):
    row = one(parse, " \t " + P + "LOG:  statement: SELECT 1 \r")
    assert row.statement == "SELECT 1"


def test_timestamps(parse):
    text = "{} UTC [1] a@b c: LOG:  x"
    stamps = [
        ("2023-11-05 04:07:09", datetime(2023, 11, 5, 4, 7, 9)),
        ("2023-11-05 04:07:09.7654321", datetime(2023, 11, 5, 4, 7, 9, 765432)),
        ("2023-17-05 04:07:09", None),
        ("2023-02-29 04:07:09", None),
        ("2023-11-05 25:07:09", None),
    ]
    rows = parse([text.format(s) for s, _ in stamps]).collect()
    assert [r.ts for r in rows] == [t for _, t in stamps]


@pytest.mark.parametrize("zone", ["UTC", "CET", "Europe/Berlin", "+02", "GMT-3"])
def test_zone_is_read_and_ignored(parse, zone):
    assert one(parse, f"2023-11-05 04:07:09 {zone} [1] a@b c: LOG:  x").ts.hour == 4


def test_metadata_placeholders(parse):
    row = one(parse, "2023-11-05 04:07:09 UTC [1] [unknown]@- [unknown]: LOG:  x")
    assert (row.user, row.database, row.application_name) == (None, None, None)


@pytest.mark.parametrize(
    "host, expected",
    [
        ("192.0.2.44(6001)", "192.0.2.44"),
        ("mill.example(1)", "mill.example"),
        ("10.0.0.1", "10.0.0.1"),
        ("", None),
        ("[unknown]", None),
        ("-", None),
        ("(5432)", "(5432)"),
        ("a(b)(c)", "a(b)"),
        ("-(5432)", None),
    ],
)
def test_rds_host(parse, host, expected):
    line = f"2022-06-01 23:59:58 UTC:{host}:miller@grain:[42]:LOG:  statement: SELECT 1"
    row = one(parse, line, "rds")
    assert (row.client_host, row.application_name, row.source_kind) == (expected, None, "AwsRds")


def test_format_choice(parse):
    rds = "2022-06-01 23:59:58 UTC:h(1):miller@grain:[42]:LOG:  statement: SELECT 1"
    bare = "2022-06-01 23:59:58:h(1):miller@grain:[42]:LOG:  statement: SELECT 1"
    assert parse([rds, P + "LOG:  x"]).count() == 2
    assert parse([rds, P + "LOG:  x"], "default").count() == 1
    assert parse([rds, P + "LOG:  x", bare], "rds").count() == 2
    with pytest.raises(ValueError):
        parse([rds], "csv")


def test_quoted_text_survives(parse):
    sql = "SELECT \"odd \\ name\", 'é: [x] @ y' FROM t"
    assert one(parse, P + "LOG:  statement: " + sql).statement == sql


def test_parts_are_trimmed_by_the_kinds_of_white_space_a_text_may_have(spark):
    texts = ["a", " a\t", "\x0ba b\x0c", "\u00a0a\u3000", "\u2003 \u00e9 \u0085", "\u1680", " ", "", "\x1fa\x1f", "\u200ba "]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    found = rows.select("t", strip(F.col("t"), white_space_in(F.col("t"))).alias("some"), strip(F.col("t")).alias("all"), white_space_in(F.col("t")).alias("kinds"))
    for r in found.collect():
        assert r["some"] == r["all"] == (None if r.t is None else r.t.strip(WHITE_SPACE))
        assert r.kinds == (ASCII_WHITE_SPACE if r.t is not None and r.t.isascii() else WHITE_SPACE)
