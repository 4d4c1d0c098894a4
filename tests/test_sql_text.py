from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from querylens.functions import fingerprint as fp
from querylens.functions.classify import nine_way_class, prefix_class, statement_class
from querylens.functions.text import quote_like, quote_literal

CANONICAL = [
    ("SELECT title FROM books WHERE isbn = 9", "SELECT title FROM books WHERE isbn = ?"),
    ("SELECT f FROM g WHERE h = 'Oslo' AND NOT i", "SELECT f FROM g WHERE h = ? AND NOT i"),
    ("UPDATE carts SET total = $1 WHERE owner = $2", "UPDATE carts SET total = ? WHERE owner = ?"),
    ("SELECT  a ,b   FROM  t   WHERE  c>=2.75", "SELECT a, b FROM t WHERE c >= ?"),
    ("DELETE FROM q WHERE (x < 4 OR y = 'z') AND k IN (5, $6, 'seven')",
     "DELETE FROM q WHERE (x < ? OR y = ?) AND k IN (?, ?, ?)"),
    ("INSERT INTO shelves (room, full_) VALUES ('west', false), ('east', NULL)",
     "INSERT INTO shelves (room, full_) VALUES (?, ?), (?, ?)"),
    ("SELECT n FROM notes WHERE read_at IS NULL OR seen = TRUE",
     "SELECT n FROM notes WHERE read_at IS NULL OR seen = ?"),
    ("SELECT max(d) FROM visits WHERE d BETWEEN '2025-01-01' AND NOW();",
     "SELECT max(d) FROM visits WHERE d BETWEEN ? AND NOW()"),
    # Shapes with rules of their own.
    ("select u.name from users u join posts p on u.id=p.user_id where u.x is not null and p.y=null",
     "SELECT u.name FROM users AS u JOIN posts AS p ON u.id = p.user_id"
     " WHERE u.x IS NOT NULL AND p.y = ?"),
    ("SELECT a::int, -1, a - 1, b->>'k' FROM \"My, Table\" WHERE d >= DATE '2024-01-01' -- c",
     "SELECT a::INT, -?, a - ?, b ->> ? FROM \"My, Table\" WHERE d >= DATE '2024-01-01'"),
    ("SELECT * FROM (SELECT 1 one) s INNER JOIN t ON s.one != t.two LEFT OUTER JOIN v USING (id)",
     "SELECT * FROM (SELECT ? AS one) AS s JOIN t ON s.one <> t.two LEFT JOIN v USING (id)"),
    ("SELECT 'it''s; ok' AS a; DELETE FROM t WHERE x = 'a;b'",
     "SELECT ? AS a;DELETE FROM t WHERE x = ?"),
    ("SELECT /* 'x' */ a[1], ARRAY[1,2] FROM t1 LIMIT 5", "SELECT a[?], ARRAY[?, ?] FROM t1 LIMIT ?"),
    # Escape, national, bit and dollar strings are not literals; comments nest.
    ("SELECT $t$ x; 'y $t$ FROM t1 WHERE col_2 = e'a'", "SELECT $t$ x; 'y $t$ FROM t1 WHERE col_2 = E'a'"),
    (r"SELECT a FROM t WHERE b = E'it\'s' AND c = 5 AND d = 'z'", r"SELECT a FROM t WHERE b = E'it\'s' AND c = ? AND d = ?"),
    ("SELECT a FROM t WHERE b = x'1F' AND c = $$y$$ AND d = B'01' AND n = N'q'",
     "SELECT a FROM t WHERE b = X'1F' AND c = $$y$$ AND d = B'01' AND n = N'q'"),
    ("SELECT a FROM t /* x /* y */ z */ WHERE b = 5", "SELECT a FROM t WHERE b = ?"),
    ("select count(*), sum(x*2.5e3) from t group by 1 order by count(*) desc",
     "SELECT count(*), sum(x * ?) FROM t GROUP BY ? ORDER BY count(*) DESC"),
    (" ; ; ", " ; ; "),
    ("", ""),
]


@pytest.fixture(scope="module")
def named(spark):
    df = spark.createDataFrame(CANONICAL, "sql string, want string")
    df = df.withColumn("shape", fp.literal_shape(F.col("sql")))
    return df.select(
        "want",
        fp.family_sql("sql", "true").alias("direct"),
        fp.family_sql("shape", "true").alias("by_shape"),
    ).collect()


def test_canonical_text(named):
    assert [r.direct for r in named] == [r.want for r in named]


def test_shape_leads_to_the_same_text(named):
    assert [r.by_shape for r in named] == [r.want for r in named]


def test_raw_text_is_kept_when_not_parsed(spark):
    df = spark.createDataFrame([("select  1",)], "sql string")
    assert df.select(fp.family_sql("sql", "false")).first()[0] == "select  1"


@pytest.mark.parametrize("sql, could_be", [
    ("SELECT 1", True), ("(SELECT 1) UNION (SELECT 2)", True), ("/* c */ BEGIN;", True), ("SELECT *", True),
    ("SELECT u.name FROM users u WHERE", False), ("SELECT (1", False), ("SELECT 'abc", False), ("INSERT INTO t VALUES (1,", False),
    ("hello world", False), ("SELECT a FROM t ORDER BY", False), ("UPDATE t SET a =", False), ("", False),
    ("SELECT '(' , E'\\'(' FROM t", True), ("SELECT \"a(\" FROM t", True),
    ("SELECT a FROM t FOR UPDATE", True), ("select a from t for  update;", True), ("SELECT a FROM t FOR NO KEY UPDATE", True),
    ("INSERT INTO t DEFAULT VALUES", True), ("INSERT INTO t default values ;", True), ("VACUUM FULL", True),
    ("VACUUM ANALYZE FULL", True), ("ALTER TABLE t REPLICA IDENTITY FULL", True), ("SET a = on", True), ("SET a TO ON", True),
    ("SET LOCAL a=ON;", True), ("SELECT a FROM t FOR UPDATE OF t", True), ("SELECT a FROM t FOR SHARE", True),
    ("SELECT a FROM t FOR", True), ("INSERT INTO t VALUES", False), ("INSERT INTO t (a) VALUES", False),
    ("SELECT a FROM t JOIN u ON", False), ("SELECT a FROM t LEFT JOIN u ON t.a = u.a AND", False), ("UPDATE", False),
    ("SELECT a FROM t FULL", False), ("SELECT xfor update", False), ("/* a */ -- b\n SELECT 1", True),
])
def test_text_that_cannot_be_sql(spark, sql, could_be):
    df = spark.createDataFrame([(sql,)], "sql string")
    assert df.select(fp.plausible(fp.literal_shape(F.col("sql")))).first()[0] is could_be


def test_long_statement(spark):
    values = ",".join(f"'v{i}''x'" for i in range(40_000))
    sql = f"INSERT INTO t (a) VALUES ({values}); SELECT '{'y' * 300_000}'"
    df = spark.createDataFrame([(sql,)], "sql string").withColumn("shape", fp.literal_shape(F.col("sql")))
    row = df.select("shape", fp.family_sql("shape", "true").alias("f")).first()
    assert row.shape.count("?") == 40_001 and row.f.endswith(";SELECT ?")


def test_regex_fingerprint(spark):
    cases = [
        ("SELECT * FROM users WHERE id = 1", "SELECT * FROM users WHERE id = N"),
        ("SELECT * FROM users WHERE id = $1", "SELECT * FROM users WHERE id = ?"),
        ("  SELECT  *\n FROM t1 WHERE a = 'it' AND b=2.50 ", "SELECT * FROM t1 WHERE a = S AND b=N"),
        ("INSERT INTO t VALUES ($1, 'x 1', 30)", "INSERT INTO t VALUES (?, S, N)"),
    ]
    df = spark.createDataFrame(cases, "sql string, want string")
    rows = df.select("want", fp.regex_fingerprint(F.col("sql")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


CLASSES = [
    # sql, by form, by prefix, nine-way
    ("SELECT 1", "SELECT", "SELECT", "SELECT"),
    ("  select 1", "SELECT", "SELECT", "SELECT"),
    ("(SELECT 1) UNION (SELECT 2)", "SELECT", "OTHER", "OTHER"),
    ("WITH x AS (SELECT 1) SELECT * FROM x", "SELECT", "OTHER", "OTHER"),
    ("VALUES (1)", "SELECT", "OTHER", "OTHER"),
    ("INSERT INTO t VALUES (1)", "INSERT", "INSERT", "INSERT"),
    ("update t set a = 1", "UPDATE", "UPDATE", "UPDATE"),
    ("DELETE FROM t", "DELETE", "DELETE", "DELETE"),
    ("CREATE TABLE t (id INT)", "DDL", "DDL", "CREATE"),
    ("CREATE UNIQUE INDEX i ON t(a)", "DDL", "DDL", "CREATE"),
    ("CREATE OR REPLACE VIEW v AS SELECT 1", "DDL", "DDL", "CREATE"),
    ("CREATE ROLE r", "OTHER", "DDL", "CREATE"),
    ("DROP TABLE t", "DDL", "DDL", "DROP"),
    ("DROP FUNCTION f", "OTHER", "DDL", "DROP"),
    ("ALTER TABLE t ADD c INT", "DDL", "DDL", "ALTER"),
    ("ALTER ROLE r", "OTHER", "DDL", "ALTER"),
    ("TRUNCATE t", "DDL", "DDL", "OTHER"),
    ("GRANT SELECT ON t TO u", "OTHER", "DDL", "OTHER"),
    ("REVOKE ALL ON t FROM u", "OTHER", "DDL", "OTHER"),
    ("BEGIN", "OTHER", "OTHER", "TRANSACTION"),
    ("COMMIT", "OTHER", "OTHER", "TRANSACTION"),
    ("rollback", "OTHER", "OTHER", "TRANSACTION"),
    ("EXPLAIN SELECT 1", "OTHER", "OTHER", "OTHER"),
    ("VACUUM", "OTHER", "OTHER", "OTHER"),
    ("/* app=x */ SELECT 1", "SELECT", "OTHER", "OTHER"),
    ("/* a /* b */ c */ -- d\n (UPDATE t SET a = 1", "UPDATE", "OTHER", "OTHER"),
    ("--\nDROP TABLE t", "DDL", "OTHER", "OTHER"),
    ("/* only */", "OTHER", "OTHER", "OTHER"),
]


def test_classes(spark):
    df = spark.createDataFrame([(c[0],) for c in CLASSES], "sql string")
    sql = F.col("sql")
    rows = df.select("sql", statement_class(sql), prefix_class(sql), nine_way_class(sql)).collect()
    assert [tuple(r) for r in rows] == CLASSES


def test_statements_of_a_line(spark):
    df = spark.createDataFrame([("SELECT 1; DELETE FROM t WHERE a = 'x;y' ;;",)], "sql string")
    queries = df.select(fp.parsed_queries("sql")).first()[0]
    assert [(q.sql, q.query_type, q.normalized_query) for q in queries] == [
        ("SELECT 1", "SELECT", "SELECT ?"),
        ("DELETE FROM t WHERE a = 'x;y'", "DELETE", "DELETE FROM t WHERE a = ?"),
    ]


def test_escapes(spark):
    df = spark.createDataFrame([("it's 100%_a\\b",)], "t string")
    row = df.select(quote_literal(F.col("t")), quote_like(F.col("t"))).first()
    assert tuple(row) == ("it''s 100%_a\\b", "it''s 100\\%\\_a\\\\b")
