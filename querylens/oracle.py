"""SQL answers for the registered queries.

They start from the columns of ``events`` and never parse a log line: what the
queries read out of rendered text is written down here directly.
"""

from __future__ import annotations

from querylens.catalog import (
    CLOUDWATCH_SAMPLE,
    DIFF_OPTIONS,
    PEAK_FACTOR,
    POINTS,
    SAMPLE_LINES,
    SLOW_MS,
)
from querylens.sources.derived import BUSY_FACTOR, BUSY_HOURS, FACTOR, FORMS as FORM_COUNT, LEVEL_WORDS, TARGET_START

# --- the log as columns -----------------------------------------------------

EV = """
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
         printf('%.3f', value) AS v,
         CAST(printf('%.3f', value) AS DOUBLE) AS ms
  FROM events)
"""

LOG = EV + """,
lg AS (
  SELECT event_id AS ri, {ts} AS ts, 'target' AS w,
         CAST(user_id AS VARCHAR) AS pid,
         'u' || (user_id % 5) AS usr, 'db' || (user_id % 3) AS db, {app} AS app,
         CASE WHEN event_type IN ('view', 'signup', 'purchase') THEN 'Statement'
              WHEN event_type = 'click' THEN 'Duration'
              WHEN k % 2 = 0 THEN 'Error' ELSE 'Log' END AS kind,
         CASE event_type
              WHEN 'view' THEN 'SELECT * FROM items WHERE id = ' || k
              WHEN 'signup' THEN
                'INSERT INTO users (id, score) VALUES (' || user_id || ', ' || v || ')'
              WHEN 'purchase' THEN 'UPDATE orders SET total = ' || v || ' WHERE id = ' || k
         END AS stmt,
         CASE event_type
              WHEN 'view' THEN 'SELECT * FROM items WHERE id = ?'
              WHEN 'signup' THEN 'INSERT INTO users (id, score) VALUES (?, ?)'
              WHEN 'purchase' THEN 'UPDATE orders SET total = ? WHERE id = ?'
         END AS norm,
         CASE WHEN event_type IN ('purchase', 'click') THEN ms END AS dur,
         CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'connection lost to shard ' || k
              WHEN event_type = 'error' THEN 'connection received: host=10.0.0.' || k
         END AS msg,
         v
  FROM ev)
"""
DEFAULT = LOG.format(ts="ts", app="'app' || (user_id % 4)")
BURSTY = DEFAULT.replace(
    "CAST(user_id AS VARCHAR) AS pid",
    "CASE WHEN event_id = 0 OR event_id >= (SELECT count(*) FROM ev) * 2 // 3 THEN '0' ELSE CAST(user_id AS VARCHAR) END AS pid",
)
BUSY_VALUE = f"value * CASE WHEN hour(ts) IN {BUSY_HOURS} THEN {BUSY_FACTOR} ELSE {FACTOR} END"
BUSY = DEFAULT.replace("printf('%.3f', value)", f"printf('%.3f', {BUSY_VALUE})")
RDS = LOG.format(ts="date_trunc('second', ts)", app="CAST(NULL AS VARCHAR)")

EXECUTIONS = """,
sd AS (
  SELECT *, count(*) FILTER (WHERE kind = 'Statement')
              OVER (PARTITION BY w, pid ORDER BY ri) AS seg
  FROM lg WHERE kind IN ('Statement', 'Duration')),
closer AS (
  SELECT s.w, s.pid, s.seg, min(d.ri) AS dri
  FROM sd s JOIN sd d ON d.w = s.w AND d.pid = s.pid AND d.seg = s.seg
  WHERE s.kind = 'Statement' AND s.dur IS NULL AND d.kind = 'Duration' AND d.ts >= s.ts
  GROUP BY 1, 2, 3),
ex AS (
  SELECT s.*, c.dri, coalesce(s.dur, d.dur) AS ms,
         CASE WHEN coalesce(s.dur, d.dur) IS NULL THEN 'StatementOnly' ELSE 'Exact' END AS conf,
         coalesce(CASE WHEN s.dur IS NOT NULL THEN s.ri END, c.dri,
                  lead(s.ri) OVER (PARTITION BY s.w, s.pid ORDER BY s.ri),
                  9223372036854775807) AS emit_index,
         CASE WHEN s.dur IS NULL THEN 0 ELSE 1 END AS emit_part,
         'queryid=|db=' || s.db || '|user=' || s.usr || '|app=' || coalesce(s.app, '')
           || '|sql=' || s.norm AS fam
  FROM sd s
  LEFT JOIN closer c ON c.w = s.w AND c.pid = s.pid AND c.seg = s.seg
  LEFT JOIN lg d ON d.w = c.w AND d.ri = c.dri
  WHERE s.kind = 'Statement')
"""

WINDOWS = DEFAULT.replace("lg AS", "one AS") + f""",
lg AS (
  SELECT * REPLACE (
    CASE WHEN ts < TIMESTAMP '{TARGET_START}' THEN 'baseline' ELSE 'target' END AS w,
    ri - min(ri) OVER (PARTITION BY ts < TIMESTAMP '{TARGET_START}') AS ri)
  FROM one)
"""

TOTALS = """,
tot AS (
  SELECT fam, db, usr, app, norm, count(*) AS n, coalesce(sum(ms), 0) AS total,
         coalesce(max(ms), 0) AS peak, count(*) FILTER (WHERE conf = 'Exact') AS exact
  FROM ex GROUP BY ALL)
"""


def evidence(kind: str, where: str = "TRUE") -> str:
    return f""",
refs AS (
  SELECT fam, ts, emit_index, emit_part, ri, 0 AS part, ri AS ref FROM ex WHERE {where}
  UNION ALL
  SELECT fam, ts, emit_index, emit_part, ri, 1, dri FROM ex WHERE dri IS NOT NULL AND {where}),
first_refs AS (
  SELECT *, row_number() OVER (
    PARTITION BY fam ORDER BY ts, emit_index, emit_part, ri, part) AS nth FROM refs),
evid AS (
  SELECT fam, string_agg('{kind}:' || ref, ',' ORDER BY nth) AS evidence
  FROM first_refs WHERE nth <= 3 GROUP BY fam)
"""


def next_sql(norm: str, db: str, usr: str, app: str) -> tuple[str, str]:
    by_text = (
        "'select queryid, calls, total_exec_time, mean_exec_time, rows, query from "
        "pg_stat_statements where query ilike ''%' || replace(replace(replace(replace("
        f"{norm}, '''', ''''''), '\\', '\\\\'), '%', '\\%'), '_', '\\_') || "
        "'%'' order by total_exec_time desc limit 20;'"
    )
    activity = (
        "'select pid, usename, datname, application_name, state, wait_event_type, wait_event, "
        "query_start, query from pg_stat_activity where ' || concat_ws(' and ', "
        f"'datname = ''' || {db} || '''', 'usename = ''' || {usr} || '''', "
        f"'application_name = ''' || {app} || '''') || "
        "' order by query_start desc nulls last limit 20;'"
    )
    return by_text, activity


BY_TEXT, ACTIVITY = next_sql("norm", "db", "usr", "app")
CONFIDENCE = (
    "CASE WHEN n - exact = 0 THEN 'high' WHEN exact > 0 THEN 'medium' ELSE 'low' END"
)
PAIR_CODES = (
    "CASE WHEN exact > 0 THEN 'correlated_duration' END, "
    "CASE WHEN n - exact > 0 THEN 'partial_correlation' END"
)

TOP = f"""
WITH {DEFAULT}{EXECUTIONS}{TOTALS}{evidence("Stderr")},
best AS (
  SELECT *, row_number() OVER (ORDER BY total DESC, fam) AS rank FROM tot
  QUALIFY rank <= 10)
SELECT CAST(rank AS INTEGER) AS rank, 'query_family:' || fam AS finding_id,
       'query_family' AS kind, 'Query family with high total runtime' AS title,
       n || ' executions contributed ' || printf('%.3f', total)
         || ' ms total runtime; max execution was ' || printf('%.3f', peak) || ' ms' AS reason,
       concat_ws(',', 'high_total_duration', 'high_max_duration', {PAIR_CODES}) AS reason_codes,
       round(total, 6) AS score, norm AS normalized_sql, db AS database_name, usr AS user_name,
       app AS application_name, n AS execution_count, round(total, 6) AS total_duration_ms,
       round(total / n, 6) AS avg_duration_ms, peak AS max_duration_ms,
       exact AS correlated_count, n - exact AS uncorrelated_count, evidence,
       {CONFIDENCE} AS confidence, {BY_TEXT} || chr(10) || {ACTIVITY} AS next_sql
FROM best JOIN evid USING (fam)
"""

# Nearest rank: sorted[min(floor(n * p), n - 1)], lists are 1-based.


def rank_of(value: str, p: float) -> str:
    return (
        f"list_sort(list({value}))[CAST(least(floor(count({value}) * {p!r}::DOUBLE), "
        f"count({value}) - 1) AS BIGINT) + 1]"
    )


METRICS = WINDOWS + EXECUTIONS + f""",
met AS (
  SELECT w, fam, db, usr, app, norm, count(*) AS n_all, count(ms) AS n,
         coalesce(sum(ms), 0) AS total, coalesce(avg(ms), 0) AS mean,
         coalesce({rank_of("ms", 0.95).replace("list(ms)", "list(ms) FILTER (WHERE ms IS NOT NULL)")}, 0) AS p95,
         coalesce(max(ms), 0) AS peak, count(*) FILTER (WHERE conf = 'Exact') AS exact
  FROM ex GROUP BY ALL)
"""

DELTAS = METRICS + """,
del AS (
  SELECT t.*, coalesce(b.n, 0) AS bn, coalesce(b.total, 0) AS btotal,
         coalesce(b.mean, 0) AS bmean, coalesce(b.p95, 0) AS bp95, coalesce(b.peak, 0) AS bpeak
  FROM (SELECT * FROM met WHERE w = 'target') t
  LEFT JOIN (SELECT * FROM met WHERE w = 'baseline') b USING (fam))
"""

FLAGS = DELTAS + f""",
flg AS (
  SELECT *, bn = 0 AS absent,
         p95 - bp95 >= {DIFF_OPTIONS.min_p95_delta_ms} AND p95 > bp95 AS slower,
         total - btotal > 0 AS costlier,
         CASE WHEN bn = 0 THEN total + p95
              ELSE greatest(total - btotal, 0) + greatest(p95 - bp95, 0) END AS score
  FROM del
  WHERE n >= {DIFF_OPTIONS.min_target_count} AND total >= {DIFF_OPTIONS.min_target_total_ms}),
cand AS (SELECT * FROM flg WHERE absent OR slower OR costlier)
"""

DIFF = f"""
WITH {FLAGS}{evidence("Stderr", "w = 'target'")},
best AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, fam) AS rank FROM cand
  QUALIFY rank <= {DIFF_OPTIONS.limit})
SELECT CAST(rank AS INTEGER) AS rank, 'slow_query_diff:' || fam AS finding_id,
       'slow_query_regression' AS kind, 'Query family regressed in target window' AS title,
       concat_ws('; ', CASE WHEN absent THEN 'absent in baseline' END,
         CASE WHEN slower THEN 'p95 increased by ' || printf('%.3f', p95 - bp95) || ' ms' END,
         CASE WHEN costlier THEN
           'total runtime increased by ' || printf('%.3f', total - btotal) || ' ms' END) AS reason,
       concat_ws(',', 'meets_eligibility_thresholds',
         CASE WHEN absent THEN 'absent_in_baseline' END,
         CASE WHEN slower THEN 'p95_regressed' END,
         CASE WHEN costlier THEN 'runtime_contribution_increased' END,
         {PAIR_CODES.replace("n - exact", "n_all - exact")}) AS reason_codes,
       round(score, 6) AS score, norm AS normalized_sql, db AS database_name, usr AS user_name,
       app AS application_name, n AS execution_count, round(total, 6) AS total_duration_ms,
       round(mean, 6) AS avg_duration_ms, peak AS max_duration_ms, exact AS correlated_count,
       n_all - exact AS uncorrelated_count, evidence,
       {CONFIDENCE.replace("n - exact", "n_all - exact")} AS confidence,
       {BY_TEXT} || chr(10) || {ACTIVITY} AS next_sql,
       bn AS baseline_count, round(bp95, 6) AS baseline_p95_ms, n AS target_count,
       round(p95, 6) AS target_p95_ms, round(total - btotal, 6) AS delta_total_ms
FROM best JOIN evid USING (fam)
"""

# --- rendered lines and files ----------------------------------------------

LINES = EV + """,
ln AS (
  SELECT *,
    CASE event_type
      WHEN 'view' THEN 'LOG:  statement: SELECT * FROM items WHERE id = ' || k
      WHEN 'signup' THEN 'LOG:  statement: INSERT INTO users (id, score) VALUES ('
                         || user_id || ', ' || v || ')'
      WHEN 'purchase' THEN 'LOG:  duration: ' || v || ' ms  statement: UPDATE orders SET total = '
                           || v || ' WHERE id = ' || k
      WHEN 'click' THEN 'LOG:  duration: ' || v || ' ms'
      ELSE CASE WHEN k % 2 = 0 THEN 'ERROR:  connection lost to shard ' || k
                ELSE 'LOG:  connection received: host=10.0.0.' || k END
    END AS body,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' UTC [' || user_id || '] u' || (user_id % 5)
      || '@db' || (user_id % 3) || ' app' || (user_id % 4) || ': ' AS prefix,
    CASE WHEN event_type IN ('view', 'signup', 'purchase') THEN 'STATEMENT'
         WHEN event_type = 'click' THEN 'DURATION'
         WHEN k % 2 = 0 THEN 'ERROR' ELSE 'LOG' END AS level
  FROM ev)
"""

FILES = LINES + """,
placed AS (SELECT *, event_id // 2500 AS number FROM ln),
named AS (
  SELECT *, CASE number % 4
    WHEN 0 THEN printf('pg_%06d.log', number) WHEN 1 THEN printf('pg_%06d.TXT', number)
    WHEN 2 THEN printf('postgres_%06d', number) ELSE printf('audit_%06d.csv', number)
    END AS file_name,
    CASE WHEN k % 10 = 0 THEN 3 ELSE 1 END AS line_count
  FROM placed),
logs AS (SELECT * FROM named WHERE number % 4 <> 3)
"""

MESSAGE = """CASE WHEN event_type IN ('view', 'signup')
  THEN regexp_replace(body, '^LOG:  ', '')
  WHEN event_type = 'purchase' THEN regexp_replace(body, '^.* ms  ', '')
  ELSE regexp_replace(body, '^[A-Z]+:  ', '') END"""

FORMS = [
    # canonical statements of each form of varied_statement
    ["SELECT * FROM items WHERE id = ?"],
    ["SELECT name FROM users WHERE name = ? AND active = ?"],
    ["INSERT INTO users (id, score) VALUES (?, ?)"],
    ["UPDATE orders SET note = ?, total = ? WHERE id IN (?, ?)"],
    ["DELETE FROM carts WHERE note IS NULL AND id = ?"],
    ["CREATE TABLE t_{k} (id INT)"],
    ["DROP TABLE t_{k}"],
    ["ALTER TABLE t ADD COLUMN c_{k} INT"],
    ["TRUNCATE audit"],
    ["GRANT SELECT ON items TO u{k}"],
    ["BEGIN"],
    ["COMMIT"],
    ["WITH x AS (SELECT ?) SELECT * FROM x"],
    ["SELECT count(*) FROM items", "DELETE FROM items WHERE id = ?"],
    ["EXPLAIN SELECT ?"],
    ["SELECT ? AS s, o.total FROM orders AS o WHERE o.id = ?"],
    ["SELECT a::INT FROM t WHERE note = E'it\\'s' AND id = ?"],
    ["SELECT id FROM t WHERE id = ?"],
    ["SELECT $$x y$$ AS s, ?"],
    ["SELECT X'1F' AS b FROM t WHERE id = ?"],
    ["SELECT total FROM orders WHERE id = ? FOR UPDATE"],
    ["SELECT total FROM orders WHERE id = ? FOR NO KEY UPDATE"],
    ["INSERT INTO audit DEFAULT VALUES"],
    ["SELECT stock FROM shelves WHERE id = ?"],
    ["UPDATE orders SET total = ? WHERE id = ?"],
    ["VACUUM FULL items"],
    ["SET enable_seqscan = ON"],
    ["SELECT total FROM orders WHERE id IN (?,"],
    ["UPDATE orders SET total = ? WHERE"],
]
REGEX_FORMS = [
    "SELECT * FROM items WHERE id=N",
    "select name from users where name = S and active = true",
    "INSERT INTO users (id, score) VALUES (N, N);",
    "UPDATE orders SET note = NULL, total = N WHERE id IN (N, ?)",
    "DELETE FROM carts WHERE note IS NULL AND id = N",
    "CREATE TABLE t_{k} (id INT)",
    "DROP TABLE t_{k}",
    "ALTER TABLE t ADD COLUMN c_{k} INT",
    "TRUNCATE audit",
    "GRANT SELECT ON items TO u{k}",
    "BEGIN",
    "COMMIT;",
    "WITH x AS (SELECT N) SELECT * FROM x",
    "SELECT count(*) FROM items; DELETE FROM items WHERE id = N",
    "EXPLAIN SELECT N",
    "SELECT S AS s, o.total FROM orders o WHERE o.id = N",
    "SELECT a::int FROM t WHERE note = ESs' AND id = N",
    "SELECT /* a /* b */ c */ id FROM t WHERE id = N",
    "SELECT $$x y$$ AS s, N",
    "SELECT XS AS b FROM t WHERE id = N -- done",
    "SELECT total FROM orders WHERE id = N FOR UPDATE",
    "select total from orders where id = N for no key update;",
    "INSERT INTO audit DEFAULT VALUES",
    "/* page N */ SELECT stock FROM shelves WHERE id = N",
    "/* job */ UPDATE orders SET total = N WHERE id = N",
    "VACUUM FULL items",
    "SET enable_seqscan = ON",
    "SELECT total FROM orders WHERE id IN (N,",
    "UPDATE orders SET total = N WHERE",
]
STATEMENT_CLASSES = ["SELECT", "SELECT", "INSERT", "UPDATE", "DELETE", "DDL", "DDL", "DDL", "DDL",
                     "OTHER", "OTHER", "OTHER", "SELECT", "SELECT", "OTHER", *["SELECT"] * 7, "INSERT", "SELECT",
                     "UPDATE", "OTHER", "OTHER", "SELECT", "UPDATE"]
PREFIX_CLASSES = ["SELECT", "SELECT", "INSERT", "UPDATE", "DELETE", "DDL", "DDL", "DDL", "DDL",
                  "DDL", "OTHER", "OTHER", "OTHER", "SELECT", "OTHER", *["SELECT"] * 7, "INSERT", "OTHER",
                  "OTHER", "OTHER", "OTHER", "SELECT", "UPDATE"]
NINE_CLASSES = ["SELECT", "SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER",
                "OTHER", "OTHER", "TRANSACTION", "TRANSACTION", "OTHER", "SELECT", "OTHER",
                *["SELECT"] * 7, "INSERT", "OTHER", "OTHER", "OTHER", "OTHER", "SELECT", "UPDATE"]


def _quoted(text: str) -> str:
    literal = "'" + text.replace("'", "''") + "'"
    return literal.replace("{k}", "' || k || '").replace("{v}", "' || v || '")


def _by_form(texts: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {_quoted(t)}" for i, t in enumerate(texts))
    return f"CASE k % {FORM_COUNT} {arms} END"


def _class_sql(classes: list[str]) -> str:
    return f"""WITH {EV} SELECT CAST(k % {FORM_COUNT} AS INTEGER) AS form, {_by_form(classes)} AS query_type,
  count(*) AS statement_count FROM ev GROUP BY ALL"""


_rows = [
    (form, len(texts), text, "DELETE" if (form, i) == (13, 1) else STATEMENT_CLASSES[form])
    for form, texts in enumerate(FORMS)
    for i, text in enumerate(texts)
]
FORM_ROWS = " UNION ALL ".join(
    f"SELECT k, {size} AS pieces, {_quoted(text)} AS norm, '{kind}' AS query_type "
    f"FROM ev WHERE k % {FORM_COUNT} = {form}"
    for form, size, text, kind in _rows
)

# What forms that cannot be SQL keep: their own text.
RAW_FORMS = {27: "SELECT total FROM orders WHERE id IN ({k},", 28: "UPDATE orders SET total = {v} WHERE"}
PARSED_FORMS = [RAW_FORMS.get(i, ";".join(texts)) for i, texts in enumerate(FORMS)]

SQL_TEXT = "'SELECT total FROM orders WHERE id = ' || k"

HOUR = "CAST(hour(ts) AS INTEGER)"
SECONDS = "(epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000"
QPS = f"CASE WHEN count(*) > 1 AND {SECONDS} > 0 THEN count(*) / ({SECONDS}) ELSE 0.0 END"

SUMMARY = f"""
  SELECT count(*) AS total_queries, coalesce(sum(d), 0.0) AS total_duration,
         coalesce(avg(d), 0.0) AS average_duration, {rank_of("d", 0.95)} AS p95_duration,
         {rank_of("d", 0.99)} AS p99_duration
  FROM (SELECT coalesce(ms, 0.0) AS d FROM ex)
"""

ORACLES: dict[str, str] = {
    "src_directory_logs": f"""WITH {FILES} SELECT file_name,
  CAST(sum(line_count) AS BIGINT) AS line_count FROM logs GROUP BY 1""",
    "src_file_list": f"""WITH {FILES} SELECT file_name,
  CAST(sum(line_count) AS BIGINT) AS line_count FROM named WHERE number % 2 = 0 GROUP BY 1""",
    "src_sample_lines": f"""WITH {FILES},
started AS (SELECT *, CAST(sum(line_count) OVER (PARTITION BY file_name ORDER BY event_id)
  - line_count AS BIGINT) AS start FROM named),
every AS (
  SELECT file_name, start AS line_no, prefix || body AS value FROM started
  UNION ALL SELECT file_name, start + 1, '    -- continued' FROM started WHERE line_count = 3
  UNION ALL SELECT file_name, start + 2, '' FROM started WHERE line_count = 3)
SELECT * FROM every WHERE line_no < {SAMPLE_LINES}""",
    "src_record_index": f"""WITH {FILES} SELECT
  row_number() OVER (ORDER BY file_name, event_id) - 1 AS record_index, ts,
  CAST(user_id AS VARCHAR) AS process_id, level FROM named""",
    "src_quarantine_files": f"""WITH {FILES},
kept AS (SELECT * FROM named WHERE file_name NOT IN (
  SELECT file_name FROM named WHERE CAST(ts AS DATE) = DATE '2024-01-17')),
numbered AS (SELECT file_name, row_number() OVER (ORDER BY file_name, event_id) - 1 AS i FROM kept)
SELECT file_name, count(*) AS entry_count, min(i) AS first_record, max(i) AS last_record
FROM numbered GROUP BY 1""",
    "src_cloudwatch_json": f"""WITH {LINES} SELECT
  row_number() OVER (ORDER BY event_id) - 1 AS record_index, 'AwsRds' AS source_kind,
  date_trunc('second', ts) AS ts, CAST(user_id AS VARCHAR) AS process_id,
  '10.1.0.' || (user_id % 250) AS client_host, level FROM ln""",
    # A message of three lines ends in a blank one that a message's line list leaves out.
    "src_cloudwatch_sample": f"""WITH {LINES},
started AS (SELECT *, sum(CASE WHEN k % 10 = 0 THEN 2 ELSE 1 END) OVER (ORDER BY event_id)
  - CASE WHEN k % 10 = 0 THEN 2 ELSE 1 END AS start FROM ln)
SELECT row_number() OVER (ORDER BY event_id) - 1 AS record_index,
  CAST(user_id AS VARCHAR) AS process_id, level FROM started WHERE start < {CLOUDWATCH_SAMPLE}""",
    "src_window_paths": DIFF,
    "src_response_zones": f"""WITH {LINES} SELECT
  row_number() OVER (ORDER BY event_id) - 1 AS record_index, CAST(user_id AS VARCHAR) AS process_id,
  level FROM ln
WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 12:00:00.001'""",
    "src_response_window": f"""WITH {LINES} SELECT
  row_number() OVER (ORDER BY event_id) - 1 AS record_index, CAST(user_id AS VARCHAR) AS process_id,
  level FROM ln
WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 12:00:00.001'""",
    "sql_unparsed_text": f"""WITH {EV} SELECT k % 3 <> 0 AS parsed,
  'SELECT total FROM orders WHERE id =' || CASE WHEN k % 3 <> 0 THEN ' ?' ELSE '' END AS query,
  count(*) AS statement_count FROM ev GROUP BY ALL""",
    "sql_parsed_forms": f"""WITH {EV}
SELECT k % {FORM_COUNT} NOT IN {tuple(RAW_FORMS)} AS parsed, {_by_form(PARSED_FORMS)} AS query,
  count(*) AS statement_count FROM ev GROUP BY ALL""",
    "slowest_queries_default": f"""WITH {BUSY}{EXECUTIONS} SELECT norm AS query,
  ms AS duration_ms, ts FROM ex WHERE ms > 1000.0
ORDER BY ms DESC, ts, emit_index, emit_part LIMIT 10""",
    "peak_hours_default": f"""WITH {BUSY}, h AS (SELECT {HOUR} AS hour, sum(dur) AS total
  FROM lg WHERE dur IS NOT NULL GROUP BY 1)
SELECT hour, round(total, 6) AS total_duration_ms FROM h
WHERE total > (SELECT avg(total) FROM h) * 1.5""",
    "accumulated_summary": f"""WITH {DEFAULT}, q AS (SELECT *, {_by_form(NINE_CLASSES)} AS t FROM ev),
s AS (SELECT count(*) AS n, sum(value) AS total FROM q),
c AS (SELECT count(*) FILTER (WHERE kind = 'Error') AS e, count(*) FILTER (WHERE kind = 'Log') AS l FROM lg)
SELECT t AS query_type, count(*) AS query_count, any_value(s.n) AS total_queries,
  round(any_value(s.total), 6) AS total_duration, any_value(c.e) AS error_count,
  any_value(c.l) AS connection_count FROM q, s, c GROUP BY 1""",
    "src_time_window": """SELECT event_id, ts FROM events
WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 12:00:00.001'""",
    "sink_findings_json": TOP,
    "findings_lookup": f"""SELECT rank, finding_id, kind, title, next_sql FROM ({TOP})
WHERE rank = 2""",
    "findings_store_lookup": f"""SELECT 'families' AS run, rank, finding_id, kind, title, next_sql FROM ({TOP}) WHERE rank = 1
UNION ALL SELECT 'changes', rank, finding_id, kind, title, next_sql FROM ({DIFF}) WHERE rank = 2""",
    "ordered_executions": f"""WITH {RDS}{EXECUTIONS} SELECT
  row_number() OVER (ORDER BY ts, emit_index, emit_part, ri) - 1 AS position, 'aws-rds:' || ri AS execution_id, ts FROM ex""",
    "report_workload_json": f"""WITH {DEFAULT}{EXECUTIONS}, s AS ({SUMMARY}),
freq AS (SELECT norm, count(*) AS n FROM ex GROUP BY 1 ORDER BY n DESC, norm LIMIT 20),
slow AS (SELECT norm, ms FROM ex WHERE ms > 1000.0 ORDER BY ms DESC, ts, emit_index LIMIT 10)
SELECT 'entries' AS section, 'all' AS name, (SELECT count(*) FROM lg) AS item_count,
       CAST(NULL AS DOUBLE) AS value
UNION ALL SELECT 'summary', 'queries', total_queries, round(total_duration, 6) FROM s
UNION ALL SELECT 'summary', 'average', NULL, round(average_duration, 6) FROM s
UNION ALL SELECT 'summary', 'errors', count(*) FILTER (WHERE kind = 'Error'), NULL FROM lg
UNION ALL SELECT 'summary', 'connections', count(*) FILTER (WHERE kind = 'Log'), NULL FROM lg
UNION ALL SELECT 'by_type', split_part(norm, ' ', 1), count(*), NULL FROM ex GROUP BY 2
UNION ALL SELECT 'slowest', slow.norm, coalesce(freq.n, 1), round(slow.ms, 6)
  FROM slow LEFT JOIN freq USING (norm)
UNION ALL SELECT 'frequent', norm, n, round(average_duration, 6) FROM freq, s""",
    "report_timing_json": f"""WITH {DEFAULT},
t AS (SELECT avg(dur) AS a, {rank_of("dur", 0.95)} AS p95, {rank_of("dur", 0.99)} AS p99
  FROM lg WHERE dur IS NOT NULL)
SELECT 'tail' AS section, 'average' AS name, CAST(NULL AS BIGINT) AS item_count,
       trunc(a) AS value FROM t
UNION ALL SELECT 'tail', 'p95', NULL, trunc(p95) FROM t
UNION ALL SELECT 'tail', 'p99', NULL, trunc(p99) FROM t
UNION ALL SELECT 'hour', CAST(hour(ts) AS VARCHAR), NULL, round(sum(dur), 6)
  FROM lg WHERE dur IS NOT NULL GROUP BY 2""",
    "parse_line_filter": f"""WITH {LINES} SELECT event_id AS record_index, prefix || body AS line
FROM ln UNION ALL SELECT event_id, prefix || body FROM ln""",
    "parse_default_prefix": f"""WITH {LINES} SELECT event_id AS record_index, ts,
  CAST(user_id AS VARCHAR) AS process_id, 'u' || (user_id % 5) AS user_name,
  'db' || (user_id % 3) AS database_name, CAST(NULL AS VARCHAR) AS client_host,
  'app' || (user_id % 4) AS application_name, level, {MESSAGE} AS message FROM ln""",
    "parse_rds_prefix": f"""WITH {LINES} SELECT event_id AS record_index, 'AwsRds' AS source_kind,
  date_trunc('second', ts) AS ts, CAST(user_id AS VARCHAR) AS process_id,
  'u' || (user_id % 5) AS user_name, 'db' || (user_id % 3) AS database_name,
  '10.1.0.' || (user_id % 250) AS client_host, CAST(NULL AS VARCHAR) AS application_name, level,
  {MESSAGE} AS message FROM ln""",
    "parse_auto_format": f"""WITH {LINES} SELECT event_id AS record_index,
  CASE WHEN event_id % 2 = 0 THEN ts ELSE date_trunc('second', ts) END AS ts,
  CAST(user_id AS VARCHAR) AS process_id,
  CASE WHEN event_id % 2 = 1 THEN '10.1.0.' || (user_id % 250) END AS client_host,
  CASE WHEN event_id % 2 = 0 THEN 'app' || (user_id % 4) END AS application_name FROM ln""",
    "parse_timestamps": """SELECT event_id AS record_index,
  CASE WHEN CAST(ts AS DATE) <> DATE '2024-01-17' THEN ts END AS ts FROM events""",
    "parse_metadata_nulls": """SELECT event_id AS record_index,
  CASE WHEN user_id % 5 <> 0 THEN 'u' || (user_id % 5) END AS user_name,
  CASE WHEN user_id % 3 <> 0 THEN 'db' || (user_id % 3) END AS database_name,
  CASE WHEN user_id % 4 <> 0 THEN 'app ' || (user_id % 4) END AS application_name FROM events""",
    "parse_rds_host": """SELECT event_id AS record_index, CASE event_id % 6
  WHEN 0 THEN 'host-' || user_id WHEN 1 THEN 'host-' || user_id
  WHEN 4 THEN 'host-' || user_id || '(a)' WHEN 5 THEN '(5432)' END AS client_host FROM events""",
    "parse_duration_statement": f"""WITH {EV} SELECT event_id AS record_index,
  'STATEMENT' AS level, 'statement: ' || {SQL_TEXT} AS message, {SQL_TEXT} AS statement,
  ms AS duration_ms FROM ev WHERE k % 10 IN (0, 1)""",
    "parse_statement": f"""WITH {EV} SELECT event_id AS record_index,
  CASE WHEN k % 10 = 8 THEN '' ELSE 'statement: ' END || {SQL_TEXT} AS message,
  CASE WHEN k % 10 <> 8 THEN {SQL_TEXT} END AS statement FROM ev WHERE k % 10 IN (2, 3, 8)""",
    "parse_duration": f"""WITH {EV} SELECT event_id AS record_index, CASE k % 10
  WHEN 4 THEN 'duration: ' || v || ' ms'
  WHEN 5 THEN 'duration: ' || v || ' ms  parse <unnamed>: ' || {SQL_TEXT}
  WHEN 6 THEN 'duration: 1.2.3 ms'
  WHEN 7 THEN 'duration: 1.2.3 ms  statement: ' || {SQL_TEXT}
  ELSE 'slot ' || k END AS message, CASE WHEN k % 10 IN (4, 5) THEN ms END AS duration_ms
FROM ev WHERE k % 10 IN (4, 5, 6, 7, 9)""",
    "level_counts": f"""WITH {EV} SELECT upper(
  [{", ".join(repr(w) for w in LEVEL_WORDS)}][k % {len(LEVEL_WORDS)} + 1]) AS level,
  count(*) AS entry_count FROM ev GROUP BY 1""",
    "sql_fingerprint": f"""WITH {EV}, f AS ({FORM_ROWS})
SELECT norm AS normalized_sql, count(*) AS statement_count FROM f GROUP BY 1""",
    "sql_fingerprint_regex": f"""WITH {EV} SELECT {_by_form(REGEX_FORMS)} AS normalized_sql,
  count(*) AS statement_count FROM ev GROUP BY 1""",
    "sql_statement_class": _class_sql(STATEMENT_CLASSES),
    "sql_prefix_class": _class_sql(PREFIX_CLASSES),
    "sql_nine_way_class": _class_sql(NINE_CLASSES),
    "sql_multi_statement": f"""WITH {EV}, f AS ({FORM_ROWS})
SELECT CAST(pieces AS INTEGER) AS statements_in_line, query_type, norm AS normalized_query,
  count(*) AS statement_count FROM f GROUP BY ALL""",
    "findings_next_sql": f"""WITH {DEFAULT}{EXECUTIONS}{TOTALS}
SELECT fam AS family_id, {BY_TEXT} AS by_text, {ACTIVITY} AS activity FROM tot""",
    "event_kinds": f"""WITH {DEFAULT} SELECT kind, count(*) AS event_count,
  count(dur) AS timed_count, round(sum(dur), 6) AS total_duration_ms FROM lg GROUP BY 1""",
    "event_ids": f"""WITH {RDS} SELECT ri AS record_index, 'aws-rds:' || ri AS event_id, kind,
  CASE kind WHEN 'Statement' THEN stmt WHEN 'Duration' THEN '' ELSE msg END AS text FROM lg""",
    "correlate_executions": f"""WITH {DEFAULT}{EXECUTIONS} SELECT 'stderr:' || ri AS execution_id,
  ts, pid AS process_id, stmt AS statement, ms AS duration_ms FROM ex""",
    "correlate_bursty_backend": f"""WITH {BURSTY}{EXECUTIONS} SELECT 'stderr:' || ri AS execution_id,
  pid AS process_id, ms AS duration_ms, emit_index,
  'Stderr:' || ri || coalesce(',Stderr:' || dri, '') AS evidence FROM ex""",
    "correlation_confidence": f"""WITH {RDS}{EXECUTIONS} SELECT 'aws-rds:' || ri AS execution_id,
  conf AS confidence, 'AwsRds:' || ri || coalesce(',AwsRds:' || dri, '') AS evidence FROM ex""",
    "execution_order": f"""WITH {RDS}{EXECUTIONS} SELECT 'aws-rds:' || ri AS execution_id, ts,
  emit_index, CAST(emit_part AS INTEGER) AS emit_part FROM ex""",
    "family_identity": f"""WITH {RDS}{EXECUTIONS} SELECT DISTINCT fam AS family_id,
  norm AS normalized_sql, db AS database_name, usr AS user_name, app AS application_name
FROM ex""",
    "family_totals": f"""WITH {DEFAULT}{EXECUTIONS}{TOTALS} SELECT fam AS family_id,
  n AS execution_count, round(total, 6) AS total_duration_ms, peak AS max_duration_ms,
  exact AS correlated_count, n - exact AS uncorrelated_count FROM tot""",
    "family_evidence": f"""WITH {RDS}{EXECUTIONS}{evidence("AwsRds")}
SELECT fam AS family_id, evidence FROM evid""",
    "top_query_families": TOP,
    "window_family_metrics": f"""WITH {METRICS} SELECT w AS source_window, fam AS family_id,
  n AS execution_count, round(total, 6) AS total_duration_ms, round(mean, 6) AS avg_duration_ms,
  p95 AS p95_duration_ms, peak AS max_duration_ms, exact AS correlated_count,
  n_all - exact AS uncorrelated_count FROM met""",
    "diff_deltas": f"""WITH {DELTAS} SELECT fam AS family_id, n - bn AS delta_count,
  round(total - btotal, 6) AS delta_total_duration_ms,
  round(mean - bmean, 6) AS delta_avg_duration_ms,
  round(p95 - bp95, 6) AS delta_p95_duration_ms,
  round(peak - bpeak, 6) AS delta_max_duration_ms FROM del""",
    "state_family_totals": f"""WITH {DEFAULT}{EXECUTIONS}{TOTALS} SELECT fam AS family_id,
  n AS execution_count, round(total, 6) AS total_duration_ms, peak AS max_duration_ms,
  exact AS correlated_count, n - exact AS uncorrelated_count FROM tot""",
    "state_summary": f"""WITH {DEFAULT}{EXECUTIONS}, s AS ({SUMMARY}),
c AS (SELECT count(*) FILTER (WHERE kind = 'Error') AS e, count(*) FILTER (WHERE kind = 'Log') AS l FROM lg)
SELECT split_part(norm, ' ', 1) AS query_type, count(*) AS query_count, any_value(total_queries) AS total_queries,
  round(any_value(total_duration), 6) AS total_duration, round(any_value(average_duration), 6) AS average_duration,
  any_value(p95_duration) AS p95_duration, any_value(p99_duration) AS p99_duration,
  any_value(e) AS error_count, any_value(l) AS connection_count FROM ex, s, c GROUP BY 1""",
    "state_diff": f"""WITH {DELTAS} SELECT fam AS family_id, n - bn AS delta_count,
  round(total - btotal, 6) AS delta_total_duration_ms,
  round(mean - bmean, 6) AS delta_avg_duration_ms,
  round(p95 - bp95, 6) AS delta_p95_duration_ms,
  round(peak - bpeak, 6) AS delta_max_duration_ms FROM del""",
    "diff_flags": f"""WITH {FLAGS} SELECT fam AS family_id, absent AS absent_in_baseline,
  slower AS p95_regressed, costlier AS runtime_increased, round(score, 6) AS score FROM cand""",
    "slow_query_diff": DIFF,
    "workload_summary": f"""WITH {DEFAULT}{EXECUTIONS}, s AS ({SUMMARY}) SELECT total_queries,
  round(total_duration, 6) AS total_duration, round(average_duration, 6) AS average_duration,
  p95_duration, p99_duration FROM s""",
    "duration_metrics": f"""WITH {DEFAULT}{EXECUTIONS} SELECT min(ms) AS min_duration,
  greatest(max(ms), 0.0) AS max_duration, round(avg(ms), 6) AS average_duration,
  {rank_of("ms", 0.95)} AS p95_duration, {rank_of("ms", 0.99)} AS p99_duration,
  count(*) AS total_queries, round(sum(ms), 6) AS total_duration FROM ex WHERE ms IS NOT NULL""",
    "query_type_counts": f"""WITH {DEFAULT}{EXECUTIONS} SELECT split_part(norm, ' ', 1)
  AS query_type, count(*) AS query_count FROM ex GROUP BY 1""",
    "event_type_distribution": f"""WITH {DEFAULT} SELECT split_part(norm, ' ', 1) AS query_type,
  count(*) AS query_count FROM lg WHERE kind = 'Statement' GROUP BY 1""",
    "slowest_queries": f"""WITH {DEFAULT}{EXECUTIONS} SELECT norm AS query, ms AS duration_ms, ts
FROM ex WHERE ms > {SLOW_MS} ORDER BY ms DESC, ts, emit_index, emit_part LIMIT 25""",
    "most_frequent_queries": f"""WITH {DEFAULT}{EXECUTIONS} SELECT norm AS query,
  count(*) AS query_count FROM ex GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "error_connection_counts": f"""WITH {DEFAULT} SELECT
  count(*) FILTER (WHERE kind = 'Error') AS error_count,
  count(*) FILTER (WHERE kind = 'Log') AS connection_count FROM lg""",
    "error_rate": f"""WITH {DEFAULT} SELECT
  round(count(*) FILTER (WHERE kind = 'Error') / count(*), 6) AS error_rate FROM lg""",
    "slow_statement_entries": f"""WITH {DEFAULT} SELECT ri AS record_index, ts, stmt AS statement,
  dur AS duration_ms FROM lg WHERE kind = 'Statement' AND dur > {SLOW_MS}""",
    "hourly_execution_stats": f"""WITH {DEFAULT}{EXECUTIONS} SELECT {HOUR} AS hour,
  count(*) AS query_count, round({QPS}, 9) AS queries_per_second,
  round(coalesce(sum(ms), 0), 6) AS total_duration,
  round(coalesce(sum(ms), 0) / count(*), 6) AS average_duration FROM ex GROUP BY 1""",
    "nine_way_summary": f"""WITH {EV}, q AS (SELECT *, {_by_form(NINE_CLASSES)} AS t FROM ev),
s AS (SELECT count(*) AS n, sum(value) AS total, avg(value) AS mean,
  {rank_of("value", 0.95)} AS p95, {rank_of("value", 0.99)} AS p99 FROM q)
SELECT t AS query_type, count(*) AS query_count, any_value(s.n) AS total_queries,
  round(any_value(s.total), 6) AS total_duration, round(any_value(s.mean), 6) AS average_duration,
  any_value(s.p95) AS p95_duration, any_value(s.p99) AS p99_duration FROM q, s GROUP BY 1""",
    "timing_summary": f"""WITH {DEFAULT} SELECT
  CAST(trunc(avg(dur)) AS BIGINT) AS average_response_time_ms,
  CAST(trunc({rank_of("dur", 0.95)}) AS BIGINT) AS p95_response_time_ms,
  CAST(trunc({rank_of("dur", 0.99)}) AS BIGINT) AS p99_response_time_ms,
  count(*) AS total_queries, round(sum(dur), 6) AS total_duration FROM lg WHERE dur IS NOT NULL""",
    "hourly_duration": f"""WITH {DEFAULT} SELECT {HOUR} AS hour,
  round(sum(dur), 6) AS total_duration_ms FROM lg WHERE dur IS NOT NULL GROUP BY 1""",
    "weekday_duration": f"""WITH {DEFAULT} SELECT CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
  round(sum(dur), 6) AS total_duration_ms FROM lg WHERE dur IS NOT NULL GROUP BY 1""",
    "hourly_connections": f"""WITH {DEFAULT} SELECT {HOUR} AS hour, count(*) AS connection_count
FROM lg WHERE kind IN ('Error', 'Log') GROUP BY 1""",
    "peak_hours": f"""WITH {DEFAULT}, h AS (SELECT {HOUR} AS hour, sum(dur) AS total
  FROM lg WHERE dur IS NOT NULL GROUP BY 1)
SELECT hour, round(total, 6) AS total_duration_ms FROM h
WHERE total > (SELECT avg(total) FROM h) * {PEAK_FACTOR}""",
    "percentiles": f"WITH {DEFAULT}"
    + " UNION ALL ".join(
        f"SELECT {p!r}::DOUBLE AS percentile, {rank_of('dur', p)} AS value "
        "FROM lg WHERE dur IS NOT NULL"
        for p in POINTS
    ),
    "hourly_distribution": f"""WITH {DEFAULT}, e AS (SELECT ts, coalesce(dur, 0.0) AS d
  FROM lg WHERE kind = 'Statement')
SELECT {HOUR} AS hour, count(*) AS query_count, round(sum(d), 6) AS total_duration,
  round(avg(d), 6) AS average_duration, min(d) AS min_duration, max(d) AS max_duration,
  round({QPS}, 9) AS queries_per_second FROM e GROUP BY 1""",
    "connection_analysis": f"""WITH {DEFAULT},
c AS (SELECT *, CAST(isodow(ts) - 1 AS INTEGER) AS wd, {HOUR} AS h,
  CAST(kind = 'Error' AS BIGINT) AS err FROM lg WHERE kind IN ('Error', 'Log')),
views AS (SELECT 'total' AS scope, -1 AS bucket, err FROM c
  UNION ALL SELECT 'hour', h, err FROM c UNION ALL SELECT 'weekday', wd, err FROM c)
SELECT scope, bucket, count(*) AS connection_count, CAST(sum(err) AS BIGINT) AS error_count,
  round(sum(err) / count(*), 6) AS error_rate FROM views GROUP BY 1, 2""",
    "peak_usage": f"""WITH {DEFAULT}, h AS (SELECT {HOUR} AS hour, count(*) AS n,
  sum(coalesce(dur, 0.0)) AS total FROM lg WHERE kind = 'Statement' GROUP BY 1),
m AS (SELECT max(n) AS mn, max(total) AS mt, CAST(sum(n) AS BIGINT) // count(*) AS mean FROM h)
SELECT hour AS peak_hour, (SELECT hour FROM h ORDER BY n DESC, hour LIMIT 1) AS busiest_hour,
  mn AS max_queries_per_hour, round(mt, 6) AS max_duration_per_hour,
  mean AS average_queries_per_hour
FROM h, m WHERE n >= mn * 0.8::DOUBLE OR total >= mt * 0.8::DOUBLE""",
}
