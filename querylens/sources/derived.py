"""A PostgreSQL log rendered from the ``events`` table.

Each row becomes one log line, so the registered queries exercise parsing and
pairing on data whose answers can also be computed from the columns.  The row's
``event_id`` (0, 1, 2, ... in time order) is its place in the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.session import scratch_path, spread

FORMS = 29
TARGET_START = "2024-01-16 00:00:00"


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    )


def line_count(spark: SparkSession, sf_dir: str) -> int:
    """Lines of the log, from the row counts in the Parquet footers."""
    return events_table(spark, sf_dir).count()


def _k() -> Column:
    return F.regexp_extract("props", r"\d+", 0)


def _value() -> Column:
    return F.format_string("%.3f", F.col("value"))


def message(value: Column | None = None) -> Column:
    k, v, user = _k(), _value() if value is None else value, F.col("user_id").cast("string")
    kind = F.col("event_type")
    text = F.concat
    lit = F.lit
    return (
        F.when(kind == "view", text(lit("LOG:  statement: SELECT * FROM items WHERE id = "), k))
        .when(
            kind == "signup",
            text(lit("LOG:  statement: INSERT INTO users (id, score) VALUES ("), user, lit(", "),
                 v, lit(")")),
        )
        .when(
            kind == "purchase",
            text(lit("LOG:  duration: "), v, lit(" ms  statement: UPDATE orders SET total = "), v,
                 lit(" WHERE id = "), k),
        )
        .when(kind == "click", text(lit("LOG:  duration: "), v, lit(" ms")))
        .when(
            k.cast("int") % 2 == 0, text(lit("ERROR:  connection lost to shard "), k)
        )
        .otherwise(text(lit("LOG:  connection received: host=10.0.0."), k))
    )


# Hours of day in which the busy log's durations are longer still.
BUSY_HOURS, BUSY_FACTOR, FACTOR = (9, 10), 16, 4


def busy_message() -> Column:
    """The message with longer durations, longest in BUSY_HOURS."""
    factor = F.when(F.hour("ts").isin(*BUSY_HOURS), F.lit(BUSY_FACTOR)).otherwise(F.lit(FACTOR))
    return message(F.format_string("%.3f", F.col("value") * factor))


def varied_statement() -> Column:
    """One of ``FORMS`` statement forms, chosen by the row's ``k``."""
    k, v = _k(), _value()
    form = k.cast("int") % FORMS
    lit, text = F.lit, F.concat
    forms = [
        text(lit("SELECT   *   FROM items   WHERE id="), k),
        text(lit("select name from users where name = 'user "), k, lit("' and active = true")),
        text(lit("INSERT INTO users (id, score) VALUES ("), k, lit(", "), v, lit(");")),
        text(lit("UPDATE orders SET note = NULL, total = "), v, lit(" WHERE id IN ("), k,
             lit(", $1)")),
        text(lit("DELETE FROM carts WHERE note IS NULL AND id = "), k),
        text(lit("CREATE TABLE t_"), k, lit(" (id INT)")),
        text(lit("DROP TABLE t_"), k),
        text(lit("ALTER TABLE t ADD COLUMN c_"), k, lit(" INT")),
        lit("TRUNCATE audit"),
        text(lit("GRANT SELECT ON items TO u"), k),
        lit("BEGIN"),
        lit("COMMIT;"),
        text(lit("WITH x AS (SELECT "), k, lit(") SELECT * FROM x")),
        text(lit("SELECT count(*) FROM items; DELETE FROM items WHERE id = "), k),
        text(lit("EXPLAIN SELECT "), k),
        text(lit("SELECT 'a;b' AS s, o.total FROM orders o WHERE o.id = "), k),
        text(lit("SELECT a::int FROM t WHERE note = E'it\\'s' AND id = "), k),
        text(lit("SELECT /* a /* b */ c */ id FROM t WHERE id = "), k),
        text(lit("SELECT $$x y$$ AS s, "), k),
        text(lit("SELECT X'1F' AS b FROM t WHERE id = "), k, lit(" -- done")),
        text(lit("SELECT total FROM orders WHERE id = "), k, lit(" FOR UPDATE")),
        text(lit("select total from orders where id = "), k, lit(" for no key update;")),
        lit("INSERT INTO audit DEFAULT VALUES"),
        text(lit("/* page "), k, lit(" */ SELECT stock FROM shelves WHERE id = "), k),
        text(lit("/* job */ UPDATE orders SET total = "), v, lit(" WHERE id = "), k),
        lit("VACUUM FULL items"),
        lit("SET enable_seqscan = ON"),
        text(lit("SELECT total FROM orders WHERE id IN ("), k, lit(",")),
        text(lit("UPDATE orders SET total = "), v, lit(" WHERE")),
    ]
    picked = F.when(form == 0, forms[0])
    for i, one in enumerate(forms[1:], start=1):
        picked = picked.when(form == i, one)
    return picked


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, form, sql): a statement of varied form for every event."""
    return spread(events_table(spark, sf_dir), "event_id").select(
        "event_id",
        "user_id",
        "ts",
        "value",
        (_k().cast("int") % FORMS).alias("form"),
        varied_statement().alias("sql"),
    )


def truncated_message() -> Column:
    """A statement whose first line ends early for every third ``k``."""
    k = _k()
    return F.concat(
        F.lit("LOG:  statement: SELECT total FROM orders WHERE id = "),
        F.when(k.cast("int") % 3 == 0, "").otherwise(k),
    )


def _default_prefix(process: Column | None = None) -> Column:
    user = F.col("user_id")
    return F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" UTC ["),
        user.cast("string") if process is None else process,
        F.lit("] u"), (user % 5).cast("string"), F.lit("@db"), (user % 3).cast("string"),
        F.lit(" app"), (user % 4).cast("string"), F.lit(": "),
    )


def _rds_prefix() -> Column:
    user = F.col("user_id")
    return F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC:10.1.0."),
        (user % 250).cast("string"), F.lit("("), (user + 40000).cast("string"), F.lit("):u"),
        (user % 5).cast("string"), F.lit("@db"), (user % 3).cast("string"), F.lit(":["),
        user.cast("string"), F.lit("]:"),
    )


def line(style: str = "default", body: Column | None = None) -> Column:
    prefix = _default_prefix() if style == "default" else _rds_prefix()
    return F.concat(prefix, message() if body is None else body)


def log_lines(
    spark: SparkSession, sf_dir: str, style: str = "default", body: Column | None = None
) -> DataFrame:
    """Lines of one window holding the whole table."""
    return spread(events_table(spark, sf_dir), "event_id").select(
        F.lit("target").alias("source_window"),
        F.col("event_id").alias("record_index"),
        line(style, body).alias("value"),
    )


def bursty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with one backend that has the first record and, after a silence, the last third of all."""
    late = line_count(spark, sf_dir) * 2 // 3
    process = F.when((F.col("event_id") == 0) | (F.col("event_id") >= late), "0").otherwise(F.col("user_id").cast("string"))
    return custom_lines(spark, sf_dir, F.concat(_default_prefix(process), message()))


def window_of_time() -> Column:
    return F.when(F.col("ts") < F.lit(TARGET_START).cast("timestamp_ntz"), "baseline").otherwise("target")


def window_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows: where in the whole log each window starts."""
    rows = events_table(spark, sf_dir).withColumn("source_window", window_of_time())
    return rows.groupBy("source_window").agg(F.min("event_id").alias("start"))


def two_window_lines(spark: SparkSession, sf_dir: str, style: str = "default") -> DataFrame:
    """Baseline (before 16 January 2024) and target lines, each counted from 0."""
    rows = events_table(spark, sf_dir).withColumn("source_window", window_of_time())
    return spread(rows, "event_id").join(F.broadcast(window_starts(spark, sf_dir)), "source_window").select(
        "source_window",
        (F.col("event_id") - F.col("start")).alias("record_index"),
        line(style).alias("value"),
    )


def varied_message() -> Column:
    """Message shapes the parser tells apart, chosen by the row's ``k``."""
    k, v = _k(), _value()
    form = k.cast("int") % 10
    lit, text = F.lit, F.concat
    sql = text(lit("SELECT total FROM orders WHERE id = "), k)
    forms = [
        text(lit("LOG:  duration: "), v, lit(" ms  statement: "), sql),
        text(lit("LOG:  duration: "), v, lit(" ms  execute <unnamed>: "), sql),
        text(lit("LOG:  statement: "), sql),
        text(lit("LOG:  execute fetch_"), k, lit(": "), sql),
        text(lit("LOG:  duration: "), v, lit(" ms")),
        text(lit("LOG:  duration: "), v, lit(" ms  parse <unnamed>: "), sql),
        lit("LOG:  duration: 1.2.3 ms"),
        text(lit("LOG:  duration: 1.2.3 ms  statement: "), sql),
        text(lit("STATEMENT:  "), sql),
        text(lit("duration:  slot "), k),
    ]
    picked = F.when(form == 0, forms[0])
    for i, one in enumerate(forms[1:], start=1):
        picked = picked.when(form == i, one)
    return picked


# Level words as servers print them, known and unknown.
LEVEL_WORDS = ("ERROR", "warning", "INFO", "Debug", "NOTICE", "LOG", "FATAL", "PANIC", "HINT",
               "detail")


def levelled_message() -> Column:
    words = F.array(*[F.lit(w) for w in LEVEL_WORDS])
    return F.concat(
        F.get(words, _k().cast("int") % len(LEVEL_WORDS)), F.lit(":  message "), _k()
    )


def odd_metadata_line() -> Column:
    """Default prefix whose user, database or application is a placeholder."""
    user = F.col("user_id")
    return F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" UTC ["), user.cast("string"),
        F.lit("] "), F.when(user % 5 == 0, "[unknown]").otherwise(F.concat(F.lit("u"), (user % 5).cast("string"))),
        F.lit("@"), F.when(user % 3 == 0, "-").otherwise(F.concat(F.lit("db"), (user % 3).cast("string"))),
        F.lit(" "), F.when(user % 4 == 0, " ").otherwise(F.concat(F.lit("app "), (user % 4).cast("string"), F.lit(" "))),
        F.lit(": "), message(),
    )


def odd_host_line() -> Column:
    """RDS prefix with hosts with and without port, and placeholders."""
    user, form = F.col("user_id"), F.col("event_id") % 6
    name = F.concat(F.lit("host-"), user.cast("string"))
    host = (
        F.when(form == 0, F.concat(name, F.lit("(5432)")))
        .when(form == 1, name)
        .when(form == 2, "[unknown]")
        .when(form == 3, "-")
        .when(form == 4, F.concat(name, F.lit("(a)(b)")))
        .otherwise("(5432)")
    )
    return F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC:"), host, F.lit(":u"),
        (user % 5).cast("string"), F.lit("@db"), (user % 3).cast("string"), F.lit(":["),
        user.cast("string"), F.lit("]:"), message(),
    )


def custom_lines(spark: SparkSession, sf_dir: str, value: Column) -> DataFrame:
    return spread(events_table(spark, sf_dir), "event_id").select(
        F.lit("target").alias("source_window"),
        F.col("event_id").alias("record_index"),
        value.alias("value"),
    )


def noisy_line() -> Column:
    """The line, and for every tenth ``k`` a continuation line and a blank line."""
    return F.concat(
        line(), F.when(_k().cast("int") % 10 == 0, "\n    -- continued\n").otherwise("")
    )


def padded_line() -> Column:
    """The line between blanks that only a Unicode trim removes."""
    return F.concat(
        F.when(_k().cast("int") % 7 == 0, "\u00a0\t ").otherwise(""),
        line(),
        F.when(_k().cast("int") % 3 == 0, " \r").otherwise(""),
    )


# Lines of one file, at every size.
ROWS_PER_FILE = 2_500


def file_name(number: int) -> str:
    kind = number % 4
    stem = f"{number:06d}"
    return (f"pg_{stem}.log", f"pg_{stem}.TXT", f"postgres_{stem}", f"audit_{stem}.csv")[kind]


_written: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, write) -> str:
    """Write an export once per application and remember where."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _written:
        path = scratch_path(spark, what)
        write(path)
        _written[key] = path
    return _written[key]


def log_directory(spark: SparkSession, sf_dir: str) -> str:
    """Folder of log files cut from the noisy log by ``event_id`` range.

    Names cover what a directory scan must accept and refuse.
    """

    def write(path: str) -> None:
        number = F.expr(f"event_id div {ROWS_PER_FILE}")
        (
            events_table(spark, sf_dir)
            .select(number.alias("number"), "event_id", noisy_line().alias("value"))
            .repartition("number")
            .sortWithinPartitions("number", "event_id")
            .select("number", "value")
            .write.partitionBy("number")
            .text(f"{path}/parts")
        )
        jvm = spark.sparkContext._jvm
        to_path = jvm.org.apache.hadoop.fs.Path
        fs = to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(to_path(f"{path}/logs"))
        for part in fs.globStatus(to_path(f"{path}/parts/number=*/part-*")):
            old = part.getPath()
            number = int(old.getParent().getName().split("=")[1])
            if not fs.rename(old, to_path(f"{path}/logs/{file_name(number)}")):
                raise OSError(f"{old} could not be renamed: a second file for number {number}?")

    return _once(spark, sf_dir, "log-directory", write) + "/logs"


def joined(spark: SparkSession, folder: str, path: str) -> None:
    """Make one file of the text parts in a folder, in order of their names.

    The file system joins them (``concat``), so that no task writes the whole file: HDFS links blocks, a local disk
    copies. File systems that cannot join are refused.
    """
    context = spark.sparkContext
    to_path = context._jvm.org.apache.hadoop.fs.Path
    fs = to_path(folder).getFileSystem(context._jsc.hadoopConfiguration())
    parts = sorted((part.getPath() for part in fs.globStatus(to_path(f"{folder}/part-*"))), key=lambda p: p.getName())
    if fs.getScheme() == "file":
        # Behind the checksums; here all parts go into a new file.
        fs = fs.getRawFileSystem()
    else:
        first, *parts = parts
        if not fs.rename(first, to_path(path)):
            raise OSError(f"{first} could not be renamed")
    if parts:
        listed = context._gateway.new_array(to_path, len(parts))
        for i, part in enumerate(parts):
            listed[i] = part
        fs.concat(to_path(path), listed)


def window_paths(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The two windows of ``two_window_lines`` as a folder of files and as one file."""

    def write(path: str) -> None:
        lines = two_window_lines(spark, sf_dir)
        baseline = lines.where("source_window = 'baseline'")
        number = F.expr(f"record_index div {ROWS_PER_FILE}")
        (
            baseline.select(number.alias("number"), "record_index", "value")
            .repartitionByRange("number")
            .sortWithinPartitions("number", "record_index")
            .select("number", "value")
            .write.partitionBy("number")
            .text(f"{path}/parts")
        )
        target = lines.where("source_window = 'target'").select("record_index", "value")
        pieces = target.repartitionByRange("record_index").sortWithinPartitions("record_index")
        pieces.select("value").write.text(f"{path}/pieces")
        jvm = spark.sparkContext._jvm
        to_path = jvm.org.apache.hadoop.fs.Path
        fs = to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(to_path(f"{path}/baseline"))
        for part in fs.globStatus(to_path(f"{path}/parts/number=*/part-*")):
            old = part.getPath()
            new = f"{path}/baseline/pg_{int(old.getParent().getName().split('=')[1]):06d}.log"
            if not fs.rename(old, to_path(new)):
                raise OSError(f"{old} could not be renamed")
        # One file is what this window is about.
        joined(spark, f"{path}/pieces", f"{path}/target.log")

    path = _once(spark, sf_dir, "windows", write)
    return f"{path}/baseline", f"{path}/target.log"


EVENTS_PER_PAGE = 1000


def response_directory(spark: SparkSession, sf_dir: str) -> str:
    """Exported responses, one JSON document per line, pages in file order.

    Every 25th ``k`` is followed by an event without a message.
    """

    def write(path: str) -> None:
        event = F.struct(
            F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
            rds_noisy_line().alias("message"),
        )
        empty = F.struct(
            F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
            F.lit(None).cast("string").alias("message"),
        )
        slots = F.array(
            F.struct(F.lit(0).alias("slot"), event.alias("event")),
            F.when(_k().cast("int") % 25 == 0, F.struct(F.lit(1).alias("slot"), empty.alias("event"))),
        )
        pages = (
            events_table(spark, sf_dir)
            .select(
                F.expr(f"event_id div {EVENTS_PER_PAGE}").alias("page"),
                "event_id",
                F.inline(F.array_compact(slots)),
            )
            # At most two slots for each of the page's EVENTS_PER_PAGE rows.
            .groupBy("page")
            .agg(F.array_sort(F.collect_list(F.struct("event_id", "slot", "event"))).alias("rows"))
        )
        document = F.to_json(
            F.struct(
                F.transform("rows", lambda r: r["event"]).alias("events"),
                F.concat(F.lit("token-"), F.col("page").cast("string")).alias("nextToken"),
            ),
            {"ignoreNullFields": "false"},
        )
        (
            pages.repartitionByRange("page")
            .sortWithinPartitions("page")
            .select(document.alias("value"))
            .write.text(path)
        )

    return _once(spark, sf_dir, "responses", write)


def rds_noisy_line() -> Column:
    return F.concat(
        line("rds"), F.when(_k().cast("int") % 10 == 0, "\n    -- continued\n").otherwise("")
    )
