"""Log files as numbered lines and entries.

Order inside a text scan is known without sorting: a split delivers its lines in
file order, and a split is named by (file, block start).  So positions come from
one small table with a row per split: how many lines it has and how many precede
it.  Lines themselves are never shuffled or sorted to be numbered.

Another scan may cut files into other splits, so places are written down with the
lines (or entries) by the scan that saw them, and numbers are worked out from what
was written.  A line whose split has no place is an error, never a lost row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from threading import RLock
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylens.operators.parse import parse_lines
from querylens.session import SPREAD_TASKS, broadcast_if_small, kept, running_rows, scratch_path, settled

SPLIT = ("source_window", "file", "block_start")
# Paths in a list file, and how many are looked up at once.
MAX_LISTED = 1_000_000
STATUS_THREADS = 32
# Opening a file costs about as much as reading this many bytes (Spark's own estimate): up to here a file is read whole.
HEAD_BYTES = 4 << 20
# Files read whole by one job and about how many by a task; longer files, each by a limit of its own, in one job;
# jobs at a time.
HEAD_FILES = 4096
TASK_FILES = 32
LIMITS = 2
HEAD_JOBS = 4
_splits_changed = RLock()
# What counts as a log file in a directory.
LOG_FILE_NAME = r"(?i)^(?:.+\.(?:log|txt)|\.?[^.]*(?:postgres|pg)[^.]*)$"


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def path_kind(spark: SparkSession, path: str) -> str:
    """'file', 'empty', 'directory' or 'missing'."""
    fs, hadoop_path = _filesystem(spark, path)
    if not fs.exists(hadoop_path):
        return "missing"
    status = fs.getFileStatus(hadoop_path)
    if status.isDirectory():
        return "directory"
    return "file" if status.getLen() > 0 else "empty"


def row_in_task() -> Column:
    # The low 33 bits of the id count the rows of one task; the rest is the task.
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def read_lines(
    spark: SparkSession, paths: str | Sequence[str], window: str = "target"
) -> DataFrame:
    """Raw lines with their split and their place in the reading task."""
    return (
        spark.read.option("lineSep", "\n")
        .text(paths if isinstance(paths, str) else list(paths))
        .select(
            F.lit(window).alias("source_window"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block_start"),
            "value",
            row_in_task().alias("_row"),
        )
    )


def directory_lines(spark: SparkSession, directory: str, window: str = "target") -> DataFrame:
    """Lines of the log files directly in a directory.

    Spark drops the other files from the scan by name before reading anything.
    """
    return (
        spark.read.option("lineSep", "\n")
        .text(directory)
        .where(F.col("_metadata.file_name").rlike(LOG_FILE_NAME))
        .select(
            F.lit(window).alias("source_window"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block_start"),
            "value",
            row_in_task().alias("_row"),
        )
    )


def listed_paths(spark: SparkSession, list_file: str) -> list[str]:
    """Distinct paths named in a list file; blank lines and # comments are skipped.

    The next scan takes its files as an argument, so the driver holds as many
    paths as it will plan splits for, and no list of more than MAX_LISTED.
    """
    text = F.btrim("value")
    rows = (
        spark.read.text(list_file)
        .select(text.alias("path"))
        .where((F.col("path") != "") & ~F.col("path").startswith("#"))
        .distinct()
        .limit(MAX_LISTED + 1)
        .collect()
    )
    if len(rows) > MAX_LISTED:
        raise ValueError(f"{list_file} names more than {MAX_LISTED} files; read their folder instead")
    return [row.path for row in rows]


def existing_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Distinct non-empty files among the paths, sorted; others are ignored.

    The file system is asked about many paths at a time.
    """
    distinct = sorted(set(paths), key=lambda p: p.split("/"))
    with ThreadPoolExecutor(STATUS_THREADS) as pool:
        kinds = pool.map(lambda p: path_kind(spark, p), distinct)
        return [p for p, kind in zip(distinct, kinds) if kind == "file"]


def file_lines(
    spark: SparkSession,
    files: Sequence[str] = (),
    list_file: str | None = None,
    directory: str | None = None,
    window: str = "target",
) -> DataFrame:
    """Lines of explicit files, of files named in a list, and of a directory."""
    if directory is not None and path_kind(spark, directory) != "directory":
        raise ValueError(f"Log directory does not exist or is not a directory: {directory}")
    named = list(files) + (listed_paths(spark, list_file) if list_file else [])
    named = existing_files(spark, named)
    if directory is not None:
        inside = directory_lines(spark, directory, window)
        folder = directory.rstrip("/")
        named = [
            p
            for p in named
            if p.rpartition("/")[0] != folder or not re.match(LOG_FILE_NAME, p.rpartition("/")[2])
        ]
        return inside.unionByName(read_lines(spark, named, window)) if named else inside
    if not named:
        raise ValueError("No log files found to process")
    return read_lines(spark, named, window)


def window_lines(spark: SparkSession, path: str, window: str) -> DataFrame:
    """Lines of one comparison window: a file or a directory."""
    kind = path_kind(spark, path)
    if kind == "missing":
        raise ValueError(f"Log path does not exist: {path}")
    if kind != "directory":
        return read_lines(spark, path, window)
    lines = directory_lines(spark, path, window)
    if lines.isEmpty():
        raise ValueError(f"No log files found under {path}")
    return lines


def _file_order() -> Column:
    """Path order component by component, on the decoded path."""
    return F.split(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), "/")


def split_table(rows: DataFrame, row: str = "_row", broken: Column | None = None) -> DataFrame:
    """One row per split: first place, rows before it in the file and in earlier files.

    Files with a broken row are left out.  Rows before a split are summed in two levels
    (``running_rows``), so no task holds the splits of a whole log; a window over one
    file's splits has a row per 128 MB of it.
    """
    broken = F.lit(False) if broken is None else broken
    splits = rows.groupBy(*SPLIT).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(row).alias("first_row"),
        F.max(broken.cast("int")).alias("broken"),
    )
    file = Window.partitionBy("source_window", "file")
    before = (Window.unboundedPreceding, -1)
    splits = splits.select(
        "*",
        F.max("broken").over(file).alias("file_broken"),
        F.sum("rows").over(file.orderBy("block_start").rowsBetween(*before)).alias("in_file"),
        _file_order().alias("file_order"),
    ).where(F.col("file_broken") == 0)
    placed = running_rows(splits, ("source_window",), ("file_order", "block_start"))
    before_split = F.coalesce("in_file", F.lit(0))
    return settled(
        placed.select(
            *SPLIT,
            "first_row",
            before_split.alias("before_split"),
            (F.col("in_log") - before_split).alias("before_file"),
        )
    )


@contextmanager
def _split_per_task(spark: SparkSession):
    """Plan scans with whole files (up to an exabyte) as splits, one split to a task.

    Tells whether the session took these settings.
    """
    ours = {
        "spark.sql.files.maxPartitionBytes": str(1 << 60),
        "spark.sql.files.openCostInBytes": str(1 << 60),
        "spark.sql.files.maxPartitionNum": None,
    }
    _splits_changed.acquire()
    before = {key: spark.conf.get(key, None) for key in ours}
    try:
        for key, value in ours.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
        yield all(spark.conf.get(key, None) == value for key, value in ours.items())
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
        _splits_changed.release()


def _united(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of frames as a tree of small depth: each union looks at all that is below it."""
    if len(frames) == 1:
        return frames[0]
    half = len(frames) // 2
    return _united(frames[:half]).union(_united(frames[half:]))


def _long_files(spark: SparkSession, names: Sequence[str]) -> list[str]:
    """Those of the files that are over HEAD_BYTES, by a listing of each folder."""

    def look(folder: str) -> list[str]:
        fs, hadoop_path = _filesystem(spark, unquote(folder))
        return [s.getPath().toString() for s in fs.listStatus(hadoop_path) if s.getLen() > HEAD_BYTES]

    with ThreadPoolExecutor(STATUS_THREADS) as pool:
        found = {path for paths in pool.map(look, {n.rpartition("/")[0] for n in names}) for path in paths}
    return [name for name in names if unquote(name) in found]


def landed_heads(lines: DataFrame, size: int) -> DataFrame:
    """The first ``size`` lines of every file of one window, written to the shared folder.

    Files of up to HEAD_BYTES are read to their end, a file to a split, and their later lines left
    out: one scan takes HEAD_FILES of them, by a range of names.  Each longer file has a limit of its
    own, and a limit stops its task.  So what is read of a file is bounded by HEAD_BYTES or by its head,
    and a plan has at most LIMITS scans, however many files there are: Spark keeps the plans of the last
    thousand executions on the driver.  Jobs run side by side and each has a folder of its own: the first
    to end clears the unfinished work in its folder.
    """
    if size <= 0:
        raise ValueError("Sample size must be greater than 0")
    spark = lines.sparkSession
    path = scratch_path(spark, "heads")
    # Without the row number the file's name prunes the scan; it is given anew behind
    # it, in the order of the file's one split.
    bare = lines.drop("_row")
    tasks = SPREAD_TASKS * spark.sparkContext.defaultParallelism

    def short_heads(first: int) -> DataFrame:
        # Open at both ends: whatever a file is called, it is in one range.
        mine = F.lit(True) if first == 0 else F.col("file") >= names[first]
        if first + HEAD_FILES < len(names):
            mine &= F.col("file") < names[first + HEAD_FILES]
        apart = [name for name in names[first : first + HEAD_FILES] if name in limited]
        rows = bare.where(mine & ~F.col("file").isin(apart) if apart else mine).withColumn("_row", row_in_task())
        return rows.where(F.col("_row") < size).coalesce(max(tasks, HEAD_FILES // TASK_FILES))

    def long_heads(some: Sequence[str]) -> DataFrame:
        heads = [bare.where(F.col("file") == name).limit(size) for name in some]
        return _united([head.withColumn("_row", row_in_task()) for head in heads])

    def land(job: int) -> str:
        first = job * HEAD_FILES
        some = long[(job - ranges) * LIMITS : (job - ranges + 1) * LIMITS]
        heads = short_heads(first) if job < ranges else long_heads(some)
        folder = f"{path}/{job:012d}"
        heads.select(*lines.columns).write.parquet(folder)
        return folder

    with _split_per_task(spark) as whole:
        # Spark lists files as file:///x and tells a row its file as file:/x.
        names = sorted({re.sub("^([a-z0-9]+):///", r"\1:/", name) for name in lines.inputFiles()})
        if not names:
            return lines.limit(0)
        # Where splits are not whole files, only a limit counts right.
        long = _long_files(spark, names) if whole else names
        limited = set(long)
        ranges = -(-len(names) // HEAD_FILES) if whole else 0
        with ThreadPoolExecutor(HEAD_JOBS) as pool:
            folders = list(pool.map(land, range(ranges + -(-len(long) // LIMITS))))
    return spark.read.schema(lines.schema).parquet(*folders)


def head_sample(lines: DataFrame, size: int | None) -> DataFrame:
    """First ``size`` lines of every file, counted before any parsing."""
    return lines if size is None else landed_heads(lines, size)


def placed(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """Lines with the places of their splits; a split without a place is an error."""
    marked = broadcast_if_small(splits.withColumn("_placed", F.lit(True)))
    joined = lines.join(marked, list(SPLIT), "left")
    place = F.when(F.col("_placed"), F.col("first_row")).otherwise(
        F.raise_error(F.concat(F.lit("no place for a split of "), F.col("file"))).cast("bigint")
    )
    return joined.withColumn("first_row", place).drop("_placed")


def _line_no() -> Column:
    return F.col("_row") - F.col("first_row") + F.col("before_split")


def numbered_lines(lines: DataFrame, landed: bool = False) -> DataFrame:
    """Lines with ``line_no`` (0-based in the file) and ``position`` (over all files).

    ``landed``: the lines are read from a table that holds their places, such as a
    head sample; others are written to one first.
    """
    lines = lines if landed else kept(lines, "lines")
    line_no = _line_no()
    return placed(lines, split_table(lines)).select(
        "source_window",
        "file",
        "value",
        line_no.alias("line_no"),
        (line_no + F.col("before_file")).alias("position"),
    )


def log_entries(
    lines: DataFrame,
    log_format: str = "auto",
    sample_size: int | None = None,
    on_bad_file: str = "skip",
    kind: str | None = None,
    in_order: bool = True,
) -> DataFrame:
    """Entries of all files in path order, numbered by ``record_index``.

    Text is read and parsed once, into Parquet in the shared folder; numbering
    and every later pass read the columns they need from there.  A line whose timestamp is no calendar date spoils its file: the file is
    skipped, or with ``on_bad_file='fail'`` the whole read is refused.
    """
    if on_bad_file not in ("skip", "fail"):
        raise ValueError(f"unknown policy for bad files: {on_bad_file}")
    entries = parse_lines(head_sample(lines, sample_size), log_format, kind)
    if in_order and sample_size is None:
        place = row_in_task()
    else:
        place = F.row_number().over(Window.partitionBy(*SPLIT).orderBy("_row")).cast("bigint")
    entries = kept(entries.withColumn("_entry", place).drop("_row"), "entries")
    broken = F.col("ts").isNull()
    if on_bad_file == "fail":
        bad = bad_files(entries).take(1)
        if bad:
            raise ValueError(f"Failed to parse {bad[0].bad_lines} lines in {bad[0].file}")
    table = split_table(entries, "_entry", broken)
    record_index = (
        F.col("_entry") - F.col("first_row") + F.col("before_split") + F.col("before_file")
    )
    # Files with a broken line have no place and are left out here.
    return entries.join(broadcast_if_small(table), list(SPLIT)).select(
        record_index.alias("record_index"),
        *[c for c in entries.columns if c not in ("_entry", "block_start")],
    )


def bad_files(entries: DataFrame) -> DataFrame:
    """Files holding lines with an impossible timestamp, and how many."""
    return (
        entries.where(F.col("ts").isNull())
        .groupBy("source_window", "file")
        .agg(F.count(F.lit(1)).alias("bad_lines"))
    )
