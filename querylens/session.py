"""Session settings and the shared scratch space that multi-pass jobs write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

# Largest side table handed to ``broadcast``; anything beyond either bound is
# left to a shuffled join.
MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 256 * 1024 * 1024
# Rows of a result limited by an argument that are broadcast unmeasured.
BOUNDED_ROWS = 10_000
# Tasks per core that a source of few splits is dealt out to.
SPREAD_TASKS = 3


def local_session(cpus: str = "8", name: str = "querylens") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Small logs: keep all cores busy after a shuffle.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.driver.memory", "8g")
        # Recording the call site of every Column call doubles plan building time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    A local master, where driver and executors are one process, may go without
    and gets a temporary folder; on a cluster that would scatter the data.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if not context.getCheckpointDir():
            context.setCheckpointDir(folder)
        return folder
    if not context.getCheckpointDir():
        if not is_local(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def drop_scratch(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a ``kept`` table that nothing reads any more."""
    folder = shared_dir(spark).rstrip("/").removeprefix("file:")
    for path in {name.rpartition("/")[0] for name in df.inputFiles()}:
        if folder in path:
            hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            conf = spark.sparkContext._jsc.hadoopConfiguration()
            hadoop_path.getFileSystem(conf).delete(hadoop_path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared folder.

    Used for small side tables (one row per input split, per hot backend, per
    finding) that later stages read several times, so that losing an executor
    never re-runs the pass over the log that produced them.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write a large intermediate to Parquet in the shared folder and read it back.

    Later passes then read only the columns they need and never repeat the work
    that produced it, also when executors are lost.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame) -> bool:
    """Whether a settled table is within the broadcast bounds, by measuring it."""
    text = sum(
        (F.coalesce(F.octet_length(n), F.lit(0)) for n, kind in df.dtypes if kind == "string"),
        F.lit(16 * len(df.columns)),
    )
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(text).alias("bytes")).first()
    return size.rows <= MAX_BROADCAST_ROWS and (size.bytes or 0) <= MAX_BROADCAST_BYTES


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast a settled side table when its measured size allows it."""
    return F.broadcast(df) if fits_broadcast(df) else df


def measured(df: DataFrame) -> DataFrame:
    """Settle a side table, and mark it for broadcast if its measure allows; rows and bytes are counted on the way."""
    shared_dir(df.sparkSession)
    text = sum(
        (F.coalesce(F.octet_length(n), F.lit(0)) for n, kind in df.dtypes if kind == "string"),
        F.lit(16 * len(df.columns)),
    )
    seen = Observation()
    size = (F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(text), F.lit(0)).alias("bytes"))
    settled_df = df.observe(seen, *size).checkpoint(eager=True)
    small = seen.get["rows"] <= MAX_BROADCAST_ROWS and seen.get["bytes"] <= MAX_BROADCAST_BYTES
    return F.broadcast(settled_df) if small else settled_df


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a settled table of at most ``rows`` rows; a bound too large to go by is measured."""
    return F.broadcast(df) if rows <= BOUNDED_ROWS else broadcast_if_small(df)


def running_rows(counted: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Add ``in_log``: the sum of ``rows`` over what comes before, per key, however many rows there are.

    Ranges of the order are summed first; the sums of earlier ranges (one row per key and range) are added to the
    running sum inside each range.
    """
    ranges = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written down once: where ranges begin is drawn from a sample.
    dealt = settled(counted.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()))
    before = (Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(*before)
    sums = dealt.groupBy(*keys, "_range").agg(F.sum("rows").alias("rows"))
    sums = sums.select(*keys, "_range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(*before)
    here = F.coalesce(F.sum("rows").over(inside), F.lit(0))
    return dealt.join(broadcast_if_small(settled(sums)), [*keys, "_range"]).withColumn(
        "in_log", here + F.col("_earlier")
    ).drop("_range", "_earlier")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a source's rows out by ``key`` when it comes in few splits.

    Parsing is CPU work. A small or unsplittable file would keep it on one core, and splits of a file with large
    row groups are uneven, many of them empty, which shows only when they are read.  A source with many splits is
    left as it is.
    """
    tasks = SPREAD_TASKS * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, key) if df.rdd.getNumPartitions() < tasks else df


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that no optimizer rule can copy their expressions.

    Filters move below projections, and joins add IS NOT NULL filters on their
    keys, by substituting the projected expression.  Nothing is substituted
    through a generator, so the columns leave through one.
    """
    fields = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(fields)))


def beside(first: DataFrame, *single_rows: DataFrame) -> DataFrame:
    """``first`` with the columns of one-row frames, as scalar subqueries."""
    for i, other in enumerate(single_rows):
        row = other.select(F.struct(*other.columns)).scalar()
        first = first.select("*", row.alias(f"_row{i}")).select(
            *first.columns, f"_row{i}.*"
        )
    return first
