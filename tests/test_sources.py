from __future__ import annotations

import gzip
import json
from contextlib import nullcontext
from datetime import datetime, timezone
from urllib.parse import unquote

import pytest
from log_samples import RDS_LOG, SAMPLE_LOG
from pyspark.sql import functions as F

from querylens.plans.investigate import top_families
from querylens.sources import cloudwatch, derived, files


def write(folder, **contents):
    for name, text in contents.items():
        (folder / name.replace("__", ".")).write_bytes(text.encode())
    return str(folder)


def names(lines):
    return sorted({r.file.rsplit("/", 1)[-1] for r in lines.select("file").distinct().collect()})


def test_directory_scan(spark, tmp_path):
    (tmp_path / "sub.log").mkdir()
    (tmp_path / "sub.log" / "inner.log").write_text(SAMPLE_LOG)
    folder = write(
        tmp_path, a__log=SAMPLE_LOG, b__TXT=SAMPLE_LOG, c__csv=SAMPLE_LOG, Postgres=SAMPLE_LOG,
        my_pg_1=SAMPLE_LOG, other=SAMPLE_LOG, pg__old=SAMPLE_LOG, d__log__gz1=SAMPLE_LOG,
    )
    assert names(files.directory_lines(spark, folder)) == ["Postgres", "a.log", "b.TXT", "my_pg_1"]


def test_explicit_files_and_list(spark, tmp_path):
    folder = write(tmp_path, a__log=SAMPLE_LOG, b__any=SAMPLE_LOG, empty__log="")
    (tmp_path / "list").write_text(
        f"# files\n\n  {folder}/b.any\n{folder}/a.log\n{folder}/gone.log\n{folder}/empty.log\n"
    )
    lines = files.file_lines(spark, [f"{folder}/a.log", folder], f"{folder}/list")
    assert names(lines) == ["a.log", "b.any"] and lines.count() == 18
    both = files.file_lines(spark, [f"{folder}/b.any", f"{folder}/a.log"], directory=folder)
    assert names(both) == ["a.log", "b.any"] and both.count() == 18
    with pytest.raises(ValueError, match="No log files"):
        files.file_lines(spark, [f"{folder}/gone.log"])
    with pytest.raises(ValueError, match="not a directory"):
        files.file_lines(spark, directory=f"{folder}/a.log")


def big_log(entries, start=0):
    out = []
    for i in range(start, start + entries):
        out.append(f"2024-01-15 10:00:00.000 UTC [{i}] a@d p: LOG:  message {i}")
        if i % 3 == 0:
            out.append("    continued")
    return "\n".join(out) + "\n"


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_record_index_over_splits_and_files(spark, tmp_path, small_splits):
    folder = write(
        tmp_path, a__log=big_log(700), b__log=big_log(5, 700), c__log=big_log(900, 705)
    )
    lines = files.directory_lines(spark, folder)
    assert lines.select("file", "block_start").distinct().count() > 10
    rows = files.log_entries(lines).orderBy("record_index").collect()
    assert [r.record_index for r in rows] == list(range(1605))
    assert [int(r.process_id) for r in rows] == list(range(1605))
    numbered = files.numbered_lines(lines).where("file LIKE '%a.log'").orderBy("line_no").collect()
    assert [r.line_no for r in numbered] == list(range(len(numbered)))
    assert [r.value for r in numbered] == big_log(700).split("\n")[:-1]


@pytest.mark.parametrize("later", ["4096", "5000", "1000000"])
def test_another_split_size_loses_nothing(spark, tmp_path, later):
    folder = write(
        tmp_path, a__log=big_log(700), b__log=big_log(5, 700), c__log=big_log(900, 705)
    )
    lines = files.directory_lines(spark, folder)
    every = sum(len(big_log(n, s).split("\n")) - 1 for n, s in ((700, 0), (5, 700), (900, 705)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        numbered, sample = files.numbered_lines(lines), files.head_sample(lines, 400)
        entries, picked = files.log_entries(lines), files.numbered_lines(sample, landed=True)
        spark.conf.set("spark.sql.files.maxPartitionBytes", later)
        places = sorted(r.position for r in numbered.select("position").collect())
        assert places == list(range(every))
        assert sorted(r.record_index for r in entries.collect()) == list(range(1605))
        assert sample.count() == picked.count() == 400 + 6 + 400
        assert sorted(r.line_no for r in picked.where("file LIKE '%c.log'").collect()) == list(range(400))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_sample_reads_heads_only(spark, tmp_path):
    folder = write(tmp_path, a__log=big_log(5_000) * 200)
    before = {s.stageId() for s in stages(spark)}
    assert files.head_sample(files.directory_lines(spark, folder), 50).count() == 50
    read = sum(s.inputBytes() for s in stages(spark) if s.stageId() not in before)
    assert read < (tmp_path / "a.log").stat().st_size / 4


def test_heads_of_many_files(spark, tmp_path, monkeypatch):
    """Several jobs, and still no file is read beyond its head."""
    monkeypatch.setattr(files, "HEAD_FILES", 8)
    rows = {f"f{i:02d}__log": big_log(3_000 + i) for i in range(20)}
    folder = write(tmp_path, **rows, big__log=big_log(5_000) * 200)
    lines = files.directory_lines(spark, folder)
    before = {s.stageId() for s in stages(spark)}
    heads = files.head_sample(lines, 5)
    read = sum(s.inputBytes() for s in stages(spark) if s.stageId() not in before)
    assert read < sum(p.stat().st_size for p in tmp_path.iterdir()) / 4
    numbered = files.numbered_lines(heads, landed=True).collect()
    assert len(numbered) == 5 * 21 and {r.line_no for r in numbered} == set(range(5))
    for name in ("f00.log", "f13.log", "big.log"):
        mine = sorted((r.line_no, r.value) for r in numbered if r.file.endswith(name))
        assert [v for _, v in mine] == (tmp_path / name).read_text().split("\n")[:5]


def test_head_jobs_do_not_share_a_folder(spark, tmp_path, monkeypatch):
    """Jobs that append to one folder at a time remove each other's unfinished work."""
    monkeypatch.setattr(files, "HEAD_FILES", 2)
    bodies = {f"f{i:02d}.log": b"%d \xff\xfe first\nsecond\n%d third" % (i, i) for i in range(40)}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    (tmp_path / "none.log").write_bytes(b"")
    lines = files.directory_lines(spark, str(tmp_path))
    heads = files.head_sample(lines, 2)
    assert len({f.rpartition("/")[0] for f in heads.inputFiles()}) >= 20
    first_two = lines.where("value NOT LIKE '%third'")
    columns = ("file", "hex(value)")
    assert sorted(heads.selectExpr(*columns).collect()) == sorted(first_two.selectExpr(*columns).collect())
    numbered = files.numbered_lines(heads, landed=True)
    assert sorted(r.line_no for r in numbered.collect()) == [0] * 40 + [1] * 40
    assert numbered.where("line_no = 1 AND value <> 'second'").count() == 0


def test_plans_of_heads_do_not_grow_with_files(spark, tmp_path):
    """The driver keeps every scan of a plan in memory."""
    folder = write(tmp_path, **{f"f{i:03d}__log": big_log(9, i) for i in range(120)})
    lines = files.directory_lines(spark, folder)
    before = {s.stageId() for s in stages(spark)}
    heads = files.head_sample(lines, 5)
    assert max(s.rddIds().size() for s in stages(spark) if s.stageId() not in before) < 60
    numbered = files.numbered_lines(heads, landed=True).collect()
    assert sorted(r.line_no for r in numbered) == sorted([*range(5)] * 120)


@pytest.mark.parametrize("whole", [True, False])
def test_heads_of_short_and_long_files(spark, tmp_path, monkeypatch, whole):
    """Short files in ranges of names, long ones by limits; all by limits where splits are not whole files."""
    if not whole:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        monkeypatch.setattr(files, "_split_per_task", lambda _: nullcontext(False))
    monkeypatch.setattr(files, "HEAD_FILES", 4)
    monkeypatch.setattr(files, "HEAD_BYTES", 2_000)
    monkeypatch.setattr(files, "LIMITS", 3)
    sizes = {f"{stem}{n:05d}.log": n for stem in ("a", "b c+", "d%20", "\u00e9", "~") for n in (1, 3, 7, 40, 500)}
    for name, n in sizes.items():
        (tmp_path / name).write_text(big_log(n), encoding="utf-8")
    (tmp_path / "none.log").write_text("")
    (tmp_path / "zip.log.gz").write_bytes(gzip.compress(big_log(500).encode()))
    lines = files.read_lines(spark, str(tmp_path)).where("value NOT LIKE '%message 2'")
    limits = []
    union = files._united
    monkeypatch.setattr(files, "_united", lambda frames: limits.append(len(frames)) or union(frames))
    try:
        heads = files.head_sample(lines, 8)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for row in files.numbered_lines(heads, landed=True).collect():
        got.setdefault(unquote(row.file).rpartition("/")[2], {})[row.line_no] = row.value
    want = {}
    for name, n in (*sizes.items(), ("zip.log.gz", 500)):
        every = [v for v in big_log(n).split("\n")[:-1] if not v.endswith("message 2")]
        want[name] = dict(enumerate(every[:8]))
    assert got == want
    assert max(limits) <= 3 and (sum(limits) >= 27 if not whole else limits)


@pytest.mark.parametrize("ranges", ["1", "3", "8"])
def test_running_rows_of_two_levels(spark, ranges):
    import random

    from querylens.session import running_rows

    rng = random.Random(1)
    rows = [(w, [rng.choice("abc"), str(i % 7)], i, rng.randint(0, 5)) for w in ("x", "y") for i in range(200)]
    df = spark.createDataFrame(rows, "w string, path array<string>, at bigint, rows bigint").repartition(5)
    default = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = {(r.w, r["at"]): r.in_log for r in running_rows(df, ("w",), ("path", "at")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", default)
    for w in ("x", "y"):
        total = 0
        for _, _, at, n in sorted(r for r in rows if r[0] == w):
            assert got[w, at] == total
            total += n


def stages(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]


def test_a_line_without_a_place_is_an_error(spark, tmp_path):
    lines = files.directory_lines(spark, write(tmp_path, a__log=big_log(10)))
    with pytest.raises(Exception, match="no place for a split"):
        files.placed(lines, files.split_table(lines).limit(0)).collect()


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from querylens.session import is_local, shared_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    assert is_local("local[8]") and not is_local("local-cluster[2,1,1024]") and not is_local("yarn")


def test_finished_scratch_can_be_dropped(spark):
    from querylens.session import drop_scratch, kept

    table = kept(spark.range(10).toDF("x"), "gone")
    (folder,) = {f.rpartition("/")[0].removeprefix("file://") for f in table.inputFiles()}
    drop_scratch(spark, table)
    import os

    assert not os.path.exists(folder)


def test_paths_order_by_component(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a-b").mkdir()
    (tmp_path / "a" / "x y+z.log").write_text(big_log(2))
    (tmp_path / "a-b" / "x.log").write_text(big_log(2, 2))
    lines = files.file_lines(
        spark, [str(tmp_path / "a-b" / "x.log"), str(tmp_path / "a" / "x y+z.log")]
    )
    rows = files.log_entries(lines).orderBy("record_index").collect()
    assert [int(r.process_id) for r in rows] == [0, 1, 2, 3]


def test_head_sample_counts_lines(spark, tmp_path, small_splits):
    folder = write(tmp_path, a__log=big_log(700), b__log=big_log(3))
    lines = files.directory_lines(spark, folder)
    assert files.head_sample(lines, 5).count() == 4 + 5 - 0
    kept = files.log_entries(lines, sample_size=400).orderBy("record_index").collect()
    assert [r.record_index for r in kept] == list(range(len(kept)))
    assert [int(r.process_id) for r in kept] == list(range(300)) + [0, 1, 2]
    with pytest.raises(ValueError, match="greater than 0"):
        files.head_sample(lines, 0)


def test_sample_leaves_a_statement_unpaired(spark, tmp_path):
    folder = write(tmp_path, a__log=SAMPLE_LOG)
    entries = files.log_entries(files.directory_lines(spark, folder), sample_size=5)
    rows = {r.query_family.application_name: r for r in top_families(entries).collect()}
    assert rows["jobs"].confidence == "low" and rows["web"].confidence == "high"


def test_bad_timestamp_spoils_its_file(spark, tmp_path):
    bad = SAMPLE_LOG.replace("2025-03-02 07:15:32.009", "2025-03-42 07:15:32.009")
    folder = write(tmp_path, a__log=SAMPLE_LOG, b__log=bad, c__log=SAMPLE_LOG)
    lines = files.directory_lines(spark, folder)
    rows = files.log_entries(lines).orderBy("record_index").collect()
    assert [r.record_index for r in rows] == list(range(18))
    assert {r.file.rsplit("/", 1)[-1] for r in rows} == {"a.log", "c.log"}
    with pytest.raises(ValueError, match="b.log"):
        files.log_entries(lines, on_bad_file="fail")
    sampled = files.log_entries(lines, sample_size=5, on_bad_file="fail")
    assert sampled.count() == 15


def test_pairs_cross_files(spark, tmp_path):
    first, second = SAMPLE_LOG.split("\n")[:2]
    folder = write(tmp_path, a__log=first + "\r\n", b__log=second + "\r\n")
    row = top_families(files.log_entries(files.directory_lines(spark, folder))).first()
    assert (row.score, [e.record_index for e in row.evidence]) == (20.0, [0, 1])


def page(*messages):
    return json.dumps({"events": [{"timestamp": 1, "message": m} for m in messages], "nextToken": "t"})


def test_cloudwatch_pages(spark, tmp_path):
    lines = RDS_LOG.strip().split("\n")
    (tmp_path / "1.json").write_text(page(lines[0] + "\n" + lines[1] + "\n", None, "", lines[2]))
    (tmp_path / "2.json").write_text(page("noise", lines[3], lines[4]))
    (tmp_path / "3.json").write_text("{}")
    responses = cloudwatch.read_responses(spark, str(tmp_path))
    rows = cloudwatch.response_entries(responses).orderBy("record_index").collect()
    assert [r.record_index for r in rows] == [0, 1, 2, 3, 4]
    assert {r.source_kind for r in rows} == {"AwsRds"}
    assert [r.duration_ms for r in rows] == [None, 44.0, None, 25.0, 120.0]
    sampled = cloudwatch.response_entries(responses, sample_size=5).count()
    assert sampled == 4
    with pytest.raises(ValueError):
        cloudwatch.response_entries(responses, sample_size=0)


def test_zone_map_prunes_files(spark, tmp_path):
    """Files of other times are not opened; a window between files and one over all files, names with odd characters."""
    folder = tmp_path / "pages"
    folder.mkdir()
    for k in range(6):
        events = [{"timestamp": 1000 * k + i, "message": "m" * 200 + str(i)} for i in range(500)]
        (folder / f"page {k}+x.json").write_text(json.dumps({"events": events}))
    (folder / "none.json").write_text("{}")
    zones = cloudwatch.zone_map(cloudwatch.read_responses(spark, str(folder))).cache()
    assert sorted((r.first_ms, r.last_ms) for r in zones.collect()) == [(1000 * k, 1000 * k + 499) for k in range(6)]
    before = {s.stageId() for s in stages(spark)}
    found = cloudwatch.responses_between(spark, zones, 2100, 3050)
    assert sorted(r.timestamp for r in found.collect()) == [*range(2100, 2500), *range(3000, 3051)]
    read = sum(s.inputBytes() for s in stages(spark) if s.stageId() not in before)
    assert read < sum(p.stat().st_size for p in folder.iterdir()) / 2
    assert cloudwatch.responses_between(spark, zones, 600, 900).count() == 0
    assert cloudwatch.responses_between(spark, zones, 0, 10_000).count() == 3000
    assert cloudwatch.response_entries(cloudwatch.responses_between(spark, zones, 600, 900)).count() == 0


def test_time_bounds(spark):
    now = datetime(2024, 1, 10, tzinfo=timezone.utc)
    end = 1704844800000
    assert cloudwatch.time_bounds("15m", now=now) == (end - 900_000, end)
    assert cloudwatch.time_bounds("2h", now=now) == (end - 7_200_000, end)
    assert cloudwatch.time_bounds("2024-01-09T01:00:00+01:00", "2024-01-10T00:00:00Z") == (
        end - 86_400_000, end)
    for since, until in [("soon", None), ("1d", "2023-01-01T00:00:00Z"), ("2024-01-01", None)]:
        with pytest.raises(ValueError):
            cloudwatch.time_bounds(since, until, now)
    df = spark.createDataFrame([(1, "a"), (5, "b"), (9, "c")], "timestamp bigint, message string")
    assert cloudwatch.in_time_window(df, 5, 9).count() == 2


def test_sorted_parts_become_one_file(spark, tmp_path):
    lines = spark.range(5000).select(F.col("id"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("value"))
    pieces = lines.repartitionByRange(7, "id").sortWithinPartitions("id").select("value")
    pieces.write.text(str(tmp_path / "pieces"))
    derived.joined(spark, str(tmp_path / "pieces"), str(tmp_path / "target.log"))
    assert (tmp_path / "target.log").read_text().splitlines() == [f"line {i}" for i in range(5000)]
    assert spark.read.text(str(tmp_path / "target.log")).count() == 5000
