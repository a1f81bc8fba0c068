"""T1 incremental scan, T2 scan log and findings log on streams."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from rulesift.plans import kept as K
from rulesift.streaming.incremental import CHANGE_SCHEMA, KEY, SNAPSHOT_SCHEMA, compact, read_kept, scan_batch, start_incremental_scan
from rulesift.streaming.scanlog import daily_findings, start_findings_log, start_scan_log

BAD = 'spark.sql("CREATE SCHEMA s")\n'
NAMES = ["", "1", "1.0", "1.1", "1.10", "0012", "12", "12e5", "me@feature", None]


def test_incremental_scan_replaces_per_commit(spark, tmp_path):
    landing, out, ck = str(tmp_path / "landing"), str(tmp_path / "out"), str(tmp_path / "ck")
    snap1 = [("org/a", "main", "c1", "src/etl.py", 'spark.sql("CREATE SCHEMA s")\n'),
             ("org/a", "main", "c1", "src/loader_job.py", "x = 1\n")]
    spark.createDataFrame(snap1, SNAPSHOT_SCHEMA).write.mode("append").parquet(landing)
    start_incremental_scan(spark, landing, out, ck).awaitTermination()
    f1 = read_kept(spark, out, "findings")
    assert sorted((r.commit, r.policy_id) for r in f1.collect()) == [("c1", 5), ("c1", 6)]
    snap2 = [("org/a", "main", "c2", "src/loader_job.py", "x = 1\n")]
    spark.createDataFrame(snap2, SNAPSHOT_SCHEMA).write.mode("append").parquet(landing)
    start_incremental_scan(spark, landing, out, ck).awaitTermination()
    totals = read_kept(spark, out, "scan_totals")
    got = sorted((r.commit, r.overall_status, r.files_scanned) for r in totals.collect())
    assert got == [("c1", "fail", 2), ("c2", "pass", 1)]


def kept(spark, out):
    found = sorted((r.repo, r.branch, r.commit, r.file_path, r.policy_id) for r in read_kept(spark, out, "findings").collect())
    totals = sorted((r.repo, r.branch, r.commit, r.files_scanned, r.overall_status, r.total_errors) for r in read_kept(spark, out, "scan_totals").collect())
    return found, totals


def test_batches_of_one_commit_replays_and_clean_commits(spark, tmp_path):
    out = str(tmp_path / "out")
    batch = lambda *rows: scan_batch(spark.createDataFrame(rows, SNAPSHOT_SCHEMA), out)
    bad, fine = ("org/a", "me@feature", "c9", "src/etl.py", 'spark.sql("CREATE SCHEMA s")\n'), ("org/a", "me@feature", "c9", "src/loader_job.py", "x = 1\n")
    other = ("org/b", "main", "c9", "src/etl.py", "x = 1\n")
    batch(bad)
    batch(fine, other)  # the same commit goes on, another repository begins
    want = ([("org/a", "me@feature", "c9", "src/etl.py", 5), ("org/a", "me@feature", "c9", "src/etl.py", 6), ("org/b", "main", "c9", "src/etl.py", 6)],
            [("org/a", "me@feature", "c9", 2, "fail", 2), ("org/b", "main", "c9", 1, "fail", 1)])
    assert kept(spark, out) == want
    batch(fine, other)
    batch(bad)  # replays
    assert kept(spark, out) == want
    batch(("org/a", "me@feature", "c9", "src/etl.py", "x = 1\n"), ("org/c", "main", "c1", "src/loader_job.py", "x = 1\n"))
    assert kept(spark, out) == (want[0][1:], [("org/a", "me@feature", "c9", 2, "fail", 1), want[1][1], ("org/c", "main", "c1", 1, "pass", 0)])
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static").lower() == "static"


def batch(spark, out, *rows, **options):
    return scan_batch(spark.createDataFrame(rows, SNAPSHOT_SCHEMA), out, **options)


def test_names_are_kept_as_they_are(spark, tmp_path):
    out = str(tmp_path / "out")
    keys = [(r, b, c) for k, r in enumerate(NAMES) for b in (NAMES[k], NAMES[k - 1], "", None) for c in (NAMES[k], "0012", "12e5", None)]
    keys = sorted(set(keys), key=str)
    batch(spark, out, *((*k, "a/load_jobs.py", BAD) for k in keys))
    batch(spark, out, *((*k, "a/save_jobs.py", BAD) for k in keys))  # every commit goes on
    rows = read_kept(spark, out, "scan_totals").collect()
    assert sorted(((r.repo, r.branch, r.commit) for r in rows), key=str) == keys
    assert {(r.files_scanned, r.total_errors) for r in rows} == {(2, 2)}
    found = read_kept(spark, out, "findings").collect()
    assert sorted(((r.repo, r.branch, r.commit, r.file_path) for r in found), key=str) == sorted(((*k, p) for k in keys for p in ("a/load_jobs.py", "a/save_jobs.py")), key=str)
    batch(spark, out, ("1", None, "12e5", "a/load_jobs.py", "x = 1\n"))
    some = read_kept(spark, out, "scan_totals", [("1", None, "12e5"), ("1.0", "", None)]).collect()
    assert sorted((r.repo, r.branch, r.commit, r.total_errors) for r in some) == [("1", None, "12e5", 1), ("1.0", "", None, 2)]
    assert read_kept(spark, out, "scan_totals", []).collect() == []


def files_under(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names}


def test_batches_cost_their_own_files_and_reads_open_their_folders(spark, tmp_path):
    out = str(tmp_path / "out")
    batch(spark, out, *(("org/a", "main", f"c{k}", f"a/load_{k}.py", BAD) for k in range(300)))
    before = files_under(out)
    version = batch(spark, out, ("org/a", "main", "c7", "a/more_jobs.py", BAD))
    after = files_under(out)
    assert {f: t for f, t in after.items() if f in before} == before  # nothing older is written again
    data = [f for f in set(after) - set(before) if f.endswith(".parquet")]
    assert len(data) == 1 and f"version={version}/" in data[0]
    opened = K.read(spark, out, CHANGE_SCHEMA, KEY, [("org/a", "main", "c7")]).select("_metadata.file_path").distinct().count()
    assert opened == 2 < len([f for f in after if f.endswith(".parquet")]) / 4
    totals = read_kept(spark, out, "scan_totals", [("org/a", "main", "c7")])
    assert [(r.commit, r.files_scanned, r.total_errors) for r in totals.collect()] == [("c7", 2, 2)]
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_a_batch_that_is_cut_off_is_not_read(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    first, second = ("org/a", "main", "c1", "a/load_jobs.py", BAD), ("org/a", "main", "c1", "a/save_jobs.py", BAD)
    batch(spark, out, first)
    want = kept(spark, out)
    frame = type(spark.range(0))
    coalesce = frame.coalesce

    def cut(*_):
        raise OSError("the driver is lost")

    monkeypatch.setattr(frame, "coalesce", cut)  # all data is written, the log is not
    with pytest.raises(OSError):
        batch(spark, out, second, writer="stream", epoch=1)
    monkeypatch.setattr(frame, "coalesce", coalesce)
    assert os.path.isdir(f"{out}/changes/version=2") and kept(spark, out) == want
    assert batch(spark, out, second, writer="stream", epoch=1) == 2
    now = kept(spark, out)
    assert now[1] == [("org/a", "main", "c1", 2, "fail", 2)] and len(now[0]) == 2
    assert batch(spark, out, second, writer="stream", epoch=1) is None and kept(spark, out) == now  # a replay
    assert batch(spark, out) is None and K.log(spark, out).count() == 2


def test_compaction_changes_no_result(spark, tmp_path):
    out = str(tmp_path / "out")
    assert compact(spark, out) == []
    for text in (BAD, "x = 1\n", BAD + BAD):
        batch(spark, out, ("org/a", "", "c1", "a/load_jobs.py", text), ("org/b", "b", "c1", "a/load_jobs.py", BAD))
    want = kept(spark, out)
    old = compact(spark, out)
    assert [x.rsplit("=", 1)[1] for x in old] == ["1", "2", "3"] and kept(spark, out) == want
    opened = [r[0] for r in K.read(spark, out, CHANGE_SCHEMA).select("_metadata.file_path").distinct().collect()]
    assert opened and all("version=4/" in x for x in opened)
    batch(spark, out, ("org/b", "b", "c1", "a/load_jobs.py", "x = 1\n"))
    assert kept(spark, out)[0] == [x for x in want[0] if x[0] == "org/a"]


def test_findings_log_equals_the_batch_counts(spark, tmp_path):
    out, sink, ck = (str(tmp_path / x) for x in ("out", "sink", "ck"))
    schema = f"{SNAPSHOT_SCHEMA}, scan_ts timestamp"
    at = lambda day, hour=1: dt.datetime(2024, 3, day, hour)

    def land(*rows):
        scan_batch(spark.createDataFrame(rows, schema), out)

    def log():
        start_findings_log(spark, out, sink, ck, "2 hours").awaitTermination()
        return sorted(map(tuple, spark.read.parquet(sink).collect()), key=str) if os.path.isdir(sink) else []

    def closed(last):
        days = daily_findings(read_kept(spark, out, "findings")).where(F.col("day") < last)
        return sorted(map(tuple, days.select("day", "repo", "policy_id", "findings").collect()), key=str)

    land(("r", None, "c1", "a/load_jobs.py", BAD + BAD, at(1)), ("r", "", "c1", "a/load_jobs.py", BAD, at(1, 23)), ("s", "b", "c1", "a/etl.py", BAD, at(2)))
    land(("r", "b", "c2", "a/save_jobs.py", BAD, at(3, 3)))
    assert log() == closed("2024-03-03") != []
    # the same file lands again, the versions are folded into one: nothing counts twice
    land(("r", "b", "c2", "a/save_jobs.py", BAD, at(3, 4)))
    compact(spark, out)
    land(("r", "b", "c3", "a/save_jobs.py", BAD, at(5)))
    assert log() == [*closed("2024-03-03"), ("2024-03-03", "r", 5, 1)]
    # a late row is dropped; the days that are closed stay as they are
    land(("r", "late", "c4", "a/save_jobs.py", BAD, at(2)), ("r", "b", "c5", "a/save_jobs.py", BAD, at(8)))
    got = log()
    assert got == [("2024-03-01", "r", 5, 3), ("2024-03-02", "s", 5, 1), ("2024-03-02", "s", 6, 1), ("2024-03-03", "r", 5, 1), ("2024-03-05", "r", 5, 1)]
    assert log() == got


def test_scan_log_stream_appends_closed_days(spark, tmp_path):
    src, sink, ck = str(tmp_path / "ev"), str(tmp_path / "log"), str(tmp_path / "ck2")
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    base = dt.datetime(2024, 1, 1, 10)
    rows = [(i, base + dt.timedelta(hours=7 * i), i % 3, "click", 1.0, "") for i in range(20)]
    spark.createDataFrame(rows, schema).write.parquet(src)
    start_scan_log(spark, src, schema, sink, ck, watermark="1 hour").awaitTermination()
    out = spark.read.parquet(sink)
    # days fully behind the watermark are final; the last (open) day is not emitted yet
    days = sorted({r.day for r in out.collect()})
    assert days and days[0] == "2024-01-01" and "2024-01-06" not in days
    assert out.agg(F.sum("scans")).first()[0] < 20
