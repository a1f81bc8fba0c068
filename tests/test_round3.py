"""Findings of round 3: joins of chunks, the size limit, and cheaper text tests with equal results."""

import random

from pyspark.sql import functions as F

from rulesift import fixed
from rulesift.functions import text as X
from rulesift.operators import chunks as C
from rulesift.operators import detectors as D
from rulesift.operators import lines as L
from rulesift.plans.queries import QUERIES


def test_size_limit_keeps_every_file_below_the_archive_limit(spark, tmp_path):
    spark.createDataFrame([(60, 1), (121, 7), (182, 14)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    kept = QUERIES["scan_size_limit"](spark, str(tmp_path))
    rows = kept.collect()
    assert kept.columns == ["repo", "branch", "path", "length"]
    assert len(rows) == QUERIES["scan_prune"](spark, str(tmp_path)).count() and max(r.length for r in rows) > 600


def test_many_chunk_sums_are_never_broadcast(spark, files_df, monkeypatch):
    table = files_df([(f"a/load_{k}.py", "x = 1\n" * 9) for k in range(5)])
    monkeypatch.setattr(C, "BROADCAST_CHUNKS", 3)
    found = C.find_chunks(C.cut(table, 2))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert C.find_chunks(C.cut(files_df([]), 2)).collect() == []


def test_stripped_lines_equal_pythons(spark, files_df):
    rng, pool = random.Random(3), ["x", " ", "\t", "\n", "\n", "a b", "\r", "\x0b", "\x1f", "\x7f", "\xa0", " ", " ", "é", "#"]
    texts = ["".join(rng.choice(pool[:n]) for _ in range(rng.randrange(25))) for n in (6, 15) for _ in range(300)] + ["", "\n", " ", "a\n  ", None]
    for row in L.with_line_arrays(files_df([(f"a/{k}.py", t) for k, t in enumerate(texts)])).select("text", "lines", "stripped").collect():
        want = (row.text or "").splitlines()
        assert row.lines == want and row.stripped == [x.strip() for x in want], repr(row.text)


def test_a_long_run_of_blanks_is_stripped_in_linear_time(files_df):
    import time

    table = files_df([("a/load_jobs.py", ("x" + " " * 200_000 + "y\n") * 2 + " " * 200_000 + "z" + " " * 200_000)])
    t = time.time()
    assert L.with_line_arrays(table).select(F.transform("stripped", F.length)).first()[0] == [200_002, 200_002, 1] and time.time() - t < 30


def test_guarded_matches_equal_the_pattern(spark):
    lines = ["", "create table t using csv", "CREATE  TABLE using", "requests.get(u, stream=True)", "requests.get u stream", "subprocess wget", "wget subprocess", "ſubprocess curl", None]
    table = spark.createDataFrame([(x,) for x in lines], "line string")
    for pattern, _ in (*fixed.P4_RULES, *fixed.P5_RULES, *fixed.P7_RULES):
        assert not table.where(F.coalesce(F.col("line").rlike(X.rx(pattern)), F.lit(False)) != F.coalesce(X.matches(F.col("line"), pattern), F.lit(False))).collect(), pattern


def test_private_characters_beside_a_session(files_df):
    text = "s = SparkSession\n\t.builder.getOrCreate()\n SparkSession .builder\n.getOrCreate(\ns = ſparkSession.builder\\\nSPARKSESSION.\nBUILDER.GETORCREATE ()\n"
    found = D.with_multiline_session(L.with_line_arrays(files_df([("a/load_jobs.py", text)]))).select("p1b").first()[0]
    assert found == [1, 6]
