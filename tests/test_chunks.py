"""Associative scan over the chunks of a file: equal to the row form."""

import random

import pytest
from pyspark.sql import functions as F

from rulesift.config import ScanConfig
from rulesift.operators import chunks as C
from rulesift.operators import detectors as D
from rulesift.operators import lines as L
from rulesift.plans.scan import scan
from rulesift.sources.code_tree import read_code_tree

LINES = ['"""', "'''", 'q = """', '"""doc"""', "x = 1", "# note", "", "   ", "\t", "y = 2  # inline", 'p = "/mnt/a/b"', 'token = "abcd1234"  # t', "s = SparkSession", "  .builder.getOrCreate()",
         "SparkSession.", "SparkSession .builder", "builder.x.getOrCreate", "  .", ".builder.master(m).getOrCreate", "  (", "()", "(SparkSession", ".builder(SparkSession.builder.getOrCreate", "z = getOrCreate",
         "# SparkSession", "# .builder.getOrCreate()", "s = SparkSession.builder.getOrCreate()", "SparkSession.builder.getOrCreate(); SparkSession.builder.getOrCreate", 'df.write.format("parquet")', 'spark.sql("CREATE SCHEMA s")',
         "a\x0bb", "c\x0c", "\x85", "d \"\"\"", "e\rf", "g\r", "\x1cSparkSession\x1d"]


def files(rng, n):
    out = []
    for k in range(n):
        pool = rng.choice([LINES, LINES, LINES[12:28] + ["", " "], LINES[:10]])
        text = rng.choice(["\n", "\n", "\r\n"]).join(rng.choice(pool) for _ in range(rng.randrange(40))) + rng.choice(["", "\n", "\n\n", "\x0b", "\r"])
        out.append((f"a/{rng.choice(['load_jobs', 'etl', 'temp'])}_{k}.py" if k % 3 else f"a/{k}.py", text))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("size", [1, 3, 10])
def test_equals_the_row_form(spark, files_df, size):
    items = [*files(random.Random(size), 150), ("a/none.py", None), ("a/empty.py", ""), ("venv/x.py", '"""'), ("a/nl.py", "\n")]
    table = files_df(items).union(files_df(items[:20], branch=None)).union(files_df(items[20:40], repo="org/s", branch=""))
    chunks = C.cut(table, size)
    assert chunks.count() > table.count() or size > 3
    assert rows(C.find_chunks(chunks)) == rows(scan(table).findings)
    prepared = L.with_comment_counts(L.with_line_arrays(L.prune(table, ScanConfig().skip_dirs)))
    states = lambda df: rows(df.select(*C.FILE, "before", F.posexplode(F.arrays_zip("lines", "w1", "w2")).alias("pos", "z")).select(*C.FILE, F.col("before") + F.col("pos"), "z.lines", "z.w1", "z.w2"))
    assert states(C.with_states(chunks)) == states(prepared.withColumn("before", F.lit(0)))


def test_selected_policies(files_df):
    table = files_df(files(random.Random(9), 60))
    for cfg in (ScanConfig().only(1), ScanConfig().only(3, 6), ScanConfig().only(), ScanConfig(multiline_session=False)):
        assert rows(C.find_chunks(C.cut(table, 4), cfg)) == rows(scan(table, cfg).findings)


def test_session_over_many_chunks(files_df):
    text = "s = SparkSession\n" + "\n \n" * 30 + "  .\n" + "\t\n" * 9 + "builder.master(m).getOrCreate\n" + "\n" * 12 + "()\nx = 1\n"
    table = files_df([("a/load_jobs.py", text)])
    found = rows(C.find_chunks(C.cut(table, 2)))
    assert found == rows(scan(table).findings) and [(r[2], r[5]) for r in found] == [(1, 1)]


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_files_read_in_byte_ranges(spark, tmp_path, block):
    rng = random.Random(block)
    root = tmp_path / "repo"
    for k, (name, text) in enumerate(files(rng, 60)):
        path = root / ["", "sub dir+%20é", "a=b"][k % 3] / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes((b"\xef\xbb\xbf" if k % 4 == 0 else b"") + text.encode() + (b"\xff\xfe\xc3\nabc\xe2\x80" if k % 5 == 0 else b""))
    (root / "big_table.py").write_text("".join(rng.choice(LINES) + "\n" for _ in range(3000)))
    whole = read_code_tree(spark, str(root), repo="r").where("length > 0")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.minPartitionNum", 1)
    try:
        chunks = C.read_chunks(spark, str(root), "r", chunk_bytes=300).cache()
        chunks.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.minPartitionNum")
    texts = {}
    for r in chunks.orderBy("path", "start", "seq").collect():
        texts[r.path] = texts.get(r.path, "") + r.text
    assert texts == {r.path: bytes(r.content).decode("utf-8", "replace") for r in whole.collect()}
    if block < 1 << 20:
        assert chunks.where("path = 'big_table.py'").select("start").distinct().count() > 10  # ranges of one file
    assert rows(C.find_chunks(chunks)) == rows(scan(whole).findings)
    chunks.unpersist()
