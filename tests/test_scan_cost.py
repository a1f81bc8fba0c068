"""The scan's steps cost less and find the same."""

import random
import re

from pyspark.sql import functions as F

from rulesift import fixed
from rulesift.config import RULE_REQUIRES, ScanConfig
from rulesift.functions import text as X
from rulesift.operators import detectors as D
from rulesift.operators import lines as L
from rulesift.plans.queries import QUERIES
from rulesift.plans.scan import scan


def _orders(spark, tmp_path):
    spark.createDataFrame([(1, 2), (3, 4)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_the_line_stage_leaves_room_for_added_policies(spark, tmp_path):
    """The JVM compiles no method of over 8,000 bytes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = QUERIES["all_findings"](spark, _orders(spark, tmp_path))
        sizes = re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(map(int, sizes)) < 6500


def test_rules_are_skipped_only_where_a_file_cannot_hold_them(files_df):
    found = ['"/mnt/raw/x"', "'/ETC/x'", r'"D:\x"', '"S3A://b/k"', "'s3://b'", '"abfs://c"', '"ABFSS://c"', '"gs://b"', '"wasb://c"', "'wasbs://c'", 'paſſword = "abc"', 'PWD="abcd"', "api_secret = 'abc'", 'to\u212aen = "abc"',
             '"a.b@example.com"', '"jdbc://h"', "'mongodb+srv://h'", '"10.0.0.1:80"', '"/mntx"', '"s3:/b"', "x = 'a'", '"1.2.3"', "a@b.co", "s3://b", "#", '"""']
    rng = random.Random(5)
    texts = ["\n".join("".join(rng.choice(found) for _ in range(rng.randrange(3))) for _ in range(rng.randrange(1, 6))) for _ in range(400)] + found
    table = files_df([(f"a/load_{k}.py", t) for k, t in enumerate(texts)])
    got = {(r.file_path, r.line_number): r.description for r in scan(table, ScanConfig().only(2)).findings.collect()}
    lines = L.explode_lines(L.with_line_arrays(table))
    code = X.code_part(F.col("line"))
    every = F.when(~X.is_comment_line(F.col("stripped")) & (F.col("in_docstring") == 0) & ~X.has_triple_quote(F.col("stripped")), D.first_rule(code, fixed.P2_RULES))
    want = {(r.path, r.line_number): r.d for r in lines.withColumn("d", every).where("d IS NOT NULL").collect()}
    assert got == want and len(set(got.values())) == len(fixed.P2_RULES) == len(RULE_REQUIRES)


def test_searches_of_long_texts_equal_contains(spark):
    literals = ("os.system", "a+b(", "\\x\n ", "$", "ab", "[^x]", "caf\xe9s")
    texts = ["", None, "x os.system(", "osXsystem", "a+b(", "aab(", "q\\x\n y", "\\x\n", "$", "b", "cab", "[^x]", "yyyy", "un caf\xe9s"]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    for literal in literals:
        row = table.select(F.collect_list(F.struct("t", X.holds_any(F.col("t"), (literal,)).alias("h"))).alias("r")).first().r
        assert [r.h for r in row] == [None if t is None else literal in t for t in texts], literal


def test_lines_are_stripped_one_by_one_like_python(files_df):
    lines = ["x", " x", "x ", "\tx", "x\t", " ", "", "\x1fx\xa0", "x\u3000", "\x0bx", " #", "a b"]
    table = files_df([(f"a/{k}.py", x) for k, x in enumerate(lines)]).withColumn("p", X.is_plain(F.col("text")))
    for r in table.select("text", X.strip_line(F.col("text"), F.col("p")).alias("s")).collect():
        assert r.s == r.text.strip(), repr(r.text)


def test_states_of_plain_texts_equal_those_by_lines(files_df):
    rng = random.Random(6)
    pool = ['"""', "'''", '"', "'", '""', "''''", "\n", "\n", "x"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(25))) for _ in range(500)] + ["\x01\n'''\n\x01\n\"\"\"\nx"]
    table = L.with_line_arrays(files_df([(f"a/{k}.py", t) for k, t in enumerate(texts)]))
    for r in table.select("text", "w1", L.w1_parity(L.w1_flags(F.col("lines"))).alias("w")).collect():
        assert r.w1 == r.w, repr(r.text)
