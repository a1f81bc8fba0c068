"""The scan's searches of whole texts give what its line-by-line forms give."""

import random
import re

from pyspark.sql import functions as F

from rulesift.config import ScanConfig
from rulesift.functions import text as X
from rulesift.operators import detectors as D
from rulesift.operators import lines as L
from rulesift.plans.queries import QUERIES


def _texts(pool, n, size, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(size))) for _ in range(n)] + ["", "\n", "x", None]


def test_states_and_counts_equal_the_automata(files_df):
    pool = ['"""', "'''", '"', "'", "\n", "\n", "\n", "x = 1", " # y", "\t#z", "#", " ", "\t", "é", "\r", "\x0b"]
    texts = _texts(pool, 500, 30, 7) + _texts(pool[:13], 500, 30, 8) + ['"""a\nb\n\n', '"""a"""\n"""\n\'\'\'\nc', "'''\"\"\"\nx\n"]
    table = L.with_comment_counts(L.with_line_arrays(files_df([(f"a/{k}.py", t) for k, t in enumerate(texts)])))
    flags = L.w1_flags(F.col("lines"))
    classes = table.withColumns({"c": L.line_classes(F.col("stripped"), F.col("w2")), "w": L.w1_parity(flags)})
    both = classes.select("text", "w1", "w", "code_lines", "comment_lines", L.count_chars(F.col("c"), "ic").alias("code"), L.count_chars(F.col("c"), "xmhi").alias("comment"))
    rows = both.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.w1, r.code_lines, r.comment_lines) == (r.w, r.code, r.comment), repr(r.text)


def test_session_starts_equal_the_search_of_every_file(files_df):
    pool = ["SparkSession", "sparksession", ".", ".builder", "builder", ".getOrCreate", "getOrCreate", "(", "\n", "\n", " ", "#", "x", "\x1f", "ſparkSession", "K"]
    whole = "SparkSession.builder.getOrCreate("
    texts = _texts(pool, 800, 16, 9) + _texts([*pool[:14], whole, whole, "\n", "\n#", "SparkSession\n.builder", ".getOrCreate\n("], 800, 9, 10)
    table = D.with_multiline_session(L.with_line_arrays(files_df([(f"a/{k}.py", t) for k, t in enumerate(texts)])))
    told = lambda n: ~F.element_at("stripped", n).startswith("#") & X.matches(F.element_at("lines", n), D.fixed.P1_PATTERN)
    marked = D.marked_sessions(F.col("lines"))
    starts = F.array_compact(F.transform(marked, lambda x, i: F.when(x.contains(D._MARK), i + 1)))
    rows = table.withColumn("s", starts).select("text", "p1b", F.filter("s", lambda n: ~told(n)).alias("want")).collect()
    assert sum(bool(r.p1b) for r in rows) > 50
    for r in rows:
        assert r.p1b == r.want, repr(r.text)


def test_held_literals_leave_out_no_line(files_df):
    sets = [("create", "stored"), ("'", '"'), (), ("ſ",)]
    table = D.with_held(files_df([("a/1.py", "CREATE x\n"), ("a/2.py", "x"), ("a/3.py", "ſtored '"), ("a/4.py", None)]), sets)
    told = table.select(*(T.alias(f"t{i}") for i, T in enumerate(X.held(F.col("_held"), s, sets) for s in sets))).collect()
    assert [tuple(r) for r in told] == [(True, False, True, True), (False, False, True, True), (True, True, True, True), (False, False, True, True)]


def test_the_scan_classifies_no_line_by_a_lambda(spark, tmp_path):
    """The comment counts went line by line through interpreted lambdas."""
    spark.createDataFrame([(1, 2)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert "zip_with" not in QUERIES["all_findings"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert ScanConfig().comment_density


def test_file_names_and_stems(spark):
    """A file's name was split off its path some twenty times for policy 6."""
    names = {"a.py": "a", "a.b.py": "a.b", ".py": ".py", "a.": "a.", "a..": "a..", "..a": ".", "": "", "x": "x", "é.ß.y": "é.ß", "a\n.py\n": "a\n", ".a.b": ".a"}
    table = spark.createDataFrame([(folder + n, n, stem) for n, stem in names.items() for folder in ("", "/", "d.x/e/")], "path string, name string, stem string")
    name = X.file_name(F.col("path"))
    for r in table.withColumns({"n": name, "s": X.file_stem(name)}).collect():
        assert (r.n, r.s) == (r.name, r.stem), r
    assert str(X.file_stem(name)).count("path") == 1


def test_session_marks_equal_the_pattern(files_df):
    """Files whose lines hold one head each are searched once; the others as before."""
    pattern = re.compile(D.fixed.P1_PATTERN, re.I)
    pool = ["SparkSession", ".builder", "SparkSession.builder", ".getOrCreate(", ".getOrCreate", "(", "\n", "\n", " ", "#", "x"]
    texts = [t for t in _texts(pool, 1000, 12, 11) if t] + ["SparkSession\n.\nbuilder.getOrCreate\n(", "SparkSession.builder SparkSession.builder\n.getOrCreate("]
    table = L.with_line_arrays(files_df([(f"a/{k}.py", t) for k, t in enumerate(texts)]))
    rows = table.select("lines", D.marked_text(F.col("lines")).alias("m")).collect()
    for r in rows:
        full = "\n".join(r.lines)
        assert re.sub(f"[{D._HEAD}{D._TAIL}]", "", r.m) == pattern.sub(lambda m: D._MARK + m[0], full), repr(full)
    assert sum(D._MARK in r.m for r in rows) > 50


def test_code_lines_are_counted_without_a_search_per_line(spark, tmp_path):
    """Code lines were collected by a search that builds an array of matches."""
    spark.createDataFrame([(1, 2)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    plan = QUERIES["line_counts"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(_code" in plan and plan.count("regexp_extract_all(") == 1  # inline comments, where there are any
