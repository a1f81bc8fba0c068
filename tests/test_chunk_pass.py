"""the findings of chunks read each text once, and what they find before the states are known is placed right."""

import random

import pytest
from pyspark.sql import functions as F

from rulesift.config import ScanConfig
from rulesift.operators import chunks as C
from rulesift.plans.scan import scan


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_texts_are_read_once_and_do_not_move(spark, files_df):
    table = files_df([(f"a/load_{k}.py", "x = 1\n" * 5 + 'p = "/mnt/a"\nSparkSession\n.builder.getOrCreate()\n') for k in range(20)])
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    found = C.find_chunks(C.cut(table.mapInArrow(counted, table.schema), 2))
    assert len(found.collect()) == 40 and read.value == 20
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [1, 2])
def test_sessions_over_chunks_equal_the_search_of_the_file(files_df, size):
    rng = random.Random(size)
    pool = ["SparkSession", "SparkSession .", ".", " . ", "builder", ".builder", ".builder(SparkSession.builder.getOrCreate", ".builder.a.getOrCreate", "builder.getOrCreate SparkSession", "builder.getOrCreate(SparkSession", "(", "()",
            "(SparkSession", ".getOrCreate()", "# SparkSession.builder.getOrCreate(", "# SparkSession", "", " ", "\xa0", "\x1c", "x", "ſparkſession", ".buılder.getOrCreate(", "s = SparkSession.builder.getOrCreate()"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12))) + rng.choice(["", "\n"]) for _ in range(400)]
    table = files_df([(f"a/load_{k}.py", t) for k, t in enumerate(texts)])
    cfg = ScanConfig().only(1)
    found = rows(C.find_chunks(C.cut(table, size), cfg))
    assert found == rows(scan(table, cfg).findings) and len({r[7] for r in found}) == 2 and len(found) > 100


def test_docstrings_over_chunks(files_df):
    rng = random.Random(4)
    pool = ['"""', "'''", '"""a', 'b"""', "'''c'''", 'q = """', "# n", "x = 1", "y = 2  # i", "", ' z\t# t"""', 'p = "/mnt/a/b"', "\x0b", 'token = "abcd1234"']
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) + rng.choice(["", "\n", "\n\n"]) for _ in range(300)]
    table = files_df([(f"a/load_{k}.py", t) for k, t in enumerate(texts)])
    cfg = ScanConfig(min_code_lines=1, max_ratio=2).only(2, 3)
    found = rows(C.find_chunks(C.cut(table, 2), cfg))
    assert found == rows(scan(table, cfg).findings) and {r[2] for r in found} == {2, 3} and len({r[8] for r in found}) == 2


def test_added_policies(files_df):
    def frame(lines):
        return lines.where("in_docstring = 1 AND stripped = 'x'").select("repo", "branch", "path", "line_number", F.lit("in a docstring").alias("description"))

    cfg = ScanConfig().with_policy(8, "frame", frame=frame).with_policy(9, "functions", function=lambda text, st: F.when(st == "x", F.lit("an x")), scope="code_part") \
        .with_policy(10, "rules", [("foo", "a foo")], severity="warning")
    table = files_df([(f"a/load_{k}.py", t) for k, t in enumerate(['x\n"""\nx\n\nx\n"""\nx\nfoo\n', "x\n", "'''\n" * 3 + "x\nfoo x\n" * 4, None, ""])])
    found = rows(C.find_chunks(C.cut(table, 2), cfg))
    assert found == rows(scan(table, cfg).findings) and {8, 9, 10} <= {r[2] for r in found}
