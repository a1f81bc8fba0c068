"""Random files: the Spark plan against the row-by-row model in brute.py."""

import random

import brute
from rulesift.plans.scan import scan

TOKENS = ['"""', "'''", '"""doc"""', "# c", "x = 1", "", "   ", 'q = """', "''' a", "y = 2  # i",
          "s = SparkSession", "    .builder.getOrCreate()", "SparkSession.builder.x.getOrCreate()",
          "sparksession . builder .getorcreate (", '  """', '"""a""" """', 'token = "abcdef"',
          'p = "/tmp/x"', "df.format('csv')", "CREATE DATABASE d", "os.system('curl x')", "\t#",
          "x #", '""""', "'''''", "  # note", 'h = "1.2.3.4"']
SEPS = ["\n", "\n", "\n", "\r\n", "\r", "\x0b", "\x0c", " ", "\x85"]


def random_text(rng):
    n = rng.randint(0, 40)
    parts = []
    for _ in range(n):
        parts.append(rng.choice(TOKENS) if rng.random() < 0.85 else rng.choice(TOKENS) + " " + rng.choice(TOKENS))
        parts.append(rng.choice(SEPS))
    return "".join(parts[:-1] if parts and rng.random() < 0.3 else parts)


def test_random_files_match_model(spark):
    rng = random.Random(7)
    files = [("org/p", "main", f"pkg/mod_{i}.py", random_text(rng)) for i in range(600)]
    df = spark.createDataFrame(files, "repo string, branch string, path string, text string")
    got = {tuple(r) for r in scan(df).findings.collect()}
    assert got == brute.scan(files)


def test_random_comment_counts_match_model(spark):
    rng = random.Random(11)
    files = [("org/p", "main", f"pkg/mod_{i}.py", random_text(rng)) for i in range(400)]
    df = spark.createDataFrame(files, "repo string, branch string, path string, text string")
    got = {r.path: (r.code_lines, r.comment_lines) for r in scan(df).line_counts.collect()}
    want = {p: brute.counts(t.splitlines()) for _, _, p, t in files}
    assert got == want
