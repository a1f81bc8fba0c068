"""Every line rule of policies 2, 4, 5 and 7: one line it finds and one it misses, with literal texts."""

from rulesift.config import ScanConfig
from rulesift.plans.scan import scan

FOUND = [
    ('p = "/mnt/raw/x"', 2, "Hardcoded file path"),
    ('p = "C:\\data\\x.csv"', 2, "Hardcoded Windows file path"),
    ('u = "s3a://bucket/key"', 2, "Hardcoded S3 path"),
    ('u = "abfss://c@a.dfs/x"', 2, "Hardcoded Azure storage path"),
    ('u = "gs://bucket/k"', 2, "Hardcoded GCS path"),
    ('u = "wasbs://c@a/x"', 2, "Hardcoded Azure Blob path"),
    ('password\x1f= "abc"', 2, "Hardcoded password/secret"),
    ('m = "a.b@example.com"', 2, "Hardcoded email address"),
    ('c = "redis://host:1"', 2, "Hardcoded connection string"),
    ('h = "10.0.0.1:80"', 2, "Hardcoded IP address"),
    ("df.write.format( 'orc' )", 4, "Non-Delta write format specified"),
    ('q = "create external table t using CSV"', 4, "CREATE TABLE using non-Delta format"),
    ('q = "STORED AS textfile"', 4, "Table stored as non-Delta format"),
    ('q = "create  database d"', 5, "Schema/database creation statement"),
    ('spark.catalog.createDatabase ("d")', 5, "createDatabase() API call"),
    ("urllib.request.urlretrieve(u, f)", 7, "urllib file download to local VM"),
    ("urllib.request.urlopen(u)", 7, "urllib URL open (potential local download)"),
    ("r = requests.get(u, stream=True)", 7, "HTTP download to local VM"),
    ("wget (u)", 7, "wget download to local VM"),
    ('subprocess.run(["curl", u])', 7, "subprocess curl/wget download"),
    ('os.system("wget -q " + u)', 7, "os.system curl/wget download"),
    ("shutil.copyfileobj(a, b)", 7, "shutil file copy (potential download)"),
    ('dbutils.fs.cp(a, "file:/x")', 7, "Copying to local filesystem via dbutils"),
    ("gdown.download(u)", 7, "Google Drive download to local VM"),
    ("tf.keras.utils.get_file(u)", 7, "Keras file download to local VM"),
    ("torch.hub.download_url_to_file(u)", 7, "PyTorch hub download to local VM"),
]
MISSED = [
    'p = "/srv/raw/x"', 'p = "C:data"', 'u = "s3:/bucket"', 'u = "abfs:/c"', 'u = "gs:/b"', 'u = "wasb:/c"', 'password = "ab"', 'm = "a.b@example"',
    'c = "redis:/host"', 'h = "10.0.0"', 'df.write.format("delta")', 'q = "CREATE TABLE t USING delta"', 'q = "STORED AS DELTA"', 'q = "CREATE VIEW d"',
    'spark.catalog.createDatabases("d")', "urllib.request.Request(u)", "r = requests.get(u)", "wget = 1", 'subprocess.run(["ls", u])', 'os.system("ls")',
    "shutil.copyfile(a, b)", "dbutils.fs.cp(a, b)", "gdown.cached(u)", "tf.keras.utils.get_source(u)", "torch.hub.load(u)",
]


def test_each_rule(files_df):
    lines = [line for line, *_ in FOUND] + MISSED
    got = scan(files_df([("jobs/load_data.py", "\n".join(lines) + "\n")]), ScanConfig().only(2, 4, 5, 7)).findings.collect()
    assert {(lines[r.line_number - 1], r.policy_id, r.description) for r in got} == set(FOUND) and len(got) == len(FOUND)


def test_long_line_is_cut_to_150_characters(files_df):
    (found,) = scan(files_df([("jobs/load_data.py", 'token = "' + "é" * 200 + '"\n')]), ScanConfig().only(2)).findings.collect()
    assert found.line_content == 'token = "' + "é" * 141


LONG = 1_000_000
#: Lines on which a search that backtracks takes hours: many heads and no tail.
HARD = ["CREATE TABLE" + " " * LONG, "CREATE TABLE " * (LONG // 13), "CREATE EXTERNAL TABLE " * (LONG // 22), "subprocess " * (LONG // 11), "curl " + "subprocess " * (LONG // 11), "requests.get(" * (LONG // 13),
        "os.system( " * (LONG // 11), "dbutils.fs.cp(" * (LONG // 14), "SparkSession.builder " * (LONG // 21), "getOrCreate; " + "SparkSession.builder " * (LONG // 21), "SparkSession.builder " * (LONG // 21) + ".getOrCreate",
        "spark.sql('" * (LONG // 11), "SparkSession" + " " * LONG + ".", "STORED" + " " * LONG, "create" + " " * LONG + "schem", "token" + " " * LONG, '"' * LONG, "x@y." * (LONG // 4)]


def test_long_lines_end_within_seconds(files_df):
    import time

    endings = {0: ("x USING csv", 4), 3: ("wget", 7), 5: ("stream", 7), 6: ("curl", 7), 7: ('"file:/x"', 7), 8: (".getOrCreate()", 1), 14: ("a", 5)}
    lines = HARD + [HARD[k] + end for k, (end, _) in endings.items()]
    start = time.time()
    got = scan(files_df([("jobs/load_data.py", "\n".join(f"{line}\nx = 1" for line in lines) + "\n")]), ScanConfig().only(1, 2, 4, 5, 7)).findings.collect()
    assert sorted((r.line_number, r.policy_id) for r in got) == [(2 * (len(HARD) + k) + 1, p) for k, (_, p) in enumerate(endings.values())]
    assert time.time() - start < 60


def test_rules_in_order_equal_the_whole_pattern(files_df):
    """Heads, tails and pieces of them in any order: the same rows as the pattern as it stands."""
    import random
    import re

    from pyspark.sql import functions as F

    from rulesift import fixed
    from rulesift.functions import text as T

    ordered = [p for rules in (fixed.P4_RULES, fixed.P5_RULES, fixed.P7_RULES, [(fixed.P1_PATTERN, "")]) for p, _ in rules if T.in_order(p)]
    assert len(ordered) == 7
    rng = random.Random(1)
    pieces = ["CREATE", "EXTERNAL", "TABLE", " ", "  ", "\t", "USING", "csv", "t", "subprocess", "curl", "wget", "os.system", "(", "'", '"', "file:/", "dbutils.fs.cp", "requests.get", "stream", "content",
              "SparkSession", ".", "builder", "getOrCreate", "spark.sql", "schema", "\x1c", "create", "x", " USING csv", ".getOrCreate (", "CREATE schema", "'file:/"]
    lines = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(4000)]
    for head in ("CREATE TABLE", "create external table", "subprocess", "os.system(", "dbutils.fs.cp (", "requests.get(", "SparkSession.builder", "spark.sql( '"):
        lines += [head + "".join(rng.choice(pieces) for _ in range(rng.randrange(9))) for _ in range(300)]
    table = files_df([("p", line) for line in lines]).select("text", *(T.matches(F.col("text"), p).alias(f"m{k}") for k, p in enumerate(ordered)), *(F.col("text").rlike(T.rx(p)).alias(f"w{k}") for k, p in enumerate(ordered)))
    rows = table.collect()
    for k, p in enumerate(ordered):
        assert [r[f"m{k}"] for r in rows] == [r[f"w{k}"] for r in rows], p
        assert any(r[f"m{k}"] for r in rows) and [r[f"m{k}"] for r in rows] == [bool(re.search(p, r.text, re.I)) for r in rows]
