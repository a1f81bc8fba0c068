"""Synthetic code corpus computed from the ``orders`` table (FIXTURES.md F-1).

One order is one Python file; its lines come from an integer formula, so Spark
and DuckDB build the same corpus and every query over it grows with ``orders``.
The file text is built in one projection (``transform`` over ``sequence``):
no shuffle, no driver data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Corpus constants of our own fixture (not of the scanned tool).
DIRS = ("src/jobs", "src/venv", "site-packages", "lib", "node_modules", "pipelines", "src")
STEMS = ("load_orders", "etl", "1", "temp", "__init__", "conftest", "Script",
         "customer_dim", "abcd", "my_file")
TEMPLATES = (
    "import os",
    "x = 1",
    "# note",
    "",
    "y = x + 1  # inline",
    '"""',
    '"""one line doc"""',
    'q = """',
    "df = load(spark, cfg)",
    'token = "abcd1234"',
    'p = "/mnt/raw/x"',
    'df.write.format("parquet").save(p)',
    'spark.sql("CREATE SCHEMA s")',
    's = SparkSession.builder.appName("a").getOrCreate()',
    "# SparkSession.builder.getOrCreate()",
    'h = "10.1.2.3:80"',
    "urllib.request.urlretrieve(u, f)",
    "''' alt",
    "s = SparkSession",
    "    .builder.getOrCreate()",
)
# One line that each other rule of policies 2, 4, 5 and 7 finds, each followed by one
# that it just misses (a later rule may find that), and a line over 150 characters.
RULE_LINES = (
    r'p = "D:\data\x.csv"', 'p = "D:data"',
    'u = "s3a://bucket/key"', 'u = "s3:/bucket"',
    'u = "abfss://c@a.dfs/x"', 'u = "abfs:/c"',
    'u = "gs://bucket/k"', 'u = "gs:/bucket"',
    'u = "wasbs://c@a/x"', 'u = "wasb:/c"',
    'password = "abc"', 'password = "ab"',
    'mail = "a.b@example.com"', 'mail = "a.b@example"',
    'c = "redis://host:1"', 'c = "redis:/host"',
    'h = "10.0.0.1"', 'h = "10.0.0"',
    'q = "CREATE TABLE t USING csv"', 'q = "CREATE TABLE t USING delta"',
    'q = "STORED AS ORC"', 'q = "STORED AS DELTA"',
    'df.read.format( \'orc\' )', 'df.read.format("delta")',
    'q = "create  database d"', 'q = "CREATE VIEW d"',
    'spark.catalog.createDatabase ("d")', 'spark.catalog.createdatabases("d")',
    'urllib.request.urlopen(u)', 'urllib.request.Request(u)',
    'r = requests.get(u, stream=True)', 'r = requests.get(u)',
    'wget (u)', 'wget = 1',
    'subprocess.run(["curl", u])', 'subprocess.run(["ls", u])',
    'os.system("wget -q " + u)', 'os.system("ls")',
    'shutil.copyfileobj(a, b)', 'shutil.copyfile(a, b)',
    'dbutils.fs.cp(a, "file:/x")', 'dbutils.fs.cp(a, b)',
    'gdown.download(u)', 'gdown.cached(u)',
    'tf.keras.utils.get_file(u)', 'tf.keras.utils.get_source(u)',
    'torch.hub.download_url_to_file(u)', 'torch.hub.load(u)',
    'token = "' + "abcdefghij" * 16 + '"',
)
N_REPOS = 20
#: Orders of customers that this divides land in a repository whose files are all skipped.
SKIPPED_EVERY = 97
SKIPPED_REPO = "org/skipped"
BRANCH = "main"


def _pick(values, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


#: Every line there is, by its number.
LINES = (*TEMPLATES, *(f"v{j} = f(v)" for j in range(40)), *RULE_LINES, *["w = g(w)"] * (340 - len(RULE_LINES)))


def corpus_line(k: Column, n: Column, modulus: Column | None = None, first: Column | None = None, step: Column | None = None) -> Column:
    """Line ``n`` (from 1) of file ``k`` (an order key); ``first`` and ``step`` are the terms without ``n``,
    if they are columns already."""
    modulus = modulus if modulus is not None else F.when(k % 3 == 0, F.lit(400)).otherwise(F.lit(60))
    number = (((k * 7919 if first is None else first) + ((k % 101 if step is None else step) * n + 104729) * n) % 1000003) % modulus
    return F.get(F.array(*map(F.lit, LINES)), number.cast("int"))


def _repo(c: Column) -> Column:
    return F.when(c % SKIPPED_EVERY == 0, SKIPPED_REPO).otherwise(F.concat(F.lit("org/repo"), (c % N_REPOS).cast("string")))


def _path(k: Column, c: Column) -> Column:
    folder = F.when(c % SKIPPED_EVERY == 0, 1).otherwise(c % 7)
    return F.concat(_pick(DIRS, folder), F.lit("/m"), k.cast("string"), F.lit("/"), _pick(STEMS, k % 10), F.lit(".py"))


def corpus_files(orders: DataFrame) -> DataFrame:
    """code_files(repo, branch, path, text) of the synthetic corpus.

    The text ends with a newline, so ``splitlines`` returns every generated
    line, a trailing blank one included."""
    k = F.col("o_orderkey").cast("long")
    c = F.col("o_custkey").cast("long")
    n_lines = F.lit(4) + k % 61
    numbers = F.sequence(F.lit(1).cast("long"), n_lines)
    # a case for all lines of a file, not one for each
    first, step = F.col("_first"), F.col("_step")
    line = lambda modulus: F.transform(numbers, lambda n: corpus_line(k, n, F.lit(modulus), first, step))
    lines = F.when(k % 3 == 0, line(400)).otherwise(line(60))
    return orders.withColumns({"_first": k * 7919, "_step": k % 101}).select(
        _repo(c).alias("repo"),
        F.lit(BRANCH).alias("branch"),
        _path(k, c).alias("path"),
        F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text"),
    )


def corpus_lines(orders: DataFrame) -> DataFrame:
    """The corpus as generated lines (repo, branch, path, line_number, line), for checks."""
    k = F.col("o_orderkey").cast("long")
    c = F.col("o_custkey").cast("long")
    return (orders
            .select(k.alias("k"), c.alias("c"),
                    F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4) + k % 61)).alias("n"))
            .select(_repo(F.col("c")).alias("repo"),
                    F.lit(BRANCH).alias("branch"),
                    _path(F.col("k"), F.col("c")).alias("path"),
                    F.col("n").cast("int").alias("line_number"),
                    corpus_line(F.col("k"), F.col("n")).alias("line")))


def load_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two key columns that the corpus is computed from, hash-spread: one order
    becomes a file of up to 64 lines, so a few input splits would leave most
    cores idle.  Only keys move (16 bytes a file); the texts are built after it.
    The count is explicit, so that AQE does not merge the tiny partitions again."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return orders.repartition(n, "o_orderkey")


def load_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_files(load_orders(spark, sf_dir))
