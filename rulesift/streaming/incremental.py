"""Incremental scan of landed code snapshots with Structured Streaming.

Snapshots of ``code_files`` rows (repo, branch, commit, path, text, and optionally scan_ts)
land as Parquet files in a folder; the files of one commit may arrive in any number of
micro-batches.  Each batch is scanned with the batch plan inside ``foreachBatch`` and added
to a kept table (``rulesift.plans.kept``) as one version: a row per scanned file
and a row per finding, in one write.  So a batch costs what its own files cost, whatever is
kept already; a batch that is cut off leaves nothing that is read; one that
is replayed after it was published adds nothing.

Of each (repo, branch, commit, path) the last version counts: a file that lands again without
findings loses its old ones, and a commit's other files stay.  Findings, files and
summaries are read from these rows; a read of some commits opens their folders only.

Defined cases: empty and null repository, branch and commit names are values of their own, and
names like ``0012``, ``1.10`` or ``12e5`` stay texts; of several rows of one path in a batch
the last by scan_ts, then by text, counts; a null text is a file that could not be read
(scanned, no findings); an empty batch adds no version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesift.config import ScanConfig
from rulesift.operators import summary as S
from rulesift.plans import kept
from rulesift.plans.scan import scan
from rulesift.session import materialize

SNAPSHOT_SCHEMA = "repo string, branch string, commit string, path string, text string"
KEY = ["repo", "branch", "commit"]
FILE = [*KEY, "path"]
#: A row without a policy stands for the scanned file itself.
CHANGE_SCHEMA = ("repo string, branch string, commit string, path string, scan_ts timestamp, policy_id int, policy_name string, "
                 "line_number int, line_content string, description string, severity string")
_CARRIED = {"branch": "string", "commit": "string", "scan_ts": "long"}


def _carry(df: DataFrame, *columns: str) -> DataFrame:
    """Branch, commit (and scan_ts) as one text in the place of the branch: a scan and its
    summaries take repository and branch along, whatever the branch says."""
    values = [F.unix_micros(c).alias(c) if c == "scan_ts" else F.col(c) for c in columns]
    return df.withColumn("branch", F.to_json(F.struct(*values))).drop(*(c for c in columns if c != "branch"))


def _carried(df: DataFrame, *columns: str) -> DataFrame:
    """The columns that ``_carry`` put away."""
    df = df.withColumn("_own", F.from_json("branch", ", ".join(f"{c} {_CARRIED[c]}" for c in columns)))
    return df.withColumns({c: F.timestamp_micros(f"_own.{c}") if c == "scan_ts" else F.col(f"_own.{c}") for c in columns}).drop("_own")


def scan_batch(batch: DataFrame, out_dir: str, cfg: ScanConfig | None = None, writer: str | None = None, epoch: int | None = None) -> int | None:
    """Scans one micro-batch and adds it to the kept table; returns its version, or None if it
    is empty or was published before under this writer and epoch."""
    cfg, spark = cfg or ScanConfig(), batch.sparkSession
    if writer is not None and kept.is_published(spark, out_dir, writer, epoch):
        return None
    if "scan_ts" not in batch.columns:
        batch = batch.withColumn("scan_ts", F.current_timestamp())
    last = batch.groupBy(*FILE).agg(F.max(F.struct("scan_ts", "text")).alias("last"))
    files = materialize(last.select(*FILE, "last.*"), "batch")
    if files.isEmpty():
        return None
    found = scan(_carry(files, "branch", "commit", "scan_ts"), cfg).findings
    found = _carried(found, "branch", "commit", "scan_ts").withColumnRenamed("file_path", "path")
    columns = [c.split(" ")[0] for c in CHANGE_SCHEMA.split(", ")]
    rows = files.select(*FILE, "scan_ts", *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in columns if c not in (*FILE, "scan_ts")))
    return kept.publish(rows.select(*columns).union(found.select(*columns)), out_dir, KEY, FILE, writer, epoch)


def read_kept(spark: SparkSession, out_dir: str, table: str, commits: list[tuple] | None = None, cfg: ScanConfig | None = None) -> DataFrame:
    """findings, files, policy_summary or scan_totals as they are kept; of the (repo, branch,
    commit) in ``commits`` alone if given."""
    cfg = cfg or ScanConfig()
    rows = kept.latest(kept.read(spark, out_dir, CHANGE_SCHEMA, KEY, commits), FILE).drop("version")
    found = rows.where("policy_id IS NOT NULL").withColumnRenamed("path", "file_path")
    files = rows.where("policy_id IS NULL").select(*FILE, "scan_ts")
    if table in ("findings", "files"):
        return found if table == "findings" else files
    pair = ("branch", "commit")
    counts = S.policy_table(S.repo_file_counts(_carry(files.drop("scan_ts"), *pair), cfg), _carry(found.drop("scan_ts"), *pair), cfg)
    return _carried({"policy_summary": lambda: S.policy_summary_from(counts, cfg), "scan_totals": lambda: S.scan_totals_from(counts)}[table](), *pair)


def compact(spark: SparkSession, out_dir: str) -> list[str]:
    """Folds the versions kept so far into one; returns the folders that are no longer read."""
    return kept.compact(spark, out_dir, CHANGE_SCHEMA, KEY, FILE, FILE)


def start_incremental_scan(spark: SparkSession, landing_dir: str, out_dir: str, checkpoint: str,
                           cfg: ScanConfig | None = None, files_per_batch: int | None = None, schema: str = SNAPSHOT_SCHEMA):
    stream = spark.readStream.schema(schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)

    def batch(df: DataFrame, epoch: int) -> None:
        scan_batch(df, out_dir, cfg, df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), epoch)

    return (stream.parquet(landing_dir).writeStream
            .foreachBatch(batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start())
