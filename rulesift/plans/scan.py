"""Public scan API: code files in, findings and summaries out (all DataFrames).

    result = scan(files_df)                 # lazy, nothing runs yet
    result = result.materialize()           # optional: findings written once
    result.findings / .policy_summary / .scan_totals / .gate / ...

Physical shape: one map-only stage from the file scan to the findings (no
shuffle of lines), one small shuffle for the counts per policy (partial aggregates),
one for the per-repository file counts (reads only repo/branch/path).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesift.config import ScanConfig
from rulesift.operators import summary as S
from rulesift.operators.detectors import find, prepared_files
from rulesift.plans import kept
from rulesift.session import materialize, scratch_path


@dataclass(frozen=True)
class ScanResult:
    prepared: DataFrame       # pruned files with line arrays and comment counts
    findings: DataFrame
    file_counts: DataFrame    # repository dimension with files_scanned
    cfg: ScanConfig

    @cached_property
    def policy_table(self) -> DataFrame:
        """Counts per repository and policy; call ``materialize`` first when
        several outputs are needed from one scan."""
        return S.policy_table(self.file_counts, self.findings, self.cfg)

    @property
    def policy_summary(self) -> DataFrame:
        return S.policy_summary_from(self.policy_table, self.cfg)

    @property
    def scan_totals(self) -> DataFrame:
        return S.scan_totals_from(self.policy_table)

    @property
    def gate(self) -> DataFrame:
        return S.gate(self.scan_totals)

    @property
    def policy_file_counts(self) -> DataFrame:
        return S.policy_file_counts(self.findings)

    @property
    def org_policy_summary(self) -> DataFrame:
        return S.org_policy_summary(self.policy_summary)

    @property
    def line_counts(self) -> DataFrame:
        return S.line_counts(self.prepared)

    def materialize(self, path: str | None = None) -> "ScanResult":
        """Write findings and file counts once (Parquet, under the shared
        checkpoint folder unless ``path`` is given) and read them back, so that
        several reports do not rescan the corpus and lineage is cut."""
        spark = self.findings.sparkSession
        base = path or scratch_path(spark, "scan")
        self.findings.write.mode("overwrite").parquet(f"{base}/findings")
        self.file_counts.write.mode("overwrite").parquet(f"{base}/file_counts")
        return replace(self,
                       findings=spark.read.parquet(f"{base}/findings"),
                       file_counts=spark.read.parquet(f"{base}/file_counts"))


#: The key of a finding; the branch as a whole is what a scan replaces.
FINDING_KEY = ["repo", "branch", "policy_id", "file_path", "line_number"]
BRANCH = ["repo", "branch"]
KEPT_SCHEMA = ("repo string, branch string, policy_id int, policy_name string, file_path string, line_number int, line_content string, "
               "description string, severity string, first_seen timestamp, last_seen timestamp")


def write_findings(result: ScanResult, path: str, scan_ts: str | None = None) -> int:
    """K5: merges the findings of a scan into the kept ones by their key.

    For the branches of this scan: a finding that was kept and is found again keeps its
    ``first_seen`` and takes the rest from the scan, a new one begins now, one that is
    not found any more goes.  Other branches stay, and their folders are not opened; a
    branch without findings has a marker row.  Empty and null repository and branch names are
    values of their own; all keys are columns (``rulesift.plans.kept``).  ``scan_ts`` is the time of
    the scan (now if not given).  Returns the version that it made."""
    spark = result.findings.sparkSession
    now = F.to_timestamp(F.lit(scan_ts)) if scan_ts else F.current_timestamp()
    branches = materialize(result.file_counts.select(*BRANCH).distinct(), "branches")
    touched = [r[0] for r in branches.select(kept.bucket(BRANCH)).distinct().collect()]  # BUCKETS at most
    old = kept.latest(kept.read(spark, path, KEPT_SCHEMA, buckets=touched), BRANCH).where("policy_id IS NOT NULL").drop("version")
    named = branches.select(*(F.col(c).alias(f"_{c}") for c in BRANCH))
    old = old.join(named, F.col("repo").eqNullSafe(F.col("_repo")) & F.col("branch").eqNullSafe(F.col("_branch")), "left_semi")
    new = result.findings.withColumns({"first_seen": now, "last_seen": now}).select(*old.columns)
    rest = [c for c in old.columns if c not in (*FINDING_KEY, "first_seen")]
    both = old.withColumn("found", F.lit(0)).union(new.withColumn("found", F.lit(1)))
    merged = both.groupBy(*FINDING_KEY).agg(F.max(F.struct("found", *rest)).alias("last"), F.min("first_seen").alias("first_seen"))
    merged = merged.where("last.found = 1").select(*(F.col(f"last.{c}").alias(c) if c in rest else F.col(c) for c in old.columns))
    marker = branches.select(*(F.col(c) if c in BRANCH else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns))
    return kept.publish(merged.union(marker), path, BRANCH, FINDING_KEY)


def read_findings(spark: SparkSession, path: str, branches: list[tuple] | None = None) -> DataFrame:
    """The findings kept by ``write_findings``, with ``first_seen`` and ``last_seen``; of these (repo,
    branch) alone if given."""
    rows = kept.read(spark, path, KEPT_SCHEMA, BRANCH, branches)
    return kept.latest(rows, BRANCH).where("policy_id IS NOT NULL").drop("version")


def compact_findings(spark: SparkSession, path: str) -> list[str]:
    """Folds the versions kept so far into one; returns the folders that are no longer read."""
    return kept.compact(spark, path, KEPT_SCHEMA, BRANCH, FINDING_KEY, BRANCH)


def register_views(result: ScanResult, prefix: str = ""):
    """U4: SQL surface — temp views code_files (prepared files), code_lines,
    findings, policy_summary, scan_totals."""
    from rulesift.operators.lines import explode_lines
    result.prepared.select("repo", "branch", "path", "text").createOrReplaceTempView(f"{prefix}code_files")
    explode_lines(result.prepared).createOrReplaceTempView(f"{prefix}code_lines")
    result.findings.createOrReplaceTempView(f"{prefix}findings")
    result.policy_summary.createOrReplaceTempView(f"{prefix}policy_summary")
    result.scan_totals.createOrReplaceTempView(f"{prefix}scan_totals")


def scan(files: DataFrame, cfg: ScanConfig | None = None, listing: DataFrame | None = None) -> ScanResult:
    """``files``: repo, branch, path and ``text`` (or ``content`` + ``read_error``).
    ``listing``: optional repository/file listing (repo, branch, path; path may
    be null for a repository without files) — defaults to ``files``."""
    cfg = cfg or ScanConfig()
    listing = listing if listing is not None else files.select("repo", "branch", "path")
    prepared = prepared_files(files, cfg)
    return ScanResult(prepared=prepared,
                      findings=find(prepared, cfg, prepared=True),
                      file_counts=S.repo_file_counts(listing, cfg),
                      cfg=cfg)
