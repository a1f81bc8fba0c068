"""Aggregations: per-policy status, per-repository totals, organisation rollup.

Shape of the plan: a repository dimension with its file count comes from the
file listing (column-pruned, no content read).  It is expanded to one skeleton
row per policy by exploding a literal array (no cross join, no join at all),
unioned with one fact row per finding, and aggregated once per policy; totals add
up the policies of a repository.  Every aggregate is partial on the map side, so a
repository holding a third of all findings still shuffles only one partial row
per policy and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulesift.config import ScanConfig
from rulesift.functions import text as T
from rulesift.operators.detectors import policy_name
from rulesift.session import materialize


def status(errors: Column, warnings: Column) -> Column:
    """A4/A5: fail on any error, warning on any warning, else pass."""
    return F.when(errors > 0, "fail").when(warnings > 0, "warning").otherwise("pass")


def repo_file_counts(listing: DataFrame, cfg: ScanConfig) -> DataFrame:
    """A6 + repository dimension: (repo, branch, files_scanned); repositories
    whose files are all pruned (or that have none) keep a row with 0."""
    kept = ~T.in_skipped_dir(F.col("path"), cfg.skip_dirs) & F.col("path").isNotNull()
    return listing.groupBy("repo", "branch").agg(F.count_if(kept).cast("long").alias("files_scanned"))


def policy_table(file_counts: DataFrame, findings: DataFrame, cfg: ScanConfig) -> DataFrame:
    """A2 + J1: (repo, branch, policy_id, files, errors, warnings), all policies present."""
    skeleton = file_counts.select(
        "repo", "branch",
        F.explode(F.array(*[F.lit(p) for p in sorted(cfg.policies)])).alias("policy_id"),
        F.col("files_scanned").alias("files"),
        F.lit(0).alias("is_error"), F.lit(0).alias("is_warning"))
    facts = findings.select(
        "repo", "branch", "policy_id",
        F.lit(0).cast("long").alias("files"),
        (F.col("severity") == "error").cast("int").alias("is_error"),
        (F.col("severity") == "warning").cast("int").alias("is_warning"))
    return (skeleton.unionByName(facts).groupBy("repo", "branch", "policy_id")
            .agg(F.max("files").cast("long").alias("files"),
                 F.sum("is_error").cast("long").alias("errors"),
                 F.sum("is_warning").cast("long").alias("warnings")))


def policy_summary_from(table: DataFrame, cfg: ScanConfig) -> DataFrame:
    """One row per repository and policy, all policies present."""
    return table.select("repo", "branch",
                        F.col("policy_id").cast("int").alias("policy_id"),
                        policy_name(F.col("policy_id"), cfg).alias("policy_name"),
                        status(F.col("errors"), F.col("warnings")).alias("status"),
                        F.col("files").alias("files_checked"),
                        "errors", "warnings")


def scan_totals_from(table: DataFrame) -> DataFrame:
    """A3/A5: one row per repository, added up from its policies; an empty scan passes."""
    totals = table.groupBy("repo", "branch").agg(F.max("files").alias("files_scanned"), F.sum("errors").alias("total_errors"), F.sum("warnings").alias("total_warnings"))
    return totals.select("repo", "branch", "files_scanned",
                         status(F.col("total_errors"), F.col("total_warnings")).alias("overall_status"),
                         "total_errors", "total_warnings")


def gate(totals: DataFrame) -> DataFrame:
    """K4: the check fails when any policy failed (any error)."""
    return totals.select("repo", "branch", (F.col("overall_status") == "fail").alias("gate_failed"))


def policy_file_counts(findings: DataFrame) -> DataFrame:
    """Violations and distinct files per repository and policy."""
    return (findings.groupBy("repo", "branch", "policy_id")
            .agg(F.count("*").cast("long").alias("violations"),
                 F.count_distinct("file_path").cast("long").alias("files")))


def org_policy_summary(policy_summary: DataFrame) -> DataFrame:
    """Per policy across all repositories of the batch."""
    return (policy_summary.groupBy("policy_id", "policy_name")
            .agg(F.count_if(F.col("status") == "fail").cast("long").alias("repos_failing"),
                 F.count_if(F.col("status") == "warning").cast("long").alias("repos_warning"),
                 F.count_if(F.col("status") == "pass").cast("long").alias("repos_passing"),
                 F.sum("errors").cast("long").alias("total_errors"),
                 F.sum("warnings").cast("long").alias("total_warnings")))


def line_counts(prepared: DataFrame) -> DataFrame:
    """A1: code and comment lines per file (computed inside the file row)."""
    return prepared.select("repo", "branch", "path", "code_lines", "comment_lines")


def ranked_within(df: DataFrame, group_cols: list[str], order: Column, name: str = "rank") -> DataFrame:
    """1-based rank by ``order`` inside each group, without putting a whole
    group into one task.  Rows are range-partitioned globally on (group, order),
    sorted inside partitions, and written once with their partition and place to
    the shared scratch folder, so that every later use sees the same places; a
    small table (one row per partition and group) then gives each slice the sizes
    of the group's slices in earlier partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = materialize(df.withColumn("_ord", order)
                           .repartitionByRange(n, *group_cols, "_ord")
                           .sortWithinPartitions(*group_cols, "_ord")
                           .withColumn("_pid", F.spark_partition_id())
                           .withColumn("_mid", F.monotonically_increasing_id()).drop("_ord"), "ranked")
    slices = numbered.groupBy("_pid", *group_cols).agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"))
    offsets = slices.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.partitionBy(*group_cols).orderBy("_pid")
                                            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (numbered.join(offsets.drop("_n"), ["_pid", *group_cols])
            .withColumn(name, (F.col("_mid") - F.col("_first") + 1 + F.col("_off")).cast("long"))
            .drop("_pid", "_mid", "_first", "_off"))


def file_order(listing: DataFrame) -> DataFrame:
    """O1: files ordered by path *parts* (as ``pathlib`` sorts), ranked per repo."""
    return ranked_within(listing.select("repo", "branch", "path"), ["repo", "branch"],
                         T.path_parts(F.col("path")), "file_rank")
