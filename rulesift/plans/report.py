"""Reports: Markdown (K1) and JSON (K2) per repository, review bundle.

A report is a *set of rows* with a sort key, not one string built in one task:
``markdown_rows`` and ``json_rows`` give (repo, branch, section, policy_id, sub,
…, text); the texts in the order of the key columns are the document.
``write_report`` range-partitions on that key and writes text files per
repository, so a repository with a third of all findings is spread over many
tasks and no repository holds up the others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulesift import fixed
from rulesift.functions import text as T
from rulesift.operators import summary as S
from rulesift.operators.detectors import fmt
from rulesift.plans import kept
from rulesift.session import materialize

FIXED_SCAN_TS = "2024-01-01 00:00:00"
DEFAULT_GENERATOR = "rulesift"
ORDER_KEY = ["section", "policy_id", "sub", "file_path", "line_number", "seq"]
ROW_COLUMNS = ["repo", "branch", *ORDER_KEY, "text"]


def _case(col: Column, mapping: dict) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v))
    return out


def _rows(df: DataFrame, section: int, texts: list[Column], policy_id: Column | None = None,
          sub: int = 0, first_seq: int = 0) -> DataFrame:
    """Fixed lines for every row of ``df`` (one per repo, or per repo+policy);
    a null text drops the line."""
    items = F.array(*[F.struct(F.lit(first_seq + i).alias("seq"), t.alias("text")) for i, t in enumerate(texts)])
    return (df.select("repo", "branch", (policy_id if policy_id is not None else F.lit(0)).alias("policy_id"),
                      F.explode(items).alias("l"))
            .where(F.col("l.text").isNotNull())
            .select("repo", "branch", F.lit(section).alias("section"), F.col("policy_id").cast("int"),
                    F.lit(sub).alias("sub"), F.lit("").alias("file_path"), F.lit(0).alias("line_number"),
                    F.col("l.seq").cast("int").alias("seq"), F.col("l.text").alias("text")))


def overall_lines(totals: DataFrame) -> DataFrame:
    """Overall result heading per repository; repositories without files
    also get the "nothing to review" note."""
    return totals.select(
        "repo", "branch", "files_scanned", "overall_status",
        _case(F.col("overall_status"), fixed.REPORT_OVERALL).alias("headline"),
        F.when(F.col("files_scanned") == 0,
               fmt(fixed.REPORT_NO_FILES, repo=F.col("repo")))
        .alias("note"))


def markdown_rows(result, scan_ts: str = FIXED_SCAN_TS, generator: str = DEFAULT_GENERATOR) -> DataFrame:
    """K1 as ordered rows.  ``scan_ts`` is a parameter so reports repeat."""
    now = F.lit(f"{scan_ts} UTC")
    # counts per repository and policy feed several sections: written once
    counts = S.policy_file_counts(result.findings).select("repo", "branch", "policy_id", F.col("files").alias("n_files"))
    table = materialize(result.policy_table.join(counts, ["repo", "branch", "policy_id"], "left"), "policy_table")
    totals, summary = S.scan_totals_from(table), S.policy_summary_from(table, result.cfg)
    n = F.col("files_scanned").cast("string")
    header = _rows(totals, 0, [
        F.lit(fixed.REPORT_TITLE), F.lit(""), F.lit(fixed.REPORT_READ_ONLY), F.lit(""),
        *map(F.lit, fixed.REPORT_FIELDS),
        F.when(F.col("repo") != "", fmt(fixed.REPORT_REPOSITORY, repo=F.col("repo"))),
        F.when(F.col("branch") != "", fmt(fixed.REPORT_BRANCH, branch=F.col("branch"))),
        fmt(fixed.REPORT_SCAN_DATE, now=now),
        fmt(fixed.REPORT_FILES, n=n),
        F.lit("")])
    overall = _rows(totals, 1, [
        _case(F.col("overall_status"), fixed.REPORT_OVERALL), F.lit(""),
        fmt(fixed.REPORT_COUNTS, errors=F.col("total_errors"), warnings=F.col("total_warnings"), n=n),
        F.lit(""), F.lit(fixed.REPORT_RULER), F.lit(""), F.lit(fixed.REPORT_SUMMARY_TITLE), F.lit(""),
        *map(F.lit, fixed.REPORT_SUMMARY_HEAD)])
    pid = F.col("policy_id").cast("string")
    summary_rows = _rows(summary, 2, [
        fmt(fixed.REPORT_SUMMARY_ROW, id=pid, name=F.col("policy_name"), status=_case(F.col("status"), fixed.STATUS_CELL),
            errors=F.col("errors"), warnings=F.col("warnings"))],
        policy_id=F.col("policy_id"))
    findings_title = _rows(totals, 3, [F.lit(""), F.lit(fixed.REPORT_RULER), F.lit(""), F.lit(fixed.REPORT_FINDINGS_TITLE)])
    per_policy = summary.join(table.select("repo", "branch", "policy_id", "n_files"), ["repo", "branch", "policy_id"])
    violations = F.col("errors") + F.col("warnings")
    has = violations > 0
    policy_head = _rows(per_policy, 4, [
        F.lit(""),
        fmt(fixed.REPORT_POLICY_TITLE, id=pid, name=F.col("policy_name"), icon=_case(F.col("status"), fixed.STATUS_ICON)),
        F.lit(""),
        F.when(has, fmt(fixed.REPORT_VIOLATIONS, violations=violations, files=F.col("n_files")))
        .otherwise(F.lit(fixed.NO_VIOLATIONS)),
        F.lit(""),
        *(F.when(has, F.lit(x)) for x in fixed.REPORT_FINDING_HEAD)],
        policy_id=F.col("policy_id"))
    policy_tail = _rows(per_policy.where(has), 4, [F.lit("")], policy_id=F.col("policy_id"), sub=2)
    f = result.findings
    line_cell = F.when(F.col("line_number") > 0, F.col("line_number").cast("string")).otherwise(
        F.lit(fixed.WHOLE_FILE_LINE))
    finding_rows = f.select(
        "repo", "branch", F.lit(4).alias("section"), F.col("policy_id").cast("int"), F.lit(1).alias("sub"),
        "file_path", F.col("line_number").cast("int"), F.lit(0).alias("seq"),
        fmt(fixed.REPORT_FINDING_ROW, icon=_case(F.col("severity"), fixed.SEVERITY_ICON), file=F.col("file_path"), line=line_cell,
            description=T.escape_pipes(F.col("description"))).alias("text"))
    footer = _rows(totals, 5, [
        F.lit(fixed.REPORT_RULER), F.lit(""), F.lit(fixed.REPORT_REFERENCE_TITLE), F.lit(""),
        *map(F.lit, fixed.REPORT_REFERENCE_HEAD),
        *[F.lit(r) for r in fixed.POLICY_REFERENCE_ROWS],
        F.lit(""), F.lit(fixed.REPORT_RULER),
        fmt(fixed.REPORT_FOOTER, generator=F.lit(generator), now=now)])
    parts = [header, overall, summary_rows, findings_title, policy_head, policy_tail, finding_rows, footer]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*ROW_COLUMNS)


PARTS_SCHEMA = "repo string, branch string, part int, file string"
BRANCH = ["repo", "branch"]


def write_report(rows: DataFrame, path: str, key: list[str] = ORDER_KEY, partitions: int | None = None) -> int:
    """K3: write each repository's report as text, in as many parts as its size asks for, and publish
    the ordered list of its parts (``report_parts``).

    The reports of the repositories and branches in ``rows`` replace those written before; all others
    stay.  The list is published last and at once (``rulesift.plans.kept``): until then readers have
    the old reports, and what a lost job leaves behind is in no list.  Returns the version."""
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{path}/text/{uuid.uuid4().hex}"
    # names of any kind (empty, null, like numbers, with slashes) do not go into folder names
    report = F.left(F.sha2(F.to_json(F.struct(*BRANCH)), 256), F.lit(32)).alias("report")
    (rows.select("*", report).repartitionByRange(n, "report", *key)
     .sortWithinPartitions("report", *key)
     .select("report", "text")
     .write.partitionBy("report").text(folder))
    names = rows.select(*BRANCH, report).distinct()
    written = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select(F.col("path").alias("file"), F.col("report").cast("string"))
    place = F.row_number().over(Window.partitionBy("report").orderBy("file"))  # a report has at most ``n`` parts
    parts = written.withColumn("part", place).join(names, "report").select(*BRANCH, "part", "file")
    return kept.publish(parts, path, BRANCH, [*BRANCH, "part"])


def report_parts(spark: SparkSession, path: str, branches: list[tuple] | None = None) -> DataFrame:
    """(repo, branch, part, file): the text files of each report; in the order of ``part`` they are the
    document.  Of these (repo, branch) alone if given."""
    return kept.latest(kept.read(spark, path, PARTS_SCHEMA, BRANCH, branches), BRANCH).drop("version")


JSON_KEY = ["section", "policy_id", "sub", "parts", "pass_no", "line_number"]


def json_rows(result, scan_ts: str = FIXED_SCAN_TS) -> DataFrame:
    """K2 as ordered rows (repo, branch, section, policy_id, sub, parts, pass_no, line_number, text):
    scan_date, files_scanned, overall_status, totals, and ``policies`` by number, each with its
    violations in file order (path parts), the one-line pass before the cross-line pass of policy 1,
    then line number.  Every text but a policy's first violation begins with its comma."""
    keys = ["repo", "branch", "policy_id"]
    table = materialize(result.policy_table, "policy_table")
    totals, summary = S.scan_totals_from(table), S.policy_summary_from(table, result.cfg)
    nowhere = [F.array().cast("array<string>").alias("parts"), F.lit(0).alias("pass_no"), F.lit(0).alias("line_number")]

    def row(df: DataFrame, section: int, sub: int, text: Column, policy_id: Column | None = None) -> DataFrame:
        return df.select("repo", "branch", F.lit(section).alias("section"), (policy_id if policy_id is not None else F.lit(0)).cast("int").alias("policy_id"),
                         F.lit(sub).alias("sub"), *nowhere, text.alias("text"))

    text = F.to_json(F.struct(F.lit(scan_ts.replace(" ", "T") + "+00:00").alias("scan_date"), "files_scanned", "overall_status", "total_errors", "total_warnings"))
    head = row(totals.withColumn("j", text), 0, 0, F.concat(F.expr("substr(j, 1, length(j) - 1)"), F.lit(', "policies": {')))
    first = F.min("policy_id").over(Window.partitionBy("repo", "branch"))  # as many rows as there are policies
    opened = F.concat(F.when(F.col("policy_id") > F.col("first"), ",").otherwise(""), F.lit('"'), F.col("policy_id").cast("string"), F.lit('": {"name": '),
                      F.expr("substr(j, 6, length(j) - 6)"), F.lit(', "status": "'), F.col("status"), F.lit('", "violations": ['))
    named = summary.withColumns({"j": F.to_json(F.struct(F.col("policy_name").alias("n"))), "first": first})
    policies = row(named, 1, 0, opened, F.col("policy_id")).union(row(summary, 1, 2, F.lit("]}"), F.col("policy_id")))

    found = result.findings.select(
        *keys, T.path_parts(F.col("file_path")).alias("parts"), (F.col("description") == fixed.P1_DESC_MULTI).cast("int").alias("pass_no"), "line_number",
        F.to_json(F.struct(F.col("file_path").alias("file"), F.col("line_number").alias("line"), "severity", "description", F.col("line_content").alias("content"))).alias("j"))
    place = F.struct("parts", "pass_no", "line_number")
    firsts = found.groupBy(*keys).agg(F.min(place).alias("least"))
    violations = found.join(firsts, keys).select(
        "repo", "branch", F.lit(1), F.col("policy_id").cast("int"), F.lit(1), "parts", "pass_no", "line_number",
        F.concat(F.when(place > F.col("least"), ",").otherwise(""), F.col("j")))
    return head.union(policies).union(violations).union(row(totals, 2, 0, F.lit("}}")))


def review_bundle_rows(files: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Per repository the review bundle as ordered rows: a header
    (part 0), then per file its begin mark (1), text (2) and end mark (3).
    Entries under the intake's skipped names, and files that could not be read,
    are left out and not counted; a repository without files has its header.
    ``listing`` (repo, branch, path, and read_error if some files could not be read) counts
    the files without building any text; without it a null text is a file that was not read."""
    wanted = F.coalesce(~T.in_skipped_dir(F.col("path"), fixed.BUNDLE_SKIP_NAMES), F.lit(False))
    source = listing if listing is not None else files
    unread = F.col("read_error").isNotNull() if "read_error" in source.columns else F.col("text").isNull() if listing is None else F.lit(False)
    header = (source.groupBy("repo", "branch").agg(F.count_if(wanted & ~unread).alias("n"))
              .select("repo", "branch", F.lit("").alias("path"), F.lit(0).alias("part"),
                      fmt(fixed.BUNDLE_HEADER, repo=F.col("repo"), n=F.col("n")).alias("text")))
    # the marks of an unread file are null as its text is, and go with it after the generator:
    # a filter on the text below it would build every text once more
    mark = lambda text: F.when(F.col("text").isNotNull(), text)
    body = files.where(wanted).select("repo", "branch", "path", F.posexplode(F.array(
        mark(fmt(fixed.BUNDLE_FILE_BEGIN, path=F.col("path"))),
        F.col("text"),
        mark(F.lit(fixed.BUNDLE_FILE_END)))).alias("pos", "text")) \
        .where("text IS NOT NULL").select("repo", "branch", "path", (F.col("pos") + 1).cast("int").alias("part"), "text")
    return header.unionByName(body)
