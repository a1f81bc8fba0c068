"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir)``.

Every query reads the driver tables (the code corpus is computed from
``orders``; prose from ``documents``; URLs from ``pages``; scan events from
``events``) over whole tables, so its work grows with them.  Column names and
types match the DuckDB statements in ``rulesift.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesift import fixed
from rulesift.config import ScanConfig
from rulesift.functions import text as T
from rulesift.operators import catalog as CAT
from rulesift.operators import chunks as CH
from rulesift.operators import detectors as D
from rulesift.operators import lines as L
from rulesift.operators import summary as S
from rulesift.plans import report as R
from rulesift.plans.scan import read_findings, scan, write_findings
from rulesift.sources import corpus as C
from rulesift.sources import tables as TB
from rulesift.sources.price_list import parse_price_lines
from rulesift.session import scratch_path
from rulesift.streaming import incremental, scanlog

SCAN_TS = R.FIXED_SCAN_TS
CFG = ScanConfig()


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return C.load_corpus(spark, sf)


def _scan(spark: SparkSession, sf: str, cfg: ScanConfig = CFG):
    return scan(_corpus(spark, sf), cfg)


def _findings(spark, sf, *policy_ids):
    """Findings of these policies, by a scan that builds their detectors alone."""
    return _scan(spark, sf, CFG.only(*policy_ids) if policy_ids else CFG).findings


def _corpus_lines(spark, sf):
    """Corpus lines as the scan sees them: pruned, split from the file text."""
    prepared = L.with_line_arrays(L.prune(_corpus(spark, sf), CFG.skip_dirs))
    return L.explode_lines(prepared)


# -- sources / scalar functions -----------------------------------------------

def scan_prune(spark, sf):
    return L.prune(_corpus(spark, sf), CFG.skip_dirs).select("repo", "branch", "path")


def scan_size_limit(spark, sf):
    files = L.within_limit(L.prune(_corpus(spark, sf), CFG.skip_dirs))
    return files.select("repo", "branch", "path", "length")


def line_split(spark, sf):
    return TB.document_lines(TB.load_documents(spark, sf)).select("doc_id", "line_number", "line")


def strip_lines(spark, sf):
    return TB.document_lines(TB.load_documents(spark, sf)).select(
        "doc_id", "line_number", T.py_strip(F.col("line")).alias("stripped"))


def comment_filter(spark, sf):
    lines = _corpus_lines(spark, sf)
    return lines.where(~T.is_comment_line(F.col("stripped"))).select("repo", "branch", "path", "line_number")


def code_part(spark, sf):
    lines = _corpus_lines(spark, sf)
    return (lines.where(F.instr("line", "#") > 0)
            .select("repo", "branch", "path", "line_number", T.code_part(F.col("line")).alias("code_part")))


def repo_name(spark, sf):
    """Clone URLs computed from the pages' ids, and the pages' own URLs."""
    url = F.expr("""CASE page_id % 4 WHEN 0 THEN concat('https://github.com/org/r', page_id, '.git')
        WHEN 1 THEN concat('http://github.com/org/r', page_id, '/') WHEN 2 THEN concat(url, '.git') ELSE url END""")
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", url.alias("url"))
    return pages.select("page_id", "url", T.repo_name_from_url(F.col("url")).alias("repo_name"))


# -- detectors ------------------------------------------------------------------

def policy1_session_line(spark, sf):
    return scan(_corpus(spark, sf), replace(CFG.only(1), multiline_session=False)).findings


def policy1_session_multiline(spark, sf):
    return _findings(spark, sf, 1).where(F.col("description") == fixed.P1_DESC_MULTI)


def policy1_session(spark, sf):
    return _findings(spark, sf, 1)


def policy2_secrets(spark, sf):
    return _findings(spark, sf, 2)


def policy2_documents(spark, sf):
    docs = TB.documents_as_files(TB.load_documents(spark, sf))
    return scan(docs, CFG.only(2)).findings


def policy3_comment_density(spark, sf):
    return _findings(spark, sf, 3)


def policy4_formats(spark, sf):
    return _findings(spark, sf, 4)


def policy5_schema(spark, sf):
    return _findings(spark, sf, 5)


def policy6_file_names(spark, sf):
    return _findings(spark, sf, 6)


def policy7_downloads(spark, sf):
    return _findings(spark, sf, 7)


def all_findings(spark, sf):
    return _findings(spark, sf)


def chunked_findings(spark, sf):
    """All findings by the associative scan, with files in chunks of seven lines."""
    return CH.find_chunks(CH.cut(_corpus(spark, sf), 7), CFG)


# -- windows (state machines) --------------------------------------------------------

def docstring_parity(spark, sf):
    return _corpus_lines(spark, sf).select("repo", "branch", "path", "line_number",
                                           F.col("in_docstring").cast("int").alias("in_docstring"))


def docstring_state(spark, sf):
    prepared = L.with_comment_counts(L.with_line_arrays(L.prune(_corpus(spark, sf), CFG.skip_dirs)))
    return (prepared.select("repo", "branch", "path", F.posexplode(F.arrays_zip("w2")).alias("pos", "z"))
            .select("repo", "branch", "path", (F.col("pos") + 1).cast("int").alias("line_number"),
                    F.col("z.w2").cast("int").alias("state")))


def first_rule(spark, sf):
    rule_sets = [rs for rs in CFG.rule_sets if rs.policy_id in (2, 4, 5, 7)]
    sets = [(rs.policy_id, rs.rules, rs.requires) for rs in rule_sets]
    needed = D.literal_sets(rule_sets)
    files = D.with_held(L.with_line_arrays(L.prune(_corpus(spark, sf), CFG.skip_dirs)), needed)
    lines = (files.select("repo", "branch", "path", "_escaped", "_held", F.posexplode(F.arrays_zip("lines")).alias("pos", "z"))
             .select("repo", "branch", "path", "_escaped", "_held", (F.col("pos") + 1).cast("int").alias("line_number"), F.col("z.lines").alias("line"), T.fold(F.col("z.lines")).alias("folded")))
    numbered = lines.select("repo", "branch", "path", "line_number", *(
        F.when(T.held(F.col("_held"), requires, needed) & T.may_contain_any(F.col("line"), F.col("folded"), requires, F.col("_escaped")), D.first_rule_index(F.col("line"), rules, needed)).alias(f"_r{pid}") for pid, rules, requires in sets))
    some = F.coalesce(*(F.col(f"_r{pid}") for pid, _, _ in sets)).isNotNull()
    per = numbered.select("repo", "branch", "path", "line_number",
                          F.explode(F.when(some, F.array(*[F.struct(F.lit(pid).alias("policy_id"), F.col(f"_r{pid}").alias("rule_no"))
                                                           for pid, _, _ in sets]))).alias("r"))
    return (per.where(F.col("r.rule_no").isNotNull())
            .select("repo", "branch", "path", "line_number",
                    F.col("r.policy_id").cast("int").alias("policy_id"),
                    F.col("r.rule_no").cast("int").alias("rule_no")))


# -- aggregations ---------------------------------------------------------------------

def line_counts(spark, sf):
    return _scan(spark, sf).line_counts


def policy_summary(spark, sf):
    return _scan(spark, sf).policy_summary


def scan_totals(spark, sf):
    return _scan(spark, sf).scan_totals


def overall_status(spark, sf):
    return R.overall_lines(_scan(spark, sf).scan_totals)


def files_scanned(spark, sf):
    return _scan(spark, sf).file_counts


def gate(spark, sf):
    return _scan(spark, sf).gate


def policy_file_counts(spark, sf):
    return _scan(spark, sf).policy_file_counts


def org_policy_summary(spark, sf):
    return _scan(spark, sf).org_policy_summary


def review_bundle(spark, sf):
    files = _corpus(spark, sf)
    return R.review_bundle_rows(files, listing=files.select("repo", "branch", "path"))


def file_order(spark, sf):
    return S.file_order(L.prune(_corpus(spark, sf), CFG.skip_dirs))


def report_markdown(spark, sf):
    return R.markdown_rows(_scan(spark, sf).materialize(), scan_ts=SCAN_TS)


#: An added policy whose description holds pipes.
PIPE_POLICY = (8, "No f | g", r"= f\(v\)$", "f(v) | g(v) || h(v)")


def report_pipes(spark, sf):
    """The report's findings of a policy whose description has to be escaped."""
    pid, name, pattern, description = PIPE_POLICY
    cfg = CFG.only().with_policy(pid, name, [(pattern, description)])
    rows = R.markdown_rows(_scan(spark, sf, cfg).materialize(), scan_ts=SCAN_TS)
    return rows.where((F.col("policy_id") == pid) & (F.col("section") == 4) & (F.col("sub") == 1)).select("repo", "branch", "file_path", "line_number", "text")


def shared_secrets(lines):
    """Lines that assign a secret which a file earlier in path order assigns too (a policy over all lines)."""
    held = lines.where((F.col("in_docstring") == 0) & F.col("stripped").rlike('^token = "'))
    first = held.groupBy("repo", "branch", "stripped").agg(F.min("path").alias("first"))
    again = held.join(first, ["repo", "branch", "stripped"]).where("path > first")
    return again.select("repo", "branch", "path", "line_number", F.col("stripped").alias("line_content"), F.concat(F.lit("Secret shared with "), "first").alias("description"))


def frame_policy(spark, sf):
    """A policy that joins the lines of all files."""
    return _scan(spark, sf, CFG.only().with_policy(8, "No Shared Secrets", frame=shared_secrets)).findings


def report_json(spark, sf):
    rows = R.json_rows(_scan(spark, sf).materialize(), scan_ts=SCAN_TS)
    return rows.withColumn("file_path", F.array_join("parts", "/")).drop("parts")


#: Branch and commit names that look alike, or like numbers, and none at all.
BRANCH_NAMES = ["", "1.1", "1.10", "0012", None]
COMMIT_NAMES = ["12e5", "0012", "c1"]


def _order_key(path="path"):
    """The order's key in a corpus path."""
    return F.regexp_extract(path, "/m([0-9]+)/", 1).cast("long")


def _named(files):
    """The corpus under the names of ``BRANCH_NAMES``, by the order's key."""
    return files.withColumn("branch", F.element_at(F.array(*map(F.lit, BRANCH_NAMES)), (_order_key() % len(BRANCH_NAMES) + 1).cast("int")))


def _landed_at(path="path"):
    """A time of landing in seven days of January 2024, computed from the order's key."""
    key = _order_key(path)
    return F.timestamp_seconds(F.lit(1704067200) + (key % 7) * 86400 + key % 86400)


def _incremental(spark, sf):
    """The corpus landed as commits in many files, scanned in about four batches; the folder of what is kept."""
    base = scratch_path(spark, "incremental")
    commit = F.element_at(F.array(*map(F.lit, COMMIT_NAMES)), (_order_key() % len(COMMIT_NAMES) + 1).cast("int"))
    files = _named(_corpus(spark, sf)).select("repo", "branch", commit.alias("commit"), "path", "text", _landed_at().alias("scan_ts"))
    files.write.parquet(f"{base}/landing")
    per_batch = -(-len(spark.read.parquet(f"{base}/landing").inputFiles()) // 4)
    schema = f"{incremental.SNAPSHOT_SCHEMA}, scan_ts timestamp"
    incremental.start_incremental_scan(spark, f"{base}/landing", f"{base}/out", f"{base}/stream", files_per_batch=per_batch, schema=schema).awaitTermination()
    return f"{base}/out"


def incremental_totals(spark, sf):
    return incremental.read_kept(spark, _incremental(spark, sf), "scan_totals").select(
        "repo", "branch", "commit", "files_scanned", "overall_status", "total_errors", "total_warnings")


def incremental_findings(spark, sf):
    return incremental.read_kept(spark, _incremental(spark, sf), "findings").select(
        "repo", "branch", "commit", "policy_id", "file_path", "line_number", "description")


def findings_log(spark, sf):
    """Closed days of the stream of findings that the incremental scan keeps."""
    out, log = _incremental(spark, sf), scratch_path(spark, "findings_log")
    scanlog.start_findings_log(spark, out, f"{log}/days", f"{log}/stream").awaitTermination()
    return spark.read.schema("day string, repo string, policy_id int, findings long").parquet(f"{log}/days")


def kept_findings(spark, sf):
    """Findings kept from two scans: all branches without policy 4, then two of the branches without policy 5."""
    path = scratch_path(spark, "kept_findings")
    files = _named(_corpus(spark, sf))
    again = files.where("branch IS NULL OR branch = '1.1'")
    write_findings(scan(files, CFG.without(4)), path, "2024-01-01 00:00:00")
    write_findings(scan(again, CFG.without(5)), path, "2024-02-01 00:00:00")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return read_findings(spark, path).select("repo", "branch", "policy_id", "file_path", "line_number", "description", "severity", day("first_seen"), day("last_seen"))


# -- price catalog: list lines computed from part ---------------------------------------

def _models(spark, sf):
    paid = ["0", "0.33", "1", "5", "10", fixed.PRICE_NOT_APPLICABLE]
    k = F.col("p_partkey")
    lines = F.array(
        F.concat(F.lit(f"{fixed.PRICE_NAME_KEY} GPT "), k % 97, F.lit(" (v"), k % 5, F.lit(")")),
        F.concat(F.lit(f"  {fixed.PRICE_PAID_KEY} "), F.element_at(F.array(*map(F.lit, paid)), (k % 6 + 1).cast("int"))),
        F.when(k % 3 == 0, F.lit(f"  {fixed.PRICE_FREE_KEY} 1")).when(k % 3 == 1, F.lit(f"  {fixed.PRICE_FREE_KEY} {fixed.PRICE_NOT_APPLICABLE}")).otherwise(""))
    parts = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("list"), k % 4).alias("source"), k, F.posexplode(lines).alias("j", "line"))
    return CAT.model_catalog(parse_price_lines(parts.select("source", (k * 10 + F.col("j")).alias("line_number"), "line")))


def model_slug(spark, sf):
    return _models(spark, sf).select("id", "name")


def model_tier(spark, sf):
    return _models(spark, sf).select("id", "multiplier", "tier")


def model_cost(spark, sf):
    return _models(spark, sf).select("id", "cost", "overage", "ui_label", "ui_badge", "option_text")


def model_resolve(spark, sf):
    o = F.col("o_orderkey")
    asked = spark.read.parquet(f"{sf}/orders.parquet").select(o, F.concat(F.lit("gpt-"), o % 120, F.lit("-v"), o % 5).alias("model"))
    return CAT.resolve_models(asked, _models(spark, sf)).select("o_orderkey", "model_id", "multiplier", "name")


def scan_log(spark, sf):
    return scanlog.daily_scan_log(scanlog.scan_events(spark.read.parquet(f"{sf}/events.parquet")))


def daily_findings(spark, sf):
    """Findings per repository, policy and day; the day of a scan is computed from the order's key in the path."""
    return scanlog.daily_findings(_findings(spark, sf).withColumn("scan_ts", _landed_at("file_path")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_prune": scan_prune,
    "scan_size_limit": scan_size_limit,
    "line_split": line_split,
    "strip_lines": strip_lines,
    "comment_filter": comment_filter,
    "code_part": code_part,
    "repo_name": repo_name,
    "policy1_session_line": policy1_session_line,
    "policy1_session_multiline": policy1_session_multiline,
    "policy1_session": policy1_session,
    "policy2_secrets": policy2_secrets,
    "policy2_documents": policy2_documents,
    "policy3_comment_density": policy3_comment_density,
    "policy4_formats": policy4_formats,
    "policy5_schema": policy5_schema,
    "policy6_file_names": policy6_file_names,
    "policy7_downloads": policy7_downloads,
    "all_findings": all_findings,
    "chunked_findings": chunked_findings,
    "docstring_parity": docstring_parity,
    "docstring_state": docstring_state,
    "first_rule": first_rule,
    "line_counts": line_counts,
    "policy_summary": policy_summary,
    "scan_totals": scan_totals,
    "overall_status": overall_status,
    "files_scanned": files_scanned,
    "gate": gate,
    "policy_file_counts": policy_file_counts,
    "org_policy_summary": org_policy_summary,
    "review_bundle": review_bundle,
    "file_order": file_order,
    "report_markdown": report_markdown,
    "report_json": report_json,
    "report_pipes": report_pipes,
    "frame_policy": frame_policy,
    "incremental_totals": incremental_totals,
    "incremental_findings": incremental_findings,
    "findings_log": findings_log,
    "kept_findings": kept_findings,
    "model_slug": model_slug,
    "model_tier": model_tier,
    "model_cost": model_cost,
    "model_resolve": model_resolve,
    "scan_log": scan_log,
    "daily_findings": daily_findings,
}
