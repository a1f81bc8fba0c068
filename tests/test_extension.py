"""User extension surface: added policy, thresholds, SQL views, findings table."""

from pyspark.sql import functions as F

from rulesift.config import ScanConfig
from rulesift.plans.scan import compact_findings, read_findings, register_views, scan, write_findings


def test_added_policy_and_thresholds(files_df):
    cfg = ScanConfig(min_code_lines=2, max_ratio=1).with_policy(
        8, "No Print Debugging", [(r"\bprint\s*\(", "print() call")], requires=("print",))
    text = "# c\nx = 1\nprint(x)\ny = 2\n"
    res = scan(files_df([("a/loader_job.py", text)]), cfg)
    got = sorted((r.policy_id, r.line_number, r.description, r.severity) for r in res.findings.collect())
    assert got == [(3, 0, "Insufficient comments: 1 comment(s) for 3 code lines (ratio 1:3, expected ≤1:20)",
                    "warning"), (8, 3, "print() call", "error")]
    assert res.policy_summary.count() == 8


def test_sql_views_and_findings_table(spark, files_df, tmp_path):
    res = scan(files_df([("a/etl.py", "x = 1\n"), ("a/loader_job.py", 'p = "/mnt/x/y"\n')]))
    register_views(res)
    n = spark.sql("SELECT count(*) AS n FROM findings f JOIN code_lines l "
                  "ON f.file_path = l.path AND f.line_number = l.line_number").first().n
    assert n == 1
    out = str(tmp_path / "findings")
    write_findings(res, out)
    assert read_findings(spark, out).where("repo = 'org/r'").count() == 2
    write_findings(scan(files_df([("a/etl.py", "x = 1\n")], repo="org/b")), out)
    kept = lambda: sorted((r.repo, r.file_path) for r in read_findings(spark, out).collect())
    assert kept() == [("org/b", "a/etl.py"), ("org/r", "a/etl.py"), ("org/r", "a/loader_job.py")]
    write_findings(scan(files_df([("a/loader_job.py", "x = 1\n")])), out)  # clean now
    assert kept() == [("org/b", "a/etl.py")]


def test_findings_are_merged_by_key(spark, files_df, tmp_path):
    out = str(tmp_path / "findings")
    names = ["", "1.1", "1.10", "0012", "12", None]
    two = {b: files_df([("a/load_jobs.py", 'spark.sql("CREATE SCHEMA s")\np = "/mnt/x/y"\n')], repo="1", branch=b) for b in names}
    every = two[""]
    for b in names[1:]:
        every = every.union(two[b])
    write_findings(scan(every), out, "2024-01-01 00:00:00")

    def kept(**options):
        rows = read_findings(spark, out, **options).collect()
        return sorted(((r.repo, r.branch, r.policy_id, r.line_number, r.description[:6], r.first_seen.day, r.last_seen.day) for r in rows), key=str)

    first = kept()
    assert len(first) == 12 and {(r[1], r[2]) for r in first} == {(b, p) for b in names for p in (2, 5)}
    # branch 1.1 loses the schema line, has the path one line higher and a new one; the null branch is clean now
    moved = files_df([("a/load_jobs.py", 'x = 1\np = "/mnt/x/z"\nq = "/mnt/x/y"\n')], repo="1", branch="1.1")
    clean = files_df([("a/load_jobs.py", "x = 1\n")], repo="1", branch=None)
    write_findings(scan(moved.union(clean)), out, "2024-01-05 00:00:00")
    second = kept()
    assert [x for x in second if x[1] not in ("1.1", None)] == [x for x in first if x[1] not in ("1.1", None)]
    assert [(x[2], x[3], x[5], x[6]) for x in second if x[1] == "1.1"] == [(2, 2, 1, 5), (2, 3, 5, 5)]
    assert not [x for x in second if x[1] is None]
    assert kept(branches=[("1", "1.1"), ("1", None)]) == [x for x in second if x[1] == "1.1"]
    assert len(compact_findings(spark, out)) == 2 and kept() == second
    assert read_findings(spark, str(tmp_path / "none")).collect() == []


def test_replaced_policies_leave_no_detector(files_df):
    files = files_df([("a/etl.py", "s = SparkSession\n .builder.getOrCreate()\n" + "x = 1\n" * 12)])
    cfg = ScanConfig()
    for pid in (1, 3, 6):
        cfg = cfg.with_policy(pid, f"Own {pid}", [(r"x = 1", "own")] if pid == 1 else [])
    got = {(r.policy_id, r.policy_name, r.description) for r in scan(files, cfg).findings.collect()}
    assert got == {(1, "Own 1", "own")}
    assert scan(files, cfg).policy_summary.count() == 7


def test_function_policy_and_selection(files_df):
    files = files_df([("a/etl.py", "x = 1\nlong_name_of_a_variable = 2\ny = 3\n")])
    cfg = ScanConfig().with_policy(9, "Short lines", function=lambda text, stripped: F.when(F.length(text) > 10, F.concat(F.lit("length "), F.length(text))))
    assert [(r.line_number, r.description) for r in scan(files, cfg.only(9)).findings.collect()] == [(2, "length 27")]
    assert [r.policy_id for r in scan(files, cfg.only(6)).findings.collect()] == [6]
    assert scan(files, cfg.only()).findings.collect() == []


def copied_lines(lines):
    """Lines that another file of the repository holds earlier in path order."""
    code = lines.where(F.length("stripped") > 12)
    first = code.groupBy("repo", "branch", "stripped").agg(F.min("path").alias("first"))
    return code.join(first, ["repo", "branch", "stripped"]).where("path > first").select("repo", "branch", "path", "line_number", F.col("line").alias("line_content"), F.concat(F.lit("copied from "), "first").alias("description"), F.lit("warning").alias("severity"))


def test_policy_over_all_lines(files_df):
    from rulesift.operators import chunks

    line = "value = compute_the_value(1)"
    files = files_df([("a/load_jobs.py", f"x = 1\n{line}\n"), ("b/save_jobs.py", f"# c\n\n  {line}\n"), ("c/etl.py", f"{line}\n{line}" + "y" * 200 + "\n"), ("venv/x.py", line)])
    cfg = ScanConfig().with_policy(9, "No Copies", frame=copied_lines)
    got = scan(files, cfg)
    want = [("b/save_jobs.py", 3, f"  {line}", "copied from a/load_jobs.py", "warning"), ("c/etl.py", 1, line, "copied from a/load_jobs.py", "warning")]
    own = lambda df: sorted((r.file_path, r.line_number, r.line_content, r.description, r.severity) for r in df.collect() if r.policy_id == 9)
    assert own(got.findings) == want and {r.policy_name for r in got.findings.where("policy_id = 9").collect()} == {"No Copies"}
    assert {r.policy_id: r.status for r in got.policy_summary.collect()}[9] == "warning"
    assert own(scan(files, cfg.only(9)).findings) == want and scan(files, cfg.only(9)).findings.count() == 2
    assert sorted(r.policy_id for r in scan(files, cfg.without(9)).findings.collect()) == sorted(r.policy_id for r in scan(files).findings.collect())
    assert own(scan(files, cfg.with_policy(9, "None", [])).findings) == []
    assert own(chunks.find_chunks(chunks.cut(files, 1), cfg)) == want


def test_lists_are_parameters(files_df):
    files = files_df([("build/load_jobs.py", 'p = "/mnt/x/y"\n'), ("venv/load_jobs.py", 'p = "/mnt/x/y"\n'), ("a/etl.py", "x = 1\n"), ("a/setup.py", "x = 1\n"), ("a/Setup.py", "x = 1\n"), ("a/nb.py", "x = 1\n")])
    plain = scan(files)
    assert plain.scan_totals.first().files_scanned == 5
    assert sorted((r.policy_id, r.file_path) for r in plain.findings.collect()) == [(2, "build/load_jobs.py"), (6, "a/etl.py"), (6, "a/nb.py")]
    own = scan(files, ScanConfig(skip_dirs=("build",), exempt_names=("etl", "nb")))
    assert own.scan_totals.first().files_scanned == 5
    assert sorted((r.policy_id, r.file_path) for r in own.findings.collect()) == [(2, "venv/load_jobs.py")]
    names = scan(files, ScanConfig(exempt_names=()))
    assert sorted(r.file_path for r in names.findings.collect() if r.policy_id == 6) == ["a/etl.py", "a/nb.py"]
    none = scan(files, ScanConfig(skip_dirs=("a", "build", "venv")))
    assert none.findings.collect() == [] and none.scan_totals.first().files_scanned == 0
