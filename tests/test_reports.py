"""Markdown text, report writer, JSON report, review bundle."""

import json

import pytest

from rulesift.config import ScanConfig
from rulesift.plans import report as R
from rulesift.plans.scan import scan

FILES = [("a/etl.py", 'spark.sql("CREATE SCHEMA s")\n'),
         ("a/loader_job.py", 'x = 1\ns = SparkSession\n  .builder.getOrCreate()\n'),
         ("a/b|c/data_job.py", "y = 2\n")]


def document(rows, key):
    """One repository's report from its rows."""
    return "\n".join(r.text for r in rows.orderBy(*key).collect())


def written(spark, out, repo="org/r", branch="main"):
    parts = R.report_parts(spark, out, [(repo, branch)]).orderBy("part").collect()
    assert [p.part for p in parts] == list(range(1, len(parts) + 1))
    return "".join(open(p.file.removeprefix("file:")).read() for p in parts).rstrip("\n")


def test_markdown_text_layout(files_df):
    res = scan(files_df(FILES))
    text = document(R.markdown_rows(res), R.ORDER_KEY)
    lines = text.split("\n")
    assert lines[0] == "# 📋 Policy Review Report"
    assert "| **Repository** | `org/r` |" in lines and "| **Files Scanned** | 3 Python file(s) |" in lines
    assert "## ❌ Overall Result: **FAIL**" in lines
    assert "> 3 error(s), 0 warning(s) across 3 file(s)" in lines
    assert "| 5 | No Schema Creation | ❌ Fail | 1 | 0 |" in lines
    i = lines.index("### Policy 1: No Global SparkSession ❌")
    assert lines[i + 2:i + 6] == ["> **1 violation(s)** in **1 file(s)**", "",
                                  "| Sev | File | Line | Finding |", "|:---:|------|:----:|---------|"]
    assert lines[i + 6] == ("| 🔴 | `a/loader_job.py` | 2 | Global SparkSession created via "
                            "SparkSession.builder...getOrCreate() (multi-line) |")
    assert "| 🔴 | `a/etl.py` | — | Non-descriptive filename: 'etl.py' |" in lines
    assert lines.count("> No violations found. ✔️") == 4
    assert lines[-1] == "*Report generated by rulesift • 2024-01-01 00:00:00 UTC*"


def test_write_report(spark, files_df, tmp_path):
    res = scan(files_df(FILES))
    R.write_report(R.markdown_rows(res), str(tmp_path / "md"), partitions=3)
    assert written(spark, str(tmp_path / "md")) == document(R.markdown_rows(res), R.ORDER_KEY)
    assert R.report_parts(spark, str(tmp_path / "md")).count() > 1
    R.write_report(R.json_rows(res), str(tmp_path / "json"), key=R.JSON_KEY, partitions=3)
    assert json.loads(written(spark, str(tmp_path / "json"))) == json.loads(document(R.json_rows(res), R.JSON_KEY))


def test_reports_are_replaced_by_repository_and_branch(spark, files_df, tmp_path, monkeypatch):
    out, names = str(tmp_path / "md"), [("org/r", "main"), ("org/r", "1.10"), ("org/r", "1.1"), ("org/r", ""), ("0012", None), ("12", None)]
    rows = {n: R.markdown_rows(scan(files_df(FILES[k % 3:], repo=n[0], branch=n[1]))) for k, n in enumerate(names)}
    texts = {n: document(r, R.ORDER_KEY) for n, r in rows.items()}
    every = rows[names[0]]
    for n in names[1:]:
        every = every.union(rows[n])
    R.write_report(every, out)
    assert {n: written(spark, out, *n) for n in names} == texts
    again = R.markdown_rows(scan(files_df([("a/load_jobs.py", "x = 1\n")], branch="1.1")))
    monkeypatch.setattr(R.kept, "publish", lambda *_: (_ for _ in ()).throw(OSError("the driver is lost")))
    with pytest.raises(OSError):
        R.write_report(again, out)
    monkeypatch.undo()
    assert {n: written(spark, out, *n) for n in names} == texts  # a torn write is not seen
    R.write_report(again, out)
    texts["org/r", "1.1"] = document(again, R.ORDER_KEY)
    assert {n: written(spark, out, *n) for n in names} == texts


def test_pipes_in_descriptions_are_escaped(files_df):
    cfg = ScanConfig().only().with_policy(8, "No Or", [(r"a \| b", "a | b || c: use or")])
    rows = R.markdown_rows(scan(files_df([("x|y/load_jobs.py", "t = a | b\n")]), cfg))
    assert "| 🔴 | `x|y/load_jobs.py` | 1 | a \\| b \\|\\| c: use or |" in document(rows, R.ORDER_KEY).split("\n")


def test_json_of_large_and_small_repositories(spark):
    big = [("org/big", "main", f"a/etl{i}.py", 'password = "abc"\n' * 200) for i in range(50)]
    files = spark.createDataFrame([*big, ("org/r", "main", "a/loader_job.py", "x = 1\n")], "repo string, branch string, path string, text string")
    rows = R.json_rows(scan(files))
    docs = {repo: json.loads(document(rows.where(f"repo = '{repo}'"), R.JSON_KEY)) for repo in ("org/big", "org/r")}
    assert docs["org/big"]["total_errors"] == 10_050 and len(docs["org/big"]["policies"]["2"]["violations"]) == 10_000
    assert docs["org/r"]["overall_status"] == "pass"


def test_json_policies_by_number(files_df):
    cfg = ScanConfig().with_policy(10, "Ten", [(r"x = 1", "x")]).with_policy(8, "None", [])
    doc = json.loads(document(R.json_rows(scan(files_df(FILES), cfg)), R.JSON_KEY))
    assert list(doc["policies"]) == ["1", "2", "3", "4", "5", "6", "7", "8", "10"]
    assert [v["line"] for v in doc["policies"]["10"]["violations"]] == [1]


def test_json_report(files_df):
    res = scan(files_df(FILES))
    doc = json.loads(document(R.json_rows(res), R.JSON_KEY))
    assert doc["scan_date"] == "2024-01-01T00:00:00+00:00"
    assert (doc["files_scanned"], doc["overall_status"], doc["total_errors"]) == (3, "fail", 3)
    assert list(doc["policies"]) == [str(i) for i in range(1, 8)]
    assert doc["policies"]["5"]["violations"] == [
        {"file": "a/etl.py", "line": 1, "severity": "error",
         "description": "Schema/database creation statement", "content": 'spark.sql("CREATE SCHEMA s")'}]
    assert doc["policies"]["2"] == {"name": "No Hardcoded Secrets/Paths", "status": "pass", "violations": []}


def test_review_bundle(spark):
    rows = [("org/r", "main", p, t) for p, t in FILES] + [("org/r", "main", "a/broken.py", None), ("org/none", "main", "venv/x.py", "x")]
    files = spark.createDataFrame(rows, "repo string, branch string, path string, text string")
    got = {}
    for r in R.review_bundle_rows(files).orderBy("repo", "path", "part").collect():
        got.setdefault(r.repo, []).append(r.text)
    assert got["org/none"] == ["Repository: org/none\nTotal Python files: 0"]
    assert got["org/r"][:4] == ["Repository: org/r\nTotal Python files: 3", "--- FILE: a/b|c/data_job.py ---", "y = 2\n", "--- END FILE ---"]
    assert len(got["org/r"]) == 10 and None not in got["org/r"]
