"""Golden cases (FIXTURES.md F-3): one small file per rule and per quirk."""

from rulesift import fixed
from rulesift.plans.scan import scan


def findings(files_df, items, policy=None):
    res = scan(files_df(items)).findings
    if policy is not None:
        res = res.where(f"policy_id = {policy}")
    return sorted((r.policy_id, r.file_path, r.line_number, r.description, r.severity, r.line_content)
                  for r in res.collect())


def test_session_on_one_line(files_df):
    got = findings(files_df, [("jobs/load_data.py", 's = SparkSession.builder.appName("a").getOrCreate()\n')], 1)
    assert got == [(1, "jobs/load_data.py", 1, fixed.P1_DESC_LINE, "error",
                    's = SparkSession.builder.appName("a").getOrCreate()')]


def test_session_split_after_class_name(files_df):
    got = findings(files_df, [("jobs/load_data.py", "s = SparkSession\n    .builder.getOrCreate()\n")], 1)
    assert got == [(1, "jobs/load_data.py", 1, fixed.P1_DESC_MULTI, "error", "s = SparkSession")]


def test_session_split_across_blank_lines(files_df):
    got = findings(files_df, [("jobs/load_data.py", "x = 1\ns = SparkSession\n\n\n  .builder.getOrCreate()\n")], 1)
    assert [(g[2], g[3]) for g in got] == [(2, fixed.P1_DESC_MULTI)]


def test_session_split_between_builder_and_get_or_create(files_df):
    text = "s = (SparkSession.builder\n     .appName('x')\n     .getOrCreate())\n"
    assert findings(files_df, [("jobs/load_data.py", text)], 1) == []


def test_commented_session_found_by_multiline_pass(files_df):
    got = findings(files_df, [("jobs/load_data.py", "# SparkSession.builder.getOrCreate()\n")], 1)
    assert got == [(1, "jobs/load_data.py", 1, fixed.P1_DESC_MULTI, "error",
                    "# SparkSession.builder.getOrCreate()")]


def test_jdbc_postgresql_url_not_found(files_df):
    assert findings(files_df, [("jobs/load_data.py", 'u = "jdbc:postgresql://h/d"\n')], 2) == []


def test_two_rules_one_line_first_wins(files_df):
    got = findings(files_df, [("jobs/load_data.py", 'password = "/mnt/raw/secret"\n')], 2)
    assert [g[3] for g in got] == ["Hardcoded file path"]


def test_secret_after_hash_in_docstring_and_quote_line(files_df):
    text = ('x = 1  # token = "abcd1234"\n'
            '"""\n'
            'token = "abcd1234"\n'
            '"""\n'
            'q = """token = "abcd1234" """\n')
    assert findings(files_df, [("jobs/load_data.py", text)], 2) == []


def test_secret_after_docstring_found(files_df):
    text = '"""\ndoc\n"""\ntoken = "abcd1234"\n'
    got = findings(files_df, [("jobs/load_data.py", text)], 2)
    assert [(g[2], g[3]) for g in got] == [(4, "Hardcoded password/secret")]


def test_format_in_docstring_still_found(files_df):
    text = '"""\ndf.write.format("parquet").save(p)\n"""\n'
    got = findings(files_df, [("jobs/load_data.py", text)], 4)
    assert [(g[2], g[3]) for g in got] == [(2, "Non-Delta write format specified")]


def _code(n):
    return "".join(f"v{i} = f(v)\n" for i in range(n))


def test_comment_density_thresholds(files_df):
    items = [
        ("a/ten_lines.py", _code(10)),
        ("a/eleven_lines.py", _code(11)),
        ("a/twenty_to_one.py", "# c\n" + _code(20)),
        ("a/half_ratio.py", "# c\n# d\n" + _code(41)),
        ("a/twenty_one.py", "# c\n" + _code(21)),
    ]
    got = {g[1]: (g[3], g[4]) for g in findings(files_df, items, 3)}
    assert set(got) == {"a/eleven_lines.py", "a/half_ratio.py", "a/twenty_one.py"}
    assert got["a/eleven_lines.py"] == (fixed.P3_DESC_NONE.format(code=11), "error")
    assert got["a/half_ratio.py"][0].endswith("(ratio 1:20, expected ≤1:20)")
    assert got["a/half_ratio.py"][1] == "warning"
    assert "(ratio 1:21," in got["a/twenty_one.py"][0]


def test_closing_quotes_of_assignment_open_a_docstring(files_df):
    # `q = """` does not open (marker mid-line); the lone `"""` then opens one,
    # so the 12 code lines after it count as comments
    text = 'q = """\nx\n"""\n' + _code(12)
    assert findings(files_df, [("a/loader_job.py", text)], 3) == []


def test_file_names(files_df):
    names = ["etl", "1", "Script", "my_file", "setup", "Setup", "a.b", "customer_dim", "__init__"]
    got = findings(files_df, [(f"pkg/{n}.py", "x = 1\n") for n in names], 6)
    flagged = sorted(g[1] for g in got)
    # Setup.py misses the (case-sensitive) exemption, then passes the name test
    assert flagged == sorted(["pkg/etl.py", "pkg/1.py", "pkg/Script.py", "pkg/my_file.py"])


def test_pruned_directories(files_df):
    res = scan(files_df([("node_modules/x/load_data.py", "import os\n"), ("src/venv/lib/etl.py", "x\n"),
                         ("src/jobs/etl.py", "x\n")]))
    assert [r.files_scanned for r in res.scan_totals.collect()] == [1]
    assert [r.file_path for r in res.findings.collect()] == ["src/jobs/etl.py"]


def test_repo_without_files_passes(spark):
    files = spark.createDataFrame([], "repo string, branch string, path string, text string")
    listing = spark.createDataFrame([("org/empty", "main", None)], "repo string, branch string, path string")
    res = scan(files, listing=listing)
    summary = res.policy_summary.collect()
    assert len(summary) == 7 and {r.status for r in summary} == {"pass"}
    assert [(r.overall_status, r.files_scanned) for r in res.scan_totals.collect()] == [("pass", 0)]


def test_line_boundaries_like_splitlines(files_df):
    text = 'a = 1\r\nb = 2\x0bc = 3\x0cd = 4 token = "abcd1234"\n'
    got = findings(files_df, [("a/loader_job.py", text)], 2)
    assert [g[2] for g in got] == [5]


def test_summary_and_gate(files_df):
    res = scan(files_df([("a/etl.py", 'spark.sql("CREATE SCHEMA s")\n'), ("a/loader_job.py", "x = 1\n")]))
    summ = {r.policy_id: (r.status, r.errors, r.files_checked) for r in res.policy_summary.collect()}
    assert summ[5] == ("fail", 1, 2) and summ[6] == ("fail", 1, 2) and summ[7] == ("pass", 0, 2)
    assert [r.gate_failed for r in res.gate.collect()] == [True]


def test_unicode_case_folding_letters_still_match(files_df):
    # U+017F (long s) and U+212A (Kelvin sign) match 's' and 'k' case-insensitively
    text = "s = ſparkSession.builder.getOrCreate()\nos.ſyſtem('wget x')\n"
    got = findings(files_df, [("jobs/load_data.py", text)])
    assert [(g[0], g[2]) for g in got] == [(1, 1), (7, 2)]
