"""Fixed values.

Everything in this module must equal the behaviour being reproduced for the
results to be right: policy names, rule patterns and their descriptions (list
order is meaning: the first matching rule wins), directory and file-name lists,
report text and price-list constants.  They are stated plainly, in their natural
order, and nothing else in the package hard-codes them.

Patterns are Java regular expressions used through ``rlike`` /
``regexp_extract_all``; ``RX_FLAGS`` is prefixed to each one:
``i`` case-insensitive, ``d`` only ``\\n`` ends a line for ``.``, ``U`` Unicode
``\\s``/``\\d`` and Unicode case folding.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# FIXED VALUES -- policies
# --------------------------------------------------------------------------

POLICIES: dict[int, str] = {
    1: "No Global SparkSession",
    2: "No Hardcoded Secrets/Paths",
    3: "Adequate Code Comments",
    4: "Delta Tables Only",
    5: "No Schema Creation",
    6: "Meaningful File Names",
    7: "No Local File Downloads",
}

RX_FLAGS = "(?idU)"

# Policy 1: session builder chain ending in getOrCreate(.
P1_PATTERN = r"SparkSession\s*\.\s*builder.*\.getOrCreate\s*\("
P1_DESC_LINE = "Global SparkSession created via SparkSession.builder.getOrCreate()"
P1_DESC_MULTI = "Global SparkSession created via SparkSession.builder...getOrCreate() (multi-line)"

# Policy 2: hardcoded secrets and paths (checked on the code part of a line).
P2_RULES: list[tuple[str, str]] = [
    (r"""['\"]\/(?:mnt|dbfs|tmp|data|home|usr|opt|var|etc)\/[^'\"]+['\"]""", "Hardcoded file path"),
    (r"""['\"][A-Z]:\\[^'\"]+['\"]""", "Hardcoded Windows file path"),
    (r"""['\"]s3[a]?:\/\/[^'\"]+['\"]""", "Hardcoded S3 path"),
    (r"""['\"]abfss?:\/\/[^'\"]+['\"]""", "Hardcoded Azure storage path"),
    (r"""['\"]gs:\/\/[^'\"]+['\"]""", "Hardcoded GCS path"),
    (r"""['\"]wasbs?:\/\/[^'\"]+['\"]""", "Hardcoded Azure Blob path"),
    (r"""(?:password|passwd|pwd|secret|api_key|apikey|api_secret|access_key|private_key|token)\s*=\s*['\"][^'\"]{3,}['\"]""",
     "Hardcoded password/secret"),
    (r"""['\"][a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}['\"]""", "Hardcoded email address"),
    (r"""['\"](?:jdbc|mongodb(\+srv)?|postgresql|mysql|redis|amqp):\/\/[^'\"]+['\"]""",
     "Hardcoded connection string"),
    (r"""['\"](?:\d{1,3}\.){3}\d{1,3}(?::\d+)?['\"]""", "Hardcoded IP address"),
]

# Policy 3: comment density.
P3_MIN_CODE_LINES = 10      # files with at most this many code lines are not judged
P3_MAX_RATIO = 20           # code/comment above this is a warning; exactly 20 passes
P3_DESC_NONE = "No comments found in file with {code} code lines (expected ≥1 comment per 20 lines)"
P3_DESC_LOW = ("Insufficient comments: {comment} comment(s) for {code} code lines "
               "(ratio 1:{ratio}, expected ≤1:20)")

# Policy 4: non-Delta formats.
P4_RULES: list[tuple[str, str]] = [
    (r"""\.format\s*\(\s*['\"](?:parquet|csv|json|orc|avro|text)['\"]""", "Non-Delta write format specified"),
    (r"""CREATE\s+(?:EXTERNAL\s+)?TABLE\s+.*?\s+USING\s+(?:parquet|csv|json|orc|avro|text)""",
     "CREATE TABLE using non-Delta format"),
    (r"""STORED\s+AS\s+(?:PARQUET|CSV|JSON|ORC|AVRO|TEXTFILE)""", "Table stored as non-Delta format"),
]

# Policy 5: schema creation.
P5_RULES: list[tuple[str, str]] = [
    (r"""CREATE\s+(?:SCHEMA|DATABASE)""", "Schema/database creation statement"),
    (r"""spark\.sql\s*\(\s*['\"].*?CREATE\s+(?:SCHEMA|DATABASE)""", "Schema/database creation via spark.sql()"),
    (r"""\.createDatabase\s*\(""", "createDatabase() API call"),
]

# Policy 6: file names.
P6_BAD_NAME = (r"^(?:[a-z]|[a-z]{2,3}|\d+|test|temp|tmp|foo|bar|baz|xxx|zzz|"
               r"untitled|new|script|code|file|my_?file|my_?script|"
               r"notebook|nb|note|draft|scratch|playground|sandbox)$")
P6_DESC = "Non-descriptive filename: '{name}'"
EXEMPT_FILENAMES = ("__init__", "__main__", "setup", "conftest", "manage",
                    "wsgi", "asgi", "fabfile", "tasks", "celery")

# Policy 7: downloads to the local machine.
P7_RULES: list[tuple[str, str]] = [
    (r"""urllib\.request\.urlretrieve""", "urllib file download to local VM"),
    (r"""urllib\.request\.urlopen""", "urllib URL open (potential local download)"),
    (r"""requests\.get\s*\(.*(?:stream|content)""", "HTTP download to local VM"),
    (r"""wget\s*\(""", "wget download to local VM"),
    (r"""subprocess.*(?:curl|wget)""", "subprocess curl/wget download"),
    (r"""os\.system\s*\(.*(?:curl|wget)""", "os.system curl/wget download"),
    (r"""shutil\.copyfileobj""", "shutil file copy (potential download)"),
    (r"""dbutils\.fs\.cp\s*\(.*['\"]file:/""", "Copying to local filesystem via dbutils"),
    (r"""gdown\.download""", "Google Drive download to local VM"),
    (r"""tf\.keras\.utils\.get_file""", "Keras file download to local VM"),
    (r"""torch\.hub\.download""", "PyTorch hub download to local VM"),
]

# Directories never scanned (a file is dropped if any path part equals one).
# The reference list has one more entry: the scanner's own install folder.
# Add it through ScanConfig.skip_dirs when needed.
SKIP_DIRS = (".git", "__pycache__", ".venv", "venv", "env", ".env",
             "node_modules", ".tox", ".mypy_cache", ".pytest_cache",
             "site-packages", ".github")

# Entry names skipped by the review-bundle intake (web variant).
BUNDLE_SKIP_NAMES = (".git", "__pycache__", "venv", ".venv", "node_modules", "env", ".env")

# Archive intake limit (bytes).
MAX_ARCHIVE_BYTES = 50 * 1024 * 1024

# Characters removed by Python's str.strip() (str.isspace() is true).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")

# Line boundaries of Python's str.splitlines(), as a Java regex.
LINE_BREAK_RX = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

LINE_CONTENT_MAX = 150

# --------------------------------------------------------------------------
# FIXED VALUES -- report text
# --------------------------------------------------------------------------

REPORT_TITLE = "# 📋 Policy Review Report"
REPORT_READ_ONLY = "> **⚠️ This is a READ-ONLY report. No files were modified.**"
REPORT_OVERALL = {
    "pass": "## ✅ Overall Result: **PASS**",
    "fail": "## ❌ Overall Result: **FAIL**",
    "warning": "## ⚠️ Overall Result: **WARNINGS**",
}
STATUS_CELL = {"pass": "✅ Pass", "fail": "❌ Fail", "warning": "⚠️ Warn"}
STATUS_ICON = {"pass": "✅", "fail": "❌", "warning": "⚠️"}
SEVERITY_ICON = {"error": "🔴", "warning": "🟡"}
NO_VIOLATIONS = "> No violations found. ✔️"
WHOLE_FILE_LINE = "—"
POLICY_REFERENCE_ROWS = (
    "| 1 | No Global SparkSession | Must not use `SparkSession.builder.getOrCreate()` |",
    "| 2 | No Hardcoded Secrets/Paths | Must not hardcode file paths, passwords, emails, IPs, or connection strings |",
    "| 3 | Adequate Code Comments | ~1 comment per 10-20 lines of code |",
    "| 4 | Delta Tables Only | All Databricks tables must use Delta format |",
    "| 5 | No Schema Creation | Must not CREATE SCHEMA or CREATE DATABASE |",
    "| 6 | Meaningful File Names | No single-char, numeric, or generic filenames |",
    "| 7 | No Local File Downloads | Must not download files to local VM |",
)
REPORT_FIELDS = ("| Field | Value |", "|-------|-------|")
REPORT_REPOSITORY = "| **Repository** | `{repo}` |"
REPORT_BRANCH = "| **Branch** | `{branch}` |"
REPORT_SCAN_DATE = "| **Scan Date** | {now} |"
REPORT_FILES = "| **Files Scanned** | {n} Python file(s) |"
REPORT_COUNTS = "> {errors} error(s), {warnings} warning(s) across {n} file(s)"
REPORT_RULER = "---"
REPORT_SUMMARY_TITLE = "## Policy Summary"
REPORT_SUMMARY_HEAD = ("| # | Policy | Status | Errors | Warnings |", "|:-:|--------|:------:|:------:|:--------:|")
REPORT_SUMMARY_ROW = "| {id} | {name} | {status} | {errors} | {warnings} |"
REPORT_FINDINGS_TITLE = "## Detailed Findings"
REPORT_POLICY_TITLE = "### Policy {id}: {name} {icon}"
REPORT_VIOLATIONS = "> **{violations} violation(s)** in **{files} file(s)**"
REPORT_FINDING_HEAD = ("| Sev | File | Line | Finding |", "|:---:|------|:----:|---------|")
REPORT_FINDING_ROW = "| {icon} | `{file}` | {line} | {description} |"
REPORT_REFERENCE_TITLE = "## 📖 Policy Definitions Reference"
REPORT_REFERENCE_HEAD = ("| # | Policy | Rule |", "|:-:|--------|------|")
# The footer names the generating tool; ours is a parameter of the report.
REPORT_FOOTER = "*Report generated by {generator} • {now}*"
REPORT_NO_FILES = "> No Python files found in `{repo}`. Nothing to review."

# --------------------------------------------------------------------------
# FIXED VALUES -- price list and review bundle
# --------------------------------------------------------------------------

PRICE_NAME_KEY = "- name:"
PRICE_PAID_KEY = "multiplier_paid:"
PRICE_FREE_KEY = "multiplier_free:"
PRICE_NOT_APPLICABLE = "Not applicable"
OVERAGE_PER_REQUEST = 0.04
DEFAULT_MODEL_ID = "gpt-4.1"

BUNDLE_HEADER = "Repository: {repo}\nTotal Python files: {n}"
BUNDLE_FILE_BEGIN = "--- FILE: {path} ---"
BUNDLE_FILE_END = "--- END FILE ---"
