"""DuckDB statements equal to the registered queries (correctness oracle).

Written independently of the Spark plan: the docstring state machines use
window functions over lines (the Spark plan uses per-file string algebra), the
cross-line session pass uses ``regexp_split_to_array``/``regexp_extract_all``
with list lambdas.  DuckDB's regular expressions are RE2: ASCII ``\\s``/``\\d``,
which equals the Spark semantics on the ASCII corpus.
"""

from __future__ import annotations

from rulesift import fixed
from rulesift.sources import corpus as C

TQD = '"""'
TQS = "'''"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(vals) -> str:
    return "[" + ", ".join(q(v) for v in vals) + "]"


def first_rule_sql(target: str, rules, value="desc") -> str:
    whens = " ".join(
        f"WHEN regexp_matches({target}, {q(p)}, 'i') THEN {q(d) if value == 'desc' else str(i + 1)}"
        for i, (p, d) in enumerate(rules))
    return f"CASE {whens} END"


def policy_name_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {pid} THEN {q(n)}" for pid, n in fixed.POLICIES.items()) + " END"


def _stem_sql(name: str) -> str:
    rpos = f"strpos(reverse({name}), '.')"
    last = f"(length({name}) - {rpos} + 1)"
    return (f"CASE WHEN {rpos} > 0 AND {last} > 1 AND {last} < length({name}) "
            f"THEN left({name}, {last} - 1) ELSE {name} END")


P1 = q(fixed.P1_PATTERN)
SKIP = lst(fixed.SKIP_DIRS)
NL = "chr(10)"

CORPUS = f"""
o AS (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS c FROM orders),
all_files AS (
  SELECT CASE WHEN c % {C.SKIPPED_EVERY} = 0 THEN {q(C.SKIPPED_REPO)} ELSE 'org/repo' || CAST(c % {C.N_REPOS} AS VARCHAR) END AS repo, {q(C.BRANCH)} AS branch,
         {lst(C.DIRS)}[CASE WHEN c % {C.SKIPPED_EVERY} = 0 THEN 1 ELSE c % 7 END + 1] || '/m' || CAST(k AS VARCHAR) || '/' || {lst(C.STEMS)}[k % 10 + 1] || '.py' AS path,
         k
  FROM o),
files AS (SELECT * FROM all_files WHERE NOT list_has_any(string_split(path, '/'), {SKIP})),
gen AS (SELECT repo, branch, path, k, unnest(generate_series(1, 4 + k % 61)) AS n FROM files),
lines AS (
  SELECT repo, branch, path, CAST(n AS INTEGER) AS line_number,
         CASE WHEN i < 20 THEN {lst(C.TEMPLATES)}[i + 1]
              WHEN i < 60 THEN 'v' || CAST(i - 20 AS VARCHAR) || ' = f(v)'
              WHEN i < {60 + len(C.RULE_LINES)} THEN {lst(C.RULE_LINES)}[i - 60 + 1]
              ELSE 'w = g(w)' END AS line
  FROM (SELECT *, ((k * 7919 + n * 104729 + (k % 101) * n * n) % 1000003)
                  % (CASE WHEN k % 3 = 0 THEN 400 ELSE 60 END) AS i FROM gen)),
ln AS (
  SELECT *, trim(line, {q(fixed.PY_WHITESPACE)}) AS st,
         (length(line) - length(replace(line, {q(TQD)}, ''))) // 3 AS tq_d,
         (length(line) - length(replace(line, {q(TQS)}, ''))) // 3 AS tq_s
  FROM lines),
w1 AS (
  SELECT *, CAST(coalesce(sum(CASE WHEN (tq_d + tq_s) % 2 = 1 THEN 1 ELSE 0 END) OVER (
              PARTITION BY repo, branch, path ORDER BY line_number
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS INTEGER) AS in_doc
  FROM ln),
w2a AS (
  SELECT *,
    CASE WHEN (starts_with(st, {q(TQD)}) AND tq_d < 2)
           OR (NOT starts_with(st, {q(TQD)}) AND starts_with(st, {q(TQS)}) AND tq_s < 2) THEN 1 ELSE 0 END AS tog
  FROM w1),
w2b AS (
  SELECT *, CASE WHEN tog = 0 AND tq_d + tq_s > 0 THEN 1 ELSE 0 END AS rst FROM w2a),
w2c AS (
  SELECT *, coalesce(sum(rst) OVER (PARTITION BY repo, branch, path ORDER BY line_number
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM w2b),
w2 AS (
  SELECT *, CAST(coalesce(sum(tog) OVER (PARTITION BY repo, branch, path, grp ORDER BY line_number
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS INTEGER) AS state FROM w2c),
cnt AS (
  SELECT repo, branch, path,
    CAST(sum(CASE WHEN st <> '' AND state = 0 AND NOT (starts_with(st, {q(TQD)}) OR starts_with(st, {q(TQS)})
                  OR starts_with(st, '#')) THEN 1 ELSE 0 END) AS BIGINT) AS code_lines,
    CAST(sum(CASE WHEN st = '' THEN 0 WHEN state = 1 THEN 1
                  WHEN starts_with(st, {q(TQD)}) OR starts_with(st, {q(TQS)}) OR starts_with(st, '#') THEN 1
                  WHEN contains(st, ' #') OR contains(st, chr(9) || '#') THEN 1 ELSE 0 END) AS BIGINT) AS comment_lines
  FROM w2 GROUP BY repo, branch, path),
p1a AS (
  SELECT repo, branch, path, line_number, st FROM ln
  WHERE NOT starts_with(st, '#') AND regexp_matches(line, {P1}, 'i')),
txt AS (SELECT repo, branch, path, string_agg(line, {NL} ORDER BY line_number) AS ftext
        FROM lines GROUP BY repo, branch, path),
hits AS (
  SELECT repo, branch, path, regexp_extract_all(ftext, {P1}, 0, 'i') AS h,
         regexp_split_to_array(ftext, {P1}, 'i') AS g
  FROM txt WHERE regexp_matches(ftext, {P1}, 'i')),
p1b_list AS (
  SELECT repo, branch, path, list_transform(range(1, len(h) + 1), lambda kk:
      1 + coalesce(list_sum(list_transform(g[1:kk], lambda x: length(x) - length(replace(x, {NL}, '')))), 0)
        + coalesce(list_sum(list_transform(h[1:kk - 1], lambda x: length(x) - length(replace(x, {NL}, '')))), 0)
      ) AS starts
  FROM hits),
p1b_all AS (
  SELECT repo, branch, path, CAST(s AS INTEGER) AS line_number
  FROM (SELECT repo, branch, path, unnest(starts) AS s FROM p1b_list)),
p1b AS (
  SELECT DISTINCT b.repo, b.branch, b.path, b.line_number FROM p1b_all b
  WHERE NOT EXISTS (SELECT 1 FROM p1a a WHERE a.repo = b.repo AND a.branch = b.branch
                    AND a.path = b.path AND a.line_number = b.line_number)),
p2 AS (
  SELECT * FROM (
    SELECT repo, branch, path, line_number, st,
           {first_rule_sql("split_part(line, '#', 1)", fixed.P2_RULES)} AS d
    FROM w1 WHERE tq_d + tq_s = 0 AND in_doc = 0 AND NOT starts_with(st, '#'))
  WHERE d IS NOT NULL),
p3 AS (
  SELECT repo, branch, path,
    CASE WHEN comment_lines = 0
         THEN 'No comments found in file with ' || code_lines || ' code lines (expected ≥1 comment per 20 lines)'
         ELSE 'Insufficient comments: ' || comment_lines || ' comment(s) for ' || code_lines
              || ' code lines (ratio 1:' || CAST(round_even(code_lines / comment_lines, 0) AS BIGINT)
              || ', expected ≤1:20)' END AS d,
    CASE WHEN comment_lines = 0 THEN 'error' ELSE 'warning' END AS sev
  FROM cnt WHERE code_lines > {fixed.P3_MIN_CODE_LINES}
                 AND (comment_lines = 0 OR code_lines / comment_lines > {fixed.P3_MAX_RATIO})),
lr AS (
  SELECT repo, branch, path, line_number, st,
         {first_rule_sql("line", fixed.P4_RULES)} AS d4,
         {first_rule_sql("line", fixed.P5_RULES)} AS d5,
         {first_rule_sql("line", fixed.P7_RULES)} AS d7
  FROM ln WHERE NOT starts_with(st, '#')),
p6 AS (
  SELECT repo, branch, path, name FROM (
    SELECT repo, branch, path, name, {_stem_sql('name')} AS stem
    FROM (SELECT repo, branch, path, string_split(path, '/')[-1] AS name FROM files))
  WHERE stem NOT IN ({", ".join(q(x) for x in fixed.EXEMPT_FILENAMES)})
    AND regexp_matches(stem, {q(fixed.P6_BAD_NAME)}, 'i')),
findings0 AS (
  SELECT repo, branch, 1 AS pid, path, line_number, st AS content, {q(fixed.P1_DESC_LINE)} AS d, 'error' AS sev FROM p1a
  UNION ALL
  SELECT b.repo, b.branch, 1, b.path, b.line_number, l.st, {q(fixed.P1_DESC_MULTI)}, 'error'
  FROM p1b b JOIN ln l USING (repo, branch, path, line_number)
  UNION ALL SELECT repo, branch, 2, path, line_number, st, d, 'error' FROM p2
  UNION ALL SELECT repo, branch, 3, path, 0, '', d, sev FROM p3
  UNION ALL SELECT repo, branch, 4, path, line_number, st, d4, 'error' FROM lr WHERE d4 IS NOT NULL
  UNION ALL SELECT repo, branch, 5, path, line_number, st, d5, 'error' FROM lr WHERE d5 IS NOT NULL
  UNION ALL SELECT repo, branch, 6, path, 0, name, 'Non-descriptive filename: ''' || name || '''', 'error' FROM p6
  UNION ALL SELECT repo, branch, 7, path, line_number, st, d7, 'error' FROM lr WHERE d7 IS NOT NULL),
findings AS (
  SELECT repo, branch, CAST(pid AS INTEGER) AS policy_id, {policy_name_sql('pid')} AS policy_name,
         path AS file_path, CAST(line_number AS INTEGER) AS line_number, left(content, 150) AS line_content,
         d AS description, sev AS severity
  FROM findings0),
file_counts AS (
  SELECT repo, branch, CAST(count(*) FILTER (WHERE NOT list_has_any(string_split(path, '/'), {SKIP})) AS BIGINT)
         AS files_scanned
  FROM all_files GROUP BY repo, branch),
pol AS (SELECT CAST(unnest({list(sorted(fixed.POLICIES))}) AS INTEGER) AS policy_id),
psum AS (
  SELECT fc.repo, fc.branch, pol.policy_id, fc.files_scanned AS files_checked,
         CAST(count(f.severity) FILTER (WHERE f.severity = 'error') AS BIGINT) AS errors,
         CAST(count(f.severity) FILTER (WHERE f.severity = 'warning') AS BIGINT) AS warnings
  FROM file_counts fc CROSS JOIN pol
  LEFT JOIN findings f ON f.repo = fc.repo AND f.branch = fc.branch AND f.policy_id = pol.policy_id
  GROUP BY fc.repo, fc.branch, pol.policy_id, fc.files_scanned),
policy_summary AS (
  SELECT repo, branch, policy_id, {policy_name_sql('policy_id')} AS policy_name,
         CASE WHEN errors > 0 THEN 'fail' WHEN warnings > 0 THEN 'warning' ELSE 'pass' END AS status,
         files_checked, errors, warnings
  FROM psum),
totals AS (
  SELECT fc.repo, fc.branch, fc.files_scanned,
         CAST(coalesce(sum(p.errors), 0) AS BIGINT) AS total_errors,
         CAST(coalesce(sum(p.warnings), 0) AS BIGINT) AS total_warnings
  FROM file_counts fc LEFT JOIN psum p ON p.repo = fc.repo AND p.branch = fc.branch
  GROUP BY fc.repo, fc.branch, fc.files_scanned),
scan_totals AS (
  SELECT repo, branch, files_scanned,
         CASE WHEN total_errors > 0 THEN 'fail' WHEN total_warnings > 0 THEN 'warning' ELSE 'pass' END
           AS overall_status,
         total_errors, total_warnings
  FROM totals)
"""

DOC_LINES = f"""
dl AS (
  SELECT doc_id, CAST(generate_subscripts(parts, 1) AS INTEGER) AS line_number, unnest(parts) AS line FROM (
    SELECT doc_id, CASE WHEN parts0[-1] = '' THEN parts0[1:len(parts0) - 1] ELSE parts0 END AS parts FROM (
      SELECT doc_id, regexp_split_to_array(text, {q(r'\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')})
             AS parts0
      FROM documents)))
"""


def with_corpus(select: str) -> str:
    return f"WITH {CORPUS} {select}"


def _findings_where(cond: str | None = None) -> str:
    return with_corpus("SELECT * FROM findings" + (f" WHERE {cond}" if cond else ""))


def _policy2_documents() -> str:
    return f"""
WITH docs AS (SELECT source AS repo, 'main' AS branch, 'doc/' || CAST(doc_id AS VARCHAR) || '.py' AS path, text
              FROM documents),
parts AS (
  SELECT repo, branch, path, CASE WHEN p0[-1] = '' THEN p0[1:len(p0) - 1] ELSE p0 END AS p FROM (
    SELECT repo, branch, path,
           regexp_split_to_array(text, {q(r'\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')}) AS p0
    FROM docs)),
ln AS (
  SELECT repo, branch, path, CAST(generate_subscripts(p, 1) AS INTEGER) AS line_number, unnest(p) AS line
  FROM parts),
ln2 AS (
  SELECT *, trim(line, {q(fixed.PY_WHITESPACE)}) AS st,
         (length(line) - length(replace(line, {q(TQD)}, ''))) // 3
         + (length(line) - length(replace(line, {q(TQS)}, ''))) // 3 AS tq
  FROM ln),
w1 AS (
  SELECT *, coalesce(sum(CASE WHEN tq % 2 = 1 THEN 1 ELSE 0 END) OVER (
              PARTITION BY repo, branch, path ORDER BY line_number
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS in_doc
  FROM ln2),
p2 AS (
  SELECT * FROM (
    SELECT repo, branch, path, line_number, st,
           {first_rule_sql("split_part(line, '#', 1)", fixed.P2_RULES)} AS d
    FROM w1 WHERE tq = 0 AND in_doc = 0 AND NOT starts_with(st, '#'))
  WHERE d IS NOT NULL)
SELECT repo, branch, CAST(2 AS INTEGER) AS policy_id, {q(fixed.POLICIES[2])} AS policy_name,
       path AS file_path, line_number, left(st, 150) AS line_content, d AS description, 'error' AS severity
FROM p2"""


def _first_rule() -> str:
    sets = [(2, fixed.P2_RULES), (4, fixed.P4_RULES), (5, fixed.P5_RULES), (7, fixed.P7_RULES)]
    parts = " UNION ALL ".join(
        f"SELECT repo, branch, path, line_number, CAST({pid} AS INTEGER) AS policy_id, "
        f"CAST({first_rule_sql('line', rules, 'index')} AS INTEGER) AS rule_no FROM lines"
        for pid, rules in sets)
    return with_corpus(f"SELECT * FROM ({parts}) WHERE rule_no IS NOT NULL")


def _org_policy_summary() -> str:
    return with_corpus("""
SELECT policy_id, policy_name,
       CAST(count(*) FILTER (WHERE status = 'fail') AS BIGINT) AS repos_failing,
       CAST(count(*) FILTER (WHERE status = 'warning') AS BIGINT) AS repos_warning,
       CAST(count(*) FILTER (WHERE status = 'pass') AS BIGINT) AS repos_passing,
       CAST(sum(errors) AS BIGINT) AS total_errors, CAST(sum(warnings) AS BIGINT) AS total_warnings
FROM policy_summary GROUP BY policy_id, policy_name""")


def _overall_status() -> str:
    heads = " ".join(f"WHEN overall_status = {q(k)} THEN {q(v)}" for k, v in fixed.REPORT_OVERALL.items())
    return with_corpus(f"""
SELECT repo, branch, files_scanned, overall_status, CASE {heads} END AS headline,
       CASE WHEN files_scanned = 0 THEN '> No Python files found in `' || repo || '`. Nothing to review.' END AS note
FROM scan_totals""")


def _review_bundle() -> str:
    bskip = lst(fixed.BUNDLE_SKIP_NAMES)
    return with_corpus(f"""
, bfiles AS (SELECT * FROM all_files WHERE NOT list_has_any(string_split(path, '/'), {bskip})),
bgen AS (SELECT repo, branch, path, k, unnest(generate_series(1, 4 + k % 61)) AS n FROM bfiles),
blines AS (
  SELECT repo, branch, path, n,
         CASE WHEN i < 20 THEN {lst(C.TEMPLATES)}[i + 1]
              WHEN i < 60 THEN 'v' || CAST(i - 20 AS VARCHAR) || ' = f(v)'
              WHEN i < {60 + len(C.RULE_LINES)} THEN {lst(C.RULE_LINES)}[i - 60 + 1] ELSE 'w = g(w)' END AS line
  FROM (SELECT *, ((k * 7919 + n * 104729 + (k % 101) * n * n) % 1000003)
                  % (CASE WHEN k % 3 = 0 THEN 400 ELSE 60 END) AS i FROM bgen)),
btext AS (SELECT repo, branch, path, string_agg(line, {NL} ORDER BY n) || {NL} AS text
          FROM blines GROUP BY repo, branch, path)
SELECT repo, branch, '' AS path, CAST(0 AS INTEGER) AS part,
       'Repository: ' || repo || {NL} || 'Total Python files: '
         || CAST(count(*) FILTER (WHERE NOT list_has_any(string_split(path, '/'), {bskip})) AS VARCHAR) AS text
FROM all_files GROUP BY repo, branch
UNION ALL SELECT repo, branch, path, CAST(1 AS INTEGER), '--- FILE: ' || path || ' ---' FROM btext
UNION ALL SELECT repo, branch, path, CAST(2 AS INTEGER), text FROM btext
UNION ALL SELECT repo, branch, path, CAST(3 AS INTEGER), {q(fixed.BUNDLE_FILE_END)} FROM btext""")


def _file_order() -> str:
    return with_corpus("""
SELECT repo, branch, path,
       CAST(row_number() OVER (PARTITION BY repo, branch ORDER BY string_split(path, '/')) AS BIGINT) AS file_rank
FROM files""")


def _scan_log() -> str:
    return """
SELECT strftime(time_bucket(INTERVAL '1 day', CAST(ts AS TIMESTAMP)), '%Y-%m-%d') AS day,
       'org/repo' || CAST(user_id % 20 AS VARCHAR) AS repo, event_type AS kind,
       CAST(count(*) AS BIGINT) AS scans
FROM events GROUP BY ALL"""


ORACLE: dict[str, str] = {
    "scan_prune": with_corpus("SELECT repo, branch, path FROM files"),
    "scan_size_limit": with_corpus(f"""
SELECT repo, branch, path, CAST(sum(strlen(line) + 1) AS BIGINT) AS length FROM lines
GROUP BY repo, branch, path HAVING sum(strlen(line) + 1) <= {fixed.MAX_ARCHIVE_BYTES}"""),
    "line_split": f"WITH {DOC_LINES} SELECT doc_id, line_number, line FROM dl",
    "strip_lines": f"WITH {DOC_LINES} SELECT doc_id, line_number, trim(line, {q(fixed.PY_WHITESPACE)}) AS stripped FROM dl",
    "comment_filter": with_corpus("SELECT repo, branch, path, line_number FROM ln WHERE NOT starts_with(st, '#')"),
    "code_part": with_corpus(
        "SELECT repo, branch, path, line_number, split_part(line, '#', 1) AS code_part FROM lines "
        "WHERE strpos(line, '#') > 0"),
    "repo_name": """
SELECT page_id, url,
  regexp_replace(regexp_replace(regexp_replace(url, 'https?://github\\.com/', ''), '\\.git$', ''), '/$', '')
  AS repo_name
FROM pages""",
    "policy1_session_line": _findings_where(f"policy_id = 1 AND description = {q(fixed.P1_DESC_LINE)}"),
    "policy1_session_multiline": _findings_where(f"policy_id = 1 AND description = {q(fixed.P1_DESC_MULTI)}"),
    "policy1_session": _findings_where("policy_id = 1"),
    "policy2_secrets": _findings_where("policy_id = 2"),
    "policy2_documents": _policy2_documents(),
    "policy3_comment_density": _findings_where("policy_id = 3"),
    "policy4_formats": _findings_where("policy_id = 4"),
    "policy5_schema": _findings_where("policy_id = 5"),
    "policy6_file_names": _findings_where("policy_id = 6"),
    "policy7_downloads": _findings_where("policy_id = 7"),
    "all_findings": _findings_where(),
    "chunked_findings": _findings_where(),
    "docstring_parity": with_corpus("SELECT repo, branch, path, line_number, in_doc AS in_docstring FROM w1"),
    "docstring_state": with_corpus("SELECT repo, branch, path, line_number, state FROM w2"),
    "first_rule": _first_rule(),
    "line_counts": with_corpus("SELECT repo, branch, path, code_lines, comment_lines FROM cnt"),
    "policy_summary": with_corpus("SELECT * FROM policy_summary"),
    "scan_totals": with_corpus("SELECT * FROM scan_totals"),
    "overall_status": _overall_status(),
    "files_scanned": with_corpus("SELECT * FROM file_counts"),
    "gate": with_corpus("SELECT repo, branch, overall_status = 'fail' AS gate_failed FROM scan_totals"),
    "policy_file_counts": with_corpus("""
SELECT repo, branch, policy_id, CAST(count(*) AS BIGINT) AS violations,
       CAST(count(DISTINCT file_path) AS BIGINT) AS files
FROM findings GROUP BY repo, branch, policy_id"""),
    "org_policy_summary": _org_policy_summary(),
    "review_bundle": _review_bundle(),
    "file_order": _file_order(),
    "scan_log": _scan_log(),
}


def _report_markdown() -> str:
    from rulesift.plans.report import DEFAULT_GENERATOR, FIXED_SCAN_TS
    now = f"{FIXED_SCAN_TS} UTC"

    def case(col, mapping):
        return "CASE " + " ".join(f"WHEN {col} = {q(k)} THEN {q(v)}" for k, v in mapping.items()) + " END"

    def rows(source, section, exprs, policy="0", sub=0):
        out = []
        for i, e in enumerate(exprs):
            out.append(f"SELECT repo, branch, CAST({section} AS INTEGER) AS section, CAST({policy} AS INTEGER) "
                       f"AS policy_id, CAST({sub} AS INTEGER) AS sub, '' AS file_path, CAST(0 AS INTEGER) "
                       f"AS line_number, CAST({i} AS INTEGER) AS seq, {e} AS text FROM {source} "
                       f"WHERE ({e}) IS NOT NULL")
        return out

    n = "CAST(files_scanned AS VARCHAR)"
    parts = []
    parts += rows("scan_totals", 0, [
        q(fixed.REPORT_TITLE), "''", q(fixed.REPORT_READ_ONLY), "''", q("| Field | Value |"),
        q("|-------|-------|"),
        "CASE WHEN repo <> '' THEN '| **Repository** | `' || repo || '` |' END",
        "CASE WHEN branch <> '' THEN '| **Branch** | `' || branch || '` |' END",
        q(f"| **Scan Date** | {now} |"),
        f"'| **Files Scanned** | ' || {n} || ' Python file(s) |'", "''"])
    parts += rows("scan_totals", 1, [
        case("overall_status", fixed.REPORT_OVERALL), "''",
        f"'> ' || CAST(total_errors AS VARCHAR) || ' error(s), ' || CAST(total_warnings AS VARCHAR) "
        f"|| ' warning(s) across ' || {n} || ' file(s)'",
        "''", q("---"), "''", q("## Policy Summary"), "''",
        q("| # | Policy | Status | Errors | Warnings |"), q("|:-:|--------|:------:|:------:|:--------:|")])
    parts += rows("policy_summary", 2, [
        "'| ' || CAST(policy_id AS VARCHAR) || ' | ' || policy_name || ' | ' || "
        f"{case('status', fixed.STATUS_CELL)} || ' | ' || CAST(errors AS VARCHAR) || ' | ' || "
        "CAST(warnings AS VARCHAR) || ' |'"], policy="policy_id")
    parts += rows("scan_totals", 3, ["''", q("---"), "''", q("## Detailed Findings")])
    has = "(errors + warnings > 0)"
    parts += rows("per_policy", 4, [
        "''",
        f"'### Policy ' || CAST(policy_id AS VARCHAR) || ': ' || policy_name || ' ' || {case('status', fixed.STATUS_ICON)}",
        "''",
        f"CASE WHEN {has} THEN '> **' || CAST(errors + warnings AS VARCHAR) || ' violation(s)** in **' "
        f"|| CAST(n_files AS VARCHAR) || ' file(s)**' ELSE {q(fixed.NO_VIOLATIONS)} END",
        "''",
        f"CASE WHEN {has} THEN '| Sev | File | Line | Finding |' END",
        f"CASE WHEN {has} THEN '|:---:|------|:----:|---------|' END"], policy="policy_id")
    parts += [f"SELECT repo, branch, CAST(4 AS INTEGER), CAST(policy_id AS INTEGER), CAST(2 AS INTEGER), '', "
              f"CAST(0 AS INTEGER), CAST(0 AS INTEGER), '' FROM per_policy WHERE {has}"]
    parts += [f"SELECT repo, branch, CAST(4 AS INTEGER), policy_id, CAST(1 AS INTEGER), file_path, line_number, "
              f"CAST(0 AS INTEGER), '| ' || {case('severity', fixed.SEVERITY_ICON)} || ' | `' || file_path || '` | ' "
              f"|| CASE WHEN line_number > 0 THEN CAST(line_number AS VARCHAR) ELSE {q(fixed.WHOLE_FILE_LINE)} END "
              f"|| ' | ' || replace(description, '|', '\\|') || ' |' FROM findings"]
    parts += rows("scan_totals", 5, [
        q("---"), "''", q("## 📖 Policy Definitions Reference"), "''", q("| # | Policy | Rule |"),
        q("|:-:|--------|------|"), *[q(r) for r in fixed.POLICY_REFERENCE_ROWS], "''", q("---"),
        q(f"*Report generated by {DEFAULT_GENERATOR} • {now}*")])
    per_policy = """, per_policy AS (
  SELECT p.*, c.n_files FROM policy_summary p LEFT JOIN (
    SELECT repo, branch, policy_id, CAST(count(DISTINCT file_path) AS BIGINT) AS n_files
    FROM findings GROUP BY repo, branch, policy_id) c USING (repo, branch, policy_id))"""
    return with_corpus(per_policy + " " + " UNION ALL ".join(parts))


ORACLE["report_markdown"] = _report_markdown()


def _report_json() -> str:
    from rulesift.plans.report import FIXED_SCAN_TS
    scan_date = FIXED_SCAN_TS.replace(" ", "T") + "+00:00"
    multi = f"CAST(CASE WHEN description = {q(fixed.P1_DESC_MULTI)} THEN 1 ELSE 0 END AS INTEGER)"

    def row(source, section, policy, sub, text):
        return (f"SELECT repo, branch, CAST({section} AS INTEGER) AS section, CAST({policy} AS INTEGER) AS policy_id, CAST({sub} AS INTEGER) AS sub, "
                f"'' AS file_path, CAST(0 AS INTEGER) AS pass_no, CAST(0 AS INTEGER) AS line_number, {text} AS text FROM {source}")

    head = (f"'{{\"scan_date\":\"{scan_date}\",\"files_scanned\":' || files_scanned || ',\"overall_status\":\"' || overall_status || "
            f"'\",\"total_errors\":' || total_errors || ',\"total_warnings\":' || total_warnings || ', \"policies\": {{'")
    opened = ("CASE WHEN policy_id > 1 THEN ',' ELSE '' END || '\"' || policy_id || '\": {\"name\": ' || to_json(policy_name) || "
              "', \"status\": \"' || status || '\", \"violations\": ['")
    violations = f"""
SELECT repo, branch, CAST(1 AS INTEGER), policy_id, CAST(1 AS INTEGER), file_path, {multi}, line_number,
       CASE WHEN row_number() OVER (PARTITION BY repo, branch, policy_id ORDER BY string_split(file_path, '/'), {multi}, line_number) > 1 THEN ',' ELSE '' END
       || to_json({{'file': file_path, 'line': line_number, 'severity': severity, 'description': description, 'content': line_content}})
FROM findings"""
    return with_corpus(" UNION ALL ".join([row("scan_totals", 0, "0", 0, head), row("policy_summary", 1, "policy_id", 0, opened),
                                           row("policy_summary", 1, "policy_id", 2, "']}'"), row("scan_totals", 2, "0", 0, "'}}'"), violations]))


ORACLE["report_json"] = _report_json()
_KEY = "CAST(regexp_extract({}, '/m([0-9]+)/', 1) AS BIGINT)"


def _named(column: str, path: str) -> str:
    """The branch or commit name of a corpus path."""
    from rulesift.plans.queries import BRANCH_NAMES, COMMIT_NAMES
    names = {"branch": BRANCH_NAMES, "commit": COMMIT_NAMES}[column]
    listed = ", ".join("NULL" if x is None else q(x) for x in names)
    return f"[{listed}][{_KEY.format(path)} % {len(names)} + 1] AS {column}"


_DAILY = f"""
SELECT strftime(DATE '2024-01-01' + CAST({_KEY.format('file_path')} % 7 AS INTEGER), '%Y-%m-%d') AS day,
       repo, policy_id, CAST(count(*) AS BIGINT) AS findings
FROM findings GROUP BY ALL"""
ORACLE["daily_findings"] = with_corpus(_DAILY)
# the last two of the seven days stay open: the watermark is a day behind the last row
ORACLE["findings_log"] = with_corpus(f"SELECT * FROM ({_DAILY}) WHERE day <= '2024-01-05'")
ORACLE["incremental_totals"] = with_corpus(f"""
, f AS (SELECT repo, {_named("branch", "path")}, {_named("commit", "path")}, CAST(count(*) FILTER (WHERE NOT list_has_any(string_split(path, '/'), {SKIP})) AS BIGINT) AS files_scanned
  FROM all_files GROUP BY ALL),
v AS (SELECT repo, {_named("branch", "file_path")}, {_named("commit", "file_path")}, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w
  FROM findings GROUP BY ALL),
t AS (SELECT f.repo, f.branch, f.commit, files_scanned, CAST(coalesce(e, 0) AS BIGINT) AS total_errors, CAST(coalesce(w, 0) AS BIGINT) AS total_warnings
  FROM f LEFT JOIN v ON f.repo = v.repo AND f.branch IS NOT DISTINCT FROM v.branch AND f.commit = v.commit)
SELECT repo, branch, commit, files_scanned, CASE WHEN total_errors > 0 THEN 'fail' WHEN total_warnings > 0 THEN 'warning' ELSE 'pass' END AS overall_status,
       total_errors, total_warnings FROM t""")
ORACLE["incremental_findings"] = with_corpus(f"""
SELECT repo, {_named("branch", "file_path")}, {_named("commit", "file_path")}, policy_id, file_path, line_number, description FROM findings""")
ORACLE["kept_findings"] = with_corpus(f"""
, named AS (SELECT * EXCLUDE (branch), {_named("branch", "file_path")} FROM findings)
SELECT repo, branch, policy_id, file_path, line_number, description, severity,
       CASE WHEN policy_id = 4 THEN '2024-02-01' ELSE '2024-01-01' END AS first_seen,
       CASE WHEN branch IS NULL OR branch = '1.1' THEN '2024-02-01' ELSE '2024-01-01' END AS last_seen
FROM named WHERE policy_id <> CASE WHEN branch IS NULL OR branch = '1.1' THEN 5 ELSE 4 END""")
ORACLE["report_pipes"] = with_corpus("""
SELECT repo, branch, path AS file_path, line_number, '| 🔴 | `' || path || '` | ' || line_number || ' | f(v) \\| g(v) \\|\\| h(v) |' AS text
FROM ln WHERE line LIKE '% = f(v)' AND NOT starts_with(st, '#')""")
ORACLE["frame_policy"] = with_corpus("""
, held AS (SELECT repo, branch, path, line_number, st FROM w1 WHERE in_doc = 0 AND starts_with(st, 'token = "')),
firsts AS (SELECT repo, branch, st, min(path) AS p FROM held GROUP BY ALL)
SELECT repo, branch, CAST(8 AS INTEGER) AS policy_id, 'No Shared Secrets' AS policy_name, path AS file_path, line_number, left(st, 150) AS line_content,
       'Secret shared with ' || p AS description, 'error' AS severity
FROM held JOIN firsts USING (repo, branch, st) WHERE path > p""")
ORACLE["repo_name"] = """
SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(url, 'https?://github\\.com/', ''), '\\.git$', ''), '/$', '') AS repo_name
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://github.com/org/r' || page_id || '.git'
             WHEN 1 THEN 'http://github.com/org/r' || page_id || '/' WHEN 2 THEN url || '.git' ELSE url END AS url FROM pages)"""

MODELS = f"""
lines AS (
  SELECT 'list' || (p_partkey % 4) AS source, p_partkey AS k, 'GPT ' || (p_partkey % 97) || ' (v' || (p_partkey % 5) || ')' AS name,
         'gpt-' || (p_partkey % 97) || '-v' || (p_partkey % 5) AS id,
         [0, 0.33, 1, 5, 10, NULL][p_partkey % 6 + 1]::DOUBLE AS m, CASE WHEN p_partkey % 3 = 0 THEN 1.0::DOUBLE END AS free
  FROM part),
catalog AS (
  SELECT id, arg_max(name, (source, k)) AS name, arg_max(m, (source, k)) AS m, max((source, k, coalesce(free, -1))) AS last
  FROM lines WHERE m IS NOT NULL GROUP BY id),
priced AS (
  SELECT id, name, m, CASE WHEN last[3] >= 0 THEN last[3] END AS free,
         CASE WHEN m = floor(m) THEN CAST(CAST(m AS BIGINT) AS VARCHAR) ELSE CAST(m AS VARCHAR) END AS t FROM catalog)
"""
ORACLE["model_slug"] = f"WITH {MODELS} SELECT id, name FROM priced"
ORACLE["model_tier"] = f"""WITH {MODELS} SELECT id, m AS multiplier,
  CASE WHEN m = 0 THEN 'base' WHEN m < 1 THEN 'low' WHEN m <= 1 THEN 'standard' WHEN m <= 5 THEN 'premium' ELSE 'expensive' END AS tier FROM priced"""
ORACLE["model_cost"] = f"""WITH {MODELS} SELECT id,
  CASE WHEN m = 0 THEN 'Included' ELSE t || '× premium' END AS cost,
  CASE WHEN m = 0 THEN '$0.00' ELSE '$' || printf('%.2f', m * {fixed.OVERAGE_PER_REQUEST}) END AS overage,
  CASE WHEN m = 0 THEN 'Included with paid plans' ELSE t || '× premium request' || CASE WHEN m <> 1 THEN 's' ELSE '' END || ' per use' END AS ui_label,
  CASE WHEN m = 0 THEN 'No premium requests used' WHEN free = 1 THEN '1× on Free plan' ELSE '' END AS ui_badge,
  name || '    ·    ' || CASE WHEN m = 0 THEN 'Included' ELSE t || '× premium' END AS option_text FROM priced"""
ORACLE["model_resolve"] = f"""WITH {MODELS},
asked AS (SELECT o_orderkey, 'gpt-' || (o_orderkey % 120) || '-v' || (o_orderkey % 5) AS model FROM orders),
known AS (SELECT o_orderkey, coalesce(p.id, {q(fixed.DEFAULT_MODEL_ID)}) AS model_id FROM asked LEFT JOIN priced p ON p.id = asked.model)
SELECT o_orderkey, model_id, m AS multiplier, name FROM known LEFT JOIN priced ON priced.id = known.model_id"""
