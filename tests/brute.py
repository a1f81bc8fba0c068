"""Row-by-row Python model of the policies, used only as a test oracle.

It walks each file's lines with explicit state, the slow obvious way, so that
the Spark plan (string algebra, arrays, no windows) is checked against an
independent formulation.
"""

from __future__ import annotations

import re

from rulesift import fixed


def _rx(p):
    return re.compile(p, re.IGNORECASE)


P1 = _rx(fixed.P1_PATTERN)
RULES = {pid: [(_rx(p), d) for p, d in rules] for pid, rules in
         ((2, fixed.P2_RULES), (4, fixed.P4_RULES), (5, fixed.P5_RULES), (7, fixed.P7_RULES))}
BAD = _rx(fixed.P6_BAD_NAME)


def first(rules, s):
    for pat, d in rules:
        if pat.search(s):
            return d
    return None


def p2_states(lines):
    """in_docstring flag before each line (policy 2 view)."""
    inside, out = False, []
    for ln in lines:
        out.append(inside)
        n = ln.count('"""') + ln.count("'''")
        if n and n % 2:
            inside = not inside
    return out


def p3_states(lines):
    """inside flag before each non-blank line (policy 3 view), None for blank."""
    inside, out = False, []
    for ln in lines:
        s = ln.strip()
        if not s:
            out.append(None)
            continue
        out.append(inside)
        if inside:
            if '"""' in s or "'''" in s:
                inside = False
        else:
            m = '"""' if s.startswith('"""') else ("'''" if s.startswith("'''") else None)
            if m and s.count(m) < 2:
                inside = True
    return out


def counts(lines):
    code = comment = 0
    for ln, st in zip(lines, p3_states(lines)):
        if st is None:
            continue
        s = ln.strip()
        if st or s.startswith('"""') or s.startswith("'''") or s.startswith("#"):
            comment += 1
        else:
            code += 1
            if " #" in s or "\t#" in s:
                comment += 1
    return code, comment


def file_findings(path, text):
    lines = text.splitlines()
    out = []
    line_hits = set()
    for i, ln in enumerate(lines, 1):
        s = ln.strip()
        if not s.startswith("#") and P1.search(ln):
            out.append((1, i, s[:150], fixed.P1_DESC_LINE, "error"))
            line_hits.add(i)
    full = "\n".join(lines)
    seen = set(line_hits)
    for m in P1.finditer(full):
        n = full.count("\n", 0, m.start()) + 1
        if n not in seen:
            seen.add(n)
            out.append((1, n, lines[n - 1].strip()[:150], fixed.P1_DESC_MULTI, "error"))
    for i, (ln, inside) in enumerate(zip(lines, p2_states(lines)), 1):
        s = ln.strip()
        if '"""' in s or "'''" in s or inside or s.startswith("#"):
            continue
        d = first(RULES[2], ln.split("#")[0])
        if d:
            out.append((2, i, s[:150], d, "error"))
    code, comment = counts(lines)
    if code > fixed.P3_MIN_CODE_LINES:
        if comment == 0:
            out.append((3, 0, "", fixed.P3_DESC_NONE.format(code=code), "error"))
        elif code / comment > fixed.P3_MAX_RATIO:
            out.append((3, 0, "", fixed.P3_DESC_LOW.format(comment=comment, code=code,
                                                           ratio=f"{code / comment:.0f}"), "warning"))
    for pid in (4, 5, 7):
        for i, ln in enumerate(lines, 1):
            s = ln.strip()
            if s.startswith("#"):
                continue
            d = first(RULES[pid], ln)
            if d:
                out.append((pid, i, s[:150], d, "error"))
    name = path.rsplit("/", 1)[-1]
    stem = name[:-3] if name.endswith(".py") and len(name) > 3 else name
    if stem not in fixed.EXEMPT_FILENAMES and BAD.match(stem):
        out.append((6, 0, name[:150], fixed.P6_DESC.format(name=name), "error"))
    return out


def skipped(path):
    return any(p in fixed.SKIP_DIRS for p in path.split("/"))


def scan(files):
    """files: iterable of (repo, branch, path, text) → set of finding tuples."""
    res = set()
    for repo, branch, path, text in files:
        if skipped(path):
            continue
        for pid, n, content, desc, sev in file_findings(path, text):
            res.add((repo, branch, pid, fixed.POLICIES[pid], path, n, content, desc, sev))
    return res
