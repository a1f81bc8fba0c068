"""Policy detectors: lines and files → findings.

One projection per file row computes the whole-file detectors (policy 1 across
lines, policy 3, policy 6); one ``posexplode`` turns the row into lines and one
projection per line computes the line detectors (policies 1, 2, 4, 5, 7).  Both
kinds of finding leave through a single ``explode``: no shuffle, no join, and
each regular expression is a literal ``rlike`` compiled once per task.

Findings are unique on (repo, branch, policy_id, file_path, line_number):
line rules stop at the first hit, the cross-line pass of policy 1 skips lines
already found by the one-line pass, policies 3 and 6 give at most one finding
per file, on line 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulesift import fixed
from rulesift.config import RULE_REQUIRES, RuleSet, ScanConfig
from rulesift.functions import text as T
from rulesift.operators import lines as L

FINDING_TYPE = ("struct<policy_id:int,line_number:int,line_content:string,"
                "description:string,severity:string>")


def empty_findings() -> Column:
    return F.array().cast(f"array<{FINDING_TYPE}>")


FINDINGS_COLUMNS = ["repo", "branch", "policy_id", "policy_name", "file_path",
                    "line_number", "line_content", "description", "severity"]

def fmt(template: str, **cols: Column) -> Column:
    """``template.format(**cols)`` as a Spark ``concat``."""
    parts = re.split(r"\{(\w+)\}", template)
    out = []
    for i, part in enumerate(parts):
        if i % 2 == 0:
            if part:
                out.append(F.lit(part))
        else:
            out.append(cols[part].cast("string"))
    return F.concat(*out)


def finding(policy_id, line_number: Column, content: Column, description: Column,
            severity: str | Column = "error") -> Column:
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    return F.struct(F.lit(policy_id).cast("int").alias("policy_id"),
                    line_number.cast("int").alias("line_number"),
                    T.truncate_content(content).alias("line_content"),
                    description.alias("description"),
                    sev.alias("severity"))


def first_rule(target: Column, rules) -> Column:
    """Description of the first matching rule, null if none."""
    return F.coalesce(*[F.when(T.matches(target, pat), F.lit(desc)) for pat, desc in rules])


def rule_matches(target: Column, pattern: str, sets, folded: Column | None = None) -> Column:
    """``text.matches``, where the file's text holds what the rule requires (``_held`` of these sets), or, with
    ``folded`` (the target's lower-cased text), where the target does."""
    literals = RULE_REQUIRES.get(pattern, ())
    found = T.matches(target, pattern)
    if folded is not None:
        return T.may_contain_any(target, folded, literals, F.col("_escaped")) & found if literals else found
    return T.held(F.col("_held"), literals, sets) & found if literals and literals in sets else found


def first_rule_index(target: Column, rules, sets=()) -> Column:
    """1-based number of the first matching rule, null if none."""
    return F.coalesce(*[F.when(rule_matches(target, pat, sets), F.lit(i + 1)) for i, (pat, _) in enumerate(rules)])


def literal_sets(rule_sets) -> list[tuple[str, ...]]:
    """The sets of literals of these rule sets, those of whole rule sets first: ``_held`` tells of so many."""
    return [rs.requires for rs in rule_sets] + [s for rs in rule_sets for s in rs.literals[1:]]


def rule_set_condition(rs: RuleSet, line: dict[str, Column], held: Column) -> Column:
    """Scope filter of the rule set and its literal pre-checks."""
    target = line["line"] if rs.scope == "line" else line["code"]
    cond = ~line["comment"]
    if rs.scope == "code_part":
        cond = cond & (line["par"] == 0)
    if rs.requires:
        cond = cond & held & T.may_contain_any(target, line["folded"] if rs.scope == "line" else T.fold(target), rs.requires, line["_escaped"])
    if rs.scope == "code_part":
        cond = cond & ~T.has_triple_quote(line["st"])
    return cond


def rule_set_description(rs: RuleSet, line: dict[str, Column], cond: Column, sets=()) -> Column:
    """The first matching rule, where the line meets ``cond``."""
    target = line["line"] if rs.scope == "line" else line["code"]
    folded = line.get("folded" if rs.scope == "line" else "folded_code")
    found = [F.when(rule_matches(target, pat, sets, folded), F.lit(desc)) for pat, desc in rs.rules]
    if rs.function:
        found.append(rs.function(target, line["st"]))
    return F.when(cond, F.coalesce(*found))


def line_conditions(cfg: ScanConfig, any_state: bool = False) -> list[Column]:
    """One column per line rule set: whether its rules are searched for on the line (``any_state``: whatever its
    docstring state)."""
    sets = literal_sets(cfg.rule_sets)
    line = {c: F.col(c) for c in ("line", "st", "par", "folded", "code", "comment", "_escaped")}
    if any_state:
        line["par"], sets = F.lit(0), []
    return [F.coalesce(rule_set_condition(rs, line, T.held(F.col("_held"), rs.requires, sets)), F.lit(False)).alias(f"_c{i}") for i, rs in enumerate(cfg.rule_sets)]


def line_descriptions(cfg: ScanConfig, own_text: bool = False) -> list[Column]:
    """One description column per line rule set (null where no rule hit), of the columns of a line; ``own_text``: what
    a rule requires is looked for in the line, not in ``_held``."""
    sets = literal_sets(cfg.rule_sets)
    line = {c: F.col(c) for c in ("line", "st", "code", *(["folded", "folded_code"] if own_text else []))}
    return [rule_set_description(rs, line, F.col(f"c._c{i}"), sets).alias(f"_d{i}") for i, rs in enumerate(cfg.rule_sets)]


def with_held(files: DataFrame, sets) -> DataFrame:
    """Adds what a file's text tells of all its lines: ``_escaped`` (may hold case escapes) and ``_held``
    (``text.held_literals`` of these sets)."""
    escaped = T.has_fold_escape(F.col("text"))
    if "_plain" in files.columns:  # no escape is plain
        escaped = ~F.col("_plain") & escaped
    files = files.withColumns({"_escaped": F.coalesce(escaped, F.lit(False)), "_lower": T.fold(F.col("text"))})
    return files.withColumn("_held", T.held_literals(F.col("_lower"), F.col("_escaped"), sets)).drop("_lower")


def line_findings(cfg: ScanConfig) -> Column:
    """Array of the line's findings, built from the description columns ``_d{i}``; their place and content, the
    same for all, are null."""
    parts = [F.when(F.col(f"_d{i}").isNotNull(),
                    F.array(finding(rs.policy_id, F.lit(None), F.lit(None).cast("string"), F.col(f"_d{i}"), rs.severity)))
             .otherwise(empty_findings())
             for i, rs in enumerate(cfg.rule_sets)]
    return F.concat(*parts)


# -- whole-file detectors -------------------------------------------------------

# Private-use characters: the mark put before each match, those after a head and before a tail of
# the pattern, and what stands for them where a text holds them already (the pattern treats all alike).
_MARK, _HEAD, _TAIL, _STANDIN = "\ue000", "\ue002", "\ue003", "\ue001"
_P1_HEAD, _P1_TAIL = T.in_order(fixed.P1_PATTERN)


# Of a lower-cased stripped text (a \n before each line): a session match that crosses a line end after
# the session, its dot or its last word, or a comment line that may hold one.
_CROSS_RX = (r"(?dU)sparksession(?=\n|[\s\x1c-\x1f]*+\.\n)[\s\x1c-\x1f]*+\.[\s\x1c-\x1f]*+builder", r"(?dU)getorcreate\n[\s\x1c-\x1f]*+\(",
             r"\n#(?=[^\n]*getorcreate)[^\n]*sparksession")


def without_marks(text: Column) -> Column:
    """The text with another character in place of the marks."""
    return F.when(T.contains_any(text, (_MARK, _HEAD, _TAIL)), F.translate(text, _MARK + _HEAD + _TAIL, _STANDIN * 3)).otherwise(text)


def mark_sessions(full: Column, folded: bool = False) -> Column:
    """A text without marks, with a mark before each match of the session pattern.  ``full`` stands in many
    places here: as an expression it would be computed in each.
    ``folded``: whether it is lower-cased and holds no case escapes; it may be stripped.

    ``\\s*`` may cross lines, ``.`` may not: head and tail stand on one line.  Where no line has two
    heads, each line is searched for a tail once, so one search of the text is linear.  Elsewhere heads
    and tails are marked, the mark of a head that no tail follows on its line is taken away, and a match
    must begin with a marked head.  So none begins in vain, and the cost is linear in the file."""
    rx = lambda pattern: F.lit(f"({T.rx(pattern, folded)})")
    many = full.rlike(T.rx(f"{_P1_HEAD}.*{_P1_HEAD}", folded))
    once = F.regexp_replace(full, rx(f"{_P1_HEAD}.*{_P1_TAIL}"), F.lit(_MARK + "$1"))
    full = F.regexp_replace(full, rx(_P1_HEAD), F.lit("$1" + _HEAD))
    full = F.regexp_replace(full, rx(_P1_TAIL), F.lit(_TAIL + "$1"))

    def useful(line: Column) -> Column:
        rest = F.substring_index(line, _TAIL, -1)  # all of it where there is no tail
        return F.when(~line.contains(_HEAD), line).otherwise(F.concat(F.left(line, F.length(line) - F.length(rest)), F.replace(rest, F.lit(_HEAD), F.lit(""))))

    full = F.array_join(F.transform(F.split(full, "\n", -1), useful), "\n")
    pattern = f"{_P1_HEAD}{_HEAD}.*{_TAIL}{_P1_TAIL}"
    return F.when(many, F.regexp_replace(full, rx(pattern), F.lit(_MARK + "$1"))).otherwise(once)


def marked_text(lines: Column) -> Column:
    """``mark_sessions`` of the lines, joined."""
    return mark_sessions(without_marks(F.array_join(lines, "\n")))


def marked_sessions(lines: Column) -> Column:
    """``marked_text``, split into lines again."""
    return F.split(marked_text(lines), "\n", -1)


def may_hold_sessions(folded: Column, text: Column, plain: Column) -> Column:
    """Whether the text may hold a match that the one-line pass does not report (``folded``: its stripped text, lower-cased)."""
    words = T.holds_any(folded, ("sparksession",)) & T.holds_any(folded, ("getorcreate",))
    return (~plain & T.has_fold_escape(text)) | (words & reduce(Column.__or__, (folded.rlike(rx) for rx in _CROSS_RX)))


def told_by_line(line: Column) -> Column:
    """Whether the one-line pass reports the line."""
    return ~T.py_strip(line).startswith("#") & T.matches(line, fixed.P1_PATTERN)


def with_multiline_session(files: DataFrame) -> DataFrame:
    """Adds ``p1b``, the start lines of matches of the session pattern on
    the lines joined by ``\\n``, minus lines the one-line pass reports (J2, inside the row).

    The numbers of the lines that hold a mark are the start lines.  A match that the one-line pass
    does not report crosses a line end or begins on a comment line: files without a sign of either
    are not marked."""
    folded, full = F.col("_folded"), F.col("_full")
    escaped = ~F.col("_plain") & T.has_fold_escape(F.col("text"))
    words = T.holds_any(folded, ("sparksession",)) & T.holds_any(folded, ("getorcreate",))
    maybe = words & reduce(Column.__or__, (folded.rlike(rx) for rx in _CROSS_RX))
    whole = F.when(escaped, without_marks(F.concat(F.lit("\n"), F.array_join("lines", "\n")))).when(maybe, F.when(F.col("_plain"), folded).otherwise(without_marks(folded)))

    # a \\n stands before the first line
    starts = F.transform(F.split("_marked", "\n", -1), lambda line, i: F.when(line.contains(_MARK), i))
    return (files
            .withColumn("_folded", T.fold(F.col("stripped_text")))
            .withColumn("_full", whole)
            .withColumn("_marked", F.when(full.isNotNull(), F.when(escaped, mark_sessions(full)).otherwise(mark_sessions(full, True))))
            .withColumn("_starts", F.when(F.col("_marked").contains(_MARK), F.array_compact(starts)))
            .withColumn("p1b", F.when(F.col("_starts").isNotNull(), F.filter("_starts", lambda n: ~told_by_line(F.element_at(F.col("lines"), n))))
                        .otherwise(F.array().cast("array<int>")))
            .drop("_marked", "_starts", "_folded", "_full"))


def multiline_session_findings(p1b: Column, lines: Column) -> Column:
    return F.transform(p1b, lambda n: finding(1, n, T.py_strip(F.element_at(lines, n)), F.lit(fixed.P1_DESC_MULTI)))


def comment_density_finding(code: Column, comment: Column, cfg: ScanConfig) -> Column:
    """P3 on the A1 counts: nothing for small files, error without comments,
    warning above the ratio; the ratio text is rounded half-even."""
    ratio = code / comment
    ratio_txt = F.bround(ratio, 0).cast("long")
    judged = code > cfg.min_code_lines
    none = finding(3, F.lit(0), F.lit(""), fmt(fixed.P3_DESC_NONE, code=code), "error")
    low = finding(3, F.lit(0), F.lit(""),
                  fmt(fixed.P3_DESC_LOW, comment=comment, code=code, ratio=ratio_txt), "warning")
    return (F.when(judged & (comment == 0), F.array(none))
            .when(judged & (ratio > cfg.max_ratio), F.array(low))
            .otherwise(empty_findings()))


def file_name_finding(path: Column, cfg: ScanConfig) -> Column:
    """Generic stem and not exempt (exempt names compare case-sensitively)."""
    name = T.file_name(path)
    stem = T.file_stem(name)
    bad = ~stem.isin(*cfg.exempt_names) & T.matches(stem, fixed.P6_BAD_NAME)
    return F.when(bad, F.array(finding(6, F.lit(0), name, fmt(fixed.P6_DESC, name=name)))) \
        .otherwise(empty_findings())


def file_findings(cfg: ScanConfig) -> Column:
    """Whole-file findings of one file row (needs lines, code/comment counts)."""
    parts = []
    if _multiline_on(cfg):
        parts.append(multiline_session_findings(F.col("p1b"), F.col("lines")))
    if cfg.comment_density:
        parts.append(comment_density_finding(F.col("code_lines"), F.col("comment_lines"), cfg))
    if cfg.file_names:
        parts.append(file_name_finding(F.col("path"), cfg))
    if not parts:
        return empty_findings()
    return F.when(F.col("text").isNotNull(), F.concat(*parts)).otherwise(empty_findings())


def policy_name(policy_id: Column, cfg: ScanConfig) -> Column:
    m = F.create_map(*[x for pid, name in sorted(cfg.policies.items()) for x in (F.lit(pid), F.lit(name))])
    return F.element_at(m, policy_id)


def _multiline_on(cfg: ScanConfig) -> bool:
    return cfg.multiline_session and any(rs.policy_id == 1 for rs in cfg.rule_sets)


def _reads_content(cfg: ScanConfig) -> bool:
    return bool(cfg.rule_sets) or cfg.comment_density or _multiline_on(cfg) or bool(cfg.frames)


def prepared_files(files: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Pruned, decoded files with line arrays, docstring parity and comment counts;
    only pruned if no detector of ``cfg`` reads contents."""
    f = L.prune(files, cfg.skip_dirs)
    if not _reads_content(cfg):
        return f
    f = L.decode(f)
    f = L.with_line_arrays(f)
    if cfg.comment_density:
        f = L.with_comment_counts(f)
    if _multiline_on(cfg):
        f = with_multiline_session(f)
    return f


def find(files: DataFrame, cfg: ScanConfig | None = None, prepared: bool = False) -> DataFrame:
    """PA: all findings of all policies.  ``files`` has repo, branch, path and
    either ``text`` or ``content``/``read_error``."""
    cfg = cfg or ScanConfig()
    f = files if prepared else prepared_files(files, cfg)
    if not _reads_content(cfg):
        return _named_findings(f, cfg)
    return with_frames(_row_findings(f, cfg), lambda: L.explode_lines(f), cfg)


def with_frames(found: DataFrame, lines: Callable[[], DataFrame], cfg: ScanConfig) -> DataFrame:
    """``found`` with the findings of the policies that are functions over all lines."""
    for pid, function in sorted(cfg.frames.items()):
        own = function(lines())
        content = F.col("line_content") if "line_content" in own.columns else F.lit(None).cast("string")
        severity = F.col("severity") if "severity" in own.columns else F.lit("error")
        own = own.select("repo", "branch", F.lit(pid).alias("policy_id"), policy_name(F.lit(pid), cfg).alias("policy_name"), F.col("path").alias("file_path"),
                         F.col("line_number").cast("int").alias("line_number"), T.truncate_content(F.coalesce(content, F.lit(""))).alias("line_content"), "description", severity.alias("severity"))
        found = found.unionByName(own)
    return found


def _row_findings(f: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Findings of the detectors that need one file row at a time."""
    f = f.withColumn("file_findings", file_findings(cfg))
    if not cfg.rule_sets:
        whole = f.select("repo", "branch", "path", F.explode(F.arrays_zip("file_findings")).alias("z"))
        return _findings_columns(whole.select("repo", "branch", "path", F.col("z.file_findings").alias("f")), cfg)
    return exploded_findings(f, cfg)


def described_lines(f: DataFrame, cfg: ScanConfig, carried: list[str], first: Column, any_state: bool = False) -> DataFrame:
    """The lines that a rule set finds, with ``carried``, ``pos``, ``st`` and a description column ``_d{i}`` per line
    rule set, and each row's first line (``pos`` 0, or null if it has none) where ``first`` holds.  ``any_state`` is the form
    for rows of few lines or of parts of files: no line is left out for its docstring state (column ``par``, of
    a row that starts outside), and literals are looked for in each line, not in the row's text before."""
    # exploding a zip (not a bare column built by higher-order functions)
    # keeps the generator on the fast path
    # the JVM leaves a method of over 8,000 bytes uncompiled (and many times slower): what all rule sets
    # share is a column, and what all findings of a line share is added after the explode; lines that a rule
    # set may find go through an explode of their own, which begins a new method
    f = with_held(f, [] if any_state else literal_sets(cfg.rule_sets))
    exploded = f.select(*carried, "_escaped", "_held", "_plain",
                        F.posexplode_outer(F.arrays_zip("lines", "w1")).alias("pos", "z"))
    exploded = exploded.withColumns({"line": F.col("z.lines"), "st": T.strip_line(F.col("z.lines"), F.col("_plain"))})
    kept = ["_escaped", "pos", "par", "folded"] if any_state else ["_held", "pos"]
    per_line = exploded.select(
        *carried, "_escaped", "_held", "pos",
        "line", "st", F.col("z.w1").alias("par"), T.fold(F.col("line")).alias("folded"), T.code_part(F.col("line")).alias("code"),
        T.is_comment_line(F.col("st")).alias("comment"))
    conditions = per_line.select(*carried, *kept, "line", "st", "code", *line_conditions(cfg, any_state))
    flags = [F.col(f"_c{i}") for i in range(len(cfg.rule_sets))]
    searched = reduce(Column.__or__, flags) | (is_head() & first)
    lines = conditions.select(
        *carried, *kept, "line", "st", "code",
        F.explode(F.when(searched, F.array(F.struct(*flags)))).alias("c"))
    if any_state:
        lines = lines.withColumn("folded_code", T.code_part(F.col("folded")))
    return lines.select(*carried, *(["par"] if any_state else []), "pos", "st", *line_descriptions(cfg, any_state))


def is_head() -> Column:
    """Whether this is the first line of its row, or stands for a row without lines."""
    return F.coalesce(F.col("pos"), F.lit(0)) == 0


def some_description(cfg: ScanConfig) -> Column:
    return F.coalesce(*(F.col(f"_d{i}") for i in range(len(cfg.rule_sets)))).isNotNull()


def exploded_findings(f: DataFrame, cfg: ScanConfig) -> DataFrame:
    """The findings of the lines of each row, and its ``file_findings``."""
    own = F.size("file_findings") > 0
    described = described_lines(f, cfg, ["repo", "branch", "path", "file_findings"], own)
    # no filter: it would be pushed below the descriptions and compute them twice
    some = some_description(cfg) | (is_head() & own)
    every = F.concat(line_findings(cfg), F.when(is_head(), F.col("file_findings")).otherwise(empty_findings()))
    found = described.select("repo", "branch", "path", "pos", "st", F.explode(F.when(some, every)).alias("f"))
    return _findings_columns(found, cfg, F.coalesce("f.line_number", (F.col("pos") + 1).cast("int")), F.coalesce("f.line_content", T.truncate_content(F.col("st"))))


def _named_findings(files: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Findings of policy 6 alone: paths, and whether a file could be read if the
    files say so, but no contents."""
    if not cfg.file_names:
        files = files.where(F.lit(False))
    if "read_error" in files.columns:
        files = files.where(F.col("read_error").isNull())
    return _findings_columns(files.select("repo", "branch", "path", F.explode(file_name_finding(F.col("path"), cfg)).alias("f")), cfg)


def _findings_columns(exploded: DataFrame, cfg: ScanConfig, line_number: Column | None = None, content: Column | None = None) -> DataFrame:
    return exploded.select(
        "repo", "branch",
        F.col("f.policy_id").alias("policy_id"),
        policy_name(F.col("f.policy_id"), cfg).alias("policy_name"),
        F.col("path").alias("file_path"),
        (F.col("f.line_number") if line_number is None else line_number).alias("line_number"),
        (F.col("f.line_content") if content is None else content).alias("line_content"),
        F.col("f.description").alias("description"),
        F.col("f.severity").alias("severity"))
