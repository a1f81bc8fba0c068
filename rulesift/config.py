"""Scan parameters and the policy registry (user extension surface).

Rules are plain ``(pattern, description)`` pairs; they become literal ``rlike``
expressions (one compiled pattern per task), never UDFs and never a join against
a table of patterns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame

from rulesift import fixed

# Scopes of a line rule set:
#   "line"      - every line that is not a comment line (policies 1, 4, 5, 7)
#   "code_part" - text before '#', skipping comment lines, lines with triple
#                 quotes and lines inside a docstring (policy 2)
SCOPES = ("line", "code_part")


@dataclass(frozen=True)
class RuleSet:
    """Ordered rules of one policy: the first matching rule gives the finding.

    ``function`` is the other form of a policy: it takes the text (the line or its
    code part) and the stripped line as columns and gives the description column,
    null where there is no finding; it comes after the rules."""
    policy_id: int
    rules: tuple[tuple[str, str], ...] = ()
    scope: str = "line"
    severity: str = "error"
    # Lower-case literals of which at least one occurs (case-folded) in every
    # line some rule matches: a cheap exact pre-check before the regexes.
    requires: tuple[str, ...] = ()
    function: Callable[[Column, Column], Column] | None = None

    @property
    def literals(self) -> list[tuple[str, ...]]:
        """All sets of literals that a file's text is searched for: that of the rules together, those of single rules."""
        return [self.requires, *(RULE_REQUIRES.get(pattern, ()) for pattern, _ in self.rules)]

    def __post_init__(self):
        if self.scope not in SCOPES:
            raise ValueError(f"scope must be one of {SCOPES}")


# Pre-check literals of the default rule sets, read off the patterns: every
# rule of the set contains one of them as a plain (case-insensitive) run.
P1_REQUIRES = ("sparksession",)
P2_REQUIRES = ("'", '"')
P4_REQUIRES = ("format", "create", "stored")
P5_REQUIRES = ("create",)
P7_REQUIRES = ("urllib.request.url", "requests.get", "wget", "subprocess", "os.system",
               "shutil.copyfileobj", "dbutils.fs.cp", "gdown.download",
               "tf.keras.utils.get_file", "torch.hub.download")

# The same for single rules, by pattern, as far as one has such literals: where a file's text has
# none of them, the rule is not searched for on its lines.
RULE_REQUIRES = {pattern: literals for (pattern, _), literals in zip(fixed.P2_RULES, (
    ("'/", '"/'), (":\\",), ("s3://", "s3a://"), ("abfs",), ("gs://",), ("wasb",),
    ("password", "passwd", "pwd", "secret", "api_key", "apikey", "access_key", "private_key", "token"),
    ("@",), ("://",), ()), strict=True)}


def default_rule_sets() -> tuple[RuleSet, ...]:
    return (
        RuleSet(1, ((fixed.P1_PATTERN, fixed.P1_DESC_LINE),), "line", requires=P1_REQUIRES),
        RuleSet(2, tuple(fixed.P2_RULES), "code_part", requires=P2_REQUIRES),
        RuleSet(4, tuple(fixed.P4_RULES), "line", requires=P4_REQUIRES),
        RuleSet(5, tuple(fixed.P5_RULES), "line", requires=P5_REQUIRES),
        RuleSet(7, tuple(fixed.P7_RULES), "line", requires=P7_REQUIRES),
    )


@dataclass(frozen=True)
class ScanConfig:
    skip_dirs: tuple[str, ...] = fixed.SKIP_DIRS
    exempt_names: tuple[str, ...] = fixed.EXEMPT_FILENAMES
    min_code_lines: int = fixed.P3_MIN_CODE_LINES
    max_ratio: int = fixed.P3_MAX_RATIO
    policies: dict[int, str] = field(default_factory=lambda: dict(fixed.POLICIES))
    rule_sets: tuple[RuleSet, ...] = field(default_factory=default_rule_sets)
    multiline_session: bool = True     # policy 1 second pass over the joined text
    comment_density: bool = True       # policy 3
    file_names: bool = True            # policy 6
    # policies that are functions from all lines to findings
    frames: dict[int, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def with_policy(self, policy_id: int, name: str, rules=(), scope: str = "line", severity: str = "error",
                    requires: tuple[str, ...] = (), function: Callable[[Column, Column], Column] | None = None,
                    frame: Callable[[DataFrame], DataFrame] | None = None) -> "ScanConfig":
        """Add a policy, or replace one with all its detectors.  Without rules and
        function the policy is listed and never has findings.

        ``frame`` is the form for policies that look beyond one line: it takes the lines of all files
        (repo, branch, path, line_number, line, stripped, in_docstring) and gives findings (repo, branch,
        path, line_number, description, and line_content and severity if it likes), by any joins,
        windows or aggregates.  It is planned into the scan beside the other detectors and reads
        the files once more; findings are unique by file and line."""
        kept = self.without(policy_id)
        sets = kept.rule_sets
        if rules or function:
            sets += (RuleSet(policy_id, tuple(tuple(r) for r in rules), scope, severity, tuple(requires), function),)
        frames = {**kept.frames, **({policy_id: frame} if frame else {})}
        return replace(kept, policies={**self.policies, policy_id: name}, rule_sets=sets, frames=frames)

    def without(self, *policy_ids: int) -> "ScanConfig":
        """The same scan with no detector of these policies (they stay listed)."""
        return replace(self, rule_sets=tuple(r for r in self.rule_sets if r.policy_id not in policy_ids),
                       multiline_session=self.multiline_session and 1 not in policy_ids,
                       comment_density=self.comment_density and 3 not in policy_ids,
                       file_names=self.file_names and 6 not in policy_ids,
                       frames={p: f for p, f in self.frames.items() if p not in policy_ids})

    def only(self, *policy_ids: int) -> "ScanConfig":
        """The same scan with the detectors of these policies alone."""
        return self.without(*(p for p in {*self.policies, 1, 3, 6} if p not in policy_ids))
