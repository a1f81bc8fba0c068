"""Scalar column functions on source text.

All of them are built-in Spark expressions: they stay inside whole-stage
codegen (or, for the array forms, inside one projection) and never call Python.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulesift import fixed

TQ_DOUBLE = '"""'
TQ_SINGLE = "'''"


def rx(pattern: str, folded: bool = False) -> str:
    """Pattern with the fixed Java flags (case-insensitive, Unicode, '.' stops at \\n);
    ``\\s`` also takes the four separators U+001C to U+001F, as in Python.  ``folded``: for
    lower-cased text without escapes (``has_fold_escape``), where plain words are searched much faster."""
    blank = r"\s\x1c-\x1f"
    out, inside = [], False
    for piece in re.split(r"(\\.|\[|\])", pattern):
        if piece == r"\s":
            piece = blank if inside else f"[{blank}]"
        elif piece in "[]":
            inside = piece == "[" if piece else inside
        out.append(piece)
    flags = fixed.RX_FLAGS.replace("i", "") if folded else fixed.RX_FLAGS
    return flags + "".join(p.lower() if folded and not p.startswith("\\") else p for p in out)


# An open run in a pattern: any text between what comes before and what comes after.
_OPEN_RUN = re.compile(r"(\\s\+)?\.\*\??(\\s\+)?")


def in_order(pattern: str) -> tuple[str, str] | None:
    """Head and tail of a fixed pattern with one open run, such that the pattern occurs in a line if
    the tail does after the first head; None for other patterns.

    A search that backtracks takes quadratic time (or worse) on a long line with many
    heads and no tail.  The heads of the fixed rules are words, marks and blanks in a row, which match in
    one way only, so the first head ends before any other; ``\\s+.*?\\s+`` is a blank, any text, a blank."""
    if pattern not in _FIXED or len(_OPEN_RUN.findall(pattern)) != 1:
        return None
    run = _OPEN_RUN.search(pattern)
    return pattern[:run.start()] + (r"\s" if run[1] else ""), (r"\s" if run[2] else "") + pattern[run.end():]


_FIXED = {fixed.P1_PATTERN, *(pattern for rules in (fixed.P4_RULES, fixed.P5_RULES, fixed.P7_RULES) for pattern, _ in rules)}


def matches(col: Column, pattern: str) -> Column:
    """Search anywhere in ``col`` (Python ``re.search`` semantics), which is one line; in linear time
    for the fixed rules."""
    parts = in_order(pattern)
    if parts is None:
        return col.rlike(rx(pattern))
    head, tail = parts  # a split compiles its pattern anew for each line, a search does not
    return F.coalesce(F.when(col.rlike(rx(head)), F.get(F.split(col, rx(head), 2), F.lit(1)).rlike(rx(tail))), F.lit(False))


# Non-ASCII characters that Java's Unicode case-insensitive matching equates
# with an ASCII letter (found by testing every code point against [a-z]):
# U+0130, U+0131, U+017F, U+212A.  ``lower`` maps U+212A to 'k'; the other
# three survive ``lower`` (or become two characters), so a line holding one of
# them skips the literal pre-check and goes straight to the regexes.
_FOLD_ESCAPES = ("\u0130", "\u0131", "\u017f")


def fold(col: Column) -> Column:
    """Lower-cased text for literal pre-checks."""
    return F.lower(col)


def has_fold_escape(col: Column) -> Column:
    return contains_any(col, _FOLD_ESCAPES)


def may_contain_any(original: Column, folded: Column, literals, escaped: Column | None = None) -> Column:
    """Exact necessary condition for a case-insensitive (Unicode) regex that
    contains one of ``literals`` (lower case) as a plain run to match.  ``escaped``: whether
    ``original`` may hold one of the escapes, where that is known."""
    if all(lit.lower() == lit.upper() for lit in literals):
        return contains_any(original, literals)
    return contains_any(folded, literals) | (escaped if escaped is not None else has_fold_escape(original))


#: Sets of literals that one number tells of.
MOST_HELD = 60


def _told(sets) -> dict[tuple[str, ...], int]:
    """Only ASCII: what ``lower`` makes of other letters may depend on what stands beside them."""
    told = [s for s in dict.fromkeys(map(tuple, sets)) if s and all(lit.isascii() for lit in s)]
    return {s: 1 << i for i, s in enumerate(told[:MOST_HELD])}


def held_literals(folded: Column, escaped: Column, sets) -> Column:
    """For each of these sets of literals whether a line of the lower-cased text may hold one of them, as one number:
    where none may, the lines need no search.  ``escaped``: whether the text may hold case escapes."""
    zero = F.lit(0).cast("long")
    bits = [F.when(holds_any(folded, s) | escaped, F.lit(bit).cast("long")).otherwise(zero) for s, bit in _told(sets).items()]
    return reduce(Column.bitwiseOR, bits, zero)


def held(number: Column, literals, sets) -> Column:
    """Whether ``held_literals`` says so of this set."""
    bit = _told(sets).get(tuple(literals))
    return number.bitwiseAND(F.lit(bit).cast("long")) != 0 if bit else F.lit(True)


def contains_any(col: Column, literals) -> Column:
    out = None
    for lit in literals:
        c = col.contains(lit)
        out = c if out is None else (out | c)
    return out


def holds_any(text: Column, literals) -> Column:
    """``contains_any`` for long texts: the search of a plain pattern of four letters or more skips
    ahead by its length, where ``contains`` looks at each byte."""
    found = [text.rlike(re.sub(r"([^0-9A-Za-z])", r"\\\1", lit)) if lit.isascii() and len(lit) > 3 else text.contains(lit) for lit in literals]
    return reduce(Column.__or__, found)


def count_breaks(col: Column) -> Column:
    """Number of ``\\n``."""
    return F.octet_length(col) - F.octet_length(F.replace(col, F.lit("\n"), F.lit("")))


def py_strip(col: Column) -> Column:
    """Python ``str.strip()``: trims the full Unicode white-space set at both ends."""
    return F.btrim(col, F.lit(fixed.PY_WHITESPACE))


def decode_utf8(content: Column) -> Column:
    """Bytes → text, invalid sequences replaced by U+FFFD (``errors="replace"``)."""
    return F.make_valid_utf8(content.cast("string"))


# A character other than visible ASCII, space, tab and \n: without one, lines end with \n alone and
# the only blanks are spaces and tabs (a small class is tested much faster than all of Unicode's).
_UNUSUAL_RX = r"[^\n\t -~]"
#: Blanks that end a line; a run of blanks is looked at once, from its begin.
_TAIL_RX = r"[ \t](?<![ \t]{2})[ \t]*+(?=\n|\z)"


def is_plain(text: Column) -> Column:
    """Whether lines end with \\n alone and all blanks are spaces and tabs, for certain."""
    return ~text.rlike(_UNUSUAL_RX)


def strip_line(line: Column, plain: Column) -> Column:
    """``py_strip`` of a line; ``plain``: whether all blanks are spaces and tabs, for certain."""
    blank = reduce(Column.__or__, (test(line, b) for test in (Column.startswith, Column.endswith) for b in (" ", "\t")))
    return F.when(plain & ~blank, line).otherwise(py_strip(line))


def split_at_breaks(text: Column, plain: Column | None = None) -> Column:
    """The parts between line breaks."""
    return F.when(plain if plain is not None else is_plain(text), F.split(text, "\n", -1)).otherwise(F.split(text, fixed.LINE_BREAK_RX, -1))


def stripped_text(text: Column, lines: Column, plain: Column) -> Column:
    """``py_strip`` of each of the text's ``lines``, a \\n before each (and perhaps one at the end)."""
    led = F.concat(F.lit("\n"), text)
    led = F.when(contains_any(led, ("\n ", "\n\t")), F.regexp_replace(led, r"\n[ \t]++", "\n")).otherwise(led)
    ended = contains_any(text, (" \n", "\t\n")) | text.endswith(" ") | text.endswith("\t")
    return F.when(~plain, F.concat(F.lit("\n"), F.array_join(F.transform(lines, py_strip), "\n"))).when(ended, F.regexp_replace(led, _TAIL_RX, "")).otherwise(led)


def split_lines(text: Column) -> Column:
    """Python ``str.splitlines()``: array of lines, no trailing empty element."""
    parts = split_at_breaks(text)
    return F.when(F.element_at(parts, -1) == F.lit(""), F.slice(parts, 1, F.size(parts) - 1)) \
        .otherwise(parts)


def count_substr(col: Column, sub: str) -> Column:
    """Non-overlapping occurrences of ``sub`` (Python ``str.count``)."""
    return F.floor((F.length(col) - F.length(F.replace(col, F.lit(sub), F.lit("")))) / len(sub)).cast("int")


def triple_quotes(col: Column) -> Column:
    """Number of triple-quote markers of both kinds on a line."""
    return count_substr(col, TQ_DOUBLE) + count_substr(col, TQ_SINGLE)


def has_triple_quote(col: Column) -> Column:
    return contains_any(col, (TQ_DOUBLE, TQ_SINGLE))


def is_comment_line(stripped: Column) -> Column:
    return stripped.startswith("#")


def code_part(line: Column) -> Column:
    """Text before the first ``#`` (also cuts at a ``#`` inside a string literal)."""
    return F.when(line.contains("#"), F.substring_index(line, "#", 1)).otherwise(line)


def truncate_content(col: Column) -> Column:
    """Finding snippet: first 150 code points."""
    return F.left(col, F.lit(fixed.LINE_CONTENT_MAX))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(name: Column) -> Column:
    """``pathlib`` stem: the name without its last suffix (``a.b.py`` → ``a.b``).
    A dot at position 0 or at the end does not start a suffix (``.py`` stays).  One search, that
    looks at ``name`` once: it is an expression, built anew wherever it stands."""
    return F.regexp_replace(name, r"(?s)\A(.+)\.[^.]+\z", "$1")


def path_parts(path: Column) -> Column:
    return F.split(path, "/")


def in_skipped_dir(path: Column, skip_dirs) -> Column:
    """True if any path part equals one of ``skip_dirs`` (the file name included)."""
    return F.arrays_overlap(path_parts(path), F.array(*[F.lit(d) for d in skip_dirs]))


def repo_name_from_url(url: Column) -> Column:
    """Repository name from a clone URL: first ``http(s)://github.com/`` removed
    (anywhere, first occurrence only), then a ``.git`` end, then a ``/`` end."""
    step1 = F.regexp_replace(url, r"(?s)^(.*?)https?://github\.com/", "$1")
    step2 = F.regexp_replace(step1, r"\.git\z", "")
    return F.regexp_replace(step2, r"/\z", "")


def escape_pipes(col: Column) -> Column:
    return F.replace(col, F.lit("|"), F.lit("\\|"))
