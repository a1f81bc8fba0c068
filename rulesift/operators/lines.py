"""Files → lines, and the per-file docstring state machines.

Design: a source file is one row.  Everything that needs the order of lines
inside one file (docstring parity W1, docstring automaton W2, comment counts A1,
the cross-line session search P1b) is computed *inside that row* with built-in
array and string expressions whose cost is linear in the file size.  The line
table is then a ``posexplode`` of the row, so lines never leave the task that
read their file: the whole findings computation is a map-only stage with no
shuffle and no window over lines, whatever the corpus size.

State machines as string algebra (both exact, linear):

* W1 parity (policy 2): a line with an odd number of triple quotes flips the
  state.  Write one flag character per line (``1`` flip, ``0`` no flip) and
  ``split`` the flag string at ``1``: run ``k`` of zeros and the flip line that
  ends it all have ``k`` flips before them, so their state is ``k % 2``.
* W2 automaton (policy 3): outside a docstring, a line *starting* with a marker
  that is not closed on the line opens; inside, any marker closes.  So an
  opener toggles (``T``), any other line with a marker resets to outside
  (``R``), other lines keep the state.  Split at ``R`` into segments (state 0
  at each start), then each segment at ``T`` as for W1; the ``R`` line itself
  has the parity of the toggles of its segment before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulesift import fixed
from rulesift.functions import text as T


def empty_int_array() -> Column:
    return F.array().cast("array<int>")


def prune(files: DataFrame, skip_dirs) -> DataFrame:
    """Drop files below a skipped directory."""
    return files.where(~T.in_skipped_dir(F.col("path"), skip_dirs))


def within_limit(files: DataFrame, limit: int = fixed.MAX_ARCHIVE_BYTES) -> DataFrame:
    """Files of at most ``limit`` bytes of text, with their ``length``."""
    return files.withColumn("length", F.octet_length("text").cast("long")).where(F.col("length") <= limit)


def decode(files: DataFrame) -> DataFrame:
    """S6 (decode): ``content`` bytes → ``text``; rows with a read error keep a null text."""
    if "text" in files.columns:
        return files
    return files.withColumn("text", F.when(F.col("read_error").isNull(), T.decode_utf8(F.col("content"))))


def _states_with_tail(flags: Column, flip: str) -> Column:
    """Per character of ``flags`` plus one past the end: parity of ``flip``
    characters strictly before it.  Run ``k`` between flips gives ``length + 1``
    entries (its characters and the flip that ends it) of value ``k % 2``; the
    last run's extra entry is the phantom position after the string.  The lambda
    refers to nothing outside itself, so it stays linear."""
    return F.flatten(F.transform(
        F.split(flags, flip, -1),
        lambda run, k: F.array_repeat((k % 2).cast("int"), F.length(run) + 1)))


def w1_flags(lines: Column) -> Column:
    """One character per line: ``1`` if the line has an odd number of triple quotes."""
    return F.array_join(F.transform(lines, lambda l: F.when(T.has_triple_quote(l) & (T.triple_quotes(l) % 2 == 1), "1").otherwise("0")), "")


def w1_parity(flags: Column) -> Column:
    """Per line, 1 inside a docstring for policy 2 (state before the line)."""
    return F.slice(_states_with_tail(flags, "1"), 1, F.length(flags))


def w1_states(text: Column, n: Column, plain: Column | None = None) -> Column:
    """W1 of all ``n`` lines of a text whose lines end with ``\\n``: a line's state is the parity of the
    markers before it.  Between two markers it is the same, so only their number is looked at.
    ``plain``: whether the text holds no control character, which can then stand for both markers
    (a split at one character compiles no pattern)."""
    one = F.replace(F.replace(text, F.lit(T.TQ_DOUBLE), F.lit("\x01")), F.lit(T.TQ_SINGLE), F.lit("\x01"))
    parts = F.split(text, f"{T.TQ_DOUBLE}|{T.TQ_SINGLE}", -1)
    if plain is not None:
        parts = F.when(plain, F.split(one, "\x01", -1)).otherwise(parts)
    runs = F.transform(parts, lambda s, k: F.array_repeat((k % 2).cast("int"), T.count_breaks(s)))
    return F.slice(F.concat(F.array(F.lit(0)), F.flatten(runs)), 1, n)


def w2_flags(stripped: Column) -> Column:
    """One character per line: ``T`` opener, ``R`` other line with a marker, ``0`` else."""
    def flag(s: Column) -> Column:
        starts_dq = s.startswith(T.TQ_DOUBLE)
        starts_sq = s.startswith(T.TQ_SINGLE)
        opener = (starts_dq & (T.count_substr(s, T.TQ_DOUBLE) < 2)) | \
                 (~starts_dq & starts_sq & (T.count_substr(s, T.TQ_SINGLE) < 2))
        return F.when(~T.has_triple_quote(s), "0").when(opener, "T").otherwise("R")
    return F.array_join(F.transform(stripped, flag), "")


def w2_state(flags: Column) -> Column:
    """Per line, 1 where the line starts inside a docstring for policy 3.
    Each ``R``-segment yields its characters plus the ``R`` after it, whose
    state is the parity of the segment's toggles; the phantom ``R`` after the
    last segment is cut off."""
    per_segment = F.transform(F.split(flags, "R", -1), lambda seg: _states_with_tail(seg, "T"))
    return F.slice(F.flatten(per_segment), 1, F.length(flags))


def line_classes(stripped: Column, state: Column) -> Column:
    """A1 per-line class as one character, given the W2 state before the line:
    ``.`` blank, ``x`` inside a docstring, ``m`` starts with a marker, ``h`` starts
    with ``#``, ``i`` code with an inline `` #``/``\\t#``, ``c`` other code."""
    def cls(s: Column, st: Column) -> Column:
        return (F.when(s == "", ".")
                .when(st == 1, "x")
                .when(s.startswith(T.TQ_DOUBLE) | s.startswith(T.TQ_SINGLE), "m")
                .when(s.startswith("#"), "h")
                .when(F.contains(s, F.lit(" #")) | F.contains(s, F.lit("\t#")), "i")
                .otherwise("c"))
    return F.array_join(F.zip_with(stripped, state, cls), "")


def count_chars(s: Column, chars: str) -> Column:
    return (F.length(s) - F.length(F.regexp_replace(s, f"[{chars}]", ""))).cast("long")


def _zeros(array: str) -> Column:
    return F.array_repeat(F.lit(0), F.size(array))


def with_line_arrays(files: DataFrame) -> DataFrame:
    """Adds ``lines``, ``stripped`` (arrays), ``stripped_text``, ``w1`` parity (array) and ``_plain`` per file.
    Each array is its own column so that no expression is evaluated twice."""
    parts, text = F.col("_parts"), F.col("text")
    return (files
            .withColumn("_plain", T.is_plain(text))
            .withColumn("_parts", T.split_at_breaks(text, F.col("_plain")))
            .withColumn("lines", F.coalesce(
                F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts),
                F.array().cast("array<string>")))
            .drop("_parts")
            .withColumn("stripped_text", T.stripped_text(text, F.col("lines"), F.col("_plain")))
            .withColumn("stripped", F.coalesce(F.slice(F.split("stripped_text", "\n", -1), 2, F.size("lines")), F.array().cast("array<string>")))
            .withColumn("w1", F.when(T.has_triple_quote(text), w1_states(F.when(F.col("_plain"), text).otherwise(F.array_join("lines", "\n")), F.size("lines"), F.col("_plain"))).otherwise(_zeros("lines"))))


def _opened(marker: str) -> str:
    """A line that opens a docstring and all up to the line that ends it (or the text's end), as W2 goes."""
    return rf"{marker}(?![^\n]*{marker})[^\n]*+\n(?s:.*?)(?:{T.TQ_DOUBLE}|{T.TQ_SINGLE}|\z)[^\n]*+"


#: Lines that are no code: those of docstrings, those that begin with a marker, comment lines.
_NO_CODE_RX = rf"\n(?=[#'\"])(?:{_opened(T.TQ_DOUBLE)}|{_opened(T.TQ_SINGLE)}|(?:#|{T.TQ_DOUBLE}|{T.TQ_SINGLE})[^\n]*+)"


#: The breaks before blank lines and at the text's end.
BLANK_RX = r"\n+(?=\n|\z)"


def inline_comments(code: Column) -> Column:
    """Lines of code with an inline comment."""
    return F.when(T.contains_any(code, (" #", "\t#")), F.regexp_count(code, F.lit(r"[ \t]#[^\n]*+"))).otherwise(0).cast("long")


def without_comments(solid: Column) -> Column:
    """The lines of code of a stripped text without blank lines."""
    return F.regexp_replace(solid, _NO_CODE_RX, "")


def with_comment_counts(files: DataFrame) -> DataFrame:
    """A1: ``code_lines`` and ``comment_lines`` per file (needs the columns of ``with_line_arrays``).

    Searches of the whole stripped text: blank lines go, then what is no code, left to right as the automaton
    W2 goes, and the line breaks of both are counted; a line with text is code, a comment, or (with an inline comment) both."""
    files = (files
             .withColumn("_f2", F.when(T.has_triple_quote(F.col("text")), w2_flags(F.col("stripped"))))
             .withColumn("w2", F.when(F.col("_f2").isNotNull(), w2_state(F.col("_f2"))).otherwise(_zeros("lines"))))
    return (files
            .withColumn("_solid", F.regexp_replace(F.coalesce("stripped_text", F.lit("")), BLANK_RX, ""))
            .withColumn("_code", without_comments(F.col("_solid")))
            .withColumn("code_lines", T.count_breaks(F.col("_code")).cast("long"))
            .withColumn("comment_lines", T.count_breaks(F.col("_solid")) - F.col("code_lines") + inline_comments(F.col("_code")))
            .drop("_f2", "_solid", "_code"))


def explode_lines(files: DataFrame, keep=("repo", "branch", "path")) -> DataFrame:
    """One row per line, ``line_number`` from 1, with ``stripped`` and ``in_docstring``."""
    z = F.arrays_zip("lines", "stripped", "w1")
    return (files.select(*keep, F.posexplode(z).alias("pos", "z"))
            .select(*keep,
                    (F.col("pos") + 1).cast("int").alias("line_number"),
                    F.col("z.lines").alias("line"),
                    F.col("z.stripped").alias("stripped"),
                    F.col("z.w1").alias("in_docstring")))
