"""Quality rules on repetition: characters inside duplicated n-grams and lines.

Words are `[^\\x20\\x09-\\x0D]+`.  Every window of n words gets a rolling hash (one prefix
sum over the word hashes serves all n), salted by its text, so that many texts are
measured at a time.  A window that is repeated at n + 1 words starts with one repeated at n
words, so each length looks only at the places that the length before has left.

Measures of a text (whole texts, code points inside words as characters):

* ``top_chars_n`` (n in ``TOP``): the most that occurrences of one n-gram found at least
  twice add up to;
* ``dup_chars_n`` (n in ``DUPLICATE``): characters of words that lie in a window found
  earlier in the text, each counted once;
* ``dup_line_chars``: characters of lines equal to an earlier line;
* ``n_words``, ``word_chars``, ``n_lines`` (\\n-split lines with a word), ``n_dup_lines``
  (those equal to an earlier line), ``n_symbols`` (characters of ``SYMBOLS``),
  ``n_repeat_words`` (words in windows of three words found twice or more, first included).

``judge`` adds ``base_failed`` (under ``LEAST_WORDS`` words, or more than ``MOST_REPEATED``
percent of the words in repeated three-word windows) and ``kept``: not failed, and no
measure above its share of the text's characters (or lines).  The limits are those of
Rae et al., "Scaling Language Models" (2021), table A1.

A map over rows without a shuffle; a task holds arrays of about ``CHUNK`` bytes of
text at a time, or of one longer text.

Defined cases: null or empty text, or blanks only: all measures 0, not kept; a text of
megabytes is measured whole, alone; rows that share an id, repeated rows and rows without
an id are measured each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulesift.llm.shingles import CHUNK, Hasher, _mix

LEAST_WORDS = 50
MOST_REPEATED = 50
SYMBOLS = b"#*$%&|<>"
#: Most characters, in percent of a text's, per window length.
TOP = {2: 20, 3: 18, 4: 16}
DUPLICATE = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
MOST_LINE_CHARS = 20
#: Most lines equal to an earlier one, in percent.
MOST_LINES = 30
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "dup_line_chars",
           *(f"top_chars_{n}" for n in TOP), *(f"dup_chars_{n}" for n in DUPLICATE)]


class Measurer:
    """Measures groups of texts; keeps tables between calls."""

    def __init__(self):
        self.hasher = Hasher()
        self.symbol = np.zeros(256, bool)
        self.symbol[list(SYMBOLS)] = True

    def measure(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Every column of ``COLUMNS`` for these texts (UTF-8)."""
        data = b" ".join(texts)
        x = np.frombuffer(data, np.uint8)
        words, starts = self.hasher.words(data)
        firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        bounds = np.searchsorted(starts, firsts)
        text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))

        def sums(values: np.ndarray) -> np.ndarray:
            return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])

        points = sums(((x & 0xC0) != 0x80) & ~self.hasher.blank[x])
        chars = points[np.append(starts, len(x))]  # of the words before each word: blanks between count nothing
        symbols = sums(self.symbol[x])[np.minimum(firsts, len(x))]
        out = {"n_words": np.diff(bounds), "word_chars": np.diff(chars[bounds]), "n_symbols": np.diff(symbols)}
        out |= dict(zip(("n_lines", "n_dup_lines", "dup_line_chars"), np.array([_lines(t) for t in texts], np.int64).reshape(-1, 3).T, strict=True))

        rolled = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.hasher.powers[:len(words)], dtype=np.uint64)])
        salt = _mix(np.arange(1, len(texts) + 1, dtype=np.uint64))
        at = np.arange(len(words))

        def covered(places: np.ndarray, n: int) -> np.ndarray:
            """Words in the windows of n words that start at these places."""
            size = len(words) + 1
            return np.cumsum(np.bincount(places, minlength=size) - np.bincount(places + n, minlength=size))[:-1] > 0

        for n in range(min(TOP), max(DUPLICATE) + 1):
            at = at[at + n <= bounds[text_of[at] + 1]]
            hashed = _mix((rolled[at + n] - rolled[at]) * self.hasher.inverses[at] + salt[text_of[at]])
            order = np.argsort(hashed, kind="stable")
            new = np.append(True, hashed[order][1:] != hashed[order][:-1])[:len(at)]
            count = np.diff(np.append(np.flatnonzero(new), len(at)))
            twice = np.repeat(count > 1, count)
            heads = at[order[new]][count > 1]
            later, at = at[order[~new]], np.sort(at[order[twice]])
            if n == 3:
                out["n_repeat_words"] = np.diff(sums(covered(at, n))[bounds])
            if n in TOP:
                most = np.zeros(len(texts), np.int64)
                np.maximum.at(most, text_of[heads], count[count > 1] * (chars[heads + n] - chars[heads]))
                out[f"top_chars_{n}"] = most
            if n in DUPLICATE:
                out[f"dup_chars_{n}"] = np.diff(sums(covered(later, n) * np.diff(chars))[bounds])
        return out


def _lines(text: bytes) -> tuple[int, int, int]:
    """Lines with a word, those equal to an earlier one, and the characters of these."""
    seen, n, repeated, size = set(), 0, 0, 0
    for line in text.split(b"\n"):
        if words := line.split():
            n += 1
            if line in seen:
                repeated += 1
                size += len(b"".join(words).decode("utf-8", "replace"))
            seen.add(line)
    return n, repeated, size


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the columns of ``COLUMNS`` for every row."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in COLUMNS)])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measurer = Measurer()
        for batch in batches:
            first, group, size = 0, [], 0
            for k, text in enumerate(batch.column(1)):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if group and size + len(data) > CHUNK:
                    yield answer(measurer, batch, first, group)
                    first, group, size = k, [], 0
                group.append(data)
                size += len(data) + 1
            if group:
                yield answer(measurer, batch, first, group)

    def answer(measurer: Measurer, batch: pa.RecordBatch, first: int, group: list[bytes]) -> pa.RecordBatch:
        found = measurer.measure(group)
        return pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(group)), *(pa.array(found[c].astype(np.int64)) for c in COLUMNS)], names=names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measures`` with ``base_failed`` and ``kept``."""
    found = measures(docs, id_col, text_col)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    fine = (100 * F.col("n_dup_lines") <= MOST_LINES * F.col("n_lines")) & (100 * F.col("dup_line_chars") <= MOST_LINE_CHARS * F.col("word_chars"))
    for name, limits in (("top", TOP), ("dup", DUPLICATE)):
        for n, most in limits.items():
            fine &= 100 * F.col(f"{name}_chars_{n}") <= most * F.col("word_chars")
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)
