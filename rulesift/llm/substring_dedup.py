"""Substring dedup by content-defined chunks.

A repeat is a run of ``MIN_WORDS`` words or more, blanks between them included, that
stands byte for byte at an earlier place (by document id and byte).  Every such run
is found; it is enough that each of its windows of ``MIN_WORDS`` words has some
earlier place.

1. *Chunks.*  A gear rolling hash over the 16 bytes from each word on cuts the text: of any
   ``MOST`` words in a row the one with the least hash begins a chunk.  So cuts depend on
   nearby bytes only and come back after an insertion, a chunk has ``MOST`` words at most, and
   a window of ``MIN_WORDS`` words holds a cut with ``NAMED`` words after it, wherever it stands.
   A chunk is named by the digest of the ``NAMED`` words from its cut.
2. *Dedup by digest.*  Chunks are shuffled by name; those of one place only go, and
   with them the windows that hold them first.
3. *Windows* of the chunks left are shuffled by their own digest; each but the first knows the
   first place.  That is one shuffle and a sort; if a chunk has more than ``HOT`` places, the windows
   of such chunks take a minimum that is combined on the map side and a join instead, so a
   passage that a third of all documents hold is no one task's.
4. Per document, in order, overlapping windows of one source in one distance are
   joined to spans; spans inside another one go.

Documents with the same text are one to steps 1 to 4: the first of them has its windows made, all of
them, and its copies get the spans of these windows' first places.

Spans of one document can overlap (one source holds the first part, another the rest).

Defined cases: null and empty texts have no repeats; rows of one id are one document
(a repeated row is not a repeat of itself); a passage that recurs within a document
is a repeat there too; rows without an id are not searched; a text of megabytes is cut whole; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from rulesift.llm.workers import frugal
from rulesift.session import materialize

WINDOW = 16
MIN_WORDS = 50
#: Words that name a chunk, and the most words of a chunk.
NAMED, MOST = 25, 26
#: Places of a chunk from which on its windows are not sorted together.
HOT = 4096
#: Copies of texts are broadcast up to this count, else joined by a shuffle.
BROADCAST_COPIES = 500_000
#: A window's place: its first byte, and the low bits of its size; beside them its word, the
#: high bits of its size, whether its chunk has many places, and whether its text has copies.
SIZE_BITS, HIGH_BITS = 24, 20
#: Words that are hashed at a time, and rows of a batch that leaves a task.
BLOCK, ROWS = 1 << 16, 1 << 18


def gear_table() -> np.ndarray:
    """A 16-bit number per byte, by a multiplicative rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(40)).astype(np.uint16)


_GEAR = gear_table()


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII blanks."""
    x = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(x) + 2, np.int8)
    inside[1:-1] = (x != 32) & ((x < 9) | (x > 13))
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _byte_table() -> np.ndarray:
    """A 64-bit number per byte."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _mixed(x)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _byte_table()


def gear(text: bytes, starts: np.ndarray) -> np.ndarray:
    """The gear hash of the ``WINDOW`` bytes from each start (zero bytes follow the text)."""
    if not len(starts):
        return np.zeros(0, np.uint16)
    h = _GEAR[np.frombuffer(text + bytes(WINDOW), np.uint8)]
    for k in (1, 2, 4, 8):  # h[i] becomes the sum of gear[byte[i + j]] << j over the next 2 k bytes
        h[:-k] = h[:-k] + (h[k:] << np.uint16(k))
    return h[starts]


def chosen(text: bytes, starts: np.ndarray) -> np.ndarray:
    """The cut (the word with the least gear hash, the first of equal ones) of each window of ``MIN_WORDS`` words."""
    count = len(starts) - MIN_WORDS + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    inside = np.lib.stride_tricks.sliding_window_view(gear(text, starts)[:len(starts) - NAMED + 1], MOST)
    return np.arange(count) + np.concatenate([inside[k:k + BLOCK].argmin(1) for k in range(0, count, BLOCK)])


def cuts(text: bytes) -> np.ndarray:
    """Bytes at which the chunks of a text begin."""
    starts, _ = word_bounds(text)
    return starts[np.unique(chosen(text, starts))]


def grams(text: bytes, starts: np.ndarray, ends: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """Digest of the text from each of these words to the end of the n-th word from there."""
    data, mult = np.frombuffer(text, np.uint8), np.uint64(0xD6E8FEB86659FD93)
    parts = [np.zeros(0, np.uint64)]  # of words and the blanks after them, in turn
    for k in range(0, len(starts), BLOCK):
        first, last = starts[k:k + BLOCK], ends[k:k + BLOCK]
        after = starts[k + BLOCK] if k + BLOCK < len(starts) else last[-1] + 1
        bounds = np.append(np.stack([first, last], 1).ravel(), after) - first[0]
        sizes, runs = np.diff(bounds), bounds[:-1]
        powers = np.cumprod(np.full(sizes.max(), mult))
        place = np.arange(bounds[-1]) - np.repeat(runs, sizes)
        values = _BYTES[data[first[0]:after]]
        if len(values) < bounds[-1]:  # nothing follows the last word
            values = np.append(values, np.uint64(0))
        parts.append(_mixed(np.add.reduceat(values * powers[place], runs)))
    whole = np.concatenate(parts)
    words = whole[::2]
    units = words * mult + whole[1::2]
    h = np.zeros(len(at), np.uint64)
    for k in range(n - 1):
        h = h * mult + units[at + k]
    return _mixed(h * mult + words[at + n - 1]) if len(at) else h


def _rows(docs: DataFrame, names: list[str], per_text) -> DataFrame:
    """(id, *names): for each row of ``docs`` (id, text, ...) the columns of 64-bit integers that ``per_text`` gives for its bytes and other values."""
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, counts, columns = [], [], []

            def flush(batch=batch):
                ids = batch.column(0).take(pa.array(np.repeat(np.array(place, np.int64), counts)))
                out = pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(x)) for x in zip(*columns, strict=True))], names=schema.fieldNames())
                for x in (place, counts, columns):
                    x.clear()
                return out

            for i, (text, *others) in enumerate(zip(*batch.columns[1:], strict=True)):
                found = per_text((text.as_py() or "").encode("utf-8", "surrogatepass"), *others)
                if len(found[0]):
                    place.append(i)
                    counts.append(len(found[0]))
                    columns.append([x.view(np.int64) for x in found])
                    if sum(counts) >= ROWS:
                        yield flush()
            if place:
                yield flush()

    return docs.mapInArrow(frugal(run), schema)


def _chunks(docs: DataFrame) -> DataFrame:
    """(id, digest, at) of every chunk."""

    def per_text(text: bytes):
        starts, ends = word_bounds(text)
        cut = np.unique(chosen(text, starts))
        return grams(text, starts, ends, NAMED, cut), starts[cut]

    return _rows(docs, ["digest", "at"], per_text)


def _windows(marked: DataFrame) -> DataFrame:
    """(id, digest, place, beside) of the windows cut by one of the ``marks`` (bytes where chunks begin, and
    whether these have many places); of all windows of texts with copies."""

    def per_text(text: bytes, marks: pa.Scalar, hot: pa.Scalar, twin: pa.Scalar):
        starts, ends = word_bounds(text)
        choice = chosen(text, starts)
        marks, hot = (x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int64) for x in (marks, hot))
        order = np.argsort(marks)
        marks, hot = np.append(marks[order], -1), np.append(hot[order], 0)  # nothing is at -1
        cut = starts[choice]
        at_mark = np.minimum(np.searchsorted(marks[:-1], cut), max(len(marks) - 2, 0))
        known = marks[at_mark] == cut
        word = np.flatnonzero(known | twin.as_py())
        at = starts[word]
        size = ends[word + MIN_WORDS - 1] - at
        many = np.where(known, hot[at_mark], 0)[word].astype(np.int64)
        place = (at << SIZE_BITS) | (size & ((1 << SIZE_BITS) - 1))
        return grams(text, starts, ends, MIN_WORDS, word), place, (word << (HIGH_BITS + 2)) | ((size >> SIZE_BITS) << 2) | (many << 1) | int(twin.as_py())

    return _rows(marked, ["digest", "place", "beside"], per_text)


def _spans(windows: DataFrame) -> DataFrame:
    """(id, role, source, start, end, words): joined windows, from rows sorted by id, role and place."""
    kind = windows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("role", T.IntegerType()), T.StructField("source", kind), *(T.StructField(n, T.LongType()) for n in ("start", "end", "words"))])
    low, high = (1 << SIZE_BITS) - 1, (1 << HIGH_BITS) - 1

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, spans, open_, now, id_type = [], [], {}, None, None  # open_: the last span of each source and distance

        def close():
            reached = -1
            for start, end, first, last, source in sorted(spans, key=lambda x: (x[0], -x[1])):
                if end > reached:
                    rows.append((*now, source, start, end, last - first + MIN_WORDS))
                    reached = end
            spans.clear()
            open_.clear()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [id_type, pa.int32(), id_type, *[pa.int64()] * 3], strict=True)], names=schema.fieldNames())
            rows.clear()
            return out

        for batch in batches:
            id_type = batch.column(0).type
            for id_, role, place, beside, source, source_place in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                at, size, word = place >> SIZE_BITS, (place & low) | ((beside >> 2) & high) << SIZE_BITS, beside >> (HIGH_BITS + 2)
                if (id_, role) != now:
                    close()
                    now = (id_, role)
                source_at = source_place >> SIZE_BITS
                span = open_.get((source, at - source_at))
                if span and at < span[1]:
                    span[1], span[3] = max(span[1], at + size), max(span[3], word)
                else:
                    spans.append([at, at + size, word, word, source])
                    open_[source, at - source_at] = spans[-1]
            if len(rows) >= 4096:
                yield flush()
        close()
        if rows:
            yield flush()

    return windows.mapInArrow(frugal(join), schema)


def _to_tasks(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has at most ``BROADCAST_COPIES`` rows."""
    return F.broadcast(table) if table.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES else table


def _copies(docs: DataFrame) -> DataFrame:
    """(id, a, b, original) of every document whose text (named by two hashes) several ids have."""
    named = docs.select("id", "a", "b").distinct()
    several = named.groupBy("a", "b").agg(F.min("id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    return named.join(several, ["a", "b"]).select("id", "a", "b", "original")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, source, start, end, n_words): spans, in bytes, of at least ``MIN_WORDS`` words seen earlier in ``source``."""
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    docs = docs.withColumns({"a": F.xxhash64("text"), "b": F.xxhash64(F.lit("second"), "text")})
    copies = materialize(_copies(docs), "copies")
    docs = docs.join(_to_tasks(copies), ["id", "a", "b"], "left").where("original IS NULL OR original = id")
    docs = docs.select("id", "text", F.col("original").isNotNull().alias("twin"))

    chunks = materialize(_chunks(docs.select("id", "text")), "chunks")
    several = materialize(chunks.groupBy("digest").count().where("count > 1").select("digest", (F.col("count") > HOT).alias("hot")), "chunk_digests")
    marks = chunks.join(several, "digest").groupBy("id").agg(F.collect_list(F.struct("at", "hot")).alias("m")).select("id", "m.at", "m.hot")
    marked = docs.join(materialize(marks, "marks"), "id", "left").where("at IS NOT NULL OR twin")
    windows = _windows(marked.select("id", "text", F.col("at").alias("marks"), "hot", "twin"))
    place = F.struct("id", "place")

    def sorted_together(windows: DataFrame) -> DataFrame:
        return windows.withColumn("first", F.min(place).over(W.partitionBy("digest")))

    if several.where("hot").isEmpty():
        placed = sorted_together(windows)
    else:
        windows = materialize(windows, "windows")
        is_hot = F.col("beside").bitwiseAND(2) == 2  # the same for all places of a window: it holds its chunk
        hot = windows.where(is_hot)
        first = hot.groupBy("digest").agg(F.min(place).alias("first"))
        # written first: the join is then one of two plain shuffles, in which Spark splits a hot digest
        placed = sorted_together(windows.where(~is_hot)).unionByName(hot.join(materialize(first, "first_places"), "digest"))
    # role 0: the document's own repeats; role 1: what its copies repeat, all of its windows
    own = F.when(F.struct("id", "place") != F.col("first"), F.lit(0))
    twin = F.when(F.col("beside").bitwiseAND(1) == 1, F.lit(1))
    again = placed.select("id", F.explode(F.array_compact(F.array(own, twin))).alias("role"), "place", "beside", F.col("first.id").alias("source"), F.col("first.place").alias("source_place"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = materialize(_spans(again.repartition(n, "id").sortWithinPartitions("id", "role", "place")), "spans")
    others = copies.where("id <> original").select(F.col("id").alias("copy"), F.col("original").alias("id")).distinct()
    of_copies = spans.where("role = 1").join(others, "id").select(F.col("copy").alias("id"), "source", "start", "end", "words")
    return spans.where("role = 0").select("id", "source", "start", "end", "words").union(of_copies).select(F.col("id").alias(id_col), "source", "start", "end", F.col("words").alias("n_words"))


def remove(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the spans of ``repeats``; a character cut at a span's edge goes with it."""
    by_doc = spans.groupBy(F.col(id_col).alias("span id")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cut")).select("span id", F.to_json("cut").alias("cut"))

    @F.pandas_udf("string")
    def keep(texts: pd.Series, cut: pd.Series) -> pd.Series:
        import json

        out = []
        for text, spans in zip(texts, cut, strict=True):
            if text is not None and spans is not None:
                data, at, kept = text.encode(), 0, b""
                for span in json.loads(spans):
                    kept += data[at:max(at, span["start"])]
                    at = max(at, span["end"])
                text = (kept + data[at:]).decode(errors="ignore")
            out.append(text)
        return pd.Series(out, dtype=object)

    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("doc id")).join(by_doc, F.col("doc id") == F.col("span id"), "left")
    rows = rows.withColumn("kept", keep(F.col("doc").getField(text_col), F.col("cut")))
    return rows.select(*(F.col("kept").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns))
