"""Ranked lexical search: hybrid term-at-a-time, document-at-a-time.

Every document is ranked for every query by summed term impacts; exact, with counts over
all documents.  Terms are the maximal runs of ASCII letters and digits and of characters
from U+0080 on, A-Z lower-cased.

1. *Index.*  Tasks cut the documents into blocks of ``BLOCK_DOCS`` documents or
   ``BLOCK_BYTES`` of text and write, per block, the ids, the lengths and the postings
   (document, tf) of the queries' terms.  Postings stay with their block, so a
   term that all documents hold is in no single task's hands.
2. *Statistics.*  N, L and each query term's df are summed over the blocks by Spark.
3. *Search*, block by block, for each query:
   - lists of at most 1 / ``SHORT`` of the block's documents are materialised, term at a
     time, into summed accumulators;
   - these, as one iterator with the largest accumulator as its bound, and the long lists,
     each with its largest contribution as its bound, are walked document-at-a-time, a
     window of documents at a time.  Iterators whose bounds together stay below the
     query's threshold (the score of the last of its best so far) bring no
     candidates; they are probed, largest bound first, for the candidates that can still reach
     the threshold, and all other postings are skipped.
   A task keeps each query's best from block to block.
4. The best of all tasks are ranked by a window, which cuts them before its shuffle too.

Queries are searched in parts of about ``PART_BYTES`` of query text, each by a pass of
its own: what is collected and broadcast is that text, its terms and their df, so bounded.

Defined cases: a null or empty text, and one without terms, has no term (such a
document is not counted and ranks nowhere, such a query has no rows); texts of megabytes
are cut at term ends and counted whole; equal scores go by ascending id, rows without an id
after the others; repeated rows are documents (or queries) of their own; empty tables give
no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from rulesift.session import materialize

TOP = 10
BLOCK_DOCS, BLOCK_BYTES = 8192, 32 << 20
PART_BYTES = 4 << 20
SHORT = 64
#: Documents of the first window; each next one is twice as large.
WINDOW = 512
#: Bytes of a text whose terms are listed at once.
CHUNK = 4 << 20
TERM, GAP = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def terms(text: bytes) -> Counter:
    """Occurrences of each term of UTF-8 text."""
    found: Counter = Counter()
    text, start = text.lower(), 0
    while start < len(text):
        gap = GAP.search(text, start + CHUNK)
        end = gap.start() if gap else len(text)
        found.update(TERM.findall(text, start, end))
        start = end
    return found


def _bytes(text: pa.StringScalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


class Queries:
    """Queries as arrays: each one's (term, times), and the number of each term."""

    def __init__(self, texts: list[bytes]):
        self.number: dict[bytes, int] = {}
        self.of: list[tuple[np.ndarray, np.ndarray]] = []
        for text in texts:
            counts = terms(text)
            numbers = [self.number.setdefault(term, len(self.number)) for term in counts]
            self.of.append((np.array(numbers, np.int64), np.array(list(counts.values()), np.int64)))


def _index(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """One row per block: ids, lengths, terms, postings (as bytes), the block's counts."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("n_docs", T.LongType()), T.StructField("n_terms", T.LongType()),
                           T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("df", T.ArrayType(T.IntegerType())),
                           *(T.StructField(c, T.BinaryType()) for c in ("lengths", "docs", "tfs"))])
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, ids, lengths, postings, size, kind = shared.value, [], [], ([], [], []), 0, None

        def block() -> pa.RecordBatch:
            n = np.array(lengths, np.int64)
            term, doc, tf = (np.array(x, np.int32) for x in postings)
            order = np.argsort(term, kind="stable")
            present, df = np.unique(term, return_counts=True)
            own = [pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in ((n, "<i8"), (doc[order], "<i4"), (tf[order], "<i4"))]
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(kind)), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]),
                                               pa.array([present], pa.list_(pa.int32())), pa.array([df.astype(np.int32)], pa.list_(pa.int32())), *own], names=schema.fieldNames())

        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                data = _bytes(text)
                found = terms(data)
                for term in found.keys() & wanted.keys():
                    for to, x in zip(postings, (wanted[term], len(ids), found[term]), strict=True):
                        to.append(x)
                ids.append(doc_id.as_py())
                lengths.append(found.total())
                size += len(data)
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield block()
                    ids, lengths, postings, size = [], [], ([], [], []), 0
        if ids:
            yield block()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(cut, schema)


class Block:
    """Postings of a block with their impacts, to be searched."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        lengths, self.docs, tfs = (np.frombuffer(row[c], k).astype(np.int64) for c, k in (("lengths", "<i8"), ("docs", "<i4"), ("tfs", "<i4")))
        m = 25 + 75 * lengths * n_docs // max(n_terms, 1)
        self.impacts = 1_000_000_000 * tfs // (1000 * tfs + 8 * m[self.docs])
        self.size = len(lengths)
        df = np.array(row["df"], np.int64)
        ends = np.cumsum(df)
        self.lists = {t: (e - n, e) for t, n, e in zip(row["terms"], df.tolist(), ends.tolist(), strict=True)}
        self.largest = dict(zip(row["terms"], np.maximum.reduceat(self.impacts, ends - df).tolist(), strict=True)) if len(df) else {}

    def search(self, query: list[tuple[int, int]], least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents, with scores, that may be among the ``top`` best: all of them are, if
        a score must be ``least`` or more.  ``query`` has (term, factor of its impacts)."""
        short, walked = [], []
        for term, factor in query:
            if term in self.lists and factor > 0:
                start, end = self.lists[term]
                if SHORT * (end - start) <= self.size:
                    short.append((self.docs[start:end], factor * self.impacts[start:end]))
                else:
                    walked.append((factor * self.largest[term], self.docs[start:end], self.impacts[start:end], factor))
        if short:
            docs, sums = _add(short)
            walked.append((int(sums.max()), docs, sums, 1))
        walked.sort(key=lambda x: x[0])
        reach = np.cumsum([0, *(x[0] for x in walked)]).tolist()  # what the iterators before each one can add up to
        best, found = np.zeros(0, np.int64), []
        start, window = 0, WINDOW
        while start < self.size and reach[-1] >= least:
            end, window = start + window, 2 * window
            first = next(k for k, x in enumerate(reach[1:]) if x >= least)  # iterators below it bring no candidates
            parts = [(docs[(cut := slice(*np.searchsorted(docs, (start, end))))], factor * values[cut]) for _, docs, values, factor in walked[first:]]
            docs, sums = _add(parts)
            for k in range(first - 1, -1, -1):
                can = sums + reach[k + 1] >= least
                docs, sums = docs[can], sums[can]
                if not len(docs):
                    break
                _, own, values, factor = walked[k]
                at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
                sums = sums + np.where(own[at] == docs, factor * values[at], 0)
            keep = sums >= least
            docs, sums = docs[keep], sums[keep]
            if len(docs):
                found.append((docs, sums))
                best = np.concatenate([best, sums])
                if len(best) >= top:
                    best = np.partition(best, len(best) - top)[-top:]
                    least = max(least, int(best[0]))
            start = end
        docs, sums = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return docs[sums >= least], sums[sums >= least]


def _add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Documents of all parts, ascending, with their summed values."""
    docs, values = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
    order = np.argsort(docs, kind="stable")
    docs, values = docs[order], values[order]
    heads = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])[:len(docs)])
    return docs[heads], np.add.reduceat(values, heads) if len(heads) else values


def _best(found: pa.Table, top: int) -> pa.Table:
    """The first rows by score, then id."""
    return found.take(pc.sort_indices(found, sort_keys=[("score", "descending"), ("id", "ascending")], null_placement="at_end")[:top])


def _ranked(index: DataFrame, queries: Queries, weights: list[int], n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(q, rank, id, score) of the best documents of each query."""
    kind = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("id", kind), T.StructField("score", T.LongType())])
    shared = index.sparkSession.sparkContext.broadcast([[(t, weights[t] * k) for t, k in zip(*(x.tolist() for x in q), strict=True)] for q in queries.of])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, pa.Table] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids = row.column(0).flatten()
                block = Block({c: row.column(c)[0].as_py() for c in ("terms", "df", "lengths", "docs", "tfs")}, n_docs, n_terms)
                for q, query in enumerate(shared.value):
                    old = best.get(q)
                    docs, scores = block.search(query, old["score"][top - 1].as_py() if old is not None and len(old) == top else 1, top)
                    if len(docs):
                        new = pa.table({"id": ids.take(pa.array(docs)), "score": pa.array(scores)})
                        best[q] = _best(pa.concat_tables([old, new]) if old is not None else new, top)
        for q, rows in best.items():
            for part in pa.table({"q": pa.array([q] * len(rows), pa.int32()), "id": rows["id"], "score": rows["score"]}).combine_chunks().to_batches():
                yield part

    found = index.select("ids", "terms", "df", "lengths", "docs", "tfs").mapInArrow(find, schema)
    order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query id, rank, document id, score) of the ``top`` best documents of each query row."""
    asked = materialize(queries.select(F.monotonically_increasing_id().alias("row"), F.col(query_id).alias("query"), F.coalesce(F.col(query_text), F.lit("")).alias("text")), "queries")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts, out = -(-size // PART_BYTES) or 1, None
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part).orderBy("row").collect()
        wanted = Queries([r.text.encode("utf-8", "surrogatepass") for r in own])
        index = materialize(_index(docs, wanted.number, id_col, text_col), "postings")
        n_docs, n_terms = (int(x or 0) for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
        df = dict(index.select(F.explode(F.arrays_zip("terms", "df")).alias("z")).groupBy("z.terms").agg(F.sum("z.df")).collect())
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(wanted.number))]
        names = docs.sparkSession.createDataFrame([(q, r.query) for q, r in enumerate(own)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("query", asked.schema["query"].dataType)]))
        found = _ranked(index, wanted, weights, n_docs, n_terms, top).join(F.broadcast(names), "q")
        found = found.select(F.col("query").alias(query_id), "rank", F.col("id").alias(id_col), "score")
        out = found if out is None else out.union(found)
    return out
