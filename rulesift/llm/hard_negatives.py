"""Hard-negative mining with shared lists per anchor cluster (MAXIMUS-style), exact.

Vectors become integers, floor(scale * x) per component; a score is their inner product.
An anchor's positives are its best rows of the same label; for each positive, its hard
negatives are the best rows of other labels whose score lies between ``low`` and ``high``
percent of the positive's.

1. *Clusters.*  Spherical k-means with ``CLUSTERS`` centres, fitted on a sample of at most
   ``FIT_ANCHORS`` anchors (by hash; a documented bound, results do not depend on it).
   A pass over all anchors gives each cluster's angle: the widest between its centre
   and a member.
2. *Lists.*  For a member u and a row x of a cluster with centre c and angle b,
   u.x <= |u| |x| cos(max(0, angle(x, c) - b)).  Rows are stored once, in blocks; each block
   holds, for every cluster, its rows sorted by that bound, written once and read by all
   walks.  A cluster's list is the union of its slices, so no list is in one task's hands
   and a cluster with a third of the anchors is walked by all tasks.
3. *Walks.*  A member goes down each slice until the bound of what is left is below the last of
   its best so far (certified: nothing further down can enter); thresholds go from block to block.
   A walk over one block in ``SEED`` comes first; its thresholds start the walk over the others, so
   tasks return few rows that another task's better ones replace.
4. The best of all tasks are ranked by a window, which cuts them before its shuffle too.

Anchors go in parts of ``PART_ANCHORS``, each with passes of its own: what is collected
and broadcast is one part's vectors and positives, so bounded.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take
no part; shorter vectors count as padded with zeros; zero and empty vectors score 0; equal
scores go by smaller id; repeated rows are rows of their own, as anchors, positives
and negatives (a copy of the anchor is another row); a positive with a negative score has no
negatives, one with score 0 those of score 0; fewer rows than asked for are all returned;
scores beyond 64 bits raise; empty tables, and tables without an anchor, give no rows; other
columns are not read.  Ids and labels are integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rulesift.session import materialize

CLUSTERS, FIT_ANCHORS, FIT_ROUNDS = 32, 10_000, 12
BLOCK_ROWS = 4096
PART_ANCHORS = 1 << 14
#: Members and list entries scored at once.
MEMBERS, STEP = 1024, 512
SEED = 16
#: Angles and bounds are widened by this much, for rounding.
SLACK = 1e-6
KEPT = 1 << 20
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _matrix(vectors: list, dim: int) -> np.ndarray:
    """Integer vectors as rows of doubles, padded to ``dim``."""
    out = np.zeros((len(vectors), dim))
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v
    return out


def _angles(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norm of each row, and its angle to each centre (a zero row: 0)."""
    norms = np.linalg.norm(x, axis=1)
    cos = (x / np.where(norms, norms, 1)[:, None]) @ centres.T
    return norms, np.where(norms[:, None] > 0, np.arccos(np.clip(cos, -1, 1)), 0)


def fit(sample: np.ndarray, clusters: int) -> np.ndarray:
    """Unit centres of the sample by k-means on angles."""
    norms = np.linalg.norm(sample, axis=1)
    x = sample[norms > 0] / norms[norms > 0][:, None]
    if not len(x):
        return np.zeros((1, sample.shape[1]))
    rng = np.random.default_rng(0)
    centres = x[rng.choice(len(x), min(clusters, len(x)), replace=False)]
    for _ in range(FIT_ROUNDS):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 0, sums / np.where(size, size, 1)[:, None], centres)
    return centres


@dataclass
class Anchors:
    """A part of the anchors, as arrays."""
    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    clusters: np.ndarray

    @classmethod
    def of(cls, rows: list, centres: np.ndarray, spread: np.ndarray) -> Anchors:
        """Each anchor goes to the nearest centre whose cluster's angle holds it (rounding could
        part it from the cluster that it was counted in)."""
        vectors = _matrix([r.v for r in rows], centres.shape[1])
        norms, angles = _angles(vectors, centres)
        column = lambda c: np.array([r[c] for r in rows], np.int64)
        return cls(column("row"), column("id"), column("label"), vectors, norms, np.argmin(np.where(angles <= spread + SLACK / 2, angles, np.inf), axis=1))


class Walker:
    """The best ``k`` rows of each (anchor, window) so far.  A window is a range of scores, ``low``
    to ``high`` (both of shape anchors x windows; none if low is larger); ``same`` asks for rows of the
    anchor's label, else for others.  ``scored`` counts the inner products."""

    def __init__(self, anchors: Anchors, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.anchors, self.high, self.same, self.k, self.scored = anchors, high, same, k, 0
        self.least = np.where(low <= high, low, MOST)
        self.best = np.full((*low.shape, k), LEAST)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.members = [np.flatnonzero(anchors.clusters == c) for c in range(anchors.clusters.max(initial=-1) + 1)]

    def walk(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray, orders: np.ndarray, bounds: np.ndarray) -> None:
        """Walks one block's slice of every cluster's list."""
        widest = float(np.linalg.norm(vectors, axis=1).max(initial=0))
        limit = widest * float(self.anchors.norms.max(initial=0))
        if limit >= 2.0**63:
            raise ValueError("scores of these vectors do not fit 64 bits")
        kind = np.float64 if limit < 2.0**53 else np.int64  # doubles are exact up to there
        for c, members in enumerate(self.members):
            for k in range(0, len(members), MEMBERS):
                group = members[k:k + MEMBERS]
                for start in range(0, len(ids), STEP):
                    reach = self.anchors.norms[group] * (float(bounds[c][start]) + SLACK * widest)
                    group = group[reach + SLACK >= self.least[group].min(axis=1)]
                    if not len(group):
                        break
                    self._score(group, orders[c][start:start + STEP], ids, rows, labels, vectors, kind)

    def _score(self, group, at, ids, rows, labels, vectors, kind) -> None:
        a = self.anchors
        scores = (a.vectors[group].astype(kind) @ vectors[at].astype(kind).T).astype(np.int64)
        self.scored += scores.size
        allowed = a.labels[group][:, None] == labels[at]
        allowed = allowed & (a.rows[group][:, None] != rows[at]) if self.same else ~allowed
        for w in range(self.high.shape[1]):
            good = allowed & (scores >= self.least[group, w][:, None]) & (scores <= self.high[group, w][:, None])
            some = np.flatnonzero(good.any(axis=1))
            if not len(some):
                continue
            own = group[some]
            merged = np.concatenate([self.best[own, w], np.where(good[some], scores[some], LEAST)], axis=1)
            self.best[own, w] = best = np.partition(merged, merged.shape[1] - self.k, axis=1)[:, -self.k:]
            self.least[own, w] = np.maximum(self.least[own, w], best.min(axis=1))
            r, x = np.nonzero(good)
            keep = scores[r, x] >= self.least[group[r], w]
            r, x = r[keep], x[keep]
            self.found.append((group[r], np.full(len(r), w), ids[at[x]], scores[r, x]))
        if sum(len(x[0]) for x in self.found) > KEPT:
            self.found = [self.ranked()]

    def ranked(self) -> tuple[np.ndarray, ...]:
        """(anchor, window, id, score) of the best so far."""
        a, w, i, s = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in self.found)]) for k in range(4))
        keep = s >= self.least[a, w]
        a, w, i, s = a[keep], w[keep], i[keep], s[keep]
        order = np.lexsort((i, -s, w, a))
        a, w, i, s = a[order], w[order], i[order], s[order]
        heads = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (w[1:] != w[:-1]))[:len(a)])
        place = np.arange(len(a)) - np.repeat(heads, np.diff(np.append(heads, len(a))))
        return tuple(x[place < self.k] for x in (a, w, i, s))


def _prepared(rows: DataFrame, anchor: Column, id_col: str, label_col: str, vector_col: str, scale: float) -> DataFrame:
    """(row, id, label, v, anchor) of the rows that take part."""
    odd = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~odd)
    return whole.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                        F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))


def _spread(anchors: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Each cluster's angle: the widest between its centre and one of all anchors."""

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(centres))
        for batch in batches:
            _, angles = _angles(_matrix(batch.column(0).to_pylist(), centres.shape[1]), centres)
            np.maximum.at(out, np.argmin(angles, axis=1), angles.min(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres), dtype=np.int32)), pa.array(out)], names=["cluster", "angle"])

    out = np.zeros(len(centres))
    for r in anchors.select("v").mapInArrow(widest, "cluster int, angle double").groupBy("cluster").agg(F.max("angle").alias("angle")).collect():
        out[r.cluster] = r.angle
    return out


def _lists(table: DataFrame, centres: np.ndarray, spread: np.ndarray) -> DataFrame:
    """Blocks of rows, each with its slice of every cluster's list (sorted rows and bounds)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(first, BLOCK_ROWS)
                row, ids, labels = (batch.column(k).to_numpy() for k in range(3))
                x = _matrix(batch.column(3).to_pylist(), centres.shape[1])
                norms, angles = _angles(x, centres)
                bounds = (norms[:, None] * np.cos(np.maximum(0, angles - spread - SLACK))).T
                orders = np.argsort(-bounds, axis=1, kind="stable")
                bounds = np.nextafter(np.take_along_axis(bounds, orders, axis=1).astype("<f4"), np.float32(np.inf))
                packed = [x.tobytes() for x in (row.astype("<i8"), ids.astype("<i8"), labels.astype("<i8"), x.astype("<f8"), orders.astype("<u2"), bounds)]
                yield pa.RecordBatch.from_arrays([pa.array([int(row[0])]), *(pa.array([x], pa.binary()) for x in packed)], names=["block", "row", "id", "label", "v", "orders", "bounds"])

    return table.select("row", "id", "label", "v").mapInArrow(cut, "block long, row binary, id binary, label binary, v binary, orders binary, bounds binary")


def _walked(lists: DataFrame, anchors: Anchors, low: np.ndarray, high: np.ndarray, same: bool, k: int, clusters: int) -> DataFrame:
    """(a, w, rank, id, score): the best ``k`` rows of each anchor and window, over all blocks."""
    spark = lists.sparkSession
    of_window = W.partitionBy("a", "w").orderBy(F.desc("score"), "id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(of_window)).where(F.col("rank") <= k)

    def over(blocks: DataFrame, low: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((tuple(vars(anchors).values()), low, high))  # arrays: no class of this package on executors

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, least, most = shared.value
            walker = Walker(Anchors(*own), least, most, same, k)
            for batch in batches:
                for j in range(batch.num_rows):
                    row, ids, labels, v, orders, bounds = (np.frombuffer(batch.column(c)[j].as_buffer(), kind) for c, kind in enumerate(("<i8", "<i8", "<i8", "<f8", "<u2", "<f4"), 1))
                    walker.walk(ids, row, labels, v.reshape(len(ids), -1), orders.reshape(clusters, -1), bounds.reshape(clusters, -1))
            a, w, i, s = walker.ranked()
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(w.astype(np.int32)), pa.array(i), pa.array(s)], names=["a", "w", "id", "score"])

        return blocks.mapInArrow(walk, "a int, w int, id long, score long")

    seed = F.pmod(F.xxhash64("block"), F.lit(SEED)) == 0
    first = materialize(best(over(lists.where(seed), low)), "seed_walk")
    least = low.copy()
    for r in first.where(F.col("rank") == k).select("a", "w", "score").collect():
        least[r.a, r.w] = max(least[r.a, r.w], r.score)
    return best(first.drop("rank").union(over(lists.where(~seed), least)))


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256,
         id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows
    where ``anchor`` holds; ``low`` and ``high`` are percentages of the positive's score."""
    spark = rows.sparkSession
    table = materialize(_prepared(rows, anchor, id_col, label_col, vector_col, scale), "vectors")
    dim = table.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    anchors = table.where("anchor")
    sample = anchors.select("v").orderBy(F.xxhash64("row")).limit(FIT_ANCHORS).collect()
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not sample:
        return out
    centres = fit(_matrix([r.v for r in sample], dim), CLUSTERS)
    spread = _spread(anchors, centres)
    lists = materialize(_lists(table, centres, spread), "lists")
    parts = -(-anchors.count() // PART_ANCHORS)
    for part in range(parts):
        own = Anchors.of(anchors.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part).collect(), centres, spread)
        whole = np.full((len(own.ids), 1), LEAST), np.full((len(own.ids), 1), MOST)
        found = _walked(lists, own, *whole, True, positives, len(centres)).collect()
        least, most = np.full((len(own.ids), positives), MOST), np.full((len(own.ids), positives), LEAST)
        for r in found:
            least[r.a, r["rank"] - 1], most[r.a, r["rank"] - 1] = -(-low * r.score // 100), high * r.score // 100
        names = spark.createDataFrame([(r.a, r["rank"] - 1, int(own.ids[r.a]), r.id, r.score) for r in found], "a int, w int, anchor_id long, positive_id long, positive_score long")
        hard = _walked(lists, own, least, most, False, negatives, len(centres)).join(F.broadcast(names), ["a", "w"])
        out = out.union(hard.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return out
