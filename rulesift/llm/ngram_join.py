"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link if 100 * |A and B| >= 80 * |A or B| for their sets of distinct
five-word shingles.  Every link between different texts is found; the result is
the set size and the connected component of each document.

1. *Classes.*  Equal sets are one class, named by 128 bits of a digest of the set.
   The same pass counts shingles in a sketch of fixed size (``COUNTERS``), summed
   over all documents by slices.
2. *Prefixes.*  A set is ordered by (sketch count, hash): rare shingles first, the
   same order everywhere, so the join is exact whatever the counts are.  Sets that
   link share at least l shingles within their first n - ceil(0.8 n) + l, for each
   l.  Every set takes the l from 1 to ``MOST_MATCHES`` of least estimated cost:
   entries to read on its prefix, and candidates (entries / l) to verify.
3. *Entries* (shingle, class) are shuffled by shingle; shingles of one class end here.  A shingle that
   the sketch counts often has its entries dealt over parts, which are put together per shingle.
4. *Early links.*  Each class is verified against the one class that leads most of
   its shingles.  A shingle's leader is its most central class: the one whose prefix
   is shared most.  A group of thousands of near copies gives one pair per member,
   never all its pairs.
5. *Candidates across parts.*  A part is a leader with the classes that link to it.
   At place p a set of n shingles can share at most n - p + l - 1 if this is one of
   its first l matches, so each entry has a largest partner size (``cap``).  Per shingle, parts whose sizes and caps exclude each other
   are told apart before any classes are paired; then classes of different parts that
   share at least l prefix shingles within their caps, with l the smaller of both
   choices, are verified.  Pairs inside a part would change no component.
6. Verification intersects whole sets; a class in many pairs has its set sent to several
   tasks, each with a share of the pairs.  Links give components by star steps.

Defined cases: words are split at blanks after lower-casing A-Z; a text of fewer
words is one shingle of all of them; a text without words, or null, has no set and
links with nothing; a row without an id links nothing and has no component; repeated
rows are returned each; a text of megabytes is one set, of eight bytes a shingle; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from rulesift.llm.graph import components
from rulesift.llm.shingles import Hasher
from rulesift.llm.workers import frugal, values
from rulesift.session import materialize, materialize_bucketed

PERCENT = 80
MOST_MATCHES = 3
#: Sketch counters, in slices; fixed, so that the summed sketch can be broadcast.
COUNTERS, SLICE = 1 << 22, 1 << 16
#: Cost of verifying a shingle of a candidate, in entries read.
VERIFY = 0.05
#: Entries of one shingle, and pairs of one class, beyond which they are dealt over several tasks.
HOT, SPLIT = 4096, 128
#: Classes to verify are broadcast up to this count, else joined by a shuffle.
BROADCAST_CLASSES = 500_000


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - (COUNTERS.bit_length() - 1))).astype(np.int64)


def _name(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set's digest, as two longs."""
    import xxhash

    digest = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, n, a, b) of each document, and rows (slice, counts) of the task's sketch."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("a", T.LongType()),
                           T.StructField("b", T.LongType()), T.StructField("slice", T.IntegerType()), T.StructField("counts", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        hasher, sketch, kind = Hasher(), np.zeros(COUNTERS, np.uint32), None
        for batch in batches:
            kind = batch.column(0).type
            sizes, names = [], []
            for found in hasher.sets(values(batch.column(1))):
                np.add.at(sketch, _slot(found), np.uint32(1))
                sizes.append(len(found))
                names.append(_name(found) if len(found) else (None, None))
            k = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array([x for x, _ in names], pa.int64()), pa.array([x for _, x in names], pa.int64()),
                                              pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=schema.fieldNames())
        if kind is not None:
            parts = [(k, zstandard.compress(x.astype("<u4").tobytes(), 1)) for k in range(COUNTERS // SLICE) if (x := sketch[k * SLICE:(k + 1) * SLICE]).any()]
            none = [pa.nulls(len(parts), pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([pa.nulls(len(parts), kind), *none, pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=schema.fieldNames())

    return docs.select(id_col, text_col).mapInArrow(frugal(read), schema)


def _sketch(read: DataFrame) -> np.ndarray:
    """The summed counters; bounded by ``COUNTERS``."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        total = np.zeros(SLICE, np.uint64)
        for batch in batches:
            for x in batch.column(1):
                total += np.frombuffer(zstandard.decompress(x.as_py()), "<u4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())], names=["slice", "counts"])

    out = np.zeros(COUNTERS, np.uint32)
    for row in read.where("slice IS NOT NULL").select("slice", "counts").groupBy("slice").applyInArrow(add, "slice int, counts binary").toLocalIterator():
        out[row["slice"] * SLICE:(row["slice"] + 1) * SLICE] = np.frombuffer(bytes(row["counts"]), "<u4")
    return out


def least_overlap(n):
    """ceil(0.8 n): what a set of n shingles shares with any set it links with."""
    return -(-PERCENT * n // 100)


def prefix(shingles: np.ndarray, counts: np.ndarray, noise: float) -> tuple[np.ndarray, int, int, np.ndarray]:
    """The set's prefix, rare shingles first, the matches it asks for, how much the prefix is shared on
    average, and the sketch's count of each of its shingles."""
    n = len(shingles)
    found = counts[_slot(shingles)]
    order = np.lexsort((shingles, found))
    lists = np.cumsum(np.maximum(found[order] - noise, 1.0))
    spare, most = n - least_overlap(n), min(MOST_MATCHES, least_overlap(n))
    cost = [lists[spare + l - 1] * (1 + VERIFY * n / l) for l in range(1, most + 1)]
    matches = 1 + int(np.argmin(cost))
    first = order[:spare + matches]
    return shingles[first], matches, int(lists[spare + matches - 1] / (spare + matches)), found[first]


def _entries(docs: DataFrame, text_col: str, sketch: np.ndarray) -> DataFrame:
    """(shingle, a, weight, packed n, place and matches, part) of every class's prefix; a task gives each class it
    meets once.  The entries of a shingle that the sketch counts more than ``HOT`` times are dealt over parts."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts, met = Hasher(), shared.value, set()
        noise = float(counts.mean(dtype=np.float64))
        for batch in batches:
            shingles, classes, weights, packed, parts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for found in hasher.sets(values(batch.column(0))):
                if len(found) and (name := _name(found)) not in met:
                    met.add(name)
                    first, matches, weight, held = prefix(found, counts, noise)
                    parts.append(np.where(held > HOT, name[0] % (held.astype(np.int64) // HOT + 1), -1).astype(np.int32))
                    shingles.append(first)
                    weights.append(np.full(len(first), min(weight, 2**31 - 1), np.int32))
                    classes.append(np.full(len(first), name[0]))
                    packed.append((np.int64(len(found)) << 33) | (np.arange(len(first)) << 3) | matches)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingles).view(np.int64)), pa.array(np.concatenate(classes)), pa.array(np.concatenate(weights)), pa.array(np.concatenate(packed)), pa.array(np.concatenate(parts))], names=["shingle", "a", "weight", "packed", "part"])

    return docs.select(text_col).mapInArrow(frugal(emit), "shingle long, a long, weight int, packed long, part int")


def _unpacked(packed: str) -> dict:
    """Set size, place, matches and cap (the largest partner's size) of a packed entry."""
    n, place, matches = F.shiftrightunsigned(packed, 33), F.shiftright(packed, 3).bitwiseAND((1 << 30) - 1), F.col(packed).bitwiseAND(7)
    most_shared = (100 + PERCENT) * (n - place + matches - 1)
    return {"n": n, "place": place, "matches": matches, "cap": F.floor((most_shared - PERCENT * n) / PERCENT).cast("long")}


def _verified(docs: DataFrame, id_col: str, text_col: str, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (u, v) of classes that link; the sets of these classes are read again from their first documents."""
    pairs = materialize(pairs, "pairs")
    both = pairs.select(F.col("u").alias("a")).union(pairs.select("v"))
    sets = _sets(docs, id_col, text_col, materialize(classes.join(both.distinct(), "a").groupBy("a").agg(F.min("first").alias("id")), "wanted"))
    many = both.groupBy("a").count().where(F.col("count") > SPLIT).select("a", F.ceil(F.col("count") / SPLIT).cast("int").alias("parts"))
    many = _to_tasks(materialize(many, "many"))

    def beside(rows: DataFrame, key: str, name: str) -> DataFrame:
        """``rows`` with the set of the class in ``key``; the sets lie in buckets and do not move."""
        return rows.join(sets.select(F.col("a").alias(key), F.col("shingles").alias(name)), key)

    def dealt(rows: DataFrame, key: str, name: str) -> DataFrame:
        """``beside`` for classes in many pairs: the set goes to several tasks, each with a share of the pairs."""
        own = sets.join(many, "a").select(F.col("a").alias(key), F.col("shingles").alias(name), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        return rows.withColumn("part", F.pmod(F.xxhash64("u", "v"), F.col(f"{key}_parts")).cast("int")).join(own, [key, "part"]).drop("part")

    # p and q are u and v, q the one in many pairs if only one is
    parts = [many.select(F.col("a").alias(c), F.col("parts").alias(f"{c}_parts")) for c in ("u", "v")]
    sides = pairs.join(parts[0], "u", "left").join(parts[1], "v", "left")
    swap = F.col("u_parts").isNotNull() & F.col("v_parts").isNull()
    sides = sides.select("u", "v", *(F.when(swap, F.col(y)).otherwise(F.col(x)).alias(to) for to, x, y in (("p", "u", "v"), ("q", "v", "u"), ("p_parts", "u_parts", "v_parts"), ("q_parts", "v_parts", "u_parts"))))
    if many.isEmpty():
        whole = beside(beside(pairs.withColumns({"p": F.col("u"), "q": F.col("v")}), "p", "x"), "q", "y").select("u", "v", "x", "y")
    else:
        sides = materialize(sides, "sides")
        few = beside(beside(sides.where("q_parts IS NULL"), "p", "x"), "q", "y")
        one = dealt(beside(sides.where("p_parts IS NULL AND q_parts IS NOT NULL"), "p", "x"), "q", "y")
        two = dealt(dealt(sides.where("p_parts IS NOT NULL"), "p", "x"), "q", "y")
        whole = few.select("u", "v", "x", "y").union(one.select("u", "v", "x", "y")).union(two.select("u", "v", "x", "y"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return whole.mapInArrow(frugal(verify), "u long, v long")


def _to_tasks(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has at most ``BROADCAST_CLASSES`` rows."""
    return F.broadcast(table) if table.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES else table


def _sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(a, shingles) of the wanted classes; ``wanted`` has one document id per class."""
    wanted = _to_tasks(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, met = Hasher(), set()  # one id may have rows of other texts, or repeated rows
        for batch in batches:
            found = [(a, x) for a, x in zip(batch.column(0).to_pylist(), hasher.sets(values(batch.column(1))), strict=True) if a not in met and len(x) and _name(x)[0] == a]
            met.update(a for a, _ in found)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([x.tobytes() for _, x in found], pa.binary())], names=["a", "shingles"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id").select("a", "text")
    return materialize_bucketed(own.mapInArrow(frugal(read), "a long, shingles binary"), "sets", "a")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    read = materialize(_read(docs, id_col, text_col), "shingle_names")
    names = read.where("slice IS NULL").select("id", "n", "a", "b")
    classes = names.where("n > 0 AND id IS NOT NULL").groupBy("a", "b").agg(F.min("id").alias("first"))

    entries = _entries(docs.where(F.col(id_col).isNotNull()), text_col, _sketch(read))
    in_part, best = W.partitionBy("shingle", "part"), F.struct("weight", "a", "packed")
    entries = entries.select("*", F.max(best).over(in_part).alias("leader"), F.min("a").over(in_part).alias("least"), F.max("a").over(in_part).alias("most"))
    entries = materialize(entries.where("part >= 0 OR least < most"), "entries_by_part")
    hot = entries.where("part >= 0").drop("leader", "least", "most")  # their parts are put together
    heads = entries.where("part >= 0").groupBy("shingle").agg(F.max("leader").alias("leader"), F.min("least").alias("least"), F.max("most").alias("most"))
    entries = entries.where("part < 0").unionByName(hot.join(_to_tasks(materialize(heads, "hot_shingles")), "shingle"))
    of, top = _unpacked("packed"), _unpacked("leader.packed")
    entries = entries.where("least < most").select("shingle", "a", *(c.alias(name) for name, c in of.items()), F.col("leader.a").alias("leader"), top["n"].alias("leader_n"), top["cap"].alias("leader_cap"))
    entries = materialize(entries.distinct(), "entries")  # copies met by several tasks are one entry now
    allowed = lambda n, cap, m, most: F.expr(f"{n} <= {most} AND {m} <= {cap} AND 100 * least({n}, {m}) >= {PERCENT} * greatest({n}, {m})")

    led = entries.where("a <> leader").where(allowed("n", "cap", "leader_n", "leader_cap")).groupBy("a", "leader").count()
    best = led.groupBy("a").agg(F.max(F.struct("count", "leader")).alias("best")).select(F.col("a").alias("u"), F.col("best.leader").alias("v"))
    early = materialize(_verified(docs, id_col, text_col, best, classes), "early_links")
    # a part is a leader with what links to it, or to what links to it: always within one component
    above = early.select(F.col("u").alias("v"), F.col("v").alias("top"))
    roots = early.join(above, "v", "left").select(F.col("u").alias("node"), F.coalesce("top", "v").alias("root"))

    parts = entries.select("shingle", "a", *of).join(roots.withColumnRenamed("node", "a"), "a", "left").withColumn("part", F.coalesce("root", "a")).drop("root")
    several = parts.groupBy("shingle").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("shingle")
    parts = materialize(parts.join(several, "shingle", "left_semi"), "parts")
    owners = parts.groupBy("shingle", "part").agg(F.min("n").alias("n"), F.max("cap").alias("cap"))
    across = owners.alias("o").join(owners.toDF("shingle", "other", "m", "most"), "shingle").where("part < other AND m <= cap AND n <= most").select("shingle", "part", "other")
    x = parts.select("shingle", "part", F.col("a").alias("u"), F.col("n").alias("un"), F.col("cap").alias("ucap"), F.col("place").alias("up"), F.col("matches").alias("um"))
    y = parts.select("shingle", F.col("part").alias("other"), F.col("a").alias("v"), F.col("n").alias("vn"), F.col("cap").alias("vcap"), F.col("place").alias("vp"), F.col("matches").alias("vm"))
    shared = across.join(x, ["shingle", "part"]).join(y, ["shingle", "other"]).where(allowed("un", "ucap", "vn", "vcap"))
    matches = F.least("um", "vm")
    for n, place in (("un", "up"), ("vn", "vp")):  # the prefix, and what can be shared from here on, with the pair's own l
        shared = shared.where(F.expr(f"{place} < {n} - ({PERCENT} * {n} + 99) DIV 100 + least(um, vm)")
                              & F.expr(f"{100 + PERCENT} * ({n} - {place} + least(um, vm) - 1) >= {PERCENT} * (un + vn)"))
    pairs = shared.groupBy("u", "v").agg(F.count("*").alias("k"), F.first(matches).alias("need")).where("k >= need").select("u", "v")
    links = early.union(_verified(docs, id_col, text_col, pairs, classes))

    roots = components(links).withColumnRenamed("node", "a")
    named = roots.join(classes.select("a", "first"), "a")
    least = named.groupBy("root").agg(F.min("first").alias("linked"))
    linked = named.join(least, "root").groupBy("a").agg(F.min("linked").alias("linked"))
    own = classes.join(linked, "a", "left").select("a", "b", F.coalesce("linked", "first").alias("component_id"))
    return names.join(own, ["a", "b"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
