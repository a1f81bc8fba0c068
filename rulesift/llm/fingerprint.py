"""Document fingerprints from closed syncmers, in DataFrame functions only.

Over the words of a text (lower case, split at blanks): a window of ``K`` words is an
anchor if the least hash of its inner runs of ``S`` words lies at its first or last
place.  Whether it is one depends on its own words only, so an anchor survives any
edit elsewhere.  A fingerprint is the text's distinct anchors (32-bit hashes, hex)
in order.

Likeness of two fingerprints matches anchors by hash and place: of the anchors both
have, taken in each one's order, those that follow the same neighbour count.  It is
twice that number over the anchors of both, from 0 to 1.

Defined cases: texts of fewer than ``K`` words, or without an anchor, have one anchor
of all their words; texts without words, or null, have the empty fingerprint, which is
like another empty one (1) and unlike all others (0); rows of one id are ordered by
text; rows without an id come last; a single row is its own next document; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

K, S = 12, 3


def with_anchors(df: DataFrame, text_col: str, to: str) -> DataFrame:
    """``df`` with the anchors of a text column as array<string> column ``to``; takes the names ``to`` + w, m."""
    w, m = f"{to} w", f"{to} m"
    df = df.withColumn(w, F.transform(F.array_remove(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[\x20\x09-\x0D]+"), ""), lambda x: F.xxhash64(x)))
    reads = ", ".join(f"get(`{w}`, i + {k})" for k in range(S))
    df = df.withColumn(m, F.expr(f"if(size(`{w}`) >= {K}, transform(sequence(0, size(`{w}`) - {S}), i -> xxhash64({reads})), array())"))
    name = "lower(substr(hex({}), 1, 8))"
    edge = f"least(get(`{m}`, i), get(`{m}`, i + {K - S})) = array_min(slice(`{m}`, i + 1, {K - S + 1}))"
    found = f"transform(filter(sequence(0, size(`{w}`) - {K}), i -> {edge}), i -> xxhash64(slice(`{w}`, i + 1, {K})))"
    df = df.withColumn(to, F.expr(f"if(size(`{w}`) >= {K}, {found}, cast(array() AS array<bigint>))"))
    whole = f"if(size(`{w}`) = 0, cast(array() AS array<bigint>), array(xxhash64(`{w}`)))"
    hashes = f"if(size(`{to}`) = 0, {whole}, `{to}`)"
    return df.withColumn(to, F.expr(f"array_distinct(transform({hashes}, x -> lpad({name.format('x')}, 8, '0')))")).drop(w, m)


def with_likeness(df: DataFrame, one: str, other: str, to: str) -> DataFrame:
    """``df`` with the likeness of two anchor columns; takes the names ``to`` + 1, 2."""
    a, b = f"{to} 1", f"{to} 2"
    df = df.withColumns({a: F.array_intersect(one, other), b: F.array_intersect(other, one)})
    follow = "zip_with(slice(`{0}`, 1, size(`{0}`) - 1), slice(`{0}`, 2, size(`{0}`) - 1), (x, y) -> concat(x, y))"
    matched = f"1 + size(array_intersect({follow.format(a)}, {follow.format(b)}))"
    likeness = f"""case when size(`{one}`) + size(`{other}`) = 0 then 1.0D when size(`{a}`) = 0 then 0.0D
        else 2.0D * ({matched}) / (size(`{one}`) + size(`{other}`)) end"""
    return df.withColumn(to, F.expr(likeness)).drop(a, b)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row."""
    rows = with_anchors(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "anchors")
    return rows.select(F.col("id").alias(id_col), F.array_join("anchors", "").alias("fingerprint"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, anchors, next, next_anchors): each row beside the next in descending id, after the last the first.

    Ranges of ids (as many as shuffle partitions, from quantiles of the id column) are sorted apart; the last row of
    a range meets the first one of the next range that has rows, from a table of one row per range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = sorted(set(rows.approxQuantile("id", [k / n for k in range(1, n)], 0.25 / n)))
    above = F.size(F.filter(F.array(*map(F.lit, edges)), lambda edge: edge > F.col("id"))) if edges else F.lit(0)
    rows = rows.withColumn("range", F.when(F.col("id").isNull(), len(edges) + 1).otherwise(above))

    tops = rows.groupBy("range").agg(F.max("id").alias("id")).collect()  # one row per range
    order = sorted(r["range"] for r in tops)
    following = [(r["range"], order[order.index(r["range"]) - 1], r["id"]) for r in tops]
    kind = docs.schema[id_col].dataType.simpleString()
    following = spark.createDataFrame(following, f"range int, before int, id {kind}")
    firsts = rows.alias("r").join(F.broadcast(following).alias("f"), F.expr("r.range = f.range AND r.id <=> f.id"))
    firsts = firsts.groupBy(F.col("f.before").alias("range")).agg(F.min("r.text").alias("text"))
    firsts = with_anchors(firsts, "text", "anchors").select("range", F.col("text").alias("first"), F.col("anchors").alias("first_anchors"))

    sorted_ = W.partitionBy("range").orderBy(F.col("id").desc(), "text")
    rows = with_anchors(rows.repartition(n, "range"), "text", "anchors")
    rows = rows.withColumns({"next": F.lead("text").over(sorted_), "next_anchors": F.lead("anchors").over(sorted_)})
    rows = rows.join(F.broadcast(firsts), "range")
    return rows.select("id", "text", "anchors", F.coalesce("next", "first").alias("next"), F.coalesce("next_anchors", "first_anchors").alias("next_anchors"))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text, its edited text (the second half replaced from the next document) and the likenesses of fingerprints:
    (id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next)."""
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text"))
    half = "cast(floor(n_chars / 2) AS int)"
    rows = rows.withColumn("edited", F.expr(f"concat(substr(text, 1, n_chars - {half}), substr(next, 1, {half}))"))
    rows = with_anchors(rows, "edited", "edited_anchors")
    steps = (("edited_anchors", "near_edited"), ("next_anchors", "near_next"))
    rows = reduce(lambda df, step: with_likeness(df, "anchors", *step), steps, rows)
    return rows.select(F.col("id").alias(id_col), F.col("n_chars").cast("long").alias("n_chars"), "edited", F.array_join("anchors", "").alias("fingerprint"),
                       F.array_join("edited_anchors", "").alias("edited_fingerprint"), "near_edited", "near_next")
