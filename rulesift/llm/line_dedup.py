"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line repeats an earlier one if both are equal, or if their edit distance in
code points is at most 1 and both have at least ``MIN_NEAR`` code points.  Of
lines that repeat each other the earliest stays (order: document id, then a hash
of the text for different rows of one id, then position); a line goes if any
earlier line of the table matches it, kept or not.

1. *Classes.*  Lines are hashed (128 bits) where they are read; equal lines are
   pre-aggregated to their first place, so a hot line leaves a task once.
2. *Which classes can have a neighbour.*  One edit leaves the left or the right
   half of a line as it is.  Each class gives the hashes of its halves, cut for
   its own length and for a partner that is one shorter; halves held by one class
   only end here.  The other half is cut again into ``PIECES``, all but one of which
   must be shared.  No neighbour is lost, and no pair is made.
3. *Deletion neighbourhood.*  For the other classes every one-character deletion
   within that piece becomes a hashed key.  Two lines of one length match
   exactly if they share a deletion at the same place; a line matches one that
   is longer by one exactly if it equals one of that line's deletions.  So
   within a key the earliest class is a partner of all the others: a minimum
   per key finds it, and groups of any size cost one row per member.
4. *Verify and keep.*  Each class meets its earliest partners' text; the edit
   distance decides.  Documents are rebuilt from the lines that stay.

Defined cases: null text stays null and has no lines; blank lines stay and match
nothing; rows equal in id and text count as one document and are both returned;
an empty table gives an empty table; other columns pass through ``dedup`` whatever
their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulesift.session import materialize

MIN_NEAR = 16
#: Classes with possible neighbours are broadcast up to this count, else joined by a shuffle.
BROADCAST_CLASSES = 200_000
#: Pieces that the half with the edit is cut into before its deletions are made.
PIECES = 16


def _half(length: Column) -> Column:
    return F.floor(length / 2).cast("int")


def _halves(line: Column, length: Column) -> Column:
    """Hashes of a line's left and right half: as a member of its own length (0, 1), and as
    the longer partner of a line that is one shorter (2, 3)."""
    parts = []
    for shorter in (length, length - 1):
        half = _half(shorter)
        parts += [F.xxhash64(F.lit(0), shorter, F.substr(line, F.lit(1), half)), F.xxhash64(F.lit(1), shorter, F.right(line, shorter - half))]
    return F.array(*parts)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))


def _lines(documents: DataFrame) -> DataFrame:
    """(id, row, position, line, length) of lines that are not blank."""
    return (documents.select("id", "row", F.posexplode(F.split("text", "\n", -1)).alias("position", "line"))
            .where(F.trim("line") != "").withColumn("length", F.length("line")))


def _hashed(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"a": F.xxhash64("line"), "b": F.xxhash64(F.lit("second"), "line")})


def _classes(documents: DataFrame) -> DataFrame:
    """One row per distinct line: its hashes, first place, length and halves (null if it is short)."""
    lines = _hashed(_lines(documents)).withColumn("halves", F.when(F.col("length") >= MIN_NEAR, _halves(F.col("line"), F.col("length"))))
    return lines.groupBy("a", "b").agg(F.min(F.struct("id", "row", "position")).alias("first"), F.first("length").alias("length"), F.first("halves").alias("halves"))


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key several classes hold."""
    several = rows.groupBy(key).agg(F.min("a").alias("least"), F.max("a").alias("most")).where("least < most").select(key)
    return rows.join(several, key, "left_semi")


def _refine(rows: DataFrame) -> DataFrame:
    """Rows (half, longer, a, b, first, part) with the part cut again: the edit lies in one of ``PIECES`` pieces."""
    at = "cast(floor(q * shorter / {0}) AS int), cast(floor((q + 1) * shorter / {0}) AS int)".format(PIECES).split("), ")
    rows = rows.withColumn("shorter", F.length("part") - F.col("longer")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    rows = rows.withColumns({"before": F.expr(at[0] + ")"), "after": F.expr(f"shorter - {at[1]}")})
    rows = rows.select(F.expr("xxhash64(half, q, substr(part, 1, before), right(part, after))").alias("half"), "longer", "a", "b", "first",
                       F.expr("substr(part, before + 1, length(part) - before - after)").alias("part"))
    return _shared(rows, "half")


def _near(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) of the classes that an earlier class matches by one edit."""
    halves = classes.where("halves IS NOT NULL").select("a", F.posexplode("halves").alias("kind", "half"))
    open_ = materialize(_shared(halves, "half").join(classes.select("a", "b", "first"), "a"), "line_halves")
    wanted = open_.select("first.*", "a", "b").distinct()
    if wanted.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES:
        wanted = F.broadcast(wanted)
    lines = _lines(documents).alias("l")
    on = F.expr("l.id <=> w.id AND l.row = w.row AND l.position = w.position")
    texts = materialize(lines.join(wanted.alias("w"), on).select("a", "b", "line").dropDuplicates(["a", "b"]), "line_texts")

    # the half that may differ, of a member of the shorter length and of the longer partner
    rows = open_.join(texts, ["a", "b"]).withColumns({"side": F.expr("kind % 2"), "longer": F.expr("cast(kind DIV 2 AS int)")})
    rows = rows.withColumn("shorter", F.length("line") - F.col("longer"))
    left = _half(F.col("shorter"))
    part = F.when(F.col("side") == 0, F.substr("line", left + 1)).otherwise(F.substr("line", F.lit(1), left + F.col("longer")))
    rows = materialize(_refine(rows.select("half", "longer", "a", "b", "first", part.alias("part"))), "line_pieces")
    # a deletion at its place, for partners of equal length; at place 0, what one deletion leaves, for partners that differ by one
    deletions = F.expr("""if(longer = 0,
        concat(transform(sequence(1, length(part), 1), i -> named_struct('at', i, 'key', xxhash64(half, substr(part, 1, i - 1), substr(part, i + 1)))),
               array(named_struct('at', 0, 'key', xxhash64(half, part)))),
        transform(sequence(1, length(part), 1), i -> named_struct('at', 0, 'key', xxhash64(half, concat(substr(part, 1, i - 1), substr(part, i + 1))))))""")
    variants = (rows.where("longer = 1 OR length(part) > 0").select("a", "b", "first", "longer", F.explode(deletions).alias("v")).select("a", "b", "first", "longer", "v.at", "v.key")
                .union(rows.where("longer = 0 AND length(part) = 0").select("a", "b", "first", "longer", F.lit(0), F.expr("xxhash64(half, part)"))).distinct())
    own = F.struct("first", "a", "b")
    earliest = variants.groupBy("key", "at").agg(F.min(F.when(F.col("longer") == 0, own)).alias("short"), F.min(F.when(F.col("longer") == 1, own)).alias("long"))
    partner = F.when((F.col("at") > 0) | (F.col("longer") == 1), F.col("short")).otherwise(F.col("long"))
    pairs = (variants.join(earliest, ["key", "at"]).withColumn("partner", partner)
             .where(F.col("partner.first") < F.col("first")).select("a", "b", F.col("partner.a").alias("pa"), F.col("partner.b").alias("pb")).distinct())
    other = texts.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("line").alias("earlier"))
    return (pairs.join(texts, ["a", "b"]).join(other, ["pa", "pb"])
            .where(F.levenshtein("line", "earlier", 1).between(0, 1)).select("a", "b").distinct())


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, position) of the lines that stay, blank ones aside; ``row`` is the text's hash."""
    documents = _documents(docs, id_col, text_col)
    classes = materialize(_classes(documents), "line_classes")
    return classes.join(_near(documents, classes), ["a", "b"], "left_anti").select("first.*")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the text of each row rebuilt from its lines that stay.

    ``count_col`` adds or replaces a column with the struct (lines, kept) of lines that are not blank.
    """
    kept = kept_lines(docs, id_col, text_col).groupBy("id", "row").agg(F.sort_array(F.collect_list("position")).alias("at"))
    # places of the lines that stay as a string of flags, one per line
    gaps = F.zip_with(F.col("at"), F.concat(F.array(F.lit(-1)), F.col("at")), lambda here, before: F.concat(F.repeat(F.lit("0"), here - before - 1), F.when(here.isNotNull(), F.lit("1"))))
    kept = kept.select("id", "row", F.array_join(gaps, "").alias("flags")).alias("k")
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row")).alias("d")
    rows = rows.join(kept, F.expr("d.id <=> k.id AND d.row = k.row"), "left").select("doc", F.coalesce("flags", F.lit("")).alias("flags"))
    text = F.col("doc").getField(text_col)
    marked = F.zip_with(F.split(text, "\n", -1), F.split("flags", ""), lambda line, flag: F.when((F.trim(line) == "") | (flag == "1"), line))
    columns = {c: F.col("doc").getField(c) for c in docs.columns} | {text_col: F.array_join(marked, "\n")}
    if count_col:
        lines = F.when(text.isNull(), 0).otherwise(F.size(F.filter(F.split(text, "\n", -1), lambda line: F.trim(line) != "")))
        columns[count_col] = F.struct(lines.alias("lines"), F.length(F.replace("flags", F.lit("0"), F.lit(""))).alias("kept"))
    return rows.select(*(value.alias(name) for name, value in columns.items()))
