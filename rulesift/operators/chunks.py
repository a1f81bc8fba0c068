"""Very large files: one file over many tasks, by an associative scan over its chunks.

A chunk is a run of whole lines of a file (cut after ``\\n``).  Docstring states, line numbers
and session chains cross chunks; each chunk is summed up by what it does to them:

* line count;
* W1: whether its flips are odd (the state goes in, is flipped or not, comes out);
* W2: whether it resets, and the parity of its toggles after the last reset: a chunk without
  reset flips or keeps the state, one with reset sets it;
* the cross-line session search: its last open lines.  A match of the session pattern crosses a
  line end only after ``SparkSession``, after its dot, or after ``getOrCreate``, so it crosses at most three
  lines with text, each open at its end; those of the chunks before come first in a chunk's
  search.

Findings read each text once.  What a chunk's lines give is found before the states are known, in all states that
the chunk may start with: line numbers count from its first line, a finding that hangs on W1 says which state it
needs, comments are counted for both states of W2, and the first lines that could end a session match begun before
are kept (few chunks have such).  These rows and the sums (a row per chunk) are written once.  The
sums are composed in file order by windows over chunks, which share one shuffle and one sort, and each
chunk's findings get the state it starts with: the states are broadcast if they are at most ``BROADCAST_CHUNKS``, else
joined by a shuffle (never by the size of their files, which are packed many times smaller than rows in memory), by
number of chunk, so that the findings of one file are spread over many tasks.  Texts do not move.

``read_chunks`` cuts files with Spark's text source, which deals byte ranges of one file to
many tasks on any file system that Spark reads; ``cut`` cuts files that are rows.  Results equal the
row form (``detectors.find``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rulesift import fixed
from rulesift.config import ScanConfig
from rulesift.functions import text as X
from rulesift.operators import detectors as D
from rulesift.operators import lines as L
from rulesift.session import materialize

CHUNK_BYTES = 4 << 20
BROADCAST_CHUNKS = 20_000
FILE = ["repo", "branch", "path"]
#: Place of a chunk in its file.
PLACE = ["start", "seq"]
#: The end of a line that a session match can go on from.
OPEN_RX = r"(?:SparkSession(?:\s*\.)?|getOrCreate)\s*$|^\s*\.\s*$"
MOST_OPEN = 3
#: The begin of a (stripped) line that a session match can go on with, and how many lines with text decide on matches from before
#: that reach the line or begin on the next one: they go on over at most MOST_OPEN more.
GOES_ON_RX = r"^(?:\.|builder|\()"
MOST_DECIDED = 2
BOM = b"\xef\xbb\xbf"


def cut(files: DataFrame, lines: int) -> DataFrame:
    """Files with ``text`` as chunks of so many ``\\n``-ended lines (a null or empty text: one chunk)."""
    rows = F.split("text", "\n", -1)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("_rows") - 1) / lines).cast("int")),
                        lambda k: F.struct(k.cast("long").alias("seq"), F.concat(F.array_join(F.slice("_rows", k * lines + 1, lines), "\n"), F.when((k + 1) * lines < F.size("_rows"), "\n").otherwise("")).alias("text")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("text")))
    return (files.withColumn("_rows", rows).select(*FILE, F.explode(F.when(F.col("text").isNull(), whole).otherwise(parts)).alias("c"))
            .select(*FILE, F.lit(0).cast("long").alias("start"), F.col("c.seq").alias("seq"), F.col("c.text").alias("text")))


def read_chunks(spark: SparkSession, root: str, repo: str, branch: str = "", glob: str = "*.py", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of the files below ``root`` (a path or URI), read in byte ranges and written once to the
    shared scratch folder; empty files have no chunk."""
    source = (spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root)
              .select("_metadata.file_path", F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value")))
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("seq", T.LongType()),
                           T.StructField("size", T.LongType()), T.StructField("content", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq, rows, held = None, 0, [], 0

        def chunk() -> pa.RecordBatch:
            columns = ([at[0]], pa.string()), ([at[1]], pa.int64()), ([seq], pa.int64()), ([at[2]], pa.int64()), ([b"\n".join([*rows, b""])], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in columns], names=schema.fieldNames())

        for batch in batches:
            for file, start, size, value in zip(*(c for c in batch.columns), strict=True):
                place = (file.as_py(), start.as_py(), size.as_py())
                if rows and (place != at or held >= chunk_bytes):
                    yield chunk()
                    seq, rows, held = (seq + 1 if place == at else 0), [], 0
                at = place
                rows.append(value.as_py())
                held += len(rows[-1]) + 1
        if rows:
            yield chunk()

    chunks = materialize(source.mapInArrow(pack, schema), "chunks")
    # what the reader takes away: the last line's end is not told from none, a byte order mark is skipped
    sums = chunks.groupBy("file").agg((F.sum(F.octet_length("content")) - F.first("size")).alias("more"), F.min(F.struct(*PLACE)).alias("first"), F.max(F.struct(*PLACE)).alias("last"))
    here = F.struct(*PLACE)
    marked = F.when((F.col("more") < 0) & (here == F.col("first")), F.concat(F.lit(BOM), "content")).otherwise(F.col("content"))
    unended = F.col("more").isin(1, 1 - len(BOM)) & (here == F.col("last"))
    content = F.when(unended, F.expr("substring(content, 1, length(content) - 1)")).otherwise(F.col("content"))
    whole = _joined(chunks, sums, ["file"]).withColumn("content", marked).withColumn("content", content)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    name = F.url_decode(F.replace(F.regexp_replace("file", r"^[a-zA-Z][\w+.-]*:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    return whole.select(F.lit(repo).alias("repo"), F.lit(branch).alias("branch"), F.substring(name, F.lit(len(base) + 2), F.length(name)).alias("path"), *PLACE, X.decode_utf8(F.col("content")).alias("text"))


def _sized(sums: DataFrame) -> DataFrame:
    """Written sums, to be joined by broadcast only if they are few."""
    return F.broadcast(sums) if sums.limit(BROADCAST_CHUNKS + 1).count() <= BROADCAST_CHUNKS else sums.hint("merge")


def _joined(chunks: DataFrame, sums: DataFrame, key: list[str]) -> DataFrame:
    """``chunks`` with the columns of ``sums``, by a null-safe key."""
    sums = _sized(materialize(sums, "chunk_sums"))
    right = sums.select(*(F.col(k).alias(f"_{k}") for k in key), *(c for c in sums.columns if c not in key))
    same = F.lit(True)
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return chunks.join(right, same).drop(*(f"_{k}" for k in key))


def _numbered(lines: Column, stripped: Column) -> Column:
    """The lines with text: structs (n, text, st)."""
    return F.filter(F.transform(F.arrays_zip(lines.alias("line"), stripped.alias("st")), lambda z, i: F.struct((i + 1).alias("n"), z["line"].alias("text"), z["st"].alias("st"))), lambda z: z["st"] != "")


def _flagged(numbered: Column) -> Column:
    return F.transform(numbered, lambda z: F.struct(z["n"].alias("n"), z["text"].alias("text"), z["text"].rlike(X.rx(OPEN_RX)).alias("open")))


def _placed(flagged: Column) -> Column:
    return F.transform(flagged, lambda z: F.struct(z["n"].alias("n"), z["text"].alias("text")))


def _open_lines(lines: Column, stripped: Column) -> Column:
    """The last lines with text, while each is open: structs (n, text), in order.  A struct without
    text stands before them if the chunk has other lines with text (the chain begins here)."""
    numbered = _numbered(lines, stripped)
    flagged = _flagged(F.slice(numbered, F.greatest(F.size(numbered) - MOST_OPEN + 1, F.lit(1)), MOST_OPEN))
    closed = F.coalesce(F.array_max(F.transform(flagged, lambda z, i: F.when(~z["open"], i + 1))), F.lit(0))
    chain = _placed(F.slice(flagged, closed + 1, MOST_OPEN))
    return F.when(F.size(numbered) == 0, _no_lines()).when((closed > 0) | (F.size(numbered) > MOST_OPEN), F.concat(_barrier(), chain)).otherwise(chain)


def _no_lines() -> Column:
    return F.array().cast("array<struct<n:int,text:string>>")


def _barrier() -> Column:
    return F.array(F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("text")))


def _first_lines(lines: Column, stripped: Column) -> Column:
    """The first lines with text (n, text) that matches from before can reach or begin on, as far as matches cross their ends."""
    flagged = _flagged(F.slice(_numbered(lines, stripped), 1, MOST_DECIDED + MOST_OPEN))
    closed = F.coalesce(F.array_min(F.transform(flagged, lambda z, i: F.when(~z["open"], i + 1))), F.lit(MOST_DECIDED + MOST_OPEN))
    return _placed(F.slice(flagged, 1, closed))


def _decided() -> Column:
    """The number of the last line whose starts of matches are decided with the lines before the chunk; 0 if none is."""
    return F.coalesce(F.element_at(F.col("head"), F.least(F.size("head"), F.lit(MOST_DECIDED)))["n"], F.lit(0))


def _stripped() -> Column:
    """``stripped``, computed where it is needed alone: few chunks hold a marker or begin or end within a session."""
    return F.coalesce(F.slice(F.split("stripped_text", "\n", -1), 2, F.size("lines")), F.array().cast("array<string>"))


def _with_flags(prepared: DataFrame) -> DataFrame:
    """Adds ``_f2``, the flags of W2 where the chunk holds a marker, and its sums: ``n``, ``flips``, ``resets``, ``toggles``."""
    text, ones = F.col("text"), lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    f2 = F.coalesce("_f2", F.lit(""))
    return (prepared.withColumn("_f2", F.when(X.has_triple_quote(text), L.w2_flags(_stripped())))
            .withColumns({"n": F.size("lines").cast("long"), "flips": F.when(F.col("_f2").isNotNull(), X.triple_quotes(text) % 2).otherwise(0),
                          "resets": (F.instr(f2, "R") > 0).cast("int"), "toggles": F.when(F.col("_f2").isNotNull(), ones(F.substring_index(f2, "R", -1), "T") % 2).otherwise(0)}))


def _in_file():
    return Window.partitionBy("_file", *FILE).orderBy(*PLACE)


def _composed(sums: DataFrame, **more: Column) -> DataFrame:
    """Sums of chunks (FILE, PLACE, ``n``, ``flips``, ``resets``, ``toggles``), all of a file in one partition and in order, with ``before`` (lines before),
    ``in1`` and ``in2`` (states the chunk starts with), ``copies`` (chunks of this place, if files share a name), and ``more`` of the first step."""
    # a number first: it decides most comparisons of a sort.  All windows have one order, only their frames differ
    sums = sums.withColumn("_file", F.xxhash64(*FILE)).repartition("_file", *FILE)
    in_file, before, here = _in_file(), _in_file().rowsBetween(Window.unboundedPreceding, -1), _in_file().rangeBetween(Window.currentRow, Window.currentRow)
    sums = sums.withColumns({"copies": F.count(F.lit(1)).over(here).cast("int"), "_reset": F.max("resets").over(here), "_own": F.sum("toggles").over(here), "_toggles": F.sum("toggles").over(in_file),
                             "before": F.coalesce(F.sum("n").over(before), F.lit(0)), "in1": F.coalesce(F.sum("flips").over(before) % 2, F.lit(0)).cast("int"), **more})
    # toggles count from the last chunk with a reset on
    since = F.last(F.when(F.col("_reset") > 0, F.col("_toggles") - F.col("_own")), ignorenulls=True).over(before)
    return sums.withColumn("in2", F.coalesce((F.lag("_toggles").over(in_file) - F.coalesce(since, F.lit(0))) % 2, F.lit(0)).cast("int")).drop("_reset", "_own", "_toggles")


def with_states(chunks: DataFrame, cfg: ScanConfig | None = None) -> DataFrame:
    """Pruned chunks with ``lines``, ``stripped``, ``before`` and per line ``w1`` and ``w2``."""
    cfg = cfg or ScanConfig()
    prepared = L.with_line_arrays(L.prune(chunks, cfg.skip_dirs))
    flagged = _with_flags(prepared)
    of = _composed(materialize(flagged.select(*FILE, *PLACE, "n", "flips", "resets", "toggles"), "chunk_states"))
    of = of.select(*FILE, *PLACE, "before", "in1", "in2", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("col")
    states = _joined(flagged.drop("n", "flips", "resets", "toggles"), of, [*FILE, *PLACE])
    w2 = F.when(F.col("_f2").isNull(), F.array_repeat("in2", F.size("lines"))).otherwise(F.slice(L.w2_state(F.concat(F.repeat(F.lit("T"), F.col("in2")), "_f2")), F.col("in2") + 1, F.size("lines")))
    return states.withColumns({"w1": F.transform("w1", lambda x: x.bitwiseXOR(F.col("in1"))), "w2": w2}).drop("_f2")


_ENTRY = f"struct<f:{D.FINDING_TYPE},needs:int>"


def _entry(f: Column, needs: Column | None = None) -> Column:
    return F.struct(f.alias("f"), (needs if needs is not None else F.lit(None)).cast("int").alias("needs"))


def _scanned(chunks: DataFrame, cfg: ScanConfig) -> DataFrame:
    """One pass over the texts, written once: per chunk a row with its number ``id`` and its ``sum``, and per finding, in whatever state, a row with
    the chunk's ``id``, the line's number in the chunk and the state of W1 that the finding ``needs`` the chunk to start with."""
    f = _with_flags(L.with_line_arrays(L.prune(chunks, cfg.skip_dirs))).withColumn("_ended", F.coalesce(F.rtrim("stripped_text", F.lit("\n")), F.lit("")))
    parts, own = ["n", "flips", "resets", "toggles", F.col("text").isNotNull().alias("readable")], F.array().cast(f"array<{_ENTRY}>")
    # numbers at once: each step copies the texts that a later one needs
    if cfg.comment_density:
        # a chunk that starts inside a docstring has the code of one that follows a line with a marker
        marked, inside = F.col("_f2").isNotNull(), F.concat(F.lit('\n"""'), "_solid")
        f = f.withColumn("_solid", F.when(F.contains("_ended", F.lit("\n\n")), F.regexp_replace("_ended", L.BLANK_RX, "")).otherwise(F.col("_ended")))
        noted = marked | F.contains("_solid", F.lit("\n#"))
        f = f.withColumns({"_code0": F.when(noted, L.without_comments(F.col("_solid"))).otherwise(F.col("_solid")), "_code1": F.when(marked, L.without_comments(inside)).otherwise(F.lit(""))})
        counts = {f"code{k}": X.count_breaks(F.col(f"_code{k}")).cast("long") for k in "01"}
        counts |= {f"comment{k}": (X.count_breaks(F.col("_solid")) - counts[f"code{k}"] + L.inline_comments(F.col(f"_code{k}"))).cast("long") for k in "01"}
        f = f.withColumns(counts).drop("_solid", "_code0", "_code1")
        parts += [*counts]
    if D._multiline_on(cfg):
        either = lambda col, test, ends: reduce(Column.__or__, (test(col, x) for x in ends))
        begin = F.ltrim("_ended", F.lit("\n"))
        f = f.withColumns({"_opens": either(F.col("_ended"), Column.endswith, "nNeE.") & F.substring_index("_ended", "\n", -1).rlike(X.rx(OPEN_RX)),
                           "_goes_on": either(begin, Column.startswith, "bB.(") & F.substring_index(begin, "\n", 1).rlike(X.rx(GOES_ON_RX)),
                           "_blank": F.col("_ended") == "", "_maybe": D.may_hold_sessions(F.lower("stripped_text"), F.col("text"), F.col("_plain"))}).drop("_ended")
        open_lines = F.when(F.col("_blank"), _no_lines()).when(F.col("_opens"), _open_lines(F.col("lines"), _stripped()))  # null: a barrier
        marks = F.transform(D.marked_sessions(F.col("lines")), lambda m, i: F.when(m.contains(D._MARK), i + 1))
        f = f.withColumns({"open": open_lines, "head": F.when(F.col("_goes_on"), _first_lines(F.col("lines"), _stripped())), "_starts": F.when(F.col("_maybe"), F.array_compact(marks))})
        alone = F.filter("_starts", lambda n: (n > _decided()) & ~D.told_by_line(F.element_at("lines", n)))
        own = F.transform(alone, lambda n: _entry(D.finding(1, n, X.py_strip(F.element_at("lines", n)), F.lit(fixed.P1_DESC_MULTI))))
        own = F.when(F.size("_starts") > 0, own).otherwise(F.array().cast(f"array<{_ENTRY}>"))
        parts += ["open", "head"]
    none = F.lit(None).cast(_ENTRY)
    f = f.select(F.monotonically_increasing_id().alias("id"), F.struct(*FILE, *PLACE, *parts).alias("sum"), F.concat(own, F.array(none)).alias("_own"), "text", "lines", "w1", "_plain")
    if not cfg.rule_sets:
        return materialize(f.select("id", "sum"), "chunk_rows")
    lines = D.described_lines(f, cfg, ["id", "sum", "_own"], F.lit(True), any_state=True)
    found = [F.when(F.col(f"_d{i}").isNotNull(), F.array(_entry(D.finding(rs.policy_id, F.lit(None), F.lit(None).cast("string"), F.col(f"_d{i}"), rs.severity), F.col("par") if rs.scope == "code_part" else None)))
             .otherwise(F.array().cast(f"array<{_ENTRY}>")) for i, rs in enumerate(cfg.rule_sets)]
    every = F.concat(*found, F.when(D.is_head(), F.col("_own")).otherwise(F.array().cast(f"array<{_ENTRY}>")))
    some = D.some_description(cfg) | D.is_head()
    rows = lines.select("id", "sum", "pos", "st", F.explode(F.when(some, every)).alias("e"))
    found = F.col("e").isNotNull()
    return materialize(rows.select(
        "id", F.when(~found, F.col("sum")).alias("sum"), "e.f.policy_id", F.when(found, F.coalesce("e.f.line_number", F.col("pos") + 1)).alias("n"),
        F.when(found, F.coalesce("e.f.line_content", X.truncate_content(F.col("st")))).alias("line_content"), "e.f.description", "e.f.severity", "e.needs"), "chunk_rows")


def _of_chunks(rows: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Per chunk, written once: ``id``, FILE, PLACE, ``before`` and ``in1``, ``copies``, whether the chunk is its file's ``first`` (with
    the file's counts), and what the session search over chunks needs."""
    here, whole = _in_file().rangeBetween(Window.currentRow, Window.currentRow), _in_file().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = [f"{c}{k}" for c in ("code", "comment") for k in "01"] if cfg.comment_density else []
    states = _composed(rows.where("sum IS NOT NULL").select("id", "sum.*"), _row=F.row_number().over(_in_file()), **{f"_{c}": F.sum(c).over(here) for c in counts})
    columns = {"readable": F.min("readable").over(whole)}
    if cfg.comment_density:
        columns |= {f"{c}_lines": F.sum(F.col("copies") * F.when(F.col("in2") == 1, F.col(f"_{c}1")).otherwise(F.col(f"_{c}0"))).over(whole) for c in ("code", "comment")}
    if D._multiline_on(cfg):
        columns["goes_on"] = F.max(F.col("head").isNotNull()).over(whole)
    states, first = states.withColumns(columns), F.col("_row") == 1
    kept = ["id", *FILE, *PLACE, "before", "in1", "copies", first.alias("first"), "readable", *(F.when(first, F.col(f"{c}_lines")).alias(f"{c}_lines") for c in ("code", "comment") if counts)]
    if D._multiline_on(cfg):
        kept += ["goes_on", F.when(F.col("goes_on"), F.col("open")).alias("open"), "head"]
    return materialize(states.select(*kept), "chunk_states")


def _with_starts(states: DataFrame) -> DataFrame:
    """Adds ``starts``, the ``before`` and ``in1`` that what is found in the chunk is placed by: its own.  Chunks of files that
    share a name are all placed as each of them starts."""
    start = F.struct("before", "in1")
    if states.where("copies > 1").isEmpty():
        return states.withColumn("starts", F.array(start))
    every = F.collect_list(start).over(Window.partitionBy(*FILE, *PLACE))
    return states.withColumn("_every", every).withColumn("starts", F.flatten(F.array_repeat("_every", F.col("copies")))).drop("_every")


def _sessions(states: DataFrame, cfg: ScanConfig) -> DataFrame:
    """The findings of session matches that begin before a chunk and end in it, and of those that begin on its
    first lines, where it begins with what a match can go on with."""
    # a row for each open line (or barrier), and one for the start of such a chunk, in file order
    begin = F.when(F.col("head").isNotNull(), F.array(F.lit(None).cast("struct<n:int,text:string>"))).otherwise(_no_lines())
    events = (states.where("goes_on")
              .select(*FILE, *PLACE, "before", "head", "starts", F.explode(F.concat(begin, F.coalesce("open", _barrier()))).alias("e"))
              .select(*FILE, *PLACE, "head", "starts", F.coalesce("e.n", F.lit(-1)).alias("n"), F.when(F.col("e").isNotNull(), F.struct((F.col("before") + F.col("e.n")).alias("n"), F.col("e.text").alias("text"))).alias("e")))
    order = f"OVER (PARTITION BY {', '.join(FILE)} ORDER BY {', '.join(PLACE)}, n)"
    events = events.withColumns({f"e{k}": F.expr(f"lag(e, {k}) IGNORE NULLS {order}") for k in range(1, MOST_OPEN + 1)}).where("e IS NULL")
    last = F.array_compact(F.array(*(f"e{k}" for k in range(1, MOST_OPEN + 1))))  # nearest first
    stop = F.coalesce(F.array_min(F.transform(last, lambda e, i: F.when(e["text"].isNull(), i))), F.size(last))
    at = events.select(*FILE, F.reverse(F.slice(last, 1, stop)).alias("carry"), "head", F.explode("starts").alias("s"))
    texts = F.transform("carry", lambda c: c["text"])
    at = at.withColumns({"_marked": D.marked_sessions(F.concat(texts, F.transform("head", lambda h: h["text"]))), "_known": F.when(F.size("carry") > 0, D.marked_sessions(texts))})
    # a carried line is not told again; of the chunk's lines, the later ones are told by its own search
    lines = F.concat(F.transform("carry", lambda c: F.struct(c["n"].cast("long").alias("n"), c["text"].alias("line"), F.lit(True).alias("new"))),
                     F.transform("head", lambda h: F.struct((h["n"] + F.col("s.before")).alias("n"), h["text"].alias("line"), (h["n"] <= _decided()).alias("new"))))
    starts = F.filter(F.arrays_zip(lines.alias("z"), F.col("_marked").alias("m")), lambda z, i: (F.instr(z["m"], D._MARK) > 0) & z["z"]["new"] & ~F.coalesce(F.instr(F.get("_known", i), D._MARK) > 0, F.lit(False)))
    found = at.select(*FILE, F.explode(F.filter(F.transform(starts, lambda z: z["z"]), lambda z: ~D.told_by_line(z["line"]))).alias("z"))
    return D._findings_columns(found.select(*FILE, D.finding(1, F.col("z.n"), X.py_strip(F.col("z.line")), F.lit(fixed.P1_DESC_MULTI)).alias("f")), cfg)


def find_chunks(chunks: DataFrame, cfg: ScanConfig | None = None) -> DataFrame:
    """PA over chunks (repo, branch, path, start, seq, text): the findings of the row form."""
    cfg = cfg or ScanConfig()
    rows = _scanned(chunks, cfg)
    states = _of_chunks(rows, cfg)
    placed = _with_starts(states)
    found = D._findings_columns(states.where("false").select(*FILE, F.explode(D.empty_findings()).alias("f")), cfg)
    if cfg.rule_sets:
        lines = rows.where("policy_id IS NOT NULL").drop("sum").withColumnRenamed("n", "_n")
        starts = placed.select("id", *FILE, F.explode("starts").alias("s")).select("id", *FILE, "s.*")
        lines = lines.join(_sized(starts), "id").where("needs IS NULL OR needs = in1")
        found = D._findings_columns(lines.select(*FILE, F.struct("policy_id", (F.col("before") + F.col("_n")).cast("int").alias("line_number"), "line_content", "description", "severity").alias("f")), cfg)
    if D._multiline_on(cfg):
        found = found.union(_sessions(placed, cfg))
    parts = [D.comment_density_finding(F.col("code_lines"), F.col("comment_lines"), cfg)] * cfg.comment_density + [D.file_name_finding(F.col("path"), cfg)] * cfg.file_names
    if parts:
        per_file = states.where("first AND readable").select(*FILE, F.explode(F.concat(*parts)).alias("f"))
        found = found.union(D._findings_columns(per_file, cfg))
    return D.with_frames(found, lambda: _lines(with_states(chunks, cfg)), cfg)


def _lines(states: DataFrame) -> DataFrame:
    """The line table of the row form."""
    z = F.arrays_zip("lines", "stripped", "w1")
    return (states.select(*FILE, "before", F.posexplode(z).alias("pos", "z"))
            .select(*FILE, (F.col("before") + F.col("pos") + 1).cast("int").alias("line_number"), F.col("z.lines").alias("line"), F.col("z.stripped").alias("stripped"), F.col("z.w1").alias("in_docstring")))
