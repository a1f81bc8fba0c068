"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts up to ``ORDER`` with counts from the training
rows.  A symbol (a byte, or the end of the text) is coded in the longest context
seen in training, at (count - 1/2) / total; if it is new there, an escape
((distinct / 2) / total, method D) leads to the next shorter context, where the
symbols of the longer one are excluded from counts and escape alike; below order 0
the symbols never seen share the rest evenly.  So a text's probability is
one of a distribution over all texts.  Letters A-Z are lower-cased first.

Pretrained lengths of all distinct (context, symbol) pairs, computed by Spark:

1. Tasks cut texts into blocks and count, per block, distinct pairs and distinct
   words (hashed to 63 bits) over its training rows: a map-side combine.  Blocks,
   with their texts, are written once, bucketed by block.
2. (item, block) rows are summed by item.  Counts of orders 0 and 1 are bounded
   tables (at most 258 x 257) that tasks receive whole, those of order 2 a table that is
   joined; higher orders are summed within groups of pairs that share the last three
   symbols, where log10 P of each pair follows.
3. Values return to the blocks that hold the item, and each block adds them up per
   text.  Nothing of the corpus' size is held by the driver or by one task.

The same pass gives a unigram word model with add-one smoothing as the baseline.

Defined cases: null text is the empty text (its end is still coded); without training
rows every symbol costs log10 257; repeated rows are scored (and learnt) each, rows without an id
too; a text of megabytes is scored whole, in a block of its own, with some 50 bytes of arrays per
byte; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulesift.llm.bpe import _pack as pack
from rulesift.llm.bpe import _unpack as unpack
from rulesift.llm.shingles import Hasher
from rulesift.session import materialize, materialize_bucketed

ORDER = 5
END, START = 256, 257
SYMBOLS = 257
BITS = 9
BLOCK_BYTES = 32 << 20
#: Bytes of text turned into arrays at once (a longer text alone).
CHUNK = 1 << 21
#: The end of a text as a word.
END_WORD = np.int64(-(2**63))
SEND_ROWS = 1 << 19


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``CHUNK`` bytes, with the index of the first."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and (size + len(text) > CHUNK or i - first >= 1 << 17):
            yield first, texts[first:i]
            first, size = i, 0
        size += len(text)
    if texts:
        yield first, texts[first:]


def pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context, symbol) of every symbol as one number, and the text it is of.

    The number holds the context's symbols from the last to the first, then the symbol.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    symbols = np.full(int(sizes.sum()) + len(texts) * (ORDER + 1), START, np.int64)
    at = 0
    for text in texts:
        at += ORDER
        symbols[at:at + len(text)] = np.frombuffer(text, np.uint8)
        at += len(text) + 1
        symbols[at - 1] = END
    coded = np.zeros(len(symbols) - ORDER, np.int64)
    for k in range(1, ORDER + 1):
        coded = (coded << BITS) | symbols[ORDER - k:len(symbols) - k]
    coded = (coded << BITS) | symbols[ORDER:]
    return coded[symbols[ORDER:] != START], np.repeat(np.arange(len(texts)), sizes + 1)


def words(texts: list[bytes], hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Every word, and each text's end, as a negative number, and the text it is of."""
    firsts = np.cumsum([0, *(len(x) + 1 for x in texts[:-1])])
    found, starts = hasher.words(b" ".join(texts))
    found = (found | np.uint64(1 << 63)).view(np.int64)
    found = np.where(found == END_WORD, END_WORD + 1, found)
    of = np.searchsorted(firsts, starts, "right") - 1
    return np.concatenate([found, np.full(len(texts), END_WORD)]), np.concatenate([of, np.arange(len(texts))])


class _Counter:
    """Distinct numbers with counts, merged now and then."""

    def __init__(self):
        self.items, self.counts, self.size, self.merged = [], [], 0, 0

    def add(self, numbers: np.ndarray, weight: int) -> None:
        found, counts = np.unique(numbers, return_counts=True)
        self.items.append(found)
        self.counts.append(counts * weight)
        self.size += len(found)
        if self.size > 2 * self.merged + (1 << 20):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        items, counts = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.items, self.counts))
        found, place = np.unique(items, return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, place, counts)
        self.items, self.counts, self.size, self.merged = [found], [total], len(found), len(found)
        return found, total


def _blocks(docs: DataFrame, id_col: str, text_col: str, taught_col: str) -> DataFrame:
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(docs.schema[id_col].dataType)),
        T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("texts", T.BinaryType()),
        T.StructField("items", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, hasher = TaskContext.get().partitionId() << 32, 0, Hasher()

        def block(ids, texts, taught, id_type):
            counter = _Counter()
            for weight in (0, 1):
                for _, some in _chunks([x for x, t in zip(texts, taught, strict=True) if t == weight]):
                    counter.add(pairs(some)[0], weight)
                    counter.add(words(some, hasher)[0], weight)
            items, counts = counter.merge()
            lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64()))
            return pa.RecordBatch.from_arrays([
                pa.array([base + made], pa.int64()), pa.array([ids], pa.list_(id_type)), lists([len(x) for x in texts]),
                pa.array([zstandard.compress(b"".join(texts), 1)], pa.binary()), lists(items), lists(counts)], names=schema.fieldNames())

        ids, texts, taught, size, kind = [], [], [], 0, None
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids.append(doc_id)
                texts.append((text or "").encode("utf-8", "surrogatepass").lower())
                taught.append(int(bool(t)))
                size += len(texts[-1]) + 16
                if size >= BLOCK_BYTES:
                    yield block(ids, texts, taught, kind)
                    made += 1
                    ids, texts, taught, size = [], [], [], 0
        if ids:
            yield block(ids, texts, taught, kind)

    return docs.select(id_col, text_col, taught_col).mapInArrow(cut, schema)


def pair_lengths(coded: np.ndarray, n: np.ndarray, low: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """log10 P of pairs that share their last three context symbols; n: training counts of these pairs,
    which hold all seen pairs of that context; low[x, s]: counts of order 1 (order 0 is their sum); n2[s]: counts of
    their order-2 context."""
    symbol = coded & ((1 << BITS) - 1)
    last = int(coded[0]) >> (BITS * ORDER)
    n0, n1 = low.sum(0), low[last]
    # per order: the pair's count, and of its context: total, distinct, and what the longer context excludes from it
    count, total, distinct, lower_of_seen = {}, {}, {}, {}
    for k in range(ORDER, 2, -1):
        context, of = np.unique(coded >> (BITS * (1 + ORDER - k)), return_inverse=True)
        key, pair = np.unique(of * (1 << BITS) + symbol, return_inverse=True)
        held = np.bincount(pair, n, len(key))
        at = key >> BITS
        count[k], total[k], distinct[k] = held[pair], np.bincount(at, held, len(context))[of], np.bincount(at, held > 0, len(context))[of]
        # lower counts of the symbols seen here: from the next order's counts, by one pair of each kind
        first = np.zeros(len(key), np.int64)
        first[pair] = np.arange(len(pair))
        lower_of_seen[k] = (first, at, held > 0, of, len(context))
    known = {2: n2, 1: n1, 0: n0}
    for k, counts in known.items():
        count[k], total[k], distinct[k] = counts[symbol], np.full(len(coded), counts.sum()), np.full(len(coded), (counts > 0).sum())

    def excluded(k):
        """Total of order k over the symbols that the context of order k + 1 has seen."""
        if k < 2:
            return np.full(len(coded), known[k][known[k + 1] > 0].sum())
        first, at, seen, of, contexts = lower_of_seen[k + 1]
        return np.bincount(at, count[k][first] * seen, contexts)[of]

    out, open_, top = np.zeros(len(coded)), np.ones(len(coded), bool), np.ones(len(coded), bool)
    for k in range(ORDER, -1, -1):
        known_ = open_ & (total[k] > 0)
        mass, new = total[k].astype(np.float64), distinct[k].astype(np.float64)
        if k < ORDER:
            mass, new = np.where(top, mass, mass - excluded(k)), np.where(top, new, new - distinct[k + 1])
        escape = np.where(distinct[k] < SYMBOLS, new, 0)
        all_ = 2 * mass - new + escape  # in halves
        here = known_ & (count[k] > 0)
        out[here] += np.log10((2 * count[k][here] - 1) / all_[here])
        on = known_ & ~here & (new > 0)
        out[on] += np.log10(escape[on] / all_[on])
        open_ &= ~here
        top &= ~known_
    out[open_] -= np.log10(SYMBOLS - distinct[0][open_])
    return out


def _lengths(totals: DataFrame, low: np.ndarray) -> DataFrame:
    """(item, value): log10 P of every pair.  Pairs meet by their last three context symbols; the counts of
    the order-2 context, a row of at most ``SYMBOLS`` counts, come to each of these groups."""

    def group(three: pa.Table, two: pa.Table) -> pa.Table:
        coded, n = three.column("item").to_numpy(), three.column("n").to_numpy()
        n2 = np.zeros(SYMBOLS, np.int64)
        for counts in two.column("counts"):
            for x in counts.as_py():
                n2[x["s"]] = x["n"]
        return pa.table({"item": pa.array(coded), "value": pa.array(pair_lengths(coded, n, low, n2) if len(coded) else np.zeros(0))})

    symbols = lambda k: F.shiftright("item", BITS * (ORDER + 1 - k))  # noqa: E731  the last k of the context
    pairs = totals.where("item >= 0").select("item", "n", symbols(3).alias("three"))
    by_symbol = totals.where("item >= 0 AND n > 0").groupBy(symbols(2).alias("two"), F.col("item").bitwiseAND((1 << BITS) - 1).alias("s")).agg(F.sum("n").alias("n"))
    order2 = by_symbol.groupBy("two").agg(F.collect_list(F.struct("s", "n")).alias("counts"))
    wanted = pairs.select("three", F.shiftright("three", BITS).alias("two")).distinct()
    beside = wanted.join(order2, "two").select(F.col("three").alias("of"), "counts")
    return pairs.groupBy("three").cogroup(beside.groupBy("of")).applyInArrow(group, "item long, value double")


def _send(values: DataFrame) -> DataFrame:
    """(block, place, value) packed by block."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(parts):
            blocks, places, values = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((places, blocks))
            starts = np.flatnonzero(np.r_[True, np.diff(blocks[order]) != 0])
            rows = [(int(blocks[p[0]]), pack(places[p].astype(np.uint32)), values[p].tobytes()) for p in np.split(order, starts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "places", "vals"])

        parts, size = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append([batch.column(i).to_numpy() for i in range(3)])
                size += batch.num_rows
            if size >= SEND_ROWS:
                yield send(parts)
                parts, size = [], 0
        if parts:
            yield send(parts)

    return values.select("block", "place", "value").mapInArrow(gather, "block long, places binary, vals binary")


def score(docs: DataFrame, taught_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row, learning from rows whose ``taught_col`` is true."""
    blocks = materialize_bucketed(_blocks(docs, id_col, text_col, taught_col), "ppm_blocks", "block")
    items = blocks.select("block", F.expr("posexplode(arrays_zip(items, counts)) AS (place, z)")).select(F.col("z.items").alias("item"), F.col("z.counts").alias("n"), "block", "place")
    totals = materialize(items.select("item", "n").groupBy("item").agg(F.sum("n").alias("n")), "ppm_totals")
    learnt = totals.where("item < 0 AND n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.count("*").alias("kinds")).first()
    all_, kinds = learnt["all"], learnt["kinds"]
    low = np.zeros((1 << BITS, SYMBOLS), np.int64)
    last, mask = F.shiftright("item", BITS * ORDER), F.col("item").bitwiseAND((1 << BITS) - 1)
    for row in totals.where("item >= 0 AND n > 0").groupBy(last.alias("x"), mask.alias("s")).agg(F.sum("n").alias("n")).collect():  # at most 258 x 257 rows
        low[row["x"], row["s"]] = row["n"]

    values = materialize(_lengths(totals, low), "ppm_lengths").union(totals.where("item < 0").select("item", F.col("n").cast("double")))
    sent = _send(items.select("item", "block", "place").join(values.hint("merge"), "item"))
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t in (
        ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())))])

    def add_up(block: pa.Table, sent: pa.Table) -> pa.Table:
        items = block.column("items").combine_chunks().flatten().to_numpy()
        values = np.zeros(len(items))
        for places, vals in zip(sent.column("places"), sent.column("vals"), strict=True):
            values[unpack(places.as_py())] = np.frombuffer(vals.as_py())
        whole = zstandard.decompress(block.column("texts")[0].as_py())
        ends = np.cumsum(block.column("sizes").combine_chunks().flatten().to_numpy()).tolist()
        texts = [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        tokens, known, base, model = np.zeros((4, len(texts)))
        hasher = Hasher()
        for first, some in _chunks(texts):
            own = slice(first, first + len(some))
            coded, of = pairs(some)
            distinct, place = np.unique(coded, return_inverse=True)
            model[own] = np.bincount(of, values[np.searchsorted(items, distinct)][place], len(some))
            found, of = words(some, hasher)
            distinct, place = np.unique(found, return_inverse=True)
            counts = values[np.searchsorted(items, distinct)]
            tokens[own] = np.bincount(of, minlength=len(some))
            known[own] = np.bincount(of, (counts > 0)[place], len(some))
            base[own] = np.bincount(of, np.log10((counts + 1) / (all_ + kinds + 1))[place], len(some))
        return pa.table({id_col: block.column("doc_ids").combine_chunks().flatten(), "n_tokens": tokens.astype(np.int64), "n_known": known.astype(np.int64),
                         "train_tokens": np.full(len(texts), all_, np.int64), "base_score": base, "score": model})

    return blocks.select("block", "doc_ids", "sizes", "texts", "items").groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(add_up, out)
