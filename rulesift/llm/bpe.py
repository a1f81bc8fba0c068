"""Byte-level BPE encoding and decoding over a global distinct-word shuffle.

Encoding, in steps that Spark partitions:

1. *Explode pre-tokens with positions.*  Tasks cut whole texts into pre-tokens
   and pack them by block (a run of documents of about ``BLOCK_BYTES`` of text):
   the block's distinct words, and one number per position naming its word.
   That is a map-side combine, so a frequent word leaves a block once.  Blocks
   are written once, bucketed by block id, to the shared scratch folder.
2. *Encode each distinct word once.*  (word, block) pairs are shuffled and
   sorted by word; a task merges each distinct word's bytes once and sends the
   ids to every block that asked for it.  No word has more rows than there are
   blocks, and a task holds one word at a time.
3. *Join ids back, reassemble by position.*  The ids meet their block by block
   id (the bucketed blocks do not move) and replace the numbers in order.

Decoding joins the token-byte table: it has at most one row per vocabulary
entry (checked, ``MAX_VOCABULARY``), so tasks receive it whole and gather the
bytes of a batch of ids by position.

Defined cases: null text is the empty text and gives no ids; repeated rows give
repeated results, rows without an id too; a text of megabytes is a block of its own; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulesift.llm.workers import frugal, give_back
from rulesift.session import materialize_bucketed

BLOCK_BYTES = 24 << 20
MAX_VOCABULARY = 1 << 20
#: Words whose ids a task gathers before it sends them to their blocks.
SEND_WORDS = 1 << 18
#: Rows, and bytes of text, that are decoded at once (a longer text alone).
DECODE_BYTES = 64 << 20
DECODE_ROWS = 512


class Vocabulary:
    """A rank file: lines of a base64 token and its rank, and the split pattern."""

    def __init__(self, rank_lines: bytes, pattern: str):
        self.rank_lines, self.pattern = rank_lines, pattern
        if rank_lines.count(b"\n") > MAX_VOCABULARY:
            raise ValueError(f"more than {MAX_VOCABULARY} tokens")

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, self.rank_lines.splitlines())}


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> Vocabulary:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return Vocabulary(f.read(), public_tokenizers.PATTERN)


class _Numbering(dict):
    """Numbers keys in the order in which they are first seen."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _pack(numbers: np.ndarray) -> bytes:
    """uint32 numbers by byte plane, compressed: small numbers are frequent."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _blocks(docs: DataFrame, pattern: str, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """One row per block: id values, numbers per document, packed numbers, words."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_type)),
        T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("numbers", T.BinaryType()),
        T.StructField("words", T.ArrayType(T.StringType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import array

        import regex

        find = regex.compile(pattern).findall
        base, made = TaskContext.get().partitionId() << 32, 0

        def block(ids, lengths, numbers, numbering, id_type):
            flat = np.frombuffer(numbers, np.uint32)
            words = list(numbering)
            order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            renumber = np.empty(len(words), np.uint32)
            renumber[order] = np.arange(len(words), dtype=np.uint32)
            return pa.RecordBatch.from_arrays([
                pa.array([base + made], pa.int64()), pa.array([ids], pa.list_(id_type)),
                pa.array([lengths], pa.list_(pa.int32())), pa.array([_pack(renumber[flat])], pa.binary()),
                pa.array([[words[i] for i in order.tolist()]], pa.list_(pa.string()))],
                names=["block", "doc_ids", "lengths", "numbers", "words"])

        ids, lengths, numbers, numbering, size, kind = [], [], array.array("I"), _Numbering(), 0, None
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                before = len(numbers)
                numbers.extend(map(numbering.__getitem__, find(text)))
                ids.append(doc_id.as_py())
                lengths.append(len(numbers) - before)
                size += len(text) + 16
                if size >= block_bytes:
                    yield block(ids, lengths, numbers, numbering, kind)
                    made += 1
                    ids, lengths, numbers, numbering, size = [], [], array.array("I"), _Numbering(), 0
        if ids:
            yield block(ids, lengths, numbers, numbering, kind)

    return docs.select(id_col, text_col).mapInArrow(frugal(cut), schema)


def _word_ids(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(word, block, number) to packed (block, numbers, sizes, ids); each distinct word is merged once."""
    shared = words.sparkSession.sparkContext.broadcast(vocabulary.ranks())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=shared.value, special_tokens={})
        last, ids = None, b""

        def send(blocks, numbers, tokens):
            blocks, numbers = np.concatenate(blocks), np.concatenate(numbers)
            order = np.lexsort((numbers, blocks))
            starts = np.flatnonzero(np.r_[True, np.diff(blocks[order]) != 0])
            rows = []
            for part in np.split(order, starts[1:]):
                own = [tokens[i] for i in part.tolist()]
                sizes = np.fromiter(map(len, own), np.uint32, len(own)) // 4
                rows.append((int(blocks[part[0]]), _pack(numbers[part]), _pack(sizes), _pack(np.frombuffer(b"".join(own), "<u4"))))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "numbers", "sizes", "ids"])

        blocks, numbers, tokens = [], [], []
        for batch in batches:
            for word in batch.column(0).to_pylist():
                if word != last:
                    last, ids = word, np.array(coder.encode_ordinary(word), "<u4").tobytes()
                tokens.append(ids)
            blocks.append(batch.column(1).to_numpy())
            numbers.append(batch.column(2).to_numpy().astype(np.uint32))
            if len(tokens) >= SEND_WORDS:
                yield send(blocks, numbers, tokens)
                blocks, numbers, tokens = [], [], []
        if tokens:
            yield send(blocks, numbers, tokens)

    return words.mapInArrow(frugal(merge), "block long, numbers binary, sizes binary, ids binary")


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs values[start:start + size], one after another (some runs at a time: indices are wide)."""
    out, at = np.empty(int(sizes.sum(dtype=np.int64)), values.dtype), 0
    for k in range(0, len(sizes), 1 << 17):
        start, size = starts[k:k + (1 << 17)].astype(np.int64), sizes[k:k + (1 << 17)].astype(np.int64)
        ends = np.cumsum(size)
        if n := int(ends[-1]):
            out[at:at + n] = values[np.repeat(start - (ends - size), size) + np.arange(n)]
            at += n
    return out


def _ends(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Offsets of runs of ``counts`` items whose items have these sizes."""
    ends = np.cumsum(sizes, dtype=np.int64)
    upto = np.cumsum(counts)
    return np.concatenate([[0], np.where(upto > 0, ends[upto - 1], 0) if len(ends) else np.zeros(len(counts))]).astype(np.int32)


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, ``ids`` array<int>) of every row: the token ids of its whole text.  Larger blocks
    shuffle fewer rows, a task holds several times ``block_bytes``."""
    blocks = materialize_bucketed(_blocks(docs, vocabulary.pattern, id_col, text_col, block_bytes), "bpe_blocks", "block")
    pairs = blocks.select("block", F.posexplode("words").alias("number", "word")).select("word", "block", "number")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = _word_ids(pairs.repartition(n, "word").sortWithinPartitions("word"), vocabulary)
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def reassemble(block: pa.Table, sent: pa.Table) -> pa.Table:
        give_back()  # of the block before
        own = lambda name: np.concatenate([np.zeros(0, np.uint32), *(_unpack(x.as_py()) for x in sent.column(name))])
        numbers, sizes, ids = own("numbers"), own("sizes").astype(np.int32), own("ids").astype(np.int32)
        start_of, size_of = np.zeros((2, len(numbers)), np.int32)
        start_of[numbers], size_of[numbers] = np.cumsum(sizes, dtype=np.int32) - sizes, sizes
        wanted = _unpack(block.column("numbers")[0].as_py())
        sizes = size_of[wanted]
        flat = _gather(ids, start_of[wanted], sizes)
        offsets = _ends(sizes, block.column("lengths").combine_chunks().flatten().to_numpy())
        return pa.table({id_col: block.column("doc_ids").combine_chunks().flatten(),
                         "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))})

    return blocks.select("block", "doc_ids", "lengths", "numbers").groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(reassemble, out)


def decode(coded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``coded`` with the bytes of each row's ids in column ``to`` (binary; null ids give no bytes)."""
    ranks = vocabulary.ranks()
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = coded.sparkSession.sparkContext.broadcast(table)
    schema = T.StructType([*(f for f in coded.schema.fields if f.name != to), T.StructField(to, T.BinaryType())])
    position = coded.columns.index(ids_col)
    kept = [i for i, f in enumerate(coded.schema.fields) if f.name != to]

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.frombuffer(b"".join(shared.value), np.uint8)
        sizes = np.fromiter(map(len, shared.value), np.int32, len(shared.value))
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        def decoded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids = batch.column(position)
            flat = ids.flatten().to_numpy()
            counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
            size = sizes[flat]
            if batch.num_rows > 1 and size.sum(dtype=np.int64) > DECODE_BYTES:  # offsets are 32 bits wide
                half = batch.num_rows // 2
                yield from decoded(batch.slice(0, half))
                yield from decoded(batch.slice(half))
                return
            text, offsets = _gather(values, starts[flat], size), _ends(size, counts)
            made = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(text)])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), made], names=schema.fieldNames())

        for whole in batches:
            for first in range(0, whole.num_rows, DECODE_ROWS):
                yield from decoded(whole.slice(first, DECODE_ROWS))

    return coded.mapInArrow(frugal(join), schema)
