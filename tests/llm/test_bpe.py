import base64
import hashlib

import tiktoken

from rulesift.llm import bpe, queries


def coder(vocabulary):
    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks(), special_tokens={})


def test_ids_and_round_trip(spark):
    texts = [None, "", " ", "\n\n  x", "It's 12 o'clock,  naïve – 東京 🙂\t\r\n", "a" * 3000, "the the the", "the the the",
             "<|endoftext|> </s>", "x" + "  y" * 50, " ".join(f"w{i % 700}é" for i in range(40000))]
    rows = [(i % 9, t, "word") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string").repartition(3)
    v = bpe.public_vocabulary()
    got = sorted((r.doc_id, list(r.ids), bytes(r.decoded)) for r in bpe.decode(bpe.encode(docs, v), v).collect())
    want = sorted((i, coder(v).encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    assert got == want


def test_small_blocks_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 64)
    monkeypatch.setattr(bpe, "SEND_WORDS", 3)
    v = bpe.public_vocabulary()
    docs = spark.createDataFrame([(i, f"some words {i} and more " * (i % 4)) for i in range(60)], "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(docs, v).collect()}
    assert got == {r.doc_id: coder(v).encode_ordinary(r.text) for r in docs.collect()}
    assert bpe.decode(bpe.encode(docs.where("false"), v), v).collect() == []


def test_vocabulary_and_query(spark):
    lines = b"".join(base64.b64encode(bytes([i])) + b" %d\n" % i for i in range(256))
    small = bpe.Vocabulary(lines, r"\S+|\s+")
    docs = spark.createDataFrame([(1, "é b")], "doc_id long, text string")
    assert list(bpe.encode(docs, small).first().ids) == list("é b".encode())
    sf = "/root/testdata/sf0.001"
    v = bpe.public_vocabulary()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = coder(v).encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in queries.op2_bpe(spark, sf).collect()} == want
