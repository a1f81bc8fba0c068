import math
import random
import re
from collections import Counter

import numpy as np

from rulesift.llm import ranked_search as S


def split(text):
    return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)})))


def brute(docs, queries, top):
    counts = [(i, split(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for q, text in queries:
        scores = []
        for i, c in counts:
            m = 25 + 75 * c.total() * n_docs // max(n_terms, 1)
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in split(text).items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def tables(spark, docs, queries):
    d = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, score long, item_id string")
    return d, spark.createDataFrame([(i, t, 1) for i, t in queries], "item_id long, text string, doc_id long")


def run(spark, docs, queries, top=10):
    return sorted(map(tuple, S.search(*tables(spark, docs, queries), top=top).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(rng, n):
    words = [*(f"w{k}" for k in range(40)), "é", "Éa", "naïve", "日本", "A1"]
    weights = [1 / (k + 1) for k in range(len(words))]
    return [(i, rng.choice([" ", "-", "\x00", "\n", "_"]).join(rng.choices(words, weights, k=rng.randrange(60)))) for i in range(n)]


def test_against_brute_force(spark):
    rng = random.Random(2)
    docs = corpus(rng, 700)
    docs += [(9000 + k, docs[11][1]) for k in range(15)]  # ties
    queries = [(k, t) for k, (_, t) in enumerate(corpus(rng, 25))]
    for top in (1, 10):
        assert run(spark, docs, queries, top) == brute(docs, queries, top)


def test_blocks_skip_and_lose_nothing():
    rng = np.random.default_rng(1)
    size, terms = 6000, 30
    own = [np.flatnonzero(rng.random(size) < share) for share in rng.choice([0.001, 0.004, 0.05, 0.5, 0.95], terms)]
    tfs = [rng.integers(1, 20, len(x)) for x in own]
    lengths = rng.integers(1, 400, size)
    row = {"terms": [t for t in range(terms) if len(own[t])], "df": [len(x) for x in own if len(x)], "lengths": lengths.astype("<i8").tobytes(),
           "docs": np.concatenate(own).astype("<i4").tobytes(), "tfs": np.concatenate(tfs).astype("<i4").tobytes()}
    n_docs, n_terms = 10 * size, 10 * int(lengths.sum())
    block = S.Block(row, n_docs, n_terms)
    for _ in range(60):
        query = [(int(t), int(rng.integers(0, 5000))) for t in rng.choice(terms, rng.integers(1, 12), replace=False)]
        want = np.zeros(size, np.int64)
        for t, factor in query:
            m = 25 + 75 * lengths[own[t]] * n_docs // n_terms
            want[own[t]] += factor * (10**9 * tfs[t] // (1000 * tfs[t] + 8 * m))
        for least in (1, int(np.sort(want)[-3]), int(want.max()), int(want.max()) + 1):
            least = max(least, 1)
            docs, scores = block.search(query, least, 10)
            assert (want[docs] == scores).all() and len(set(docs.tolist())) == len(docs) and (scores >= least).all()
            tenth = max(least, int(np.sort(want)[-10]))
            assert {int(d) for d in np.flatnonzero(want >= tenth)} <= set(docs.tolist())


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "--- \n"), (4, "alpha beta"), (4, "alpha beta"), (None, "alpha beta"), (5, "ALPHA gamma"), (6, "delta " * 200)]
    queries = [(1, "Alpha, alpha!"), (1, "Alpha, alpha!"), (2, None), (None, "delta"), (3, "nowhere"), (4, "")]
    assert run(spark, docs, queries) == brute(docs, queries, 10)
    assert run(spark, [], queries) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], queries) == []


def test_long_texts_and_parts_of_queries(spark, monkeypatch):
    long = " ".join(f"t{k % 5000}" for k in range(1_500_000)) + " needle"  # several chunks
    assert len(long) > 2 * S.CHUNK / 1.2 and S.terms(long.encode()) == Counter(x.encode() for x in long.split())
    assert S.terms(b"a" * (2 * S.CHUNK) + b" b") == Counter([b"a" * (2 * S.CHUNK), b"b"])
    docs = [(1, long), (2, "t1 needle t2"), (3, "t3")]
    queries = [(k, f"needle t{k} t{k + 1}") for k in range(8)]
    monkeypatch.setattr(S, "PART_BYTES", 40)
    assert run(spark, docs, queries) == brute(docs, queries, 10)
