import random
import re

import duckdb
import numpy as np
import pytest

from rulesift.llm import graph, ngram_join, queries
from rulesift.llm.shingles import Hasher


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(rows):
    """{id: (set size, component)} by all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(i, j) for held in by.values() for i in held for j in held if i < j}
    for i, j in pairs:
        shared = len(sets[i] & sets[j])
        if 100 * shared >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_table_equals_brute_force(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
        assert result(queries.op4_ngram_join(spark, sf)) == brute(rows)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(queries.LLM_ORACLE["op4_ngram_join"])
    assert sorted(map(tuple, queries.op4_ngram_join(spark, sf).select(*want.columns).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("hot, split", [(ngram_join.HOT, ngram_join.SPLIT), (5, 3)])
def test_chains_hot_groups_and_edges(spark, monkeypatch, hot, split):
    monkeypatch.setattr(ngram_join, "HOT", hot)  # shingles and classes dealt over parts
    monkeypatch.setattr(ngram_join, "SPLIT", split)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choice(words) for _ in range(80)]
    common = " ".join(rng.choice(words) for _ in range(30))
    for _ in range(60):  # a drifting chain: neighbours link, ends do not
        base[rng.randrange(len(base))] = rng.choice(words)
        rows.append(" ".join(base))
    for _ in range(150):  # near copies of one text, and texts that only share a passage
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append(" ".join(copy))
        rows.append(common + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(5, 40))))
    rows += ["One two", "one TWO", "one", "", None, " \t\n", "É b c d e f", "é b c d e f", "a b c d e", "a\tb\x0bc d e"] + [rows[3]] * 40
    rng.shuffle(rows)
    rows = list(enumerate(rows, 7))
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, a int, shingle string").repartition(6)
    assert result(ngram_join.link(docs)) == brute(rows)
    more = docs.union(spark.createDataFrame([(None, "one two", 1, "x"), (rows[0][0], rows[0][1], 1, "x")], docs.schema))
    got = ngram_join.link(more).collect()
    assert len(got) == len(rows) + 2 and [tuple(r) for r in got if r.doc_id is None] == [(None, 1, None)]
    assert ngram_join.link(docs.where("false")).collect() == []


def test_prefix_and_hashes():
    counts = np.zeros(ngram_join.COUNTERS, np.uint32)
    s = np.sort(np.random.default_rng(1).integers(0, 2**63, 100, dtype=np.uint64))
    counts[ngram_join._slot(s[:20])] = 100_000
    first, matches, _, held = ngram_join.prefix(s, counts, 0.0)
    assert len(held) == len(first) and held.max() < 100_000
    assert len(first) == 20 + matches and not set(first.tolist()) & set(s[:20].tolist())
    frequent = np.full(ngram_join.COUNTERS, 1000, np.uint32)
    assert ngram_join.prefix(s, frequent, 0.0)[1] == ngram_join.MOST_MATCHES
    h = Hasher()
    a, b, c, d = h.sets(["x Y z", "X y  Z", "x yz", None])
    assert a.tolist() == b.tolist() != c.tolist() and len(d) == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    assert got == {x: label[x] for u, v in edges if u != v for x in (u, v)}
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []
