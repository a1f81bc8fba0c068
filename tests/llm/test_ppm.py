import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rulesift.llm import ppm, queries


class Brute:
    """PPM with escape method D and exclusion, symbol by symbol."""

    def __init__(self, texts):
        self.tables = {}
        for text in texts:
            for context, symbol in self.steps(text):
                for k in range(ppm.ORDER + 1):
                    self.tables.setdefault(context[:k], Counter())[symbol] += 1

    @staticmethod
    def steps(text):
        seen = [ppm.START] * ppm.ORDER
        for symbol in [*text, ppm.END]:
            yield tuple(reversed(seen[-ppm.ORDER:])), symbol
            seen.append(symbol)

    def p(self, context, symbol):
        p, excluded = 1.0, set()
        for k in range(ppm.ORDER, -1, -1):
            table = {s: n for s, n in self.tables.get(context[:k], {}).items() if s not in excluded}
            if not table:
                continue
            escape = len(table) / 2 if len(self.tables[context[:k]]) < ppm.SYMBOLS else 0
            total = sum(n - 0.5 for n in table.values()) + escape
            if symbol in table:
                return p * (table[symbol] - 0.5) / total
            p *= escape / total
            excluded |= set(table)
        return p / (ppm.SYMBOLS - len(excluded))

    def score(self, text):
        return sum(math.log10(self.p(*x)) for x in self.steps(text))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base(rows):
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for i, t, _ in rows}
    c = Counter(w for i, _, taught in rows if taught for w in tokens[i])
    n, v = sum(c.values()), len(c)
    return {i: (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, w in tokens.items()}


def check(got, rows):
    model = Brute([lower(t).encode() for _, t, taught in rows if taught])
    want = base(rows)
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)
        assert r.score == pytest.approx(model.score(lower(text).encode()), rel=1e-9)


def test_against_brute_force(spark, monkeypatch):
    texts = [None, "", "a", "Abracadabra abracadabra", "the cat sat on the mat\nthe end", "zebra the cat", "ÉÜ 日本 🙂 the", "aaaa" * 300, "   \t", "mat cat"] + [f"line {i} of {i * i} words" for i in range(40)]
    rows = [(i, t, i % 7 != 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, taught boolean, block int").repartition(3)
    check(ppm.score(docs, "taught").collect(), rows)
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 100)
    monkeypatch.setattr(ppm, "CHUNK", 40)
    monkeypatch.setattr(ppm, "SEND_ROWS", 50)
    check(ppm.score(docs, "taught").collect(), rows)
    untaught = [(i, t, False) for i, t, _ in rows]
    check(ppm.score(spark.createDataFrame(untaught, "doc_id long, text string, taught boolean"), "taught").collect(), untaught)
    assert ppm.score(docs.where("false"), "taught").collect() == []


def test_query_and_held_out_texts(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op10_ppm(spark, sf).collect()
    want = base(rows)
    assert {r.doc_id: r.held_out for r in got} == {i: not t for i, _, t in rows}
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.base_score == pytest.approx(want[r.doc_id][3])
    per_char = [r.score / len(next(t for i, t, _ in rows if i == r.doc_id)) for r in got if r.held_out and r.n_tokens > 20]
    assert -0.85 < np.mean(per_char) < -0.5  # bytes alone would take -2.4


def test_lengths_are_a_distribution():
    model = Brute([b"abracadabra", b"abc"])
    for context in ((97, 98, 99, 97), (ppm.START,) * 4, (1, 2, 3, 4), (97, 114, 98, 97)):
        assert sum(model.p(context, s) for s in range(ppm.SYMBOLS)) == pytest.approx(1)
