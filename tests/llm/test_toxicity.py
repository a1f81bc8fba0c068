import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from rulesift.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op3_toxicity(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()
    assert sorted(got) == sorted(r.doc_id for r in docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    toxic = [got[i].score for i, t in labels if t == 1]
    clean = [got[i].score for i, t in labels if t == 0]
    auc = np.mean([(a > np.array(clean)).mean() + 0.5 * (a == np.array(clean)).mean() for a in toxic])
    assert auc > 0.95 and np.mean(np.array(toxic) >= 0.5) > 0.85 and np.mean(np.array(clean) >= 0.5) < 0.08


def test_nulls_empty_and_one_class(spark):
    rows = [(1, None, 1, "w"), (2, "", 0, "w"), (3, "ab", None, "w"), (3, "ab", None, "w"), (None, "xyz " * 20000, 0, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, weights string")
    model = toxicity.train(docs)
    scores = toxicity.score(docs, model).collect()
    assert len(scores) == 5 and all(0 < r.score < 1 for r in scores)
    assert toxicity.train(docs.where("toxic IS NULL")).score("x") == pytest.approx(0.5)
    assert toxicity.train(docs.where("toxic = 0")).score("x") < 0.5
    assert toxicity.score(docs.where("false"), model).collect() == []


def test_features_follow_the_text():
    a = toxicity.buckets("Straße 🙂 naïve")
    assert (a == toxicity.buckets("STRAßE 🙂 NAÏVE")).all() and 0 <= a.min() and a.max() < toxicity.BUCKETS
    assert len(toxicity.buckets("ab")) == 0 and len(toxicity.buckets("abcd")) == 3
    assert set(toxicity.buckets("abc")) <= set(toxicity.buckets("xxabcxx"))


def plain_grams(text):
    """Distinct buckets of the text's character n-grams, one n-gram at a time."""
    text = (text or "").lower()
    return {int(toxicity.buckets(text[i:i + n])[-1]) for n in toxicity.SIZES for i in range(len(text) - n + 1)}


def test_against_a_plain_model(spark):
    """Counts, ratios, weights and scores by dictionaries and loops."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(160):
        toxic = k % 4 == 0
        rows.append((k, " ".join([*rng.choices(words, k=rng.randrange(3, 30)), *(["Vile", "insult"] if toxic and k % 8 == 0 else ["nasty"] if toxic else ["kind"] if k % 3 else [])]), int(toxic)))
    rows += [(900, None, 0), (901, "", 1), (902, "vile", None), (903, "kind", 2)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5))

    learnt = [(plain_grams(t), y) for _, t, y in rows if y in (0, 1)]
    texts = [sum(y == c for _, y in learnt) for c in (0, 1)]
    held = [Counter(b for g, y in learnt if y == c for b in g) for c in (0, 1)]
    ratio = {}
    for b in {*held[0], *held[1]}:
        r = math.log((held[1][b] + 1) / (texts[1] + 2)) - math.log((held[0][b] + 1) / (texts[0] + 2))
        if abs(r) >= max(toxicity.MIN_RATIO, toxicity.SURE * math.sqrt(1 / (held[1][b] + 1) + 1 / (held[0][b] + 1))):
            ratio[b] = r
    assert ratio and len(ratio) < len({*held[0], *held[1]})
    found = [([b for b in g if b in ratio], y) for g, y in learnt]
    used = sorted({b for g, _ in found for b in g})
    w, bias = dict.fromkeys(used, 0.1), -2.0
    share = {1: 0.5 / max(1, texts[1]), 0: 0.5 / max(1, texts[0])}
    m, v = dict.fromkeys([*used, None], 0.0), dict.fromkeys([*used, None], 0.0)
    for step in range(1, toxicity.STEPS + 1):
        g = {b: toxicity.PULL * (w[b] - 0.1) / max(1, len(used)) ** 0.5 for b in used} | {None: 0.0}
        for grams, y in found:
            error = share[y] * (1 / (1 + math.exp(-(bias + sum(ratio[b] * w[b] for b in grams)))) - y)
            g[None] += error
            for b in grams:
                g[b] += ratio[b] * error
        for b in g:
            m[b], v[b] = 0.9 * m[b] + 0.1 * g[b], 0.99 * v[b] + 0.01 * g[b] ** 2
            move = 0.05 * (m[b] / (1 - 0.9**step)) / (math.sqrt(v[b] / (1 - 0.99**step)) + 1e-9)
            if b is None:
                bias -= move
            else:
                w[b] = max(w[b] - move, 0)
    assert model.bias == pytest.approx(bias, abs=1e-6)
    assert {b: model.weights[b] for b in used} == pytest.approx({b: w[b] * ratio[b] for b in used}, abs=1e-6) and (model.weights != 0).sum() <= len(used)
    docs = [(1, "a VILE insult w3"), (2, "kind w4 w5"), (3, None), (4, "ab"), (5, "nasty " * 50)]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    want = {i: 1 / (1 + math.exp(-(bias + sum(w[b] * ratio[b] for b in plain_grams(t) if b in w)))) for i, t in docs}
    assert got == pytest.approx(want, abs=1e-6) and got[1] > 0.5 > got[2]
