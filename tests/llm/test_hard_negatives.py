import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulesift.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score long, row string"
NAN, INF = float("nan"), float("inf")


def brute(rows, positives=5, negatives=10):
    """Every anchor's hard negatives by all its scores."""
    own = []
    for i, v, label in rows:
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v):
            own.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    for k, (i, u, label) in enumerate(own):
        if i % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(u, v)), j, other) for n, (j, v, other) in enumerate(own) if n != k]
        for p, j, _ in sorted(x for x in scores if x[2] == label)[:positives]:
            hard = sorted(x for x in scores if x[2] != label and 30 * -p <= 100 * -x[0] <= 90 * -p)[:negatives]
            out += [(i, j, r, n, -p, -s) for r, (s, n, _) in enumerate(hard, 1)]
    return sorted(out)


def run(spark, rows, **options):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, H.mine(table, F.col("vec_id") % 100 == 0, **options).collect()))


def vectors(rng, n, dim=8, near=0.4):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, near) for c in rng.choice(centres)], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, parts and steps
        for name, value in (("BLOCK_ROWS", 16), ("PART_ANCHORS", 2), ("STEP", 5), ("MEMBERS", 1), ("SEED", 3), ("KEPT", 30)):
            monkeypatch.setattr(H, name, value)
    rows = vectors(random.Random(4), 900)
    assert run(spark, rows) == brute(rows) != []
    assert run(spark, rows, positives=2, negatives=3) == brute(rows, 2, 3)


def test_edges(spark):
    rng = random.Random(6)
    rows = vectors(rng, 240, near=0.0)  # six vectors only: ties everywhere
    rows += [rows[100], rows[100], rows[7], (200, [0.0] * 8, 1), (301, [0.0] * 8, 0), (300, [0.5], 2), (400, [], 0), (401, [1.0, -1.0], 2)]
    rows += [(500, None, 1), (600, [1.0, None], 1), (700, [1.0, NAN], 1), (800, [INF] * 8, 1), (900, [1.0] * 8, None), (None, [1.0] * 8, 1), (1000, [-1.0] * 8, 9), (1100, [-1.0] * 8, 9), (1200, [1e-9] * 8, 9)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows) != []
    assert run(spark, []) == [] and run(spark, [(1, [1.0], 0)]) == [] and run(spark, [(100, [1.0], 0)]) == [] and run(spark, [(100, None, 0)]) == []


def test_large_components(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-2e6, 2e6) for _ in range(4)], i % 2) for i in range(120)]  # scores beyond 2 ** 53
    assert run(spark, rows) == brute(rows) != []
    with pytest.raises(Exception, match="do not fit 64 bits"):
        run(spark, [(100, [1e12], 0), (101, [1e12], 1)])


def test_walks_end_early_and_lose_nothing():
    rng = np.random.default_rng(3)
    n, dim = 4000, 16
    centres = np.linalg.qr(rng.normal(size=(dim, 8)))[0].T
    x = np.floor(256 * (centres[rng.integers(0, 8, n)] + 0.01 * rng.normal(size=(n, dim))))
    labels = rng.integers(0, 4, n)
    ids = np.arange(n)
    rows = [type("Row", (dict,), {"__getattr__": dict.__getitem__})(row=int(i), id=int(i), label=int(labels[i]), v=x[i].tolist()) for i in range(0, n, 100)]
    fitted = H.fit(np.array([r.v for r in rows]), 8)
    spread = np.zeros(len(fitted))
    _, angles = H._angles(np.array([r.v for r in rows]), fitted)
    np.maximum.at(spread, angles.argmin(axis=1), angles.min(axis=1))
    anchors = H.Anchors.of(rows, fitted, spread)
    norms, angles = H._angles(x, fitted)
    bounds = (norms[:, None] * np.cos(np.maximum(0, angles - spread - H.SLACK))).T
    orders = np.argsort(-bounds, axis=1, kind="stable")
    walker = H.Walker(anchors, np.full((len(rows), 1), H.LEAST), np.full((len(rows), 1), H.MOST), True, 5)
    walker.walk(ids, ids, labels, x, orders, np.take_along_axis(bounds, orders, axis=1))
    assert walker.scored < 0.5 * n * len(rows)
    got = list(zip(*(v.tolist() for v in walker.ranked())))
    want = []
    for a, r in enumerate(rows):
        scores = (x @ np.array(r.v)).astype(int)
        best = sorted((-scores[i], i) for i in ids if labels[i] == r.label and i != r.id)[:5]
        want += [(a, 0, i, -s) for s, i in best]
    assert got == want
