import random
from itertools import combinations

import duckdb

from rulesift.llm import decontaminate, queries


def test_query_equals_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        got = queries.op5_decontaminate(spark, sf)
        want = con.sql(queries.LLM_ORACLE["op5_decontaminate"])
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
        assert got.count() > 0


def test_substitutions_and_edges(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: text(n) for i, n in enumerate((5, 6, 8, 15, 20, 40, 60))}
    docs, want = [], set()
    for i, item in items.items():
        docs.append((10 * i, " ".join(text(30) + item + text(30))))
        want.add((10 * i, i))
        if len(item) >= 5:
            every5 = [w if k % 5 != 4 else "changed" for k, w in enumerate(item)]
            docs.append((10 * i + 1, " ".join(text(9) + every5).upper()))  # exactly 80 % stay
            want.add((10 * i + 1, i))
        if len(item) >= 15:
            inserted = item[:7] + ["put", "in"] + item[7:]
            docs.append((10 * i + 2, "\n".join(inserted)))
            want.add((10 * i + 2, i))
            docs.append((10 * i + 3, " ".join(text(10) + item[: int(0.79 * len(item))] + text(10))))
    docs += [(900, None), (901, ""), (902, " ".join(text(20000))), (903, "v1 v2"), (904, "some Two  words here"), (905, "two more words"), (None, " ".join(items[4])), (40, docs[0][1])]
    want |= {(None, 4), (40, 0), (904, 52)}
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, seed string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w), 0) for i, w in items.items()] + [(50, None, 0), (51, "", 0), (52, "two words", 0), (0, " ".join(items[0]), 0)], "item_id long, text string, doc_id int")
    pairs = lambda df: {(r.doc_id, r.item_id) for r in df.collect()}
    assert pairs(decontaminate.overlaps(table, bench)) == want
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", 0)
    assert pairs(decontaminate.overlaps(table, bench)) == want
    assert pairs(decontaminate.overlaps(table.where("false"), bench)) == set() == pairs(decontaminate.overlaps(table, bench.where("false")))


def test_every_allowed_pattern_is_hit():
    for n in range(1, 21):
        masks, most = decontaminate.masks_of(n), n * (100 - decontaminate.PERCENT) // 100
        assert all(any(decontaminate.hits(m, n, set(p)) for m in masks) for p in combinations(range(n), most)), n
    assert decontaminate.masks_of(13) == decontaminate.masks_of(500) == decontaminate.MASKS


def test_replaced_words_of_short_items(spark):
    """Every allowed pattern is found, one word more is not, and no item changes another's result."""
    items = {n: [f"w{n}x{k}" for k in range(n)] for n in (1, 2, 4, 5, 6, 7, 9, 10, 11, 12, 14)}
    docs, want = [], set()
    for n, item in items.items():
        most = n * (100 - decontaminate.PERCENT) // 100
        for p in combinations(range(n), most):
            want.add((len(docs), n))
            docs.append(" ".join(["before", *(w if k not in p else "other" for k, w in enumerate(item)), "after"]))
        for p in list(combinations(range(n), most + 1))[:40]:
            docs.append(" ".join(w if k not in p else "other" for k, w in enumerate(item)))
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    pairs = lambda b: {(r.doc_id, r.item_id) for r in decontaminate.overlaps(table, b).collect()}
    assert pairs(bench) == want
    for n in (1, 5, 10, 14):
        assert pairs(bench.where(f"item_id = {n}")) == {x for x in want if x[1] == n}
