import random

import duckdb

from rulesift.llm import line_dedup, queries


def distance(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    """Expected text of each (id, text), ids distinct."""
    seen, out = [], {}
    for i, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            if line.strip(" ") == "":
                kept.append(line)
                continue
            if not any(line == x or (min(len(line), len(x)) >= line_dedup.MIN_NEAR and distance(line, x) <= 1) for x in seen):
                kept.append(line)
            seen.append(line)
        out[i] = "\n".join(kept)
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    bases = ["".join(rng.choice("abé ") for _ in range(n)) for n in (5, 15, 16, 17, 18, 30, 31, 32, 70)]

    def edited():
        line = rng.choice(bases)
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            at, kind = rng.randrange(len(line) + 1), rng.randrange(3)
            line = line[:at] + (rng.choice("abé日") if kind else "") + line[at + (kind != 1):]
        return line

    rows = [(i, "\n".join(rng.choice([edited(), edited(), "", " "]) for _ in range(rng.randrange(1, 8)))) for i in range(90)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, `first.x` string").repartition(4)
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs.drop("first.x")).collect()}
    assert got == brute(rows)


def test_hot_group_and_edges(spark):
    rows = [(i, f"a common line number {i % 10}\nsame\n\n") for i in range(400)] + [(None, "same"), (None, "same"), (401, None), (402, ""), (403, "x" * 40000 + "\n" + "x" * 40001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup(docs, count_col="n").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [r.text for r in got if r.doc_id is None] == ["same", "same"]
    assert by[0].text == "a common line number 0\n\n" and all(by[i].text == "\n" for i in range(1, 400))
    assert by[401].text is None and by[402].text == "" and by[403].text == "x" * 40000
    assert tuple(by[0].n) == (2, 1) and tuple(by[401].n) == (0, 0)
    assert line_dedup.dedup(docs.where("false")).collect() == []


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.op6_line_dedup(spark, sf)
    want = con.sql(queries.LLM_ORACLE["op6_line_dedup"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
