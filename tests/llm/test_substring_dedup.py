import random
import re

import duckdb
import pytest

from rulesift.llm import queries, substring_dedup as S

VOCABULARY = [a + b + c for a in ("th", "on", "é", "re", "in", "zu") for b in ("an", "er", "ti", "ou") for c in ("", "ing", "s", "en", "heit")]


def passage(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def test_planted_passages(spark):
    rng = random.Random(8)
    long, short = [passage(rng, 55) for _ in range(40)], [passage(rng, 45) for _ in range(40)]
    docs, where = [], {}
    for p in (*long, *short):
        for _ in range(3):
            where.setdefault(p, []).append(len(docs))
            docs.append((len(docs), passage(rng, rng.randrange(20, 200)) + "\n" + p + "\n" + passage(rng, rng.randrange(20, 200))))
    clean = [(1000 + i, passage(rng, 300)) for i in range(30)]
    copies = [(2000, docs[0][1]), (2001, docs[0][1])]
    table = spark.createDataFrame([(i, t, 5, "x") for i, t in docs + clean + copies], "doc_id long, text string, start int, digest string").repartition(5)
    spans = S.repeats(table).collect()
    found = {r.doc_id for r in spans}
    want = {i for p in long for i in where[p][1:]}
    assert found - {2000, 2001} <= want and len(want - found) <= 2 and {2000, 2001} <= found
    texts = dict(docs + copies)
    for r in spans:
        assert r.source < r.doc_id and r.n_words >= S.MIN_WORDS
        assert texts[r.doc_id].encode()[r.start:r.end] in texts[r.source].encode()
    kept = {r.doc_id: r.text for r in S.remove(table, S.repeats(table)).collect()}
    assert len(kept) == table.count() and all(kept[i] == t for i, t in clean)
    for p in long:
        assert p in kept[where[p][0]]
        for i in where[p][1:]:
            assert i not in found or len(kept[i].split()) <= len(texts[i].split()) - 45


def test_edges(spark):
    rng = random.Random(9)
    big = passage(rng, 30000)
    rows = [(1, None), (2, ""), (3, "x" * 9000), (4, "one two"), (4, "one two"), (5, big), (5, big), (None, big), (6, "changed " + big[:90000] + " here too " + big[90000:])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.repeats(table).collect()
    assert {r.doc_id for r in got} == {6} and sum(r.n_words for r in got) > 29000
    assert S.repeats(table.where("false")).collect() == []
    assert [r.text for r in S.remove(table, S.repeats(table)).where("doc_id = 5").collect()] == [big, big]


def test_cuts_come_back_after_an_insertion():
    rng = random.Random(1)
    text = passage(rng, 3000).encode()
    cuts = S.cuts(text).tolist()
    moved = S.cuts(text[:5000] + b"shifted" + text[5000:]).tolist()
    back = {c if c < 5000 else c - 7 for c in moved}
    assert len(back & set(cuts)) > 0.98 * len(moved) and S.cuts(b"").tolist() == [] == S.cuts(b"one two").tolist()
    chunks = [text[x:y].split() for x, y in zip(cuts, cuts[1:])]
    assert max(map(len, chunks)) <= S.MOST and sum(map(len, chunks)) / len(chunks) > 8
    # any window holds a cut with the words after it that name the chunk, wherever it stands
    for k in range(0, 200, 7):
        part = b" ".join(text.split()[k:k + S.MIN_WORDS])
        starts, _ = S.word_bounds(part)
        (cut,) = S.cuts(part).tolist()
        assert cut + text.find(part) in cuts and len(part[cut:].split()) >= S.NAMED


def test_digests_at_some_words_equal_digests_of_their_bytes(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(["a", "bc", "é", "x" * 40, "0"]) + rng.choice([" ", "  ", "\n", "\t "]) for _ in range(900)).strip().encode()
    for block in (7, 1 << 16):
        monkeypatch.setattr(S, "BLOCK", block)
        starts, ends = S.word_bounds(text)
        for n in (1, 2, 25, 50):
            at = [rng.randrange(len(starts) - n + 1) for _ in range(200)] + [len(starts) - n]
            got = S.grams(text, starts, ends, n, S.np.array(at))
            by = {}
            for k, d in zip(at, got.tolist()):
                by.setdefault(text[starts[k]:ends[k + n - 1]], set()).add(d)
            assert all(len(x) == 1 for x in by.values()) and len({d for x in by.values() for d in x}) == len(by)


def test_query(spark):
    got = queries.op8_substring_dedup(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert got and all(r.first_doc_id <= r.doc_id and docs[r.doc_id][r.start_byte:r.end_byte] for r in got)
    first = {}
    for i in sorted(docs):
        if docs[i] in first and len(docs[i].split()) > 2 * S.MIN_WORDS:
            assert any(r.doc_id == i for r in got)
        first.setdefault(docs[i], i)


def windows(text):
    """(start, end, bytes) of every window of MIN_WORDS words."""
    at = [m.span() for m in re.finditer(rb"[^ \t\n\v\f\r]+", text)]
    return [(a, b, text[a:b]) for (a, _), (_, b) in zip(at, at[S.MIN_WORDS - 1:])]


def check_against_windows(docs, spans):
    """Spans are equal in their source, and cover just what windows seen earlier cover."""
    for r in spans:
        part = docs[r.doc_id][r.start:r.end]
        assert len(part.split()) == r.n_words >= S.MIN_WORDS
        assert part in docs[r.source] if r.source < r.doc_id else r.source == r.doc_id and docs[r.doc_id].find(part) < r.start
    seen, want = set(), {}
    for i in sorted(docs):
        for a, b, w in windows(docs[i]):
            if w in seen:
                want.setdefault(i, set()).update(range(a, b))
            seen.add(w)
    got = {}
    for r in spans:
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    assert got == want
    return want


@pytest.mark.parametrize("hot", [S.HOT, 2])
def test_parts_first_seen_in_other_documents(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)  # windows that are sorted together, or joined
    rng = random.Random(12)
    docs, whole = [], set()
    for _ in range(40):
        p = passage(rng, 84).split(" ")
        for part in (p[:42], p[42:], p[20:64], p, p):
            docs.append(" ".join([passage(rng, rng.randrange(5, 90)), *part, passage(rng, rng.randrange(5, 90))]))
        whole.add(len(docs) - 1)
    spans = S.repeats(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)).collect()
    assert set(check_against_windows({i: t.encode() for i, t in enumerate(docs)}, spans)) == whole


def test_all_windows_seen_earlier(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert len(check_against_windows(texts, S.repeats(docs).collect())) > 20
    turns = "one two three four five six seven " * 40
    assert check_against_windows({1: turns.encode()}, S.repeats(spark.createDataFrame([(1, turns)], "doc_id long, text string")).collect())


def test_query_equals_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        want = con.sql(queries.LLM_ORACLE["op8_substring_dedup"])
        assert sorted(map(tuple, queries.op8_substring_dedup(spark, sf).select(*want.columns).collect())) == sorted(want.fetchall())
