import random

import pytest

from rulesift.llm import repetition as R

BLANKS = b" \t\n\x0b\x0c\r"


def brute(text):
    """The measures of one text, window by window."""
    data = (text or "").encode()
    words = [w.decode() for w in data.split()]
    size = [len(w) for w in words]
    out = {"n_words": len(words), "word_chars": sum(size), "n_symbols": sum(c in "#*$%&|<>" for c in text or "")}
    lines = [x for x in data.split(b"\n") if x.strip(BLANKS)]
    again = [x for k, x in enumerate(lines) if x in lines[:k]]
    out |= {"n_lines": len(lines), "n_dup_lines": len(again), "dup_line_chars": sum(len(b"".join(x.split()).decode()) for x in again)}
    for n in range(2, 11):
        grams = [tuple(words[k:k + n]) for k in range(len(words) - n + 1)]
        both, later = set(), set()
        for k, g in enumerate(grams):
            if grams.count(g) > 1:
                both.update(range(k, k + n))
            if g in grams[:k]:
                later.update(range(k, k + n))
        if n == 3:
            out["n_repeat_words"] = len(both)
        if n in R.TOP:
            out[f"top_chars_{n}"] = max([grams.count(g) * sum(map(len, g)) for g in set(grams) if grams.count(g) > 1], default=0)
        if n in R.DUPLICATE:
            out[f"dup_chars_{n}"] = sum(size[k] for k in later)
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, `first.x` string")


def test_measures_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "a b a b a b", "é ü é ü é ü\n\né ü\n é ü", "x y x y z", "#a *b |c <d> $%&"]
    for vocabulary in (2, 5, 30):
        for _ in range(12):
            texts.append("".join(rng.choice(["w%d", "é%d", "%d"]) % rng.randrange(vocabulary) + rng.choice([" ", "  ", "\n", "\t", "\r\n"]) for _ in range(rng.randrange(90))))
    got = R.measures(table(spark, list(enumerate(texts)))).collect()
    assert len(got) == len(texts)
    for r in got:
        assert {c: r[c] for c in R.COLUMNS} == brute(texts[r.doc_id]), texts[r.doc_id]


def test_verdicts(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"{rng.randrange(10**9):x}" for _ in range(n)]
    clean, passage = fresh(400), fresh(60)
    cases = {
        "clean": (" ".join(clean), False, True),
        "short": (" ".join(clean[:49]), True, False),
        "fifty": (" ".join(clean[:50]), False, True),
        "passage thrice": (" ".join([*clean, *passage, *clean[:0], *passage, *passage]), False, False),
        "passage twice in a long text": (" ".join([*clean, *fresh(400), *passage, *passage]), False, True),
        "lines": ("\n".join([*(" ".join(clean[k:k + 4]) for k in range(0, 240, 4)), *["same"] * 40]), False, False),
        "loop": ("over and over again " * 40, True, False),
        "null": (None, True, False),
        "empty": ("", True, False),
    }
    rows = list(enumerate(t for t, *_ in cases.values()))
    got = {r.doc_id: (r.base_failed, r.kept) for r in R.judge(table(spark, rows)).collect()}
    assert got == {i: tuple(want) for i, (_, *want) in enumerate(cases.values())}


@pytest.mark.parametrize("copies", [1, 3])
def test_repeated_rows_null_ids_and_empty_tables(spark, copies):
    rows = [(None, "a b c " * 30), (7, "a b c " * 30), (7, None)] * copies
    got = R.judge(table(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_repeat_words) for r in got) == sorted([("None", 90, 90), ("7", 90, 90), ("7", 0, 0)] * copies)
    assert R.judge(table(spark, [])).collect() == []


def test_text_of_megabytes_is_measured_whole(spark):
    fresh = " ".join(f"word{i}" for i in range(300_000))
    tail = " ".join(f"tail{i}" for i in range(40_000))
    r = R.judge(table(spark, [(1, f"{fresh} {tail} {tail}"), (2, "a b")])).where("doc_id = 1").first()
    assert r.n_words == 380_000 and r.n_repeat_words == 80_000 and not r.base_failed
    assert r.dup_chars_10 == len(tail) - tail.count(" ") and r.kept == (100 * r.dup_chars_10 <= 10 * r.word_chars)
