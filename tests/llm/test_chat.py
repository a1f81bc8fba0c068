import hashlib
import random

import duckdb
import pytest

from rulesift.llm import chat, queries

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    """{conv: (turns, digest, loss chars, loss digest)} of (conv, turn, role, text)."""
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), len(s := "".join(x for r, x in t if r == "assistant")), sha(s)) for c, t in out.items()}


def test_query_reads_back_every_turn(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in queries.op1_chat(spark, sf).collect()}
    want = expected(rows)
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want
    assert all(r.formatted_chars > r.loss_chars for r in got.values())


def test_hostile_texts_ties_and_nulls(spark):
    rng = random.Random(4)
    bits = [*chat.CONTROL, "<|im_start|>", "<|im_end|>", "<|im_sep|>", "im_", "<|", "|>", "\\", "\\\\", "<", "\\n", "\n", "im_end|>", "é🙂", "[", "", chat.PROBE[0], "<s", ">"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
    rows = [(rng.choice([1, 2, 3, None]), rng.randrange(9), rng.choice(["user", "assistant", "a\nb\\n", None]), rng.choice([text(), None])) for _ in range(300)]
    rows += [(9, 1, "assistant", "again")] * 3 + [(8, i, "user", "x" * 50) for i in range(3000)]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, piece string").repartition(5)
    got = chat.digests(chat.spans(table)).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == expected(rows) and not any(r.rewrites for r in got)
    assert chat.digests(chat.spans(table.where("false"))).collect() == []


def test_spans_and_rewriting_templates(spark):
    turns = [(1, i, ("user", "assistant")[i % 2], f"text {i}") for i in range(6)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")

    def rebuilt(template):
        text = ""
        rows = chat.spans(table, template).collect()
        for r in rows:
            text = text[:r.start] + r.piece
        assert text == template.render([(r, x) for *_, r, x in turns])
        return text, rows

    def no_history(given):  # thoughts of earlier turns are dropped: history changes
        return "<s>" + "".join(f"[{r}]{x + ' (thought)' if k == len(given) - 1 and r == 'assistant' else x};" for k, (r, x) in enumerate(given))

    def first_mark(given):
        return "<s>" + "".join(f"[{r}]{x};" for r, x in given)

    text, rows = rebuilt(chat.Template(first_mark, memory=1))
    assert [text[r.loss_start:r.loss_end] for r in rows if r.loss_start is not None] == ["text 1", "text 3", "text 5"] and not any(r.rewrites for r in rows)
    assert rebuilt(chat.Template(first_mark))[0] == text
    _, rows = rebuilt(chat.Template(no_history))
    assert [r.rewrites for r in rows] == [False, False, True, False, True, False]


def test_every_prefix_of_the_marks_is_read_back(spark):
    texts = [mark[:k] + end for mark in ("<|im_start|>", "<|im_end|>", "<|im_sep|>", "</s>", "[/INST]", "<</SYS>>") for k in range(len(mark) + 1) for end in ("", "|>", "\\", "\\|im_", "\n")]
    texts += ["<<|im_|im_end|>", "<\\|im_end|>", "\\<|im_", "<|im_" * 3, "x" * 3_000_000 + "<|im_end|>" + "\\" * 1000]
    rows = [(k, t, role, text) for k, text in enumerate(texts) for t, role in enumerate(("user", "assistant", text[:20]))]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.spans(table)).collect()}
    assert got == expected(rows)


def test_wrong_memory_is_found(spark):
    def counted(given):  # each turn is numbered, the last one twice: the whole history matters
        return "".join(f"[{k}{r}]{x};" for k, (r, x) in enumerate(given))

    def last_but_one(given):
        return "".join(f"[{r}]{x}{'!' if k < len(given) - 2 else ''};" for k, (r, x) in enumerate(given))

    turns = [(1, i, ("user", "assistant")[i % 2], f"text {i}") for i in range(6)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for template in (counted, last_but_one):
        with pytest.raises(Exception, match="depends on more than 1 earlier turns"):
            chat.spans(table, chat.Template(template, memory=1)).collect()
    assert len(chat.spans(table, chat.Template(counted)).collect()) == 6
    long = [(1, i, ("user", "assistant")[i % 2], f"text {i}") for i in range(3 * chat.WHOLE)]
    table = spark.createDataFrame(long, "conv_id long, turn long, role string, text string")
    plain = lambda given: "<s>" + "".join(f"[{r}]{x};" for r, x in given)
    assert chat.spans(table, chat.Template(plain, memory=1)).collect() == chat.spans(table, chat.Template(plain)).collect()


def test_query_equals_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
        want = con.sql(queries.LLM_ORACLE["op1_chat"])
        assert sorted(map(tuple, queries.op1_chat(spark, sf).select(*want.columns).collect())) == sorted(want.fetchall())
