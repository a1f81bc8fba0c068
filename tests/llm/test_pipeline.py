import corpus_pipeline as P
from rulesift.llm import bpe, toxicity

SF = "/root/testdata/sf0.01"


def stages(spark, docs, tmp_path):
    """Input and output of each stage, written and read again."""
    out = []
    for k, (name, f) in enumerate(P.STAGES):
        f(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out.append((name, docs, docs := spark.read.parquet(str(tmp_path / str(k)))))
    return out


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    done = stages(spark, docs, tmp_path)
    assert [n for n, *_ in done] == ["toxicity", "line_dedup", "near_duplicates", "decontaminate", "tokenize"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for name, before, after in done:
        assert ids(after) <= ids(before) and (name == "tokenize" or after.dtypes == docs.dtypes)
        assert 0.5 * before.count() < after.count() <= before.count()
    _, before, after = done[0]
    model = toxicity.train(toxicity.with_labels(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert ids(before) - ids(after) == {r.doc_id for r in before.collect() if model.score(r.text) >= 0.5}
    lines = [x for r in done[1][2].collect() for x in r.text.split("\n") if x.strip(" ")]
    assert len(lines) == len(set(lines))
    texts = {r.doc_id: r.text for r in done[3][2].collect()}
    v = bpe.public_vocabulary()
    back = {i: t for t, i in v.ranks().items()}
    assert {r.doc_id: b"".join(back[i] for i in r.ids).decode() for r in done[4][2].collect()} == texts


def test_edges(spark, tmp_path):
    clean = "the first line of a clean document with some words\nand the second one"
    rows = [(1, clean, "en", "s", 1), (1, clean, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "text without an id is kept here", "en", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    *_, (_, _, out) = stages(spark, docs, tmp_path)
    got = sorted((r.doc_id or 0, r.n_tokens > 0) for r in out.collect())
    assert got == [(0, True), (1, True), (2, False), (3, False)]
    *_, (_, _, none) = stages(spark, docs.where("false"), tmp_path / "none")
    assert none.collect() == []


def test_toxicity_stage_keeps_what_labels_say_nothing_of(spark, tmp_path):
    texts = [None, "", "ab", *(f"a kind sentence about the garden {i}" for i in range(80)), *(f"some vile insult thrown at you {i}" for i in range(80))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    toxic = {i for i, t in enumerate(texts) if t and "vile" in t}

    def gone(name, labels):
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        return set(range(len(texts))) - {r.doc_id for r in P.drop_toxic(spark, docs, str(tmp_path / name)).collect()}

    assert gone("empty", []) == set()
    assert gone("others", [(1000, 0), (1001, 1)]) == set()
    assert gone("all toxic", [(i, 1) for i in toxic]) == set()
    assert gone("all clean", [(i, 0) for i in range(3, 83)]) == set()
    assert gone("both", [(i, int(i in toxic)) for i in range(3, len(texts))]) == toxic


def test_rows_that_share_an_id_are_judged_each(spark):
    words = [f"word{i}" for i in range(60)]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text IS NOT NULL").first().text
    other = [f"a quite different text number {i} with words of its own " + " ".join(f"own{i}x{k}" for k in range(30)) for i in range(3)]
    near, same = " ".join(words), " ".join([*words[:-1], "changed"])
    rows = [(1, near), (2, same), (2, other[0]), (3, other[1]), (3, other[1]), (4, item), (4, other[2]), (5, near + " more"), (None, item)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    once = [(1, near), (2, other[0]), (3, other[1]), (4, item), (4, other[2]), (None, item)]
    assert got(P.drop_near_duplicates(spark, docs, SF)) == sorted(once, key=str)
    clean = [x for x in rows if x != (4, item)]
    assert got(P.drop_contaminated(spark, docs, SF)) == sorted(clean, key=str)


def test_clashing_columns_and_long_texts(spark, tmp_path):
    """Extra columns named like those that the stages make, and a text of megabytes, go through all stages."""
    names = ["score", "key", "row", "id", "words", "n", "lines", "kept", "line", "position", "component_id", "n_shingles", "seed", "item", "ids", "decoded", "doc", "digest", "a", "u", "v", "first.x", "part"]
    long = " ".join(f"word{i}" for i in range(300_000))
    texts = [f"{long} ending one", f"{long} ending two", "a short clean text with some words of its own\nand a second line", None, ""]
    rows = [(i, t, "en", "s", len(t or ""), *([f"x{i}"] * len(names))) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    *kept, (_, last, out) = stages(spark, docs, tmp_path)
    assert all(after.columns == docs.columns for *_, after in kept)
    got = {r.doc_id: r for r in last.collect()}
    assert sorted(got) == [0, 2, 3, 4] and all(r[n] == f"x{i}" for i, r in got.items() for n in names)
    assert got[0].text == texts[0] and got[0].n_chars == len(texts[0])
    tokens = {r.doc_id: r.n_tokens for r in out.collect()}
    assert sorted(tokens) == [0, 2, 3, 4] and tokens[0] > 300_000 and tokens[3] == tokens[4] == 0
