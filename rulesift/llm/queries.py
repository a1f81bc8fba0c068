"""Registered queries of the training-data operators, and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from rulesift.llm import bpe, chat, decontaminate, fingerprint, hard_negatives, line_dedup, ngram_join, ppm, ranked_search, repetition, substring_dedup, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, formatted and read back."""
    hostile = spark.sql("""SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text
        FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)""")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(hostile)
    return chat.digests(chat.spans(turns))


def _op1_sql() -> str:
    def escaped(text):
        out = f"replace({text}, chr(92), chr(92) || chr(92))"
        for mark in chat.CONTROL:
            out = f"replace({out}, '{mark}', '{mark[0]}' || chr(92) || '{mark[1:]}')"
        return out

    header = f"replace({escaped('role')}, chr(10), chr(92) || 'n')"
    return f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
d AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(length('<|im_start|>' || {header} || chr(10) || {escaped('text')} || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, 0::BIGINT AS rewrites FROM d
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as token ids and back: digests of both per document."""
    vocabulary = bpe.public_vocabulary()
    coded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def remainder(n: int):
    """crc32 of the doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored by a model of the labels outside the held-out fifth."""
    docs = _table(spark, sf_dir, "documents")
    taught = docs.where(remainder(5) != 0)
    model = toxicity.train(toxicity.with_labels(taught, _table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and link component of every document."""
    return ngram_join.link(_table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM d
), c AS (
  SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS h, count(*) AS n FROM s GROUP BY doc_id
), firsts AS (
  SELECT h, min(doc_id) AS doc_id, max(n) AS n FROM c GROUP BY h
), held AS (
  SELECT doc_id, g FROM s JOIN firsts USING (doc_id)
), links AS (
  SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM held a JOIN held b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL)
  JOIN firsts x ON x.doc_id = u JOIN firsts y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)
), near AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reached(x, y) AS (
  SELECT doc_id, doc_id FROM firsts UNION SELECT x, v FROM reached JOIN near ON y = u
), named AS (
  SELECT h, min(y) AS component_id FROM firsts JOIN reached ON x = doc_id GROUP BY h
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM d LEFT JOIN c USING (doc_id) LEFT JOIN named USING (h)
"""


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, up to replaced words."""
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _op5_sql() -> str:
    def leads(mask, key):
        parts = ", ".join(f"lead(w, {k}) OVER (PARTITION BY {key} ORDER BY p)" for k, x in enumerate(mask) if x == "1")
        return f"[{parts}] AS seed, lead(w, {len(mask) - 1}) OVER (PARTITION BY {key} ORDER BY p) AS last"

    lengths = {m: [n for n in range(1, decontaminate.LONG) if m in decontaminate.masks_of(n)] for n in range(1, decontaminate.LONG + 1) for m in decontaminate.masks_of(n)}

    def fits(mask):
        return f"(n IN ({', '.join(map(str, lengths[mask]))})" * bool(lengths[mask]) + " OR " * bool(lengths[mask] and mask in decontaminate.MASKS) + f"n >= {decontaminate.LONG}" * (mask in decontaminate.MASKS) + ")" * bool(lengths[mask])

    hits = " UNION ".join(
        f"""SELECT DISTINCT doc_id, item_id, d.p - b.p AS diagonal
  FROM (SELECT doc_id, p, {leads(m, "doc_id")} FROM dw WHERE EXISTS (FROM bw WHERE {fits(m)})) d JOIN (SELECT item_id, p, {leads(m, "item_id")} FROM bw WHERE {fits(m)}) b USING (seed)
  WHERE d.last IS NOT NULL AND b.last IS NOT NULL""" for m in lengths)

    def words(key, table):
        split = "list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
        return f"SELECT {key}, unnest(ws) AS w, generate_subscripts(ws, 1) AS p, len(ws) AS n FROM (SELECT {key}, {split} AS ws FROM {table})"

    return f"""
WITH dw AS ({words("doc_id", "documents")}), bw AS ({words("item_id", "benchmark")}), hits AS ({hits})
SELECT doc_id, item_id, count(DISTINCT b.p) AS matched, max(b.n) AS n_words
FROM hits JOIN bw b USING (item_id) JOIN dw d USING (doc_id)
WHERE d.p = b.p + hits.diagonal AND d.w = b.w
GROUP BY doc_id, item_id HAVING 100 * count(DISTINCT b.p) >= {decontaminate.PERCENT} * max(b.n)
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those that stay, and the digest of the text they make."""
    out = line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n")
    return out.select("doc_id", F.col("n.lines").cast("long").alias("n_lines"), F.col("n.kept").cast("long").alias("n_kept"),
                      F.sha2("text", 256).alias("kept_sha256"))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they are."""
    out = fingerprint.compare_edited(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of 50 words or more that an earlier document holds."""
    return substring_dedup.repeats(_table(spark, sf_dir, "documents")).toDF("doc_id", "first_doc_id", "start_byte", "end_byte", "n_words")


OP8_SQL = """
WITH t AS (
  SELECT doc_id, i, tok, sum(strlen(tok)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(tok) AS pos
  FROM (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+') AS toks FROM documents WHERE doc_id IS NOT NULL))
), w AS (
  SELECT doc_id, pos::BIGINT AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS word, i, tok FROM t WHERE NOT regexp_matches(tok, '^[ \\t\\n\\x0B\\f\\r]')
), v AS (
  SELECT doc_id, word, pos, lead(pos, 49) OVER o + lead(strlen(tok), 49) OVER o AS stop FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY word)
), x AS (
  SELECT doc_id, word, pos, stop, encode(text)[pos + 1:stop] AS part FROM v JOIN documents USING (doc_id) WHERE stop IS NOT NULL
), f AS (
  SELECT doc_id, word, pos, stop, first_value(struct_pack(d := doc_id, pos := pos)) OVER (PARTITION BY part ORDER BY doc_id, pos) AS first FROM x
), again AS (
  SELECT doc_id, first.d AS source, pos - first.pos AS shift, word, pos, stop FROM f WHERE doc_id <> first.d OR pos <> first.pos
), marked AS (
  SELECT *, CASE WHEN pos < max(stop) OVER (PARTITION BY doc_id, source, shift ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM again
), spans AS (
  SELECT doc_id, source, min(pos) AS a, max(stop) AS b, max(word) - min(word) + 50 AS n_words
  FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id, source, shift ORDER BY pos) AS island FROM marked) GROUP BY doc_id, source, shift, island
)
SELECT doc_id, source AS first_doc_id, a::BIGINT AS start_byte, b::BIGINT AS end_byte, n_words::BIGINT AS n_words
FROM (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM spans) WHERE reached IS NULL OR b > reached
"""


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every whole text, learnt outside the held-out seventh."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(remainder(7) != 2, F.lit(True)).alias("taught"))
    scored = ppm.score(docs, "taught")
    return scored.select("doc_id", F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive; every seventh row has the next label."""
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, x.vec_id AS id, a.label = x.label AS same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * x.v[i]))::BIGINT AS score
  FROM v a JOIN v x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
totals AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nt FROM lengths),
postings AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt))))::BIGINT AS score
  FROM (SELECT item_id, term, count(*) AS times FROM b GROUP BY item_id, term) JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals
  GROUP BY item_id, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""


def op13_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdict of every whole text."""
    return repetition.judge(_table(spark, sf_dir, "documents"))


def _op13_sql() -> str:
    parts, columns = [], []
    for n in sorted({*repetition.TOP, *repetition.DUPLICATE}):
        gram = " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER (PARTITION BY doc_id ORDER BY i)" for k in range(1, n))])
        chars = " + ".join(["c", *(f"lead(c, {k}) OVER (PARTITION BY doc_id ORDER BY i)" for k in range(1, n))])
        window = f"OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        parts.append(f"""g{n} AS (SELECT doc_id, i, c, g, gc, count(*) OVER (PARTITION BY doc_id, g) AS k, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS r
  FROM (SELECT doc_id, i, c, {gram} AS g, {chars} AS gc FROM w))""")
        measures = [f"coalesce(max(k * gc) FILTER (g IS NOT NULL AND k > 1), 0)::BIGINT AS top_chars_{n}"] * (n in repetition.TOP)
        measures += [f"coalesce(sum(c) FILTER (later), 0)::BIGINT AS dup_chars_{n}"] * (n in repetition.DUPLICATE)
        measures += ["(count(*) FILTER (twice))::BIGINT AS n_repeat_words"] * (n == 3)
        parts.append(f"""m{n} AS (SELECT doc_id, {", ".join(measures)} FROM (
  SELECT *, max(g IS NOT NULL AND k > 1) {window} AS twice, max(g IS NOT NULL AND r > 1) {window} AS later FROM g{n}) GROUP BY doc_id)""")
        columns += [x.rsplit(" AS ", 1)[1] for x in measures]
    limits = [f"100 * top_chars_{n} <= {most} * word_chars" for n, most in repetition.TOP.items()] + [f"100 * dup_chars_{n} <= {most} * word_chars" for n, most in repetition.DUPLICATE.items()]
    limits += [f"100 * n_dup_lines <= {repetition.MOST_LINES} * n_lines", f"100 * dup_line_chars <= {repetition.MOST_LINE_CHARS} * word_chars"]
    join = " ".join(f"LEFT JOIN m{n} USING (doc_id)" for n in sorted({*repetition.TOP, *repetition.DUPLICATE}))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, w, i, length(w) AS c FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d)),
l AS (SELECT doc_id, line, i, length(regexp_replace(line, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (r > 1) AS n_dup_lines, coalesce(sum(c) FILTER (r > 1), 0)::BIGINT AS dup_line_chars
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS r FROM l WHERE c > 0) GROUP BY doc_id),
{", ".join(parts)},
a AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_lines", "n_dup_lines", "dup_line_chars", *columns))}
  FROM d LEFT JOIN lines USING (doc_id) {join})
SELECT *, NOT base_failed AND {" AND ".join(limits)} AS kept
FROM (SELECT *, n_words < {repetition.LEAST_WORDS} OR 100 * n_repeat_words > {repetition.MOST_REPEATED} * n_words AS base_failed FROM a)
"""


OP6_SQL = """
WITH l AS (
  SELECT doc_id, i AS position, line, length(line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), c AS (
  SELECT line, n, min(struct_pack(doc_id := doc_id, position := position)) AS place FROM l WHERE trim(line) <> '' GROUP BY line, n
), v AS (
  SELECT line, n, place, i, hash(substr(line, 1, i - 1) || substr(line, i + 1)) AS cut
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM c WHERE n >= 16)
), substituted AS (
  SELECT DISTINCT v.place FROM v JOIN (SELECT n, i, cut, min(place) AS place FROM v GROUP BY ALL) e USING (n, i, cut) WHERE e.place < v.place
), longer AS (
  SELECT DISTINCT v.place AS long_place, c.place AS short_place FROM v JOIN c ON c.n >= 16 AND c.n = v.n - 1 AND hash(c.line) = v.cut
), gone AS (
  SELECT place FROM substituted
  UNION SELECT greatest(long_place, short_place) FROM longer
), marked AS (
  SELECT l.*, trim(l.line) = '' AS blank, k.place IS NOT NULL AS kept
  FROM l LEFT JOIN (SELECT place FROM c WHERE place NOT IN (SELECT place FROM gone)) k ON k.place = struct_pack(doc_id := l.doc_id, position := l.position)
)
SELECT doc_id, count(*) FILTER (NOT blank) AS n_lines, count(*) FILTER (kept) AS n_kept,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (blank OR kept), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_chat": op1_chat,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_ngram_join": op4_ngram_join,
    "op5_decontaminate": op5_decontaminate,
    "op6_line_dedup": op6_line_dedup,
    "op7_fingerprint": op7_fingerprint,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_ppm": op10_ppm,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_ranked_search": op12_ranked_search,
    "op13_repetition": op13_repetition,
}

LLM_ORACLE: dict[str, str] = {
    "op1_chat": _op1_sql(),
    "op4_ngram_join": OP4_SQL,
    "op5_decontaminate": _op5_sql(),
    "op6_line_dedup": OP6_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_repetition": _op13_sql(),
}
