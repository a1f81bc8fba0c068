"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of ``documents``:

1. ``toxicity``: documents that the classifier of ``labels`` scores 0.5 or more go.  A
   text that holds no feature of the classifier stays; so all rows stay if no document
   is labelled, all labels are of one class, or too few for any feature.
2. ``line_dedup``: lines that repeat an earlier line go; a document that loses all its
   lines goes too.  n_chars is counted anew.
3. ``near_duplicates``: of each group that the n-gram Jaccard join connects, the
   document with the smallest id stays; documents without words all stay.
4. ``decontaminate``: documents that hold an item of ``benchmark`` go.
5. ``tokenize``: the texts as token ids (doc_id, lang, source, n_tokens, ids), checked
   by decoding: a document whose ids do not give back its text raises.

Defined cases: rows with a null or empty text pass (they have no lines, words or items);
rows without an id are scored, deduplicated by line and encoded like any other, and pass
stages 3 and 4; rows that share an id are judged each by its own text; of repeated rows
one stays at stage 3; an empty table gives an empty table; extra columns pass through
the first four stages, whatever their names; texts of megabytes are read whole.

A stage of ``STAGES`` first removes the scratch tables of the stage before it, whose output is
written by then.  Python workers get ``ARROW_ROWS`` rows at a time where the session sets no number itself: a batch of
whole documents stands in memory several times, in the executor and in the worker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesift.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from rulesift.session import drop_scratch, materialize, scratch_tables

#: Sets of ids are broadcast up to this count, else joined by a shuffle.
BROADCAST_IDS = 1_000_000
ARROW_ROWS = 1000
#: Text of a block of the tokenizer; its tasks start on executors whose memory earlier stages have filled.
BLOCK_BYTES = 6 << 20


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, ARROW_ROWS)


def _key():
    """A row's doc_id and the hash of its text; null without an id."""
    return F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("row")))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` less the rows of these keys (written before; few of them go to the tasks)."""
    if keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        keys = F.broadcast(keys)
    return docs.join(keys, _key() == keys["key"], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(toxicity.with_labels(docs, labels))
    score = "score " + "_".join(docs.columns)  # no column has this name
    return toxicity.with_score(docs, model, unknown=0.0, to=score).where(F.col(f"`{score}`") < 0.5).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    counts = "lines " + "_".join(docs.columns)  # no column has this name
    out = line_dedup.dedup(docs, count_col=counts)
    emptied = (F.col(f"`{counts}`.lines") > 0) & (F.col(f"`{counts}`.kept") == 0)
    return out.where(~emptied).drop(counts).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    linked = ngram_join.link(docs.select(_key().alias("key"), "text"), id_col="key")
    linked = materialize(linked.where("n_shingles > 0 AND key IS NOT NULL"), "linked")
    docs = _without(docs, linked.where("component_id < key").select("key").distinct())
    repeated = linked.groupBy("key").count().where("count > 1").select("key")
    if repeated.isEmpty():
        return docs
    return _without(docs, repeated).union(docs.join(repeated, _key() == repeated["key"], "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(docs.select(_key().alias("key"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    return _without(docs, materialize(found.where("key IS NOT NULL").select("key").distinct(), "contaminated"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    vocabulary = bpe.public_vocabulary()
    whole = F.sha2(F.coalesce("text", F.lit("")), 256)
    docs = docs.select(F.struct("doc_id", "lang", "source", whole.alias("digest")).alias("doc"), "text")
    coded = bpe.decode(bpe.encode(docs, vocabulary, id_col="doc", block_bytes=BLOCK_BYTES), vocabulary)
    lost = F.raise_error(F.concat(F.lit("ids do not decode to the text of document "), F.col("doc.doc_id").cast("string")))
    return coded.select("doc.doc_id", "doc.lang", "doc.source", F.size("ids").cast("long").alias("n_tokens"),
                        F.when(F.sha2("decoded", 256) == F.col("doc.digest"), F.col("ids")).otherwise(lost).alias("ids"))


#: Scratch tables of the stage that ran last, by Spark application.
_left: dict[str, list] = {}


def _staged(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        made = _left.setdefault(spark.sparkContext.applicationId, [])
        drop_scratch(spark, made)
        with scratch_tables(made):
            return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _staged(drop_toxic)),
    ("line_dedup", _staged(drop_repeated_lines)),
    ("near_duplicates", _staged(drop_near_duplicates)),
    ("decontaminate", _staged(drop_contaminated)),
    ("tokenize", _staged(tokenize)),
]

#: The first stage trains a classifier, the last merges byte pairs: SQL does not express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared scratch folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
