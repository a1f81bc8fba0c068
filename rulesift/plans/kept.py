"""Kept tables: rows under a key that later writes replace, version by version.

    path/changes/version=N/bucket=B/   the rows that version N brings (Parquet)
    path/log/version=N/                one row per published version

A write adds one version and touches nothing older, so its cost follows its own rows.
It is published by the row in the log, a single file that is moved into place after all
data: what a job leaves behind that ends before it is never read, and the next write
takes the number (and the folder) again.  Of a key, the rows of its last version count;
a version brings all rows of each key that it names, and a marker row where there may be
none.  Keys are columns, never values read off folder names; the folders hold two
integers whose types are given to the reader.  Rows lie in ``BUCKETS`` folders by the hash of
``key``: a read of some keys opens their folders only.

``compact`` writes the rows that count as one version that later reads start from.

A table has one writer at a time, as one stream or one scheduled job is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
LOG = "writer string, batch long, base boolean, version long"


def log(spark: SparkSession, path: str) -> DataFrame:
    """(writer, batch, base, version) of every published version."""
    try:
        return spark.read.schema(LOG).json(f"{path}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def is_published(spark: SparkSession, path: str, writer: str, batch: int) -> bool:
    return not log(spark, path).where((F.col("writer") == writer) & (F.col("batch") == batch)).isEmpty()


def bucket(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


def publish(rows: DataFrame, path: str, key: list[str], order: list[str], writer: str | None = None, batch: int | None = None, base: bool = False) -> int:
    """Writes ``rows`` as the next version and returns its number.  Files are sized and large
    buckets split by the rebalance; rows are sorted by ``order`` in them, for row-group pruning."""
    spark = rows.sparkSession
    version = (log(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    (rows.withColumn("bucket", bucket(key)).hint("rebalance", "bucket").sortWithinPartitions("bucket", *order)
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/changes/version={version}"))
    entry = spark.createDataFrame([(writer, batch, base)], "writer string, batch long, base boolean")
    entry.coalesce(1).write.mode("overwrite").json(f"{path}/log/version={version}")
    return version


def read(spark: SparkSession, path: str, schema: str, key: list[str] | None = None, only: list[tuple] | None = None, buckets: list[int] | None = None) -> DataFrame:
    """Rows of the published versions, with ``version``.  ``only``: values of ``key`` to read (null
    for null); ``buckets``: folders to read."""
    versions = {r.version: r.base for r in log(spark, path).collect()}
    start = max((v for v, base in versions.items() if base), default=0)
    folders = [f"{path}/changes/version={v}" for v in sorted(versions) if v >= start]
    if not folders:
        return spark.createDataFrame([], f"{schema}, version long")
    rows = spark.read.schema(f"{schema}, version long, bucket int").option("basePath", f"{path}/changes").parquet(*folders)
    if only is not None:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key).schema)
        buckets = [r[0] for r in spark.createDataFrame(only, fields).select(bucket(key)).distinct().collect()]
        wanted = [reduce(Column.__and__, (F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(key, values, strict=True))) for values in only]
        rows = rows.where(reduce(Column.__or__, wanted, F.lit(False)))
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    return rows.drop("bucket")


def latest(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows of each key's last version.  The maximum is combined on the map side, and the
    join's large keys are split by adaptive execution, so one key may hold any share of the rows."""
    last = rows.groupBy(*key).agg(F.max("version").alias("_last")).select(*(F.col(k).alias(f"_{k}") for k in key), "_last")
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key))
    return rows.join(last, same & (F.col("version") == F.col("_last"))).select(*rows.columns)


def compact(spark: SparkSession, path: str, schema: str, key: list[str], order: list[str], replaced: list[str]) -> list[str]:
    """Writes what counts now as one version; reads start from it.  ``replaced`` is the key whose
    last version counts.  Returns the folders that no later read opens."""
    old = [r.version for r in log(spark, path).collect()]
    if old:
        publish(latest(read(spark, path, schema), replaced).drop("version"), path, key, order, base=True)
    return [f"{path}/changes/version={v}" for v in sorted(old)]
