"""Session settings for local runs (tests, bench, CLI) and the shared scratch folder.

Library functions never create a session: they take the caller's one.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "rulesift",
                  driver_memory: str = "8g", extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in {**LOCAL_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the session's checkpoint folder.

    Where none is set, a ``local[...]`` master gets a fresh folder under the temp
    directory (driver and executors are one process there); on any other master
    this raises, because a folder of the driver's machine is not shared.
    """
    d = checkpoint_dir(spark)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="rulesift-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
        spark.conf.set("spark.checkpoint.dir", d)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


#: Scratch tables (path, catalogue name or None) that this process has made, for each open ``scratch_tables``.
_watching: list[list[tuple[str, str | None]]] = []


@contextmanager
def scratch_tables(made: list[tuple[str, str | None]] | None = None) -> Iterator[list[tuple[str, str | None]]]:
    """Adds the scratch tables made inside the block to ``made``, for a later ``drop_scratch``."""
    made = made if made is not None else []
    _watching.append(made)
    try:
        yield made
    finally:
        _watching[:] = [x for x in _watching if x is not made]


def drop_scratch(spark: SparkSession, made: list[tuple[str, str | None]]) -> None:
    """Removes these scratch tables, and empties the list.  Call it when no DataFrame that
    reads them is needed any more."""
    for path, table in made:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    made.clear()


def scratch_path(spark: SparkSession, name: str, table: bool = False) -> str:
    """A path of its own for an intermediate table (``table``: one of the catalogue) under the
    shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    for made in _watching:
        made.append((path, f"{name}_{path[-32:]}".replace("-", "_") if table else None))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it
    back: cuts the lineage with files that survive lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``materialize``, with the files bucketed by ``key`` into
    ``spark.sql.shuffle.partitions`` buckets: later joins and groupings on ``key``
    read it in place, without another shuffle of its rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name, table=True)
    table = f"{name}_{path[-32:]}".replace("-", "_")
    (df.write.option("compression", "zstd").option("path", path).format("parquet")
       .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(table))
    return spark.table(table)
