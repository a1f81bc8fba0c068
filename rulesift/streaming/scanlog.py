"""Scan log — scans per repository and day, batch or streaming.

The same aggregation runs on a batch DataFrame (the registered query) and on a
streaming one (``start_scan_log``): event-time windows of one day with a
watermark, so state for closed days is dropped and late events beyond the
watermark are ignored.  Findings have the same log: in batch (``daily_findings``) and as a
stream over the changes that the incremental scan keeps (``start_findings_log``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N_REPOS = 20


def scan_events(events: DataFrame) -> DataFrame:
    """Driver ``events`` as scan events: one event is one scan of a repository."""
    return events.select(F.col("ts").alias("scan_ts"),
                         F.concat(F.lit("org/repo"), (F.col("user_id") % N_REPOS).cast("string")).alias("repo"),
                         F.col("event_type").alias("kind"))


def daily_scan_log(scans: DataFrame, watermark: str = "1 day") -> DataFrame:
    """(day, repo, kind, scans) per one-day event-time window."""
    return (scans.withWatermark("scan_ts", watermark)
            .groupBy(F.window("scan_ts", "1 day"), "repo", "kind")
            .agg(F.count("*").cast("long").alias("scans"))
            .select(F.date_format(F.col("window.start"), "yyyy-MM-dd").alias("day"),
                    "repo", "kind", "scans"))


def _per_day(findings: DataFrame) -> DataFrame:
    return (findings.groupBy(F.window("scan_ts", "1 day"), "repo", "policy_id")
            .agg(F.count("*").cast("long").alias("findings"))
            .select(F.date_format(F.col("window.start"), "yyyy-MM-dd").alias("day"), "repo", "policy_id", "findings"))


def daily_findings(findings: DataFrame, watermark: str = "1 day") -> DataFrame:
    """(day, repo, policy_id, findings) of kept findings that carry their ``scan_ts``."""
    return _per_day(findings.withWatermark("scan_ts", watermark))


FINDING_KEY = ["repo", "branch", "commit", "policy_id", "path", "line_number"]


def findings_log(changes: DataFrame, watermark: str = "1 day") -> DataFrame:
    """The same counts from a stream of T1's changes.

    A finding that comes again within the watermark (a file that landed twice, a batch
    that was written twice, a compaction) counts once, on the day it came first; what comes
    after its day's window has passed the watermark is late and dropped.  State is bounded by the
    watermark: keys for the duplicates, one row per open day, repository and policy for the counts."""
    found = changes.where("policy_id IS NOT NULL").withWatermark("scan_ts", watermark)
    return _per_day(found.dropDuplicatesWithinWatermark(FINDING_KEY))


def start_findings_log(spark, kept_dir: str, sink_path: str, checkpoint: str, watermark: str = "1 day"):
    """Changes that the incremental scan keeps in ``kept_dir``, as they come, to daily counts
    (closed days, appended) in ``sink_path``; restartable from ``checkpoint``."""
    from rulesift.streaming.incremental import CHANGE_SCHEMA
    changes = spark.readStream.schema(f"{CHANGE_SCHEMA}, version long, bucket int").parquet(f"{kept_dir}/changes")
    return (findings_log(changes, watermark).writeStream.outputMode("append").format("parquet")
            .option("path", sink_path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def start_scan_log(spark, events_dir: str, schema, sink_path: str, checkpoint: str,
                   watermark: str = "1 day"):
    """Streaming form: parquet files landing in ``events_dir`` → daily counts
    appended (closed windows only) to ``sink_path``; restartable from
    ``checkpoint``.  Returns the started query (``availableNow`` trigger)."""
    stream = spark.readStream.schema(schema).parquet(events_dir)
    out = daily_scan_log(scan_events(stream), watermark)
    return (out.writeStream.outputMode("append").format("parquet")
            .option("path", sink_path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
