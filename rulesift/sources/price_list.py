"""Price list text → model records (landed file, no download)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulesift import fixed
from rulesift.functions.catalog import js_trim

SLICE = 10_000
NUMBER_PREFIX = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def _value(trimmed, key):
    val = js_trim(F.expr(f"substring({trimmed}, {len(key) + 1})"))
    num = F.regexp_extract(val, NUMBER_PREFIX, 0)
    return F.when(val == fixed.PRICE_NOT_APPLICABLE, F.lit(None).cast("double")).otherwise(
        F.when(num != "", num.cast("double")).otherwise(F.lit(float("nan"))))


def parse_price_lines(lines: DataFrame) -> DataFrame:
    """``lines``: (source, line_number, line).  A ``- name:`` line opens a
    record; ``multiplier_paid:``/``multiplier_free:`` lines of that record set
    its numbers (the last one wins); "Not applicable" is null; text before the
    first record is ignored.  Records are numbered in file order (``seq``): names are counted per
    slice of ``SLICE`` line numbers, the slices' counts are added up per list, and lines are
    numbered inside their slice, so no task needs a whole list."""
    t = lines.withColumns({"_t": js_trim(F.col("line")), "_slice": F.floor(F.col("line_number") / SLICE)})
    is_name = F.col("_t").startswith(fixed.PRICE_NAME_KEY)
    earlier = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = t.groupBy("source", "_slice").agg(F.count_if(is_name).alias("_names")).withColumn("_before", F.coalesce(F.sum("_names").over(earlier), F.lit(0)))
    inside = Window.partitionBy("source", "_slice").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("seq", F.sum(is_name.cast("int")).over(inside)).join(slices.drop("_names"), ["source", "_slice"])
    t = t.withColumn("seq", F.col("seq") + F.col("_before")).where(F.col("seq") > 0)
    paid = F.when(F.col("_t").startswith(fixed.PRICE_PAID_KEY), F.struct("line_number", _value("_t", fixed.PRICE_PAID_KEY).alias("v")))
    free = F.when(F.col("_t").startswith(fixed.PRICE_FREE_KEY), F.struct("line_number", _value("_t", fixed.PRICE_FREE_KEY).alias("v")))
    name = F.when(is_name, js_trim(F.expr(f"substring(_t, {len(fixed.PRICE_NAME_KEY) + 1})")))
    return (t.groupBy("source", "seq")
            .agg(F.max(name).alias("name"),
                 F.max(paid).alias("_paid"), F.max(free).alias("_free"))
            .select("source", "seq", "name",
                    F.col("_paid.v").alias("multiplier_paid"), F.col("_free.v").alias("multiplier_free"),
                    F.col("_paid").isNotNull().alias("has_paid")))


def read_price_list(spark: SparkSession, path: str) -> DataFrame:
    """Whole price-list files (small) → lines with numbers → records."""
    raw = spark.read.text(path, wholetext=True).withColumn("source", F.input_file_name())
    lines = raw.select("source", F.posexplode(F.split("value", "\n", -1)).alias("pos", "line")) \
        .select("source", (F.col("pos") + 1).alias("line_number"), "line")
    return parse_price_lines(lines)
