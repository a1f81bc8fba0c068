"""Model catalog: J4 last record wins per id, J3 requested model with default."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesift import fixed
from rulesift.functions import catalog as FC
from rulesift.session import materialize


def model_catalog(records: DataFrame) -> DataFrame:
    """F8–F12 + J4: one row per model id.  Records without a paid multiplier
    (or with "Not applicable") are dropped; a later record with the same id
    replaces an earlier one."""
    kept = records.where(F.col("has_paid") & F.col("multiplier_paid").isNotNull())
    m = F.col("multiplier_paid")
    label, badge = FC.ui_cost_text(m, F.col("multiplier_free"))
    rows = kept.select(
        FC.model_slug(F.col("name")).alias("id"), "source", "seq",
        F.struct(F.col("name"), m.alias("multiplier"), F.col("multiplier_free"),
                 FC.cost_label(m).alias("cost"), FC.tier(m).alias("tier"), FC.overage(m).alias("overage"),
                 label.alias("ui_label"), badge.alias("ui_badge"),
                 FC.option_text(F.col("name"), m).alias("option_text")).alias("info"))
    last = rows.groupBy("id").agg(F.max_by("info", F.struct("source", "seq")).alias("info"))
    return last.select("id", "info.*")


def resolve_models(requests: DataFrame, catalog: DataFrame, model_col: str = "model") -> DataFrame:
    """The requested model if the catalog knows it, else the default id;
    then its catalog row (null fields when the default is not listed).  One join brings the
    row; the default's, one row at most, is a scalar subquery.  The catalog is written once."""
    catalog = materialize(catalog, "catalog")
    info = catalog.select(F.col("id").alias("_id"), F.struct(*(c for c in catalog.columns if c != "id")).alias("_info"))
    r = requests.join(info, requests[model_col] == info["_id"], "left")
    fallback = info.where(F.col("_id") == fixed.DEFAULT_MODEL_ID).select("_info").scalar()
    known = F.col("_id").isNotNull()
    r = r.withColumns({"model_id": F.coalesce("_id", F.lit(fixed.DEFAULT_MODEL_ID)), "_info": F.when(known, F.col("_info")).otherwise(fallback)})
    return r.select("model_id", *requests.columns, "_info.*")
