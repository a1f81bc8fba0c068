"""Price list parsing, model ids, tiers, cost texts, lookup with default."""

from pyspark.sql import functions as F

from rulesift.operators.catalog import model_catalog, resolve_models
from rulesift.sources.price_list import read_price_list

PRICE_LIST = """# header
- name: GPT-4.1
  multiplier_paid: 0
  multiplier_free: 1
- name: Claude   Sonnet (Preview)
  multiplier_paid: 1
  multiplier_free: Not applicable
- name: Big Model
  multiplier_paid: 10
- name: Cheap
  multiplier_paid: 0.33
  multiplier_paid: 0.25
- name: Gone
  multiplier_paid: Not applicable
- name: NoPaid
  multiplier_free: 1
- name: big model
  multiplier_paid: 1.5
"""


def test_price_list_to_catalog(spark, tmp_path):
    p = tmp_path / "multipliers.yml"
    p.write_text(PRICE_LIST)
    cat = {r.id: r for r in model_catalog(read_price_list(spark, str(p))).collect()}
    assert set(cat) == {"gpt-4.1", "claude-sonnet-preview", "big-model", "cheap"}
    g = cat["gpt-4.1"]
    assert (g.multiplier, g.cost, g.tier, g.overage) == (0.0, "Included", "base", "$0.00")
    assert (g.ui_label, g.ui_badge) == ("Included with paid plans", "No premium requests used")
    c = cat["claude-sonnet-preview"]
    assert (c.cost, c.tier, c.overage, c.multiplier_free) == ("1× premium", "standard", "$0.04", None)
    assert c.ui_label == "1× premium request per use" and c.ui_badge == ""
    assert cat["cheap"].multiplier == 0.25 and cat["cheap"].tier == "low"
    b = cat["big-model"]            # the later "big model" record replaces "Big Model"
    assert (b.name, b.multiplier, b.tier, b.cost, b.overage) == ("big model", 1.5, "premium", "1.5× premium", "$0.06")
    assert b.option_text == "big model    ·    1.5× premium"


def test_resolve_with_default(spark, tmp_path):
    p = tmp_path / "m.yml"
    p.write_text(PRICE_LIST)
    cat = model_catalog(read_price_list(spark, str(p)))
    req = spark.createDataFrame([(1, "cheap"), (2, "unknown-model"), (3, None)], "request_id int, model string")
    got = {r.request_id: (r.model_id, r.tier) for r in resolve_models(req, cat).collect()}
    assert got == {1: ("cheap", "low"), 2: ("gpt-4.1", "base"), 3: ("gpt-4.1", "base")}


def test_tier_edges(spark):
    from rulesift.functions.catalog import tier
    df = spark.createDataFrame([(None,), (0.0,), (0.5,), (1.0,), (5.0,), (5.01,)], "m double")
    assert [r.t for r in df.select(tier(F.col("m")).alias("t")).collect()] == \
        ["unavailable", "base", "low", "standard", "premium", "expensive"]
