"""Plan shape: the findings stage has no shuffle and no Python UDF."""

from rulesift.config import ScanConfig
from rulesift.plans.queries import QUERIES
from rulesift.plans.scan import scan
from rulesift.sources.corpus import corpus_files


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_findings_plan_is_map_only(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_custkey")
    res = scan(corpus_files(orders))
    plan = plan_text(res.findings)
    assert "Exchange" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "Window [" not in plan       # no window operator (the word occurs in a rule text)


SF = "/root/testdata/sf0.001"


def exchanges(plan):
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("Exchange RoundRobin") + plan.count("Exchange SinglePartition")


def test_registered_policy_queries_build_their_own_detectors(spark):
    marks = {2: "wasbs?:", 4: "STORED[", 5: "(?:SCHEMA|DATABASE)", 7: r"gdown\."}
    for pid, query in ((2, "policy2_secrets"), (4, "policy4_formats"), (5, "policy5_schema"), (7, "policy7_downloads"), (6, "policy6_file_names"), (3, "policy3_comment_density")):
        plan = plan_text(QUERIES[query](spark, SF))
        assert {p for p, mark in marks.items() if mark in plan} == {pid} & set(marks), query
        assert exchanges(plan) == 1 and "hashpartitioning(o_orderkey" in plan  # keys only; texts are built after it
    names = plan_text(QUERIES["policy6_file_names"](spark, SF))
    assert "array_join" not in names and "split(text" not in names
    assert exchanges(plan_text(QUERIES["policy2_documents"](spark, SF))) == 0 == exchanges(plan_text(QUERIES["line_split"](spark, SF)))


def test_session_search_is_linear(files_df):
    import time

    text = "s = SparkSession\n  .builder.getOrCreate()\n" * 32_000
    files = files_df([("a/load_jobs.py", text)])
    t = time.time()
    got = [r.line_number for r in scan(files, ScanConfig().only(1)).findings.collect()]
    assert sorted(got) == list(range(1, 64_000, 2)) and time.time() - t < 40


def test_summary_has_one_aggregation_shuffle_and_no_cross_join(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_custkey")
    res = scan(corpus_files(orders))
    plan = plan_text(res.policy_summary)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert exchanges(plan_text(res.scan_totals)) <= 4
