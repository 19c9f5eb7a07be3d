"""Plan trees and pattern rules."""

import json

from conftest import plan_of
from pyspark.sql import functions as F

from plangauge.plans import patterns, plan_tree
from plangauge.plans.plan_tree import diagnosis, observe, plan_metrics, plan_nodes, suggested_actions


def node(kind, *children, **fields):
    out = {"Node Type": kind, **{k.replace("_", " "): v for k, v in fields.items()}}
    if children:
        out["Plans"] = list(children)
    return out


JOIN = node("Hash Join", node("Seq Scan"), node("Hash", node("Seq Scan")))
COSTS = node("Limit", node("Seq Scan", Total_Cost=500), node("Sort", Total_Cost=50), Total_Cost=100)
TIES = node("Limit", node("Sort", node("Index Scan", Total_Cost=9), Total_Cost=9), node("Seq Scan", Total_Cost=9), Total_Cost=1)


def deep(levels):
    out = node("Seq Scan", Total_Cost=levels)
    for i in range(levels):
        out = node("Nested Loop" if i % 2 else "Merge Join", out, Total_Cost=i)
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "plan_id long, plan_json string")


def test_three_shapes_and_counts(spark):
    texts = [json.dumps([{"Plan": JOIN}]), json.dumps({"Plan": JOIN}), json.dumps(JOIN)]
    for r in plan_metrics(frame(spark, texts)).collect():
        assert (r["node_type"], r["seq_scans"], r["hash_joins"], r["nested_loops"], r["node_count"]) == ("Hash Join", 2, 1, 0, 4)


def test_highest_cost_and_ties(spark):
    out = plan_metrics(frame(spark, [json.dumps(COSTS), json.dumps(TIES)])).orderBy("plan_id").collect()
    assert (out[0]["top_node_type"], out[0]["top_node_cost"], out[0]["top_node_path"]) == ("Seq Scan", 500.0, "0")
    # equal costs: the first in preorder, not the first by level
    assert (out[1]["top_node_type"], out[1]["top_node_path"]) == ("Sort", "0")
    preorder = [r["node_type"] for r in plan_nodes(frame(spark, [json.dumps(TIES)])).orderBy("preorder").collect()]
    assert preorder == ["Limit", "Sort", "Index Scan", "Seq Scan"]


def test_bad_input_gives_defaults(spark):
    texts = ["bad json", "", None, '{"Plan": {"Node Type": "Seq', json.dumps({"Node Type": "Sort", "Plans": {"x": 1}, "Total Cost": "many"})]
    out = plan_metrics(frame(spark, texts)).orderBy("plan_id").collect()
    for r in out[:4]:
        assert (r["node_type"], r["total_cost"], r["actual_time_ms"], r["rows"], r["node_count"]) == ("unknown", 0.0, 0.0, 0, 1)
    assert (out[4]["node_type"], out[4]["total_cost"], out[4]["node_count"]) == ("Sort", 0.0, 1)


def test_text_cost_that_is_a_number_and_fractional_rows(spark):
    text = json.dumps(node("Sort", Total_Cost="12.5", Actual_Rows=7.9))
    r = plan_metrics(frame(spark, [text])).first()
    assert (r["total_cost"], r["rows"]) == (12.5, 7)


def test_depth_beyond_recursion_defaults_and_join_depth(spark):
    r = plan_metrics(frame(spark, [json.dumps(deep(150))])).first()
    assert (r["node_count"], r["join_depth"], r["top_node_type"]) == (151, 150, "Seq Scan")
    nodes = plan_nodes(frame(spark, [json.dumps(deep(150))]))
    assert nodes.agg(F.max("depth")).first()[0] == 150


def test_self_cost(spark):
    out = {r["path"]: r["self_cost"] for r in plan_nodes(frame(spark, [json.dumps(COSTS)])).collect()}
    assert out == {"": -450.0, "0": 500.0, "1": 50.0}


def metrics_row(spark, **values):
    base = dict(
        plan_id=1, node_type="Aggregate", total_cost=0.0, actual_time_ms=0.0, rows=0, seq_scans=0, index_scans=0, nested_loops=0,
        hash_joins=0, join_depth=0, child0_rows=0, child0_node_type="", filter_or=False,
    )
    return spark.createDataFrame([{**base, **values}])


def diagnose(spark, **values):
    return metrics_row(spark, **values).select(diagnosis().alias("d")).first()["d"]


def test_diagnosis_order(spark):
    assert diagnose(spark, seq_scans=2, actual_time_ms=1500.0) == "SEQ_SCAN_SELECTIVE_FILTER"
    assert diagnose(spark, nested_loops=1, rows=200000) == "NESTED_LOOP_HIGH_CARDINALITY"
    assert diagnose(spark, seq_scans=1, actual_time_ms=500.0) == "MISSING_INDEX_FILTER"
    assert diagnose(spark, node_type="Subquery Scan") == "SUBQUERY_MATERIALIZABLE"
    assert diagnose(spark, join_depth=3) == "MULTI_JOIN_NO_STATS"
    assert diagnose(spark, index_scans=2, rows=100, actual_time_ms=10.0) == "ALREADY_OPTIMAL"


def test_suggested_actions(spark):
    df = spark.createDataFrame([("MISSING_INDEX_FILTER",), ("whatever",)], "d string")
    out = [r[0] for r in df.select(suggested_actions(F.col("d"))).collect()]
    assert out == [["suggest_index", "push_filter"], ["push_filter"]]


def matches(spark, **values):
    return metrics_row(spark, **values).select(patterns.matching_ids().alias("m")).first()["m"]


def test_pattern_rules(spark):
    assert matches(spark, seq_scans=2, rows=600000, nested_loops=1) == ["P2_NESTED_LOOP_ELIMINATION", "P1_FILTER_PUSHDOWN"]
    assert matches(spark, rows=10, index_scans=1) == []
    assert matches(spark, node_type="Limit", child0_node_type="Incremental Sort", child0_rows=100000) == ["P6_LIMIT_PUSHDOWN"]
    assert matches(spark, node_type="Limit", child0_node_type="Sort", child0_rows=99999) == []
    assert matches(spark, seq_scans=1, filter_or=True) == ["P7_PREDICATE_ISOLATION"]
    assert matches(spark, nested_loops=1, child0_rows=1000000, total_cost=50000.0) == ["P3_SUBQUERY_TO_CTE", "P5_JOIN_REORDER"]


def test_allowed_and_k(spark):
    row = metrics_row(spark, seq_scans=2, rows=2000000, nested_loops=1)
    every = row.select(patterns.matching_ids().alias("m")).first()["m"]
    assert every == ["P2_NESTED_LOOP_ELIMINATION", "P4_EARLY_AGGREGATION", "P1_FILTER_PUSHDOWN"]
    assert row.select(patterns.matching_ids(k=2).alias("m")).first()["m"] == every[:2]
    assert row.select(patterns.matching_ids(allowed=[], k=2).alias("m")).first()["m"] == []
    assert row.select(patterns.matching_ids(allowed=["P1_FILTER_PUSHDOWN"], k=2).alias("m")).first()["m"] == ["P1_FILTER_PUSHDOWN"]
    assert row.select(patterns.matching_ids(k=0).alias("m")).first()["m"] == []


def test_patterns_for_query():
    assert [p.pattern_id for p in patterns.patterns_for_query("q9")] == ["P5_JOIN_REORDER", "P7_PREDICATE_ISOLATION"]
    assert patterns.patterns_for_query("17") == patterns.patterns_for_query("Q17")


def test_or_in_filter_modes(spark):
    inside = node("Seq Scan", Total_Cost=10, Filter="(a = 1 OR b = 2)")
    hidden = node("Limit", node("Seq Scan", Total_Cost=1, Filter="(a = 1 OR b = 2)"), node("Sort", Total_Cost=99), Total_Cost=5)
    out = plan_metrics(frame(spark, [json.dumps(inside), json.dumps(hidden)])).orderBy("plan_id").collect()
    assert (out[0]["filter_or"], out[0]["filter_or_text"]) == (True, True)
    # a cheap leaf is the costliest node of its own subtree
    assert (out[1]["filter_or"], out[1]["filter_or_text"]) == (True, True)
    below = node("Sort", node("Limit", node("Seq Scan", Total_Cost=9), Total_Cost=2, Output="a or b filter"), Total_Cost=3)
    out = plan_metrics(frame(spark, [json.dumps(below)])).first()
    # the node with the text is exceeded from below, so the summary leaves it out
    assert (out["filter_or"], out["filter_or_text"]) == (False, True)
    flagged = frame(spark, [json.dumps(node("Sort"))]).withColumn("query_has_or", F.lit(True))
    assert plan_metrics(flagged).first()["filter_or"] is True


def test_hotspot_and_ratio(spark):
    r = observe(frame(spark, [json.dumps(node("Sort", Total_Cost=0, Actual_Rows=7000000))]), 6001215).first()
    assert (r["cost_hotspot"], r["rows_scanned_ratio"]) == ("Sort (0% of total cost)", 1.0)


def test_metrics_are_narrow_and_jvm_side(spark):
    text = plan_of(plan_metrics(frame(spark, ["{}"])))
    assert "Exchange" not in text and "EvalPython" not in text and "InPandas" not in text


def test_or_flag_of_escaped_plans_and_one_summary_a_plan(spark):
    texts = ['{"Node Type": "Seq Scan", "Filter": "a \\u006fr b"}', '{"Node Type": "Seq Scan", "F\\u0069lter": "a or b"}', '{"Node Type": "Seq Scan", "Filter": "a = 1"}', '{"Node Type": "or", "Filter": "x"}', None]
    df = plan_metrics(spark.createDataFrame(list(enumerate(texts)), "plan_id int, plan_json string"))
    assert [r["filter_or"] for r in df.orderBy("plan_id").collect()] == [True, True, False, False, False]
    assert df.select("filter_or")._jdf.queryExecution().optimizedPlan().toString().lower().count("structstojson") == 1
