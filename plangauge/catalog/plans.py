"""Plan-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plangauge.catalog.base import Catalog, plain
from plangauge.plans import patterns, plan_tree
from plangauge.sources.standins import standin
from plangauge.sources.tables import TABLE_ROWS

CATALOG = Catalog()
Q = CATALOG.query
PLANS = ("plans",)
LARGEST = max(TABLE_ROWS.values())

# The tree in recursive SQL over JSON: root, then children by index.
_NUMBER = "COALESCE(TRY_CAST({j}->>'{f}' AS DOUBLE), 0)"


def _number(field: str, source: str = "j") -> str:
    return _NUMBER.format(j=source, f=field)


_IS_JOIN = "CASE WHEN ({j}->>'Node Type') IN ('Nested Loop', 'Hash Join', 'Merge Join') THEN 1 ELSE 0 END"
TREE = f"""WITH RECURSIVE roots AS (
      SELECT plan_id, plan_json, CASE WHEN NOT json_valid(plan_json) THEN NULL
        ELSE COALESCE(json_extract(plan_json, '$[0].Plan'), json_extract(plan_json, '$.Plan'), json_extract(plan_json, '$')) END AS j
      FROM plans),
    tree AS (
      SELECT plan_id, j, 0 AS depth, CAST([] AS INT[]) AS path, {_IS_JOIN.format(j='j')} AS joins FROM roots
      UNION ALL
      SELECT plan_id, c.j, depth + 1, list_append(path, CAST(c.i AS INT)), joins + {_IS_JOIN.format(j='c.j')}
      FROM tree, LATERAL (SELECT json_extract(tree.j, '$.Plans[' || CAST(x.i AS VARCHAR) || ']') AS j, x.i
        FROM (SELECT UNNEST(range(CASE WHEN json_type(tree.j, '$.Plans') = 'ARRAY' THEN CAST(json_array_length(tree.j, '$.Plans') AS BIGINT) ELSE 0 END)) AS i) x) c),
    nodes AS (
      SELECT plan_id, depth, path, joins, COALESCE(j->>'Node Type', 'unknown') AS node_type, {_number('Total Cost')} AS total_cost,
      {_number('Actual Total Time')} AS actual_time_ms, CAST(TRUNC({_number('Actual Rows')}) AS BIGINT) AS rows_out, j
      FROM tree),
    tops AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY total_cost DESC, path) AS rn FROM nodes) t WHERE rn = 1),
    counts AS (
      SELECT plan_id, COUNT(*) AS node_count, MAX(joins) AS join_depth,
      COUNT(*) FILTER (node_type = 'Seq Scan') AS seq_scans, COUNT(*) FILTER (node_type = 'Index Scan') AS index_scans,
      COUNT(*) FILTER (node_type = 'Nested Loop') AS nested_loops, COUNT(*) FILTER (node_type = 'Hash Join') AS hash_joins,
      lower(string_agg(node_type, ' ')) AS all_types FROM nodes GROUP BY plan_id),
    exceeded AS (
      SELECT DISTINCT m.plan_id, m.path FROM nodes m JOIN nodes b
      ON b.plan_id = m.plan_id AND b.depth > m.depth AND b.total_cost > m.total_cost AND list_slice(b.path, 1, m.depth) = m.path),
    shown AS (
      SELECT n.plan_id, string_agg(lower(COALESCE(CAST(n.j AS VARCHAR), '')), ' ') AS texts
      FROM nodes n LEFT JOIN exceeded e ON e.plan_id = n.plan_id AND e.path = n.path WHERE e.plan_id IS NULL GROUP BY n.plan_id),
    metrics AS (
      SELECT r.plan_id, r.node_type, r.total_cost, r.actual_time_ms, r.rows_out, c.seq_scans, c.index_scans, c.nested_loops, c.hash_joins,
      CAST(c.join_depth AS BIGINT) AS join_depth, t.node_type AS top_node_type, t.total_cost AS top_node_cost, c.node_count,
      COALESCE(f.rows_out, 0) AS child0_rows, COALESCE(f.node_type, '') AS child0_node_type,
      (COALESCE(s.texts, '') || c.all_types) LIKE '% or %' AND (COALESCE(s.texts, '') || c.all_types) LIKE '%filter%' AS filter_or,
      lower(p.plan_json) LIKE '% or %' AND lower(p.plan_json) LIKE '%filter%' AS filter_or_text
      FROM nodes r JOIN counts c ON r.plan_id = c.plan_id JOIN tops t ON t.plan_id = r.plan_id LEFT JOIN shown s ON s.plan_id = r.plan_id JOIN plans p ON p.plan_id = r.plan_id
      LEFT JOIN nodes f ON f.plan_id = r.plan_id AND f.depth = 1 AND f.path = [0]
      WHERE r.depth = 0),
    diagnosed AS (
      SELECT *, CASE WHEN seq_scans > 0 AND actual_time_ms > 500 THEN 'SEQ_SCAN_SELECTIVE_FILTER'
        WHEN nested_loops > 0 AND rows_out > 50000 THEN 'NESTED_LOOP_HIGH_CARDINALITY'
        WHEN seq_scans > 0 AND index_scans = 0 THEN 'MISSING_INDEX_FILTER'
        WHEN node_type LIKE '%Subquery%' OR node_type LIKE '%SubPlan%' THEN 'SUBQUERY_MATERIALIZABLE'
        WHEN join_depth > 2 THEN 'MULTI_JOIN_NO_STATS' ELSE 'ALREADY_OPTIMAL' END AS bottleneck_diagnosis FROM metrics),
    matches AS (
      SELECT plan_id, 'P6_LIMIT_PUSHDOWN' AS pattern_id, 0.85::DOUBLE AS target_ratio FROM metrics
        WHERE lower(node_type) LIKE '%limit%' AND lower(child0_node_type) LIKE '%sort%' AND child0_rows >= 100000
      UNION ALL SELECT plan_id, 'P3_SUBQUERY_TO_CTE', 0.80 FROM metrics WHERE nested_loops >= 1 AND total_cost >= 50000
      UNION ALL SELECT plan_id, 'P2_NESTED_LOOP_ELIMINATION', 0.70 FROM metrics WHERE nested_loops >= 1 AND rows_out >= 100000
      UNION ALL SELECT plan_id, 'P4_EARLY_AGGREGATION', 0.65 FROM metrics WHERE seq_scans >= 2 AND rows_out >= 1000000
      UNION ALL SELECT plan_id, 'P1_FILTER_PUSHDOWN', 0.60 FROM metrics WHERE seq_scans >= 1 AND rows_out >= 500000 AND nested_loops >= 1
      UNION ALL SELECT plan_id, 'P7_PREDICATE_ISOLATION', 0.55 FROM metrics WHERE seq_scans >= 1 AND filter_or
      UNION ALL SELECT plan_id, 'P5_JOIN_REORDER', 0.40 FROM metrics WHERE nested_loops >= 1 AND child0_rows >= 1000000),
    ranked AS (SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY target_ratio DESC, pattern_id) AS rank, pattern_id, target_ratio FROM matches)
    """


def _plans(spark, d):
    return standin(spark, d, "plans").select("plan_id", "plan_json")


@Q(
    "P1_plan_nodes",
    PLANS,
    TREE
    + """SELECT plan_id, CAST(depth AS BIGINT) AS depth, array_to_string(path, '.') AS path,
    CASE WHEN depth > 0 THEN array_to_string(path[1:depth-1], '.') END AS parent, node_type, total_cost, actual_time_ms,
    rows_out AS "rows", CAST(joins AS BIGINT) AS joins FROM nodes""",
)
def p1(spark, d):
    return plain(plan_tree.plan_nodes(_plans(spark, d)).drop("preorder", "self_cost"))


@Q("P2_node_type_counts", PLANS, TREE + "SELECT plan_id, seq_scans, index_scans, nested_loops, hash_joins FROM counts")
def p2(spark, d):
    rows = plan_tree.plan_metrics(_plans(spark, d))
    return plain(rows.select("plan_id", "seq_scans", "index_scans", "nested_loops", "hash_joins"))


@Q(
    "P3_highest_cost_node",
    PLANS,
    TREE + "SELECT plan_id, node_type AS top_node_type, total_cost AS top_node_cost, array_to_string(path, '.') AS top_node_path FROM tops",
)
def p3(spark, d):
    return plain(plan_tree.plan_metrics(_plans(spark, d)).select("plan_id", "top_node_type", "top_node_cost", "top_node_path"))


@Q(
    "P4_key_fields",
    PLANS,
    TREE
    + """SELECT plan_id, node_type, total_cost, actual_time_ms, rows_out AS "rows", seq_scans, index_scans, nested_loops, hash_joins,
    top_node_type, child0_rows, child0_node_type, node_count FROM metrics""",
)
def p4(spark, d):
    columns = "plan_id node_type total_cost actual_time_ms rows seq_scans index_scans nested_loops hash_joins".split()
    rows = plan_tree.plan_metrics(_plans(spark, d))
    return plain(rows.select(*columns, "top_node_type", "child0_rows", "child0_node_type", "node_count"))


@Q("P5_join_depth", PLANS, TREE + "SELECT plan_id, join_depth FROM metrics")
def p5(spark, d):
    return plain(plan_tree.plan_metrics(_plans(spark, d)).select("plan_id", "join_depth"))


@Q("P6_bottleneck", PLANS, TREE + "SELECT plan_id, bottleneck_diagnosis FROM diagnosed")
def p6(spark, d):
    return plan_tree.observe(_plans(spark, d), LARGEST).select("plan_id", "bottleneck_diagnosis")


@Q(
    "P7_suggested_actions",
    PLANS,
    TREE
    + """SELECT plan_id, CASE bottleneck_diagnosis WHEN 'SEQ_SCAN_SELECTIVE_FILTER' THEN 'push_filter,suggest_index,add_cte'
    WHEN 'NESTED_LOOP_HIGH_CARDINALITY' THEN 'rewrite_join,add_cte,reorder_joins' WHEN 'MISSING_INDEX_FILTER' THEN 'suggest_index,push_filter'
    WHEN 'SUBQUERY_MATERIALIZABLE' THEN 'add_cte,push_filter' WHEN 'MULTI_JOIN_NO_STATS' THEN 'reorder_joins,add_cte,rewrite_join'
    WHEN 'ALREADY_OPTIMAL' THEN 'push_filter,limit_early' ELSE 'push_filter' END AS suggested_actions FROM diagnosed""",
)
def p7(spark, d):
    rows = plan_tree.observe(_plans(spark, d), LARGEST)
    return rows.select("plan_id", F.array_join("suggested_actions", ",").alias("suggested_actions"))


@Q(
    "P8_cost_hotspot",
    PLANS,
    TREE
    + """SELECT plan_id, top_node_type || ' (' || CAST(CAST(round_even(top_node_cost / CASE WHEN total_cost = 0 THEN 1 ELSE total_cost END * 100, 0) AS BIGINT) AS VARCHAR)
    || '% of total cost)' AS cost_hotspot FROM metrics""",
)
def p8(spark, d):
    return plan_tree.observe(_plans(spark, d), LARGEST).select("plan_id", "cost_hotspot")


@Q("P9_rows_scanned_ratio", PLANS, TREE + "SELECT plan_id, ROUND(LEAST(rows_out / 6001215e0, 1e0), 6) AS rows_scanned_ratio FROM metrics")
def p9(spark, d):
    return plain(plan_tree.observe(_plans(spark, d), LARGEST).select("plan_id", "rows_scanned_ratio"))


@Q(
    "P10_signal_matches",
    PLANS,
    TREE + "SELECT pattern_id, COUNT(*) AS plans FROM matches GROUP BY pattern_id",
)
def p10(spark, d):
    metrics = plan_tree.plan_metrics(_plans(spark, d))
    counts = metrics.agg(*[F.count_if(patterns.signal_matches(p)).alias(p.pattern_id) for p in patterns.PATTERNS])
    long = counts.unpivot([], [p.pattern_id for p in patterns.PATTERNS], "pattern_id", "plans")
    return long.filter(F.col("plans") > 0)


@Q("P11_or_in_filter", PLANS, TREE + "SELECT plan_id, COALESCE(filter_or, false) AS filter_or, filter_or_text FROM metrics")
def p11(spark, d):
    return plan_tree.plan_metrics(_plans(spark, d)).select("plan_id", "filter_or", "filter_or_text")


@Q("P12_applicable_patterns", PLANS, TREE + "SELECT plan_id, rank, pattern_id, target_ratio FROM ranked")
def p12(spark, d):
    return plain(patterns.applicable_patterns(plan_tree.plan_metrics(_plans(spark, d))))


_ALLOWED = ["P1_FILTER_PUSHDOWN", "P2_NESTED_LOOP_ELIMINATION", "P4_EARLY_AGGREGATION", "P7_PREDICATE_ISOLATION"]


@Q(
    "P13_top_patterns",
    PLANS,
    TREE
    + f"""SELECT plan_id, rank, pattern_id, target_ratio FROM (SELECT plan_id, pattern_id, target_ratio,
    row_number() OVER (PARTITION BY plan_id ORDER BY target_ratio DESC) AS rank FROM matches
    WHERE pattern_id IN ({', '.join(repr(a) for a in _ALLOWED)})) x WHERE rank <= 2""",
)
def p13(spark, d):
    return plain(patterns.applicable_patterns(plan_tree.plan_metrics(_plans(spark, d)), allowed=_ALLOWED, k=2))


@Q(
    "P14_sample_observations",
    PLANS,
    TREE
    + """SELECT p.plan_id, p.seed, m.seq_scans FROM metrics m JOIN plans p ON p.plan_id = m.plan_id
    WHERE p.task_level = 1 AND m.seq_scans >= 1 ORDER BY p.seed, p.plan_id LIMIT 20""",
)
def p14(spark, d):
    rows = plan_tree.plan_metrics(standin(spark, d, "plans").select("plan_id", "plan_json", "task_level", "seed"))
    return plain(plan_tree.sample_observations(rows.select("plan_id", "task_level", "seed", "seq_scans"), 20).select("plan_id", "seed", "seq_scans"))


@Q(
    "P4_normalized_plans",
    ("normalized_plans",),
    """SELECT plan_id, 'Limit' AS node_type, k * 1e1 AS total_cost, k * 9e0 AS actual_time_ms, CAST(k * 15 AS BIGINT) AS rows, 1::BIGINT AS seq_scans, 1::BIGINT AS hash_joins,
    1::BIGINT AS join_depth, 'Hash Join' AS top_node_type, CAST(k * 20 AS BIGINT) AS child0_rows, 3::BIGINT AS node_count, k % 2 = 0 AS filter_or FROM normalized_plans""",
)
def p4_normalized(spark, d):
    metrics = plan_tree.plan_metrics(standin(spark, d, "normalized_plans").select("plan_id", "plan_json"))
    return plain(
        metrics.select(
            "plan_id", "node_type", "total_cost", "actual_time_ms", "rows", "seq_scans", "hash_joins", "join_depth", "top_node_type", "child0_rows", "node_count", "filter_or"
        )
    )
