"""Plan logs: JSON plan trees to node rows and to one metrics row per plan.

A plan is one JSON text per row.  The whole tree is unfolded inside its row by
built-in higher-order functions over VARIANT values, level by level, so there
is no shuffle, no Python and no limit on the number of plans.  The number of
levels is bounded per row by the number of times its text says "Plans" or "children".

Plans may be raw EXPLAIN output or the normalized form that observations store: ``node_type``, ``total_cost``,
``actual_time_ms``, ``rows``, ``children`` and, as a raw node, ``highest_cost_node``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Plan field names and the node types that are counted.
JOIN_TYPES = ("Nested Loop", "Hash Join", "Merge Join")
COUNTED = {
    "seq_scans": "Seq Scan",
    "index_scans": "Index Scan",
    "nested_loops": "Nested Loop",
    "hash_joins": "Hash Join",
}

# Actions suggested per diagnosis; the last entry is for anything else.
SUGGESTED_ACTIONS = {
    "SEQ_SCAN_SELECTIVE_FILTER": ["push_filter", "suggest_index", "add_cte"],
    "NESTED_LOOP_HIGH_CARDINALITY": ["rewrite_join", "add_cte", "reorder_joins"],
    "MISSING_INDEX_FILTER": ["suggest_index", "push_filter"],
    "SUBQUERY_MATERIALIZABLE": ["add_cte", "push_filter"],
    "MULTI_JOIN_NO_STATS": ["reorder_joins", "add_cte", "rewrite_join"],
    "ALREADY_OPTIMAL": ["push_filter", "limit_early"],
}
DEFAULT_ACTIONS = ["push_filter"]

_EMPTY = "cast(array() as array<{}>)"
_FRONT = "struct<path:array<int>,joins:int,raw:variant>"
_NODE = (
    "struct<path:array<int>,depth:int,joins:int,node_type:string,total_cost:double,actual_time_ms:double,"
    "rows:bigint,raw:variant>"
)


def _get(source: str, name: str, kind: str) -> str:
    return f"try_variant_get({source}, '$[\"{name}\"]', '{kind}')"


def _either(source: str, raw: str, normalized: str, kind: str, default: str) -> str:
    """A field under its raw or its normalized name."""
    return f"coalesce({_get(source, raw, kind)}, {_get(source, normalized, kind)}, {default})"


def _is_join(source: str) -> str:
    types = ", ".join(f"'{t}'" for t in JOIN_TYPES)
    return f"if({_either(source, 'Node Type', 'node_type', 'string', chr(39) * 2)} in ({types}), 1, 0)"


def _typed(front: str) -> str:
    raw = f"{front}.raw"
    return f"""named_struct(
        'path', {front}.path, 'depth', size({front}.path), 'joins', {front}.joins,
        'node_type', {_either(raw, 'Node Type', 'node_type', 'string', "'unknown'")},
        'total_cost', {_either(raw, 'Total Cost', 'total_cost', 'double', '0D')},
        'actual_time_ms', {_either(raw, 'Actual Total Time', 'actual_time_ms', 'double', '0D')},
        'rows', {_either(raw, 'Actual Rows', 'rows', 'bigint', '0L')},
        'raw', coalesce({_get(raw, 'highest_cost_node', 'variant')}, {raw}))"""


def _unfold(plans: DataFrame, preorder: bool = False) -> DataFrame:
    """Add ``_nodes``: all nodes of the tree, level by level or in preorder; the root is first either way."""
    rooted = plans.withColumn("_doc", F.expr("try_parse_json(plan_json)")).withColumn(
        "_root",
        F.expr("coalesce(try_variant_get(_doc, '$[0].Plan', 'variant'), try_variant_get(_doc, '$.Plan', 'variant'), _doc)"),
    )
    levels = "1 + regexp_count(plan_json, '\"(Plans|children)\"')"
    children = _either("f.raw", "Plans", "children", "array<variant>", _EMPTY.format("variant"))
    step = f"""named_struct(
        'done', concat(a.done, transform(a.front, f -> {_typed('f')})),
        'front', flatten(transform(a.front, f -> transform({children}, (c, i) ->
            named_struct('path', concat(f.path, array(i)), 'joins', f.joins + {_is_join('c')}, 'raw', c)))))"""
    start = f"""named_struct(
        'done', {_EMPTY.format(_NODE)},
        'front', cast(array(named_struct('path', {_EMPTY.format('int')}, 'joins', {_is_join('_root')}, 'raw', _root)) as array<{_FRONT}>))"""
    # the bound is generous for wide trees, so steps after the last level pass the result on
    nodes = f"aggregate(sequence(1, coalesce({levels}, 1)), {start}, (a, i) -> if(size(a.front) = 0, a, {step}), a -> a.done)"
    if preorder:  # the order of the paths
        nodes = f"array_sort({nodes}, (l, r) -> case when l.path < r.path then -1 when l.path > r.path then 1 else 0 end)"
    return rooted.withColumn("_nodes", F.expr(nodes)).drop("_doc", "_root")


def plan_nodes(plans: DataFrame) -> DataFrame:
    """One row per plan node.

    ``path`` is the list of child indexes from the root; ``joins`` counts join
    nodes from the root down to the node; ``self_cost`` is the cost without the
    direct children.  Unreadable JSON gives one node with default values.
    """
    keep = [c for c in plans.columns if c != "plan_json"]
    children = "filter(_nodes, c -> c.depth = n.depth + 1 and slice(c.path, 1, n.depth) = n.path)"
    self_cost = f"n.total_cost - aggregate({children}, 0D, (s, c) -> s + c.total_cost)"
    flat = f"""transform(_nodes, (n, i) -> named_struct(
        'preorder', i, 'depth', n.depth, 'path', array_join(cast(n.path as array<string>), '.'),
        'parent', if(n.depth > 0, array_join(cast(slice(n.path, 1, n.depth - 1) as array<string>), '.'), null),
        'node_type', n.node_type, 'total_cost', n.total_cost, 'actual_time_ms', n.actual_time_ms, 'rows', n.rows,
        'joins', n.joins, 'self_cost', {self_cost}))"""
    # the outer form: there always is a root, and the plain form would unfold the tree again to test for emptiness
    return _unfold(plans, preorder=True).select(*keep, F.explode_outer(F.expr(flat)).alias("_n")).select(*keep, "_n.*")


def count_node_type(nodes: str, node_type: str) -> Column:
    """Number of nodes of exactly one type in an unfolded tree."""
    return F.expr(f"size(filter({nodes}, n -> n.node_type = '{node_type}'))")


def plan_metrics(plans: DataFrame, keep_text: bool = False) -> DataFrame:
    """One row per plan: root values, node counts, join depth, the costliest node, first child, OR filter flags.

    A narrow transformation: one row in, one row out.
    """
    keep = [c for c in plans.columns if keep_text or c != "plan_json"]
    tree = _unfold(plans)
    root = F.element_at("_nodes", 1)
    # the first node in preorder (the least path) among those that reach the highest cost
    highest = F.expr("array_max(transform(_nodes, n -> n.total_cost))")
    tied = F.expr("filter(_nodes, n -> n.total_cost = _highest)")
    top = F.expr("get(filter(_tied, n -> size(_tied) = 1 or n.path = array_min(transform(_tied, m -> m.path))), 0)")
    child = F.expr("get(filter(_nodes, n -> n.depth = 1), 0)")
    tree = tree.withColumn("_highest", highest).withColumn("_tied", tied)
    tree = tree.withColumns({"_r": root, "_top": top, "_child": child})
    # what a serialized summary shows: node types everywhere, other fields inside the costliest node of every subtree,
    # that is inside each node that no node below it exceeds
    shown = "filter(_nodes, n -> not exists(_nodes, d -> d.depth > n.depth and d.total_cost > n.total_cost and slice(d.path, 1, n.depth) = n.path))"
    summary = F.lower(
        F.concat_ws(
            " ", F.expr(f"array_join(transform({shown}, n -> to_json(n.raw)), ' ')"), F.array_join(F.transform("_nodes", lambda n: n["node_type"]), '", "')
        )
    )
    whole = F.lower("plan_json")

    # a log may say outright that the query has an OR
    forced = F.coalesce(F.col("query_has_or"), F.lit(False)) if "query_has_or" in plans.columns else F.lit(False)

    def has_or(text: Column) -> Column:
        # one pattern: the text is made once
        return F.coalesce(text.rlike("(?s) or .*filter|filter.* or "), F.lit(False))

    # a summary has no letters that its plan has not, unless escaped: most plans need none
    possible = (whole.contains("filter") & whole.contains("or")) | whole.contains("\\")

    return tree.select(
        *keep,
        F.col("_r.node_type").alias("node_type"),
        F.col("_r.total_cost").alias("total_cost"),
        F.col("_r.actual_time_ms").alias("actual_time_ms"),
        F.col("_r.rows").alias("rows"),
        *[count_node_type("_nodes", kind).alias(name) for name, kind in COUNTED.items()],
        F.array_max(F.transform("_nodes", lambda n: n["joins"])).alias("join_depth"),
        F.col("_top.node_type").alias("top_node_type"),
        F.col("_top.total_cost").alias("top_node_cost"),
        F.array_join(F.col("_top.path").cast("array<string>"), ".").alias("top_node_path"),
        F.coalesce("_child.rows", F.lit(0).cast("long")).alias("child0_rows"),
        F.coalesce("_child.node_type", F.lit("")).alias("child0_node_type"),
        F.size("_nodes").alias("node_count"),
        (F.when(possible, has_or(summary)).otherwise(F.lit(False)) | forced).alias("filter_or"),
        has_or(whole).alias("filter_or_text"),
    )


def diagnosis() -> Column:
    """The first bottleneck rule that applies to a metrics row."""
    seq, index, loops = (F.coalesce(F.col(c), F.lit(0)) for c in ("seq_scans", "index_scans", "nested_loops"))
    rows, time = F.coalesce(F.col("rows"), F.lit(0)), F.coalesce(F.col("actual_time_ms"), F.lit(0.0))
    kind = F.coalesce(F.col("node_type"), F.lit(""))
    return (
        F.when((seq > 0) & (time > 500), "SEQ_SCAN_SELECTIVE_FILTER")
        .when((loops > 0) & (rows > 50000), "NESTED_LOOP_HIGH_CARDINALITY")
        .when((seq > 0) & (index == 0), "MISSING_INDEX_FILTER")
        .when(kind.contains("Subquery") | kind.contains("SubPlan"), "SUBQUERY_MATERIALIZABLE")
        .when(F.coalesce(F.col("join_depth"), F.lit(0)) > 2, "MULTI_JOIN_NO_STATS")
        .otherwise("ALREADY_OPTIMAL")
    )


def suggested_actions(name: Column) -> Column:
    """Actions for a diagnosis, best first."""

    def literal(actions: list[str]) -> Column:
        return F.array(*[F.lit(a) for a in actions])

    chain = F.when(F.lit(False), literal(DEFAULT_ACTIONS))
    for key, actions in SUGGESTED_ACTIONS.items():
        chain = chain.when(name == key, literal(actions))
    return chain.otherwise(literal(DEFAULT_ACTIONS))


def cost_hotspot() -> Column:
    """The costliest node and its share of the plan's cost, as text.

    A total of zero or null counts as 1, as does a plan without a cost.
    """
    total = F.coalesce(F.nullif(F.col("total_cost"), F.lit(0.0)), F.lit(1.0))
    share = F.when(total > 0, F.col("top_node_cost") / total * 100).otherwise(F.lit(0.0))
    return F.format_string("%s (%s%% of total cost)", F.col("top_node_type"), F.bround(share, 0).cast("decimal(38,0)").cast("string"))


def rows_scanned_ratio(largest_table: int) -> Column:
    """Root rows relative to the largest table, at most 1."""
    if largest_table <= 0:
        return F.lit(0.0)
    return F.least(F.col("rows").cast("double") / F.lit(float(largest_table)), F.lit(1.0))


def observe(plans: DataFrame, largest_table: int) -> DataFrame:
    """Metrics plus diagnosis, suggested actions, hotspot text and rows ratio for every plan."""
    return (
        plan_metrics(plans)
        .withColumn("bottleneck_diagnosis", diagnosis())
        .withColumn("suggested_actions", suggested_actions(F.col("bottleneck_diagnosis")))
        .withColumn("cost_hotspot", cost_hotspot())
        .withColumn("rows_scanned_ratio", rows_scanned_ratio(largest_table))
    )


def sample_observations(observations: DataFrame, n: int, level: int = 1) -> DataFrame:
    """The first ``n`` observations by seed at one level whose plan has a sequential scan."""
    wanted = (F.col("task_level") == level) & (F.coalesce(F.col("seq_scans"), F.lit(0)) >= 1)
    return observations.filter(wanted).orderBy("seed", *[c for c in ("plan_id",) if c in observations.columns]).limit(max(1, n))
