"""Rewrite-pattern rules, matched against plan metrics inside each row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Predicate:
    metric: str
    op: str
    ref: float | str | bool | tuple[str, ...]


@dataclass(frozen=True)
class Pattern:
    pattern_id: str
    name: str
    problem: str
    predicates: tuple[Predicate, ...]
    slow_sql: str
    fast_sql: str
    expected_change: str
    target_ratio: float
    queries: tuple[str, ...] = field(default=())


def _where(*triples) -> tuple[Predicate, ...]:
    return tuple(Predicate(*t) for t in triples)


# Pattern ids, thresholds, target ratios and query lists.
PATTERNS: tuple[Pattern, ...] = (
    Pattern(
        "P1_FILTER_PUSHDOWN",
        "Filter pushdown",
        "Every line meets its supplier before the conditions throw most lines away.",
        _where(("seq_scans", "ge", 1), ("rows", "ge", 500_000), ("nested_loops", "ge", 1)),
        "SELECT s_name, l_orderkey, l_quantity FROM supplier JOIN lineitem ON s_suppkey = l_suppkey WHERE "
        "l_returnflag = 'R' AND l_quantity >= 45",
        "SELECT s_name, big.l_orderkey, big.l_quantity FROM (SELECT l_suppkey, l_orderkey, l_quantity FROM "
        "lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45) AS big JOIN supplier ON s_suppkey = "
        "big.l_suppkey",
        "fewer sequential scans and far fewer joined rows",
        0.60,
        ("Q3", "Q5", "Q10"),
    ),
    Pattern(
        "P2_NESTED_LOOP_ELIMINATION",
        "Nested-loop elimination",
        "Counting after the join makes the engine probe the orders of one customer at a time.",
        _where(("nested_loops", "ge", 1), ("rows", "ge", 100_000)),
        "SELECT c_custkey, COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY "
        "c_custkey",
        "SELECT c_custkey, per.n FROM customer JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY "
        "o_custkey) AS per ON per.o_custkey = c_custkey",
        "no nested loops and at least one hash join",
        0.70,
        ("Q3", "Q5", "Q12"),
    ),
    Pattern(
        "P3_SUBQUERY_TO_CTE",
        "Correlated subquery to CTE",
        "The highest price of a customer is looked up again for each of the customer's orders.",
        _where(("nested_loops", "ge", 1), ("total_cost", "ge", 50_000)),
        "SELECT o_orderkey FROM orders AS a WHERE o_totalprice = (SELECT MAX(b.o_totalprice) FROM orders AS b "
        "WHERE b.o_custkey = a.o_custkey)",
        "WITH best AS (SELECT o_custkey, MAX(o_totalprice) AS top FROM orders GROUP BY o_custkey) SELECT "
        "o_orderkey FROM orders JOIN best USING (o_custkey) WHERE o_totalprice = top",
        "a clearly lower total cost",
        0.80,
        ("Q2", "Q17"),
    ),
    Pattern(
        "P4_EARLY_AGGREGATION",
        "Early aggregation",
        "Two joins carry each single line although only a total per nation is asked for.",
        _where(("seq_scans", "ge", 2), ("rows", "ge", 1_000_000)),
        "SELECT n_name, SUM(l_quantity) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation "
        "ON s_nationkey = n_nationkey GROUP BY n_name",
        "SELECT n_name, SUM(per.q) AS q FROM (SELECT l_suppkey, SUM(l_quantity) AS q FROM lineitem GROUP BY "
        "l_suppkey) AS per JOIN supplier ON per.l_suppkey = s_suppkey JOIN nation ON s_nationkey = "
        "n_nationkey GROUP BY n_name",
        "many fewer rows below the top join",
        0.65,
        ("Q1", "Q10", "Q12"),
    ),
    Pattern(
        "P5_JOIN_REORDER",
        "Join reorder",
        "All lines are read to find the parts of one size; those parts could lead the way.",
        _where(("nested_loops", "ge", 1), ("child0_rows", "ge", 1_000_000)),
        "SELECT p_name, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 50",
        "WITH wanted AS (SELECT p_partkey, p_name FROM part WHERE p_size = 50) SELECT p_name, l_quantity FROM "
        "wanted JOIN lineitem ON l_partkey = p_partkey",
        "fewer rows from the driving input",
        0.40,
        ("Q7", "Q8", "Q9"),
    ),
    Pattern(
        "P6_LIMIT_PUSHDOWN",
        "Limit pushdown",
        "Ten customers are shown, yet all of them are joined and put in order first.",
        _where(("node_type", "in", ("limit",)), ("child0_node_type", "in", ("sort",)), ("child0_rows", "ge", 100_000)),
        "SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY c_acctbal "
        "DESC, c_custkey LIMIT 10",
        "WITH rich AS (SELECT c_name, c_acctbal, c_custkey, c_nationkey FROM customer ORDER BY c_acctbal "
        "DESC, c_custkey LIMIT 10) SELECT c_name, n_name FROM rich JOIN nation ON c_nationkey = n_nationkey "
        "ORDER BY c_acctbal DESC, c_custkey",
        "a sort input near the size of the limit",
        0.85,
        ("Q18",),
    ),
    Pattern(
        "P7_PREDICATE_ISOLATION",
        "OR split",
        "Either condition alone could use an index; together they force a look at every part.",
        _where(("seq_scans", "ge", 1), ("filter_or", "eq", True)),
        "SELECT p_partkey FROM part WHERE p_size = 1 OR p_brand = 'Brand#11'",
        "SELECT p_partkey FROM part WHERE p_size = 1 UNION ALL SELECT p_partkey FROM part WHERE p_brand = "
        "'Brand#11' AND p_size <> 1",
        "two index scans and no sequential scan",
        0.55,
        ("Q9", "Q14"),
    ),
)

_COMPARE = {
    "ge": lambda c, v: c >= v,
    "le": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "eq": lambda c, v: c == v,
}


def predicate_column(p: Predicate) -> Column:
    """One predicate over a metrics row. Node types match as case-insensitive parts of the name."""
    if p.metric in ("node_type", "child0_node_type"):
        words = p.ref if isinstance(p.ref, tuple) else (p.ref,)
        name = F.lower(F.coalesce(F.col(p.metric), F.lit("")))
        return F.greatest(F.lit(False), *[name.contains(str(w).lower()) for w in words])
    if isinstance(p.ref, bool):
        return F.coalesce(F.col(p.metric), F.lit(False)) == F.lit(p.ref)
    return _COMPARE[p.op](F.coalesce(F.col(p.metric).cast("double"), F.lit(0.0)), F.lit(float(p.ref)))


def signal_matches(pattern: Pattern) -> Column:
    """All predicates of the pattern hold; a pattern without predicates always matches."""
    result = F.lit(True)
    for predicate in pattern.predicates:
        result = result & predicate_column(predicate)
    return result


def ranked(patterns: tuple[Pattern, ...] = PATTERNS) -> list[Pattern]:
    """Highest target ratio first; equal ratios keep their listed order."""
    return sorted(patterns, key=lambda p: -p.target_ratio)


def matching_ids(
    patterns: tuple[Pattern, ...] = PATTERNS, allowed: list[str] | None = None, k: int | None = None
) -> Column:
    """Ids of the matching patterns, best first: all of them, or the first ``k`` of the allowed ones.

    ``allowed=None`` allows every pattern, an empty list none.
    """
    usable = [p for p in ranked(patterns) if allowed is None or p.pattern_id in allowed]
    if not usable:
        return F.array().cast("array<string>")
    found = F.array_compact(F.array(*[F.when(signal_matches(p), F.lit(p.pattern_id)) for p in usable]))
    return found if k is None else F.slice(found, 1, max(0, k)) if k > 0 else F.array().cast("array<string>")


def applicable_patterns(metrics: DataFrame, key: str = "plan_id", **options) -> DataFrame:
    """One row per plan and matching pattern, ranked from 1."""
    ratios = F.create_map(*[x for p in PATTERNS for x in (F.lit(p.pattern_id), F.lit(p.target_ratio))])
    found = metrics.select(key, F.posexplode_outer(matching_ids(**options)).alias("_at", "pattern_id"))
    return found.filter(F.col("pattern_id").isNotNull()).select(
        key, (F.col("_at") + 1).alias("rank"), "pattern_id", ratios[F.col("pattern_id")].alias("target_ratio")
    )


def rules(spark: SparkSession) -> DataFrame:
    """The rule table (seven rows)."""
    rows = [
        (p.pattern_id, p.name, p.target_ratio, list(p.queries), [(q.metric, q.op, str(q.ref)) for q in p.predicates])
        for p in PATTERNS
    ]
    return spark.createDataFrame(
        rows,
        "pattern_id string, name string, target_ratio double, tpch_queries array<string>, "
        "predicates array<struct<metric:string,op:string,ref:string>>",
    )


def patterns_for_query(query_id: str) -> list[Pattern]:
    """Patterns that list a query; ``"q5"`` and ``"5"`` mean ``"Q5"``."""
    wanted = query_id.strip().upper()
    wanted = wanted if wanted.startswith("Q") else f"Q{wanted}"
    return [p for p in PATTERNS if wanted in p.queries]
