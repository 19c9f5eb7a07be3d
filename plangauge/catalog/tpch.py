"""Workload queries, rewrite pairs and result equality over the given relations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plangauge.catalog.base import Catalog, plain, tables
from plangauge.operators import equality
from plangauge.plans import rewrites, tpch
from plangauge.sources.standins import standin, with_views

CATALOG = Catalog()
Q = CATALOG.query
LI, OD, PS = "typed_lineitem", "typed_orders", "partsupp"
D = dt.date


@Q(
    "Q1_pricing_summary",
    (LI,),
    """SELECT l_returnflag, l_linestatus, CAST(SUM(l_quantity) AS DOUBLE) AS sum_qty,
    CAST(SUM(l_extendedprice) AS DOUBLE) AS sum_base_price,
    CAST(ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS sum_disc_price,
    CAST(ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS DOUBLE) AS sum_charge,
    ROUND(CAST(SUM(l_quantity) AS DOUBLE) / COUNT(*), 4) AS avg_qty,
    ROUND(CAST(SUM(l_extendedprice) AS DOUBLE) / COUNT(*), 4) AS avg_price,
    ROUND(CAST(SUM(l_discount) AS DOUBLE) / COUNT(*), 4) AS avg_disc, COUNT(*) AS count_order
    FROM typed_lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
def q1(spark, d):
    return plain(tpch.pricing_summary(**tables(spark, d, "lineitem")), 2, avg_qty=4, avg_price=4, avg_disc=4)


@Q(
    "Q6_forecast_revenue",
    (LI,),
    """SELECT CAST(ROUND(SUM(l_extendedprice * l_discount), 2) AS DOUBLE) AS revenue FROM typed_lineitem
    WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'
    AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
)
def q6(spark, d):
    return plain(tpch.forecast_revenue(**tables(spark, d, "lineitem"), start=D(1996, 1, 1)), 2)


@Q(
    "Q14_promotion_share",
    (LI,),
    """SELECT ROUND(1e2 * CAST(SUM(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) AS DOUBLE)
    / CAST(SUM(l_extendedprice * (1 - l_discount)) AS DOUBLE), 6) AS promo_revenue
    FROM typed_lineitem, part WHERE l_partkey = p_partkey
    AND l_shipdate >= DATE '1995-09-01' AND l_shipdate < DATE '1995-10-01'""",
)
def q14(spark, d):
    return plain(tpch.promotion_share(**tables(spark, d, "lineitem", "part")))


@Q(
    "Q3_shipping_priority",
    (LI, OD),
    """SELECT l_orderkey, CAST(ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS revenue, o_orderdate
    FROM customer, typed_orders, typed_lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey
    AND l_orderkey = o_orderkey AND o_orderdate < DATE '1995-03-15' AND l_shipdate > DATE '1995-03-15'
    GROUP BY l_orderkey, o_orderdate
    ORDER BY SUM(l_extendedprice * (1 - l_discount)) DESC, o_orderdate, l_orderkey LIMIT 10""",
)
def q3(spark, d):
    return plain(tpch.shipping_priority(**tables(spark, d, "customer", "orders", "lineitem")), 2)


@Q(
    "Q5_local_supplier_volume",
    (LI, OD),
    """SELECT n_name, CAST(ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS revenue
    FROM customer, typed_orders, typed_lineitem, supplier, nation, region
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
    AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
    AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY n_name""",
)
def q5(spark, d):
    t = tables(spark, d, "customer", "orders", "lineitem", "supplier", "nation", "region")
    return plain(tpch.local_supplier_volume(**t, start=D(1996, 1, 1)), 2)


@Q(
    "Q10_returned_items",
    (LI, OD),
    """SELECT c_custkey, c_name, CAST(ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS revenue, c_acctbal, n_name
    FROM customer, typed_orders, typed_lineitem, nation
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01'
    AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
    GROUP BY c_custkey, c_name, c_acctbal, n_name
    ORDER BY SUM(l_extendedprice * (1 - l_discount)) DESC, c_custkey LIMIT 20""",
)
def q10(spark, d):
    t = tables(spark, d, "customer", "orders", "lineitem", "nation")
    return plain(tpch.returned_items(**t, start=D(1996, 10, 1)), 2)


@Q(
    "Q12_ship_mode_priority",
    (LI,),
    """SELECT l_returnflag, SUM(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS high_line_count,
    SUM(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS low_line_count
    FROM orders, typed_lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R')
    AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY l_returnflag""",
)
def q12(spark, d):
    # the given line items have no ship mode or receipt date
    t = tables(spark, d, "orders", "lineitem")
    return tpch.ship_mode_priority(**t, modes=("A", "R"), start=D(1996, 1, 1), mode="l_returnflag", receipt="l_shipdate")


Q2_SQL = """SELECT CAST(s_acctbal AS DOUBLE) AS s_acctbal, s_name, n_name, p_partkey FROM part, supplier, partsupp, nation, region
    WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size = 15 AND p_type LIKE '%ALL'
    AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
    AND ps_supplycost = (SELECT MIN(ps_supplycost) FROM partsupp, supplier, nation, region
      WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND s_nationkey = n_nationkey
      AND n_regionkey = r_regionkey AND r_name = 'EUROPE')
    ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100"""


@Q("Q2_minimum_cost_supplier", (PS,), Q2_SQL)
def q2(spark, d):
    t = tables(spark, d, "part", "supplier", "partsupp", "nation", "region")
    return plain(tpch.minimum_cost_supplier(**t, suffix="ALL"), 2)


@Q("Q2_minimum_cost_supplier_sql", (PS,), Q2_SQL)
def q2_sql(spark, d):
    t = tables(spark, d, "part", "supplier", "partsupp", "nation", "region")
    given = ",\n".join(f"{name} AS (SELECT * FROM {{given_{name}}})" for name in t)
    text = tpch.MINIMUM_COST_SQL.format(size=15, suffix="ALL", region="EUROPE", n=100)
    return plain(spark.sql(f"WITH {given}\n{text}", **{f"given_{name}": df for name, df in t.items()}), 2)


@Q(
    "Q9_product_profit",
    (LI, OD, PS),
    """SELECT n_name AS nation, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS o_year,
    CAST(ROUND(SUM(l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity), 2) AS DOUBLE) AS sum_profit
    FROM part, supplier, typed_lineitem, partsupp, typed_orders, nation
    WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey
    AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%red%' GROUP BY 1, 2""",
)
def q9(spark, d):
    t = tables(spark, d, "part", "supplier", "lineitem", "partsupp", "orders", "nation")
    return plain(tpch.product_profit(**t, word="red"), 2)


@Q(
    "Q17_small_quantity_revenue",
    (LI,),
    """SELECT ROUND(CAST(SUM(l_extendedprice) AS DOUBLE) / 7.0, 4) AS avg_yearly FROM typed_lineitem l, part
    WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND p_size BETWEEN 1 AND 25
    AND l_quantity < (SELECT 0.2 * AVG(l_quantity) FROM typed_lineitem i WHERE i.l_partkey = p_partkey)""",
)
def q17(spark, d):
    # the given parts have no container
    wanted = (F.col("p_brand") == "Brand#23") & F.col("p_size").between(1, 25)
    return plain(tpch.small_quantity_revenue(**tables(spark, d, "lineitem", "part"), wanted=wanted), 4)


# Rewrite pairs ----------------------------------------------------------------------

_NET = "l_extendedprice * (1 - l_discount)"
_R1 = "o_orderstatus = 'F' AND o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"
_LATEST = "ORDER BY l_shipdate DESC, l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey"
_R1_ARGS = {"first": "1996-01-01", "last": "1996-12-31"}
_R2_ARGS = {"day": "1998-12-25"}
_DAY = "1998-09-02"

# pair -> (arguments for the given data, views, before SQL, after SQL, digits)
PAIR_SQL: dict[str, tuple[dict, tuple[str, ...], str, str]] = {
    "R1": (
        _R1_ARGS,
        (OD,),
        f"SELECT o_orderkey, c_name, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM typed_orders JOIN customer ON o_custkey = c_custkey WHERE {_R1}",
        f"SELECT o_orderkey, c_name, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM (SELECT * FROM typed_orders WHERE {_R1}) f JOIN customer ON o_custkey = c_custkey",
    ),
    "R2": (
        _R2_ARGS,
        (LI, OD),
        f"SELECT o_orderkey, CAST(ROUND(SUM({_NET}), 2) AS DOUBLE) AS revenue FROM typed_lineitem JOIN typed_orders ON l_orderkey = o_orderkey WHERE o_orderdate < DATE '1998-12-25' GROUP BY o_orderkey",
        f"SELECT o_orderkey, revenue FROM typed_orders JOIN (SELECT l_orderkey, CAST(ROUND(SUM({_NET}), 2) AS DOUBLE) AS revenue FROM typed_lineitem GROUP BY l_orderkey) s ON o_orderkey = l_orderkey WHERE o_orderdate < DATE '1998-12-25'",
    ),
    "R3": (
        {},
        (PS,),
        "SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS p_retailprice FROM part WHERE CAST(p_retailprice AS DECIMAL(15,2)) > (SELECT 0.2 * AVG(ps_supplycost) FROM partsupp WHERE ps_partkey = p_partkey)",
        "SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS p_retailprice FROM part JOIN (SELECT ps_partkey, 0.2 * AVG(ps_supplycost) AS thr FROM partsupp GROUP BY ps_partkey) a ON p_partkey = ps_partkey WHERE CAST(p_retailprice AS DECIMAL(15,2)) > thr",
    ),
    "R4": (
        {},
        (LI,),
        f"SELECT o_orderkey, l_partkey, CAST(ROUND(SUM({_NET}), 2) AS DOUBLE) AS s FROM typed_lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey, l_partkey",
        f"SELECT o_orderkey, l_partkey, s FROM orders JOIN (SELECT l_orderkey, l_partkey, CAST(ROUND(SUM({_NET}), 2) AS DOUBLE) AS s FROM typed_lineitem GROUP BY l_orderkey, l_partkey) x ON o_orderkey = l_orderkey",
    ),
    "R5": (
        {},
        (),
        "SELECT o_orderkey, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey",
        "SELECT o_orderkey, c_name FROM orders o JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey",
    ),
    "R6": (
        {},
        (LI,),
        f"SELECT l_orderkey, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice FROM (SELECT * FROM typed_lineitem {_LATEST} LIMIT 100) x",
        f"SELECT l_orderkey, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice FROM (SELECT * FROM typed_lineitem WHERE l_shipdate >= (SELECT MIN(l_shipdate) FROM (SELECT l_shipdate FROM typed_lineitem ORDER BY l_shipdate DESC LIMIT 100) d) {_LATEST} LIMIT 100) x",
    ),
    "R7": (
        {},
        (),
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O'",
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'",
    ),
    "R8": (
        {},
        (LI,),
        f"SELECT l_returnflag, l_linestatus, CAST(ROUND(SUM({_NET}), 2) AS DOUBLE) AS sum_disc_price, COUNT(*) AS count_order FROM typed_lineitem WHERE l_shipdate <= DATE '{_DAY}' GROUP BY l_returnflag, l_linestatus",
        f"SELECT l_returnflag, l_linestatus, CAST(ROUND(SUM({_NET}), 2) AS DOUBLE) AS sum_disc_price, COUNT(*) AS count_order FROM typed_lineitem WHERE l_shipdate <= CAST(TIMESTAMP '1998-12-01' - INTERVAL 90 DAY AS DATE) GROUP BY l_returnflag, l_linestatus",
    ),
}
_R8_COLUMNS = ["l_returnflag", "l_linestatus", "sum_disc_price", "count_order"]


def _register_pair(pair_id: str) -> None:
    pair = rewrites.PAIRS[pair_id]
    arguments, views, before_sql, after_sql = PAIR_SQL[pair_id]
    names = ("orders", "customer", "lineitem", "part")

    def load(spark, d):
        t = tables(spark, d, *names)
        if pair_id == "R3":
            t["partsupp"] = standin(spark, d, PS)
        return t

    def shown(df):
        return plain(df.select(*_R8_COLUMNS) if pair_id == "R8" else df, 2)

    CATALOG.add(f"{pair_id}_{pair.name}_before", lambda s, d: shown(pair.before(load(s, d), **arguments)), views, before_sql)
    CATALOG.add(f"{pair_id}_{pair.name}_after", lambda s, d: shown(pair.after(load(s, d), **arguments)), views, after_sql)

    def equal(spark, d):
        t = load(spark, d)
        return equality.same_result(shown(pair.before(t, **arguments)), shown(pair.after(t, **arguments)))

    CATALOG.add(
        f"{pair_id}_{pair.name}_same_result",
        equal,
        views,
        f"""WITH b AS ({before_sql}), a AS ({after_sql})
        SELECT (SELECT COUNT(*) FROM b) AS rows_before, (SELECT COUNT(*) FROM a) AS rows_after,
        NOT EXISTS (SELECT * FROM b EXCEPT ALL SELECT * FROM a) AND NOT EXISTS (SELECT * FROM a EXCEPT ALL SELECT * FROM b) AS same_result""",
    )


for _pair_id in PAIR_SQL:
    _register_pair(_pair_id)


# Result equality ----------------------------------------------------------------------


def _digest_sql(columns: list[str]) -> str:
    parts = [
        f"CASE WHEN {c} IS NULL THEN '~' ELSE CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"
        for c in columns
    ]
    return "md5(concat_ws('|', " + ", ".join(parts) + "))"


_SUMS = """COUNT(*) AS row_count, CAST(SUM(CAST(CAST('0x' || substr(h, 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS sum_a,
    CAST(SUM(CAST(CAST('0x' || substr(h, 16, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS sum_b"""
_FP_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def _as_text(df):
    return df.select("row_count", F.col("sum_a").cast("string").alias("sum_a"), F.col("sum_b").cast("string").alias("sum_b"))


@Q(
    "X1_ordered_fingerprint",
    (),
    f"""SELECT {_SUMS} FROM (SELECT md5(CAST(row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS VARCHAR) || '|' || h) AS h
    FROM (SELECT o_orderpriority, o_orderkey, {_digest_sql(_FP_COLUMNS)} AS h FROM orders) a) b""",
)
def x1(spark, d):
    rows = tables(spark, d, "orders")["orders"].select(*_FP_COLUMNS)
    return _as_text(equality.ordered_fingerprint(rows, [F.col("o_orderpriority"), F.col("o_orderkey")]))


@Q("X2_fingerprint", (), f"SELECT {_SUMS} FROM (SELECT {_digest_sql(_FP_COLUMNS)} AS h FROM orders) a")
def x2(spark, d):
    return _as_text(equality.fingerprint(tables(spark, d, "orders")["orders"].select(*_FP_COLUMNS)))


@Q(
    "X3_changed_results",
    ("attempts", "initial_obs"),
    """SELECT a.run_id, COUNT(*) AS attempts, COUNT(*) FILTER (i.run_id IS NOT NULL AND new_hash IS DISTINCT FROM base_hash) AS changed,
    COUNT(*) FILTER (i.run_id IS NULL) AS without_baseline FROM attempts a LEFT JOIN initial_obs i ON a.run_id = i.run_id AND a.episode_id = i.episode_id GROUP BY a.run_id""",
)
def x3(spark, d):
    rows = equality.changed_results(standin(spark, d, "attempts"), standin(spark, d, "initial_obs"), ["run_id", "episode_id"])
    return rows.groupBy("run_id").agg(
        F.count("*").alias("attempts"), F.count_if(F.coalesce("result_changed", F.lit(False))).alias("changed"), F.count_if(~F.col("has_baseline")).alias("without_baseline")
    )


@Q(
    "X4_differing_rows",
    (),
    """WITH b AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 1e5),
    a AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'),
    x AS (SELECT * FROM b EXCEPT ALL SELECT * FROM a), y AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
    SELECT * FROM (SELECT o_orderkey, o_orderstatus, 'only_before' AS side FROM x ORDER BY 1, 2 LIMIT 5) p
    UNION ALL SELECT * FROM (SELECT o_orderkey, o_orderstatus, 'only_after' AS side FROM y ORDER BY 1, 2 LIMIT 5) q""",
)
def x4(spark, d):
    orders = tables(spark, d, "orders")["orders"]
    columns = ["o_orderkey", "o_orderstatus"]
    before = orders.filter(F.col("o_totalprice") > 100000).select(*columns)
    return equality.differing_rows(before, orders.filter(F.col("o_orderstatus") != "P").select(*columns))


@Q(
    "X4_few_differing_rows",
    (),
    """WITH b AS (SELECT l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem),
    a AS (SELECT l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity + CASE WHEN l_orderkey % 997 = 3 THEN 1 ELSE 0 END AS BIGINT) AS quantity FROM lineitem),
    x AS (SELECT * FROM b EXCEPT ALL SELECT * FROM a), y AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
    SELECT *, 'only_before' AS side FROM x UNION ALL SELECT *, 'only_after' AS side FROM y""",
)
def x4_few(spark, d):
    lines = tables(spark, d, "lineitem")["lineitem"].select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_quantity").cast("long").alias("quantity"))
    changed = lines.withColumn("quantity", F.col("quantity") + F.when(F.col("l_orderkey") % 997 == 3, 1).otherwise(0))
    return plain(equality.few_differing_rows(lines, changed, n=None))


@Q(
    "X5_all_repetitions_match",
    ("timings", "timing_baselines"),
    """SELECT t.query_id, variant, bool_and(result_hash IS NOT DISTINCT FROM base_hash) AS hash_match, COUNT(*) AS repetitions
    FROM timings t JOIN timing_baselines b ON t.query_id = b.query_id GROUP BY t.query_id, variant""",
)
def x5(spark, d):
    return equality.all_repetitions_match(standin(spark, d, "timings"), standin(spark, d, "timing_baselines"))
