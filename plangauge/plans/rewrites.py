"""Rewrite pairs: a slow and a fast form of the same question.

The slow forms are written the way they are found, so that the pair can be
compared; ``guard`` states when both forms must agree.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plangauge.plans.tpch import net_total, pricing_summary

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class RewritePair:
    name: str
    before: Callable[..., DataFrame]
    after: Callable[..., DataFrame]
    guard: str


def _day(value: str):
    return F.lit(dt.date.fromisoformat(value))


# filter pushdown -----------------------------------------------------------------


def late_filter(t: Tables, status: str = "F", first: str = "1993-01-01", last: str = "1993-12-31") -> DataFrame:
    joined = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    kept = joined.filter((F.col("o_orderstatus") == status) & F.col("o_orderdate").between(_day(first), _day(last)))
    return kept.select("o_orderkey", "c_name", "o_totalprice")


def early_filter(t: Tables, status: str = "F", first: str = "1993-01-01", last: str = "1993-12-31") -> DataFrame:
    kept = t["orders"].filter((F.col("o_orderstatus") == status) & F.col("o_orderdate").between(_day(first), _day(last)))
    return kept.join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


# aggregation below the join ------------------------------------------------------


def revenue_after_join(t: Tables, day: str = "1994-12-25") -> DataFrame:
    joined = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.filter(F.col("o_orderdate") < _day(day)).groupBy("o_orderkey").agg(net_total().alias("revenue"))


def revenue_before_join(t: Tables, day: str = "1994-12-25") -> DataFrame:
    sums = t["lineitem"].groupBy("l_orderkey").agg(net_total().alias("revenue"))
    wanted = t["orders"].filter(F.col("o_orderdate") < _day(day)).select("o_orderkey")
    return wanted.join(sums, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "revenue")


# correlated subquery to grouped join ---------------------------------------------

CORRELATED_SQL = """
SELECT p.p_partkey, p.p_retailprice
FROM {part} p
WHERE p.p_retailprice > (SELECT 0.2 * AVG(ps.ps_supplycost) FROM {partsupp} ps WHERE ps.ps_partkey = p.p_partkey)
"""


def correlated_threshold(t: Tables) -> DataFrame:
    spark = t["part"].sparkSession
    return spark.sql(CORRELATED_SQL, part=t["part"], partsupp=t["partsupp"])


def grouped_threshold(t: Tables) -> DataFrame:
    limits = t["partsupp"].groupBy("ps_partkey").agg((F.lit(0.2).cast("decimal(2,1)") * F.avg("ps_supplycost")).alias("_limit"))
    joined = t["part"].join(limits, F.col("p_partkey") == F.col("ps_partkey"))
    return joined.filter(F.col("p_retailprice") > F.col("_limit")).select("p_partkey", "p_retailprice")


# early aggregation ---------------------------------------------------------------


def order_part_after_join(t: Tables) -> DataFrame:
    joined = t["lineitem"].join(t["orders"].select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderkey", "l_partkey").agg(net_total().alias("s"))


def order_part_before_join(t: Tables) -> DataFrame:
    sums = t["lineitem"].groupBy("l_orderkey", "l_partkey").agg(net_total().alias("s"))
    joined = t["orders"].select("o_orderkey").join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("o_orderkey", "l_partkey", "s")


# join order ----------------------------------------------------------------------


def fact_first(t: Tables) -> DataFrame:
    return (
        t["lineitem"]
        .join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "c_name")
    )


def small_first(t: Tables) -> DataFrame:
    return (
        t["orders"]
        .join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey"))
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "c_name")
    )


# limit pushdown ------------------------------------------------------------------

LATEST = [F.desc, F.desc, F.asc, F.asc, F.asc]
LATEST_BY = ["l_shipdate", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"]


def _latest():
    return [direction(name) for direction, name in zip(LATEST, LATEST_BY)]


def top_of_all(t: Tables, n: int = 100) -> DataFrame:
    return t["lineitem"].orderBy(*_latest()).limit(n).select("l_orderkey", "l_extendedprice")


def top_of_recent(t: Tables, n: int = 100) -> DataFrame:
    """Only days that the first ``n`` rows can come from are sorted; the bound is taken from the rows per day (one row a day)."""
    lines = t["lineitem"]
    recent = lines.sparkSession.sql(
        """SELECT * FROM {lines} WHERE l_shipdate >= (SELECT MIN(day) FROM (
            SELECT l_shipdate AS day, SUM(COUNT(*)) OVER (ORDER BY l_shipdate DESC) - COUNT(*) AS later FROM {lines} GROUP BY l_shipdate) WHERE later < {n})""",
        lines=lines,
        n=n,
    )
    return recent.orderBy(*_latest()).limit(n).select("l_orderkey", "l_extendedprice")


# OR split ------------------------------------------------------------------------


def either_status(t: Tables, first: str = "F", second: str = "O") -> DataFrame:
    status = F.col("o_orderstatus")
    return t["orders"].filter((status == first) | (status == second)).select("o_orderkey", "o_totalprice")


def split_status(t: Tables, first: str = "F", second: str = "O") -> DataFrame:
    """The second branch leaves out what the first has taken, so overlapping branches stay right."""
    status = F.col("o_orderstatus")
    one = t["orders"].filter(status == first)
    two = t["orders"].filter((status == second) & ~F.coalesce(status == first, F.lit(False)))
    columns = ["o_orderkey", "o_totalprice"]
    return one.select(*columns).unionByName(two.select(*columns))


# date typing ---------------------------------------------------------------------


def summary_by_date(t: Tables) -> DataFrame:
    return pricing_summary(t["lineitem"])


def summary_by_timestamp(t: Tables) -> DataFrame:
    cutoff = F.to_date(F.expr("timestamp_ntz'1998-12-01' - interval '90' day"))
    return pricing_summary(t["lineitem"], cutoff=cutoff)


PAIRS: dict[str, RewritePair] = {
    "R1": RewritePair("filter_pushdown", late_filter, early_filter, "always"),
    "R2": RewritePair("preaggregate", revenue_after_join, revenue_before_join, "orders.o_orderkey is unique"),
    "R3": RewritePair("subquery_to_cte", correlated_threshold, grouped_threshold, "always"),
    "R4": RewritePair("early_aggregation", order_part_after_join, order_part_before_join, "orders.o_orderkey is unique"),
    "R5": RewritePair("join_reorder", fact_first, small_first, "always"),
    "R6": RewritePair("limit_pushdown", top_of_all, top_of_recent, "always"),
    "R7": RewritePair("or_split", either_status, split_status, "always (branches made disjoint)"),
    "R8": RewritePair("date_typing", summary_by_date, summary_by_timestamp, "always"),
}


def guard_holds(pair_id: str, t: Tables, **parameters) -> bool | None:
    """Check the condition under which a pair must agree; ``None`` when there is nothing to check."""
    if pair_id in ("R2", "R4"):
        twice = t["orders"].groupBy("o_orderkey").agg(F.count("*").alias("n")).filter("n > 1")
        return twice.isEmpty()
    return None
