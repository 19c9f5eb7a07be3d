"""The ten workload queries as parameterized DataFrame functions.

Every function takes the relations it needs as DataFrames and has the standard
substitution values as defaults.  Line items are summed per join key before
they meet another relation wherever the query allows it: the partial sums are
combined on the map side, so an order or a part with a huge number of lines
reaches the join as one row.

Money is summed exactly, in whole units of 1/100, 1/10,000 or 1/1,000,000: long
products inside the generated code, decimal totals.  This holds for columns
stored as DECIMAL(15,2) and for doubles that hold two-digit values.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

D = dt.date
_LOW_BITS = 20


def _day(value: dt.date) -> Column:
    return F.lit(value).cast("date")


def _plus(value: dt.date, interval: str) -> Column:
    return F.expr(f"date'{value.isoformat()}' + interval '{interval}'")


def _between_days(column: str, start: dt.date, interval: str) -> Column:
    return (F.col(column) >= _day(start)) & (F.col(column) < _plus(start, interval))


def hundredths(name: str) -> Column:
    """A two-digit value as a whole number of hundredths."""
    return F.rint(F.col(name).cast("double") * 100).cast("long")


def net_units() -> Column:
    """Price after discount in 1/10,000."""
    return hundredths("l_extendedprice") * (F.lit(100) - hundredths("l_discount"))


def charge_units() -> Column:
    """Price after discount and with tax in 1/1,000,000."""
    return net_units() * (F.lit(100) + hundredths("l_tax"))


def total(units: Column, digits: int) -> Column:
    """Exact sum of whole units, as a decimal with ``digits`` places.

    Upper and lower parts are summed as longs, inside the generated code, and meet as a decimal once per
    group.  A sum of either part that leaves 64 bits raises, it does not wrap.
    """
    low = F.sum(units.bitwiseAND(F.lit((1 << _LOW_BITS) - 1))).cast("decimal(20,0)")
    high = F.sum(F.shiftright(units, _LOW_BITS)).cast("decimal(20,0)")
    whole = (high * F.lit(Decimal(1 << _LOW_BITS)) + low).cast("decimal(28,0)")
    return whole * F.lit(Decimal(1).scaleb(-digits))


def net_total() -> Column:
    return total(net_units(), 4)


def _value_between(df: DataFrame, name: str, low: str, high: str) -> Column:
    """Both edges included; on a double column the edges move out by half a hundredth, so no edge value is lost."""
    if isinstance(df.schema[name].dataType, T.DecimalType):
        return F.col(name).between(F.lit(Decimal(low)), F.lit(Decimal(high)))
    return F.col(name).between(float(low) - 0.005, float(high) + 0.005)


def pricing_summary(lineitem: DataFrame, end: dt.date = D(1998, 12, 1), days: int = 90, cutoff: Column | None = None) -> DataFrame:
    """Q1: totals and averages per return flag and line status for lines shipped up to a cutoff."""
    limit = F.expr(f"date'{end.isoformat()}' - interval '{days}' day") if cutoff is None else cutoff
    # every value is made whole once, below the totals
    lines = lineitem.filter(F.col("l_shipdate") <= limit).select(
        "l_returnflag", "l_linestatus", *[hundredths(f"l_{c}").alias(c) for c in ("quantity", "extendedprice", "discount", "tax")]
    )
    lines = lines.withColumn("net", F.col("extendedprice") * (F.lit(100) - F.col("discount")))
    lines = lines.withColumn("charge", F.col("net") * (F.lit(100) + F.col("tax")))
    # hundredths of quantities and discounts are below 2 ** 16, so 2 ** 47 lines and more fit one long
    small = lambda c: F.sum(c).cast("decimal(20,0)") * F.lit(Decimal("0.01"))
    sums = lines.groupBy("l_returnflag", "l_linestatus").agg(
        small("quantity").alias("sum_qty"), total(F.col("extendedprice"), 2).alias("sum_base_price"), total(F.col("net"), 4).alias("sum_disc_price"), total(F.col("charge"), 6).alias("sum_charge"),
        small("discount").alias("sum_disc"), *[F.count(c).alias(f"n_{c}") for c in ("quantity", "extendedprice", "discount")], F.count("*").alias("count_order"),
    )
    means = {"avg_qty": ("sum_qty", "n_quantity"), "avg_price": ("sum_base_price", "n_extendedprice"), "avg_disc": ("sum_disc", "n_discount")}
    return sums.select(
        "l_returnflag", "l_linestatus", "sum_qty", "sum_base_price", "sum_disc_price", "sum_charge",
        *[(F.col(s) / F.col(n)).alias(name) for name, (s, n) in means.items()], "count_order",
    ).orderBy("l_returnflag", "l_linestatus")


def forecast_revenue(
    lineitem: DataFrame, start: dt.date = D(1994, 1, 1), low: str = "0.05", high: str = "0.07", quantity: int = 24
) -> DataFrame:
    """Q6: revenue from discounts in one year; both discount edges count."""
    discount = _value_between(lineitem, "l_discount", low, high)
    return lineitem.filter(
        _between_days("l_shipdate", start, "1 year") & discount & (F.col("l_quantity") < F.lit(quantity))
    ).agg(total(hundredths("l_extendedprice") * hundredths("l_discount"), 4).alias("revenue"))


def promotion_share(lineitem: DataFrame, part: DataFrame, start: dt.date = D(1995, 9, 1), prefix: str = "PROMO") -> DataFrame:
    """Q14: percentage of one month's revenue from promotional parts; null when no line qualifies."""
    per_part = (
        lineitem.filter(_between_days("l_shipdate", start, "1 month"))
        .groupBy("l_partkey")
        .agg(net_total().alias("revenue"))
    )
    promo = F.when(F.col("p_type").startswith(prefix), F.col("revenue")).otherwise(F.lit(0))
    share = F.lit(100).cast("double") * F.sum(promo).cast("double") / F.sum("revenue").cast("double")
    return per_part.join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).agg(
        share.alias("promo_revenue")
    )


def shipping_priority(
    customer: DataFrame,
    orders: DataFrame,
    lineitem: DataFrame,
    segment: str = "BUILDING",
    day: dt.date = D(1995, 3, 15),
    n: int = 10,
) -> DataFrame:
    """Q3: the most valuable unshipped orders of a market segment.

    ``o_shippriority`` takes part when the orders relation has it.
    """
    extra = [c for c in ("o_shippriority",) if c in orders.columns]
    lines = (
        lineitem.filter(F.col("l_shipdate") > _day(day)).groupBy("l_orderkey").agg(net_total().alias("_r"))
    )
    buyers = customer.filter(F.col("c_mktsegment") == segment).select("c_custkey")
    open_orders = orders.filter(F.col("o_orderdate") < _day(day)).select("o_orderkey", "o_custkey", "o_orderdate", *extra)
    return (
        open_orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_orderkey", "o_orderdate", *extra)
        .agg(F.sum("_r").alias("revenue"))
        .select("l_orderkey", "revenue", "o_orderdate", *extra)
        .orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey")
        .limit(n)
    )


def local_supplier_volume(
    customer: DataFrame,
    orders: DataFrame,
    lineitem: DataFrame,
    supplier: DataFrame,
    nation: DataFrame,
    region: DataFrame,
    region_name: str = "ASIA",
    start: dt.date = D(1994, 1, 1),
) -> DataFrame:
    """Q5: revenue per nation where customer and supplier share the nation.

    The region's suppliers cut the lines down before they are shuffled, and the
    nation is part of the join key, so even a huge order is spread.
    """
    nations = nation.join(region.filter(F.col("r_name") == region_name), F.col("n_regionkey") == F.col("r_regionkey"))
    nations = nations.select("n_nationkey", "n_name")
    sellers = supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    year = orders.filter(_between_days("o_orderdate", start, "1 year")).select("o_orderkey", "o_custkey")
    bought = year.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return (
        lineitem.join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(bought, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
        .groupBy("n_name")
        .agg(net_total().alias("revenue"))
        .orderBy(F.desc("revenue"), "n_name")
    )


def returned_items(
    customer: DataFrame,
    orders: DataFrame,
    lineitem: DataFrame,
    nation: DataFrame,
    start: dt.date = D(1993, 10, 1),
    flag: str = "R",
    n: int = 20,
) -> DataFrame:
    """Q10: customers who lost the most revenue to returns in a quarter."""
    extra = [c for c in ("c_address", "c_phone", "c_comment") if c in customer.columns]
    lines = lineitem.filter(F.col("l_returnflag") == flag).groupBy("l_orderkey").agg(net_total().alias("_r"))
    quarter = orders.filter(_between_days("o_orderdate", start, "3 months")).select("o_orderkey", "o_custkey")
    lost = quarter.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("_r").alias("_r"))
    return (
        lost.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("c_custkey", "c_name", "c_acctbal", "n_name", *extra)
        .agg(F.sum("_r").alias("revenue"))
        .select("c_custkey", "c_name", "revenue", "c_acctbal", "n_name", *extra)
        .orderBy(F.desc("revenue"), "c_custkey")
        .limit(n)
    )


def ship_mode_priority(
    orders: DataFrame,
    lineitem: DataFrame,
    modes: tuple[str, ...] = ("MAIL", "SHIP"),
    start: dt.date = D(1994, 1, 1),
    mode: str = "l_shipmode",
    receipt: str = "l_receiptdate",
) -> DataFrame:
    """Q12: late lines per ship mode, split by order priority.

    The two date comparisons apply when the relation has a commit date.
    """
    wanted = F.col(mode).isin(*modes) & _between_days(receipt, start, "1 year")
    if "l_commitdate" in lineitem.columns:
        wanted &= (F.col("l_commitdate") < F.col(receipt)) & (F.col("l_shipdate") < F.col("l_commitdate"))
    # one row per order with a count per mode: a single shuffle by order key serves the grouping and the join
    lines = lineitem.filter(wanted).groupBy("l_orderkey").agg(*[F.count_if(F.col(mode) == m).alias(f"_{m}") for m in modes])
    joined = lines.join(orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    sums = joined.groupBy(urgent.alias("_urgent")).agg(*[F.sum(f"_{m}").alias(m) for m in modes])
    long = sums.unpivot(["_urgent"], list(modes), mode, "_n")
    return (
        long.groupBy(mode)
        .agg(
            F.sum(F.when(F.col("_urgent"), F.col("_n")).otherwise(0)).alias("high_line_count"),
            F.sum(F.when(~F.col("_urgent"), F.col("_n")).otherwise(0)).alias("low_line_count"),
        )
        .filter(F.col("high_line_count") + F.col("low_line_count") > 0)
        .orderBy(mode)
    )


def minimum_cost_supplier(
    part: DataFrame,
    supplier: DataFrame,
    partsupp: DataFrame,
    nation: DataFrame,
    region: DataFrame,
    size: int = 15,
    suffix: str = "BRASS",
    region_name: str = "EUROPE",
    n: int = 100,
) -> DataFrame:
    """Q2: cheapest suppliers of a region for parts of one size and type; ties are kept."""
    part_extra = [c for c in ("p_mfgr",) if c in part.columns]
    seller_extra = [c for c in ("s_address", "s_phone", "s_comment") if c in supplier.columns]
    parts = part.filter((F.col("p_size") == size) & F.col("p_type").endswith(suffix)).select("p_partkey", *part_extra)
    nations = nation.join(region.filter(F.col("r_name") == region_name), F.col("n_regionkey") == F.col("r_regionkey"))
    sellers = supplier.join(nations.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", "s_acctbal", "s_name", "n_name", *seller_extra
    )
    offers = (
        partsupp.select("ps_partkey", "ps_suppkey", "ps_supplycost")
        .join(parts, F.col("ps_partkey") == F.col("p_partkey"))
        .join(sellers, F.col("ps_suppkey") == F.col("s_suppkey"))
    )
    cheapest = offers.groupBy(F.col("p_partkey").alias("_part")).agg(F.min("ps_supplycost").alias("_cost"))
    return (
        offers.join(cheapest, (F.col("p_partkey") == F.col("_part")) & (F.col("ps_supplycost") == F.col("_cost")))
        .select("s_acctbal", "s_name", "n_name", "p_partkey", *part_extra, *seller_extra)
        .orderBy(F.desc("s_acctbal"), "n_name", "s_name", "p_partkey")
        .limit(n)
    )


MINIMUM_COST_SQL = """
SELECT s_acctbal, s_name, n_name, p_partkey
FROM part
JOIN partsupp ON p_partkey = ps_partkey
JOIN supplier ON s_suppkey = ps_suppkey
JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
WHERE p_size = {size} AND p_type LIKE '%{suffix}' AND r_name = '{region}'
  AND ps_supplycost = (
    SELECT MIN(i.ps_supplycost)
    FROM partsupp i
    JOIN supplier s2 ON s2.s_suppkey = i.ps_suppkey
    JOIN nation n2 ON s2.s_nationkey = n2.n_nationkey
    JOIN region r2 ON n2.n_regionkey = r2.r_regionkey
    WHERE i.ps_partkey = p_partkey AND r2.r_name = '{region}')
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey
LIMIT {n}
"""


def product_profit(
    part: DataFrame,
    supplier: DataFrame,
    lineitem: DataFrame,
    partsupp: DataFrame,
    orders: DataFrame,
    nation: DataFrame,
    word: str = "green",
) -> DataFrame:
    """Q9: profit per supplier nation and order year for parts whose name contains a word."""
    parts = part.filter(F.col("p_name").contains(word)).select("p_partkey")
    sellers = supplier.join(nation.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("n_name").alias("nation")
    )
    costs = partsupp.select("ps_partkey", "ps_suppkey", hundredths("ps_supplycost").alias("_cost"))
    amount = net_units() - F.col("_cost") * hundredths("l_quantity")
    return (
        lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(costs, (F.col("ps_suppkey") == F.col("l_suppkey")) & (F.col("ps_partkey") == F.col("l_partkey")))
        .join(sellers, F.col("s_suppkey") == F.col("l_suppkey"))
        .join(orders.select("o_orderkey", F.year("o_orderdate").alias("o_year")), F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("nation", "o_year")
        .agg(total(amount, 4).alias("sum_profit"))
        .orderBy("nation", F.desc("o_year"))
    )


def small_quantity_revenue(
    lineitem: DataFrame, part: DataFrame, wanted: Column | None = None, fraction: str = "0.2", years: str = "7.0"
) -> DataFrame:
    """Q17: yearly revenue lost if lines below a fraction of their part's mean quantity were dropped.

    The lines of the wanted parts are reduced to one row per (part, quantity),
    which is all the mean and the comparison need.  So the line items are read
    once, and the window sees at most the distinct quantities of a part, however
    many lines it has.
    """
    if wanted is None:
        wanted = (F.col("p_brand") == "Brand#23") & (F.col("p_container") == "MED BOX")
    parts = part.filter(wanted).select("p_partkey")
    per_quantity = (
        lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_partkey", "l_quantity")
        .agg(F.count("*").alias("_n"), total(hundredths("l_extendedprice"), 2).alias("_price"))
    )
    quantity = hundredths("l_quantity").cast("decimal(18,0)")
    of_part = W.partitionBy("l_partkey")
    # quantity < fraction * sum(quantity) / lines, without dividing
    least = F.lit(Decimal(fraction)) * F.sum(quantity * F.col("_n")).over(of_part)
    return (
        per_quantity.withColumn("_below", quantity * F.sum("_n").over(of_part) < least)
        .filter("_below")
        .agg((F.sum("_price").cast("double") / F.lit(float(years))).alias("avg_yearly"))
    )
