"""Reading model completions: an action and a rewritten query out of free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plangauge.functions.sqltext import strip

# The actions an attempt may take, the action and query used when nothing is found.
ACTIONS = ("rewrite_join", "add_cte", "push_filter", "reorder_joins", "suggest_index", "limit_early", "revert")
DEFAULT_ACTION = "push_filter"
DEFAULT_QUERY = "SELECT 1"

# Fenced blocks in completions.
ANY_FENCE = r"(?is)```(?:json)?\s*(.+?)\s*```"
SQL_FENCE = r"(?is)```sql\s*(.*?)```"


def parse_strict(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``strict`` (action, rewritten_query; null when the text is not acceptable) and ``strict_ok``.

    The whole text must be one JSON object with a non-empty text action and
    query.  It is parsed as the only element of an array, so that anything after
    the object makes it invalid.
    """
    staged = df.withColumn(
        "_items", F.expr(f"try_cast(try_parse_json(concat('[', {text}, ']')) as array<variant>)")
    ).withColumn("_one", F.expr("if(size(_items) = 1, _items[0], null)"))

    def member(name: str) -> Column:
        found = f"try_variant_get(_one, '$.{name}', 'variant')"
        value = strip(F.expr(f"try_variant_get(_one, '$.{name}', 'string')"))
        return F.when((F.expr(f"schema_of_variant({found})") == "STRING") & (value != ""), value)

    staged = staged.withColumns({"_action": member("action"), "_query": member("rewritten_query")})
    ok = F.col("_action").isNotNull() & F.col("_query").isNotNull()
    both = F.struct(F.col("_action").alias("action"), F.col("_query").alias("rewritten_query"))
    return staged.withColumn("strict_ok", ok).withColumn("strict", F.when(ok, both)).drop("_items", "_one", "_action", "_query")


def parse_tolerant(df: DataFrame, text: str = "text", default_action: Column | None = None) -> DataFrame:
    """Add ``json_valid``, ``has_query``, ``action`` and ``rewritten_query`` found in free text.

    Looks into a fenced block, else the whole text; takes the first JSON object
    from the first brace on, whatever follows it.  Without a usable query: a
    fenced SQL block, else the text itself, else ``SELECT 1``.
    """
    default = F.coalesce(default_action, F.lit(DEFAULT_ACTION)) if default_action is not None else F.lit(DEFAULT_ACTION)
    default = F.when(default == "", F.lit(DEFAULT_ACTION)).otherwise(default)
    body = strip(F.coalesce(F.col(text), F.lit("")))
    staged = df.withColumn("_body", body)
    fenced = strip(F.regexp_extract("_body", ANY_FENCE, 1))
    staged = staged.withColumn("_blob", F.when(F.col("_body").rlike(ANY_FENCE), fenced).otherwise(F.col("_body")))
    staged = staged.withColumn("_from", F.locate("{", F.col("_blob")))
    staged = staged.withColumn(
        "_doc", F.when(F.col("_from") > 0, F.expr("try_parse_json(substring(_blob, _from))"))
    )
    staged = staged.withColumn("_query", strip(F.expr("try_variant_get(_doc, '$.rewritten_query', 'string')")))
    staged = staged.withColumn("_action", strip(F.expr("try_variant_get(_doc, '$.action', 'string')")))
    has_query = F.coalesce(F.col("_query") != "", F.lit(False))
    in_sql_fence = strip(F.regexp_extract("_body", SQL_FENCE, 1))
    fallback = (
        F.when(in_sql_fence != "", in_sql_fence).when(F.col("_body") != "", F.col("_body")).otherwise(F.lit(DEFAULT_QUERY))
    )
    known = F.coalesce(F.col("_action").isin(*ACTIONS), F.lit(False))
    return (
        staged.withColumn("json_valid", F.col("_doc").isNotNull())
        .withColumn("has_query", has_query)
        .withColumn("action", F.when(has_query & known, F.col("_action")).otherwise(default))
        .withColumn("rewritten_query", F.when(has_query, F.col("_query")).otherwise(fallback))
        .drop("_body", "_blob", "_from", "_doc", "_query", "_action")
    )


def validity_by(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Share of completions that hold valid JSON, and that hold a query."""
    return parsed.groupBy(*keys).agg(
        F.count("*").alias("completions"),
        F.avg(F.col("json_valid").cast("int")).alias("valid_share"),
        F.avg(F.col("has_query").cast("int")).alias("query_share"),
    )
