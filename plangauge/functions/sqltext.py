"""Checks and edits on SQL text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statements that may not be run, and the openings of readable ones.
BLOCKED = ("CREATE", "DROP", "ALTER", "TRUNCATE", "INSERT", "UPDATE", "DELETE", "GRANT", "REVOKE", "VACUUM", "ANALYZE")
READ_OPENINGS = ("select", "with", "explain")

# The two shapes of a common table expression, on upper-case text.
CTE_SHAPES = (
    r"(?s)\bWITH\s+[A-Z0-9_`\"\[\].]+\s+AS\s*\(",
    r"(?s)\bWITH\s+[A-Z0-9_`\"\[\].]+\s+AS\s+MATERIALIZED",
)


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def has_no_blocked_word(query: Column) -> Column:
    """Not empty, and none of the blocked words occurs as a word."""
    pattern = r"\b(" + "|".join(BLOCKED) + r")\b"
    return F.coalesce((F.length(query) > 0) & ~F.upper(query).rlike(pattern), F.lit(False))


def is_read_only(query: Column) -> Column:
    """Opens like a read, and no blocked word is followed by a blank anywhere (literals included)."""
    text = F.lower(strip(query))
    opens = F.lit(False)
    for opening in READ_OPENINGS:
        opens = opens | text.startswith(opening)
    blocked = F.array(*[F.lit(word.lower() + " ") for word in BLOCKED])
    return F.coalesce(opens & ~F.exists(blocked, lambda word: text.contains(word)), F.lit(False))


def has_cte(text: Column) -> Column:
    """Does the text hold a WITH clause?"""
    upper = F.upper(F.coalesce(text, F.lit("")))
    return upper.rlike(CTE_SHAPES[0]) | upper.rlike(CTE_SHAPES[1])


# tampering variants -------------------------------------------------------------

# Variant names, their expected penalties, the added predicate, and the wrappers and patterns below.
TAMPER_PENALTIES = {"limit_zero": -20, "where_false": -20, "drop_where": -20, "ddl": -15, "constant_predicate": -20}
TAMPER_PREDICATE = "l_orderkey = 1"
TAMPER_DDL = "ALTER TABLE orders ADD COLUMN checked INTEGER"
TAMPER_FALLBACK = "SELECT 1 FROM lineitem WHERE l_orderkey = 1"


def without_where(query: Column) -> Column:
    """Drop the first WHERE clause: up to GROUP BY, else up to ORDER BY or the end."""
    to_group = F.regexp_replace(query, r"(?is)^(.*?)WHERE\s+.+?(\bGROUP\s+BY\b)", "$1$2")
    to_order = F.regexp_replace(query, r"(?is)^(.*?)WHERE\s+.+?(\bORDER\s+BY\b|\z)", "$1$2")
    return F.when(to_group != query, to_group).when(query.rlike(r"(?is)\bWHERE\s+"), to_order).otherwise(query)


def with_predicate(query: Column, predicate: str = TAMPER_PREDICATE, fallback: str = TAMPER_FALLBACK) -> Column:
    """Put a constant predicate first in the first WHERE clause."""
    edited = F.regexp_replace(query, r"(?is)^(.*?)(WHERE)\s+", "$1$2 " + predicate + " AND ")
    return F.when(edited == query, F.lit(fallback)).otherwise(edited)


def tamper_variants(queries: DataFrame, query: str = "query") -> DataFrame:
    """Five tampered forms of every query: columns of the input plus variant, sql, expected_penalty."""
    text = F.col(query)
    bare = F.regexp_replace(strip(text), r";+$", "")
    forms = {
        "limit_zero": F.concat(F.lit("SELECT * FROM (\n"), bare, F.lit("\n) AS _a LIMIT 0")),
        "where_false": F.concat(F.lit("SELECT * FROM (\n"), bare, F.lit("\n) AS _a WHERE 1=0")),
        "drop_where": without_where(text),
        "ddl": F.lit(TAMPER_DDL),
        "constant_predicate": with_predicate(bare),
    }
    rows = [
        F.struct(
            F.lit(name).alias("variant"),
            sql.alias("sql"),
            F.lit(TAMPER_PENALTIES[name]).cast("double").alias("expected_penalty"),
        )
        for name, sql in forms.items()
    ]
    return queries.withColumn("_v", F.explode(F.array(*rows))).select("*", "_v.*").drop("_v")


def tamper_audit(observed: DataFrame, variants: DataFrame, key: list[str]) -> DataFrame:
    """Compare observed penalties with expected ones, within 0.01."""
    expected = variants.select(*key, "variant", "expected_penalty")
    joined = observed.join(expected, [*key, "variant"])
    return joined.withColumn("as_expected", F.abs(F.col("observed_penalty") - F.col("expected_penalty")) < 0.01)


# clause difference ---------------------------------------------------------------

CLAUSES = ("GROUP BY", "WHERE", "JOIN")


def changed_clause(original: Column, rewritten: Column, around: int = 40, absent_counts: bool = True) -> Column:
    """Name the first clause that seems changed: its count differs, or the text from its first use on.

    With ``absent_counts`` a clause that the rewritten text lacks is named even
    if the original lacks it too, as the original heuristic does.
    """
    a, b = F.upper(original), F.upper(rewritten)
    chain = F.when(F.lit(False), F.lit("other"))
    for clause in CLAUSES:
        def uses(text: Column) -> Column:
            return F.length(text) - F.length(F.replace(text, F.lit(clause), F.lit("")))

        def first_use(text: Column) -> Column:
            return F.substring(text, F.locate(clause, text), F.lit(around))

        differs = a.contains(clause) & (first_use(a) != first_use(b))
        differs = F.when(b.contains(clause), differs).otherwise(F.lit(absent_counts) | a.contains(clause))
        chain = chain.when((uses(a) != uses(b)) | differs, F.lit(clause))
    return chain.otherwise(F.lit("other"))
