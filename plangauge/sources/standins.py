"""Log tables derived from the given tables.

The given data has no logs of plans, attempts, timings or metrics, so these
views derive them row by row from ``events`` and ``lineitem``.  They are written
once, in SQL that Spark and the checking engine both accept.  None of them
leaves out rows: the log tables grow with the given tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# name -> (views it reads, SQL)
STANDINS: dict[str, tuple[tuple[str, ...], str]] = {
    "typed_lineitem": (
        (),
        """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS DECIMAL(15,2)) AS l_quantity,
        CAST(l_extendedprice AS DECIMAL(15,2)) AS l_extendedprice, CAST(l_discount AS DECIMAL(4,2)) AS l_discount,
        CAST(l_tax AS DECIMAL(4,2)) AS l_tax, l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS l_shipdate
        FROM lineitem""",
    ),
    "typed_orders": (
        (),
        """SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(15,2)) AS o_totalprice,
        CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders""",
    ),
    # cheapest price per piece of a line, in whole cents, as the offer of a supplier
    "partsupp": (
        (),
        """SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey,
        CAST(MIN(FLOOR(ROUND(l_extendedprice * 1e2) * 6e-1 / l_quantity)) / 1e2 AS DECIMAL(15,2)) AS ps_supplycost,
        CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS ps_availqty
        FROM lineitem GROUP BY l_partkey, l_suppkey""",
    ),
    # seven consecutive events are one episode; a third of all episodes belongs to one run
    "event_log": (
        (),
        """SELECT event_id, ts, user_id, event_type, value, k, episode_id, step_index,
        CASE WHEN episode_id % 3 = 0 THEN 'run-0' ELSE 'run-' || CAST(1 + episode_id % 4 AS STRING) END AS run_id
        FROM (SELECT event_id, ts, user_id, event_type, value,
          CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
          CAST(FLOOR(event_id / 7) AS BIGINT) AS episode_id, CAST(event_id % 7 AS INT) AS step_index
          FROM events) e""",
    ),
    "attempts": (
        ("event_log",),
        """SELECT run_id, episode_id, step_index, event_id, ts,
        CASE k % 9 WHEN 0 THEN 'rewrite_join' WHEN 1 THEN 'add_cte' WHEN 2 THEN 'push_filter' WHEN 3 THEN 'reorder_joins'
          WHEN 4 THEN 'suggest_index' WHEN 5 THEN 'limit_early' WHEN 6 THEN 'revert' WHEN 7 THEN 'push_filter'
          ELSE 'drop_table' END AS action,
        CASE WHEN k % 20 = 7 THEN 'DROP TABLE t' || CAST(k AS STRING)
          WHEN k % 4 = 0 THEN 'WITH r AS (SELECT o_orderkey FROM orders WHERE o_orderkey < ' || CAST(event_id AS STRING) || ') SELECT COUNT(*) FROM r'
          WHEN k % 4 = 1 THEN 'SELECT l_partkey, COUNT(*) FROM lineitem WHERE l_suppkey = ' || CAST(user_id AS STRING) || ' GROUP BY l_partkey;'
          WHEN k % 4 = 2 THEN 'select c_name from customer join orders on c_custkey = o_custkey where o_orderkey = ' || CAST(event_id AS STRING) || ' order by c_name'
          ELSE 'SELECT COUNT(*) FROM part' END AS rewritten_query,
        event_type <> 'error' AS parse_ok,
        k % 17 = 3 AS timed_out,
        CASE WHEN k % 23 = 1 THEN 'division by zero' END AS exec_error,
        value AS new_ms,
        CASE WHEN event_type = 'signup' AND k % 2 = 0 THEN 'other-' || CAST(event_id AS STRING)
          ELSE 'same-' || CAST(episode_id AS STRING) END AS new_hash,
        CASE k % 4 WHEN 0 THEN 'Hash Join' WHEN 1 THEN 'Seq Scan' WHEN 2 THEN 'Nested Loop' ELSE 'Aggregate' END AS node_type,
        k * 1e2 AS total_cost, CAST(k * 10000 AS BIGINT) AS rows_out, k % 3 AS seq_scans, k % 2 AS nested_loops, k % 4 AS hash_joins
        FROM event_log""",
    ),
    "initial_obs": (
        ("event_log",),
        """SELECT run_id, episode_id, CAST(1 + episode_id % 3 AS INT) AS task_level, 5e0 AS target_ms,
        'SELECT * FROM orders WHERE o_orderkey = ' || CAST(episode_id AS STRING) AS original_query,
        MAX(value) + 1e1 AS execution_ms, 'same-' || CAST(episode_id AS STRING) AS base_hash,
        'Nested Loop' AS base_node_type, 5e4 AS base_total_cost, CAST(MAX(k) * 20000 AS BIGINT) AS base_rows,
        2 AS base_seq_scans, 1 AS base_nested_loops, 0 AS base_hash_joins
        FROM event_log GROUP BY run_id, episode_id""",
    ),
    "history": (
        ("event_log",),
        """SELECT run_id, event_id AS step,
        CASE WHEN k = 13 THEN NULL WHEN k = 14 THEN CAST('NaN' AS DOUBLE) ELSE (value - 2e1) / 1e2 END AS reward_mean,
        CASE WHEN k = 13 AND event_type = 'view' THEN value / 1e2 END AS env_reward,
        CAST(k AS DOUBLE) / 1e2 AS speedup_ratio,
        CASE WHEN event_type = 'signup' THEN CAST(k % 6 AS DOUBLE) ELSE 0e0 END AS result_changed,
        CASE WHEN event_type = 'error' THEN 1e0 ELSE 0e0 END AS syntax_error,
        CASE WHEN k = 21 THEN NULL ELSE CAST(k % 3 AS DOUBLE) END AS seq_scans_removed,
        CAST(1 + k % 5 AS DOUBLE) AS episode_length, CAST(1 + user_id % 3 AS DOUBLE) AS task_level,
        CASE WHEN k % 11 = 0 THEN ' No_Op ' WHEN k % 11 = 1 THEN 'identity' ELSE 'push_filter' END AS action,
        CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS rewrite_unchanged,
        CASE WHEN k % 10 = 1 THEN 1 END AS noop
        FROM event_log""",
    ),
    # a third of all timings belongs to one query
    "timings": (
        (),
        """SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'q-all' ELSE 'q-' || CAST(l_partkey AS STRING) END AS query_id,
        CASE l_linenumber % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'untrained' ELSE 'trained' END AS variant,
        l_linenumber AS rep, l_extendedprice / 1e2 AS ms,
        CASE WHEN l_tax > 7.5e-2 AND l_discount > 9.5e-2 THEN 'h-' || CAST(l_orderkey AS STRING) ELSE 'h' END AS result_hash
        FROM lineitem""",
    ),
    "timing_baselines": (("timings",), "SELECT query_id, 'h' AS base_hash FROM timings GROUP BY query_id"),
    # trees of two to five levels, some broken, in the three accepted shapes
    "plans": (
        ("event_log",),
        """SELECT event_id AS plan_id, run_id, user_id AS seed, CAST(1 + user_id % 3 AS INT) AS task_level, value AS execution_ms,
        'SELECT * FROM orders WHERE o_orderkey = ' || CAST(event_id AS STRING) AS original_query,
        CASE WHEN k % 19 = 5 THEN '{"Plan": {"Node Type": "Seq' WHEN k % 3 = 0 THEN '[{"Plan": ' || tree || '}]'
          WHEN k % 3 = 1 THEN '{"Plan": ' || tree || '}' ELSE tree END AS plan_json
        FROM (SELECT l.*,
          '{"Node Type": "' || CASE k % 8 WHEN 0 THEN 'Limit' WHEN 1 THEN 'Hash Join' WHEN 2 THEN 'Nested Loop' WHEN 3 THEN 'Aggregate'
            WHEN 4 THEN 'Subquery Scan' WHEN 5 THEN 'Seq Scan' WHEN 6 THEN 'Index Scan' ELSE 'Merge Join' END
          || '", "Total Cost": ' || CASE WHEN k % 13 = 2 THEN '"n/a"' ELSE CAST(k * 900 AS STRING) END
          || ', "Actual Total Time": ' || CAST(k * 9 AS STRING) || ', "Actual Rows": ' || CAST(k * 15000 AS STRING)
          || CASE WHEN k % 7 = 6 THEN ', "Plans": {"Node Type": "Seq Scan"}}'
             ELSE ', "Plans": [' || child || ']}' END AS tree
          FROM (SELECT event_log.*,
            CASE WHEN k % 5 = 0 THEN '{"Node Type": "Sort", "Total Cost": 500, "Actual Rows": ' || CAST(k * 4000 AS STRING) || ', "Plans": [{"Node Type": "Seq Scan", "Total Cost": 100, "Filter": "((a = 1) OR (b = 2))"}]}'
              WHEN k % 5 = 1 THEN '{"Node Type": "Seq Scan", "Total Cost": ' || CAST(k * 1000 AS STRING) || ', "Actual Rows": ' || CAST(k * 20000 AS STRING) || ', "Filter": "(x > 1 or y < 2)"}, {"Node Type": "Hash", "Plans": [{"Node Type": "Seq Scan", "Total Cost": 7}]}'
              WHEN k % 5 = 2 THEN '{"Node Type": "Nested Loop", "Total Cost": 300, "Plans": [{"Node Type": "Hash Join", "Total Cost": 300, "Plans": [{"Node Type": "Merge Join", "Plans": [{"Node Type": "Index Scan"}, {"Node Type": "Index Scan"}]}]}, {"Node Type": "Index Only Scan", "Total Cost": 1}]}'
              WHEN k % 5 = 3 THEN '{"Node Type": "Index Scan", "Total Cost": "250.5", "Actual Rows": 12}'
              ELSE '{"Node Type": "Nested Loop", "Total Cost": 90000, "Actual Rows": 60000, "Plans": []}' END AS child
            FROM event_log) l) t""",
    ),
    # the form in which observations store plans
    "normalized_plans": (
        ("event_log",),
        """SELECT event_id AS plan_id, k, '{"node_type": "Limit", "total_cost": ' || CAST(k * 10 AS STRING) || ', "actual_time_ms": ' || CAST(k * 9 AS STRING)
        || ', "rows": ' || CAST(k * 15 AS STRING) || ', "seq_scans": 1, "index_scans": 0, "nested_loops": 0, "hash_joins": 1, "highest_cost_node": ' || raw_join
        || ', "children": [{"node_type": "Hash Join", "total_cost": 2000, "actual_time_ms": 1, "rows": ' || CAST(k * 20 AS STRING)
        || ', "seq_scans": 1, "index_scans": 0, "nested_loops": 0, "hash_joins": 1, "highest_cost_node": ' || raw_join || ', "children": [{"node_type": "Seq Scan", "total_cost": 50, '
        || '"actual_time_ms": 1, "rows": 5, "seq_scans": 1, "index_scans": 0, "nested_loops": 0, "hash_joins": 0, "highest_cost_node": ' || raw_scan || ', "children": []}]}]}' AS plan_json
        FROM (SELECT event_log.*, '{"Node Type": "Hash Join", "Total Cost": 2000}' AS raw_join,
          '{"Node Type": "Seq Scan", "Total Cost": 50' || CASE WHEN k % 2 = 0 THEN ', "Filter": "(a = 1 OR b = 2)"}' ELSE '}' END AS raw_scan FROM event_log) l""",
    ),
    "completions": (
        ("attempts",),
        """SELECT episode_id AS prompt_id, step_index AS sample_id, run_id, event_id,
        CASE event_id % 6
          WHEN 0 THEN '{"action": "' || action || '", "rewritten_query": "' || rewritten_query || '"}'
          WHEN 1 THEN 'Here it is: {"action": "' || action || '", "rewritten_query": " ' || rewritten_query || ' "} I hope it helps.'
          WHEN 2 THEN 'Plan looks slow. ```json {"rewritten_query": "' || rewritten_query || '"} ``` done'
          WHEN 3 THEN 'Use this: ```sql ' || rewritten_query || ' ``` it is fast'
          WHEN 4 THEN '{"action": "' || action || '", "rewritten_query": "' || rewritten_query
          ELSE '  {"action": "' || action || '", "rewritten_query": ""}  ' END AS text
        FROM attempts""",
    ),
    # every document and every rewritten query
    "texts": (
        ("attempts",),
        """SELECT 'doc-' || CAST(doc_id AS STRING) AS text_id, text FROM documents
        UNION ALL SELECT 'sql-' || CAST(event_id AS STRING), rewritten_query FROM attempts""",
    ),
    # many copies of few prompt texts
    "prompt_batch": (
        ("event_log",),
        """SELECT event_id AS seed, event_id AS position, 'Rewrite query ' || CAST(k % 7 AS STRING) || ' of ' || event_type AS prompt
        FROM event_log""",
    ),
    "prompt_seeds": (
        ("prompt_batch",),
        """SELECT prompt, MIN(seed) AS seed FROM prompt_batch GROUP BY prompt HAVING MIN(seed) % 2 = 0""",
    ),
}


# Logs whose rows are whole plans or completions, many times as large as the events they come from.  The events are
# dealt over tasks before they grow; a log that was collected as such is read as it is.
TEXT_LOGS = ("plans", "normalized_plans", "completions")


def with_views(*names: str) -> str:
    """A WITH clause that defines the named views and all they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in STANDINS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{name} AS ({STANDINS[name][1]})" for name in ordered) + "\n"


def base_tables_of(name: str) -> list[str]:
    """The given tables that a derived table reads."""
    needed, sql = STANDINS[name]
    sql = re.sub(r"'[^']*'", "''", sql)  # quoted query texts name tables too
    own = [t for t in BASE_TABLES if re.search(rf"\bFROM {t}\b", sql)]
    return list(dict.fromkeys(own + [t for n in needed for t in base_tables_of(n)]))


def standin(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One derived log table as a DataFrame; the given tables go in by name, no view of the session is replaced."""
    given = {table: spark.read.parquet(f"{directory}/{table}.parquet") for table in base_tables_of(name)}
    if name in TEXT_LOGS:
        # the number is given, or small events would be put together again
        given["events"] = given["events"].repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    views = with_views(name)
    # tables are passed under names that no column has
    marked = {f"given_{table}": rows for table, rows in given.items()}
    sources = ",\n".join(f"{table} AS (SELECT * FROM {{given_{table}}})" for table in given)
    body = views.removeprefix("WITH ").replace("{", "{{").replace("}", "}}")
    return spark.sql(f"WITH {sources},\n{body} SELECT * FROM {name}", **marked)
