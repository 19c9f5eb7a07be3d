"""Queries over SQL texts, completions and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plangauge.catalog.base import Catalog, plain
from plangauge.catalog.plans import TREE
from plangauge.catalog.scoring import SCORED, scored
from plangauge.functions import completions as C
from plangauge.functions import sqltext
from plangauge.operators import diversity, prompts, scoring
from plangauge.plans import patterns, plan_tree
from plangauge.sources.standins import standin

CATALOG = Catalog()
Q = CATALOG.query
WORDS = "|".join(sqltext.BLOCKED)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


# Guards ------------------------------------------------------------------------------


@Q("T1_no_blocked_word", ("texts",), rf"SELECT text_id, length(text) > 0 AND NOT regexp_matches(upper(text), '\b({WORDS})\b') AS ok FROM texts")
def t1(spark, d):
    return standin(spark, d, "texts").select("text_id", sqltext.has_no_blocked_word(F.col("text")).alias("ok"))


_OPENS = " OR ".join(f"starts_with(lower({_strip('text')}), '{o}')" for o in sqltext.READ_OPENINGS)
_CONTAINS = " OR ".join(f"contains(lower({_strip('text')}), '{w.lower()} ')" for w in sqltext.BLOCKED)


@Q("T2_read_only", ("texts",), f"SELECT text_id, ({_OPENS}) AND NOT ({_CONTAINS}) AS ok FROM texts")
def t2(spark, d):
    return standin(spark, d, "texts").select("text_id", sqltext.is_read_only(F.col("text")).alias("ok"))


@Q(
    "T3_has_cte",
    ("texts",),
    r"""SELECT text_id, regexp_matches(upper(text), '\bWITH\s+[A-Z0-9_`\"\[\].]+\s+AS\s*\(')
    OR regexp_matches(upper(text), '\bWITH\s+[A-Z0-9_`\"\[\].]+\s+AS\s+MATERIALIZED') AS ok FROM texts""",
)
def t3(spark, d):
    return standin(spark, d, "texts").select("text_id", sqltext.has_cte(F.col("text")).alias("ok"))


# Completions ---------------------------------------------------------------------------

CO = ("completions",)
PARSED = rf"""WITH found AS (SELECT *, regexp_extract(text, '\{{[^{{}}]*\}}') AS obj FROM completions),
    docs AS (SELECT *, obj <> '' AND json_valid(obj) AS json_valid, CASE WHEN obj <> '' AND json_valid(obj) THEN trim(obj->>'rewritten_query') END AS q,
      CASE WHEN obj <> '' AND json_valid(obj) THEN trim(obj->>'action') END AS a FROM found),
    parsed AS (SELECT *, COALESCE(q <> '', false) AS has_query,
      CASE WHEN COALESCE(q <> '', false) AND a IN ({', '.join(lit(x) for x in C.ACTIONS)}) THEN a ELSE 'push_filter' END AS act,
      CASE WHEN COALESCE(q <> '', false) THEN q ELSE COALESCE(NULLIF({_strip("regexp_extract(text, '(?is)```sql\\s*(.*?)```', 1)")}, ''),
        NULLIF({_strip('text')}, ''), 'SELECT 1') END AS query FROM docs)
    """


@Q(
    "T4_strict_parse",
    CO,
    PARSED
    + """SELECT event_id, json_valid(text) AND COALESCE(a <> '', false) AND COALESCE(q <> '', false) AS strict_ok,
    CASE WHEN json_valid(text) AND COALESCE(a <> '', false) AND COALESCE(q <> '', false) THEN a END AS action,
    CASE WHEN json_valid(text) AND COALESCE(a <> '', false) AND COALESCE(q <> '', false) THEN q END AS rewritten_query FROM parsed""",
)
def t4(spark, d):
    rows = C.parse_strict(standin(spark, d, "completions").select("event_id", "text"))
    return rows.select("event_id", "strict_ok", "strict.action", "strict.rewritten_query")


@Q("T5_tolerant_parse", CO, PARSED + "SELECT event_id, act AS action, query AS rewritten_query FROM parsed")
def t5(spark, d):
    return C.parse_tolerant(standin(spark, d, "completions").select("event_id", "text")).select("event_id", "action", "rewritten_query")


@Q(
    "T6_validity_share",
    CO,
    PARSED
    + """SELECT run_id, COUNT(*) AS completions, ROUND(AVG(CASE WHEN json_valid THEN 1 ELSE 0 END), 6) AS valid_share,
    ROUND(AVG(CASE WHEN has_query THEN 1 ELSE 0 END), 6) AS query_share FROM parsed GROUP BY run_id""",
)
def t6(spark, d):
    return plain(C.validity_by(C.parse_tolerant(standin(spark, d, "completions").select("run_id", "text")), ["run_id"]))


# Tampering -------------------------------------------------------------------------------

_BARE = f"regexp_replace({_strip('query')}, ';+$', '')"
_TO_GROUP = r"regexp_replace(query, '(?is)^(.*?)WHERE\s+.+?(\bGROUP\s+BY\b)', '\1\2')"
_TO_ORDER = r"regexp_replace(query, '(?is)^(.*?)WHERE\s+.+?(\bORDER\s+BY\b|\z)', '\1\2')"
_ADDED = rf"regexp_replace({_BARE}, '(?is)^(.*?)(WHERE)\s+', '\1\2 {sqltext.TAMPER_PREDICATE} AND ')"
VARIANTS = rf"""WITH source AS (SELECT event_id, rewritten_query AS query FROM attempts),
    variants AS (SELECT event_id, 'limit_zero' AS variant, {lit('SELECT * FROM (' + chr(10))} || {_BARE} || {lit(chr(10) + ') AS _a LIMIT 0')} AS sql, -20e0 AS expected_penalty FROM source
    UNION ALL SELECT event_id, 'where_false', {lit('SELECT * FROM (' + chr(10))} || {_BARE} || {lit(chr(10) + ') AS _a WHERE 1=0')}, -20e0 FROM source
    UNION ALL SELECT event_id, 'drop_where', CASE WHEN {_TO_GROUP} <> query THEN {_TO_GROUP} WHEN regexp_matches(query, '(?is)\bWHERE\s+') THEN {_TO_ORDER} ELSE query END, -20e0 FROM source
    UNION ALL SELECT event_id, 'ddl', {lit(sqltext.TAMPER_DDL)}, -15e0 FROM source
    UNION ALL SELECT event_id, 'constant_predicate', CASE WHEN {_ADDED} = {_BARE} THEN {lit(sqltext.TAMPER_FALLBACK)} ELSE {_ADDED} END, -20e0 FROM source)
    """


def _variants(spark, d):
    source = standin(spark, d, "attempts").select("event_id", F.col("rewritten_query").alias("query"))
    return sqltext.tamper_variants(source).drop("query")


@Q("T7_tamper_variants", ("attempts",), VARIANTS + "SELECT * FROM variants")
def t7(spark, d):
    return _variants(spark, d)


@Q(
    "T8_tamper_audit",
    ("attempts",),
    VARIANTS
    + rf"""SELECT variant, COUNT(*) AS attempts, COUNT(*) FILTER (abs(CASE WHEN regexp_matches(upper(sql), '\b({WORDS})\b') THEN -15e0 ELSE -20e0 END
    - expected_penalty) < 0.01) AS as_expected FROM variants GROUP BY variant""",
)
def t8(spark, d):
    rows = _variants(spark, d)
    # what the guards and the result check would answer
    observed = rows.select(
        "event_id", "variant", F.when(sqltext.has_no_blocked_word(F.col("sql")), -20.0).otherwise(-15.0).alias("observed_penalty")
    )
    audit = sqltext.tamper_audit(observed, rows, ["event_id"])
    return audit.groupBy("variant").agg(F.count("*").alias("attempts"), F.count_if("as_expected").alias("as_expected"))


def _clause(clause: str) -> str:
    uses = f"length({{t}}) - length(replace({{t}}, '{clause}', ''))"
    first = f"substr({{t}}, instr({{t}}, '{clause}'), 40)"
    return (
        f"WHEN {uses.format(t='a')} <> {uses.format(t='b')} OR CASE WHEN contains(b, '{clause}') THEN contains(a, '{clause}') "
        f"AND {first.format(t='a')} <> {first.format(t='b')} ELSE true END THEN '{clause}'"
    )


@Q(
    "T9_changed_clause",
    ("attempts", "initial_obs"),
    f"""SELECT event_id, CASE {' '.join(_clause(c) for c in sqltext.CLAUSES)} ELSE 'other' END AS clause
    FROM (SELECT event_id, upper(original_query || ' group by o_custkey') AS a, upper(rewritten_query || ' GROUP BY o_custkey') AS b
      FROM attempts t JOIN initial_obs i ON t.run_id = i.run_id AND t.episode_id = i.episode_id) x""",
)
def t9(spark, d):
    start = standin(spark, d, "initial_obs").select(*scoring.EPISODE, "original_query")
    rows = standin(spark, d, "attempts").select("event_id", *scoring.EPISODE, "rewritten_query").join(start, scoring.EPISODE)
    before = F.concat("original_query", F.lit(" group by o_custkey"))
    after = F.concat("rewritten_query", F.lit(" GROUP BY o_custkey"))
    return rows.select("event_id", sqltext.changed_clause(before, after).alias("clause"))


@Q(
    "T10_completion_diversity",
    CO,
    """WITH sizes AS (SELECT prompt_id, COUNT(*) AS samples FROM completions GROUP BY prompt_id),
    dealt AS (SELECT c.prompt_id, sample_id, text, samples, ('0x' || substr(md5(CAST(sample_id AS VARCHAR)), 1, 8))::BIGINT % CAST(CEIL(samples / 5e0) AS BIGINT) AS probe_id
      FROM completions c JOIN sizes s ON c.prompt_id = s.prompt_id),
    pairs AS (SELECT a.prompt_id, COUNT(*) AS pairs, SUM(levenshtein(a.text, b.text)) AS total FROM dealt a JOIN dealt b
      ON a.prompt_id = b.prompt_id AND a.probe_id = b.probe_id AND a.sample_id < b.sample_id GROUP BY a.prompt_id),
    probes AS (SELECT prompt_id, COUNT(DISTINCT probe_id) AS probes FROM dealt GROUP BY prompt_id)
    SELECT s.prompt_id, samples, probes, COALESCE(pairs, 0) AS pairs, ROUND(COALESCE(total / CAST(pairs AS DOUBLE), 0e0), 6) AS mean_distance,
    COALESCE(total / CAST(pairs AS DOUBLE), 0e0) < 50 AS low_diversity
    FROM sizes s JOIN probes q ON q.prompt_id = s.prompt_id LEFT JOIN pairs p ON s.prompt_id = p.prompt_id""",
)
def t10(spark, d):
    return plain(diversity.completion_diversity(standin(spark, d, "completions")))


# a prompt is what an action and an episode's last digit share: some twenty samples and more
_SAMPLED = "SELECT action || '-' || CAST(episode_id % 50 AS VARCHAR) AS prompt_id, event_id AS sample_id, rewritten_query AS text FROM attempts"


@Q(
    "T10_exact_diversity",
    ("attempts",),
    f"""WITH samples AS ({_SAMPLED}), pairs AS (SELECT a.prompt_id, COUNT(*) AS pairs, SUM(levenshtein(a.text, b.text)) AS total FROM samples a JOIN samples b
      ON a.prompt_id = b.prompt_id AND a.sample_id < b.sample_id GROUP BY a.prompt_id), sizes AS (SELECT prompt_id, COUNT(*) AS samples FROM samples GROUP BY prompt_id)
    SELECT s.prompt_id, samples, COALESCE(pairs, 0) AS pairs, ROUND(COALESCE(total / CAST(pairs AS DOUBLE), 0e0), 6) AS mean_distance,
    COALESCE(total / CAST(pairs AS DOUBLE), 0e0) < 50 AS low_diversity FROM sizes s LEFT JOIN pairs p ON s.prompt_id = p.prompt_id""",
)
def t10_exact(spark, d):
    log = standin(spark, d, "attempts")
    prompt = F.concat_ws("-", "action", (F.col("episode_id") % 50).cast("string"))
    return plain(diversity.exact_diversity(log.select(prompt.alias("prompt_id"), F.col("event_id").alias("sample_id"), F.col("rewritten_query").alias("text"))))


# Prompts ---------------------------------------------------------------------------------

PLANS = ("plans",)
W = prompts.DEFAULT_WORDING
SCHEMA_TEXT = "orders(o_orderkey, o_custkey), customer(c_custkey, c_name)"
_LIBRARY = "CASE pattern_id " + " ".join(f"WHEN '{p.pattern_id}' THEN {lit(prompts.example_text(p))}" for p in patterns.PATTERNS) + " END"
SHOTS = (
    TREE
    + f""", shots AS (SELECT plan_id, string_agg({_LIBRARY}, {lit(chr(10) * 2)} ORDER BY rank) AS body FROM ranked WHERE rank <= 2 GROUP BY plan_id),
    obs AS (SELECT p.plan_id, p.plan_json, p.original_query, p.execution_ms, m.*  EXCLUDE (plan_id), s.body FROM plans p JOIN metrics m ON m.plan_id = p.plan_id
      LEFT JOIN shots s ON s.plan_id = p.plan_id)
    """
)


def _rounded(column: str) -> str:
    return f"CAST(CAST(round_even({column}, 0) AS BIGINT) AS VARCHAR)"


_FACTS = {
    "root of the plan": "node_type", "costliest node": f"top_node_type || ' (cost=' || {_rounded('top_node_cost')} || ')'", "estimated cost": _rounded("total_cost"),
    "full scans": "seq_scans", "nested loop joins": "nested_loops", "hash joins": "hash_joins",
}
_PERFORMANCE = (
    f"{lit(prompts.HEAD_PERFORMANCE + 'measured: ')} || printf('%.1f ms', round_even(execution_ms, 1)) || "
    + " || ".join(f"{lit(chr(10) + label + ': ')} || {value}" for label, value in _FACTS.items())
    + f" || {lit(chr(10))}"
)
_OPENING = lit(f"{W.role} {W.goal}\n\n{prompts.HEAD_SCHEMA}{SCHEMA_TEXT}")


def _observations(spark, d):
    rows = plan_tree.plan_metrics(standin(spark, d, "plans").drop("run_id", "seed", "task_level"), keep_text=True)
    return rows.withColumn("schema_context", F.lit(SCHEMA_TEXT)).withColumn("result_hash", F.md5(F.col("plan_id").cast("string")))


def _digest(df, *keys):
    return df.select(*keys, F.length("prompt").cast("long").alias("chars"), F.md5("prompt").alias("digest"))


_RECORD = (
    f"""SELECT plan_id, {lit(W.role + chr(10) + 'Answer with JSON that has the keys action and rewritten_query.' + chr(10) * 2 + 'ORIGINAL_QUERY:' + chr(10))}
    || original_query || {lit(chr(10) * 2 + 'EXPLAIN_PLAN:' + chr(10))} || plan_json || {lit(chr(10) * 2 + 'EXECUTION_MS: ')} || printf('%.1f', round_even(execution_ms, 1))
    || {lit(chr(10) + 'RESULT_HASH: ')} || md5(CAST(plan_id AS VARCHAR)) || {lit(chr(10) * 2 + 'SCHEMA_CONTEXT:' + chr(10) + SCHEMA_TEXT + chr(10))}
    || CASE WHEN body IS NOT NULL THEN {lit(prompts.RECORD_HINTS)} || body || {lit(chr(10))} ELSE '' END AS prompt, original_query FROM obs"""
)


@Q("T11_record_prompt", PLANS, SHOTS + f"SELECT plan_id, length(prompt) AS chars, md5(prompt) AS digest FROM ({_RECORD}) x")
def t11(spark, d):
    return _digest(prompts.record_prompt(_observations(spark, d)), "plan_id")


@Q("T12_build_records", PLANS, SHOTS + f"SELECT plan_id, original_query AS query, md5(prompt) AS digest FROM ({_RECORD}) x")
def t12(spark, d):
    source = standin(spark, d, "plans")
    queries = source.select("plan_id", "original_query", F.lit(SCHEMA_TEXT).alias("schema_context"))
    metrics = plan_tree.plan_metrics(source.select("plan_id", "plan_json"), keep_text=True)
    times = source.select("plan_id", "execution_ms", F.md5(F.col("plan_id").cast("string")).alias("result_hash"))
    return prompts.build_records(queries, metrics, times).select("plan_id", "query", F.md5("prompt").alias("digest"))


_TAIL = lit(f"\n\n{prompts.OUTPUT_FORMAT}{W.answer}{W.full_answer}")


@Q(
    "T13_optimized_prompt",
    PLANS,
    SHOTS
    + f"""SELECT plan_id, length(prompt) AS chars, md5(prompt) AS digest FROM (SELECT plan_id, {_OPENING} || {lit(chr(10))} || {_PERFORMANCE} || {lit(prompts.HEAD_QUERY)}
    || original_query || {lit(chr(10) * 2)} || CASE WHEN body IS NULL THEN '' ELSE {lit(prompts.HEAD_PATTERNS)} || body || {lit(prompts.END_PATTERNS)} END
    || {lit(prompts.HEAD_ATTEMPTS + prompts.NO_ATTEMPTS + chr(10) + prompts.HEAD_TASK + W.task + chr(10) * 2 + W.rules)} || {_TAIL} AS prompt FROM obs) x""",
)
def t13(spark, d):
    rows = _observations(spark, d)
    rows = rows.withColumn("previous_rewrites", F.array().cast("array<string>")).withColumn("previous_rewards", F.array().cast("array<double>"))
    return _digest(prompts.optimized_prompt(rows), "plan_id")


@Q(
    "T13_plan_only_prompt",
    PLANS,
    SHOTS
    + f"""SELECT plan_id, length(prompt) AS chars, md5(prompt) AS digest FROM (SELECT plan_id, {_OPENING} || {lit(chr(10))} || {_PERFORMANCE} || {lit(prompts.HEAD_QUERY)}
    || original_query || {_TAIL} AS prompt FROM obs) x""",
)
def t13_plan(spark, d):
    return _digest(prompts.plan_only_prompt(_observations(spark, d)), "plan_id")


@Q(
    "T13_baseline_prompt",
    PLANS,
    f"""SELECT plan_id, length(prompt) AS chars, md5(prompt) AS digest FROM (SELECT plan_id, {_OPENING} || {lit(prompts.HEAD_QUERY)} || original_query
    || {lit(f'{chr(10) * 2}{prompts.OUTPUT_FORMAT}{W.answer}{W.short_answer}')} AS prompt FROM plans) x""",
)
def t13_base(spark, d):
    rows = standin(spark, d, "plans").withColumn("schema_context", F.lit(SCHEMA_TEXT))
    return _digest(prompts.baseline_prompt(rows), "plan_id")


@Q(
    "T14_few_shot_block",
    PLANS,
    SHOTS
    + f"""SELECT plan_id, CASE WHEN body IS NULL THEN '' ELSE {lit(prompts.HEAD_PATTERNS)} || body || {lit(prompts.END_PATTERNS)} END AS block FROM obs""",
)
def t14(spark, d):
    rows = plan_tree.plan_metrics(standin(spark, d, "plans").select("plan_id", "plan_json"))
    return rows.select("plan_id", prompts.few_shot_section(patterns.matching_ids(k=2)).alias("block"))


_ATTEMPT = """'Attempt ' || CAST(row_number() OVER (PARTITION BY run_id, episode_id ORDER BY step_index) AS VARCHAR) || ' (result: '
    || printf('%+.2f', reward) || ' reward' || CASE WHEN reward < 0 THEN ' (penalty)' ELSE '' END || '):' || chr(10) || effective_query || chr(10)"""


@Q(
    "T15_previous_attempts",
    ("attempts", "initial_obs"),
    SCORED
    + f""", lines AS (SELECT run_id, episode_id, step_index, {_ATTEMPT} AS line FROM scored WHERE error IS NULL),
    blocks AS (SELECT run_id, episode_id, regexp_replace(string_agg(line, chr(10) ORDER BY step_index), '\\s+$', '') || chr(10) AS block FROM lines GROUP BY run_id, episode_id)
    SELECT e.run_id, e.episode_id, COALESCE(block, '{prompts.NO_ATTEMPTS}') AS block FROM (SELECT DISTINCT run_id, episode_id FROM scored) e
    LEFT JOIN blocks b ON b.run_id = e.run_id AND b.episode_id = e.episode_id""",
)
def t15(spark, d):
    last = scoring.with_history(scored(spark, d)).groupBy(*scoring.EPISODE).agg(
        F.max_by(F.struct("previous_rewrites", "previous_rewards"), "step_index").alias("h")
    )
    return last.select(*scoring.EPISODE, prompts.previous_attempts(F.col("h.previous_rewrites"), F.col("h.previous_rewards")).alias("block"))


_LIMIT = 1600
_A1 = "'Attempt 1 (result: +0.10 reward):' || chr(10) || lang || chr(10) || chr(10)"
_A2 = "'Attempt 2 (result: -0.20 reward (penalty)):' || chr(10) || source || ' ' || lang || ' ' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10)"
_A3 = "'Attempt 3 (result: +0.30 reward):' || chr(10) || source || chr(10)"
_S1 = "'Rewrite.' || chr(10) || chr(10)"


@Q(
    "T16_truncated_prompt",
    (),
    f"""WITH parts AS (SELECT doc_id, {_S1} AS opening, text AS body, {lit(prompts.HEAD_PERFORMANCE)} || 'Execution Time: 1.0 ms' || chr(10) AS perf,
      {lit(prompts.HEAD_PATTERNS)} || repeat('example ', 40) || {lit(prompts.END_PATTERNS)} AS shots, {_A1} AS a1, {_A2} AS a2, {_A3} AS a3,
      {lit(prompts.HEAD_TASK + 'Do it.' + chr(10) * 2 + prompts.OUTPUT_FORMAT + ' JSON')} AS task FROM documents),
    s0 AS (SELECT *, opening || {lit(prompts.HEAD_SCHEMA)} || body || perf || shots || {lit(prompts.HEAD_ATTEMPTS)} || a1 || a2 || a3 || chr(10) || task AS t0,
      opening || {lit(prompts.HEAD_SCHEMA)} || body || perf || {lit(prompts.HEAD_ATTEMPTS)} || a1 || a2 || a3 || chr(10) || task AS t1,
      opening || {lit(prompts.HEAD_SCHEMA)} || body || perf || {lit(prompts.HEAD_ATTEMPTS)} || a2 || chr(10) || a3 || chr(10) || chr(10) || task AS t2,
      CASE WHEN length(body) > 300 THEN opening || {lit(prompts.HEAD_SCHEMA)} || substr(body, 1, 300) || {lit(prompts.SCHEMA_CUT)} || perf || {lit(prompts.HEAD_ATTEMPTS)} || a2 || chr(10) || a3 || chr(10) || chr(10) || task END AS t3 FROM parts),
    done AS (SELECT doc_id, CASE WHEN length(t0) <= {_LIMIT} THEN t0 WHEN length(t1) <= {_LIMIT} THEN t1 WHEN length(t2) <= {_LIMIT} THEN t2
      WHEN length(COALESCE(t3, t2)) <= {_LIMIT} THEN COALESCE(t3, t2) ELSE right(COALESCE(t3, t2), {_LIMIT}) END AS prompt FROM s0)
    SELECT doc_id, length(prompt) AS chars, md5(prompt) AS digest FROM done""",
)
def t16(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rewrites = F.array("lang", F.concat_ws(" ", "source", "lang", F.col("doc_id").cast("string")), "source")
    tried = prompts.previous_attempts(rewrites, F.array(F.lit(0.1), F.lit(-0.2), F.lit(0.3)))
    text = F.concat(
        F.lit("Rewrite.\n\n" + prompts.HEAD_SCHEMA),
        F.col("text"),
        F.lit(prompts.HEAD_PERFORMANCE + "Execution Time: 1.0 ms\n" + prompts.HEAD_PATTERNS + "example " * 40 + prompts.END_PATTERNS),
        F.lit(prompts.HEAD_ATTEMPTS),
        tried,
        F.lit("\n" + prompts.HEAD_TASK + "Do it.\n\n" + prompts.OUTPUT_FORMAT + " JSON"),
    )
    return _digest(prompts.truncated(docs.withColumn("prompt", text), max_tokens=_LIMIT // prompts.CHARS_PER_TOKEN), "doc_id")


@Q(
    "T17_unique_prompts",
    ("prompt_batch",),
    """SELECT seed, prompt || CASE WHEN seed > MIN(seed) OVER (PARTITION BY prompt) THEN chr(10) || '# disambiguation: env_seed=' || CAST(seed AS VARCHAR) || chr(10)
    ELSE '' END AS prompt FROM prompt_batch""",
)
def t17(spark, d):
    return prompts.unique_prompts(standin(spark, d, "prompt_batch")).select("seed", "prompt")


@Q(
    "T18_prompt_seeds",
    ("prompt_batch", "prompt_seeds"),
    "SELECT b.position, COALESCE(s.seed, b.position) AS seed FROM prompt_batch b LEFT JOIN prompt_seeds s ON s.prompt = b.prompt",
)
def t18(spark, d):
    batch = standin(spark, d, "prompt_batch").select("prompt", "position")
    return prompts.seeds_of(batch, standin(spark, d, "prompt_seeds")).select("position", "seed")
