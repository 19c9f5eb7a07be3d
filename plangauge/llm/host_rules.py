"""Quality rules judged by document and by host.

Each document gets counts over its whole text and a base verdict.  Failures are
aggregated by host, host rates are shrunk with a beta prior estimated from all
hosts, and a host whose shrunk rate exceeds ``host_limit`` takes its documents along.

Nulls and empty texts have no words and fail the base rule.  A null host is a
host of its own.  Every row in gives one row out.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plangauge.llm.common import keep, map_rows, words

# The six characters that separate words, and the symbols that are counted.
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
GRAM = 5


def repeated_words(tokens: list[bytes], size: int = GRAM) -> int:
    """Words inside windows of ``size`` words that occur twice or more in the text, first occurrences included."""
    grams = list(zip(*[tokens[i:] for i in range(size)]))
    if len(set(grams)) == len(grams):
        return 0
    times = Counter(grams)
    covered = upto = 0
    for at, gram in enumerate(grams):
        if times[gram] > 1:
            covered += at + size - max(upto, at)
            upto = at + size
    return covered


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    tokens = words(text)
    lines = Counter(text.split("\n"))
    dup_lines = sum(n - 1 for line, n in lines.items() if n > 1 and line.strip(BLANK))
    return (
        len(tokens),
        len(text) - sum(map(text.count, BLANK)),
        sum(map(text.count, SYMBOLS)),
        dup_lines,
        repeated_words(tokens),
    )


def document_stats(df: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Id, host and counts of every document; no shuffle."""

    def make():
        def work(ids, hosts, texts):
            for i, h, t in zip(ids, hosts, texts):
                yield (i, h, *measure(t))

        return work

    kinds = dict(df.dtypes)
    schema = f"doc_id {kinds[id_col]}, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    made = map_rows(df.select(id_col, F.col(host).cast("string"), text), schema, make)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return made.withColumn("base_failed", failed)


def host_verdicts(stats: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, host_failed: beta-binomial shrinkage, prior by the method of moments.

    With rates r_h over hosts, mean m and variance v, the prior is Beta(m k, (1 - m) k) with
    k = m (1 - m) / v - 1, held between 1 and 1000 (one host, or equal hosts, give 1000).
    """
    hosts = stats.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    # one row, so a scalar for every host
    seen = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()
    m, v = seen["m"] or 0.0, seen["v"] or 0.0
    k = min(1000.0, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 1000.0
    shrunk = (F.col("n_failed") + F.lit(m * k)) / (F.col("n_docs") + F.lit(k))
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("host_failed", shrunk > host_limit)


def judge(df: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", host_limit: float = 0.5) -> DataFrame:
    """Counts, base verdict, host rate and the final ``kept`` of every document.

    The counts are written once and read twice.  Hosts meet documents in a join
    that adaptive execution splits where a host is hot.
    """
    stats = keep(document_stats(df, id_col, text, host), "host-rules")
    verdicts = host_verdicts(stats, host_limit).select(F.col("host").alias("of_host"), "shrunk_rate", "host_failed")
    joined = stats.join(verdicts, F.col("host").eqNullSafe(F.col("of_host")), "left").drop("of_host")
    return joined.withColumn("kept", ~(F.col("base_failed") | F.col("host_failed")))
