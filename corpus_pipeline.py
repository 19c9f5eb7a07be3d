"""Corpus pipeline: language, near copies, benchmark leaks, mixture, token files.

Each stage takes the documents its predecessor kept and gives documents back; the last
writes token files and gives their document index.  Nulls, empty texts, ties, repeated rows and empty
tables are treated as the operators of the stages say; other columns than those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plangauge.llm import decontaminate, language, mixing, near_copies, token_planes
from plangauge.llm.catalog import LANG_FOLDS, LANG_HELD_OUT, tokenizer_path
from plangauge.llm.common import fold_column, keep, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SURE = 0.5


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found, with probability SURE or more."""
    docs = docs.select(*COLUMNS)
    model = language.train(docs.filter(fold_column("doc_id", LANG_FOLDS) != LANG_HELD_OUT))
    found = language.identify(docs, model)
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE)).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies."""
    return near_copies.keep_one(docs.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    found = decontaminate.scan(docs, read(spark, sf_dir, "benchmark"), carry=COLUMNS)
    return found.filter(F.col("n_hit") == 0).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture uses them, in training order."""
    return mixing.in_training_order(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Document index of the token files, read back from them; the files hold the documents in the order of their rows, which is the training order."""
    return token_planes.round_trip(docs, tokenizer_path(), order=token_planes.row_order(docs))


STAGES = [
    ("language ID", by_language),
    ("MinHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID output", token_files),
]
# Learned, sketched and tokenized steps have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each result is written to the shared folder before the next stage reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
