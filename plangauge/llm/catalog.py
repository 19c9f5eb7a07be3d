"""Registered queries of the operators: each applies one to its whole table and gives the digest columns."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import functions as F

from plangauge.catalog.base import Catalog
from plangauge.llm import alignment, decontaminate, hard_negatives, host_rules, language, line_chunks, main_text, mixing, near_copies, quality, recompression, simhash, sql, token_planes
from plangauge.llm.common import fold_column, read

CATALOG = Catalog()
Q = CATALOG.query

LANG_FOLDS, LANG_HELD_OUT = 4, 2
QUALITY_FOLDS, QUALITY_HELD_OUT, GOOD = 5, 0, 0.3


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Vocabulary file of a public tokenizer; the environment may name another folder."""
    folder = os.environ.get("PLANGAUGE_TOKENIZERS")
    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


@Q("op1_language_id")
def op1(spark, d):
    docs = read(spark, d, "documents")
    held_out = fold_column("doc_id", LANG_FOLDS) == LANG_HELD_OUT
    model = language.train(docs.filter(~held_out))
    return language.identify(docs, model, carry=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@Q("op3_host_rules", (), sql.HOST_RULES)
def op3(spark, d):
    judged = host_rules.judge(read(spark, d, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@Q("op4_decontamination", (), sql.DECONTAMINATION)
def op4(spark, d):
    found = decontaminate.scan(read(spark, d, "documents"), read(spark, d, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@Q("op5_quality")
def op5(spark, d):
    docs = read(spark, d, "documents")
    model = quality.train(docs, read(spark, d, "labels"), folds=QUALITY_FOLDS, held_out=QUALITY_HELD_OUT)
    held_out = fold_column("doc_id", QUALITY_FOLDS) == QUALITY_HELD_OUT
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


@Q("op7_line_chunks", (), sql.LINE_CHUNKS)
def op7(spark, d):
    done = line_chunks.remove_repeated(read(spark, d, "documents").select("doc_id", "text"))
    return done.select("doc_id", "line_chunks.n_lines", "line_chunks.n_removed", F.sha2(F.coalesce("line_chunks.text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@Q("op9_mixing", (), sql.MIXING)
def op9(spark, d):
    # words are counted where the texts are read; the texts themselves are not shuffled
    docs = read(spark, d, "documents").select("doc_id", "source", mixing.n_words("text").alias("words"))
    mixed = mixing.mix(docs, size=F.col("words"))
    rows = mixed.select(
        "doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", F.size("mix.plays").cast("long").alias("n_uses"), F.get("mix.plays", F.lit(0))["position"].alias("first_position"),
    )
    return rows.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


@Q("op10_token_planes")
def op10(spark, d):
    return token_planes.round_trip(read(spark, d, "documents").select("doc_id", "text"), tokenizer_path())


@Q("op2_recompression", (), sql.RECOMPRESSION)
def op2(spark, d):
    done = recompression.remove_repeats(read(spark, d, "documents"), with_text=False)
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256")


@Q("op6_near_copies")
def op6(spark, d):
    classes = near_copies.near_copies(read(spark, d, "documents").select("doc_id", "text"))
    return classes.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("is_first"))


@Q("op8_main_text")
def op8(spark, d):
    pages = read(spark, d, "pages")
    return main_text.main_text(pages, main_text.train(pages))


@Q("op11_covering_simhash")
def op11(spark, d):
    return simhash.near_components(read(spark, d, "documents"))


@Q("op12_hard_negatives", (), sql.HARD_NEGATIVES)
def op12(spark, d):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, d, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


@Q("op13_token_alignment")
def op13(spark, d):
    return alignment.align(read(spark, d, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
