"""The pipeline's stages against brute force."""

import collections

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from plangauge.llm import decontaminate, mixing, near_copies  # noqa: E402
from plangauge.llm.common import keep  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def test_stages_on_given_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").cache()
    names, kept = [n for n, _ in corpus_pipeline.STAGES], docs
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, data).cache()
        assert kept.columns == list(corpus_pipeline.COLUMNS)
        assert kept.join(before, ["doc_id", "text"], "left_anti").count() == 0
        if name == "MinHash near-dedup":
            classes = {r["doc_id"]: r["class_id"] for r in near_copies.near_copies(before).collect()}
            assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(set(classes.values()))
        if name == "benchmark decontamination":
            bench = spark.read.parquet(f"{data}/benchmark.parquet")
            assert decontaminate.scan(kept, bench).filter("n_hit > 0").count() == 0
            hit = {r[0] for r in decontaminate.scan(before, bench).filter("n_hit > 0").select("doc_id").collect()}
            assert {r[0] for r in before.select("doc_id").collect()} - hit == {r[0] for r in kept.select("doc_id").collect()}
        if name.startswith("mixing"):
            uses = collections.Counter(r[0] for r in kept.select("doc_id").collect())
            plan = {r["doc_id"]: r for r in mixing.mix(before).select("doc_id", "mix.*").collect()}
            assert all(uses[i] == sum(2 * p["words"] >= r["size"] for p in r["plays"]) for i, r in plan.items())
    out = corpus_pipeline.STAGES[-1][1](spark, kept, data).collect()
    assert len(out) == kept.count() and sum(r["n_tokens"] for r in out) == max(r["start"] + r["n_tokens"] for r in out)


def test_stages_on_odd_and_empty_tables(spark, data):
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "a", 0, "x"), (2, "the and of it to", "en", None, 5, "x"), (2, "the and of it to", "en", None, 5, "x"), (3, " 12 ", "en", "a", 3, None)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, DOCS)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, data).count() <= len(some) * 3


def test_token_files_keep_the_training_order(spark, data):
    rows = [(i, " ".join(["word"] * (1 + i % 7)), "en", "abc"[i % 3], None, None) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3).cache()
    streams = set()
    for slopes in (mixing.SLOPES, (-0.9, 0.0, 0.9)):
        mix = mixing.mix(docs, slopes=slopes)
        plan = {r["doc_id"]: sorted(p["position"] for p in r["plays"] if 2 * p["words"] >= r["size"]) for r in mix.select("doc_id", "mix.*").collect()}
        ordered = mixing.in_training_order(mix, 13).select(*corpus_pipeline.COLUMNS)
        for given in (keep(ordered, "test-order"), ordered.cache()):  # files, which Spark reads in another order, and rows in memory
            index = sorted(corpus_pipeline.token_files(spark, given, data).collect(), key=lambda r: r["start"])
            seen, places = collections.Counter(), []
            for r in index:
                places.append(plan[r["doc_id"]][seen[r["doc_id"]]])
                seen[r["doc_id"]] += 1
            assert places == sorted(places) and len(places) == sum(map(len, plan.values()))
        streams.add(tuple(r["doc_id"] for r in index))
    assert len(streams) == 2
