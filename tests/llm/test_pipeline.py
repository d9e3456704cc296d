"""The pipeline: each stage on its own against its operator's judgement, and the whole run."""

import corpus_pipeline
from compare import connect
from pyspark.sql import functions as F

from cityflux.llm import language, mixing, quality, simhash
from cityflux.llm.queries import ORACLES


def test_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "language_id", "near_dedup", "source_mixing", "best_fit_packing"]
    state = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, state, sf)
        out.write.parquet(path := f"{corpus_pipeline.materialize(spark.range(1), 'x').inputFiles()[0].rsplit('/', 1)[0]}-{name}")
        out = spark.read.parquet(path)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        if name == "quality_rules":
            want = {r[0] for r in connect(sf).sql(f"SELECT doc_id FROM ({ORACLES['op6_quality_rules']}) WHERE kept").fetchall()}
            assert {r["doc_id"] for r in out.collect()} == want
        if name == "language_id":
            und = {r["doc_id"] for r in language.identify(state).filter("lang_pred = 'und'").collect()}
            assert not und & {r["doc_id"] for r in out.collect()} and out.count() >= 0.98 * state.count()
        if name == "near_dedup":
            groups = simhash.near_duplicates(state)
            assert {r["doc_id"] for r in out.collect()} == {r[0] for r in groups.select("component_id").distinct().collect()}
            assert out.count() == out.select("doc_id").distinct().count()
        if name == "source_mixing":
            times = {r["doc_id"]: r["times"] for r in mixing.mix(state).collect() if r["times"]}
            assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == times
        if name == "best_fit_packing":
            assert out.filter("piece = 0").count() == state.count()
            assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
        state = out
    assert quality.keep_quality(docs).count() >= state.select("doc_id").distinct().count()


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert set(rows.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and rows.count() > 0


def test_nothing_in_nothing_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
