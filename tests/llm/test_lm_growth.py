"""The network learns from every training document, however many and however long."""

from collections import Counter

from pyspark.sql import functions as F

from cityflux.llm import language, lm


def test_learns_from_long_documents(spark):
    text = " ".join(f"word{i % 5}" for i in range(4_000))
    docs = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    held = lm.score(docs).filter("held_out").first()
    # Words alone say log10(1/5) a token; their order is certain.
    assert held["score"] - held["base_score"] > 0.3 * held["n_tokens"]


def test_every_training_document_is_in_a_round(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 5_000)
    docs = spark.range(9_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a "), "id", F.repeat(F.lit(" b"), F.when(F.col("id") % 900 == 0, 3_000).otherwise(3))).alias("text"))
    counts = lm.word_counts(docs)
    scorer, *_ = lm._scorer(lm.materialize(counts, "counts"))
    encoded = lm._encoded(docs, scorer, 1)
    taught = encoded.filter(language.learns(F.col("doc_id"), lm.MODULUS))
    dealt, shards = lm._dealt(encoded)
    rows = dealt.collect()
    assert Counter(bytes(r["tokens"]) for r in rows) == Counter(bytes(r["tokens"]) for r in taught.collect())
    assert {r["part"] for r in rows} == set(range(lm.ROUNDS))
    # Shards stay about as large as tokens grow in number.
    sizes = Counter()
    for r in rows:
        sizes[r["part"], r["shard"]] += len(r["tokens"]) // 2
    assert shards >= 4 and max(sizes.values()) <= 2 * lm.SHARD_TOKENS + 3_003
    assert lm._dealt(encoded.unionByName(encoded))[1] >= 2 * shards - 1
    assert sum(sizes.values()) == taught.agg(F.sum("n_tokens")).first()[0]
