"""Shapes of whole words, and samples that reach every source and language."""

from pyspark.sql import functions as F

from panelwright.llm import cotraining, secret_scan


def test_shapes_see_whole_words():
    assert cotraining.shape("a" * 64 + "9") == "a9"
    assert cotraining.shape("a1b2c3d4e5!") == "a9a9a9a9a9!"
    blob = "日" * 5000
    assert (cotraining.content_features(blob) != cotraining.content_features(blob + "9%" * 50))[: cotraining.SHAPES].any()


def test_ordinary_samples_reach_every_source_and_language(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("plain common words here").alias("text"), F.lit("web").alias("source"), F.lit("en").alias("lang"))
    rare = spark.createDataFrame([(10**6 + i, f"rare{i}x kind{i}y of{i}z", f"s{i}", None if i % 2 else "de") for i in range(20)], "doc_id long, text string, source string, lang string")
    found = {r["text"] for r in secret_scan.default_samples(df.unionByName(rare)).where("label = 0").select("text").distinct().collect()}
    assert all(f"rare{i}x" in found for i in range(20))
    common = secret_scan.default_samples(df).where("label = 0 AND text = 'plain'").count()
    assert 400 <= common <= 600
