"""A training corpus from documents: rejects poor ones, keeps one of each near-duplicate group, redacts secrets, mixes
sources to weights and encodes.

Each stage takes all rows its predecessor kept and returns the columns of documents, the last one the token ids.
Between stages rows are written as parquet in the shared folder, so a lost executor costs no more than one
stage's tasks. Null and empty texts pass: the classifier scores them, they duplicate nothing, hold no secrets, take no words
and have no tokens. Rows that repeat one id stay or go together. Columns of documents beyond its own are carried along,
but for the last stage, which returns doc_id, source, lang, n_tokens and token_ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import bpe, cotraining, jaccard_join, mixing, secret_scan
from panelwright.llm.common import stored, table
from panelwright.llm.queries import MIX

#: Dropped ids up to which they are broadcast, 8 bytes each; beyond, Spark joins as it sees fit.
BROADCAST_IDS = 1_000_000
#: Least chance of being good of the documents that stay.
KEPT = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained views do not reject."""
    model = cotraining.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(cotraining.chances(docs, model)["score"] >= KEPT)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    dropped = stored(jaccard_join.join(docs.select("doc_id", "text")).where("component_id <> doc_id").select("doc_id").distinct())
    few = dropped.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced by a mark, and their new lengths."""
    models = secret_scan.train(secret_scan.default_samples(docs.select("doc_id", "text", "source", "lang")))
    return docs.withColumn("text", secret_scan.clean(F.col("text"), models)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix repeats them."""
    slim = stored(mixing.slim_rows(docs))
    return mixing.apply(docs, mixing.plan(slim, **MIX), MIX["max_epochs"])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    import public_tokenizers as tokenizers

    coded = bpe.coded(docs.select("doc_id", "source", "lang", "text"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN, decode=False)
    return coded.select("doc_id", "source", "lang", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_join),
    ("secret scans", secrets),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: training a classifier is not expressible.
ORACLE_SQL = None
