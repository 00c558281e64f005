"""A corpus cleaning pipeline from the operators on training text.

Each stage takes (spark, docs, sf_dir) and returns a table: toxic documents go,
one document of each class of near-duplicates stays, documents that hold
benchmark passages go, secrets are masked, and the rest is encoded. Labels and
benchmark come from ``sf_dir``. All other columns pass through as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import contamination, order_minhash, pieces, queries, secrets, storage, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that score below the threshold."""
    return toxicity.accept(docs, queries.toxicity_lexicon(spark, docs, sf_dir), queries.TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least id of each class."""
    return order_minhash.first_of_class(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no window of a benchmark text."""
    return contamination.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets; ``n_chars`` follows the text."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the ids of every text, their number, and the text that they decode to."""
    encoded = pieces.round_trip(docs, queries.model_path())
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", reject_toxic),
    ("order_minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", mask_secrets),
    ("sentencepiece", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each reading what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
