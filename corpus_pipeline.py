"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and
returns a DataFrame; run() writes every result as Parquet in the folder that
driver and executors share and reads it again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import langid, neardup, packing, secrets, substrings
from assayer.llm.common import SPACES, Workspace, columns

#: Language ID rejects a document below this posterior.
LEAST_SCORE = 0.5
#: Near-duplicates share so many hundredths of their shingles or more.
SIMILAR = 80


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null or letterless texts, and posteriors below LEAST_SCORE."""
    model = langid.train(langid.split(docs).where(~F.col("held_out")))
    kept = langid.predict(docs, model).where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id; rows go, not ids."""
    return neardup.distinct_documents(docs, threshold=SIMILAR)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; a document of which no word is left goes."""
    cut = substrings.deduplicate(docs)
    blank = F.length(F.translate(F.col("text"), SPACES, "")) == 0
    cut = cut.where(~(blank & (F.col("removed_words") > 0)))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their kind."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences."""
    return packing.pack(columns(docs, doc_id="doc_id", text="text"))


STAGES = [
    ("language_id", identify),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("secret_scan", redact),
    ("best_fit_packing", pack),
]

#: Language models, MinHash and rolling hashes have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            work.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
