"""Documents to training pieces: quality, near-dedup, decontamination, personal data, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept; what it returns is written as Parquet and read again by the next.
All but the last return the columns of `documents`, and any others that it has.

Defined results, of every stage: an empty table gives an empty one; null and empty
texts are scored by the intercept (quality), are near copies of each other (neardup;
those without an id all stay), are clean (decontamination), stay as they are (personal data)
and have no pieces (encoding); equal rows with an id are one document from near-dedup on,
those without an id all stay; of copies the least doc_id stays; very long texts are
read whole. Without labels every document scores 0.5 and stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import decontaminate, neardup, pieces, pii, quality
from pixelloom.llm.common import bucket_of, read_table, remove, work_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 go."""
    model = quality.QualityModel.fit(docs, read_table(spark, sf_dir, "labels"), use=bucket_of("doc_id", 3) != 1)
    return quality.keep_good(docs, model)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays."""
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    return pii.redact_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its pieces' ids instead of its text."""
    out = pieces.encode(docs, keep=("doc_id", "lang", "source", "n_chars"))
    return out.withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("quality", quality_stage),
    ("neardup", neardup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("encoding", encoding_stage),
]
#: The compression classifier is not expressible in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again; a stage's table goes when the next one's is written."""
    docs, folder = read_table(spark, sf_dir, "documents"), work_dir(spark, "corpus")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.mode("overwrite").parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
        if i:
            remove(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
