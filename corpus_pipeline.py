"""The corpus pipeline: quality, near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before
kept; its result is written as Parquet and read again. All but the last keep the
columns of ``docs``; the last returns each kept document's token ids. No stage
joins on doc_id alone, so null or repeated ids do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import bpe, decontaminate, neardup, quality
from tallymill.llm.common import bounded, saved, spare

#: Documents with a lower score than this are rejected.
LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the rule ensemble scores under LEAST_QUALITY."""
    model = quality.fit(docs, bounded(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    score = spare(docs.columns, "__score")
    return quality.score_rows(docs, model, score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word similarity 0.8 or more stays: the one with the smallest doc_id.

    The fingerprint search comes first, buckets of minima find what it can't reach, texts decide.
    """
    bounded(spark)
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark item or a near copy of one."""
    return decontaminate.clean(docs, bounded(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, n_bytes): token ids, and the bytes that they decode to."""
    bounded(spark)
    both = bpe.round_trip(docs)
    return both.select("doc_id", "n_tokens", "ids", F.octet_length("decoded").cast("long").alias("n_bytes"))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]

#: SQL has neither the classifier nor the hashes; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
