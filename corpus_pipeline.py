"""The corpus pipeline: five stages, each over all that the stage before it kept.

1. quality classifier  - importance resampling; rejected documents go
2. line dedup          - later repeated runs of lines go, the rows stay
3. near duplicates     - of each group of similar texts the smallest id stays
4. mixing              - every document as often as its source's target weight says
5. packing             - length buckets and token-budget batches

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame`` whose result is
written as Parquet and read again as the next stage's ``docs``; all but the last
return the columns of ``documents``.

Texts and ids may be null, repeated or empty, and the table may be empty or carry
further columns: each operator states its result for these cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioscope.llm import jaccard_join, line_dedup, mixing, packing, resampling
from biblioscope.llm.tables import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps."""
    return resampling.keep_good(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines, a long line being a run of its own."""
    return line_dedup.dedup_lines(docs, long_words=line_dedup.LONG_WORDS).drop("_n_lines", "_n_removed")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on five-word shingles."""
    return jaccard_join.keep_one(docs, shingle=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for."""
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every copy."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates),
          ("mixing", mix), ("packing", pack)]

# The resampling, the similarity groups and the dynamic programme are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
