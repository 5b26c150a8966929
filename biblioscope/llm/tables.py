"""Written intermediate tables and joins that stand hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioscope.session import checkpoint_root

WORD = r"[^\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/llm-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, survives executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """Shuffle partitions, which the cluster sets in proportion to its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def key_buckets(spark: SparkSession) -> int:
    """Buckets of a packed key exchange: a task sorts a bucket's keys in memory."""
    return 2 * parts(spark)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """Hash that tells texts of one id apart; a null text is an empty one."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


BROADCAST_BYTES = 4 << 20
SALTS = 16


def lookup(facts: DataFrame, table: DataFrame, key: str, spread: Column, how: str = "left",
           left_key: str | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``facts`` joined to ``table`` (one row per ``key``; null matches null).

    ``table`` must be a written table: its bytes are measured, and it is broadcast
    only within ``broadcast_bytes``.  Beyond that a fact row takes one of ``SALTS``
    salts from ``spread`` (a hash of its other columns) and ``table`` is copied once
    per salt, so a key with a third of all rows is dealt to ``SALTS`` tasks; these
    copies are joined by sorting and never reach the driver.
    """
    left_key = left_key or key
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in table.columns), F.lit(16))
    size = table.agg(F.sum(width)).first()[0] or 0
    taken = {c.lower() for c in facts.columns + table.columns}
    joined, salt, copy = (next(n for n in (f"{base}_{i}" for i in range(len(taken) + 1)) if n not in taken)
                          for base in ("lookup_key", "lookup_salt", "lookup_copy"))
    right = table.withColumnRenamed(key, joined)
    if size <= broadcast_bytes:
        out = facts.join(F.broadcast(right), facts[left_key].eqNullSafe(right[joined]), how)
    else:
        left = facts.withColumn(salt, F.pmod(spread, F.lit(SALTS)).cast("int"))
        # Spark's estimate sees compressed files and not the copies, so left to itself it may broadcast them
        right = right.withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        out = left.join(right, left[left_key].eqNullSafe(right[joined]) & (left[salt] == right[copy]), how)
    return out.drop(joined, salt, copy)


def without(docs: DataFrame, gone: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the documents of ``gone`` (doc_id, text_key): both must match, and a null id matches a null id."""
    taken = {c.lower() for c in docs.columns}
    key = next(n for n in (f"row_key_{i}" for i in range(len(taken) + 1)) if n not in taken)
    rows = docs.withColumn(key, F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key")))
    table = written(gone.select(F.struct("doc_id", "text_key").alias("gone")).distinct(), "gone")
    return lookup(rows, table, "gone", F.xxhash64("text"), how="left_anti", left_key=key, broadcast_bytes=broadcast_bytes).drop(key)
