"""Joining a large fact side to a dimension whose size is checked, not assumed.

``join_dimension`` first measures the dimension: its rows and the bytes of their values.
Within the bound the dimension is broadcast and the fact side is not shuffled at all.
The bound is ``spark.sql.autoBroadcastJoinThreshold``, the cluster's own broadcast
budget; a threshold of -1 disables broadcasting.

Beyond the bound the join is a shuffle join in which only hot keys are salted:

1. rows per key on the fact side are counted (partial aggregation, map-side
   combined).  With ``P`` shuffle partitions, at most ``P`` keys can each hold
   more than ``1/P`` of the rows - the hot-key table has a proven size bound and
   is broadcast;
2. a hot key holding share ``s`` of the rows gets ``ceil(2 * s * P)`` salt buckets;
   its fact rows take a salt from a hash of their own columns (not ``rand()``, so
   a recomputed task after an executor loss yields the same rows), and its
   dimension rows are replicated once per bucket;
3. all other keys keep salt 0, so the dimension grows by at most about ``2P``
   rows in total, and one shuffle join on ``(key, salt)`` finishes the work.

A lab holding a third of all rows is then spread over a third of the reducers
instead of landing on one.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioscope.session import checkpoint_root

# What a value and a row take besides their text when a side is measured.
VALUE_BYTES, ROW_BYTES = 8, 16


def broadcast_limit(df: DataFrame) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes; -1 where broadcasting is off."""
    spark = df.sparkSession
    value = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").strip().lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20,
             "g": 1 << 30, "gb": 1 << 30}
    for suffix in sorted(units, key=len, reverse=True):
        if value.endswith(suffix) and value[: -len(suffix)].strip().lstrip("-").isdigit():
            limit = int(value[: -len(suffix)]) * units[suffix]
            break
    else:
        limit = int(value)
    return max(limit, -1)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df`` and the bytes its values take, both from one partial sum per task."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + VALUE_BYTES for c in df.columns), F.lit(ROW_BYTES))
    row = df.agg(F.count(F.lit(1)), F.sum(width)).first()
    return row[0], row[1] or 0


def dimension_fits(dim: DataFrame, max_rows: int | None = None) -> bool:
    """True when ``dim`` may be broadcast: at most ``max_rows`` rows, or within the session's bytes."""
    limit = broadcast_limit(dim)
    if (max_rows if max_rows is not None else limit) < 0:
        return False
    rows, size = measured(dim)
    return rows <= max_rows if max_rows is not None else size <= limit


# Buckets per hot key = ceil(spread * share * partitions): each bucket then holds at
# most 1/spread of a partition's fair share, which absorbs hash collisions of
# buckets onto the same partition.
HOT_KEY_SPREAD = 2


def hot_keys(fact: DataFrame, keys: list[str], partitions: int,
             spread: int = HOT_KEY_SPREAD) -> DataFrame:
    """Keys holding more than ``1/partitions`` of the fact rows, with their bucket count.

    At most ``partitions`` rows by construction.
    """
    counts = fact.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.select(F.sum("_rows")).scalar()
    share = counts.select(*keys, "_rows", total.alias("_total"))
    buckets = F.ceil(F.col("_rows") * (spread * partitions) / F.col("_total")).cast("int")
    return (share.where(F.col("_rows") * partitions > F.col("_total"))
            .select(*keys, buckets.alias("_buckets")))


def hot_salted_join(fact: DataFrame, dim: DataFrame, keys: list[str], how: str,
                    partitions: int) -> DataFrame:
    # Computed once and cut from the lineage (checkpoint to the shared folder);
    # both join sides then read the same small table.
    checkpoint_root(fact.sparkSession)   # the cluster's shared folder (set only if unset)
    hot = F.broadcast(hot_keys(fact, keys, partitions).checkpoint())
    payload = [c for c in fact.columns if c not in keys] or fact.columns
    buckets = F.coalesce(F.col("_buckets"), F.lit(1))
    salted_fact = (fact.join(hot, keys, "left")
                   .withColumn("_salt", F.pmod(F.xxhash64(*payload), buckets.cast("long")).cast("int"))
                   .drop("_buckets"))
    salted_dim = (dim.join(hot, keys, "left")
                  .withColumn("_salt", F.explode(F.sequence(F.lit(0), buckets - 1)))
                  .drop("_buckets"))
    return salted_fact.join(salted_dim, keys + ["_salt"], how).drop("_salt")


def join_dimension(fact: DataFrame, dim: DataFrame, on: str | list[str], how: str = "inner",
                   max_broadcast_rows: int | None = None,
                   partitions: int | None = None) -> DataFrame:
    """``fact`` joined to ``dim`` on equal keys; the fact side is kept for ``left``."""
    keys = [on] if isinstance(on, str) else list(on)
    if how not in ("inner", "left"):
        raise ValueError("join_dimension supports inner and left joins (fact side kept)")
    if dimension_fits(dim, max_broadcast_rows):
        return fact.join(F.broadcast(dim), keys, how)
    # Null keys match nothing: they stay out of the shuffle.
    null_key = reduce(or_, (F.col(k).isNull() for k in keys))
    joined = hot_salted_join(fact.where(~null_key), dim, keys, how, partitions or shuffle_partitions(fact))
    if how == "inner":
        return joined
    return joined.unionByName(fact.where(null_key), allowMissingColumns=True)
