"""k-combinations of a sorted array column, one output row per combination.

For a row holding ``[a, b, c]`` and k = 2 this yields the rows ``(a, b)``,
``(a, c)``, ``(b, c)``.  It runs inside each row (one doi's distinct country
set), so pairs and triples need no self-join and no second shuffle by doi.

The enumeration is a chain of ``posexplode`` generators over ``slice``s of the
array: level ``i`` picks an element at 1-based position ``s + p`` and the next
level explodes the slice starting right after it.  Generators and ``slice``
are compiled by whole-stage codegen (a lambda-based ``transform`` is
interpreted per row and was several times slower).

A set with more than ``per_row`` combinations is not left to one task: its first
positions become rows, and since the combinations that begin before position p are
C(n, k) - C(n - p, k) in number, that count puts each position into one of as many
buckets of equal cost as there are shuffle partitions.  Smaller sets stay where they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_ROW = 1 << 16


def combinations_of(n: Column, k: int) -> Column:
    """C(n, k) as a double; 0 where n < k."""
    product = F.lit(1.0)
    for i in range(k):
        product = product * F.greatest(n - i, F.lit(0))
    return product / float(math.factorial(k))


def _finish(cur: DataFrame, arr: Column, names: list[str], keep: tuple[str, ...]) -> DataFrame:
    """The positions after the first, for rows that carry the array, its first pick and the next start."""
    start, picked = "_comb_start", [names[0]]
    for name in names[1:]:
        length = F.greatest(F.size(arr) - F.col(start) + 1, F.lit(0))
        tail = F.slice(arr, F.col(start), length)
        cur = cur.select(*keep, arr, start, *picked, F.posexplode(tail).alias("_comb_pos", name))
        cur = cur.withColumn(start, F.col(start) + F.col("_comb_pos") + 1)
        picked.append(name)
    return cur.select(*keep, *names)


def explode_combinations(df: DataFrame, array_col: str, names: list[str],
                         keep: tuple[str, ...] = (), per_row: int | None = None) -> DataFrame:
    """Rows ``keep + names``: every k-combination (k = len(names)) in array order.

    With ``per_row`` sets of more combinations are spread; ``df`` is then read twice, so it
    should be a written table.
    """
    arr, k = F.col(array_col), len(names)
    cost = combinations_of(F.size(arr), k)

    def first(rows: DataFrame) -> DataFrame:
        out = rows.select(*keep, arr, F.posexplode(arr).alias("_comb_pos", names[0]))
        return out.withColumn("_comb_start", F.col("_comb_pos") + 2)

    if per_row is None:
        return _finish(first(df), arr, names, keep)
    small = _finish(first(df.where(cost <= per_row)), arr, names, keep)
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    large = first(df.where(cost > per_row))
    before = 1.0 - combinations_of(F.size(arr) - F.col("_comb_pos"), k) / cost
    bucket = F.pmod(F.xxhash64(arr) + F.floor(before * buckets), F.lit(buckets)).cast("int")
    spread = large.withColumn("_comb_bucket", bucket).repartitionById(buckets, F.col("_comb_bucket")).drop("_comb_bucket")
    return small.unionByName(_finish(spread, arr, names, keep))
