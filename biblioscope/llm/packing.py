"""Packing into optimal length buckets.

A global histogram of lengths goes to the driver, where dynamic programming chooses
at most ``buckets`` upper bounds that minimise the padding of all rows, a row being
padded to its bucket's bound.  Inside each bucket, rows fill batches of
floor(budget / bound) rows (one at least), so a padded batch keeps the token budget.

Every length counts exactly, so a bound is the longest length of its bucket.  The
histogram has a row per distinct length: at most the root of twice the corpus's words.

Rows get their place in a bucket without one task holding the bucket: they are dealt
to slices by a hash, numbered inside the slice, and shifted by the sums of the slices
before.  Equal ids are counted first and numbered as a run.

Defined results: a null text has length 0 and lands in the first bucket; equal rows
are numbered one after the other; an empty table gives an empty result; only id and
length are carried, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioscope.llm.tables import parts, word_count, written

BUCKETS = 16
BUDGET = 32_768


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    cost(i, j) = length[j] * (count of i+1..j) - (tokens of i+1..j).  For a fixed j the
    choice of i is a lower envelope of lines with falling slopes, visited at rising
    lengths, so a layer takes linear time.
    """
    lengths, counts = np.asarray(lengths, float), np.asarray(counts, float)
    n = len(lengths)
    if n == 0:
        return []
    rows = np.concatenate([[0.0], np.cumsum(counts)])
    tokens = np.concatenate([[0.0], np.cumsum(counts * lengths)])
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    choice = []
    for _ in range(min(buckets, n)):
        layer, came = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        hull: list[tuple[float, float, int]] = []        # slope, intercept, i
        head = 0
        for j in range(1, n + 1):
            i = j - 1
            if np.isfinite(best[i]):
                line = (-rows[i], best[i] + tokens[i], i)
                while len(hull) - head >= 2 and _useless(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            x = lengths[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            if len(hull) > head:
                m, b, i = hull[head]
                layer[j], came[j] = m * x + b + x * rows[j] - tokens[j], i
        best = layer
        choice.append((layer[n], came))
    used = min(range(len(choice)), key=lambda k: choice[k][0])
    bounds, j = [], n
    for k in range(used, -1, -1):
        bounds.append(int(lengths[j - 1]))
        j = choice[k][1][j]
    return bounds[::-1]


def _useless(a: tuple, b: tuple, c: tuple) -> bool:
    """True when line b is nowhere the lowest between a and c (slopes fall)."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def pack(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, buckets: int = BUCKETS,
         budget: int = BUDGET, slices: int | None = None) -> DataFrame:
    """One row per input row: n_tokens, bucket, padded_length, batch (within the bucket), place (within the batch)."""
    spark = docs.sparkSession
    slices = slices or parts(spark)
    length = word_count(F.col("text")) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    # rows equal in id and length are one counted row: numbered as a run below
    runs = written(docs.select(F.col(id_col).alias("doc_id"), length.alias("n_tokens"))
                   .groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("copies")), "lengths")
    histogram = (runs.groupBy("n_tokens").agg(F.sum("copies").alias("rows")).orderBy("n_tokens").collect())
    bounds = optimal_bounds(np.array([r["n_tokens"] for r in histogram]), np.array([r["rows"] for r in histogram]), buckets)
    bucket, bound = F.lit(0), F.lit(bounds[-1] if bounds else 0)
    for i, b in reversed(list(enumerate(bounds))):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(i)).otherwise(bucket)
        bound = F.when(F.col("n_tokens") <= b, F.lit(b)).otherwise(bound)
    placed = runs.select("doc_id", "n_tokens", "copies", bucket.cast("int").alias("bucket"),
                         bound.cast("long").alias("padded_length"),
                         F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(slices)).cast("int").alias("slice"))
    totals = placed.groupBy("bucket", "slice").agg(F.sum("copies").alias("rows"))     # buckets x slices rows
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("bucket", "slice", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    upto = (Window.partitionBy("bucket", "slice").orderBy("doc_id", "n_tokens")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = (placed.withColumn("end", F.sum("copies").over(upto)).join(offsets, ["bucket", "slice"])
                .withColumn("rank", F.explode(F.sequence(F.col("offset") + F.col("end") - F.col("copies"),
                                                         F.col("offset") + F.col("end") - 1))))
    size = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("padded_length"), F.lit(1))), F.lit(1)).cast("long")
    return numbered.select("doc_id", "n_tokens", "bucket", "padded_length",
                           F.floor(F.col("rank") / size).cast("long").alias("batch"),
                           (F.col("rank") % size).alias("place"))
