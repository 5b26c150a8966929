"""Exact places in a sorted order, without a window over all rows.

Rows are dealt to slices by ranges of the order, one slice a shuffle partition; rows
of a slice are numbered on their own and take the number of rows before their slice.
Rows that are equal in the whole order still spread over slices, by their place in
the input, so a hot key is no hot slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioscope.llm.tables import parts, written


def ranked(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``place`` (from 0, in ``order`` within ``group``) and ``members`` (rows of the group).

    ``rows`` must be a written table or a scan, so that it reads alike every time; its
    columns must leave the names ``slice``, ``tie``, ``place`` and ``members`` free and
    ``group`` non-null.
    """
    n = parts(rows.sparkSession)
    dealt = (rows.withColumn("tie", F.monotonically_increasing_id())
             .repartitionByRange(n, F.col(group), *order, F.col("tie")).withColumn("slice", F.spark_partition_id()))
    dealt = written(dealt, "slices")
    # at most one row a group and one a slice: a slice holds a range of the groups
    counts = dealt.groupBy(group, "slice").agg(F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy(group)
    upto = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "slice", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("before"),
                           F.sum("rows").over(whole).alias("members"))
    inside = Window.partitionBy(group, "slice").orderBy(*order, "tie")
    placed = (dealt.join(counts, [group, "slice"])
              .withColumn("place", F.col("before") + F.row_number().over(inside) - 1))
    return placed.select(*rows.columns, "place", "members")
