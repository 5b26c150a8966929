"""Distributions of per-country quartile counts: histogram and kernel density.

Input is the long table (country, quartile, n).  Range statistics are scalar
subqueries (one row each); per-quartile statistics are at most one row per
quartile label and are broadcast with that proven bound.  No cross join and no
driver round trip is planned.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biblioscope.functions.binning import bin_edges, equal_width_bin

# Fixed values of the plotting defaults reproduced here.
HISTOGRAM_BINS = 20
DENSITY_GRID = 200


def quartile_count_histogram(long: DataFrame, bins: int = HISTOGRAM_BINS,
                             digits: int = 6) -> DataFrame:
    """Countries per (quartile, bin) over one shared range, with stacked bar tops.

    Only non-empty cells are returned; ``stack_top`` adds the cells of the same bin
    in quartile order (the stacked drawing), ``n`` is the bar's own height.
    """
    # One scalar subquery, projected once: the shared range of all values.
    rng = long.select(F.struct(F.min("n").alias("lo"), F.max("n").alias("hi"))).scalar()
    ranged = long.select("quartile", "n", rng.alias("_r"))
    lo, hi = F.col("_r.lo"), F.col("_r.hi")
    b = equal_width_bin(F.col("n"), lo, hi, bins)
    cells = (ranged.groupBy("quartile", b.alias("bin"), F.col("_r").alias("_r"))
             .agg(F.count(F.lit(1)).alias("n")))
    start, end = bin_edges(F.col("bin"), lo, hi, bins)
    stack = Window.partitionBy("bin").orderBy("quartile").rowsBetween(Window.unboundedPreceding, 0)
    return cells.select(
        "quartile", "bin",
        F.round(start, digits).alias("bin_start"),
        F.round(end, digits).alias("bin_end"),
        "n",
        F.sum("n").over(stack).alias("stack_top"),
    )


def quartile_count_density(long: DataFrame, grid: int = DENSITY_GRID, bins: int = HISTOGRAM_BINS,
                           digits: int = 6) -> DataFrame:
    """Gaussian kernel density per quartile, as drawn over the stacked histogram.

    * Bandwidth: Scott's rule, ``std * n ** (-1/5)`` with the sample standard
      deviation of the quartile's values.
    * Support: one ``grid``-point grid shared by all quartiles, from the smallest
      to the largest value of all quartiles (no extension beyond the data),
      i.e. the histogram's range.
    * ``density`` integrates to 1 over the real line; ``count_density`` is
      ``density * n * bin_width``, the curve scaled to the histogram's counts;
      ``stack_top`` stacks ``count_density`` over the quartiles in order at each
      grid point.
    * Quartiles with fewer than two values or no spread have no curve.

    Each value contributes to the ``grid`` points (a fixed fan-out), and the
    contributions are summed per (quartile, point).
    """
    rng = long.select(F.struct(F.min("n").alias("lo"), F.max("n").alias("hi"))).scalar()
    stats = (long.groupBy("quartile")
             .agg(F.count(F.lit(1)).alias("cnt"), F.stddev_samp("n").alias("sd"))
             .where((F.col("cnt") >= 2) & (F.col("sd") > 0))
             .withColumn("bw", F.col("sd") * F.pow(F.col("cnt").cast("double"), F.lit(-0.2))))
    # At most one row per quartile label: a proven broadcast bound.
    points = long.join(F.broadcast(stats), "quartile").select(
        "quartile", "n", "cnt", "bw", rng.alias("_r"))
    lo, hi = F.col("_r.lo").cast("double"), F.col("_r.hi").cast("double")
    i = F.col("i")
    x = lo + (i * (hi - lo)) / (grid - 1)
    u = (x - F.col("n")) / F.col("bw")
    kernel = F.exp(-0.5 * u * u) / (F.col("cnt") * F.col("bw") * math.sqrt(2 * math.pi))
    curves = (points
              .select("quartile", "n", "cnt", "bw", "_r",
                      F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
              .select("quartile", "cnt", "_r", i.alias("point"), x.alias("x"), kernel.alias("k"))
              .groupBy("quartile", "point", "x", "cnt", "_r")
              .agg(F.sum("k").alias("density")))
    bin_width = (hi - lo) / bins
    scaled = curves.withColumn("count_density", F.col("density") * F.col("cnt") * bin_width)
    stack = Window.partitionBy("point").orderBy("quartile").rowsBetween(Window.unboundedPreceding, 0)
    return scaled.select(
        "quartile", "point",
        F.round("x", digits).alias("x"),
        F.round("density", digits).alias("density"),
        F.round("count_density", digits).alias("count_density"),
        F.round(F.sum("count_density").over(stack), digits).alias("stack_top"),
    )
