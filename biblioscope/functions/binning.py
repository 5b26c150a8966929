"""Equal-width histogram bins over a shared range (numpy's rule)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def equal_width_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based bin of integer ``x`` among ``bins`` bins spanning [lo, hi].

    ``(x - lo) * bins`` and ``hi - lo`` are exact integers and their quotient is
    correctly rounded, so a value on an edge lands in the upper bin exactly; the
    maximum belongs to the last bin.  When lo == hi the range is widened by 0.5 on each side, which puts
    every value in the middle bin.
    """
    regular = F.least(F.floor(((x - lo) * bins) / (hi - lo)).cast("int"), F.lit(bins - 1))
    return F.when(hi == lo, F.lit(bins // 2)).otherwise(regular)


def bin_edges(b: Column, lo: Column, hi: Column, bins: int) -> tuple[Column, Column]:
    lo_d = F.when(hi == lo, lo - 0.5).otherwise(lo).cast("double")
    width = F.when(hi == lo, F.lit(1.0)).otherwise((hi - lo).cast("double"))
    return lo_d + b * width / bins, lo_d + (b + 1) * width / bins
