"""Quartile labels and their rank (best = 1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The quartile domain, best first.
QUARTILES = ("Q1", "Q2", "Q3", "Q4")


def quartile_rank(q: Column) -> Column:
    """Q1 -> 1 ... Q4 -> 4; any other value (or null) -> null."""
    expr = F.when(q == QUARTILES[0], F.lit(1))
    for i, label in enumerate(QUARTILES[1:], start=2):
        expr = expr.when(q == label, F.lit(i))
    return expr
