"""Countries that publish together: pairs, triples, any k, and the weighted graph.

A k-tuple of countries counts once per doi whose authors' labs cover all k.  The
distinct country set of each doi is built once (one shuffle by doi), its
k-combinations are generated inside the row by chained generators, and the
tuples are counted with a partial+final aggregation (one shuffle by tuple,
pre-combined map-side).  A doi with n distinct countries emits C(n, k) tuples;
n is bounded by the number of countries, not by the size of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioscope.functions.combinations import PER_ROW, explode_combinations
from biblioscope.operators.affiliations import article_countries

TUPLE_NAMES = ("country_a", "country_b", "country_c", "country_d", "country_e")


def country_tuples(doi_countries: DataFrame, k: int, balanced: bool = False) -> DataFrame:
    """Dois per k-tuple; ``balanced`` spreads the tuples of very large sets (for a written table)."""
    if not 2 <= k <= len(TUPLE_NAMES):
        raise ValueError(f"k must be in 2..{len(TUPLE_NAMES)}")
    names = list(TUPLE_NAMES[:k])
    sets = doi_countries.where(F.size("countries") >= k)
    return (explode_combinations(sets, "countries", names, per_row=PER_ROW if balanced else None)
            .groupBy(*names)
            .agg(F.count(F.lit(1)).alias("collaboration_count")))


def ordered_tuples(tuples: DataFrame, k: int) -> DataFrame:
    """Most frequent first, ties by the countries."""
    return tuples.orderBy(F.desc("collaboration_count"), *TUPLE_NAMES[:k])


def country_collaborations(articles: DataFrame, authors_labs: DataFrame, k: int = 2,
                           ordered: bool = True, **join_opts) -> DataFrame:
    """Counts per k-tuple; ``ordered`` sorts by count (desc) then countries."""
    tuples = country_tuples(article_countries(articles, authors_labs, **join_opts), k)
    return ordered_tuples(tuples, k) if ordered else tuples


def country_pairs(articles: DataFrame, authors_labs: DataFrame, ordered: bool = True,
                  **join_opts) -> DataFrame:
    return country_collaborations(articles, authors_labs, 2, ordered, **join_opts)


def country_triples(articles: DataFrame, authors_labs: DataFrame, ordered: bool = True,
                    **join_opts) -> DataFrame:
    return country_collaborations(articles, authors_labs, 3, ordered, **join_opts)


def collaboration_edges(pairs: DataFrame) -> DataFrame:
    """Undirected weighted edges, src < dst."""
    return pairs.select(F.col("country_a").alias("src"), F.col("country_b").alias("dst"),
                        F.col("collaboration_count").alias("weight"))


def collaboration_nodes(edges: DataFrame) -> DataFrame:
    """Every endpoint with its degree and weighted degree."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.col("weight")),
        F.struct(F.col("dst").alias("node"), F.col("weight")),
    )).alias("e")).select("e.node", "e.weight")
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"),
                                    F.sum("weight").alias("weighted_degree"))
