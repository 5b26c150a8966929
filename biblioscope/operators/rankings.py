"""Journal rankings: flattening and quartile statistics.

All inputs are the flattened rankings, one row per (journal, category, year).
Every statistic below is a hash aggregation with partial aggregation, so hot
countries or categories are pre-combined before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioscope.functions.quartiles import QUARTILES, quartile_rank


def journals_flat(journals: DataFrame) -> DataFrame:
    """One row per ranking entry; journals without rankings vanish.

    ``explode`` plus field access (rather than ``inline``) lets Catalyst prune
    the nested scan, e.g. to ``data: array<struct<quartile>>`` for the
    per-country counts.
    """
    entries = journals.select("journal_name", "issn", "country", F.explode("data").alias("_e"))
    return entries.select("journal_name", "issn", "country",
                          *[F.col("_e")[f].alias(f) for f in ("category", "year", "quartile")])


def quartile_counts(flat: DataFrame, key: str) -> DataFrame:
    """Rows per (key, quartile); null keys and null quartiles dropped."""
    return (flat.where(F.col(key).isNotNull() & F.col("quartile").isNotNull())
            .groupBy(key, "quartile")
            .agg(F.count(F.lit(1)).alias("n")))


def quartile_by_category(flat: DataFrame) -> DataFrame:
    return quartile_counts(flat, "category")


def quartile_by_year(flat: DataFrame) -> DataFrame:
    return quartile_counts(flat, "year")


def countries_per_quartile(flat: DataFrame) -> DataFrame:
    """Number of distinct countries having at least one row of each quartile."""
    return (flat.where(F.col("country").isNotNull() & F.col("quartile").isNotNull())
            .groupBy("quartile")
            .agg(F.countDistinct("country").alias("n")))


def best_quartile_heatmap(flat: DataFrame) -> DataFrame:
    """Best quartile (1 = Q1 ... 4 = Q4, 0 = none) per category and year, dense.

    The grid is every category present times every year present; a cell whose
    rows carry no Q1-Q4 value (null or another label) is 0, like an absent cell.  Years form a
    small bounded domain; their sorted list is a scalar subquery, and each
    category row expands over it, looking its own cells up in a per-category map
    (at most one entry per year).  No cross join is planned.
    """
    base = flat.where(F.col("category").isNotNull() & F.col("year").isNotNull())
    cells = base.groupBy("category", "year").agg(F.min(quartile_rank(F.col("quartile"))).alias("best"))
    years = base.select(F.array_sort(F.collect_set("year"))).scalar()
    per_category = cells.groupBy("category").agg(
        F.map_from_entries(F.collect_list(F.struct("year", "best"))).alias("cells"))
    return per_category.select("category", "cells", years.alias("years")).select(
        "category", F.inline(F.transform(
        "years",
        lambda y: F.struct(y.alias("year"),
                           F.coalesce(F.try_element_at(F.col("cells"), y), F.lit(0)).alias("best_quartile")),
    )))


def quartile_by_country_wide(flat: DataFrame) -> DataFrame:
    """Per country, Q1..Q4 row counts, zero when absent; null countries dropped."""
    q = F.col("quartile")
    return (flat.where(F.col("country").isNotNull())
            .groupBy("country")
            .agg(*[F.count_if(q == label).alias(label) for label in QUARTILES]))


def wide_to_long(wide: DataFrame) -> DataFrame:
    """(country, Q1..Q4) melted to (country, quartile, n), zeros included."""
    return wide.unpivot("country", list(QUARTILES), "quartile", "n")


def quartile_by_country_long(flat: DataFrame) -> DataFrame:
    """The wide table melted to (country, quartile, n), zeros included."""
    return wide_to_long(quartile_by_country_wide(flat))


def label_counts_by_country(flat: DataFrame) -> DataFrame:
    """Rows per (country, label), whatever the label; null countries and labels dropped."""
    return quartile_counts(flat, "country")


def wide_from_labels(labels: DataFrame) -> DataFrame:
    """``quartile_by_country_wide`` from ``label_counts_by_country``.

    A country all of whose rows lack a label has no row in ``labels``; the callers add it.
    """
    n = F.col("n")
    return labels.groupBy("country").agg(
        *[F.coalesce(F.sum(F.when(F.col("quartile") == label, n)), F.lit(0)).cast("long").alias(label) for label in QUARTILES])


def dense_labels(labels: DataFrame) -> DataFrame:
    """(country, quartile, n, total): every country with every label of the data, zeros included.

    The label list is a scalar subquery over the counted table, so labels are rows all
    the way: their spelling and number never become columns, and building the plan runs
    no job.  A country's absent labels are the list without its own (one hash lookup a
    label); no cross join is planned.
    """
    every = labels.select(F.array_sort(F.collect_set("quartile"))).scalar()
    own = labels.groupBy("country").agg(F.collect_list(F.struct("quartile", "n")).alias("own"), F.sum("n").alias("total"))
    own = own.select("country", "own", "total", every.alias("every"))
    absent = F.transform(F.array_except("every", F.col("own")["quartile"]),
                         lambda q: F.struct(q.alias("quartile"), F.lit(0).cast("long").alias("n")))
    return own.select("country", "total", F.inline(F.concat("own", absent))).select("country", "quartile", "n", "total")


def label_table_by_country(labels: DataFrame) -> DataFrame:
    """Country x label counts as rows, zeros included, for every label the data carries."""
    return dense_labels(labels).select("country", "quartile", "n")


def label_share_by_country(labels: DataFrame, digits: int = 6) -> DataFrame:
    share = F.round(F.col("n").cast("double") / F.col("total"), digits)
    return dense_labels(labels).select("country", "quartile", share.alias("share"))


def quartile_share_by_country(flat: DataFrame, digits: int = 6) -> DataFrame:
    """Share of every label the data carries in a country's labelled rows.

    Rows without country or label do not count; a label that a country lacks has
    share 0, and a country without any label does not appear.
    """
    return label_share_by_country(label_counts_by_country(flat), digits)


def unranked_by_country(labels: DataFrame) -> DataFrame:
    """Per country, its labelled rows and those whose label is none of Q1-Q4, with their share."""
    n, other = F.col("n"), ~F.col("quartile").isin(*QUARTILES)
    counts = labels.groupBy("country").agg(F.sum("n").alias("labelled"),
                                           F.coalesce(F.sum(F.when(other, n)), F.lit(0)).cast("long").alias("other"))
    return counts.withColumn("share", F.round(F.col("other").cast("double") / F.col("labelled"), 6))


def quartile_strings(flat: DataFrame) -> DataFrame:
    """Per (category, year), its quartiles in order, joined by a blank, repeats kept.

    Rows are counted per label first, so a cell's aggregate sees one row a label and no
    string is built over more than a cell.
    """
    counts = (flat.where(F.col("category").isNotNull() & F.col("year").isNotNull() & F.col("quartile").isNotNull())
              .groupBy("category", "year", "quartile").agg(F.count(F.lit(1)).cast("int").alias("n")))
    run = F.concat(F.repeat(F.concat("quartile", F.lit(" ")), F.col("n") - 1), "quartile")
    return (counts.withColumn("run", run).groupBy("category", "year")
            .agg(F.expr("listagg(run, ' ') WITHIN GROUP (ORDER BY quartile)").alias("quartiles")))
