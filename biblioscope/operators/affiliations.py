"""Articles -> authors -> labs -> countries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioscope.operators.joins import join_dimension


def article_authors(articles: DataFrame) -> DataFrame:
    """One row per (article, author entry); null or empty author lists vanish."""
    return (articles
            .select("article_title", "doi", F.explode("authors_data").alias("author"))
            .select("article_title", "doi", F.col("author.name").alias("name"),
                    F.col("author.labs").alias("labs")))


def article_author_labs(articles: DataFrame) -> DataFrame:
    """One row per (article, author, lab); authors without labs vanish."""
    return (article_authors(articles)
            .select("article_title", "doi", "name", F.explode("labs").alias("lab")))


def lab_countries(authors_labs: DataFrame) -> DataFrame:
    """Distinct (lab, country): the join side without the per-author fan-out."""
    return authors_labs.select("lab", "country").distinct()


def article_affiliations(articles: DataFrame, authors_labs: DataFrame, **join_opts) -> DataFrame:
    """Distinct (doi, author, lab, country); labs unknown to authors_labs keep a null country.

    (doi, author, lab) is made distinct before the join: the lab table is itself
    distinct, so the joined rows are distinct too, and the shuffle carries one
    column less while the join sees fewer rows.
    """
    labs = article_author_labs(articles).select("doi", F.col("name").alias("author"), "lab").distinct()
    return join_dimension(labs, lab_countries(authors_labs), "lab", "left", **join_opts) \
        .select("doi", "author", "lab", "country")


def article_countries(articles: DataFrame, authors_labs: DataFrame, **join_opts) -> DataFrame:
    """Per doi, the sorted set of distinct countries of its authors' labs.

    Rows without doi or country cannot pair and are dropped before the shuffle.
    ``collect_set`` is aggregated partially in each map task, so a doi with a huge
    author list reaches its reducer as at most one set per map task.
    """
    labs = (article_author_labs(articles)
            .where(F.col("doi").isNotNull() & F.col("lab").isNotNull())
            .select("doi", "lab"))
    return (join_dimension(labs, lab_countries(authors_labs).where(F.col("country").isNotNull()),
                           "lab", "inner", **join_opts)
            .groupBy("doi")
            .agg(F.array_sort(F.collect_set("country")).alias("countries")))
