"""Article counts: by date, year, month, journal, journal country and author."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biblioscope.functions.dates import extract_date_text, parse_date_text, year_text
from biblioscope.operators.affiliations import article_authors
from biblioscope.sources import schemas

# All of an article but the raw date text, plus what is derived from that.
DERIVED_COLUMNS = tuple(f.name for f in schemas.ARTICLES.fields) + ("extracted_date",)


def articles_dated(articles: DataFrame) -> DataFrame:
    """Articles with the extracted date fragment and the parsed DATE.

    The raw text is kept as ``publication_date_raw``; ``publication_date`` is the
    parsed value.  ``derived_row`` is a digest of all columns but the raw text: it is
    equal for articles that differ only in the text around the date.  Idempotent: an input already carrying the parsed columns (the
    workspace stores articles that way) is returned unchanged.
    """
    if "publication_date_raw" in articles.columns:
        return articles
    fragment = extract_date_text(F.col("publication_date_raw"))
    return (articles
            .withColumnRenamed("publication_date", "publication_date_raw")
            .withColumn("extracted_date", fragment)
            .withColumn("publication_date", parse_date_text(F.col("extracted_date")))
            .withColumn("derived_row", F.unhex(F.md5(F.to_json(
                F.struct(*DERIVED_COLUMNS), {"ignoreNullFields": "false"})))))


def articles_table(dated: DataFrame) -> DataFrame:
    """The full dated table, one row per article, the nested authors as text.

    Authors read ``name [lab, lab]``, joined by ``; ``; null labs are left out, and
    an article without an author list has null.
    """
    author = F.transform("authors_data", lambda a: F.concat(
        F.coalesce(a["name"], F.lit("")), F.lit(" ["), F.concat_ws(", ", a["labs"]), F.lit("]")))
    return dated.select("article_title", "doi", "publication_date_raw", "keywords", "journal_name",
                        F.array_join(author, "; ").alias("authors"), "extracted_date", "publication_date")


def articles_by_year(dated: DataFrame) -> DataFrame:
    """Articles per four-digit year found in the fragment (text year)."""
    year = year_text(F.col("extracted_date"))
    return (dated.select(year.alias("year"))
            .where(F.col("year").isNotNull() & (F.col("year") != ""))
            .groupBy("year").agg(F.count(F.lit(1)).alias("article_count"))
            .orderBy(F.col("year").cast("int")))


def date_counts(dated: DataFrame) -> DataFrame:
    """Articles per parsed date (unordered); unparsed dates form one null group."""
    return dated.groupBy("publication_date").agg(F.count(F.lit(1)).alias("article_count"))


def order_by_date(counts: DataFrame) -> DataFrame:
    """Date counts in date order, the null group first."""
    return counts.orderBy(F.asc_nulls_first("publication_date"))


def articles_by_date(dated: DataFrame) -> DataFrame:
    """``date_counts`` in date order, the null group first."""
    return order_by_date(date_counts(dated))


def series_positions(series: DataFrame, date_col: str) -> DataFrame:
    """0-based position of each row in ``date_col`` order (nulls first), distributed.

    Dates fall into years; the row count per year is a small table (one row per
    year, a bounded domain), whose running sum gives each year's offset.  Within a
    year, ``row_number`` runs per year partition.  No global single-partition
    window over the series is planned.
    """
    d = F.col(date_col)
    keyed = series.withColumn("_y", F.year(d))
    per_year = keyed.groupBy("_y").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = per_year.select(
        F.col("_y").alias("_oy"),
        (F.sum("_cnt").over(Window.orderBy(F.asc_nulls_first("_y"))
                            .rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cnt")).alias("_off"))
    within = Window.partitionBy("_y").orderBy(F.asc_nulls_first(date_col))
    # One row per year, years are four-digit: a proven broadcast bound.
    return (keyed.join(F.broadcast(offsets), F.col("_y").eqNullSafe(F.col("_oy")))
            .withColumn("position", F.col("_off") + F.row_number().over(within) - 1)
            .drop("_y", "_oy", "_off"))


def articles_by_date_frames(dated: DataFrame) -> DataFrame:
    """Growing-prefix animation frames in compact form.

    Frame ``i`` shows every point whose ``first_frame <= i``; the last frame is the
    whole series.  The expanded form (one copy of each point per frame) is
    quadratic in the series length and is not materialised.
    """
    return frames_from_counts(date_counts(dated))


def frames_from_counts(counts: DataFrame) -> DataFrame:
    """Frames (``first_frame``) from per-date counts."""
    return (series_positions(counts, "publication_date")
            .withColumnRenamed("position", "first_frame"))


def expanded_frames(frames: DataFrame, first: int, last: int) -> DataFrame:
    """The points of each animation frame ``first..last``: (frame, publication_date, article_count).

    Frame *i* shows the points whose ``first_frame`` is at most *i*, so a point stands in
    the frames from its own to ``last``: it is exploded over them.  No join is needed, and
    the work is the size of the result.
    """
    shown = frames.where(F.col("first_frame") <= last)
    return shown.select(F.explode(F.sequence(F.greatest("first_frame", F.lit(first).cast("long")), F.lit(last).cast("long"))).alias("frame"),
                        "publication_date", "article_count")


def articles_by_year_month(dated: DataFrame) -> DataFrame:
    """Articles per (year, month) of the parsed date; the null group is kept."""
    d = F.col("publication_date")
    return (dated.select(F.year(d).alias("year"), F.month(d).alias("month"))
            .groupBy("year", "month").agg(F.count(F.lit(1)).alias("article_count")))


def articles_by_year_month_wide(dated: DataFrame) -> DataFrame:
    """Year x month table (m01..m12), zero filled; rows without a date dropped."""
    d = F.col("publication_date")
    month = F.month(d)
    return (dated.where(d.isNotNull())
            .groupBy(F.year(d).alias("year"))
            .agg(*[F.count_if(month == m).alias(f"m{m:02d}") for m in range(1, 13)]))


def articles_by_journal(articles: DataFrame, digits: int = 6) -> DataFrame:
    """Articles per journal name (null name is a group) and share of all articles."""
    total = articles.select(F.count(F.lit(1))).scalar()
    return (articles.groupBy("journal_name").agg(F.count(F.lit(1)).alias("article_count"))
            .withColumn("share", F.round(F.col("article_count") / total, digits)))


def articles_by_journal_country(articles: DataFrame, journals: DataFrame,
                                null_safe: bool = False) -> DataFrame:
    """Articles per country of their journal (inner join on journal name).

    A journal name listed on several journal rows counts its articles once per
    row.  Both sides are counted before the join - articles per journal name,
    journal rows per name and country - so a name that holds a large share of
    either side is one row per country.  With ``null_safe=True`` a null name
    matches a null name.
    """
    per_name = articles
    if not null_safe:
        per_name = per_name.where(F.col("journal_name").isNotNull())
    per_name = per_name.groupBy("journal_name").agg(F.count("doi").alias("article_count"))
    jr = (journals.where(F.col("country").isNotNull())
          .groupBy(F.col("journal_name").alias("_jn"), "country").agg(F.count(F.lit(1)).alias("_rows")))
    cond = (per_name["journal_name"].eqNullSafe(jr["_jn"]) if null_safe
            else per_name["journal_name"] == jr["_jn"])
    return (per_name.join(jr, cond)
            .groupBy("country").agg(F.sum(F.col("article_count") * F.col("_rows")).alias("article_count"))
            .orderBy(F.desc("article_count"), "country"))


def author_article_counts(articles: DataFrame) -> DataFrame:
    return (article_authors(articles)
            .groupBy("name").agg(F.count(F.lit(1)).alias("article_count")))


def top_authors(articles: DataFrame, k: int = 10) -> DataFrame:
    return author_article_counts(articles).orderBy(F.desc("article_count"), "name").limit(k)


def distinct_authors(articles: DataFrame) -> DataFrame:
    return article_authors(articles).select("name").distinct()


def value_counts(df: DataFrame, column: str, name: str = "author_count") -> DataFrame:
    """Non-null values of ``column`` with their row counts."""
    return (df.where(F.col(column).isNotNull())
            .groupBy(column).agg(F.count(F.lit(1)).alias(name)))


def top_values(df: DataFrame, column: str, k: int = 20, name: str = "author_count") -> DataFrame:
    return value_counts(df, column, name).orderBy(F.desc(name), column).limit(k)


def authors_by_country_top20(authors_labs: DataFrame, k: int = 20) -> DataFrame:
    return top_values(authors_labs, "country", k)


def labs_top20(authors_labs: DataFrame, k: int = 20) -> DataFrame:
    return top_values(authors_labs, "lab", k)
