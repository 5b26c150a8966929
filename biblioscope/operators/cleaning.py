"""Cleaning: drop the store's ``_id``, remove whole-row duplicates, count rows.

De-duplication is a hash aggregation on the full row: partial aggregation merges
copies inside each map task before the shuffle, so a row repeated in a third of
the input collapses map-side and no reducer receives the hot key unaggregated.
The same aggregation can carry each row's number of copies (``_copies``), which
gives the before/after report without a second pass over the raw data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioscope.sources.landing import canonicalize

# Collection labels as the report names them.
COLLECTION_LABELS = {
    "authors_labs": "Authors Labs",
    "journaux": "Journaux",
    "articles": "Articles",
}

COPIES = "_copies"


def drop_id(df: DataFrame) -> DataFrame:
    return df.drop("_id")


def deduplicate(df: DataFrame) -> DataFrame:
    """Whole-row de-duplication (arrays and structs compare by value)."""
    return df.dropDuplicates()


def clean(raw: DataFrame, collection: str) -> DataFrame:
    """Landing rows -> canonical, ``_id``-free, duplicate-free rows."""
    return deduplicate(drop_id(canonicalize(raw, collection)))


def clean_with_copies(raw: DataFrame, collection: str) -> DataFrame:
    """``clean`` plus ``_copies``: how many landing rows each clean row stood for."""
    df = drop_id(canonicalize(raw, collection))
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(COPIES))


def row_counts(df: DataFrame) -> DataFrame:
    """One row: rows before and after whole-row de-duplication, in one pass.

    Rows are grouped by their full value (partial aggregation map-side); the
    number of groups is the de-duplicated count, the sum of group sizes the
    original count.
    """
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(COPIES))
    return copies_counts(groups)


def copies_counts(cleaned_with_copies: DataFrame) -> DataFrame:
    """One row (rows_before, rows_after) from a cleaned table carrying ``_copies``."""
    return cleaned_with_copies.agg(F.coalesce(F.sum(COPIES), F.lit(0)).alias("rows_before"),
                                   F.count(F.lit(1)).alias("rows_after"))


def _report(per_collection: dict[str, DataFrame]) -> DataFrame:
    report = None
    for collection, label in COLLECTION_LABELS.items():
        row = per_collection[collection].select(
            F.lit(label).alias("collection"), "rows_before", "rows_after")
        report = row if report is None else report.unionByName(row)
    return report


def cleaning_report(spark: SparkSession, raw: dict[str, DataFrame]) -> DataFrame:
    """One row per collection: rows before and after de-duplication (from landing rows)."""
    return _report({c: row_counts(drop_id(canonicalize(raw[c], c))) for c in COLLECTION_LABELS})


def cleaning_report_from_copies(cleaned: dict[str, DataFrame]) -> DataFrame:
    """The same report read from cleaned tables that carry ``_copies`` (no raw pass)."""
    return _report({c: copies_counts(cleaned[c]) for c in COLLECTION_LABELS})
