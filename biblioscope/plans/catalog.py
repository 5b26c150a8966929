"""Named results - the analytics a caller asks for by name.

``RESULTS[name](ws)`` builds the lazy DataFrame of one result from a
``Workspace`` (test tables or landed collections).  ``QUERIES[name](spark,
sf_dir)`` is the same over the test tables.  Nothing is collected; the caller
writes or shows the result.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from biblioscope.operators import articles as art
from biblioscope.operators import collaboration as col
from biblioscope.operators import distributions as dist
from biblioscope.operators import keywords as kw
from biblioscope.operators import rankings as rk
from biblioscope.operators.affiliations import article_affiliations, article_countries
from biblioscope.sources.tables import Workspace, landed_workspace, spread_small_scan, workspace

Result = Callable[[Workspace], DataFrame]
Query = Callable[[SparkSession, str], DataFrame]


def _flat(ws: Workspace) -> DataFrame:
    return rk.journals_flat(ws.journals())


def _dated(ws: Workspace) -> DataFrame:
    return art.articles_dated(ws.articles())


def _date_counts(ws: Workspace) -> DataFrame:
    """Articles per parsed date (one row per date); shared by two results, written once."""
    return ws.derived("date_counts", lambda: art.date_counts(_dated(ws)))


def _country_labels(ws: Workspace) -> DataFrame:
    """Rows per (country, label); shared by three results, written once."""
    return ws.derived("country_labels", lambda: rk.label_counts_by_country(_flat(ws)))


def _country_wide(ws: Workspace) -> DataFrame:
    """Q1..Q4 counts per country; shared by four results, written once."""
    return ws.derived("country_quartiles", lambda: rk.quartile_by_country_wide(_flat(ws)))


def _country_long(ws: Workspace) -> DataFrame:
    return rk.wide_to_long(_country_wide(ws))


def _doi_countries(ws: Workspace) -> DataFrame:
    """Per doi, its sorted distinct countries; shared by the four collaboration results."""
    return ws.derived("doi_countries", lambda: article_countries(ws.articles(), ws.authors_labs()))


def _tuples(ws: Workspace, k: int) -> DataFrame:
    """Pairs of a doi stay below what a task gets even if every country of the world takes part; triples do not."""
    return col.country_tuples(_doi_countries(ws), k, balanced=ws.materialize and k > 2)


def _edges(ws: Workspace) -> DataFrame:
    return col.collaboration_edges(_tuples(ws, 2))


# Animation frames that ``articles_by_date_expanded`` shows.
FRAME_RANGE = (0, 99)

RESULTS: dict[str, Result] = {
    # cleaning and full tables
    "cleaning_report": lambda ws: ws.cleaning_report(),
    "articles_dated": lambda ws: art.articles_table(_dated(ws)),
    "journals_flat": _flat,
    "author_labs": lambda ws: ws.authors_labs(),
    # keywords and words
    "keyword_counts": lambda ws: kw.keyword_counts(ws.articles()),
    "top_keywords": lambda ws: kw.top_keywords(ws.articles()),
    "keyword_word_counts": lambda ws: kw.keyword_word_counts(ws.articles()),
    "keyword_words": lambda ws: kw.keyword_words(ws.articles()),
    "category_word_counts": lambda ws: kw.category_word_counts(_flat(ws)),
    "category_words": lambda ws: kw.category_words(_flat(ws)),
    "keyword_collocations": lambda ws: kw.keyword_collocations(ws.articles()),
    "category_collocations": lambda ws: kw.category_collocations(_flat(ws)),
    "document_words": lambda ws: kw.document_words(spread_small_scan(ws.documents())),
    "document_words_folded": lambda ws: kw.document_words_folded(spread_small_scan(ws.documents())),
    # affiliations and collaboration
    "article_affiliations": lambda ws: article_affiliations(ws.articles(), ws.authors_labs()),
    "country_pairs": lambda ws: col.ordered_tuples(_tuples(ws, 2), 2),
    "country_triples": lambda ws: col.ordered_tuples(_tuples(ws, 3), 3),
    "collaboration_edges": _edges,
    "collaboration_nodes": lambda ws: col.collaboration_nodes(_edges(ws)),
    # journal rankings
    "quartile_by_category": lambda ws: rk.quartile_by_category(_flat(ws)),
    "quartile_by_year": lambda ws: rk.quartile_by_year(_flat(ws)),
    "quartile_strings": lambda ws: rk.quartile_strings(_flat(ws)),
    "best_quartile_heatmap": lambda ws: rk.best_quartile_heatmap(_flat(ws)),
    "countries_per_quartile": lambda ws: rk.countries_per_quartile(_flat(ws)),
    "quartile_by_country_wide": _country_wide,
    "quartile_by_country_long": _country_long,
    "quartile_share_by_country": lambda ws: rk.label_share_by_country(_country_labels(ws)),
    "label_table_by_country": lambda ws: rk.label_table_by_country(_country_labels(ws)),
    "unranked_by_country": lambda ws: rk.unranked_by_country(_country_labels(ws)),
    "quartile_count_histogram": lambda ws: dist.quartile_count_histogram(_country_long(ws)),
    "quartile_count_density": lambda ws: dist.quartile_count_density(_country_long(ws)),
    # authors and labs
    "authors_by_country_top20": lambda ws: art.authors_by_country_top20(ws.authors_labs()),
    "labs_top20": lambda ws: art.labs_top20(ws.authors_labs()),
    "top_authors": lambda ws: art.top_authors(ws.articles()),
    "distinct_authors": lambda ws: art.distinct_authors(ws.articles()),
    # article counts
    "articles_by_year": lambda ws: art.articles_by_year(_dated(ws)),
    "articles_by_date": lambda ws: art.order_by_date(_date_counts(ws)),
    "articles_by_date_frames": lambda ws: art.frames_from_counts(_date_counts(ws)),
    "articles_by_date_expanded": lambda ws: art.expanded_frames(art.frames_from_counts(_date_counts(ws)), *FRAME_RANGE),
    "articles_by_year_month": lambda ws: art.articles_by_year_month(_dated(ws)),
    "articles_by_year_month_wide": lambda ws: art.articles_by_year_month_wide(_dated(ws)),
    "articles_by_journal": lambda ws: art.articles_by_journal(ws.articles()),
    "articles_by_journal_country": lambda ws: art.articles_by_journal_country(ws.articles(), ws.journals()),
}


# Tables derived once per workspace and read by several results.
SHARED: dict[str, Result] = {
    "doi_countries": _doi_countries,
    "country_quartiles": _country_wide,
    "country_labels": _country_labels,
    "date_counts": _date_counts,
}


def prepare(ws: Workspace) -> Workspace:
    """Build the cleaned tables, then the shared derived tables (concurrent jobs)."""
    ws.prepare()
    with ThreadPoolExecutor(max_workers=len(SHARED)) as pool:
        for f in [pool.submit(build, ws) for build in SHARED.values()]:
            f.result()
    return ws


def _over_testdata(result: Result) -> Query:
    return lambda spark, sf_dir: result(workspace(spark, sf_dir))


QUERIES: dict[str, Query] = {name: _over_testdata(fn) for name, fn in RESULTS.items()}


# Results over exported files that are landed again, damaged records among them.
LANDED: dict[str, Result] = {
    "landing_report": lambda ws: ws.landing_report(),
    "landing_quarantine": lambda ws: ws.quarantine(),
    "landed_articles": lambda ws: art.articles_table(_dated(ws)),
    "landed_journals_flat": _flat,
    "landed_author_labs": lambda ws: ws.authors_labs(),
    "landed_country_pairs": lambda ws: col.ordered_tuples(_tuples(ws, 2), 2),
}


def _over_landing(result: Result) -> Query:
    return lambda spark, sf_dir: result(landed_workspace(spark, sf_dir))


QUERIES.update({name: _over_landing(fn) for name, fn in LANDED.items()})

# The flagship result: nested explode, size-checked join, per-doi sets,
# combinations and a pre-aggregated count.
FLAGSHIP = "country_pairs"
