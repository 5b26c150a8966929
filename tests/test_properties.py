"""Equivalence properties of SURVEY section 5 on the smallest test folder."""

import os

import pytest
from pyspark.sql import functions as F

from biblioscope.plans.catalog import RESULTS
from biblioscope.sources.tables import workspace
from helpers import as_set
from test_collaboration import naive_pairs

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def ws(spark):
    return workspace(spark, SF)


def total(df, col):
    return df.agg(F.sum(col)).first()[0]


def test_pairs_equal_naive_self_join(ws):
    got = as_set(RESULTS["country_pairs"](ws))
    assert got == as_set(naive_pairs(ws.articles(), ws.authors_labs()))


def test_histogram_covers_every_cell(ws):
    long = RESULTS["quartile_by_country_long"](ws)
    assert total(RESULTS["quartile_count_histogram"](ws), "n") == long.count()


def test_quartile_by_year_sums_to_flat_rows(ws):
    flat = RESULTS["journals_flat"](ws)
    keyed = flat.where(F.col("year").isNotNull() & F.col("quartile").isNotNull()).count()
    assert total(RESULTS["quartile_by_year"](ws), "n") == keyed


def test_shares_sum_to_one(ws):
    sums = RESULTS["quartile_share_by_country"](ws).groupBy("country").agg(F.sum("share").alias("s"))
    assert all(abs(r.s - 1) < 1e-5 for r in sums.collect())


def test_last_frame_is_whole_series(ws):
    frames = RESULTS["articles_by_date_frames"](ws)
    last = frames.agg(F.max("first_frame")).first()[0]
    assert frames.count() == last + 1
    assert as_set(frames, "publication_date", "article_count") == as_set(RESULTS["articles_by_date"](ws))


def test_cleaning_report_matches_cleaned_tables(ws):
    rep = {r.collection: r.rows_after for r in RESULTS["cleaning_report"](ws).collect()}
    assert rep["Articles"] == ws.articles().count()
    assert rep["Journaux"] == ws.journals().count()
    assert rep["Authors Labs"] == ws.authors_labs().count()


def test_edges_are_pairs_and_degrees_add_up(ws):
    edges = RESULTS["collaboration_edges"](ws)
    nodes = RESULTS["collaboration_nodes"](ws)
    assert total(nodes, "degree") == 2 * edges.count()
    assert total(nodes, "weighted_degree") == 2 * total(edges, "weight")
