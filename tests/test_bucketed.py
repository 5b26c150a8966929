"""Cleaned tables bucketed by doi and lab: the same results, one shuffle less."""

import os
import re

import pytest

from biblioscope.operators.affiliations import article_countries, lab_countries
from biblioscope.plans.catalog import RESULTS, SHARED
from biblioscope.sources.landing import write_landing
from biblioscope.sources.tables import COLLECTIONS, Workspace
from helpers import as_set

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"\bExchange hashpartitioning", plan))


class Lazy(Workspace):
    """Derived tables stay in the plan, from cleaned tables that are written."""

    def derived(self, name, build):
        return build()


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("bucketed")
    base = Workspace.from_testdata(spark, SF, materialize=False)
    paths = {c: str(d / c) for c in COLLECTIONS}
    for c in COLLECTIONS:
        write_landing(base.raw(c), paths[c], "jsonl")
    make = lambda **kw: Lazy.from_landing(spark, paths, "jsonl", table_root=str(d / "tables"), **kw)
    return make(), make(buckets=4), make


def test_pairs_from_landed_input_plan_one_exchange_less(landed):
    plain, bucketed, _ = landed
    pairs = [RESULTS["country_pairs"](ws) for ws in (plain, bucketed)]
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in pairs]
    assert [len(re.findall(r"\bExchange hashpartitioning\(doi", p)) for p in plans] == [1, 0]
    assert exchanges(pairs[1]) < exchanges(pairs[0])
    assert as_set(pairs[1]) == as_set(pairs[0])
    by_doi = [article_countries(ws.articles(), ws.authors_labs()) for ws in (plain, bucketed)]
    assert as_set(by_doi[0].selectExpr("doi", "cast(countries as string) as c")) == as_set(by_doi[1].selectExpr("doi", "cast(countries as string) as c"))


def test_labs_are_made_distinct_in_their_buckets(landed):
    plain, bucketed, _ = landed
    a, b = (lab_countries(ws.authors_labs()) for ws in (plain, bucketed))
    assert (exchanges(a), exchanges(b)) == (1, 0)
    assert as_set(a) == as_set(b)


@pytest.mark.parametrize("name", ["cleaning_report", "article_affiliations", "country_triples", "labs_top20", "articles_by_year"])
def test_other_results_are_the_same(landed, name):
    plain, bucketed, _ = landed
    assert as_set(RESULTS[name](bucketed)) == as_set(RESULTS[name](plain))


def test_finished_copy_is_read_again(spark, landed):
    _, bucketed, make = landed
    folder = bucketed.table_path("bucketed-4/articles")
    want = as_set(SHARED["doi_countries"](bucketed).selectExpr("doi", "cast(countries as string) as c"))
    [attempt] = os.listdir(folder)
    files = [f for f in os.listdir(f"{folder}/{attempt}") if f.endswith(".parquet")]
    assert 0 < len(files) <= 4                            # a bucket is one file
    [name] = [t.name for t in spark.catalog.listTables() if "_articles_" in t.name]
    spark.sql(f"drop table `{name}`")                     # as in a session with a catalog of its own
    again = make(buckets=4)
    assert as_set(SHARED["doi_countries"](again).selectExpr("doi", "cast(countries as string) as c")) == want
    assert os.listdir(folder) == [attempt] and exchanges(article_countries(again.articles(), again.authors_labs())) == 0


def test_frequent_keys_keep_the_collection_as_it_is(spark, tmp_path):
    labs = [(str(i), f"n{i}", "hot" if i % 3 == 0 else f"l{i}", "FR") for i in range(300)]
    some = [(str(i), f"n{i}", None if i % 3 == 0 else f"l{i}", "FR") for i in range(300)]
    for case, rows in (("hot", labs), ("null", some)):
        df = spark.createDataFrame(rows, "_id string, name string, lab string, country string")
        ws = Workspace(spark, lambda c, df=df: df, case, table_root=str(tmp_path), buckets=8)
        assert ws.authors_labs().count() == 300 and not os.path.exists(ws.table_path("bucketed-8/authors_labs"))
    even = spark.createDataFrame([r for r in labs if r[2] != "hot"], "_id string, name string, lab string, country string")
    ws = Workspace(spark, lambda c: even, "even", table_root=str(tmp_path), buckets=8)
    assert ws.authors_labs().count() == 200 and os.path.exists(ws.table_path("bucketed-8/authors_labs"))
    none = Workspace(spark, lambda c: even.limit(0), "none", table_root=str(tmp_path), buckets=8)
    assert none.authors_labs().count() == 0
    with pytest.raises(ValueError):
        Workspace(spark, lambda c: even, "lazy", materialize=False, buckets=8)
