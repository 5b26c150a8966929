"""Plan properties that keep the results scalable (checked on the physical plans)."""

import os
import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")

# The only window without a partition key: running offsets over the per-year
# table (one row per calendar year).
UNPARTITIONED_WINDOW_OK = {"articles_by_date_expanded", "articles_by_date_frames"}


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan_text(fn(spark, SF)) for name, fn in E.queries().items()}


def test_no_cross_or_nested_loop_joins(plans):
    for name, p in plans.items():
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_no_python_evaluation(plans):
    for name, p in plans.items():
        assert "EvalPython" not in p and "PythonUDF" not in p, name


def unpartitioned_windows(p):
    """Window specs whose first item is a sort key, i.e. without a partition key."""
    found = []
    for spec in re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", p):
        first = spec.split(",")[0]
        if not first.strip() or "ASC" in first or "DESC" in first:
            found.append(spec)
    return found


def test_windows_are_partitioned(plans):
    flagged = {name for name, p in plans.items() if unpartitioned_windows(p)}
    assert flagged == UNPARTITIONED_WINDOW_OK


def test_scans_are_pruned(plans):
    keywords_scan = re.search(r"FileScan parquet \[([^\]]*)\]", plans["keyword_counts"]).group(1)
    assert [c.split("#")[0] for c in keywords_scan.split(",")] == ["keywords", "derived_row"]
    assert "authors_data" not in plans["articles_by_journal"]


def test_flagship_operator_plan(spark):
    from biblioscope.operators.collaboration import country_pairs
    from biblioscope.sources.tables import workspace
    ws = workspace(spark, SF)
    p = plan_text(country_pairs(ws.articles(), ws.authors_labs()))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    assert "collect_set" in p and "posexplode" in p
    # one shuffle by doi, one by pair (plus the range sort of the ordered result
    # and the shuffle inside the broadcast lab table's distinct)
    assert len(re.findall(r"Exchange hashpartitioning\(doi", p)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(country_a", p)) == 1


def test_collaboration_results_read_the_shared_sets(plans):
    for name in ("country_pairs", "country_triples", "collaboration_edges", "collaboration_nodes"):
        p = plans[name]
        assert "ReadSchema: struct<countries:array<string>>" in p and "Join" not in p, name


def test_journal_country_aggregates_before_join(plans):
    p = plans["articles_by_journal_country"]
    join_at = p.index("Join")
    assert "partial_count(doi" in p[join_at:]


EXPECTED_READ_SCHEMAS = {
    "keyword_counts": {"struct<keywords:string,derived_row:binary>"},
    "articles_by_year": {"struct<extracted_date:string>"},
    "articles_by_date": {"struct<publication_date:date,article_count:bigint>"},   # shared per-date table
    "articles_by_journal_country": {"struct<doi:string,journal_name:string>",
                                    "struct<journal_name:string,country:string>"},
    "top_authors": {"struct<authors_data:array<struct<name:string>>>"},
    "article_affiliations": {"struct<doi:string,authors_data:array<struct<name:string,labs:array<string>>>>",
                             "struct<lab:string,country:string>"},
    "labs_top20": {"struct<lab:string>"},
}


@pytest.mark.parametrize("name", sorted(EXPECTED_READ_SCHEMAS))
def test_scans_read_only_what_they_use(plans, name):
    found = set(re.findall(r"ReadSchema: (struct<[^\n]*?>)(?:\n|$|,)", plans[name]))
    assert found == EXPECTED_READ_SCHEMAS[name]
