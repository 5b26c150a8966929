import pytest
from pyspark.sql import functions as F

from biblioscope.operators.affiliations import article_affiliations, article_author_labs
from biblioscope.operators.collaboration import (collaboration_edges, collaboration_nodes,
                                                 country_pairs, country_triples)
from helpers import articles_df, as_set, author, authors_labs_df

LABS = [("a1", "LFR", "FR"), ("a2", "LMA", "MA"), ("a3", "LES", "ES"),
        ("a4", "LFR", "FR"), ("a5", "LFR", "FR"), ("a6", "LNULL", None)]


def test_author_explosion_drops_empty_lists(spark):
    rows = [{"doi": "1", "authors_data": None},
            {"doi": "2", "authors_data": []},
            {"doi": "3", "authors_data": [author("x", None)]},
            {"doi": "4", "authors_data": [author("y", ["L1", "L2"])]}]
    got = as_set(article_author_labs(articles_df(spark, rows)), "doi", "name", "lab")
    assert got == {("4", "y", "L1"), ("4", "y", "L2")}


def test_unknown_lab_kept_with_null_country_but_never_pairs(spark):
    arts = articles_df(spark, [{"doi": "1", "authors_data": [author("x", ["LFR", "LXX"])]}])
    labs = authors_labs_df(spark, LABS)
    aff = as_set(article_affiliations(arts, labs), "doi", "author", "lab", "country")
    assert aff == {("1", "x", "LFR", "FR"), ("1", "x", "LXX", None)}
    assert country_pairs(arts, labs).count() == 0


def test_pairs_and_triples_of_one_article(spark):
    arts = articles_df(spark, [
        {"doi": "1", "authors_data": [author("x", ["LFR"]), author("y", ["LMA", "LES"])]},
        {"doi": "2", "authors_data": [author("z", ["LFR"])]},           # one country
        {"doi": None, "authors_data": [author("w", ["LFR", "LMA"])]},   # no doi
    ])
    labs = authors_labs_df(spark, LABS)
    assert as_set(country_pairs(arts, labs)) == {("ES", "FR", 1), ("ES", "MA", 1), ("FR", "MA", 1)}
    assert as_set(country_triples(arts, labs)) == {("ES", "FR", "MA", 1)}


def test_fan_out_does_not_change_counts(spark):
    # three authors of the same lab, in two articles: still one article per pair
    arts = articles_df(spark, [
        {"doi": "1", "authors_data": [author("x", ["LFR"]), author("y", ["LFR"]), author("z", ["LMA"])]},
        {"doi": "2", "authors_data": [author("x", ["LFR"]), author("q", ["LMA"])]},
    ])
    labs = authors_labs_df(spark, LABS)   # LFR has three authors in authors_labs
    assert as_set(country_pairs(arts, labs)) == {("FR", "MA", 2)}


def naive_pairs(arts, labs):
    """The original self-join formulation, used as a reference."""
    exploded = article_author_labs(arts)
    aff = exploded.join(labs.withColumnRenamed("name", "lab_name"), "lab", "left") \
        .select("doi", "name", "lab_name", "country")
    a, b = aff.alias("a"), aff.alias("b")
    pairs = a.join(b, (F.col("a.doi") == F.col("b.doi")) & (F.col("a.country") != F.col("b.country"))) \
        .select(F.array_sort(F.array("a.country", "b.country")).alias("c"), "a.doi").distinct()
    return pairs.groupBy("c").agg(F.count("doi").alias("n")) \
        .select(F.col("c")[0], F.col("c")[1], "n")


@pytest.mark.parametrize("salted", [False, True])
def test_pairs_equal_self_join_formulation(spark, salted):
    countries = ["FR", "MA", "ES", "DE", "IT"]
    labs = authors_labs_df(spark, [(f"p{i}", f"L{i}", countries[i % 5]) for i in range(10)]
                           + [("p10", "L10", None)])
    arts = articles_df(spark, [
        {"doi": str(d), "authors_data": [author(f"n{d}-{j}", [f"L{(d * j + j) % 11}", f"L{(d + j) % 11}"])
                                         for j in range(d % 4 + 1)]}
        for d in range(60)])
    opts = {"max_broadcast_rows": 0, "partitions": 4} if salted else {}
    assert as_set(country_pairs(arts, labs, **opts)) == as_set(naive_pairs(arts, labs))


def test_graph_nodes_and_edges(spark):
    pairs = spark.createDataFrame([("ES", "FR", 2), ("FR", "MA", 1)],
                                  "country_a string, country_b string, collaboration_count long")
    edges = collaboration_edges(pairs)
    assert as_set(edges) == {("ES", "FR", 2), ("FR", "MA", 1)}
    nodes = as_set(collaboration_nodes(edges))
    assert nodes == {("ES", 1, 2), ("FR", 2, 3), ("MA", 1, 1)}


def test_explode_combinations_counts(spark):
    from math import comb

    from biblioscope.functions.combinations import explode_combinations
    df = spark.createDataFrame([(i, [f"c{j}" for j in range(i)]) for i in range(0, 8)],
                               "id int, arr array<string>")
    for k in (2, 3, 4):
        names = [f"x{j}" for j in range(k)]
        rows = explode_combinations(df, "arr", names, keep=("id",)).collect()
        per_id = {}
        for r in rows:
            per_id[r.id] = per_id.get(r.id, 0) + 1
            vals = [r[n] for n in names]
            assert vals == sorted(vals) and len(set(vals)) == k
        assert per_id == {i: comb(i, k) for i in range(8) if comb(i, k)}


@pytest.mark.parametrize("salted", [False, True])
def test_hot_lab_and_hot_doi(spark, salted):
    # one lab holds a third of all author rows, one doi has hundreds of authors
    countries = ["FR", "MA", "ES", "DE", "IT", "PT"]
    labs = authors_labs_df(spark, [(f"p{i}", f"L{i}", countries[i % 6]) for i in range(12)])
    rows = []
    for d in range(90):
        authors = [author(f"h{d}", ["L0"])] if d % 3 == 0 else []
        authors += [author(f"a{d}-{j}", [f"L{(d + j) % 12}"]) for j in range(2)]
        rows.append({"doi": str(d), "authors_data": authors})
    rows.append({"doi": "hot", "authors_data": [author(f"x{j}", [f"L{j % 12}", "L0"]) for j in range(400)]})
    arts = articles_df(spark, rows)
    opts = {"max_broadcast_rows": 0, "partitions": 8} if salted else {}
    got = as_set(country_pairs(arts, labs, **opts))
    assert got == as_set(naive_pairs(arts, labs))
    assert as_set(country_triples(arts, labs, **opts))
