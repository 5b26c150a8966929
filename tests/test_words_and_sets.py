"""Collocations, plurals, frames of a range, ordered strings, large country sets, measured broadcasts."""

import math
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from biblioscope.functions.combinations import PER_ROW, combinations_of, explode_combinations
from biblioscope.operators.articles import expanded_frames
from biblioscope.operators.joins import broadcast_limit, dimension_fits, join_dimension, measured
from biblioscope.operators.keywords import collocations, fold_plurals
from biblioscope.operators.rankings import quartile_strings
from biblioscope.sources.tables import spread_small_scan
from helpers import as_set, flat_df


def test_collocation_scores(spark):
    texts = ["machine learning of machine learning"] * 20 + ["machine parts", "deep learning", "learning", "", None, "the cat"] + ["deep sea parts"] * 5
    got = {(r.word_a, r.word_b): r for r in collocations(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()}
    stop = {"of", "the"}
    pairs = Counter(p for t in texts if t for p in zip(t.split(), t.split()[1:]) if not stop & set(p))
    total = pairs.total()
    first, second = Counter(), Counter()
    for (a, b), n in pairs.items():
        first[a] += n
        second[b] += n
    assert set(got) == set(pairs)
    for (a, b), n in pairs.items():
        cells = [(n, first[a] * second[b]), (first[a] - n, first[a] * (total - second[b])), (second[b] - n, (total - first[a]) * second[b]),
                 (total - first[a] - second[b] + n, (total - first[a]) * (total - second[b]))]
        score = 2 * sum(k * math.log(k * total / e) for k, e in cells if k)
        r = got[a, b]
        assert (r.n, r.n_a, r.n_b) == (n, first[a], second[b]) and math.isclose(r.score, score, abs_tol=2e-6)
        assert r.collocation == (n * total > first[a] * second[b] and round(score, 6) > 30)
    assert got["machine", "learning"].collocation and not got["machine", "parts"].collocation
    assert collocations(spark.createDataFrame([], "t string"), "t").collect() == []


def test_collocations_with_a_hot_word_beyond_the_broadcast_bound(spark):
    texts = spark.createDataFrame([(f"common w{i}",) for i in range(200)] + [("common w1",)] * 50, "t string")
    want = as_set(collocations(texts, "t"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert as_set(collocations(texts, "t")) == want and len(want) == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_plurals_join_their_singular(spark):
    freq = {"cat": 3, "cats": 2, "glass": 4, "glas": 1, "dogs": 5, "s": 1, "bus": 2, "bu": 1, "ss": 7}
    got = fold_plurals(spark.createDataFrame(list(freq.items()), "word string, n long"))
    assert as_set(got) == {("cat", 5, 2), ("glass", 4, 1), ("glas", 1, 1), ("dogs", 5, 1), ("s", 1, 1), ("bu", 3, 2), ("ss", 7, 1)}


def test_expanded_frames(spark):
    points = [(f"2020-01-{d:02d}", d, d - 1) for d in range(1, 11)]
    frames = spark.createDataFrame(points, "publication_date string, article_count long, first_frame long")
    got = expanded_frames(frames, 3, 5)
    assert as_set(got) == {(f, d, n) for f in (3, 4, 5) for d, n, p in points if p <= f}
    assert expanded_frames(frames, 8, 20).count() == sum(p <= f for f in range(8, 21) for _, _, p in points)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" not in plan


def test_quartile_strings(spark):
    rows = [("j", "i", "FR", "A", 2000, q) for q in ("Q2", "Q1", "Q2", "-", None)] + [("j", "i", None, "B", 2001, "Q3"), ("j", "i", "FR", None, 2000, "Q1")]
    assert as_set(quartile_strings(flat_df(spark, rows))) == {("A", 2000, "- Q1 Q2 Q2"), ("B", 2001, "Q3")}


@pytest.mark.parametrize("k", [2, 3, 4])
def test_large_sets_give_the_same_combinations(spark, k):
    sets = [("a", [f"c{i:02d}" for i in range(14)]), ("b", ["x", "y"]), ("c", []), ("d", None), ("e", [f"c{i:02d}" for i in range(9)])]
    df = spark.createDataFrame(sets, "doi string, countries array<string>")
    names = ["p", "q", "r", "s"][:k]
    want = Counter((d, *c) for d, s in sets for c in combinations(s or [], k))
    for per_row in (0, 50, 10 ** 9, None):
        got = Counter(map(tuple, explode_combinations(df, "countries", names, ("doi",), per_row).collect()))
        assert got == want
    n = spark.range(6).select(combinations_of(F.col("id"), k).alias("c")).collect()
    assert [r.c for r in n] == [math.comb(i, k) for i in range(6)]


def test_one_large_set_is_spread_by_cost(spark):
    one = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.format_string("C%04d", i)).alias("countries"))
    rows = explode_combinations(one, "countries", ["p", "q", "r"], per_row=PER_ROW)
    per_task = sorted(r["count"] for r in rows.groupBy(F.spark_partition_id().alias("t")).count().collect())
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(per_task) == math.comb(400, 3) and len(per_task) == tasks
    assert per_task[-1] < 2 * per_task[len(per_task) // 2]


def test_wide_rows_are_not_broadcast(spark):
    dim = spark.range(3000).select(F.concat(F.lit("LAB-"), "id").alias("lab"), F.repeat(F.lit("x"), 10_000).alias("country"))
    fact = spark.range(100).select(F.concat(F.lit("LAB-"), F.col("id") % 50).alias("lab"), "id")
    rows, size = measured(dim)
    assert rows == 3000 and 30_000_000 < size < 31_000_000 and size > broadcast_limit(dim)
    assert not dimension_fits(dim) and dimension_fits(dim.limit(100)) and dimension_fits(dim, max_rows=3000)
    joined = join_dimension(fact, dim, "lab", "left")
    assert "Salt" in joined._jdf.queryExecution().toString() or "_salt" in joined._jdf.queryExecution().toString()
    assert joined.where(F.length("country") == 10_000).count() == 100
    narrow = dim.select("lab", F.lit("FR").alias("country"))
    assert "_salt" not in join_dimension(fact, narrow, "lab", "left")._jdf.queryExecution().toString()


def test_small_scans_are_spread_and_large_ones_left_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread_small_scan(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == cores
    many = spark.range(100, numPartitions=cores + 3)
    assert spread_small_scan(many) is many
