from pyspark.sql import functions as F

from biblioscope.operators.joins import (broadcast_limit, dimension_fits, hot_keys,
                                         join_dimension)
from helpers import as_set


def fact_and_dim(spark):
    # key "hot" holds half of all rows; "cold-i" one row each; "none" has no dimension row
    rows = [("hot", i) for i in range(100)] + [(f"cold-{i}", i) for i in range(99)] + [("none", 0)]
    fact = spark.createDataFrame(rows, "k string, v int")
    dim = spark.createDataFrame([("hot", "H1"), ("hot", "H2")] + [(f"cold-{i}", f"C{i}") for i in range(99)],
                                "k string, d string")
    return fact, dim


def test_hot_keys_bound_and_buckets(spark):
    fact, _ = fact_and_dim(spark)
    hot = {r.k: r._buckets for r in hot_keys(fact, ["k"], 10).collect()}
    assert hot == {"hot": 10}                # half of the rows, 10 partitions, spread 2
    assert hot_keys(fact, ["k"], 1).count() == 0   # nothing exceeds all rows


def expected(fact, dim, how):
    return as_set(fact.join(dim, "k", how))


def test_salted_join_equals_plain_join(spark):
    fact, dim = fact_and_dim(spark)
    for how in ("inner", "left"):
        got = join_dimension(fact, dim, "k", how, max_broadcast_rows=0, partitions=10)
        assert sorted(got.columns) == sorted(["k", "v", "d"])
        rows = sorted(tuple(r[c] for c in ("k", "v", "d")) for r in got.collect())
        want = sorted(tuple(r[c] for c in ("k", "v", "d")) for r in fact.join(dim, "k", how).collect())
        assert rows == want


def test_hot_key_spread_over_buckets(spark):
    fact, dim = fact_and_dim(spark)
    hot = F.broadcast(hot_keys(fact, ["k"], 10))
    salts = (fact.join(hot, "k").select(F.pmod(F.xxhash64("v"), F.col("_buckets").cast("long")).alias("s"))
             .distinct().count())
    assert salts == 10


def test_broadcast_bound(spark):
    _, dim = fact_and_dim(spark)
    assert dimension_fits(dim, 101) and not dimension_fits(dim, 100)
    assert not dimension_fits(dim, -1)
    assert broadcast_limit(dim) > 0
