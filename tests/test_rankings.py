from biblioscope.operators.distributions import quartile_count_density, quartile_count_histogram
from biblioscope.operators.rankings import (best_quartile_heatmap, countries_per_quartile,
                                            journals_flat, quartile_by_category,
                                            quartile_by_country_long, quartile_by_country_wide,
                                            quartile_by_year, quartile_share_by_country)
from biblioscope.sources.landing import canonicalize
from biblioscope.sources.schemas import JOURNALS_LANDING
from helpers import as_set, flat_df


def test_flatten_drops_journals_without_rankings(spark):
    raw = spark.createDataFrame([
        ("1", "J1", "I1", "FR", [("Math", "2020", "Q1"), ("CS", "2021", "Q2")]),
        ("2", "J2", "I2", "MA", []),
        ("3", "J3", "I3", "ES", None),
    ], JOURNALS_LANDING)
    flat = journals_flat(canonicalize(raw, "journaux"))
    assert as_set(flat) == {("J1", "I1", "FR", "Math", 2020, "Q1"), ("J1", "I1", "FR", "CS", 2021, "Q2")}


def test_best_quartile(spark):
    flat = flat_df(spark, [
        ("j", "i", "FR", "A", 2000, "Q2"), ("j", "i", "FR", "A", 2000, "Q1"),
        ("j", "i", "FR", "A", 2001, "-"),
        ("j", "i", "FR", "A", 2002, None),
        ("j", "i", "FR", "B", 2000, "Q3"),
    ])
    got = {(r.category, r.year): r.best_quartile for r in best_quartile_heatmap(flat).collect()}
    assert got == {("A", 2000): 1, ("A", 2001): 0, ("A", 2002): 0,
                   ("B", 2000): 3, ("B", 2001): 0, ("B", 2002): 0}


def test_country_tables(spark):
    flat = flat_df(spark, [
        ("j", "i", "FR", "A", 2000, "Q3"),
        ("j", "i", "MA", "A", 2000, "Q1"), ("j", "i", "MA", "A", 2001, "Q1"),
        ("j", "i", "MA", "B", 2001, "Q4"),
        ("j", "i", None, "A", 2000, "Q2"),
    ])
    wide = {r.country: (r.Q1, r.Q2, r.Q3, r.Q4) for r in quartile_by_country_wide(flat).collect()}
    assert wide == {"FR": (0, 0, 1, 0), "MA": (2, 0, 0, 1)}
    long = as_set(quartile_by_country_long(flat))
    assert len(long) == 8 and ("FR", "Q1", 0) in long and ("MA", "Q1", 2) in long
    share = {(r.country, r.quartile): r.share for r in quartile_share_by_country(flat).collect()}
    assert share[("MA", "Q1")] == round(2 / 3, 6) and share[("FR", "Q3")] == 1.0
    for c in ("FR", "MA"):
        assert abs(sum(v for (k, _), v in share.items() if k == c) - 1) < 1e-5
    cpq = dict(as_set(countries_per_quartile(flat)))
    assert cpq == {"Q1": 1, "Q3": 1, "Q4": 1}


def test_plain_counts_keep_other_labels(spark):
    flat = flat_df(spark, [("j", "i", "FR", "A", 2000, "Q1"), ("j", "i", "FR", "A", 2000, "-"),
                           ("j", "i", "FR", "A", None, "Q1"), ("j", "i", "FR", "A", 2000, None)])
    assert as_set(quartile_by_category(flat)) == {("A", "Q1", 2), ("A", "-", 1)}
    assert as_set(quartile_by_year(flat)) == {(2000, "Q1", 1), (2000, "-", 1)}


def long_df(spark, rows):
    return spark.createDataFrame(rows, "country string, quartile string, n long")


def test_histogram_equal_counts_one_bin(spark):
    h = quartile_count_histogram(long_df(spark, [("FR", "Q1", 3), ("MA", "Q1", 3), ("MA", "Q2", 3)]))
    rows = {(r.quartile, r.bin): (r.n, r.stack_top, r.bin_start, r.bin_end) for r in h.collect()}
    assert rows == {("Q1", 10): (2, 2, 3.0, 3.05), ("Q2", 10): (1, 3, 3.0, 3.05)}


def test_histogram_edges_and_max_in_last_bin(spark):
    data = [("c%d" % v, "Q1", v) for v in range(0, 21)]
    h = {r.bin: r.n for r in quartile_count_histogram(long_df(spark, data)).collect()}
    assert h[19] == 2            # 19 and the maximum 20
    assert h[0] == 1 and sum(h.values()) == 21


def test_density_on_the_histogram_range(spark):
    data = [("c%d" % i, "Q1", v) for i, v in enumerate([1, 2, 2, 3, 7, 9])] + \
           [("d%d" % i, "Q2", v) for i, v in enumerate([0, 12, 4])] + [("x", "Q3", 5)]
    d = quartile_count_density(long_df(spark, data)).collect()
    assert {r.quartile for r in d} == {"Q1", "Q2"}          # one value: no curve
    q1 = sorted((r.point, r.x, r.density, r.count_density, r.stack_top) for r in d if r.quartile == "Q1")
    q2 = {r.point: r for r in d if r.quartile == "Q2"}
    assert len(q1) == 200 and q1[0][1] == 0.0 and q1[-1][1] == 12.0   # shared range of all values
    bin_width = 12 / 20
    for point, x, dens, cnt_dens, top in q1:
        assert abs(cnt_dens - dens * 6 * bin_width) < 1e-5
        assert abs(top - cnt_dens) < 1e-5                  # Q1 is the bottom of the stack
        assert abs(q2[point].stack_top - (cnt_dens + q2[point].count_density)) < 1e-5
