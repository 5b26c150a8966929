"""Histogram bins against numpy's equal-width histogram over the shared range."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from biblioscope.operators.distributions import quartile_count_histogram

QS = ["Q1", "Q2", "Q3", "Q4"]


@settings(max_examples=10, deadline=None,
          suppress_health_check=[HealthCheck.too_slow, HealthCheck.data_too_large])
@given(st.lists(st.tuples(st.sampled_from(QS), st.integers(0, 60)), min_size=1, max_size=80))
def test_bins_match_numpy(spark, cells):
    long = spark.createDataFrame([(f"c{i}", q, n) for i, (q, n) in enumerate(cells)],
                                 "country string, quartile string, n long")
    rows = quartile_count_histogram(long).collect()
    values = np.array([n for _, n in cells])
    counts, edges = np.histogram(values, bins=20)
    got = np.zeros(20, dtype=int)
    for r in rows:
        got[r.bin] += r.n
        assert abs(r.bin_start - round(edges[r.bin], 6)) < 1e-6
        assert abs(r.bin_end - round(edges[r.bin + 1], 6)) < 1e-6
    assert got.tolist() == counts.tolist()
    # stack tops: cumulative per bin in quartile order
    for r in rows:
        same_bin = sorted((x.quartile, x.n) for x in rows if x.bin == r.bin)
        assert r.stack_top == sum(n for q, n in same_bin if q <= r.quartile)
