"""The native date cascade against a small pure-Python model of the rules.

The model applies the same ordered patterns with ASCII classes (as Java does) and
parses with ``strptime`` in English; generated strings cover days 0-39 with and
without padding, full / abbreviated / mixed-case / non-English month names,
volume prefixes, ranges, junk and years 0000-2999.
"""

import calendar
import datetime as dt
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from biblioscope.operators.articles import articles_dated
from helpers import articles_df

P_DAY_MONTH_YEAR = re.compile(r"\d{1,2} \w+ \d{4}", re.ASCII)
P_VOLUME = re.compile(r"Volume \d+,\s?\w+ \d{4}", re.ASCII)
P_MONTH_YEAR = re.compile(r"\w+ \d{4}", re.ASCII)
P_YEAR = re.compile(r"\d{4}", re.ASCII)

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December"]


def model(raw):
    if raw is None:
        return None, None
    if m := P_DAY_MONTH_YEAR.search(raw):
        frag = m.group(0)
    elif P_VOLUME.search(raw):
        frag = P_MONTH_YEAR.search(raw).group(0)
    elif m := P_YEAR.search(raw):
        frag = m.group(0)
    else:
        return None, None
    # the fragment's own number of words says which parts it has
    parts = frag.split()
    day = int(parts[0]) if len(parts) == 3 else 1
    month = MONTHS.index(parts[-2].title()) + 1 if len(parts) > 1 and parts[-2].title() in MONTHS else (1 if len(parts) == 1 else None)
    last = month and calendar.monthrange(int(parts[-1]) or 4, month)[1]
    valid = month and 1 <= day <= last and int(parts[-1]) > 0
    return frag, dt.date(int(parts[-1]), month, day) if valid else None


month = st.one_of(
    st.sampled_from(MONTHS),
    st.sampled_from(MONTHS).map(str.upper),
    st.sampled_from(MONTHS).map(str.lower),
    st.sampled_from(MONTHS).map(lambda m: m[:3]),
    st.sampled_from(["décembre", "Mai", "Sept", "Juni", "in", "Volume"]),
)
day = st.integers(0, 39).flatmap(lambda d: st.sampled_from([str(d), f"{d:02d}"]))
year = st.integers(0, 2999).flatmap(lambda y: st.sampled_from([f"{y:04d}", str(y)]))
junk = st.sampled_from(["", "in press", "Published: ", "10-", "(", ")", " ", ", ", "Vol. 3 "])
piece = st.one_of(
    st.tuples(day, month, year).map(lambda t: f"{t[0]} {t[1]} {t[2]}"),
    st.tuples(month, year).map(lambda t: f"{t[0]} {t[1]}"),
    st.tuples(st.integers(0, 20000), st.sampled_from([",", ", "]), month, year)
    .map(lambda t: f"Volume {t[0]}{t[1]}{t[2]} {t[3]}"),
    year,
    st.text(alphabet="0123456789 -/abcMay", max_size=12),
)
raw_date = st.one_of(st.none(), st.tuples(junk, piece, junk).map("".join))


@settings(max_examples=6, deadline=None,
          suppress_health_check=[HealthCheck.too_slow, HealthCheck.data_too_large])
@given(st.lists(raw_date, min_size=50, max_size=150))
def test_cascade_matches_model(spark, raws):
    rows = [{"doi": str(i), "publication_date": r} for i, r in enumerate(raws)]
    got = {int(r["doi"]): (r["extracted_date"], r["publication_date"])
           for r in articles_dated(articles_df(spark, rows)).collect()}
    for i, raw in enumerate(raws):
        assert got[i] == model(raw), raw
