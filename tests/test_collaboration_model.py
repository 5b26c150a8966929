"""Country k-tuples against a brute-force Python model, on both join paths."""

from collections import Counter
from itertools import combinations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from biblioscope.operators.collaboration import country_collaborations
from helpers import articles_df, author, authors_labs_df

COUNTRIES = ["FR", "MA", "ES", "DE", "IT", None]
LABS = [f"L{i}" for i in range(10)]

affiliation = st.tuples(st.sampled_from(["a", "b", "c"]), st.sampled_from(LABS[:8]),
                        st.sampled_from(COUNTRIES))
author_entry = st.tuples(st.sampled_from(["x", "y", "z", None]),
                         st.one_of(st.none(), st.lists(st.sampled_from(LABS), max_size=3)))
article = st.tuples(st.one_of(st.none(), st.sampled_from([str(i) for i in range(12)])),
                    st.one_of(st.none(), st.lists(author_entry, max_size=4)))


def model(articles, labs, k):
    lab_countries = {}
    for _, lab, country in labs:
        if country is not None:
            lab_countries.setdefault(lab, set()).add(country)
    per_doi = {}
    for doi, authors in articles:
        if doi is None or not authors:
            continue
        for _, author_labs in authors:
            for lab in author_labs or []:
                per_doi.setdefault(doi, set()).update(lab_countries.get(lab, ()))
    counts = Counter()
    for countries in per_doi.values():
        counts.update(combinations(sorted(countries), k))
    return {combo + (n,) for combo, n in counts.items()}


@settings(max_examples=10, deadline=None,
          suppress_health_check=[HealthCheck.too_slow, HealthCheck.data_too_large])
@given(st.lists(article, max_size=25), st.lists(affiliation, min_size=1, max_size=15),
       st.sampled_from([2, 3]), st.booleans())
def test_tuples_match_brute_force(spark, articles, labs, k, salted):
    arts = articles_df(spark, [{"doi": d, "authors_data": None if a is None else
                                [author(n, ls) for n, ls in a]} for d, a in articles])
    al = authors_labs_df(spark, labs)
    opts = {"max_broadcast_rows": 0, "partitions": 4} if salted else {}
    got = {tuple(r) for r in country_collaborations(arts, al, k, ordered=False, **opts).collect()}
    assert got == model(articles, labs, k)
