"""Keyword counts against a pure-Python model: split on ',', trim spaces, lower-case,
distinct per article, count articles per keyword."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from biblioscope.operators.keywords import keyword_count_table
from helpers import articles_df

word = st.text(alphabet="abcABC xyZ-é\t", max_size=6)
keywords = st.one_of(st.none(), st.lists(word, max_size=6).map(",".join))


def model(raws):
    counts = Counter()
    for raw in raws:
        if raw is None:
            continue
        counts.update({part.strip(" ").lower() for part in raw.split(",")})
    return dict(counts)


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.too_slow, HealthCheck.data_too_large])
@given(st.lists(keywords, min_size=20, max_size=120))
def test_keyword_counts_match_model(spark, raws):
    rows = [{"doi": str(i), "keywords": r} for i, r in enumerate(raws)]
    got = {r.keyword: r.keyword_count for r in keyword_count_table(articles_df(spark, rows)).collect()}
    assert got == model(raws)


import re  # noqa: E402

from biblioscope.functions.text import STOP_WORDS  # noqa: E402
from biblioscope.operators.keywords import word_frequencies  # noqa: E402

WORD = re.compile(r"[^\W][\w']*")
text = st.lists(st.sampled_from(["the", "cat", "and", "hat", "a", "x", "l'été", "sat", "on", "it's", "--", "7"]),
                max_size=30).map(" ".join)


def words_model(texts, bigrams):
    counts = Counter()
    for t in texts:
        toks = WORD.findall(t.lower())
        counts.update(w for w in toks if w not in STOP_WORDS)
        if bigrams:
            counts.update(f"{a} {b}" for a, b in zip(toks, toks[1:])
                          if a not in STOP_WORDS and b not in STOP_WORDS)
    return dict(counts)


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.too_slow, HealthCheck.data_too_large])
@given(st.lists(text, min_size=1, max_size=20), st.booleans())
def test_word_frequencies_match_model(spark, texts, bigrams):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.word: r.n for r in word_frequencies(df, "text", bigrams).collect()}
    assert got == words_model(texts, bigrams)
