from biblioscope.operators.articles import (articles_by_date_frames, articles_by_journal,
                                            articles_by_journal_country, articles_dated,
                                            authors_by_country_top20, distinct_authors,
                                            labs_top20, top_authors)
from biblioscope.sources.schemas import JOURNALS
from helpers import articles_df, as_set, author, authors_labs_df


def journals(spark, rows):
    return spark.createDataFrame([(n, i, c, []) for n, i, c in rows], JOURNALS)


def test_journal_country_join(spark):
    arts = articles_df(spark, [{"doi": "1", "journal_name": "J1"}, {"doi": "2", "journal_name": "J1"},
                               {"doi": "3", "journal_name": "J2"}, {"doi": "4", "journal_name": None},
                               {"doi": None, "journal_name": "J2"}])
    jr = journals(spark, [("J1", "a", "FR"), ("J1", "b", "MA"), ("J2", "c", "FR"), (None, "d", "ES")])
    # J1 on two rows: its articles count once per row; null doi is not counted
    assert as_set(articles_by_journal_country(arts, jr)) == {("FR", 3), ("MA", 2)}
    assert as_set(articles_by_journal_country(arts, jr, null_safe=True)) == {("FR", 3), ("MA", 2), ("ES", 1)}


def test_articles_by_journal_share(spark):
    arts = articles_df(spark, [{"doi": str(i), "journal_name": j} for i, j in enumerate(["A", "A", "B", None])])
    got = as_set(articles_by_journal(arts))
    assert got == {("A", 2, 0.5), ("B", 1, 0.25), (None, 1, 0.25)}


def test_frames_compact_form(spark):
    arts = articles_df(spark, [{"doi": str(i), "publication_date": d} for i, d in enumerate(
        ["3 March 2020", "3 March 2020", "1 January 1999", None, "5 May 2021", "6 June 2021"])])
    frames = sorted((r.first_frame, r.publication_date, r.article_count)
                    for r in articles_by_date_frames(articles_dated(arts)).collect())
    assert [f[0] for f in frames] == [0, 1, 2, 3, 4]
    assert frames[0][1] is None and frames[1][1].year == 1999 and frames[2][2] == 2
    # the last frame (all first_frame <= 4) is the whole series
    assert sum(f[2] for f in frames) == 6


def test_top_authors_ties_by_name(spark):
    arts = articles_df(spark, [
        {"doi": "1", "authors_data": [author("b", []), author("a", [])]},
        {"doi": "2", "authors_data": [author("c", []), author("a", [])]},
        {"doi": "3", "authors_data": [author("b", [])]},
    ])
    assert [tuple(r) for r in top_authors(arts, 2).collect()] == [("a", 2), ("b", 2)]
    assert as_set(distinct_authors(arts)) == {("a",), ("b",), ("c",)}


def test_value_count_tops(spark):
    labs = authors_labs_df(spark, [("x", "L1", "FR"), ("y", "L1", "FR"), ("z", "L2", None),
                                   ("w", "L3", "MA")])
    assert [tuple(r) for r in authors_by_country_top20(labs).collect()] == [("FR", 2), ("MA", 1)]
    assert [tuple(r) for r in labs_top20(labs, 2).collect()] == [("L1", 2), ("L2", 1)]
