import datetime as dt

from biblioscope.operators.articles import (articles_by_date, articles_by_year,
                                            articles_by_year_month, articles_by_year_month_wide,
                                            articles_dated)
from helpers import articles_df

D = dt.date

# raw text -> (extracted fragment, parsed date)
CASES = {
    "3 December 2024": ("3 December 2024", D(2024, 12, 3)),
    "12 MARCH 2021": ("12 MARCH 2021", D(2021, 3, 12)),
    "10-12 June 2023": ("12 June 2023", D(2023, 6, 12)),
    "Volume 139, January 2025": ("January 2025", D(2025, 1, 1)),
    "Volume 1390, January 2025": ("Volume 1390", None),
    "January 2025": ("2025", D(2025, 1, 1)),
    "March 2025": ("2025", D(2025, 1, 1)),
    "3 Dec 2024": ("3 Dec 2024", None),
    "3 décembre 2024": ("2024", D(2024, 1, 1)),
    "2024-05-06": ("2024", D(2024, 1, 1)),
    "31 February 2024": ("31 February 2024", None),
    "in press": (None, None),
    "": (None, None),
    "0000": ("0000", None),
}


def test_date_cascade(spark):
    rows = [{"doi": str(i), "publication_date": raw} for i, raw in enumerate(CASES)]
    rows.append({"doi": "null", "publication_date": None})
    got = {r["publication_date_raw"]: (r["extracted_date"], r["publication_date"])
           for r in articles_dated(articles_df(spark, rows)).collect()}
    for raw, expected in CASES.items():
        assert got[raw] == expected, raw
    assert got[None] == (None, None)


def test_year_counts_use_text_year(spark):
    rows = [{"doi": "1", "publication_date": "3 Dec 2024"},
            {"doi": "2", "publication_date": "5 May 2024"},
            {"doi": "3", "publication_date": "in press"},
            {"doi": "4", "publication_date": None}]
    dated = articles_dated(articles_df(spark, rows))
    # the abbreviation does not parse, yet the text year still counts
    assert [tuple(r) for r in articles_by_year(dated).collect()] == [("2024", 2)]


def test_null_dates_group_first_and_leave_wide_table(spark):
    rows = [{"doi": "1", "publication_date": "in press"},
            {"doi": "2", "publication_date": None},
            {"doi": "3", "publication_date": "3 March 2020"},
            {"doi": "4", "publication_date": "4 March 2020"},
            {"doi": "5", "publication_date": "4 April 2021"}]
    dated = articles_dated(articles_df(spark, rows))
    by_date = [tuple(r) for r in articles_by_date(dated).collect()]
    assert by_date[0] == (None, 2)
    assert len(by_date) == 4
    long = {tuple(r) for r in articles_by_year_month(dated).collect()}
    assert (None, None, 2) in long and (2020, 3, 2) in long
    wide = {r["year"]: r for r in articles_by_year_month_wide(dated).collect()}
    assert set(wide) == {2020, 2021}
    assert wide[2020]["m03"] == 2 and wide[2020]["m04"] == 0 and wide[2021]["m04"] == 1


def test_cascade_stays_native(spark):
    rows = [{"doi": "1", "publication_date": "3 March 2020"}]
    plan = articles_dated(articles_df(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
