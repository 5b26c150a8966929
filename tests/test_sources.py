import json
import os
import tempfile

from biblioscope.operators.cleaning import clean, cleaning_report
from biblioscope.sources.landing import canonicalize, read_landing, write_landing
from helpers import as_set

DOCS = [
    {"_id": "1", "article_title": "T", "doi": "d1", "publication_date": "3 March 2020",
     "keywords": "a,b", "journal_name": "J", "authors_data": [{"name": "x", "labs": ["L"]}]},
    {"_id": "2", "article_title": "T", "doi": "d1", "publication_date": "3 March 2020",
     "keywords": "a,b", "journal_name": "J", "authors_data": [{"name": "x", "labs": ["L"]}]},
    {"_id": "3", "article_title": "U", "doi": "d2", "publication_date": None,
     "keywords": None, "journal_name": None, "authors_data": None},
]


def test_json_array_and_lines_read_the_same(spark):
    d = tempfile.mkdtemp(prefix="bs-landing-")
    arr = os.path.join(d, "articles.json")
    with open(arr, "w") as f:
        json.dump(DOCS, f)
    a = read_landing(spark, arr, "articles", "json")
    lines = os.path.join(d, "lines")
    write_landing(a, lines, "jsonl")
    b = read_landing(spark, lines, "articles", "jsonl")
    pq = os.path.join(d, "pq")
    write_landing(b, pq, "parquet")
    c = read_landing(spark, pq, "articles", "parquet")
    assert a.count() == b.count() == c.count() == 3
    assert as_set(canonicalize(a, "articles"), "doi", "keywords") == \
        as_set(canonicalize(c, "articles"), "doi", "keywords")


def test_cleaning_drops_id_and_duplicates(spark):
    d = tempfile.mkdtemp(prefix="bs-landing-")
    p = os.path.join(d, "a.json")
    with open(p, "w") as f:
        json.dump(DOCS, f)
    raw = read_landing(spark, p, "articles", "json")
    cleaned = clean(raw, "articles")
    assert "_id" not in cleaned.columns and cleaned.count() == 2


def test_cleaning_report_counts(spark):
    raw_articles = spark.createDataFrame(
        [(d["_id"], d["article_title"], d["doi"], d["publication_date"], d["keywords"],
          d["journal_name"], d["authors_data"]) for d in DOCS],
        "_id string, article_title string, doi string, publication_date string, keywords string,"
        " journal_name string, authors_data array<struct<name:string,labs:array<string>>>")
    raw_labs = spark.createDataFrame([("1", "n", "L", "FR"), ("2", "n", "L", "FR")],
                                     "_id string, name string, lab string, country string")
    raw_j = spark.createDataFrame([], "_id string, `Journal Name` string, ISSN string, Country string,"
                                      " Data array<struct<Category:string,Year:string,Quartile:string>>")
    rep = {r.collection: (r.rows_before, r.rows_after) for r in
           cleaning_report(spark, {"articles": raw_articles, "authors_labs": raw_labs,
                                   "journaux": raw_j}).collect()}
    assert rep == {"Articles": (3, 2), "Authors Labs": (2, 1), "Journaux": (0, 0)}


def test_parquet_landing_with_numeric_year(spark):
    from biblioscope.operators.rankings import journals_flat
    d = tempfile.mkdtemp(prefix="bs-landing-")
    raw = spark.createDataFrame(
        [("1", "J", "I", "FR", [("Math", 2020, "Q1")])],
        "_id string, `Journal Name` string, ISSN string, Country string,"
        " Data array<struct<Category:string,Year:bigint,Quartile:string>>")
    write_landing(raw, os.path.join(d, "j"), "parquet")
    got = journals_flat(canonicalize(read_landing(spark, os.path.join(d, "j"), "journaux", "parquet"), "journaux"))
    assert [tuple(r) for r in got.collect()] == [("J", "I", "FR", "Math", 2020, "Q1")]
    assert dict(got.dtypes)["year"] == "int"


def test_json_landing_with_numeric_and_string_years(spark):
    from biblioscope.operators.rankings import journals_flat
    d = tempfile.mkdtemp(prefix="bs-landing-")
    p = os.path.join(d, "j.json")
    with open(p, "w") as f:
        json.dump([{"_id": "1", "Journal Name": "J", "ISSN": "I", "Country": "FR",
                    "Data": [{"Category": "Math", "Year": 2020, "Quartile": "Q1"},
                             {"Category": "CS", "Year": "2021", "Quartile": "Q2"}]}], f)
    got = journals_flat(canonicalize(read_landing(spark, p, "journaux", "json"), "journaux"))
    assert sorted(tuple(r) for r in got.collect()) == [("J", "I", "FR", "CS", 2021, "Q2"),
                                                       ("J", "I", "FR", "Math", 2020, "Q1")]
