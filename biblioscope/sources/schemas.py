"""Declared schemas of the three collections, in landing and canonical form.

Landing form is what the document store exports (original field names, ``_id``
included).  Canonical form is what every operator consumes: snake_case names,
``year`` as INT, no ``_id``.  Declaring the schema avoids an inference pass over
the whole landing folder on every load.
"""

from pyspark.sql import types as T

AUTHOR = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("labs", T.ArrayType(T.StringType())),
])

RANKING_LANDING = T.StructType([
    T.StructField("Category", T.StringType()),
    T.StructField("Year", T.StringType()),
    T.StructField("Quartile", T.StringType()),
])

RANKING = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("quartile", T.StringType()),
])

ARTICLES_LANDING = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("article_title", T.StringType()),
    T.StructField("doi", T.StringType()),
    T.StructField("publication_date", T.StringType()),
    T.StructField("keywords", T.StringType()),
    T.StructField("journal_name", T.StringType()),
    T.StructField("authors_data", T.ArrayType(AUTHOR)),
])

JOURNALS_LANDING = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("Journal Name", T.StringType()),
    T.StructField("ISSN", T.StringType()),
    T.StructField("Country", T.StringType()),
    T.StructField("Data", T.ArrayType(RANKING_LANDING)),
])

AUTHORS_LABS_LANDING = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("lab", T.StringType()),
    T.StructField("country", T.StringType()),
])

LANDING = {
    "articles": ARTICLES_LANDING,
    "journaux": JOURNALS_LANDING,
    "authors_labs": AUTHORS_LABS_LANDING,
}

ARTICLES = T.StructType([f for f in ARTICLES_LANDING.fields if f.name != "_id"])

JOURNALS = T.StructType([
    T.StructField("journal_name", T.StringType()),
    T.StructField("issn", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("data", T.ArrayType(RANKING)),
])

AUTHORS_LABS = T.StructType([f for f in AUTHORS_LABS_LANDING.fields if f.name != "_id"])

CANONICAL = {
    "articles": ARTICLES,
    "journaux": JOURNALS,
    "authors_labs": AUTHORS_LABS,
}
