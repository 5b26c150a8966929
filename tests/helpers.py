from pyspark.sql import types as T

from biblioscope.sources import schemas


def articles_df(spark, rows):
    """rows: dicts with any of the canonical article fields (others null)."""
    names = [f.name for f in schemas.ARTICLES.fields]
    data = [tuple(r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(data, schemas.ARTICLES)


def authors_labs_df(spark, rows):
    return spark.createDataFrame(rows, schemas.AUTHORS_LABS)


def flat_df(spark, rows):
    schema = T.StructType([
        T.StructField("journal_name", T.StringType()),
        T.StructField("issn", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("quartile", T.StringType()),
    ])
    return spark.createDataFrame(rows, schema)


def as_set(df, *cols):
    cols = cols or df.columns
    return {tuple(r[c] for c in cols) for r in df.collect()}


def author(name, labs):
    return {"name": name, "labs": labs}
