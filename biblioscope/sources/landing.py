"""Landing readers and writers (collection scan, JSON export, JSON scan).

The source system exports each collection as documents.  Three layouts are read:

* ``jsonl``  - one document per line; splittable.
* ``json``   - one top-level JSON array per file (the export format of the
  original tool), read by all splits of a file (``json_objects``).
* ``parquet`` - columnar landing; column pruning and filter pushdown apply.

Every reader applies the declared landing schema, then ``canonicalize`` maps the
landing names to the canonical ones.  A JSON record that is no object, does not parse
or does not fit the schema is never turned into a row of nulls: ``read_records`` carries
its text in ``_damaged``, ``read_landing`` gives the sound rows and ``quarantined`` the
others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biblioscope.sources import schemas
from biblioscope.sources.json_objects import read_objects

FORMATS = ("jsonl", "json", "parquet")
DAMAGED = "_damaged"
CORRUPT = "_corrupt_record"


def _parsed(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Fields of each ``record``, and the record itself where it is damaged.

    ``whole`` false marks text that is known not to be a whole record.
    """
    fields = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    row = F.from_json("record", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    parsed = records.select("record", "whole", row.alias("row"))
    sound = F.col("whole") & F.ltrim("record").startswith("{") & F.col(f"row.{CORRUPT}").isNull()
    return parsed.select(*[F.when(sound, F.col("row")[f.name]).alias(f.name) for f in schema.fields],
                         F.when(~sound, F.col("record")).alias(DAMAGED))


def read_records(spark: SparkSession, path: str, collection: str, fmt: str = "jsonl") -> DataFrame:
    """Scan one landed collection: its declared columns (landing names) and ``_damaged``."""
    schema = schemas.LANDING[collection]
    if fmt == "parquet":
        # Parquet carries its own schema (no inference pass); numeric vs string
        # ``Year`` and similar differences are settled by ``canonicalize``.
        df = spark.read.parquet(path)
        missing = [f.name for f in schema.fields if f.name not in df.columns and f.name != "_id"]
        if missing:
            raise ValueError(f"{collection} landing at {path} lacks columns {missing}")
        return df.withColumn(DAMAGED, F.lit(None).cast("string"))
    if fmt == "jsonl":
        lines = spark.read.text(path).where(F.col("value").rlike(r"\S"))
        return _parsed(lines.select(F.col("value").alias("record"), F.lit(True).alias("whole")), schema)
    if fmt == "json":
        return _parsed(read_objects(spark, path), schema)
    raise ValueError(f"unknown landing format {fmt!r}; expected one of {FORMATS}")


def sound(records: DataFrame) -> DataFrame:
    """The records that can be read, without ``_damaged``."""
    return records.where(F.col(DAMAGED).isNull()).drop(DAMAGED) if DAMAGED in records.columns else records


def quarantined(records: DataFrame) -> DataFrame:
    """(record) the text of every damaged record."""
    if DAMAGED not in records.columns:
        return records.select(F.lit(None).cast("string").alias("record")).where(F.lit(False))
    return records.where(F.col(DAMAGED).isNotNull()).select(F.col(DAMAGED).alias("record"))


def read_landing(spark: SparkSession, path: str, collection: str,
                 fmt: str = "jsonl") -> DataFrame:
    """Scan one landed collection with its declared schema (landing names); damaged records are left out."""
    return sound(read_records(spark, path, collection, fmt))


def json_lines(df: DataFrame) -> DataFrame:
    """(value) each row as one JSON document; null fields are left out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def write_json_arrays(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON documents (value) as one array per task, as the original tool exports them."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            lines = []
            for document in batch.column(0):
                lines.append(mark + document.as_py())
                mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"], pa.string())], names=["value"])

    documents.select("value").mapInArrow(arrays, "value string").write.mode(mode).text(path)


def write_landing(df: DataFrame, path: str, fmt: str = "jsonl",
                  mode: str = "overwrite") -> None:
    """Export a collection: JSON lines, JSON arrays (one per task) or Parquet."""
    if fmt == "jsonl":
        df.write.mode(mode).json(path)
    elif fmt == "json":
        write_json_arrays(json_lines(df), path, mode)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"cannot write landing format {fmt!r}")


def canonicalize(df: DataFrame, collection: str) -> DataFrame:
    """Rename landing columns to canonical snake_case; ``_id`` is kept if present."""
    keep_id = ["_id"] if "_id" in df.columns else []
    if collection == "journaux":
        data = F.transform(
            "Data",
            lambda d: F.struct(
                d["Category"].alias("category"),
                d["Year"].try_cast("int").alias("year"),
                d["Quartile"].alias("quartile"),
            ),
        )
        return df.select(
            *keep_id,
            F.col("`Journal Name`").alias("journal_name"),
            F.col("ISSN").alias("issn"),
            F.col("Country").alias("country"),
            data.alias("data"),
        )
    return df.select(*keep_id, *[f.name for f in schemas.CANONICAL[collection].fields])
