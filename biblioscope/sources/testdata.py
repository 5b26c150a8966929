"""Landing-form collections derived from the star-schema test tables.

The test folder holds TPC-H-like tables, not bibliographic documents, so the
three collections are derived from them by rule (see FIXTURES.md section 3):

* articles      - one per order (plus exact copies of every 97th order, to be
  removed by cleaning, and for some a variant that differs only in the text around
  the date); authors are the order's distinct suppliers, some with a null lab.
* authors_labs  - one per customer (plus a copy of every 10th customer), some
  without a lab.
* journaux      - one per part (plus a second row, another country, for every
  part whose key ends in 01); each carries a short ranking history built from
  the part row itself, so no group is ever gathered into one array; some entries are
  unranked (``-``), lack a quartile or have a malformed year.

Every derivation is a scan plus bounded per-row expressions, a per-order
aggregation (at most a few line items per order) and joins with dimension
tables; the work grows with the test tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioscope.operators.joins import dimension_fits, shuffle_partitions

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# The tables the views below read.
VIEW_TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "documents")

# Fixed values of the derivation rules (FIXTURES.md section 3).
ARTICLE_COPY_EVERY = 97
AUTHOR_COPY_EVERY = 10
JOURNAL_COPY_SUFFIX = 1      # p_partkey % 100 == 1 gets a second journal row
ARTICLE_LABS = 45            # labs referenced by articles: LAB-0 .. LAB-44
AFFILIATION_LABS = 40        # labs known to authors_labs: LAB-0 .. LAB-39
NATIONS = 25
VARIANT_EVERY, VARIANT_REST = 41, 16        # o_orderkey: a second row, other text around the date
NULL_LAB_EVERY, NULL_LAB_REST = 10, 8       # l_suppkey: the second lab of the author is null
NO_LAB_EVERY, NO_LAB_REST = 37, 36          # c_custkey: an author without a lab
UNRANKED_EVERY, UNRANKED_REST = 23, 5       # p_partkey + entry: the quartile is "-"
NO_QUARTILE_EVERY, NO_QUARTILE_REST = 29, 7     # p_partkey + entry: the quartile is null
BAD_YEAR_EVERY, BAD_YEAR_REST = 31, 3       # p_partkey + entry: the year is "n/a"
DAMAGE_EVERY, DAMAGE_REST = 53, 7           # the number in _id: the exported document is damaged
DAMAGE_CHARS = 24                           # a document of a line is cut off there

# Line items from which a shuffle partition is worth a task of its own.
MIN_TASK_LINES = 50_000
# Line items a task joins to their suppliers and combines, at most; and how many times the
# lines of a task, on average, one supplier may hold.
MAX_TASK_LINES = 400_000
SUPPLIER_SHARE = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _nation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The nation table has a fixed 25 rows by definition: a proven broadcast bound.
    return F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


def publication_text(k: Column, day: Column) -> Column:
    """Free-text publication date, one of eight styles chosen by ``k % 8``."""
    style = k % 8
    return (
        F.when(style == 0, F.date_format(day, "d MMMM yyyy"))
        .when(style == 1, F.date_format(day, "dd MMMM yyyy"))
        .when(style == 2, F.concat(F.lit("Volume "), (k % 200).cast("string"), F.lit(", "),
                                   F.date_format(day, "MMMM yyyy")))
        .when(style == 3, F.date_format(day, "yyyy"))
        .when(style == 4, F.date_format(day, "MMMM yyyy"))
        .when(style == 5, F.date_format(day, "d MMM yyyy"))
        .when(style == 6, F.lit("in press"))
    )


def keyword_text(k: Column) -> Column:
    """Comma-separated keywords with a case-differing repeat; some empty or null."""
    kw = F.concat(F.lit("Kw"), (k % 7).cast("string"))
    return (
        F.when(k % 17 == 0, F.lit(None).cast("string"))
        .when(k % 13 == 0, F.lit(""))
        .otherwise(F.concat(kw, F.lit(", topic "), (k % 11).cast("string"),
                            F.lit(",KW"), (k % 7).cast("string")))
    )


def author_labs(suppkey: Column) -> Column:
    first = F.concat(F.lit("LAB-"), (suppkey % ARTICLE_LABS).cast("string"))
    second = F.when(suppkey % NULL_LAB_EVERY != NULL_LAB_REST,
                    F.concat(F.lit("LAB-"), ((suppkey + 1) % ARTICLE_LABS).cast("string")))
    return F.when(suppkey % 2 == 0, F.array(first, second)).otherwise(F.array(first))


def _spread_suppliers(suppliers: DataFrame, lines: DataFrame, n_lines: int) -> DataFrame:
    """``suppliers`` dealt into so many partitions that no task joins more than some of the lines.

    The lines follow into the same number, which is not coalesced: after the join each task
    combines its lines by order, in memory several times what was shuffled.  Suppliers small
    enough for a broadcast stay as they are, and so they do where one holds so many lines
    that its partition has to be split.
    """
    if dimension_fits(suppliers):
        return suppliers
    n = max(shuffle_partitions(lines), -(-n_lines // MAX_TASK_LINES))
    per_supplier = lines.where(F.col("l_suppkey").isNotNull()).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    largest = per_supplier.agg(F.max("n")).first()[0] or 0
    return suppliers if largest * n > SUPPLIER_SHARE * n_lines else suppliers.repartition(n, "s_suppkey")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    orders = orders.withColumn("doi", F.col("o_orderkey").cast("string"))
    n, n_lines = shuffle_partitions(lines), lines.count()
    if n_lines >= n * MIN_TASK_LINES:
        # a shuffle into a given number is not coalesced: its tasks, which group, sort and
        # clean whole articles, stay small enough for memory
        orders = orders.repartition(n, "doi")
        suppliers = _spread_suppliers(suppliers, lines, n_lines)
    # Per order: the set of its suppliers as authors and its lowest part as journal.
    # Partial aggregation runs before the shuffle, so even an order holding a large
    # share of all lines reaches its reducer pre-combined per map task.  Only the keys
    # and names are shuffled and sorted; the labs follow from the key, once the order's
    # row is put together.  Both sides are keyed by the doi, so that rows leave the join
    # partitioned by a column of theirs and cleaning need not shuffle whole articles again.
    per_order = (
        lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
        .groupBy(F.col("l_orderkey").cast("string").alias("l_doi"))
        .agg(F.collect_set(F.struct("s_name", "l_suppkey")).alias("suppliers"),
             F.min("l_partkey").alias("first_part"))
    )
    # sorted: a recomputed task yields the same array, hence the same row; distinct: two
    # suppliers of one name may have the same labs
    authors = F.array_sort(F.array_distinct(F.transform("suppliers", lambda a: F.struct(
        a["s_name"].alias("name"), author_labs(a["l_suppkey"]).alias("labs")))))
    k = F.col("o_orderkey")
    journal = (
        F.when(k % 50 == 0, F.lit(None).cast("string"))
        .when(k % 27 == 26, F.concat(F.lit("Unlisted "), F.col("first_part").cast("string")))
        .otherwise(F.concat(F.lit("Journal "), F.col("first_part").cast("string")))
    )
    copies = (F.when(k % ARTICLE_COPY_EVERY == 0, F.array(F.lit("a"), F.lit("b")))
              .when(k % VARIANT_EVERY == VARIANT_REST, F.array(F.lit("a"), F.lit("v")))
              .otherwise(F.array(F.lit("a"))))
    text = publication_text(k, F.col("o_orderdate"))
    return (
        orders.join(per_order, orders.doi == per_order.l_doi, "left")
        .select(
            F.explode(copies).alias("copy"),
            F.col("o_orderkey"),
            F.concat(F.lit("Article "), k.cast("string")).alias("article_title"),
            "doi",
            F.when(F.col("copy") == "v", F.concat(F.lit("Available online "), text))
            .otherwise(text).alias("publication_date"),
            keyword_text(k).alias("keywords"),
            journal.alias("journal_name"),
            F.col("suppliers"),
        )
        .select(
            F.concat(F.col("copy"), k.cast("string")).alias("_id"),
            "article_title", "doi", "publication_date", "keywords", "journal_name", authors.alias("authors_data"),
        )
    )


def authors_labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    c = F.col("c_custkey")
    lab_no = c % AFFILIATION_LABS
    copies = F.when(c % AUTHOR_COPY_EVERY == 0, F.array(F.lit("c"), F.lit("d"))).otherwise(F.array(F.lit("c")))
    nations = _nation_names(spark, sf_dir)
    return (
        customers.join(nations, (lab_no % NATIONS) == nations.n_nationkey, "left")
        .select("*", F.explode(copies).alias("copy"))
        .select(
            F.concat(F.col("copy"), c.cast("string")).alias("_id"),
            F.col("c_name").alias("name"),
            F.when(c % NO_LAB_EVERY != NO_LAB_REST,
                   F.concat(F.lit("LAB-"), lab_no.cast("string"))).alias("lab"),
            F.when(lab_no == AFFILIATION_LABS - 1, F.lit(None).cast("string"))
            .otherwise(F.col("n_name")).alias("country"),
        )
    )


def ranking_history(p: Column, size: Column, ptype: Column, pname: Column) -> Column:
    """1-4 yearly rankings of one journal, derived from its part row only."""
    noun = F.element_at(F.split(pname, " "), -1)
    category = F.concat(ptype, F.lit(" "), noun)

    def entry(i: Column) -> Column:
        offset = (size + i) % 10
        return F.struct(
            category.alias("Category"),
            F.when((p + i) % BAD_YEAR_EVERY == BAD_YEAR_REST, F.lit("n/a"))
            .otherwise((F.lit(2000) + offset).cast("string")).alias("Year"),
            F.when((p + i) % UNRANKED_EVERY == UNRANKED_REST, F.lit("-"))
            .when((p + i) % NO_QUARTILE_EVERY != NO_QUARTILE_REST,
                  F.concat(F.lit("Q"), (F.lit(1) + (offset + p % 2 + i) % 4).cast("string"))).alias("Quartile"),
        )

    history = F.transform(F.sequence(F.lit(0), size % 4), entry)
    # Every 60th journal has an empty history, which explode drops.
    return F.when(p % 60 == 59, F.filter(history, lambda e: F.lit(False))).otherwise(history)


def journaux(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    p = F.col("p_partkey")
    copies = F.when(p % 100 == JOURNAL_COPY_SUFFIX, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = parts.select("*", F.explode(copies).alias("copy"))
    nations = _nation_names(spark, sf_dir)
    return (
        rows.join(nations, ((p + F.col("copy")) % NATIONS) == nations.n_nationkey, "left")
        .select(
            F.concat(F.lit("j"), p.cast("string"), F.lit("-"), F.col("copy").cast("string")).alias("_id"),
            F.concat(F.lit("Journal "), p.cast("string")).alias("Journal Name"),
            F.concat(F.lit("ISSN-"), p.cast("string")).alias("ISSN"),
            F.when(p % 50 == 49, F.lit(None).cast("string")).otherwise(F.col("n_name")).alias("Country"),
            ranking_history(p, F.col("p_size"), F.col("p_type"), F.col("p_name")).alias("Data"),
        )
    )


def exported(rows: DataFrame, collection: str) -> DataFrame:
    """(value) the landing rows as JSON documents; those of some keys are damaged.

    A document on a line of its own is cut off; a journal, which stands in an array, has
    text where its ranking history should be.
    """
    key = F.regexp_extract("_id", r"\d+", 0).cast("long")
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    broken = (F.to_json(F.struct(F.col("_id"), F.lit("lost").alias("Data"))) if collection == "journaux"
              else F.substring(whole, 1, DAMAGE_CHARS))
    return rows.select(F.when(key % DAMAGE_EVERY == DAMAGE_REST, broken).otherwise(whole).alias("value"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


LANDING_VIEWS = {
    "articles": articles,
    "journaux": journaux,
    "authors_labs": authors_labs,
}
