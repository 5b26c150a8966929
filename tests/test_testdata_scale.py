"""The derived articles: rows held against plain Python, shuffles counted, tasks of large inputs kept apart."""

import datetime
import glob
import re

import pytest
from pyspark.sql import functions as F

from biblioscope.operators.cleaning import clean_with_copies
from biblioscope.sources import tables, testdata
from biblioscope.sources.landing import read_records
from biblioscope.sources.tables import Workspace

# two orders of one key, keys without lines, null keys; suppliers 2 and 92 share name and labs
ORDERS = [97, 97, 5, 7, 8, 13, None, None]
LINES = [(97, 1, 9), (97, 2, 4), (97, 2, 3), (5, 2, 8), (5, 92, 2), (5, 2, 1), (7, 3, 6), (7, 77, 1), (8, None, 5), (None, 1, 1), (13, 4, None)]
SUPPLIERS = [(1, "s1"), (2, "twin"), (92, "twin"), (3, None), (4, "s4"), (4, "other4"), (None, "nobody")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("articles"))
    day = datetime.datetime(2020, 3, 4)
    spark.createDataFrame([(k, day) for k in ORDERS], "o_orderkey long, o_orderdate timestamp").write.parquet(f"{top}/orders.parquet")
    spark.createDataFrame(LINES, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{top}/lineitem.parquet")
    spark.createDataFrame(SUPPLIERS, "s_suppkey long, s_name string").write.parquet(f"{top}/supplier.parquet")
    return top


def labs(key):
    first, second = f"LAB-{key % 45}", None if key % 10 == 8 else f"LAB-{(key + 1) % 45}"
    return (first, second) if key % 2 == 0 else (first,)


def expected():
    rows = []
    for k in ORDERS:
        pairs = [(name, s, p) for o, s, p in LINES for key, name in SUPPLIERS if k is not None and o == k and s is not None and s == key]
        authors = frozenset((name, labs(s)) for name, s, _ in pairs) if pairs else None
        rows += [(k, authors)] * (2 if k is not None and (k % 97 == 0 or k % 41 == 16) else 1)
    return rows


def shown(df):
    return [(r.doi and int(r.doi), r.authors_data if r.authors_data is None else [(a["name"], tuple(a["labs"])) for a in r.authors_data])
            for r in df.collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("least", [testdata.MIN_TASK_LINES, 1])
def test_articles_have_each_author_of_their_order_once(spark, folder, monkeypatch, least):
    monkeypatch.setattr(testdata, "MIN_TASK_LINES", least)
    got = shown(testdata.articles(spark, folder))
    assert all(a is None or len(a) == len(set(a)) for _, a in got)
    key = lambda r: (str(r[0]), sorted(map(str, r[1] or ())))
    assert sorted(((k, a and frozenset(a)) for k, a in got), key=key) == sorted(expected(), key=key)
    journals = {r.doi: r.journal_name for r in testdata.articles(spark, folder).collect()}
    assert journals["97"] == "Journal 3" and journals["5"] == "Journal 1" and journals["7"] == "Journal 6" and journals["8"] is None


def test_cleaning_the_articles_shuffles_no_whole_article(spark, folder):
    p = plan(clean_with_copies(testdata.articles(spark, folder), "articles"))
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 2      # orders and the lines of each
    assert not re.search(r"Exchange hashpartitioning\([^)]*authors_data", p)


def test_large_inputs_keep_every_shuffle_partition_a_task(spark, folder, monkeypatch):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = clean_with_copies(testdata.articles(spark, folder), "articles")
    monkeypatch.setattr(testdata, "MIN_TASK_LINES", 1)
    many = clean_with_copies(testdata.articles(spark, folder), "articles")
    assert "REPARTITION_BY_NUM" not in plan(few) and plan(many).count("REPARTITION_BY_NUM") == 1
    assert len(re.findall(r"Exchange hashpartitioning", plan(many))) == 2
    monkeypatch.setattr(testdata, "MIN_TASK_LINES", 100)
    assert n * 100 > len(LINES) and sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


@pytest.fixture
def shuffled_suppliers(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(testdata, "MIN_TASK_LINES", 1)
    yield monkeypatch
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_inputs_join_suppliers_in_tasks_of_some_lines(spark, folder, shuffled_suppliers):
    shuffled_suppliers.setattr(testdata, "MAX_TASK_LINES", 1)
    shuffled_suppliers.setattr(testdata, "SUPPLIER_SHARE", len(LINES))       # no supplier is frequent
    assert len(LINES) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = clean_with_copies(testdata.articles(spark, folder), "articles")
    p = plan(df)
    for side in ("l_suppkey", "s_suppkey"):
        assert re.search(rf"hashpartitioning\({side}#\d+L, {len(LINES)}\)", p)
    assert p.count("REPARTITION_BY_NUM") == 2
    key = lambda r: (str(r[0]), sorted(map(str, r[1] or ())))
    got = shown(testdata.articles(spark, folder))
    assert sorted(((k, a and frozenset(a)) for k, a in got), key=key) == sorted(expected(), key=key)


def test_frequent_suppliers_are_left_to_be_split(spark, folder, shuffled_suppliers):
    shuffled_suppliers.setattr(testdata, "SUPPLIER_SHARE", 0)
    p = plan(testdata.articles(spark, folder))
    assert p.count("REPARTITION_BY_NUM") == 1 and not re.search(r"hashpartitioning\(s_suppkey[^)]*\), REPARTITION_BY_NUM", p)
    key = lambda r: (str(r[0]), sorted(map(str, r[1] or ())))
    got = shown(testdata.articles(spark, folder))
    assert sorted(((k, a and frozenset(a)) for k, a in got), key=key) == sorted(expected(), key=key)


def test_exported_lines_are_compressed_files_of_some_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "EXPORT_FILE_RECORDS", 40)
    rows = spark.range(0, 250, 1, 1).select(F.concat(F.lit("c"), "id").alias("_id"), F.concat(F.lit("n"), "id").alias("name"),
                                            F.lit("LAB-1").alias("lab"), F.lit("FR").alias("country"))
    ws = Workspace(spark, lambda c: rows, "exported", table_root=str(tmp_path))
    path = ws.export("authors_labs")
    files = glob.glob(f"{path}/part-*")
    assert len(files) == 7 and all(f.endswith(".txt.gz") for f in files)
    got = read_records(spark, path, "authors_labs").collect()
    assert len(got) == 250
    assert {r.name for r in got if r._damaged is None} == {f"n{i}" for i in range(250) if i % 53 != 7}
