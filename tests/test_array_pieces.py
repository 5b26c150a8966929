"""Splits of a JSON array are summed and sorted in pieces of some fragments; records do not depend on the pieces."""

import json
import random

import pytest
from pyspark.sql import functions as F

from biblioscope.sources import json_objects

TEXTS = ["plain", 'a "quoted" {brace}', "}", "{", '\\"}', "[1,{2}]", "", "line\nfeed", "é 🙂", "}{" * 9]


def document(i):
    rng = random.Random(i)
    return json.dumps({"_id": str(i), "t": rng.choice(TEXTS), "d": [{"x": rng.choice(TEXTS)} for _ in range(rng.randrange(4))]})


@pytest.fixture
def folder(spark, tmp_path):
    docs = [document(i) for i in range(60)]
    (tmp_path / "sound.json").write_text("[" + ",".join(docs) + "]")
    (tmp_path / "cut.json").write_text("[" + ",".join(docs)[:-5])                                   # the last has no end
    (tmp_path / "broken.json").write_text("[" + ",".join(docs[:9]) + "}" + ",".join(docs[9:]) + "]")  # one brace too many
    (tmp_path / "empty.json").write_text("[]")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    yield str(tmp_path), docs
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("bits", [0, 1, 4])
def test_records_do_not_depend_on_the_pieces(spark, folder, monkeypatch, bits):
    path, docs = folder
    got = {}
    for b in (bits, 30):
        monkeypatch.setattr(json_objects, "PIECE_BITS", b)
        got[b] = sorted((r.whole, r.record) for r in json_objects.read_objects(spark, path).collect())
    assert got[bits] == got[30]
    assert sorted(r for whole, r in got[bits] if whole) == sorted(docs + docs[:-1])
    assert sum(not whole for whole, _ in got[bits]) > 60


def test_no_piece_has_more_than_some_fragments(spark, folder, monkeypatch):
    monkeypatch.setattr(json_objects, "PIECE_BITS", 2)
    sizes = json_objects._fragments(spark, folder[0]).groupBy("file", "split").agg(F.count("n").alias("n")).collect()
    assert max(r.n for r in sizes) == 4
    assert all(len(r.file) == 16 for r in sizes)
