"""Landing path = test-table path: exported collections give the same results."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from biblioscope.__main__ import main as cli
from biblioscope.plans.catalog import RESULTS
from biblioscope.sources.landing import write_landing
from biblioscope.sources.tables import COLLECTIONS, Workspace
from helpers import as_set

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")

SAMPLE = ["cleaning_report", "country_pairs", "keyword_counts", "best_quartile_heatmap",
          "articles_by_journal_country", "articles_by_date"]


@pytest.fixture(scope="module")
def landed(spark):
    base = Workspace.from_testdata(spark, SF, materialize=False)
    d = tempfile.mkdtemp(prefix="bs-ws-")
    paths = {}
    for c in COLLECTIONS:
        paths[c] = os.path.join(d, c)
        write_landing(base.raw(c), paths[c], "jsonl")
    return base, paths, d


@pytest.mark.parametrize("name", SAMPLE)
def test_jsonl_landing_matches_testdata(spark, landed, name):
    base, paths, d = landed
    ws = Workspace.from_landing(spark, paths, "jsonl", table_root=os.path.join(d, "tables"))
    assert as_set(RESULTS[name](ws)) == as_set(RESULTS[name](base))


def test_json_array_landing(spark, landed):
    base, paths, d = landed
    arrays = {}
    for c in COLLECTIONS:
        rows = [json.loads(r) for r in base.raw(c).toJSON().collect()]
        arrays[c] = os.path.join(d, f"{c}.json")
        with open(arrays[c], "w") as f:
            json.dump(rows, f)
    ws = Workspace.from_landing(spark, arrays, "json", table_root=os.path.join(d, "tables-array"))
    assert as_set(RESULTS["country_triples"](ws)) == as_set(RESULTS["country_triples"](base))


def test_cli_writes_results(spark, tmp_path):
    out = str(tmp_path / "out")
    assert cli(["run", "country_pairs", "quartile_by_country_wide", "--testdata", SF, "--out", out]) == 0
    pairs = spark.read.parquet(os.path.join(out, "country_pairs"))
    assert pairs.columns == ["country_a", "country_b", "collaboration_count"]
    assert pairs.count() == 45


def test_cli_list(capsys):
    assert cli(["list"]) == 0
    names = capsys.readouterr().out.split()
    assert set(names) == set(RESULTS) and len(names) == 43


def test_fingerprint_follows_the_data(spark, tmp_path):
    from biblioscope.sources.tables import _fingerprint
    d = tmp_path / "landing"
    d.mkdir()
    (d / "part-0.json").write_text('{"a": 1}\n')
    first = _fingerprint(spark, "jsonl", str(d))
    assert first == _fingerprint(spark, "jsonl", str(d))
    (d / "part-1.json").write_text('{"a": 2}\n')
    assert _fingerprint(spark, "jsonl", str(d)) != first
    assert _fingerprint(None, "jsonl", str(d)) != _fingerprint(None, "jsonl", str(d) + "-missing")


def test_cli_explain(capsys):
    assert cli(["explain", "country_pairs", "--testdata", SF]) == 0
    out = capsys.readouterr().out
    assert "== country_pairs ==" in out and "HashAggregate" in out


def test_from_dataframes_matches_testdata(spark, landed):
    base, _, d = landed
    frames = {c: base.raw(c) for c in COLLECTIONS}
    lazy = Workspace.from_dataframes(spark, frames)
    assert not lazy.materialize
    written = Workspace.from_dataframes(spark, frames, dataset="base", version="v1",
                                        table_root=os.path.join(d, "frames"))
    for name in ("country_pairs", "quartile_by_country_wide", "cleaning_report"):
        want = as_set(RESULTS[name](base))
        assert as_set(RESULTS[name](lazy)) == want
        assert as_set(RESULTS[name](written)) == want


def test_parquet_landing_read_in_place(spark, landed):
    base, paths, d = landed
    pq = {}
    for c in COLLECTIONS:
        pq[c] = os.path.join(d, f"pq-{c}")
        write_landing(base.raw(c), pq[c], "parquet")
    ws = Workspace.from_landing(spark, pq, "parquet", table_root=os.path.join(d, "tables-pq"))
    assert not ws.land_raw
    for name in ("country_triples", "best_quartile_heatmap", "articles_by_year_month"):
        assert as_set(RESULTS[name](ws)) == as_set(RESULTS[name](base))


def test_refresh_rewrites_committed_tables(spark, landed):
    base, paths, d = landed
    root = os.path.join(d, "tables-refresh")
    first = Workspace.from_landing(spark, paths, "jsonl", table_root=root)
    open_reader = first.authors_labs()
    rows = open_reader.count()
    attempts = lambda: sorted(os.listdir(first.table_path("authors_labs")))
    [written] = attempts()
    again = Workspace.from_landing(spark, paths, "jsonl", table_root=root)
    again.authors_labs().count()
    assert attempts() == [written]                       # finished copy reused
    forced = Workspace.from_landing(spark, paths, "jsonl", table_root=root, refresh=True)
    forced.authors_labs().count()
    assert attempts()[0] == written and len(attempts()) == 2     # rebuilt on request, beside the old one
    assert open_reader.count() == rows                   # whoever reads the old one goes on


def test_failed_write_leaves_the_old_table(spark, tmp_path):
    good = spark.createDataFrame([("1", "n", "L", "FR")], "_id string, name string, lab string, country string")
    bad = good.select("_id", "name", "lab", F.raise_error(F.lit("lost")).cast("string").alias("country"))
    make = lambda df, **kw: Workspace(spark, lambda c: df, "k", table_root=str(tmp_path), **kw)
    make(good).authors_labs().count()
    with pytest.raises(Exception, match="lost"):
        make(bad, refresh=True).authors_labs().count()
    assert as_set(make(bad).authors_labs()) == {("n", "L", "FR")}


def test_frames_are_keyed_by_dataset_and_version(spark, landed, tmp_path):
    base, _, _ = landed
    frames = {c: base.raw(c) for c in COLLECTIONS}
    other = {**frames, "authors_labs": frames["authors_labs"].where("lab = 'LAB-1'")}
    make = lambda f, **kw: Workspace.from_dataframes(spark, f, table_root=str(tmp_path), **kw)
    everyone = make(frames, dataset="all", version="v1").authors_labs().count()
    some = make(other, dataset="one lab", version="v1").authors_labs().count()
    assert 0 < some < everyone
    with pytest.raises(ValueError):
        make(frames, version="v1")


def test_rewritten_file_in_a_subfolder_changes_the_fingerprint(spark, tmp_path):
    from biblioscope.sources.tables import _fingerprint
    inner = tmp_path / "landing" / "year=2024"
    inner.mkdir(parents=True)
    part = inner / "part-0.json"
    part.write_text('{"a": 1}\n')
    os.utime(part, (1_700_000_000, 1_700_000_000))
    before = [_fingerprint(s, "jsonl", str(tmp_path / "landing")) for s in (spark, None)]
    part.write_text('{"a": 2}\n')                        # same size, same folder times
    os.utime(part, (1_700_000_100, 1_700_000_100))
    after = [_fingerprint(s, "jsonl", str(tmp_path / "landing")) for s in (spark, None)]
    assert before[0] != after[0] and before[1] != after[1]
