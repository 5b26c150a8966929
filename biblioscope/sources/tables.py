"""Workspace: the landed and cleaned collections every analytic reads.

A workspace is built from a *loader* - a function returning one collection in
landing form (``_id`` included):

* ``Workspace.from_landing`` reads exported collections (JSON array, JSON lines
  or Parquet) with the declared schemas - the production path;
* ``Workspace.from_testdata`` derives them from the star-schema test tables.

The cleaned tables (and a landed JSON array, which no later job could split) are
computed once and written as Parquet under the shared folder named by
``spark.checkpoint.dir`` (one sub-folder per input fingerprint, one attempt
folder per write): landing -> cleaning -> analytics.  Later plans read them back, so

* the lineage is cut - losing an executor re-reads Parquet instead of
  re-running the landing derivation and the de-duplication shuffle;
* every analytic keeps column pruning and filter pushdown into the scan, which
  an RDD checkpoint would not give;
* a one-line JSON array (one unsplittable task per file) is read only once.

``materialize=False`` keeps everything as one lazy plan.

``buckets=n`` keeps a second copy of the cleaned articles and labs, bucketed by ``doi`` and
``lab``: results that group by these then shuffle nothing for it.  The copy costs one
shuffle of whole rows, so it is for inputs that many results or sessions read.  A
collection with a key so frequent that its bucket would outgrow the others stays as it is.
"""

from __future__ import annotations

import hashlib
import os
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioscope.operators.articles import articles_dated
from biblioscope.operators.cleaning import (COLLECTION_LABELS, COPIES, clean_with_copies, cleaning_report,
                                            cleaning_report_from_copies)
from biblioscope.session import checkpoint_root
from biblioscope.sources import testdata
from biblioscope.sources.landing import quarantined, read_records, sound, write_json_arrays

# Bump when a landing view rule changes, so stale written tables are not reused.
VIEW_VERSION = "12"
COLLECTIONS = ("articles", "journaux", "authors_labs")
EXPORT_FORMATS = {"articles": "jsonl", "journaux": "json", "authors_labs": "jsonl"}
EXPORT_FILE_RECORDS = 100_000

ATTEMPT = "attempt-"

# Keys of the bucketed copies, and how many times a bucket's fair share of the rows one key may hold.
BUCKET_KEYS = {"articles": "doi", "authors_labs": "lab"}
BUCKET_SHARE = 2

Loader = Callable[[str], DataFrame]


def _file_list_hash(spark: SparkSession, path: str) -> str:
    """Files, bytes and a hash over every file's (path, length, modification time).

    The listing is a Spark scan of file metadata (file contents are pruned), so
    a folder of any number of files is listed and hashed by tasks.
    """
    row = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
           .select(F.xxhash64("path", "length", "modificationTime").alias("h"), "length")
           .agg(F.count("h"), F.sum("length"), F.bit_xor("h")).first())
    return ":".join(str(v) for v in row)


def _input_signature(spark: SparkSession | None, path: str) -> str:
    """Name and state of an input: changes when any file in it is added, removed or rewritten."""
    jvm = getattr(spark, "_jvm", None) if spark is not None else None
    if jvm is not None:
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
        return f"{path}:{_file_list_hash(spark, path) if fs.exists(hpath) else 'missing'}"
    local = path[len("file:"):] if path.startswith("file:") else path
    if not os.path.exists(local):
        return f"{path}:missing"
    files = sorted(os.path.join(root, name)
                   for root, _, names in (os.walk(local) if os.path.isdir(local) else [("", [], [local])])
                   for name in names)
    stats = [(f, os.stat(f)) for f in files]
    return f"{path}:" + ":".join(f"{f}={st.st_size}@{st.st_mtime_ns}" for f, st in stats)


def _fingerprint(spark: SparkSession | None, kind: str, *paths: str) -> str:
    """Hash of the view rules' version and the signature of every input."""
    h = hashlib.sha1(f"{VIEW_VERSION}:{kind}".encode())
    for path in paths:
        h.update(_input_signature(spark, path).encode())
    return h.hexdigest()[:16]


def _latest_attempt(spark: SparkSession, path: str) -> str | None:
    """The newest finished attempt folder of a written table.

    A write goes to a folder of its own, whose ``_SUCCESS`` marker comes last, so
    unfinished or failed writes are never read and no write touches files that
    another application reads.  Names start with the time of the write.
    """
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return None
    names = sorted((f.getPath().getName() for f in fs.listStatus(hpath) if f.isDirectory()), reverse=True)
    for name in names:
        if name.startswith(ATTEMPT) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
            return f"{path}/{name}"
    return None


class Workspace:
    """Landed and cleaned collections of one input."""

    def __init__(self, spark: SparkSession, loader: Loader, key: str, *,
                 materialize: bool = True, land_raw: bool = False,
                 table_root: str | None = None,
                 documents: Callable[[], DataFrame] | None = None,
                 refresh: bool = False, buckets: int | None = None):
        if buckets is not None and (buckets < 1 or not materialize):
            raise ValueError("buckets must be positive, and need written tables")
        self.spark = spark
        self.buckets = buckets
        self.loader = loader
        self.key = key
        self.materialize = materialize
        self.land_raw = land_raw
        self.table_root = table_root
        self._documents = documents
        self.refresh = refresh       # rebuild tables even when a finished copy exists
        self._cache: dict[str, DataFrame] = {}
        # Callers may share a session across threads: one lock per table, so each
        # table is built and written once while different tables build concurrently.
        self._locks: dict[str, threading.RLock] = {}
        self._locks_guard = threading.Lock()

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str, **kw) -> "Workspace":
        sf_dir = sf_dir.rstrip("/")
        tables = [f"{os.path.abspath(sf_dir)}/{t}.parquet" for t in testdata.VIEW_TABLES]
        ws = cls(spark, lambda c: testdata.LANDING_VIEWS[c](spark, sf_dir),
                 _fingerprint(spark, "testdata", *tables), **kw)
        ws._documents = lambda: testdata.documents(spark, sf_dir)
        return ws

    @classmethod
    def from_landing(cls, spark: SparkSession, paths: dict[str, str], fmt: str | dict[str, str] = "jsonl",
                     documents_path: str | None = None, **kw) -> "Workspace":
        """``paths`` maps each of articles / journaux / authors_labs to its landing path.

        ``fmt`` is one format, or one for each collection.
        """
        missing = set(COLLECTIONS) - set(paths)
        if missing:
            raise ValueError(f"landing paths missing for {sorted(missing)}")
        docs = None
        if documents_path:
            docs = lambda: spark.read.parquet(documents_path)
        formats = fmt if isinstance(fmt, dict) else dict.fromkeys(COLLECTIONS, fmt)
        # objects of an array are put together once, not again for every reader
        kw.setdefault("land_raw", "json" in formats.values())
        inputs = [paths[c] for c in COLLECTIONS] + ([documents_path] if documents_path else [])
        return cls(spark, lambda c: read_records(spark, paths[c], c, formats[c]),
                   _fingerprint(spark, repr(sorted(formats.items())), *inputs), documents=docs, **kw)

    @classmethod
    def from_dataframes(cls, spark: SparkSession, frames: dict[str, DataFrame],
                        documents: DataFrame | None = None, dataset: str | None = None,
                        version: str | None = None, **kw) -> "Workspace":
        """Collections that are already DataFrames (landing names, ``_id`` optional).

        DataFrames cannot be fingerprinted, so the workspace stays lazy unless
        the caller names the ``dataset`` and its ``version``; with both, tables are
        written once under that key and the frames' schemas, like any other input.
        """
        missing = set(COLLECTIONS) - set(frames)
        if missing:
            raise ValueError(f"frames missing for {sorted(missing)}")
        if (dataset is None) != (version is None):
            raise ValueError("written tables need both a dataset name and a version")
        kw.setdefault("materialize", version is not None)
        if kw["materialize"] and version is None:
            raise ValueError("written tables need a dataset name and a version")
        schemas = [frames[c].schema.json() for c in COLLECTIONS]
        key = hashlib.sha1(repr((VIEW_VERSION, "frames", dataset, version, schemas)).encode()).hexdigest()[:16]
        return cls(spark, lambda c: frames[c], key,
                   documents=(lambda: documents) if documents is not None else None, **kw)

    def table_path(self, name: str) -> str:
        root = self.table_root or f"{checkpoint_root(self.spark)}/biblioscope-tables"
        return f"{root}/{self.key}/{name}"

    def _lock(self, key: str) -> threading.RLock:
        with self._locks_guard:
            return self._locks.setdefault(key, threading.RLock())

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        found, there = self._attempt(self.table_path(name))
        if not there:
            # zstd: smaller intermediate tables than the default codec, similar decode cost
            df.write.option("compression", "zstd").parquet(found)
        return self.spark.read.parquet(found)

    def _attempt(self, path: str) -> tuple[str, bool]:
        """The folder to read a written table from, or to write it to, and whether it is there."""
        found = None if self.refresh else _latest_attempt(self.spark, path)
        return found or f"{path}/{ATTEMPT}{time.time_ns():020d}-{uuid.uuid4().hex[:8]}", found is not None

    def _bucketed(self, df: DataFrame, collection: str) -> DataFrame:
        """``df``, a written table, by buckets of the collection's key: a catalog table over files of the shared folder."""
        key, n = BUCKET_KEYS[collection], self.buckets
        counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        largest, rows = counts.agg(F.max("n"), F.sum("n")).first()
        # one row per key always fits: such a table has no frequent key, however few its rows
        if rows and largest > max(1, BUCKET_SHARE * rows / n):
            return df
        path, there = self._attempt(self.table_path(f"bucketed-{n}/{collection}"))
        name = f"biblioscope_{self.key}_{collection}_{hashlib.sha1(path.encode()).hexdigest()[:12]}"
        if there:
            self.spark.sql(f"create table if not exists `{name}` ({df.schema.toDDL()}) using parquet "
                           f"clustered by (`{key}`) sorted by (`{key}`) into {n} buckets location '{path}'")
        else:
            # dealt by the bucket's own hash first, so that each bucket is one file
            (df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("compression", "zstd")
             .option("path", path).format("parquet").saveAsTable(name))
        return self.spark.table(name)

    def _shared(self, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        with self._lock(key):
            if key not in self._cache:
                df = build()
                self._cache[key] = self._written(df, key) if self.materialize else df
            return self._cache[key]

    def derived(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table derived from the cleaned ones and shared by several results.

        Written once (when materializing), so those results do not each repeat
        the scans, joins and shuffles that produce it.
        """
        return self._shared("derived/" + name, build)

    def raw(self, collection: str) -> DataFrame:
        """The sound records of the landed collection (landing names, ``_id`` included)."""
        return sound(self.records(collection))

    def quarantine(self) -> DataFrame:
        """(collection, record): the text of every landed record that could not be read."""
        return self.derived("quarantine", lambda: self._each(lambda c: quarantined(self.records(c))))

    def _each(self, rows: Callable[[str], DataFrame]) -> DataFrame:
        """Rows of the three collections under their report labels."""
        out = None
        for c, label in COLLECTION_LABELS.items():
            one = rows(c).select(F.lit(label).alias("collection"), "*")
            out = one if out is None else out.unionByName(one)
        return out

    def landing_report(self) -> DataFrame:
        """Per collection: records landed, quarantined, and rows before and after de-duplication.

        The counts come from written tables: the copies column of the cleaned ones and the quarantine.
        """
        damaged = self.quarantine().groupBy("collection").agg(F.count(F.lit(1)).alias("rows_quarantined"))
        kept = self.cleaning_report()                                  # three rows
        n = F.coalesce("rows_quarantined", F.lit(0))
        return kept.join(damaged, "collection", "left").select(
            "collection", (F.col("rows_before") + n).alias("rows_landed"), n.alias("rows_quarantined"), "rows_before", "rows_after")

    def records(self, collection: str) -> DataFrame:
        """All landed records of a collection, damaged ones (``_damaged``) too."""
        key = "landing/" + collection
        with self._lock(key):
            if key not in self._cache:
                df = self.loader(collection)
                if self.materialize and self.land_raw:
                    df = self._written(df, key)
                self._cache[key] = df
            return self._cache[key]

    def raw_all(self) -> dict[str, DataFrame]:
        return {c: self.raw(c) for c in COLLECTIONS}

    def cleaned(self, collection: str) -> DataFrame:
        """Cleaned collection; articles also carry their parsed dates.

        Dates are parsed once here, as the original tool does at start-up, so
        no result re-runs the regular-expression cascade.
        """
        return self.cleaned_with_copies(collection).drop(COPIES)

    def cleaned_with_copies(self, collection: str) -> DataFrame:
        """Cleaned rows plus ``_copies`` (landing rows per clean row), written once."""
        with self._lock(collection):
            if collection not in self._cache:
                df = clean_with_copies(self.raw(collection), collection)
                if collection == "articles":
                    df = articles_dated(df)
                if self.materialize:
                    df = self._written(df, collection)
                    if self.buckets and collection in BUCKET_KEYS:
                        df = self._bucketed(df, collection)
                self._cache[collection] = df
            return self._cache[collection]

    def cleaning_report(self) -> DataFrame:
        """Rows before/after de-duplication per collection.

        Read from the written cleaned tables (a scan of one small column); without
        materialization, computed from the landing rows.
        """
        if self.materialize:
            return cleaning_report_from_copies({c: self.cleaned_with_copies(c) for c in COLLECTIONS})
        return cleaning_report(self.spark, self.raw_all())

    def export(self, collection: str) -> str:
        """Path of the collection's export, written once: its documents, some of them damaged (``testdata``)."""
        path = self.table_path(f"export/{collection}")
        with self._lock("export/" + collection):
            found = None if self.refresh else _latest_attempt(self.spark, path)
            if found is None:
                found = f"{path}/{ATTEMPT}{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
                documents = testdata.exported(self.loader(collection), collection)
                if EXPORT_FORMATS[collection] == "json":
                    write_json_arrays(documents, found)
                else:
                    # a compressed file is read by one task: no file gets more than some records
                    (documents.write.option("compression", "gzip")
                     .option("maxRecordsPerFile", EXPORT_FILE_RECORDS).text(found))
            return found

    def articles(self) -> DataFrame:
        return self.cleaned("articles")

    def journals(self) -> DataFrame:
        return self.cleaned("journaux")

    def authors_labs(self) -> DataFrame:
        return self.cleaned("authors_labs")

    def documents(self) -> DataFrame:
        if self._documents is None:
            raise ValueError("this workspace has no documents table")
        return self._documents()

    def prepare(self) -> "Workspace":
        """Build every table now; independent tables are built by concurrent jobs."""
        steps = [lambda c=c: self.cleaned(c) for c in COLLECTIONS]
        if self._documents is not None:
            steps.append(self.documents)
        with ThreadPoolExecutor(max_workers=len(steps)) as pool:
            for f in [pool.submit(step) for step in steps]:
                f.result()
        return self


def spread_small_scan(df: DataFrame) -> DataFrame:
    """``df``, a scan, dealt anew where it has fewer splits than the session has cores.

    Such a scan is small (a split is at least some megabytes unless cores are idle), and
    one row group may hold all its rows; a larger scan is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_WORKSPACES: dict[tuple[int, str, str, bool], Workspace] = {}
_WORKSPACES_LOCK = threading.Lock()


def _session_key(spark: SparkSession) -> tuple[int, str]:
    # The application id changes when a stopped context is replaced.
    return id(spark), spark.sparkContext.applicationId


def workspace(spark: SparkSession, sf_dir: str, materialize: bool = True) -> Workspace:
    """One test-table workspace per (session, folder), so cleaning runs once."""
    key = (*_session_key(spark), os.path.abspath(sf_dir), materialize)
    with _WORKSPACES_LOCK:
        if key not in _WORKSPACES:
            _WORKSPACES[key] = Workspace.from_testdata(spark, sf_dir, materialize=materialize)
        return _WORKSPACES[key]


def landed_workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The test collections exported as files - JSON lines, journals as JSON arrays, some records
    damaged on the way - and landed again from there."""
    base = workspace(spark, sf_dir)
    with base._lock("landed"):
        if "landed" not in base.__dict__:
            paths = {c: base.export(c) for c in COLLECTIONS}
            base.landed = Workspace.from_landing(spark, paths, EXPORT_FORMATS, table_root=base.table_root)
        return base.landed


def register_workspace(ws: Workspace, sf_dir: str) -> Workspace:
    """Make ``ws`` the one ``workspace(spark, sf_dir)`` returns."""
    _WORKSPACES[(*_session_key(ws.spark), os.path.abspath(sf_dir), ws.materialize)] = ws
    return ws
