"""Quality classifier by importance resampling.

Texts are bags of hashed word uni- and bigrams.  Two generative models are counted:
*raw* from all documents, *target* from labelled good ones.  A document's log weight
is the sum over its n-grams of log(p_target / p_raw); Gumbel noise, a hash of the
document id, is added, and the ``k`` documents of highest value are the sample.

The target model is smoothed towards the raw one (``PRIOR`` pseudo counts a bucket),
so an n-gram that the labelled rows say nothing about weighs nothing.  ``k`` is the
share of good rows among the labelled ones times the number of documents.

Bounds: ``max_labelled`` labelled rows (those of smallest id hash) and ``BUCKETS``
counts reach the driver; counts and scores cover all rows and whole texts.  The
threshold of the top ``k`` is narrowed by histograms of ``BINS`` rows, and ties at
it are settled by id, so no task holds more than its share.

Defined results: a null text is an empty text, its log weight 0; rows equal in id
and text are one document to the sampler, kept or rejected together; without
labelled good rows or with an empty table, everything is kept.  Only id and text
are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioscope.llm import textnp as T
from biblioscope.llm.tables import text_key, without, written

BUCKETS = 1 << 18
PRIOR = 2.0
MAX_LABELLED = 50_000
BINS = 4096
SEED = 17


def _grams(piece: T.Piece) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each uni- and bigram."""
    w = T.words(piece, lower=True)
    at, two = T.windows(w, 2)
    mask = T.U64(BUCKETS - 1)
    return (np.concatenate([w.row, w.row[at]]),
            np.concatenate([w.hash & mask, two & mask]).astype(np.int64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of a task: all its rows, and its good rows."""
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        flag = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
        for piece in T.pieces(batch.column(0)):
            row, bucket = _grams(piece)
            raw += np.bincount(bucket, minlength=BUCKETS)
            if flag[piece.first:piece.first + piece.rows].any():
                good += np.bincount(bucket[flag[piece.first + row]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])


def log_ratios(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """log(p_target / p_raw) of each bucket; zeros when there is no target."""
    if not good.sum() or not raw.sum():
        return np.zeros(len(raw))
    expected = raw / raw.sum() * good.sum()
    return np.log((good + PRIOR) / (expected + PRIOR))


def labelled_sample(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """At most ``max_labelled`` rows (doc_id, good): a limit is their proven bound."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    one = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
           .groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min(good).alias("good")))
    return one.orderBy(F.xxhash64("label_id", F.lit(SEED)), "label_id").limit(max_labelled)


def gumbel(id_col: F.Column, text: F.Column) -> F.Column:
    """Standard Gumbel noise, a fixed function of the row."""
    bits = F.pmod(F.xxhash64(id_col, text, F.lit(SEED)), F.lit(1 << 52)).cast("double")
    return -F.log(-F.log((bits + 0.5) / float(1 << 52)))


def kth_largest(scores: DataFrame, key: str, k: int) -> tuple[float, int]:
    """The value of the k-th largest ``key`` and how many rows lie above it.

    Histograms of ``BINS`` bins narrow the interval until it holds one value.
    """
    low, high = scores.agg(F.min(key), F.max(key)).first()
    above = 0
    while low < high:
        width = (high - low) / BINS
        if width <= 0 or low + width <= low:
            break
        edge = F.least(F.floor((F.col(key) - low) / width), F.lit(BINS - 1))
        bins = (scores.where(F.col(key).between(low, high)).groupBy(edge.alias("bin"))
                .agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
                .orderBy(F.desc("bin")).collect())
        for b in bins:
            if above + b["n"] >= k:
                low, high = b["lo"], b["hi"]
                break
            above += b["n"]
    return low, above


def resample(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED,
             share: float | None = None) -> DataFrame:
    """One row per document: log_weight, gumbel_key, kept."""
    return verdicts(docs, labels, max_labelled, share).drop("text_key")


def verdicts(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED,
             share: float | None = None) -> DataFrame:
    """``resample`` with the ``text_key`` that tells texts of one id apart."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sample = labelled_sample(labels, max_labelled)
    known = sample.agg(F.count(F.lit(1)), F.sum(F.col("good").cast("long"))).first()
    if share is None:
        share = (known[1] or 0) / known[0] if known[0] and known[1] else 1.0
    marked = (texts.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"), "left")
              .select("text", F.coalesce("good", F.lit(False)).alias("good")))
    counts = (marked.mapInArrow(_count, "bucket long, raw long, good long")
              .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas())
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    raw[counts["bucket"]], good[counts["bucket"]] = counts["raw"], counts["good"]
    model = spark.sparkContext.broadcast(log_ratios(raw, good))     # BUCKETS doubles

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = model.value
        for batch in batches:
            for piece in T.pieces(batch.column(1)):
                row, bucket = _grams(piece)
                weight = np.bincount(row, ratio[bucket], piece.rows)
                part = batch.slice(piece.first, piece.rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(weight), part.column(3)],
                                                 names=["doc_id", "noise", "log_weight", "text_key"])

    scored = (texts.select("doc_id", "text", gumbel(F.col("doc_id"), F.col("text")).alias("noise"),
                           text_key(F.col("text")).alias("text_key"))
              .mapInArrow(score, "doc_id long, noise double, log_weight double, text_key long"))
    scored = written(scored.withColumn("gumbel_key", F.col("log_weight") + F.col("noise")), "scores")
    n = scored.count()
    k = round(share * n)
    if n == 0 or k >= n:
        return scored.withColumn("kept", F.lit(True))
    if k <= 0:
        return scored.withColumn("kept", F.lit(False))
    value, above = kth_largest(scored, "gumbel_key", k)
    tied = scored.where(F.col("gumbel_key") == value)
    if tied.count() == k - above:
        return scored.withColumn("kept", F.col("gumbel_key") >= value)
    # Of equal keys the smallest ids stay; rows equal in id as well stay together.
    last, _ = kth_largest(tied.select((-F.col("doc_id").cast("double")).alias("neg")).na.fill(float("inf")), "neg", k - above)
    own = F.coalesce(-F.col("doc_id").cast("double"), F.lit(float("inf")))
    return scored.withColumn("kept", (F.col("gumbel_key") > value) | ((F.col("gumbel_key") == value) & (own >= last)))


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``docs`` without the rejected rows; a row is its id and text, so other texts of its id stand on their own."""
    return without(docs, verdicts(docs, labels, max_labelled).where("not kept"))
