"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the ``K`` smallest distinct hashes (``HASH_BYTES`` bytes each) of a
text's word shingles, in ascending order.  Sketches of parts merge into the sketch of
the whole.  From two sketches follow the resemblance (share of the ``K`` smallest of
the union that both hold), the containment of one set in the other, and the number
of distinct shingles; all three are exact while the sets have at most ``K`` shingles.

As text a sketch is URL-safe base64 of its hashes.

Defined results: a null text is an empty text; a text of fewer words than a shingle
has its whole word sequence as one shingle; an empty text has the empty sketch, which
is like another empty sketch (1) and unlike any other (0).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioscope.llm import textnp as T
from biblioscope.llm.tables import parts

K = 128
HASH_BYTES = 6
SHINGLE = 5
SPACE = float(1 << (8 * HASH_BYTES))


def sketches(texts: pa.Array, k: int = K, n: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of each text of an Arrow column."""
    out = []
    for piece in T.pieces(texts):
        row, h = T.shingles(T.words(piece), n)
        h, at = T.distinct_sets(row, h >> T.U64(64 - 8 * HASH_BYTES), piece.rows)
        out += [h[a:min(b, a + k)] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def merge(*parts_of_text: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of a union, from the sketches of its parts."""
    return np.unique(np.concatenate(parts_of_text))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k=k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, union, assume_unique=True).sum() / len(union))


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Number of distinct shingles; exact below ``k``, else from the k-th smallest hash."""
    return float(len(a)) if len(a) < k else (k - 1) * SPACE / (float(a[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first set that the second holds too."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k=k), k)
    return min(1.0, shared / distinct_shingles(a, k))


def to_text(a: np.ndarray) -> str:
    raw = a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES:]
    return base64.urlsafe_b64encode(raw.tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.urlsafe_b64decode(s), np.uint8).reshape(-1, HASH_BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - HASH_BYTES:] = raw
    return wide.view(">u8").ravel().astype(T.U64)


def fingerprint(docs: DataFrame, k: int = K, n: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint and the estimated number of distinct shingles of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = sketches(b.column(1), k, n)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(to_text, found), pa.string()),
                 pa.array([distinct_shingles(a, k) for a in found], pa.float64())],
                names=["doc_id", "fingerprint", "n_distinct"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, fingerprint string, n_distinct double"))


# --- every document against an edited copy and against its successor ---------

PAIRS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
         "near_edited double, near_next double, contained_in_edited double, n_distinct double")


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by (slot, order); a guard row only closes the slot before it."""
    held = None          # (slot, doc_id, text) whose successor is still to come
    for batch in batches:
        slots, guards, ids, texts = (batch.column(i).to_pylist() for i in range(4))
        pairs = []
        for slot, guard, doc_id, text in zip(slots, guards, ids, texts, strict=True):
            if held is not None:
                pairs.append((*held, text))
                held = None
            if not guard:
                held = (doc_id, text)
        size, start = 0, 0
        for i, p in enumerate(pairs):
            size += len(p[1])
            if size > T.PIECE_BYTES or i == len(pairs) - 1:
                yield _rows(pairs[start:i + 1])
                size, start = 0, i + 1


def _rows(pairs: list[tuple]) -> pa.RecordBatch:
    """One output row for each (doc_id, text, next text)."""
    edits = [_edited(text, following) for _, text, following in pairs]
    own = sketches(pa.array([text for _, text, _ in pairs], pa.large_string()))
    # Each text is the successor of the row before it, so only the last one is new.
    chained = all(pairs[i][2] is pairs[i + 1][1] for i in range(len(pairs) - 1))
    following = (own[1:] + sketches(pa.array([pairs[-1][2]], pa.large_string())) if chained
                 else sketches(pa.array([x for _, _, x in pairs], pa.large_string())))
    edited = sketches(pa.array(edits, pa.large_string()))
    columns = [
        pa.array([i for i, _, _ in pairs], pa.int64()),
        pa.array([len(text) for _, text, _ in pairs], pa.int64()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edits], pa.string()),
        pa.array(map(to_text, own), pa.string()),
        pa.array(map(to_text, edited), pa.string()),
        pa.array(map(resemblance, own, edited), pa.float64()),
        pa.array(map(resemblance, own, following), pa.float64()),
        pa.array(map(containment, own, edited), pa.float64()),
        pa.array(map(distinct_shingles, own), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PAIRS.split(", ")])


LOWEST = -(1 << 63)


def _cuts_upto(cuts: list[int], key: F.Column, strict: bool) -> F.Column:
    """How many of the sorted ``cuts`` lie at or below (strictly below) ``key``: a binary search."""
    if not cuts:
        return F.lit(0)
    table = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])

    def step(at, jump):
        cut = F.get(table, at + jump - 1)
        return F.when((at + jump <= len(cuts)) & (cut < key if strict else cut <= key), at + jump).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _slot(cuts: list[int]) -> F.Column:
    """Slot of a row, rising with (k, h).  An id that takes several quantiles alone is split by ``h``."""
    upto, below = _cuts_upto(cuts, F.col("k"), False), _cuts_upto(cuts, F.col("k"), True)
    own = upto - below
    share = F.floor((F.col("h").cast("double") / 2.0 ** 64 + 0.5) * own)
    return F.when(own == 0, upto).otherwise(below + 1 + F.least(share, own - 1)).cast("int")


def compare_with_next(docs: DataFrame, slots: int | None = None) -> DataFrame:
    """Each text against its edited copy and the next text by (doc_id, text hash, text).

    The edited copy's last half of code points is replaced by the first as many of
    the next document.  Documents are dealt to ``slots`` by ranges of ``doc_id``
    whose bounds come from a bounded quantile sketch, so each slot is one sorted
    pass.  The first document of a slot goes to the slot before it as well, as the
    successor of that slot's last one; the first of all also ends the last slot.
    Null ids stand first.  An id of many rows is dealt on by the text hash.  A text
    alone in the table is its own successor.
    """
    spark = docs.sparkSession
    n = slots or parts(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(LOWEST)).alias("k"), F.xxhash64("text").alias("h"))
    cuts = rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    placed = rows.withColumn("slot", _slot(sorted(cuts or [])))
    firsts = (placed.groupBy("slot").agg(F.min(F.struct("k", "h")).alias("place"))
              .orderBy("slot").collect())                                  # at most ``n`` rows
    guards = spark.createDataFrame([(f["place"]["k"], f["place"]["h"], firsts[i - 1]["slot"]) for i, f in enumerate(firsts)],
                                   "guard_k long, guard_h long, before int")
    dealt = (placed.join(F.broadcast(guards), (F.col("k") == F.col("guard_k")) & (F.col("h") == F.col("guard_h")), "left")
             .withColumn("place", F.explode(F.array_compact(F.array(
                 F.struct(F.col("slot").alias("to"), F.lit(False).alias("guard")),
                 F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("to"), F.lit(True).alias("guard")))))))
             .select("place.to", "place.guard", "doc_id", "text", "k", "h"))
    ordered = dealt.repartitionById(n, F.col("to")).sortWithinPartitions("to", "guard", "k", "h", "text")
    return ordered.select("to", "guard", "doc_id", "text").mapInArrow(_compare, PAIRS)
