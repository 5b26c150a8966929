"""Importance resampling towards a target text: which documents look like the target.

A tokenizers pre-tokeniser, an untrained Regex Split over the ASCII-lowered text,
gives each text's words with their offsets.  A feature is a run of 1 to ``LONGEST``
words, found as a pair of offsets (first word's start, last word's end), its words
joined by one space; its bucket is the CRC-32 of its UTF-8 bytes modulo ``BUCKETS``.
Buckets are written once a document; the histograms of all documents and of the target
texts follow from them, with at most ``BUCKETS`` rows, and so does each bucket's gain:
the floor of 1000 times the log ratio of its smoothed shares in target and documents.

A document's weight is the sum of its features' gains; its score adds Gumbel noise that
a hash of its id seeds, so the highest scores are a draw without replacement.  Of all
documents with at least ``MIN_WORDS`` words the top ``PERCENT`` per cent are drawn and
ranked (``ranks.ranked``: no window over all rows).

Long texts are cut at characters that no word holds into pieces of ``PIECE_CHARS`` (the
last words of a piece begin the next one's runs), which bounds what the library holds.

Defined results: a null text is an empty text: no feature, weight 0, never drawn while
``MIN_WORDS`` is above 0; a null id is hashed as ``null`` and stands after all others among
ties; rows of one id share its noise; ties go to the smaller id, then to fewer
features; equal rows take following ranks; an empty table gives an empty result; without
target texts all gains come from smoothing alone; other columns of the inputs are not
carried, so their names cannot clash.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioscope.llm.merkle import crc32_sql
from biblioscope.llm.ranks import ranked
from biblioscope.llm.tables import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGEST = 1
BUCKETS = 10_000
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
PIECE_CHARS = 1 << 16
KNOWN = 100_000             # distinct features whose bucket a task remembers
GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")

FEATURES = "doc_id long, n_words long, buckets array<int>"


def _cut(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about ``limit`` characters, cut where no word is cut."""
    at = 0
    while len(text) - at > limit:
        gap = GAP.search(text, at + limit)
        if gap is None:
            break
        yield text[at:gap.start()]
        at = gap.start()
    yield text[at:]


class _Buckets:
    """Buckets of a text's features, by offset pairs of its words."""

    def __init__(self, longest: int, buckets: int):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split = Split(Regex(WORD), "removed", invert=True)
        self.longest, self.buckets, self.known = longest, buckets, {}

    def of(self, text: str) -> tuple[int, np.ndarray]:
        """Number of words, and the bucket of every feature, of an ASCII-lowered text."""
        out, n_words, held = [np.zeros(0, np.int32)], 0, []
        for piece in _cut(text):
            words = self.split.pre_tokenize_str(piece)
            n_words += len(words)
            if self.longest == 1:
                out.append(np.fromiter((self._bucket(w) for w, _ in words), np.int32, len(words)))
                continue
            # words held from the piece before, with their offsets in one string of both
            joined = " ".join(held)
            shift = len(joined) + 1 if held else 0
            spans, at = [], 0
            for w in held:
                spans.append((at, at + len(w)))
                at += len(w) + 1
            both = f"{joined} {piece}" if held else piece
            fresh = len(spans)
            spans += [(a + shift, b + shift) for _, (a, b) in words]
            found = [self._bucket(" ".join(both[a:b] for a, b in spans[j - n + 1:j + 1]))
                     for j in range(fresh, len(spans)) for n in range(1, min(self.longest, j + 1) + 1)]
            out.append(np.array(found, np.int32))
            held = [both[a:b] for a, b in spans[-(self.longest - 1):]]
        return n_words, np.concatenate(out)

    def _bucket(self, feature: str) -> int:
        b = self.known.get(feature)
        if b is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            b = self.known[feature] = crc32(feature.encode()) % self.buckets
        return b


def features(texts: DataFrame, id_col: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words and the buckets of all features of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made = _Buckets(longest, buckets)
        for batch in batches:
            ids, n_words, found, size, start = batch.column(0), [], [], 0, 0
            for i, text in enumerate(pc.ascii_lower(pc.fill_null(batch.column(1), ""))):
                n, b = made.of(text.as_py())
                n_words.append(n)
                found.append(b)
                size += len(b)
                if size >= 1 << 20 or i == batch.num_rows - 1:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(start, i + 1 - start), pa.array(n_words, pa.int64()),
                         pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))], names=["doc_id", "n_words", "buckets"])
                    n_words, found, size, start = [], [], 0, i + 1

    return texts.select(F.col(id_col).cast("long"), F.col("text").cast("string")).mapInArrow(run, FEATURES)


def histogram(made: DataFrame, name: str) -> DataFrame:
    """Features a bucket; counted map-side, at most ``BUCKETS`` rows."""
    return made.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket; ``docs`` and ``target`` are written feature tables."""
    both = (docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
            .join(histogram(docs, "s"), "bucket", "left").join(histogram(target, "t"), "bucket", "left").fillna(0))
    counts = both.orderBy("bucket").select("s", "t").collect()             # ``buckets`` rows, whatever the input
    s, t = (np.array([r[c] for r in counts], np.float64) for c in ("s", "t"))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(made: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight: the sum of the gains of a row's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            total = np.zeros(int(offsets[-1] - offsets[0]) + 1, np.int64)
            np.cumsum(gain[lists.values.to_numpy()[offsets[0]:offsets[-1]]], out=total[1:])
            at = offsets - offsets[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at)), pa.array(total[at[1:]] - total[at[:-1]])],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return made.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, target_id: str = "item_id", longest: int = LONGEST, buckets: int = BUCKETS,
             percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document."""
    made = written(features(docs, "doc_id", longest, buckets), "features")
    aimed = written(features(target, target_id, longest, buckets), "target")
    scored = weighed(made, gains(made, aimed, buckets)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = written(scored.withColumn("key", F.lit(0)), "scored")
    fit = written(scored.where(F.col("n_words") >= min_words), "fit")
    drawn = percent * fit.count() // 100
    placed = ranked(fit, "key", [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")])
    columns = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("long").alias("rank")
    unfit = scored.where(F.col("n_words") < min_words)
    return placed.select(*columns, rank).unionByName(unfit.select(*columns, F.lit(None).cast("long").alias("rank")))


def _words_sql(text: str) -> str:
    lowered = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lowered}, '{WORD}')"


ORACLE = f"""
with docs as materialized (select row_number() over () as r, doc_id, {_words_sql("text")} as words from documents),
d as materialized (select r, word, count(*) as n from (select r, unnest(words) as word from docs) group by r, word),
b as materialized (select word, count(*) as n from (select unnest({_words_sql("text")}) as word from benchmark) group by word),
bucket as materialized (select word, {crc32_sql("word")} % {BUCKETS} as bucket
                        from (select word from d union select word from b)),
s as (select bucket, sum(n)::double as s from d join bucket using (word) group by bucket),
t as (select bucket, sum(n)::double as t from b join bucket using (word) group by bucket),
counts as (select i as bucket, coalesce(s, 0) as s, coalesce(t, 0) as t
           from range({BUCKETS}) x(i) left join s on s.bucket = i left join t on t.bucket = i),
gain as materialized (
  select bucket, floor(1000 * ln((t + 1) * (sum(s) over () + {BUCKETS}) / ((s + 1) * (sum(t) over () + {BUCKETS}))))::bigint as gain
  from counts),
weight as (select r, sum(n * gain)::bigint as weight from d join bucket using (word) join gain using (bucket) group by r),
scored as materialized (
  select doc_id, len(words)::bigint as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint + 0.5::double)
                                                    / 4294967296.0::double)))::bigint as score
  from docs left join weight using (r)),
fit as (select *, row_number() over (order by score desc, doc_id nulls last, n_features) as place, count(*) over () as fit
        from scored where n_features >= {MIN_WORDS})
select doc_id, n_features, weight, score, case when place <= {PERCENT} * fit // 100 then place end as rank from fit
union all
select doc_id, n_features, weight, score, null as rank from scored where n_features < {MIN_WORDS}
"""
