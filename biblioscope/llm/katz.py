"""Language model scoring: Katz backoff over words.

Tokens are a text's words (A-Z lower-cased), then one end token; the first token's
history is a start symbol.  The model has order two and is evaluated from the bigram
down: a bigram seen ``least`` times or more has its Good-Turing discounted share
of its history, any other one the history's backoff weight times the unigram
probability, and a word not in training the probability that discounting left over.

    p(v|u) = d(c) c(u,v) / (c(u) + 1)       if c(u,v) >= least
           = a(u) p(v)                       else
    p(v)   = d1(c) c(v) / N, or the rest of the unigram mass for an unknown word

``least`` is 1 unless a caller asks for a pruned model: every bigram of the training
folds counts, those seen once with the share that d(1) leaves them.

a(u) makes every history's probabilities sum to exactly one.  The pseudo count in
c(u) + 1 keeps mass for backoff where every follower of u is too frequent to be
discounted.  Discounts follow Katz: counts up to 5 (fewer where the counts of counts
don't allow it), all others undiscounted.

Nothing of the model is held in one place.  Each block of documents sends its
distinct words and bigrams with their training counts to buckets of the key space
and gets totals back; counts of counts are the only numbers that reach the driver.
Then each block sends the mass of the bigrams that it was told to speak for, and how
often each of its documents backs off from each history, to the buckets of the
histories, which hold the backoff weights and answer with each document's sum.

``katz_tables`` stores the same model, and those of other orders, as tables partitioned
by bucket and evaluates a text from them token by token.

Defined results: a null text is an empty text (one end token); a null id counts as an
empty text when folds are dealt, so its row trains; repeated rows count as often as they stand; with no training token the
unknown word has probability one; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioscope.llm import blocks as B
from biblioscope.llm import textnp as T
from biblioscope.llm.tables import parts, written

# Every block has a message for every bucket, so few large ones keep their number down: bytes of text
BLOCK_TEXT = 3 << 20        # of a block
BUCKET_TEXT = 8 << 20       # whose distinct n-grams make a bucket
LARGEST = 5                 # counts up to this are discounted
FOLDS, HELD_OUT = 7, 2
START, END = T.U64(0x5BD1E995A3C59AC3), T.U64(0x27D4EB2F165667C5)
BIGRAM_BITS = 48            # of a bigram's hash; one in 2**48 / (distinct bigrams) collides
UNI, BI, STATS, DOCS, SUMS = 1, 2, 9, 3, 4

SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(ids: pa.Array) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids.to_pylist()], bool)


class Tokens:
    """Tokens of a block with histories, and its distinct words and bigrams in key order."""

    def __init__(self, ids: pa.Array, texts: list[pa.Array]):
        words, count = B.block_words(texts, lower=True)
        self.docs, self.ids, self.held = len(count), ids, held_out(ids)
        self.first = np.concatenate([[0], np.cumsum(count + 1)])[:-1]
        self.length = count + 1
        total = int(self.length.sum())
        token = np.full(total, END)
        inside = np.ones(total, bool)
        inside[self.first + count] = False
        token[inside] = words
        history = np.empty(total, T.U64)
        history[1:] = token[:-1]
        history[self.first] = START
        self.doc = np.repeat(np.arange(self.docs), self.length)
        both = (T.mix(history * T.MULT + token) >> T.U64(64 - BIGRAM_BITS)) << T.U64(64 - BIGRAM_BITS)
        self.words, self.word = np.unique(token, return_inverse=True)
        self.pairs, at, self.pair = np.unique(both, return_index=True, return_inverse=True)
        self.histories, self.history = np.unique(history, return_inverse=True)
        self.pair_word, self.pair_history = self.word[at], self.history[at]
        # the words' totals answer for histories too: a history's place among the words (-1: start)
        place = np.minimum(np.searchsorted(self.words, self.histories), max(len(self.words) - 1, 0))
        self.history_word = np.where(self.words[place] == self.histories, place, -1) if total else place

    def trained(self, index: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(index[~self.held[self.doc]], minlength=n)


def _ask(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in B.whole_blocks(batches, BLOCK_TEXT):
            t = Tokens(ids, texts)
            for kind, keys, n in ((UNI, t.words, t.trained(t.word, len(t.words))), (BI, t.pairs, t.trained(t.pair, len(t.pairs)))):
                at = B.cut(keys, buckets)
                yield B.rows([{"block": block, "kind": kind, "bucket": i, "seq": 0, "a": T.plane_bytes(keys[at[i]:at[i + 1]]),
                               "b": B.ints(n[at[i]:at[i + 1]])} for i in np.flatnonzero(np.diff(at)).tolist()])
    return run


def _read(batches: Iterator[pa.RecordBatch]) -> list[dict]:
    out = []
    for batch in batches:
        out += batch.select(["block", "kind", "bucket", "a", "b", "c", "d"]).to_pylist()
    return sorted(out, key=lambda r: (r["kind"], r["block"]))


def _totals(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[dict]:
    """One bucket: training totals of its words and bigrams, in each block's order.

    A bigram's answer is twice its total (0 below ``least``), plus 1 for the first
    block that holds it, which speaks for it when masses are summed.
    """
    asked = _read(batches)
    stats = np.zeros((2, LARGEST + 4), np.int64)
    for kind in (UNI, BI):
        own = [r for r in asked if r["kind"] == kind]
        if not own:
            continue
        keys = [T.from_planes(r.pop("a")) for r in own]
        size = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        keys = np.concatenate(keys)
        uniq, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        del keys
        n = np.bincount(inverse, np.concatenate([B.from_ints(r.pop("b")) for r in own]), len(uniq)).astype(np.int64)
        s = stats[kind - 1]
        s[:LARGEST + 1] = np.bincount(n[n <= LARGEST + 1], minlength=LARGEST + 2)[1:]
        s[LARGEST + 1], s[LARGEST + 2] = (n > 0).sum(), n.sum()
        value = n[inverse]
        if kind == BI:
            value = np.where(value >= least, 2 * value, 0)
            value[first] += n[inverse[first]] >= least
        for r, i, j in zip(own, size[:-1], size[1:], strict=True):
            yield {"block": r["block"], "kind": kind, "bucket": r["bucket"], "seq": 0,
                   "a": np.ascontiguousarray(value[i:j].astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()}
    if asked:
        yield {"block": -1, "kind": STATS, "bucket": asked[0]["bucket"], "seq": 0, "a": stats.astype("<i8").tobytes()}


def _values(answers: list[dict]) -> np.ndarray:
    """The answers of all buckets, in key order."""
    flat = [np.ascontiguousarray(np.frombuffer(r["a"], np.uint8).reshape(8, -1).T).view("<i8").ravel()
            for r in sorted(answers, key=lambda r: r["bucket"])]
    return np.concatenate(flat) if flat else np.zeros(0, np.int64)


def discounts(counts_of_counts: list[int], least: int = 1) -> np.ndarray:
    """d[r] for r = 0..LARGEST+1 by Katz's rule, 1 for larger counts.

    The largest k <= LARGEST is taken for which all d[1..k] lie in (0, 1].
    """
    n = [0, *counts_of_counts]
    for k in range(LARGEST, 0, -1):
        if n[1] <= 0 or min(n[1:k + 1]) <= 0:
            continue
        a = (k + 1) * n[k + 1] / n[1]
        if a >= 1:
            continue
        d = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, k + 1)]
        if all(0 < x <= 1 for x in d) and any(x < 1 for x in d):
            return np.array([1.0, *d, *[1.0] * (LARGEST + 1 - k)])
    return np.ones(LARGEST + 2)


class Model:
    """Numbers of a few bytes that every task needs: sizes, discounts, the unknown word's probability."""

    def __init__(self, stats: np.ndarray):
        uni, bi = stats
        self.tokens, self.types = int(uni[LARGEST + 2]), int(uni[LARGEST + 1])
        self.d1, self.d2 = discounts(uni[:LARGEST + 1].tolist()), discounts(bi[:LARGEST + 1].tolist())
        r = np.arange(1, LARGEST + 2)
        left = float((uni[:LARGEST + 1] * r * (1 - self.d1[1:])).sum())
        # without a usable discount one pseudo token stands for the unknown word
        self.size = self.tokens if left > 0 else self.tokens + 1
        self.unknown = (left if left > 0 else 1.0) / max(self.size, 1)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        seen = self.d1[np.minimum(c, LARGEST + 1)] * c / max(self.size, 1)
        return np.where(c > 0, seen, self.unknown)

    def share(self, c: np.ndarray, history: np.ndarray) -> np.ndarray:
        """Probability of kept bigrams."""
        return self.d2[np.minimum(c, LARGEST + 1)] * c / (history + 1.0)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.tokens + 1.0 * (self.types + 1)))


def _score(model: Model, starts: int, buckets: int):
    """Blocks with their totals: what is known of each document, and what is asked of the histories."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts, answers in B.met_blocks(batches):
            t = Tokens(ids, texts)
            c, pair = _values(answers.get(UNI, [])), _values(answers.get(BI, []))
            p, base = model.unigram(c), model.base(c)
            history = np.where(t.history_word >= 0, c[t.history_word], starts)
            kept, speaks = pair >> 1, (pair & 1) == 1
            share = model.share(kept, history[t.pair_history])
            token_kept = kept[t.pair] > 0
            known = np.where(token_kept, np.log10(np.where(kept > 0, share, 1.0))[t.pair], np.log10(p)[t.word])
            n_known = np.bincount(t.doc[c[t.word] > 0], minlength=t.docs)
            docs = np.stack([t.length, n_known, t.held]).astype("<i8")
            sums = np.stack([np.bincount(t.doc, base[t.word], t.docs), np.bincount(t.doc, known, t.docs)]).astype("<f8")
            valid = np.array([i is not None for i in ids.to_pylist()], np.uint8)
            yield B.rows([{"block": block, "kind": DOCS, "bucket": block % buckets, "seq": 0, "a": docs.tobytes(), "b": sums.tobytes(),
                           "c": ids.fill_null(0).to_numpy().astype("<i8").tobytes(), "d": valid.tobytes()}])
            h = len(t.histories)
            mass = np.bincount(t.pair_history[speaks], share[speaks], h)
            covered = np.bincount(t.pair_history[speaks], p[t.pair_word[speaks]], h)
            # (history, document) with the number of tokens that back off
            code = t.history[~token_kept].astype(np.int64) * max(t.docs, 1) + t.doc[~token_kept]
            code, times = np.unique(code, return_counts=True)
            at_history, at_doc = code // max(t.docs, 1), code % max(t.docs, 1)
            per = np.bincount(at_history, minlength=h)
            at, cut = np.concatenate([[0], np.cumsum(per)]), B.cut(t.histories, buckets)
            out = []
            for i in np.flatnonzero(np.diff(cut)).tolist():
                a, b = cut[i], cut[i + 1]
                x, y = at[a], at[b]
                out.append({"block": block, "kind": SUMS, "bucket": i, "seq": 0, "a": T.plane_bytes(t.histories[a:b]),
                            "b": np.stack([mass[a:b], covered[a:b]]).astype("<f8").tobytes(), "c": B.ints(per[a:b]),
                            "d": B.ints(np.concatenate([at_doc[x:y], times[x:y]]))})
            if out:
                yield B.rows(out)
    return run


def _back_off(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One bucket of histories: their weights, and each document's sum of their logarithms."""
    asked = _read(batches)
    for r in asked:
        if r["kind"] == DOCS:
            yield r | {"seq": 0}
    own = [r for r in asked if r["kind"] == SUMS]
    if not own:
        return
    keys = [T.from_planes(r["a"]) for r in own]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    mass, covered = (np.bincount(inverse, np.concatenate([np.frombuffer(r["b"], "<f8").reshape(2, -1)[i] for r in own])) for i in (0, 1))
    weight = np.log10((1.0 - mass) / np.maximum(1.0 - covered, 1e-300))
    size = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    for r, i, j in zip(own, size[:-1], size[1:], strict=True):
        per, flat = B.from_ints(r["c"]), B.from_ints(r["d"])
        doc, times = flat.reshape(2, -1)
        if len(doc):
            each = np.repeat(weight[inverse[i:j]], per) * times
            uniq, at = np.unique(doc, return_inverse=True)
            yield {"block": r["block"], "kind": SUMS, "bucket": r["bucket"], "seq": 0, "a": uniq.astype("<i4").tobytes(),
                   "b": np.bincount(at, each).astype("<f8").tobytes()}


def _finish(model: Model):
    def done(docs: dict, extra: np.ndarray) -> pa.RecordBatch:
        length, known, held = np.frombuffer(docs["a"], "<i8").reshape(3, -1)
        base, score = np.frombuffer(docs["b"], "<f8").reshape(2, -1)
        ids = pa.array(np.frombuffer(docs["c"], "<i8"), mask=np.frombuffer(docs["d"], np.uint8) == 0)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(held == 1), pa.array(length), pa.array(known), pa.array(np.full(len(length), model.tokens)),
             pa.array(base), pa.array(score + extra)], names=[c.split()[0] for c in SCORES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = extra = None
        for batch in batches:
            for r in batch.select(["block", "kind", "a", "b", "c", "d"]).to_pylist():
                if r["kind"] == DOCS:
                    if docs:
                        yield done(docs, extra)
                    docs, extra = r, np.zeros(len(r["a"]) // 24)
                else:
                    extra[np.frombuffer(r["a"], "<i4")] += np.frombuffer(r["b"], "<f8")
        if docs:
            yield done(docs, extra)
    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def text_buckets(docs: DataFrame) -> int:
    """Buckets of the key space, by measured bytes of text: a task sorts one bucket's keys in memory."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(2 * parts(docs.sparkSession), -(-size // BUCKET_TEXT))


def train(docs: DataFrame, least: int, n: int) -> tuple[DataFrame, Model, int]:
    """Totals for every block (a written table), the model's few numbers, and the number of training texts."""
    totals = written(B.by_bucket(docs.mapInArrow(_ask(n), B.ROW), n, lambda batches: B.batched(_totals(batches, least))), "totals")
    stats = sum((np.frombuffer(r["a"], "<i8").reshape(2, -1) for r in totals.where(F.col("kind") == STATS).select("a").collect()),
                np.zeros((2, LARGEST + 4), np.int64))          # one row a bucket
    test = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    starts = docs.select(F.count_if(~test)).first()[0]
    return totals, Model(stats), starts


def score(docs: DataFrame, least: int = 1) -> DataFrame:
    """Every text's score under the model of bigrams seen ``least`` (1 or more) times in the folds that are not held out."""
    rows, n = _rows(docs), parts(docs.sparkSession)
    buckets = text_buckets(rows)
    totals, model, starts = train(rows, least, buckets)
    answers = totals.where(F.col("kind") != STATS)
    asked = B.with_texts(rows, answers, n, _score(model, starts, buckets), B.ROW, BLOCK_TEXT)
    weighed = B.by_bucket(asked, buckets, lambda batches: B.batched(_back_off(batches)))
    return (weighed.repartition(n, "block").sortWithinPartitions("block", "kind", "bucket").mapInArrow(_finish(model), SCORES))
