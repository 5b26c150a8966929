"""Substring dedup with a compressed FM-index per shard.

A window is ``WINDOW`` consecutive words of one text; every word that lies in a window
whose words also start earlier (smaller id, or earlier in the same text) is removed.

*Shards.*  Each window selects one of its ``GRAM``-word grams, the one of smallest
hash, so equal windows select equal grams.  Packed counts tell which selected grams
stand at several places; the windows of all others are unique and done.  The rest of
a text falls into segments, the runs of windows with one selected gram, and the gram
deals the segment to a shard.  A gram that fills a good part of a bucket deals its
windows one by one, by their whole content.  Copies of a segment within a block are
settled there, so a group of copies reaches a shard once a block.

*Search.*  A shard builds the FM-index of its distinct segments, laid out in order of
document and position.  The segments are streamed against it: backward search over
the wavelet matrix, giving up where a window is found once only, yields the matching
windows' suffix ranges, and the earliest place in a range tells whether the window
also starts earlier.  The intervals found go back to the documents.

Words are compared by ``WORD_BYTES`` bytes of their hashes, twenty in a row.

Defined results: a null text has no words; a text of fewer words than a window loses
nothing; null ids come first; rows that share an id follow one another as read; other
columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioscope.llm import blocks as B
from biblioscope.llm import textnp as T
from biblioscope.llm.fm_index import FMIndex
from biblioscope.llm.tables import key_buckets, parts, written

WINDOW = 20
GRAM = 8
WORD_BYTES = 6
KEY_BITS = 48
HOT_SHARE = 0.25            # of a bucket's selected grams
HOT_LEAST = 1000
ASK, SEGMENTS, MARKS = 1, 2, 3
BATCH = 1 << 18             # windows searched at a time

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Selection:
    """Windows of a block and the gram each of them selects."""

    def __init__(self, texts: list[pa.Array], window: int, gram: int):
        self.words, self.count = B.block_words(texts, lower=False)
        self.first = np.concatenate([[0], np.cumsum(self.count)])[:-1]
        row = np.repeat(np.arange(len(self.count)), self.count)
        n = len(self.words)
        if n < window:
            self.start = self.at = np.zeros(0, np.int64)
            self.row, self.gram = row, np.zeros(0, T.U64)
            return
        prefix = T.rolling(self.words)
        at = np.arange(n - gram + 1)
        self.gram = T.span_hash(prefix, at, at + gram)
        self.start = np.flatnonzero(row[:n - window + 1] == row[window - 1:])
        # leftmost smallest gram of each window, by doubling steps
        best, span, width = np.arange(len(self.gram)), 1, window - gram + 1
        while span * 2 <= width:
            best = self._smaller(best[:-span], best[span:])
            span *= 2
        left = best[self.start]
        self.at = self._smaller(left, best[self.start + width - span]) if span < width else left
        self.row = row

    def _smaller(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(self.gram[b] < self.gram[a], b, a)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct selected positions, their distinct keys in order, and each position's place among the keys."""
        at = np.unique(self.at)
        shift = T.U64(64 - KEY_BITS)
        key, inverse = np.unique((T.mix(self.gram[at] ^ T.MULT) >> shift) << shift, return_inverse=True)
        return at, key, inverse


def _ask(buckets: int, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in B.whole_blocks(batches):
            _, key, inverse = Selection(texts, window, gram).keys()
            if len(key):
                n, at = np.bincount(inverse, minlength=len(key)), B.cut(key, buckets)
                yield B.rows([{"block": block, "kind": ASK, "bucket": i, "seq": 0, "a": T.plane_bytes(key[at[i]:at[i + 1]]),
                               "b": B.ints(n[at[i]:at[i + 1]])} for i in np.flatnonzero(np.diff(at)).tolist()])
    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: 1 for a gram selected at several places, 2 for one that fills a good part of the bucket."""
    asked = []
    for batch in batches:
        asked += batch.select(["block", "kind", "bucket", "a", "b"]).to_pylist()
    if not asked:
        return
    keys = [T.from_planes(r["a"]) for r in asked]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(inverse, np.concatenate([B.from_ints(r["b"]) for r in asked]))
    state = ((n > 1).astype(np.uint8) + (n > max(HOT_LEAST, HOT_SHARE * n.sum())))[inverse].astype(np.uint8)
    at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    for r, i, j in zip(asked, at[:-1], at[1:], strict=True):
        yield B.rows([{"block": r["block"], "kind": ASK, "bucket": r["bucket"], "seq": 0, "a": state[i:j].tobytes()}])


def _mark_rows(block: int, row: np.ndarray, start: np.ndarray, length: np.ndarray, seq: int) -> pa.RecordBatch:
    return B.rows([{"block": block, "kind": MARKS, "bucket": 0, "seq": seq,
                    "a": np.stack([row, start, length]).astype("<i4").tobytes()}])


def _segments(buckets: int, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts, answers in B.met_blocks(batches):
            s = Selection(texts, window, gram)
            at, key, inverse = s.keys()
            if not len(at):
                continue
            state = np.concatenate([np.frombuffer(r["a"], np.uint8) for r in sorted(answers[ASK], key=lambda r: r["bucket"])])
            state = state[inverse]
            place = np.searchsorted(at, s.at)
            live, hot = state[place] > 0, state[place] > 1
            # runs of windows with one selected gram; every window of a hot gram alone
            begins = np.ones(len(s.start), bool)
            begins[1:] = (s.at[1:] != s.at[:-1]) | (s.start[1:] != s.start[:-1] + 1) | hot[1:]
            run_at = np.flatnonzero(begins)
            n_windows = np.diff(np.append(run_at, len(s.start)))
            keep = live[run_at]
            run_at, n_windows = run_at[keep], n_windows[keep]
            if not len(run_at):
                continue
            start = s.start[run_at]
            end = start + n_windows + window - 1
            content = T.span_hash(T.rolling(s.words), start, end)
            route = np.where(hot[run_at], content, key[inverse][place[run_at]])
            row = s.row[start]
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(0).to_numpy()
            # copies within the block: the earliest goes to the shard, the others are settled
            order = np.lexsort((start, row, doc[row], known[row], content, route))
            same = np.zeros(len(order), bool)
            same[1:] = (content[order][1:] == content[order][:-1]) & (route[order][1:] == route[order][:-1])
            later = order[same]
            if len(later):
                yield _mark_rows(block, row[later], start[later] - s.first[row[later]], (end - start)[later], 0)
            own = order[~same]
            bucket = ((T.mix(route[own]) >> T.U64(32)) * T.U64(buckets) >> T.U64(32)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            own, cut = own[by], np.searchsorted(bucket[by], np.arange(buckets + 1))
            out = []
            for i in np.flatnonzero(np.diff(cut)).tolist():
                g = own[cut[i]:cut[i + 1]]
                size = end[g] - start[g]
                words = s.words[np.repeat(start[g] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
                out.append({"block": block, "kind": SEGMENTS, "bucket": i, "seq": 0,
                            "a": np.stack([doc[row[g]], known[row[g]], row[g], start[g] - s.first[row[g]], size]).astype("<i8").tobytes(),
                            "b": words.view(np.uint8).reshape(-1, 8)[:, 8 - WORD_BYTES:].tobytes()})
            yield B.rows(out)
    return run


def later_windows(words: np.ndarray, size: np.ndarray, rank: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of a shard's segments also start earlier: (segment, offset, length) intervals.

    Segments come in order of (document rank, start); ``words`` holds them end to end.
    """
    at = np.concatenate([[0], np.cumsum(size)])
    content = T.span_hash(T.rolling(words), at[:-1], at[1:])
    _, first = np.unique(content, return_index=True)
    own = np.sort(first)
    copy = np.ones(len(size), bool)
    copy[own] = False
    copy = np.flatnonzero(copy)                     # later copies of whole segments
    # the distinct segments end to end, separated by 0
    n = size[own] + 1
    place = np.concatenate([[0], np.cumsum(n)])
    text = np.zeros(place[-1], np.int64)
    inside = np.repeat(place[:-1], size[own]) + _steps(size[own])
    alphabet = np.repeat(at[own], size[own]) + _steps(size[own])
    text[inside] = np.unique(words[alphabet], return_inverse=True)[1] + 1
    position = np.full(place[-1], np.iinfo(np.int64).max)
    position[inside] = (np.repeat(rank[own], size[own]) << 32) + np.repeat(start[own], size[own]) + _steps(size[own])
    index = FMIndex(text, window)
    windows = np.repeat(place[:-1], size[own] - window + 1) + _steps(size[own] - window + 1)
    segment = np.repeat(own, size[own] - window + 1)
    seg, off = [copy], [np.zeros(len(copy), np.int64)]
    for i in range(0, len(windows), BATCH):
        q = windows[i:i + BATCH]
        low, high = index.search(text[q[:, None] + np.arange(window)], least=2)
        found = np.flatnonzero(high > low)
        hit = found[index.smallest(low[found], high[found], position) < position[q[found]]]
        seg.append(segment[i + hit])
        off.append(q[hit] - place[np.searchsorted(own, segment[i + hit])])
    length = [size[copy]] + [np.full(len(x), window) for x in off[1:]]
    return np.concatenate(seg), np.concatenate(off), np.concatenate(length)


def _steps(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ... end to end."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _match(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = []
        for batch in batches:
            for r in batch.select(["block", "kind", "bucket", "seq", "a", "b"]).to_pylist():
                if r["kind"] == MARKS:
                    yield B.rows([r])
                else:
                    asked.append(r)
        if not asked:
            return
        head = [np.frombuffer(r["a"], "<i8").reshape(5, -1) for r in asked]
        block = np.repeat([r["block"] for r in asked], [h.shape[1] for h in head])
        shard = asked[0]["bucket"]
        doc, known, row, start, size = np.concatenate(head, axis=1)
        wide = np.zeros((int(size.sum()), 8), np.uint8)
        wide[:, 8 - WORD_BYTES:] = np.frombuffer(b"".join(r["b"] for r in asked), np.uint8).reshape(-1, WORD_BYTES)
        asked.clear()
        words = wide.view(T.U64).ravel()
        at = np.cumsum(size) - size
        order = np.lexsort((start, row, block, doc, known))
        doc, known, row, start, block = (x[order] for x in (doc, known, row, start, block))
        words = words[np.repeat(at[order], size[order]) + _steps(size[order])]
        size = size[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (known[1:] != known[:-1]) | (row[1:] != row[:-1]) | (block[1:] != block[:-1])
        seg, off, length = later_windows(words, size, np.cumsum(new), start, window)
        by = np.argsort(block[seg], kind="stable")
        seg, off, length = seg[by], off[by], length[by]
        edges = np.flatnonzero(np.diff(block[seg])) + 1
        for i, j in zip([0, *edges], [*edges, len(seg)], strict=True):
            if j > i:
                yield _mark_rows(int(block[seg[i]]), row[seg[i:j]], start[seg[i:j]] + off[i:j], length[i:j], 1 + shard)
    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their intervals: words left, as counts and digest."""
    for _, ids, texts, answers in B.met_blocks(batches):
        marks = [np.frombuffer(r["a"], "<i4").reshape(3, -1) for r in answers.get(MARKS, [])]
        row, start, length = np.concatenate(marks, axis=1) if marks else np.zeros((3, 0), np.int32)
        order = np.argsort(row, kind="stable")
        row, start, length = row[order], start[order], length[order]
        cut = np.searchsorted(row, np.arange(len(ids) + 1))
        n_words, n_removed, digest = [], [], []
        i = 0
        for text in texts:
            for value in text:
                words = (value.as_py() or "").encode().split()
                n, gone = len(words), 0
                if cut[i] < cut[i + 1]:
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, start[cut[i]:cut[i + 1]], 1)
                    np.add.at(step, start[cut[i]:cut[i + 1]] + length[cut[i]:cut[i + 1]], -1)
                    left = np.cumsum(step)[:n] == 0
                    gone = n - int(left.sum())
                    words = compress(words, left)
                n_words.append(n)
                n_removed.append(gone)
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
                i += 1
        yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())],
                                         names=[c.split()[0] for c in RESULT.split(", ")])


def repeated_intervals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Marks of all repeated windows, by block: a written table."""
    n, buckets = parts(docs.sparkSession), key_buckets(docs.sparkSession)
    answers = written(B.by_bucket(docs.mapInArrow(_ask(buckets, window, gram), B.ROW), buckets, _repeated), "grams")
    cut = B.with_texts(docs, answers, n, _segments(buckets, window, gram), B.ROW)
    return written(B.by_bucket(cut, buckets, _match(window)), "marks")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Words, words removed and SHA-256 of the words left (joined by a space), per row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return B.with_texts(rows, repeated_intervals(rows, window, gram), parts(docs.sparkSession), _remove, RESULT)


ORACLE = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
win as (select doc_id, s, array_to_string(words[s:s + {WINDOW - 1}], ' ') as win
        from (select doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) as s from w where len(words) >= {WINDOW})),
later as (select doc_id, s from (select doc_id, s, row_number() over (partition by win order by doc_id, s) as nth from win) where nth > 1),
gone as (select distinct doc_id, unnest(range(s, s + {WINDOW})) as p from later),
each as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as p from w),
kept as (select e.doc_id, count(g.p) as n_removed, string_agg(e.word, ' ' order by e.p) filter (where g.p is null) as left_over
         from each e left join gone g on e.doc_id = g.doc_id and e.p = g.p group by e.doc_id)
select w.doc_id, len(w.words)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
       sha256(coalesce(left_over, '')) as kept_sha256
from w left join kept k on w.doc_id = k.doc_id
"""
