"""Quality rules on repetition: how much of a text lies in repeated n-grams and lines.

Every text is judged alone, so the rows stay where they are: one pass, no shuffle.
Rolling hashes of several n-gram lengths are taken over whole batches in numpy; a
longer n-gram can only repeat where the shorter one repeats, so each length looks
only at the positions that the length before left over.

Defined results: a null text is an empty text; an empty text has zero counts and is
not kept; equal rows get equal results; other columns of the input are not carried,
so their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioscope.llm import textnp as T

# Largest share of word characters inside n-grams that stood earlier in the text, by
# n-gram length (fixed values of the published repetition rules), and of lines.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.30
LINE_CHAR_LIMIT = 0.20
SYMBOL_LIMIT = 0.10            # symbols per word
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, dup_line_share double, dup_line_char_share double, "
          "dup_ngram_shares array<double>")
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _repeated(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the same (row, hash) stands at another position too, and where at an earlier one."""
    order = np.lexsort((h, row))           # stable: equal ones stay in order of position
    r, v = row[order], h[order]
    same = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
    later = np.zeros(len(h), bool)
    later[order[1:][same]] = True
    hit = later.copy()
    hit[order[:-1][same]] = True
    return hit, later


def _covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words inside a window of ``n`` words that starts at one of ``at``."""
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step)[:total] > 0


def _lines(piece: T.Piece, word_at: np.ndarray):
    """Spans, row and number of words of each line that holds a word."""
    cuts = np.union1d(np.flatnonzero(piece.data == 10) + 1, piece.offsets)
    start, end = cuts[:-1], cuts[1:].copy()
    end -= (piece.data[end - 1] == 10) if len(end) else 0
    has = np.diff(np.searchsorted(word_at, cuts)) > 0
    start, end = start[has], end[has]
    return start, end, np.searchsorted(piece.offsets, start, side="right") - 1


def measure(piece: T.Piece) -> dict[str, np.ndarray]:
    """All counts and shares of the rows of one piece."""
    w = T.words(piece)
    total, rows = len(w.hash), piece.rows
    word_offsets = np.append(w.first, total)
    chars = np.zeros(len(piece.data) + 1, np.int64)
    np.cumsum(T.code_points(piece.data), out=chars[1:])
    length = chars[w.end] - chars[w.start]
    word_chars = T.row_sums(length, word_offsets)

    at, h = T.windows(w, 3)
    at = at[_repeated(w.row[at], h)[0]]
    repeat_words = T.row_sums(_covered(at, 3, total), word_offsets)

    shares, prefix = [], T.rolling(w.hash)
    for n in sorted(NGRAM_LIMITS):
        at = at[at + n <= total]
        at = at[w.row[at] == w.row[at + n - 1]]
        hit, later = _repeated(w.row[at], T.span_hash(prefix, at, at + n))
        inside = T.row_sums(np.where(_covered(at[later], n, total), length, 0), word_offsets)
        at = at[hit]
        shares.append(inside / np.maximum(word_chars, 1))

    start, end, row = _lines(piece, w.start)
    h = T.span_hash(T.rolling(piece.data.astype(T.U64) + T.U64(1)), start, end)
    later = _repeated(row, h)[1]
    line_offsets = np.searchsorted(row, np.arange(rows + 1))
    n_lines, dup_lines = np.diff(line_offsets), T.row_sums(later, line_offsets)
    line_chars = chars[end] - chars[start]
    dup_chars = T.row_sums(np.where(later, line_chars, 0), line_offsets)
    symbols = T.row_sums(_IS_SYMBOL[piece.data], piece.offsets)

    failed = (w.count < MIN_WORDS) | (100 * repeat_words > REPEAT_PERCENT * w.count)
    dup_line_share = dup_lines / np.maximum(n_lines, 1)
    dup_char_share = dup_chars / np.maximum(T.row_sums(line_chars, line_offsets), 1)
    bad = failed | (dup_line_share > LINE_LIMIT) | (dup_char_share > LINE_CHAR_LIMIT)
    bad |= symbols > SYMBOL_LIMIT * w.count
    for n, share in zip(sorted(NGRAM_LIMITS), shares, strict=True):
        bad |= share > NGRAM_LIMITS[n]
    return {"n_words": w.count, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines,
            "n_repeat_words": repeat_words, "base_failed": failed, "kept": ~bad,
            "dup_line_share": dup_line_share, "dup_line_char_share": dup_char_share,
            "dup_ngram_shares": np.stack(shares, axis=1)}


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for piece in T.pieces(batch.column(1)):
            m = measure(piece)
            shares = m.pop("dup_ngram_shares")
            flat = pa.ListArray.from_arrays(np.arange(0, shares.size + 1, shares.shape[1], dtype=np.int32), shares.ravel())
            columns = [ids.slice(piece.first, piece.rows), *map(pa.array, m.values()), flat]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *m, "dup_ngram_shares"])


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, shares and verdict of every whole text; see the module text."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_score, SCHEMA)
