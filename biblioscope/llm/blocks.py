"""Blocks of documents, and packed key exchanges between blocks and buckets.

A task cuts its documents into blocks of about ``BLOCK_BYTES`` of text.  What a block
asks of the whole corpus (counts of its distinct n-grams, say) it asks with sorted,
packed arrays, one for each bucket of the key space: a few bytes a key instead of a
row a key.  A bucket answers each array in the order it was asked, so an answer needs
no keys.  Answers meet the block's texts again by a shuffle on the block number.

A block is named by task and sequence, so the documents must be read alike each time
they are read: a scan of files is, and so is a written table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioscope.llm import textnp as T

BLOCK_BYTES = 1 << 20
BATCH_BYTES = 1 << 20       # of the answers sent as one Arrow batch
ROW = "block long, kind int, bucket int, seq int, doc_id long, text string, a binary, b binary, c binary, d binary"
NAMES = [c.split()[0] for c in ROW.split(", ")]
TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
SCHEMA = pa.schema([(n, TYPES[t]) for n, t in (c.split() for c in ROW.split(", "))])


def rows(records: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in records], f.type) for f in SCHEMA], schema=SCHEMA)


def batched(records: Iterable[dict]) -> Iterator[pa.RecordBatch]:
    """``rows`` of many small records: a batch costs far more than a record."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += 64 + sum(len(x) for x in r.values() if isinstance(x, bytes))
        if size >= BATCH_BYTES:
            yield rows(held)
            held, size = [], 0
    if held:
        yield rows(held)


def ints(values: np.ndarray) -> bytes:
    """Non-negative 32-bit values as byte planes, which compress where they are small."""
    return np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_ints(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def tagged(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block, rows) in order: batches (doc_id, text) cut where a block ends."""
    part, seq, held = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        for i, n in enumerate(size):
            if held and held + n > limit:
                if i > start:
                    yield (part << 24) + seq, batch.slice(start, i - start)
                start, seq, held = i, seq + 1, 0
            held += int(n) + 16
        if start < batch.num_rows:
            yield (part << 24) + seq, batch.slice(start)


def tag_rows(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Documents as rows of kind 0 of their block, numbered in order."""
    last, n = None, 0
    for block, batch in tagged(batches, limit):
        n = 0 if block != last else n
        k, last = batch.num_rows, block
        none = pa.nulls(k, pa.binary())
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(k, block)), pa.array(np.zeros(k, np.int32)), pa.array(np.zeros(k, np.int32)),
            pa.array(np.arange(n, n + k, dtype=np.int32)), batch.column(0), batch.column(1), none, none, none, none], schema=SCHEMA)
        n += k


def whole_blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Array, list[pa.Array]]]:
    """(block, doc ids, text arrays) of each block of a task."""
    block, ids, texts = None, [], []
    for b, batch in tagged(batches, limit):
        if b != block and ids:
            yield block, pa.concat_arrays(ids), texts
            ids, texts = [], []
        block = b
        ids.append(batch.column(0))
        texts.append(batch.column(1))
    if ids:
        yield block, pa.concat_arrays(ids), texts


def cut(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Offsets of the buckets in sorted 64-bit keys (equal ranges of the key space)."""
    edges = np.array([((i << 64) // buckets) & ((1 << 64) - 1) for i in range(1, buckets)], T.U64)
    return np.concatenate([[0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]]).astype(np.int64)


def by_bucket(packed: DataFrame, buckets: int, answer: Callable) -> DataFrame:
    """One task a bucket runs ``answer`` over its rows."""
    return packed.repartitionById(buckets, F.col("bucket")).mapInArrow(answer, ROW)


def with_texts(docs: DataFrame, answers: DataFrame, partitions: int, finish: Callable, schema: str,
               limit: int = BLOCK_BYTES) -> DataFrame:
    """Blocks (of ``limit`` bytes, as when they asked) with their texts and answers, in order of kind, bucket and sequence."""
    both = docs.mapInArrow(partial(tag_rows, limit=limit), ROW).unionByName(answers)
    return (both.repartition(partitions, "block").sortWithinPartitions("block", "kind", "bucket", "seq")
            .mapInArrow(finish, schema))


def met_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, list[pa.Array], dict[int, list[dict]]]]:
    """(block, doc ids, text arrays, answers by kind) from ordered rows; a block without texts is skipped."""
    block, ids, texts, answers = None, [], [], {}
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        kinds = batch.column(1).to_numpy()
        edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | ((kinds[1:] == 0) != (kinds[:-1] == 0))) + 1
        for i, j in zip([0, *edges], [*edges, len(blocks)], strict=True):
            if i == j:
                continue
            if blocks[i] != block:
                if ids:
                    yield block, pa.concat_arrays(ids), texts, answers
                block, ids, texts, answers = int(blocks[i]), [], [], {}
            part = batch.slice(i, j - i)
            if kinds[i] == 0:
                ids.append(part.column(4))
                texts.append(part.column(5))
            else:
                for r in part.select(["kind", "bucket", "seq", "a", "b", "c", "d"]).to_pylist():
                    answers.setdefault(r["kind"], []).append(r)
    if ids:
        yield block, pa.concat_arrays(ids), texts, answers


def block_words(texts: list[pa.Array], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block and the number of words of each row."""
    hashes, counts = [np.zeros(0, T.U64)], [np.zeros(0, np.int64)]
    for text in texts:
        for piece in T.pieces(text):
            w = T.words(piece, lower)
            hashes.append(w.hash)
            counts.append(w.count)
    return np.concatenate(hashes), np.concatenate(counts)
