"""Token ids as binary files: Arrow files of equal-length sequences with masks.

*File.*  The Arrow stream-file format, uncompressed.  Record batches of ``BATCH``
sequences hold three columns: ``ids``, a fixed-size list of ``LENGTH`` ids (16 bits
where the vocabulary fits); ``mask`` and ``ends``, fixed-size lists of as many bits:
where an id stands, and where a document's last id stands; and ``doc_ids``, the
documents that end in the sequence.  Only a file's last sequence is padded (id 0, mask
off).  Every batch but the last is full, so sequence *i* is found by one division, and
ids and masks are views into the file's bytes (``Sequences``).

*Writing.*  Rows are dealt to slices by ranges of (doc_id, text hash, place in the
input), one slice a shuffle partition; a slice is encoded in order and closes a file
at the first document past ``FILE_IDS`` ids.  A document lies within one file.  The
files go out by Spark's own text writer, one record a file, with the format's closing
magic as the line end, and come back by its binary reader, so any store will do.

*Encoding.*  White space never joins two tokens of a tokenizer that normalises with
NFC, collapsed blanks and lower case and then splits into runs of letters, digits and
other marks; so with such a file (``_Encoder`` looks at its recipe) a Latin text is
split into those runs here and the tokenizers library's model encodes each distinct
run once while a worker remembers it.  Other words, other recipes and words that hold a
special token go through the library's whole ``encode``.

Defined results: a null text is an empty text, which has its end id alone; a null
``doc_id`` stands before all others; rows of one id are ordered by text hash; equal
rows follow each other; a long text makes a long file, and a task holds one file at a
time; other columns of the input are not carried, so their names cannot clash; an
empty table gives files of no sequence or no files, and an empty result.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioscope.llm.tables import parts, scratch_path, written

END_ID = 1
LENGTH = 2048               # ids of a sequence, a multiple of 8 so that masks begin on bytes
BATCH = 64                  # sequences of a record batch
FILE_IDS = 4 << 20          # a file is closed once it holds as many
RUNS = 400_000              # distinct runs a worker remembers
MAGIC = b"ARROW1"           # the format's closing bytes

# --- encoding -----------------------------------------------------------------

# The recipe under which white space parts a text into words that encode on their own.
RECIPE = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "blanks": {"Regex": r"\s+"},
    "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
# Texts of ASCII and the Latin letters that are one code point below 256: there lower case and
# composition are plain, and the same split is this.
LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
SIMPLE = re.compile("[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
SIMPLE_RUNS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\t-\\r 0-9{LETTERS}]+")
BLANKS = re.compile(r"[\t-\r ]+")
PRINTABLE = re.compile(f"[!-~{LETTERS}]+")
AT_ONCE = 1 << 17           # runs of a text that are looked up together
WORKER = "biblioscope_worker_cache"


class _Encoder:
    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.model = self.whole.model
        self.special = [t["content"] for t in json.loads(spec).get("added_tokens") or []]
        self.by_words = _parts_at_blanks(json.loads(spec)) and not any(BLANKS.search(t) for t in self.special)
        self.runs: dict[str, bytes] = {}
        self.as_chars = dict(enumerate(_byte_chars()))

    def encode(self, text: str) -> np.ndarray:
        if not self.by_words:
            found = self._plain(text)
        elif any(t in text for t in self.special):
            found = b"".join(self._plain(w) if any(t in w for t in self.special) else self._words([w]) for w in BLANKS.split(text))
        elif SIMPLE.fullmatch(text):
            found = self._simple(text)
        else:
            found = self._words(BLANKS.split(text))
        return np.frombuffer(found, np.uint32)

    def _plain(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _words(self, words: list[str]) -> bytes:
        """Words without blanks: simple ones side by side as one text, others whole."""
        out, simple = [], []
        for w in words:
            if w.isascii() or SIMPLE.fullmatch(w):
                simple.append(w)
            else:
                out += [self._simple(" ".join(simple)), self._look_up([w])]
                simple = []
        return b"".join([*out, self._simple(" ".join(simple))])

    def _simple(self, text: str) -> bytes:
        runs = SIMPLE_RUNS.findall(text.lower())
        return b"".join(self._look_up(runs[i:i + AT_ONCE]) for i in range(0, len(runs), AT_ONCE))

    def _look_up(self, runs: list[str]) -> bytes:
        try:
            return b"".join(map(self.runs.__getitem__, runs))
        except KeyError:
            new = {r: self._learn(r) for r in set(runs).difference(self.runs)}
        out = b"".join([new[r] if r in new else self.runs[r] for r in runs])
        if len(self.runs) + len(new) > RUNS:
            self.runs.clear()
        self.runs.update((r, ids) for r, ids in new.items() if len(r) <= 64)
        return out

    def _learn(self, run: str) -> bytes:
        """The model alone knows a run that the byte-level step turns into letters one by one."""
        if PRINTABLE.fullmatch(run):
            chars = run if run.isascii() else "".join(map(self.as_chars.__getitem__, run.encode()))
            return np.array([t.id for t in self.model.tokenize(chars)], np.uint32).tobytes()
        return self._plain(run)


def _byte_chars() -> list[str]:
    """The character that stands for each byte at byte level: itself where it prints, else the next free one."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(others)) for b in range(256)]


def _parts_at_blanks(spec: dict) -> bool:
    """Whether the tokenizer file is of the recipe that encodes word by word."""
    norm, pre, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec["model"]
    norms, pres = norm.get("normalizers") or [], pre.get("pretokenizers") or []
    return ([n["type"] for n in norms] == RECIPE["normalizer"] and norms[1]["pattern"] == RECIPE["blanks"] and norms[1]["content"] == " "
            and [p["type"] for p in pres] == ["Split", "ByteLevel"]
            and pres[0]["pattern"] == {"Regex": RECIPE["split"]} and pres[0]["behavior"] == "Removed" and pres[0]["invert"]
            and not pres[1]["add_prefix_space"] and not pres[1].get("use_regex", True)
            and spec.get("truncation") is None and spec.get("padding") is None
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens") or [])
            and model["type"] == "BPE" and not model.get("dropout"))


def _encoder(spec: str) -> _Encoder:
    """The encoder of a tokenizer file, kept by the worker process from task to task."""
    cache = sys.modules.setdefault(WORKER, types.ModuleType(WORKER)).__dict__.setdefault("encoders", {})
    key = zlib.crc32(spec.encode()), len(spec)
    if key not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"        # Spark has a task for every core already
        cache.clear()
        cache[key] = _Encoder(spec)
    return cache[key]


# --- the file format ----------------------------------------------------------

def _schema(length: int, dtype: np.dtype, meta: dict[str, int]) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length)),
                      ("ends", pa.list_(pa.bool_(), length)), ("doc_ids", pa.list_(pa.int64()))],
                     {k: str(v) for k, v in meta.items()})


def _bits(values: np.ndarray, length: int) -> pa.Array:
    packed = pa.py_buffer(np.packbits(values, bitorder="little"))
    return pa.FixedSizeListArray.from_arrays(pa.BooleanArray.from_buffers(pa.bool_(), len(values), [None, packed]), length)


def file_bytes(documents: list[tuple[int | None, np.ndarray]], meta: dict[str, int], dtype: np.dtype = np.dtype(np.uint16),
               length: int = LENGTH, batch: int = BATCH) -> bytes:
    """One Arrow file of (doc_id, ids) in order."""
    sizes = np.array([len(ids) for _, ids in documents], np.int64)
    total = int(sizes.sum())
    sequences = -(-total // length)
    ids = np.zeros(sequences * length, dtype)
    if documents:
        ids[:total] = np.concatenate([x for _, x in documents])
    mask, ends = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    mask[:total] = True
    last = np.cumsum(sizes) - 1
    ends[last] = True
    per_sequence = np.concatenate([[0], np.cumsum(np.bincount(last // length, minlength=sequences))]).astype(np.int32)
    doc_ids = pa.array([i for i, _ in documents], pa.int64())
    sink, schema = pa.BufferOutputStream(), _schema(length, dtype, meta)
    with pa.ipc.new_file(sink, schema) as out:
        for a in range(0, sequences, batch):
            b = min(a + batch, sequences)
            span = slice(a * length, b * length)
            docs = pa.ListArray.from_arrays(per_sequence[a:b + 1] - per_sequence[a], doc_ids.slice(per_sequence[a], per_sequence[b] - per_sequence[a]))
            out.write_batch(pa.RecordBatch.from_arrays([
                pa.FixedSizeListArray.from_arrays(pa.array(ids[span]), length), _bits(mask[span], length), _bits(ends[span], length), docs],
                schema=schema))
    return sink.getvalue().to_pybytes()


class Sequences:
    """Random access to a file's sequences without copying: views into ``data`` (bytes, or a memory map)."""

    def __init__(self, data: pa.Buffer | bytes):
        self.file = pa.ipc.open_file(pa.BufferReader(data))
        self.batches = [self.file.get_batch(i) for i in range(self.file.num_record_batches)]
        self.meta = {k.decode(): int(v) for k, v in (self.file.schema.metadata or {}).items()}
        self.length = self.file.schema.field("ids").type.list_size
        self.full = self.batches[0].num_rows if self.batches else 1

    @classmethod
    def open(cls, path: str) -> Sequences:
        """A file of a local or mounted folder, memory-mapped."""
        return cls(pa.memory_map(path).read_buffer())

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def _at(self, i: int) -> tuple[pa.RecordBatch, int]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        return self.batches[i // self.full], i % self.full

    def ids(self, i: int) -> np.ndarray:
        batch, row = self._at(i)
        return batch.column("ids").values.to_numpy()[row * self.length:(row + 1) * self.length]

    def packed(self, i: int, name: str = "mask") -> np.ndarray:
        """The bits of ``mask`` or ``ends``, eight a byte, lowest first."""
        batch, row = self._at(i)
        values = batch.column(name).values
        raw = np.frombuffer(values.buffers()[1], np.uint8)
        return raw[row * self.length // 8:(row + 1) * self.length // 8]

    def mask(self, i: int, name: str = "mask") -> np.ndarray:
        return np.unpackbits(self.packed(i, name), bitorder="little").astype(bool)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place of its first id in the file, ids) of each document."""
        start, held = 0, []
        for i, batch in enumerate(self.batches):
            base = i * self.full * self.length
            ids = batch.column("ids").values.to_numpy()
            bits = np.frombuffer(batch.column("ends").values.buffers()[1], np.uint8)
            ends = np.flatnonzero(np.unpackbits(bits, count=len(ids), bitorder="little"))
            at = 0
            for doc_id, end in zip(batch.column("doc_ids").values.to_pylist(), ends.tolist(), strict=True):
                held.append(ids[at:end + 1])
                whole = held[0] if len(held) == 1 else np.concatenate(held)
                yield doc_id, start, whole
                start, at, held = base + end + 1, end + 1, []
            if at < len(ids):
                held.append(ids[at:])


# --- Spark --------------------------------------------------------------------

def write_sequences(docs: DataFrame, path: str, spec: str, end_id: int = END_ID, length: int = LENGTH, file_ids: int = FILE_IDS) -> None:
    """``docs`` (doc_id, text) as Arrow files of equal-length sequences in ``path``.

    ``spec`` is the text of a tokenizer file (bounded by its vocabulary; it goes to the
    tasks as a broadcast variable).
    """
    if length % 8:
        raise ValueError("the sequence length must be a multiple of 8")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)
    most = max([end_id, *_ids_of(spec)])
    dtype = np.dtype(np.uint16 if most < 1 << 16 else np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(shared.value), TaskContext.get().partitionId()
        first, number, held, size = 0, 0, [], 0

        def close() -> pa.RecordBatch:
            data = file_bytes(held, {"slice": part, "file": number, "first": first}, dtype, length)
            return pa.RecordBatch.from_arrays([pa.array([data.removesuffix(MAGIC)], pa.binary())], names=["file"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(encoder.encode(text.as_py() or ""), np.uint32(end_id)).astype(dtype)
                held.append((doc_id.as_py(), ids))
                size += len(ids)
                if size >= file_ids:
                    yield close()
                    first, number, held, size = first + size, number + 1, [], 0
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = (rows.withColumns({"h": F.xxhash64(F.coalesce("text", F.lit(""))), "tie": F.monotonically_increasing_id()})
             .repartitionByRange(parts(spark), F.col("doc_id").asc_nulls_first(), "h", "tie")
             .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "tie"))
    (dealt.select("doc_id", "text").mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
     .write.option("lineSep", MAGIC.decode()).option("maxRecordsPerFile", 1).text(path))


def _ids_of(spec: str) -> list[int]:
    data = json.loads(spec)
    vocab = data["model"].get("vocab") or {}
    return [*(vocab.values() if isinstance(vocab, dict) else range(len(vocab))), *(t["id"] for t in data.get("added_tokens") or [])]


READ = "slice long, first long, doc_id long, n_tokens long, ids_crc32 long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            if content.as_buffer().size == 0:            # the file of a task without rows
                continue
            file = Sequences(content.as_buffer())
            rows = [(file.meta["first"] + at, doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for doc_id, at, ids in file.documents()]
            if rows:
                first, doc_id, n, crc = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), file.meta["slice"])), first, doc_id, n, crc],
                                                 names=[c.split()[0] for c in READ.split(", ")])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = written(files.mapInArrow(_read, READ), "documents")
    # one row a slice: at most as many as the shuffle partitions of the writing job
    totals = rows.groupBy("slice").agg(F.sum("n_tokens").alias("ids")).orderBy("slice").collect()
    before = np.cumsum([0, *(t["ids"] for t in totals)]).tolist()
    base = spark.createDataFrame([(t["slice"], b) for t, b in zip(totals, before, strict=False)], "slice long, base long")
    return (rows.join(F.broadcast(base), "slice")
            .select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"))


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``docs`` encoded and written as files, and every document read back from them."""
    path = scratch_path(docs.sparkSession, "sequences")
    write_sequences(docs, path, Path(tokenizer_path).read_text(encoding="utf-8"))
    return read_documents(docs.sparkSession, path)
