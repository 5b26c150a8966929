"""Exact Jaccard join of texts on word shingles, as a join in the metric space 1 - J.

*Sets.*  A text's set holds the hashes of its shingles; equal sets are one member of
the space.  A set can only have a partner if at most (1 - t) of its shingles occur
nowhere else, so one shuffle of packed, sorted hashes counts for each set the
shingles that it shares, and all other sets are done.

*Regions.*  The pivots are single shingles, the rarest first.  A set belongs to the
region of the first pivot it holds.  By the triangle inequality no set within
distance 1 - t can lack more than floor((1 - t) n) of its n shingles, so the window
that replicates it takes in its floor((1 - t) n) + 1 first pivots, and two linked sets
always meet in a region.  They meet first at their first common pivot; what each holds
before it the other lacks, which bounds their similarity: pairs beyond the bound are not
formed, as a pair that meets again later was judged at its first meeting.

*Recursion.*  Inside a region the set that holds the fewest pivots before the region's is
the next pivot and is compared with the others; sets linked so far form components.  Where a region still holds several
components, each gives a pivot that is compared with the members of the others, and
what is left is compared pairwise between components, as far as the triangle
inequality on the distances to the region's pivot allows.  Pairs within a component
can add nothing and are never formed, so a large group of copies costs its size, not
its square.

*Signatures.*  A set's shingles are dealt to parts by their hash, and each part is summed
up in one odd-weighted number: parts that differ in it hold a shingle that the other set
lacks, or two where the numbers of shingles are both even or both odd.  The sum over the
parts bounds the symmetric difference from below, so most pairs of texts that fill one
template are told apart by signatures of an eighth of the sets' bytes at most, and only
the others are compared whole.  The regions' first pivots are compared whole at once, as
the triangle windows need their distances.

Defined results: a null text is an empty text; a text without words has the empty
set, is linked with nothing and is its own component; a text of fewer words than a
shingle has its whole sequence as one shingle; copies share a component; rows with a
null id have the component of their set, null if nothing else is in it; extra columns
are kept by ``keep_one`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioscope.llm import textnp as T
from biblioscope.llm.components import components
from biblioscope.llm.tables import key_buckets, lookup, parts, text_key, without, written

SHINGLE = 3
PERCENT = 90
BLOCK = 1 << 19             # shingles packed at a time
COUNT_BITS = 48             # of a hash, for counting: a collision only keeps a set in play

SIGNATURE_PARTS = 512       # at most; beyond some 10,000 shingles the test only lets more pairs through

PACKED = "bucket int, block long, kind int, a binary, b binary, c binary, d binary"
MEMBERS = "doc_id long, text_key long, set_id long, n int, shared int"


def set_ids(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each sorted set; the empty set is 0."""
    n = np.diff(at)
    ids = T.span_hash(T.rolling(h), at[:-1], at[1:]) ^ T.mix(n.astype(T.U64))
    return np.where(n == 0, 0, T.unsigned_to_long(ids))


def text_sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted hashes, offsets) of the pieces of a batch (doc_id, text)."""
    for piece in T.pieces(batch.column(1)):
        row, h = T.shingles(T.words(piece, lower=True), shingle)
        yield piece.first, *T.distinct_sets(row, h, piece.rows)


def _packer(shingle: int, buckets: int):
    """Blocks of documents, their shingle hashes dealt to buckets and packed in order."""

    def flush(block: int, hashes: list, rows: list, ids: list, docs: list, texts: list, sizes: list) -> Iterator[pa.RecordBatch]:
        h, row = np.concatenate(hashes), np.concatenate(rows)
        sets, size = np.concatenate(ids), np.concatenate(sizes)
        # a set that the block holds twice is counted once
        uniq, first, member = np.unique(sets, return_index=True, return_inverse=True)
        once = np.zeros(len(sets), bool)
        once[first] = True
        keep = once[row]
        h, row = h[keep] >> T.U64(64 - COUNT_BITS), member[row[keep]]
        order = np.argsort(h, kind="stable")
        h, row = h[order], row[order].astype(np.int32)
        bucket = ((h * T.U64(buckets)) >> T.U64(COUNT_BITS)).astype(np.int64)
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cut))
        a = [T.plane_bytes(h[cut[i]:cut[i + 1]]) for i in full]
        b = [np.ascontiguousarray(row[cut[i]:cut[i + 1]].view(np.uint8).reshape(-1, 4).T).tobytes() for i in full]
        doc = pa.concat_arrays(docs)
        known = pa.compute.is_valid(doc).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
        doc = pa.compute.fill_null(doc, 0).to_numpy().astype(np.int64).tobytes() + pa.concat_arrays(texts).to_numpy().astype(np.int64).tobytes()
        n = len(full)
        yield pa.RecordBatch.from_arrays([
            pa.array([*full, block % buckets], pa.int32()), pa.array([block] * (n + 1), pa.int64()),
            pa.array([1] * n + [0], pa.int32()), pa.array([*a, uniq.tobytes() + size[first].astype(np.int64).tobytes()], pa.binary()),
            pa.array([*b, doc], pa.binary()), pa.array([None] * n + [member.astype(np.int64).tobytes()], pa.binary()),
            pa.array([None] * n + [known], pa.binary())], names=["bucket", "block", "kind", "a", "b", "c", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, rows = TaskContext.get().partitionId(), 0, ([], [], [], [], [], []), 0
        total = 0
        for batch in batches:
            for first, h, at in text_sets(batch, shingle):
                n = np.diff(at)
                for store, x in zip(held, (h, rows + np.repeat(np.arange(len(n)), n), set_ids(h, at),
                                           batch.column(0).slice(first, len(n)), batch.column(2).slice(first, len(n)), n), strict=True):
                    store.append(x)
                rows, total = rows + len(n), total + len(h)
                if total >= BLOCK:
                    yield from flush((part << 24) + seq, *held)
                    seq, held, rows, total = seq + 1, ([], [], [], [], [], []), 0, 0
        if rows:
            yield from flush((part << 24) + seq, *held)

    return run


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: how many of its hashes each set of each block shares with another set."""
    blocks, hashes, rows = [], [], []
    for batch in batches:
        lists = batch.select([0, 3, 4, 5, 6])
        for i, (block, kind) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if kind == 0:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([block], pa.int64()), pa.array([0], pa.int32()),
                                                  *[lists.column(j).slice(i, 1) for j in range(1, 5)]], names=batch.schema.names)
            else:
                blocks.append(block)
                hashes.append(T.from_planes(batch.column(3)[i].as_py()))
                rows.append(np.ascontiguousarray(np.frombuffer(batch.column(4)[i].as_py(), np.uint8).reshape(4, -1).T).view(np.int32).ravel())
    if not blocks:
        return
    size = np.array([len(h) for h in hashes])
    h = np.concatenate(hashes)
    hashes.clear()
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    shared = np.zeros(len(h), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    at = np.concatenate([[0], np.cumsum(size)])
    for i, block in enumerate(blocks):
        row, n = np.unique(rows[i][shared[at[i]:at[i + 1]]], return_counts=True)
        if len(row):
            yield pa.RecordBatch.from_arrays([
                pa.array([0], pa.int32()), pa.array([block], pa.int64()), pa.array([1], pa.int32()),
                pa.array([row.astype(np.int32).tobytes()], pa.binary()), pa.array([n.astype(np.int32).tobytes()], pa.binary()),
                pa.array([None], pa.binary()), pa.array([None], pa.binary())], names=["bucket", "block", "kind", "a", "b", "c", "d"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order, each its documents first, then the counts of every bucket."""
    held = None

    def done() -> pa.RecordBatch:
        _, sets, n, docs, texts, member, counts = held
        return pa.RecordBatch.from_arrays([docs, pa.array(texts), pa.array(sets[member]), pa.array(n[member].astype(np.int32)),
                                           pa.array(counts[member].astype(np.int32))], names=["doc_id", "text_key", "set_id", "n", "shared"])

    for batch in batches:
        for i in range(batch.num_rows):
            block, kind = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
            a, b = batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
            if kind == 0:
                if held:
                    yield done()
                sets, n = np.frombuffer(a, np.int64).reshape(2, -1)
                docs, texts = np.frombuffer(b, np.int64).reshape(2, -1)
                docs = pa.array(docs, mask=np.frombuffer(batch.column(6)[i].as_py(), np.uint8) == 0)
                held = (block, sets, n, docs, texts, np.frombuffer(batch.column(5)[i].as_py(), np.int64), np.zeros(len(sets), np.int64))
            else:
                held[6][np.frombuffer(a, np.int32)] += np.frombuffer(b, np.int32)
    if held:
        yield done()


def members(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, set_id, set size and number of shingles shared with other sets, of every row (doc_id, text, text_key)."""
    n, buckets = parts(docs.sparkSession), key_buckets(docs.sparkSession)
    packed = docs.mapInArrow(_packer(shingle, buckets), PACKED)
    counted = packed.repartitionById(buckets, F.col("bucket")).mapInArrow(_count_shared, PACKED)
    return counted.repartition(n, "block").sortWithinPartitions("block", "kind").mapInArrow(_gather, MEMBERS)


def signature_parts(n: np.ndarray) -> np.ndarray:
    """Parts of a signature for sets of ``n`` shingles: a power of two, four to eight shingles each."""
    return np.minimum(1 << (np.frexp(np.maximum(n // 4, 1))[1] - 1), SIGNATURE_PARTS).astype(np.int64)


def signatures(h: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Of each set, the sum of 2x + 1 over each part's shingles: it is odd when their number is odd."""
    n = np.diff(at)
    k = signature_parts(n)
    start = np.concatenate([[0], np.cumsum(k)])
    part = np.repeat(start[:-1], n) + (h & np.repeat(k - 1, n).astype(T.U64)).astype(np.int64)
    weight = (2 * (h >> T.U64(34)) + T.U64(1)).astype(np.float64)
    total = np.bincount(part, weight, start[-1]).astype(np.uint64).astype(np.uint32)      # exact below 2^21 shingles a part
    return [total[i:j].tobytes() for i, j in zip(start[:-1], start[1:])]


def least_difference(a: list[bytes], b: list[bytes], n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """A lower bound of the symmetric difference of each pair of sets, from their signatures."""
    k_a, k_b = signature_parts(n_a), signature_parts(n_b)
    out = np.zeros(len(a), np.int64)
    sizes = k_a * (2 * SIGNATURE_PARTS) + k_b
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        k = int(min(k_a[rows[0]], k_b[rows[0]]))
        x, y = (np.frombuffer(b"".join([sig[i] for i in rows]), np.uint32).reshape(len(rows), -1, k).sum(1, dtype=np.uint32) for sig in (a, b))
        d = x - y
        out[rows] = np.where(d == 0, 0, 2 - (d & 1)).sum(1)
    return out


def _may_link(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            least = least_difference(batch.column(4).to_pylist(), batch.column(5).to_pylist(), n_a, n_b)
            may = (n_a + n_b - least) * 100 >= (n_a + n_b + least) * percent
            yield batch.select([0, 1]).filter(pa.array(may))

    return run


def screened(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their signatures let be linked."""
    left = sets.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("x"))
    right = sets.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "x", "y")
    return written(both.mapInArrow(_may_link(percent), "a long, b long"), "screened")


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, h, at in text_sets(batch, shingle):
                lists = pa.LargeListArray.from_arrays(at, T.unsigned_to_long(h)).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(h, at)), pa.array(np.diff(at).astype(np.int32)), lists,
                                                  pa.array(signatures(h, at), pa.binary())], names=["set_id", "n", "hashes", "signature"])

    return run


def _can_link(n_a: str, lack_a: str, n_b: str, lack_b: str, percent: int):
    """Whether sets whose first common shingle this is, ``lack`` rarer ones before it, can be linked."""
    most = F.least(F.col(n_a) - F.col(lack_a), F.col(n_b) - F.col(lack_b))
    return most * 100 >= (F.col(n_a) + F.col(n_b) - most) * percent


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, distance, linked) of candidate pairs: exact counts on whole sets."""
    left = sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    counted = (pairs.select("a", "b").distinct().join(left, "a").join(right, "b")
               .select("a", "b", both.alias("both"), (F.size("x") + F.size("y") - both).alias("union")))
    return written(counted.select("a", "b", (1 - F.col("both") / F.col("union")).alias("distance"),
                                  (F.col("both") * 100 >= F.col("union") * percent).alias("linked")), "verified")


def _linked(links: DataFrame, sets_n: DataFrame) -> DataFrame:
    """(set_id, comp): sets without links are their own component."""
    comp = components(links)
    return (sets_n.join(comp, sets_n["set_id"] == comp["node"], "left")
            .select("set_id", F.coalesce("comp", "set_id").alias("comp")))


def region_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect exactly the components of the similarity graph of ``sets``."""
    may_lack = F.floor(F.col("n") * (100 - percent) / 100)
    tokens = sets.select("set_id", "n", F.explode("hashes").alias("h"))
    df = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # Spark's estimate sees the sets' compressed file and not their shingles, so left to itself it may broadcast ``df``
    ranked = (tokens.join(df.hint("merge"), "h").groupBy("set_id", "n")
              .agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("pivots")))       # bounded by the text
    window = may_lack + 1 - (F.col("n") - F.size("pivots"))      # the pivots held by no other set come first
    alone = F.col("n") - F.size("pivots")
    cells = written(ranked.where(window > 0)
                    .select("set_id", "n", alone.alias("alone"), F.posexplode(F.slice("pivots", 1, window.cast("int"))).alias("at", "p"))
                    .select(F.col("p.h").alias("cell"), "p.df", "set_id", "n", (F.col("alone") + F.col("at")).alias("lack")), "cells")
    # regions of the same members are one region, that of the rarest pivot: no member lacks more before it
    same = (cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("set_id")).alias("x"),
                                      F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("y"),
                                      F.min("df").alias("df"))
            .where("size > 1").groupBy("size", "x", "y").agg(F.min(F.struct("df", "cell")).alias("c")).select("c.cell"))
    cells = written(cells.join(same, "cell").drop("df"), "regions")

    def pivot_pairs(pivots: DataFrame, rows: DataFrame, other: F.Column) -> DataFrame:
        return (rows.join(pivots, "cell").where(other & _can_link("n", "lack", "pivot_n", "pivot_lack", percent))
                .select(F.least("set_id", "pivot").alias("a"), F.greatest("set_id", "pivot").alias("b")))

    # the member with the fewest rarer shingles is the most central one
    pivot = F.min(F.struct("lack", "set_id", "n")).alias("p")
    as_pivot = [F.col("p.set_id").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.lack").alias("pivot_lack")]
    first = written(cells.groupBy("cell").agg(pivot).select("cell", *as_pivot), "pivots")
    tested = _verify(pivot_pairs(first, cells, F.col("set_id") != F.col("pivot")), sets, percent)
    sets_n = written(cells.select("set_id").distinct(), "players")

    def open_cells(links: DataFrame) -> DataFrame:
        """Members of the cells that still hold more than one component."""
        comp = _linked(links, sets_n)
        rows = cells.join(comp, "set_id")
        several = rows.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("cell")
        return written(rows.join(several, "cell"), "open")

    left = open_cells(tested.where("linked"))
    if left.isEmpty():
        return tested.where("linked").select("a", "b")
    # each component's most central member against the other components' members
    per = written(left.groupBy("cell", "comp").agg(pivot).select("cell", F.col("comp").alias("pivot_comp"), *as_pivot), "pivots")
    again = pivot_pairs(per, left, F.col("comp") != F.col("pivot_comp")).distinct().join(tested, ["a", "b"], "left_anti")
    tested = written(tested.unionByName(_verify(screened(again, sets, percent), sets, percent)), "tested")
    left = open_cells(tested.where("linked"))
    if left.isEmpty():
        return tested.where("linked").select("a", "b")
    # A pivot has met its whole region.  Of the other members, the pairs between components are left,
    # inside the triangle window of the region's first pivot.
    met = per.select("cell", F.col("pivot").alias("set_id")).unionByName(first.select("cell", F.col("pivot").alias("set_id")))
    left = left.join(met, ["cell", "set_id"], "left_anti")
    several = left.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("cell")
    left = written(left.join(several, "cell"), "rest")
    if left.isEmpty():
        return tested.where("linked").select("a", "b")
    to_pivot = tested.select("a", "b", "distance").unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    placed = (left.join(first.select("cell", "pivot"), "cell")
              .join(to_pivot.withColumnsRenamed({"a": "set_id", "b": "pivot"}), ["set_id", "pivot"], "left"))
    other = placed.select("cell", F.col("set_id").alias("set_b"), F.col("comp").alias("comp_b"), F.col("n").alias("n_b"),
                          F.col("lack").alias("lack_b"), F.col("distance").alias("distance_b"))
    near = F.coalesce(F.abs(F.col("distance") - F.col("distance_b")) <= 1 - percent / 100 + 1e-9, F.lit(True))
    rest = (placed.join(other, "cell").where((F.col("set_id") < F.col("set_b")) & (F.col("comp") != F.col("comp_b")) & near
                                             & _can_link("n", "lack", "n_b", "lack_b", percent))
            .select(F.col("set_id").alias("a"), F.col("set_b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"))
    return tested.where("linked").select("a", "b").unionByName(_verify(screened(rest, sets, percent), sets, percent).where("linked").select("a", "b"))


def join_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, set_id, comp (the component's least set) and component_id of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key(F.col("text")).alias("text_key"))
    member = written(members(rows, shingle), "members")
    may_lack = F.floor(F.col("n") * (100 - percent) / 100)
    # one document for each set that shares enough
    play = written(member.where((F.col("n") > 0) & (F.col("n") - F.col("shared") <= may_lack))
                   .groupBy("set_id").agg(F.min("doc_id").alias("rep")).groupBy("rep").agg(F.lit(True).alias("plays")), "players")
    texts = lookup(rows, play, "rep", F.xxhash64("text"), how="left_semi", left_key="doc_id")
    sets = written(texts.mapInArrow(_sets(shingle), "set_id long, n int, hashes array<long>, signature binary")
                   .where("n > 0").dropDuplicates(["set_id"]), "sets")
    comp = components(region_links(sets, percent))
    smallest = member.groupBy("set_id").agg(F.min("doc_id").alias("first_id"))
    named = smallest.join(comp, smallest["set_id"] == comp["node"], "left")
    named = named.select("set_id", "first_id", F.coalesce("comp", "set_id").alias("comp"))
    ids = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    by_set = named.join(ids, "comp").select("set_id", "comp", "component_id")
    solid = member.where("n > 0").join(by_set, "set_id").select(
        "doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), "set_id", "comp", "component_id")
    empty = member.where("n = 0").select(
        "doc_id", "text_key", F.lit(0).cast("long").alias("n_shingles"), "set_id", F.col("set_id").alias("comp"), F.col("doc_id").alias("component_id"))
    return solid.unionByName(empty)


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group: the smallest id; rows without words or id stay.

    A document is its id and text: rows equal in both go or stay together, other texts of an
    id stand on their own.  Of several texts of the smallest id, that of smallest hash stays.
    """
    found = written(join_components(docs, shingle, percent).where("n_shingles > 0 and doc_id is not null")
                    .select("doc_id", "text_key", "comp", "component_id").distinct(), "found")
    of_first = found.where("doc_id = component_id")
    several = written(of_first.groupBy("comp").agg(F.min("text_key").alias("stays"), F.max("text_key").alias("last"))
                      .where("stays <> last").select("comp", "stays"), "several")
    later = lookup(of_first, several, "comp", F.col("text_key"), how="inner").where("text_key <> stays")
    return without(docs, found.where("doc_id <> component_id").select("doc_id", "text_key").union(later.select("doc_id", "text_key")))
