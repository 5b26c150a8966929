"""What a query's cost follows as its input grows."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from biblioscope.llm import blocks as B
from biblioscope.llm import jaccard_join, katz
from biblioscope.llm import textnp as T
from biblioscope.llm.tables import lookup, text_key, without, written


def test_katz_answers_of_many_blocks_leave_in_few_batches():
    blocks, rng = 400, np.random.default_rng(3)
    asked, total = [], {katz.UNI: Counter(), katz.BI: Counter()}
    for block in range(blocks):
        for kind in total:
            keys = np.unique(rng.integers(0, 50, 9).astype(T.U64))
            n = rng.integers(0, 3, len(keys))
            total[kind].update(dict(zip(keys.tolist(), n.tolist())))
            asked.append({"block": block, "kind": kind, "bucket": 0, "seq": 0, "a": T.plane_bytes(keys), "b": B.ints(n), "c": keys.tobytes()})
    batches = list(B.batched(katz._totals(iter([B.rows(asked)]), 1)))
    assert len(batches) <= 2                            # not one a block and kind
    answers = [r for batch in batches for r in batch.to_pylist()]
    assert len(answers) == 2 * blocks + 1
    keys = {(r["block"], r["kind"]): np.frombuffer(r["c"], T.U64).tolist() for r in asked}
    for r in answers:
        if r["kind"] == katz.UNI:
            assert katz._values([r]).tolist() == [total[katz.UNI][k] for k in keys[r["block"], katz.UNI]]
        elif r["kind"] == katz.BI:
            assert (katz._values([r]) >> 1).tolist() == [total[katz.BI][k] for k in keys[r["block"], katz.BI]]
    spoken = Counter(k for r in answers if r["kind"] == katz.BI
                     for k, x in zip(keys[r["block"], katz.BI], katz._values([r]).tolist()) if x & 1)
    assert spoken == {k: 1 for k, n in total[katz.BI].items() if n}


def test_katz_scores_do_not_hang_on_blocks_buckets_or_batches(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j * j) % 37}" for j in range(i % 11 * 9))) for i in range(120)] + [(None, "a b"), (7, "w1 w2"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def scores():
        got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.held_out, r.base_score, r.score) for r in katz.score(docs).collect()]
        return sorted(got, key=lambda r: (r[0] is None, r))
    whole = scores()
    for module, name, value in ((katz, "BLOCK_TEXT", 900), (katz, "BUCKET_TEXT", 400), (B, "BATCH_BYTES", 300)):
        monkeypatch.setattr(module, name, value)
    cut = scores()
    assert [r[:5] for r in cut] == [r[:5] for r in whole] and len(cut) == len(rows)
    assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(cut, whole) for x, y in zip(a[5:], b[5:]))


def joins(df):
    df.collect()                                        # the plan as it ran
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {kind for kind in ("BroadcastHashJoin", "ShuffledHashJoin", "SortMergeJoin") if kind in plan.split("== Initial Plan ==")[0]}


def test_copies_of_a_table_above_the_bound_are_not_broadcast(spark):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10485760b", "10485760", "10MB", "10m")
    facts = spark.createDataFrame([(i % 7 if i % 5 else None, i) for i in range(300)], "k long, x long")
    table = written(spark.createDataFrame([(0, "a"), (1, "b"), (None, "n")], "key long, v string"), "table")
    want = {0: "a", 1: "b", None: "n"}
    for how in ("left", "inner", "left_semi", "left_anti"):
        got = lookup(facts, table, "key", F.xxhash64("x"), how=how, left_key="k", broadcast_bytes=0)
        assert joins(got) == {"SortMergeJoin"}, how
        small = lookup(facts, table, "key", F.xxhash64("x"), how=how, left_key="k")
        assert joins(small) == {"BroadcastHashJoin"}
        rows = [tuple(r) for r in facts.collect()]
        rows = {"left": [(k, x, want.get(k)) for k, x in rows], "inner": [(k, x, want[k]) for k, x in rows if k in want],
                "left_semi": [(k, x) for k, x in rows if k in want], "left_anti": [(k, x) for k, x in rows if k not in want]}[how]
        for df in (got, small):
            assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(rows, key=repr), how


def test_rejected_documents_above_the_bound_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(40)] + [(None, "t"), (3, "other")], "doc_id long, text string")
    gone = docs.where("doc_id % 2 = 1 and text <> 'other' or doc_id is null").select("doc_id", text_key(F.col("text")).alias("text_key"))
    left = without(docs, gone, broadcast_bytes=0)
    assert joins(left) == {"SortMergeJoin"}
    assert sorted(tuple(r) for r in left.collect()) == sorted([(i, f"t{i}") for i in range(0, 40, 2)] + [(3, "other")])


def test_jaccard_joins_players_and_shingles_by_sorting(spark, monkeypatch):
    seen = {}

    def kept(df, name):
        seen.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df, name)
    monkeypatch.setattr(jaccard_join, "written", kept)
    monkeypatch.setattr(jaccard_join, "lookup", lambda *a, **b: lookup(*a, broadcast_bytes=0, **b))
    base = [f"w{j}" for j in range(40)]
    texts = {i: " ".join(base[:i] + [f"x{i}"] + base[i + 1:]) for i in (1, 2)} | {3: " ".join(base), 4: " ".join(base), 5: "a b c d", 6: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.join_components(docs, percent=80).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}
    for name, key in (("sets", "Join LeftSemi"), ("cells", "Join Inner")):
        lines = [x for x in seen[name][0].splitlines() if key in x]
        assert lines and all("strategy=merge" in x for x in lines), seen[name][0]
