"""Katz models of several orders, stored as tables, against brute force and against the packed scoring."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from biblioscope.llm import katz, katz_tables
from test_operators import tokens

TEXTS = [(i, t) for i, t in enumerate([
    "a b a b a c", "a b d", "d a b c b a", "A one two three one two four", "one two three", "one two three", "", None,
    "x y z x y w x y z", "a b </s> <s> a b", "unseen words here", "two three one two five six", "\t a \n b\x0b c   d"])]
TEXTS += [(None, "a b c null id"), (None, "one two null id"), (3, "shared id a b d"), (4, "one two three"),
          (44, " ".join(f"w{i % 40} a b" for i in range(3000)))]


def brute_force(rows, order, least):
    """{text: (score, base)}, and the probability of a token after a history."""
    texts = [["\n"] * (order - 1) + [*tokens(t or "", True), "\t"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    assert any(held) and not all(held)
    counts = {k: Counter(tuple(t[i - k + 1:i + 1]) for t, out in zip(texts, held) if not out for i in range(order - 1, len(t)))
              for k in range(1, order + 1)}
    history = {k: Counter() for k in counts}
    followers = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            history[k][g[:-1]] += n
            if n >= least:
                followers[k][g[:-1]].append(g[-1])
    d = {k: katz.discounts([sum(n == r for n in c.values()) for r in range(1, katz.LARGEST + 2)]) for k, c in counts.items()}
    total = sum(counts[1].values())
    left = sum(n * (1 - d[1][min(n, katz.LARGEST + 1)]) for n in counts[1].values())
    size = total if left > 0 else total + 1

    def share(g):
        n, k = counts[len(g)][g], len(g)
        if k == 1:
            return d[1][min(n, katz.LARGEST + 1)] * n / size if n else (left or 1.0) / size
        return d[k][min(n, katz.LARGEST + 1)] * n / (history[k][g[:-1]] + 1)

    weights = {}

    def weight(h):
        if h not in weights:
            f = followers[len(h) + 1].get(h, [])
            weights[h] = (1 - sum(share((*h, v)) for v in f)) / (1 - sum(p((*h[1:], v)) for v in f)) if f else 1.0
        return weights[h]

    def p(g):
        if len(g) == 1 or counts[len(g)][g] >= least:
            return share(g)
        return weight(g[:-1]) * p(g[1:])

    out = []
    for (i, _), t, h in zip(rows, texts, held):
        own = t[order - 1:]
        out.append((i, h, len(own), sum(v in {g[0] for g in counts[1]} for v in own), total,
                    sum(math.log10((counts[1][v,] + 1) / (total + len(counts[1]) + 1)) for v in own),
                    sum(math.log10(p(tuple(t[j - order + 1:j + 1]))) for j in range(order - 1, len(t)))))
    # every history's probabilities, the unknown word's with them, sum to one
    for h in [g[:-1] for g in list(counts[order])[:40]]:
        assert math.isclose(sum(p((*h, v)) for (v,) in counts[1]) + p((*h, "\v")), 1, rel_tol=1e-9)
    return out


def _key(r):
    return (r[0] is None, r[0] or 0, r[2], round(r[6], 6))


@pytest.mark.parametrize(("order", "least"), [(1, 1), (2, 1), (2, 2), (3, 1), (4, 2)])
def test_orders_against_brute_force(spark, order, least):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").select("*", F.lit(1).alias("row"), F.lit("x").alias("t1"), F.lit(2).alias("p"))
    got = sorted((tuple(r) for r in katz_tables.score_anew(docs, order, least).collect()), key=_key)
    want = sorted(brute_force(TEXTS, order, least), key=_key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9), g


def test_order_two_is_the_packed_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = {r.doc_id: r for r in katz_tables.score_anew(docs).collect()}
    b = {r.doc_id: r for r in katz.score(docs).collect()}
    assert len(a) == len(b) == docs.count()
    for i, r in a.items():
        assert tuple(r)[:5] == tuple(b[i])[:5] and math.isclose(r.score, b[i].score, rel_tol=1e-9)
        assert math.isclose(r.base_score, b[i].base_score, rel_tol=1e-9)


def test_stored_tables_hold_the_model(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    path = katz_tables.build(docs, str(tmp_path / "model"), order=3)
    words = {r.word: r for r in spark.read.parquet(f"{path}/vocabulary").collect()}
    assert {"\t", "</s>", "<s>", "a"} <= set(words) and "\n" not in words
    assert {"bucket"} <= set(spark.read.parquet(f"{path}/grams_3").columns)
    assert spark.read.parquet(f"{path}/backoff_3").where("not (weight >= 0)").count() == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert katz_tables.score_anew(empty, 3).collect() == []
    none_trains = spark.createDataFrame([(8, "a b"), (8, None)], "doc_id long, text string").where(katz_tables._held_out())
    assert all(r.score == 0.0 for r in katz_tables.score_anew(none_trains, 2).collect())
