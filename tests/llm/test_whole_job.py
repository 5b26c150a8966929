"""Queries and pipeline stages against brute force, where a cut once left part of the job undone."""

import math
import zlib
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

import corpus_pipeline
from biblioscope.llm import packing
from biblioscope.llm.queries import op7_katz
from biblioscope.llm.tables import text_key, without
from test_operators import COMMON, TEXTS, _docs, tokens


def test_katz_query_keeps_bigrams_seen_once(spark, tmp_path):
    texts = {i: t or "" for i, t, _ in TEXTS[:-2]}
    texts |= {20: "a b a b a c", 21: "a b d", 22: "d a b c b a", 23: "c one a b"}
    _docs(spark, [(i, t, "a") for i, t in texts.items()]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op7_katz(spark, str(tmp_path)).collect()}
    # every bigram of the training texts has its discounted share; the rest of a history's mass goes to backoff
    own = {i: [*tokens(t, True), "</s>"] for i, t in texts.items()}
    train = [i for i in own if zlib.crc32(str(i).encode()) % 7 != 2]
    uni, pairs, hist = Counter(), Counter(), Counter()
    for i in train:
        uni.update(own[i])
        for u, v in zip(["<s>", *own[i]], own[i]):
            pairs[u, v] += 1
            hist[u] += 1

    def good_turing(counts):
        n = [sum(c == r for c in counts.values()) for r in range(8)]
        for k in range(5, 0, -1):
            if all(n[1:k + 1]) and (a := (k + 1) * n[k + 1] / n[1]) < 1:
                d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, k + 1)}
                if all(0 < x <= 1 for x in d.values()) and min(d.values()) < 1:
                    return d
        return {}
    d1, d2, n = good_turing(uni), good_turing(pairs), sum(uni.values())
    left = sum((1 - d1.get(c, 1)) * c for c in uni.values())
    size = n if left > 0 else n + 1

    def p(v):
        return d1.get(uni[v], 1) * uni[v] / size if uni[v] else (left or 1) / size

    def share(u, v):
        return d2.get(pairs[u, v], 1) * pairs[u, v] / (hist[u] + 1)
    followers = {u: [v for x, v in pairs if x == u] for u in hist}
    weight = {u: (1 - sum(share(u, v) for v in f)) / (1 - sum(map(p, f))) for u, f in followers.items()}
    assert 1 in pairs.values() and any(i not in train for i in own)
    for i, text in own.items():
        score = sum(math.log10(share(u, v) if pairs[u, v] else weight.get(u, 1) * p(v)) for u, v in zip(["<s>", *text], text))
        assert math.isclose(got[i].score, score, rel_tol=1e-9), i


def test_pipeline_line_dedup_takes_long_single_lines(spark):
    long, short = " ".join(f"p{i}" for i in range(51)), " ".join(f"q{i}" for i in range(50))
    rows = [(1, f"a\n{long}\nb\n{short}\nc", "s"), (2, f"d\n  {long} \ne\n{short}\nf", "s"), (3, long, "s"), (4, short, "s"),
            (5, f"{long}\ng\n{long}", "s"), (6, f"c\nh\n{short}\n\ni", "s"), (7, f"h\n{short}\nj", "s"), (3, long, "s"), (8, None, "s"),
            (None, f"k\n{' '.join(f'r{i}' for i in range(60))}", "s"), (9, " ".join(f"r{i}" for i in range(60)), "s")]
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.lines(spark, _docs(spark, rows), "").collect())
    # a later line of over 50 words goes, and later pairs of lines that follow each other
    runs, want = set(), []
    for i, text in sorted({(i or 0, t or "") for i, t, _ in rows}):
        solid = [(j, x.strip(" ")) for j, x in enumerate(text.split("\n")) if x.strip(" ")]
        found = [((x,), (j,)) for j, x in solid if len(x.split()) > 50]
        found += [((x, y), (j, k)) for (j, x), (k, y) in zip(solid, solid[1:])]
        gone = set()
        for run, where in found:
            gone.update(where if run in runs else ())
            runs.add(run)
        want += [(i, "\n".join(x for j, x in enumerate(text.split("\n")) if j not in gone))] * sum(r[0] == (i or None) for r in rows)
    assert [(i, t or "") for i, t in got] == sorted(want)
    assert (3, "") in got and (9, "") in got and (4, short) in got and (8, None) in got


def test_pipeline_quality_judges_rows_not_ids(spark, tmp_path):
    def good(i):
        return " ".join(f"good{(i * j) % 50}" for j in range(1, 60))
    rows = [(i, good(i) if i % 4 else "junk " * 60 + str(i), "s") for i in range(200)]
    rows += [(None, good(i) if i % 4 else "junk " * 60 + str(i), "s") for i in range(201, 213)]
    rows += [(i // 4 + 500, good(i) if i % 4 else "junk " * 60 + str(i), "s") for i in range(244, 260)]
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted((r.doc_id or -1, r.text) for r in corpus_pipeline.quality(spark, _docs(spark, rows), str(tmp_path)).collect())
    assert got == sorted((i or -1, t) for i, t, _ in rows if t.startswith("good"))


def test_pipeline_near_duplicates_judge_rows_not_ids(spark):
    other = [" ".join(f"u{k}_{j}" for j in range(80)) for k in range(6)]
    rows = [(2, COMMON, "s"), (2, other[0], "s"), (1, COMMON, "s"), (1, COMMON, "s"), (1, COMMON + " tail", "s"), (1, other[1], "s"),
            (3, other[2], "s"), (3, other[3], "s"), (4, other[3] + " x", "s"), (4, other[4], "s"), (None, COMMON, "s"), (None, other[5], "s"),
            (5, other[5] + " y", "s"), (5, None, "s"), (6, "", "s"), (2, "", "s"), (2, other[0], "s")]
    sets = {}
    for _, text, _ in rows:
        w = tokens(text, True)
        sets[text] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)}
    group = {t: t for t in sets}
    for _ in sets:
        for a, b in combinations([t for t in sets if sets[t]], 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group[a] = group[b] = min(group[a], group[b])
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, _docs(spark, rows), "").collect())
    given = Counter((i, t) for i, t, _ in rows)
    assert all(got[r] == given[r] for r in got)                  # equal rows go or stay together
    assert all(r in got for r in given if r[0] is None or not sets[r[1]])
    for g in {group[t] for t in sets if sets[t]}:
        members = {(i, t) for i, t in given if i is not None and sets[t] and group[t] == g}
        stay = [r for r in members if r in got]
        assert len(stay) == min(1, len(members)) and all(i == min(m[0] for m in members) for i, _ in stay), g


def test_without_matches_id_and_text(spark):
    rows = [(None, "a", "s"), (None, "b", "s"), (None, None, "s"), (1, "a", "s"), (1, "b", "s"), (1, "b", "s")]
    docs = _docs(spark, rows)
    gone = docs.where("text = 'b' and doc_id is null or text = 'a' and doc_id = 1").select("doc_id", text_key(F.col("text")).alias("text_key"))
    for broadcast_bytes in (1 << 20, 0):
        out = without(docs, gone, broadcast_bytes)
        assert out.columns == docs.columns
        assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter({(None, "a"): 1, (None, None): 1, (1, "b"): 2})
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_packing_pads_long_texts_least(spark):
    lengths = [0, 7, 900, 1025, 1025, 1027, 2049, 2051, 2051, 4099, 20_020]
    docs = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long")
    rows = packing.pack(docs, length=F.col("n"), buckets=4).collect()
    assert sorted(r.n_tokens for r in rows) == lengths and {r.padded_length for r in rows} <= set(lengths)
    best = min(sum(min(b for b in (*inner, max(lengths)) if b >= x) - x for x in lengths)
               for inner in combinations(sorted(set(lengths) - {max(lengths)}), 3))
    assert sum(r.padded_length - r.n_tokens for r in rows) == best
