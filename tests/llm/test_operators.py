"""Operators of the training-data package against brute force, on small awkward tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from biblioscope.llm import (arc_convert, fingerprints, jaccard_join, katz, line_dedup, mixing, packing, repetition,
                             resampling, substring_dedup)
from biblioscope.llm.fm_index import FMIndex

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _salt int, slot string"
COMMON = " ".join(f"w{i}" for i in range(60))
NEAR = " ".join(f"n{i}" for i in range(200))
TEXTS = [
    (1, COMMON, "a"), (2, COMMON + " tail", "a"), (3, "head " + COMMON, "b"), (4, "", "b"), (5, None, None),
    (6, "one", "c"), (7, "ONE", "c"), (8, NEAR, "a"), (9, NEAR.replace("n199", "x"), "a"), (10, NEAR, "a"),
    (11, "l1\nl2\nl3\nrest a", "b"), (12, "x\nl1\n\nl2\n l3 \nrest b", "b"), (13, "spam " * 300, "c"),
    (14, "é ü\tß\x0bö " * 30, None), (15, " ".join(str(i * i) for i in range(30_000)), "a"), (None, "no id here", "a"),
    (1, COMMON, "a"),
]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "z") for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return _docs(spark, TEXTS)


@pytest.fixture(scope="module")
def unique(spark):
    return _docs(spark, TEXTS[:-2])


def tokens(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_empty_tables(spark):
    empty = _docs(spark, TEXTS).where("doc_id < 0")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for result in (packing.pack(empty), line_dedup.line_dedup(empty), arc_convert.round_trip(pages),
                   resampling.resample(empty, labels), fingerprints.compare_with_next(empty), mixing.mixture(empty),
                   katz.score(empty), substring_dedup.dedup_substrings(empty), repetition.repetition_rules(empty),
                   jaccard_join.join_components(empty)):
        assert result.count() == 0


def test_bounds_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = np.unique(rng.integers(0, 60, 9))
        counts, k = rng.integers(1, 9, len(lengths)), int(rng.integers(1, 5))

        def cost(bounds, lengths=lengths, counts=counts):
            return sum((min(b for b in bounds if b >= x) - x) * c for x, c in zip(lengths, counts))
        best = min(cost((*inner, lengths[-1])) for m in range(k) for inner in combinations(lengths[:-1], m))
        assert cost(packing.optimal_bounds(lengths, counts, k)) == best


def test_packing_fills_batches(docs):
    rows = packing.pack(docs, buckets=3, budget=500).collect()
    assert len(rows) == len(TEXTS) and Counter(r.doc_id for r in rows)[1] == 2
    groups = defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.padded_length
        groups[r.bucket, r.batch].append(r)
    for (bucket, batch), g in groups.items():
        assert sorted(r.place for r in g) == list(range(len(g)))
        assert len(g) == 1 or len(g) * g[0].padded_length <= 500


def test_line_dedup(docs):
    out = {(r.doc_id, r._n_removed): r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert out[11, 0] == "l1\nl2\nl3\nrest a" and out[12, 3] == "x\n\nrest b" and out[5, 0] is None
    assert line_dedup.dedup_lines(docs).columns == [*docs.columns, "_n_lines", "_n_removed"]


@pytest.mark.parametrize("n,long_words", [(2, 50), (2, None), (3, 4), (1, None)])
def test_line_dedup_against_brute_force(spark, n, long_words):
    rng = np.random.default_rng(n)
    pool = ["A", " B", "c c", "", "five words in one line", "w " * 51, "d", "  "]
    rows = [(i, "\n".join(rng.choice(pool, int(rng.integers(0, 12)))), "s") for i in range(40)]
    rows += [(50, "z\nz\nz", "s"), (51, "p\nq\np\nq\np\nq", "s"), (52, "solo " * 80, "s"), (53, "solo " * 80, "s"), (54, None, "s"),
             (None, "y\nx", "s"), (55, "y\nx", "s"), (56, "v\nu", "s"), (56, "t\nv\nu", "s"), (50, "z\nz\nz", "s"),
             (57, "\n".join(f"k{j % 700}" for j in range(1500)), "s")]
    docs = _docs(spark, rows)
    got = Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs, n, long_words).collect())
    # texts of one id stand in the order of their hash
    keys = {r.text: r.key for r in docs.select("text", F.xxhash64("text").alias("key")).distinct().collect()}
    first, want = {}, {}
    for i, text in sorted(set((i, t) for i, t, _ in rows if t is not None), key=lambda r: (r[0] is not None, r[0] or 0, keys[r[1]])):
        solid = [(j, x.strip(" ")) for j, x in enumerate(text.split("\n")) if x.strip(" ")]
        gone = set()
        for at in range(len(solid)):
            sizes = [n] if at + n <= len(solid) else []
            if long_words is not None and len(solid[at][1].split()) > long_words:
                sizes.append(1)
            for size in sizes:
                run = tuple(x for _, x in solid[at:at + size])
                own, start = first.setdefault((size, run), ((i, text), at))
                if (own, start) != ((i, text), at):
                    kept = set(range(start, start + size)) if own == (i, text) else set()
                    gone.update(solid[k][0] for k in range(at, at + size) if k not in kept)
        want[i, text] = "\n".join(x for j, x in enumerate(text.split("\n")) if j not in gone)
    assert got == Counter((i, want.get((i, t))) for i, t, _ in rows)
    if (n, long_words) == (2, 50):
        assert got[50, "z\nz"] == 2 and got[51, "p\nq"] == 1 and got[52, "solo " * 80] == 1 and got[53, ""] == 1 and got[55, ""] == 1


def test_archives(spark):
    pages = [(1, "http://a b/", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "v", "x\r\n\r\ny\n"), (2, "w", "same")]
    out = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in arc_convert.round_trip(
        spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect())
    digest = {p: arc_convert.sha1_base32((h or "").encode()) for p, _, h in pages}
    assert out == sorted([(1, 4, digest[1], "response", None), (2, 4, digest[1], "revisit", 1), (2, 4, digest[1], "revisit", 1),
                          (3, 0, digest[3], "response", None), (4, 0, digest[3], "revisit", 3), (5, 7, digest[5], "response", None)])


def test_both_arc_versions():
    for version in (1, 2):
        doc = b"HTTP/1.0 200 OK\r\n\r\nbody\n"
        raw = (arc_convert.version_block("f", version, "20010101000000") + b"\n"
               + arc_convert.arc_record(version, "f", "http://x/a b", "20010101000000", doc) + b"\n")
        [(name, offset, fields, body)] = arc_convert.read_arc(raw)
        assert name == "f" and body == doc and fields["URL"] == "http://x/a b" and raw[offset:].startswith(b"http://x")


def test_resampling_keeps_good_text(spark):
    rows = [(i, " ".join(f"good{(i * j) % 50}" for j in range(1, 60)) if i % 4 else "junk " * 60, "s") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in resampling.resample(_docs(spark, rows), labels).collect()}
    assert sum(kept.values()) == 150 and all(kept[i] == (i % 4 > 0) for i in kept)
    again = {r.doc_id: r.kept for r in resampling.resample(_docs(spark, rows), labels).collect()}
    assert again == kept


def test_resampling_against_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"W{x}" if x % 5 else f"w{x}" for x in rng.zipf(1.6, int(rng.integers(0, 40))) % 40 + 7 * (i % 3)), "s") for i in range(90)]
    rows += [(90, None, "s"), (91, "", "s"), (None, "w1 w2 w3", "s"), (None, "w4 w4", "s"), (7, rows[7][1], "s"), (7, "other text", "s")]
    given = [(i, int(i % 3 == 0), int(i == 12)) for i in range(60)] + [(3, 0, 0), (None, 1, 0), (61, None, 0)]
    docs, labels = _docs(spark, rows), spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    got = resampling.resample(docs, labels).collect()
    good = {i: all(q == 1 and not t for j, q, t in given if j == i) for i, quality, _ in given if i is not None and quality is not None}

    def grams(text):
        w = tokens(text, True)
        return [*w, *zip(w, w[1:])]
    raw = Counter(g for _, t, _ in rows for g in grams(t))
    target = Counter(g for i, t, _ in rows if good.get(i) for g in grams(t))
    r, n = raw.total(), target.total()
    noise = {(x.doc_id, x.text): x.g for x in docs.select(
        "doc_id", "text", resampling.gumbel(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("g")).collect()}
    want = sorted((sum(math.log((target[g] + 2) / (raw[g] / r * n + 2)) for g in grams(t)), noise[i, t], i or -1) for i, t, _ in rows)
    assert np.allclose([w[:2] for w in want], sorted((x.log_weight, x.noise) for x in got), atol=1e-9)
    k = round(sum(good.values()) / len(good) * len(rows))
    best = sorted(want, key=lambda w: -w[0] - w[1])
    assert best[k - 1][2] != best[k][2] or best[k - 1][2] != 7        # the two equal rows go or stay together
    kept = [x for x in got if x.kept]
    assert 0 < k < len(rows) and len(kept) == k
    assert np.allclose(sorted(x.gumbel_key for x in kept), sorted(w[0] + w[1] for w in best[:k]), atol=1e-9)


def test_kth_largest(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 5, 3, 3, 3, -2]], "v double")
    assert resampling.kth_largest(df, "v", 1)[0] == 5 and resampling.kth_largest(df, "v", 4) == (3.0, 2)


def test_fingerprints(unique):
    rows = {r.doc_id: r for r in fingerprints.compare_with_next(unique, slots=4).collect()}
    order = sorted((i, t or "") for i, t, _ in TEXTS[:-2])
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        assert rows[i].n_chars == len(text) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        x, y = ({tuple(w[j:j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in (tokens(text), tokens(edited)))
        true = len(x & y) / len(x | y) if x and y else float(x == y)
        assert abs(rows[i].near_edited - true) < 0.2
    assert rows[8].fingerprint == rows[10].fingerprint
    a, b = (fingerprints.from_text(rows[i].fingerprint) for i in (8, 9))
    assert fingerprints.to_text(a) == rows[8].fingerprint and fingerprints.resemblance(a, b) > 0.9
    assert fingerprints.containment(a, b) > 0.9 and len(fingerprints.merge(a, b)) == fingerprints.K


def test_mixing(docs):
    rows = mixing.mixture(docs).collect()
    sizes = defaultdict(int)
    for _, text, source in TEXTS:
        sizes[source] += len(tokens(text))
    for r in rows:
        assert r.source_size == sizes[r.source] and r.taken <= 2 * r.size and r.target <= 2 * r.source_size + 1e-9
    targets = {r.source: r.target for r in rows}
    assert math.isclose(sum(targets.values()), min(1.5, 2) * sum(sizes.values()))
    out = mixing.emit(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows)


def test_katz_against_brute_force(unique):
    got = {r.doc_id: r for r in katz.score(unique, least=2).collect()}
    texts = {i: [*tokens(t, True), "</s>"] for i, t, _ in TEXTS[:-2]}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    uni = Counter(w for i in train for w in texts[i])
    pairs = Counter(p for i in train for p in zip(["<s>", *texts[i]], texts[i]))
    hist = Counter()
    for (u, _), c in pairs.items():
        hist[u] += c
    def coc(counts):
        return [sum(c == r for c in counts.values()) for r in range(1, 7)]
    d1, d2, n = katz.discounts(coc(uni)), katz.discounts(coc(pairs)), sum(uni.values())
    left = sum(r * x * (1 - d1[r]) for r, x in enumerate(coc(uni), 1))
    size = n if left > 0 else n + 1
    unknown = (left or 1.0) / size
    def p1(w):
        return d1[min(uni[w], 6)] * uni[w] / size if uni[w] else unknown
    kept = defaultdict(dict)
    for (u, v), c in pairs.items():
        if c >= 2:
            kept[u][v] = d2[min(c, 6)] * c / (hist[u] + 1)
    weight = {u: (1 - sum(k.values())) / (1 - sum(map(p1, k))) for u, k in kept.items()}
    for u, k in kept.items():
        assert math.isclose(sum(k.values()) + weight[u] * (sum(p1(w) for w in uni if w not in k) + unknown), 1, rel_tol=1e-9)
    for i, text in texts.items():
        score = sum(math.log10(kept[u][v] if v in kept[u] else weight.get(u, 1) * p1(v)) for u, v in zip(["<s>", *text], text))
        base = sum(math.log10((uni[w] + 1) / (n + len(uni) + 1)) for w in text)
        r = got[i]
        assert math.isclose(r.score, score, rel_tol=1e-9) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(text), sum(w in uni for w in text), n) and r.held_out == (i not in train)


def test_fm_index():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 4, 300), 0)
    index = FMIndex(text, 5)
    patterns = rng.integers(1, 4, (50, 5))
    low, high = index.search(patterns)
    for p, a, b in zip(patterns, low, high):
        where = [i for i in range(296) if (text[i:i + 5] == p).all()]
        assert sorted(index.suffixes[a:b]) == where


def test_substring_dedup(docs):
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(docs).collect())
    seen, want = set(), []
    for i, text, _ in sorted(TEXTS, key=lambda r: r[0] or 0):
        words, gone = tokens(text), set()
        for s in range(len(words) - 19):
            w = tuple(words[s:s + 20])
            if w in seen:
                gone.update(range(s, s + 20))
            seen.add(w)
        left = " ".join(w for j, w in enumerate(words) if j not in gone)
        want.append((i or 0, len(words), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    assert got == sorted(want)


def test_repetition(docs):
    for r in repetition.repetition_rules(docs).collect():
        match = [t for i, t, _ in TEXTS if i == r.doc_id]
        words = tokens(match[0])
        windows = Counter(zip(words, words[1:], words[2:]))
        inside = {j + k for j in range(len(words) - 2) if windows[tuple(words[j:j + 3])] > 1 for k in range(3)}
        lines = [x for x in (match[0] or "").split("\n") if tokens(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(inside))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", match[0] or ""))
        assert r.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize("shingle,percent", [(3, 90), (5, 80)])
def test_jaccard_join(spark, shingle, percent):
    rng = np.random.default_rng(shingle)
    rows = [(i, t, s) for i, t, s in TEXTS if i]
    for i in range(100, 160):                     # variants of a few texts, at distances around the threshold
        words = [f"v{i % 4}_{j}" for j in range(int(rng.integers(5, 120)) if i % 3 else 120)]
        for j in rng.integers(0, len(words), int(rng.integers(0, 4))):
            words[j] = f"e{i}"
        rows.append((i, " ".join(words), "a"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(_docs(spark, rows), shingle, percent).collect()}
    sets = {}
    for i, text, _ in rows:
        w = tokens(text, True)
        sets[i] = {tuple(w[j:j + shingle]) for j in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {i: (len(sets[i]), label[i]) for i in sets}


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(5)
    pairs = []
    for _ in range(300):
        common = rng.integers(0, 1 << 63, int(rng.integers(1, 6000)), dtype=np.uint64) << np.uint64(1)
        x, y = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, int(rng.integers(0, 300)), dtype=np.uint64)])) for _ in "ab")
        pairs.append((x, y))
    sides = [jaccard_join.signatures(np.concatenate(s), np.concatenate([[0], np.cumsum([len(x) for x in s])])) for s in zip(*pairs)]
    n_a, n_b = (np.array([len(x) for x in s]) for s in zip(*pairs))
    least = jaccard_join.least_difference(*sides, n_a, n_b)
    true = np.array([len(np.setxor1d(x, y)) for x, y in pairs])
    assert (least <= true).all() and (least[true == 0] == 0).all() and (least[true > 0] > 0).mean() > 0.99
    assert len({len(s) for s in sides[0]}) > 5 and max(map(len, sides[0])) == 4 * jaccard_join.SIGNATURE_PARTS


def test_filled_templates_are_told_apart_by_signatures(spark, monkeypatch):
    compared = []
    whole = jaccard_join._verify

    def verify(pairs, sets, percent):
        compared.append(pairs.select("a", "b").distinct().count())
        return whole(pairs, sets, percent)
    monkeypatch.setattr(jaccard_join, "_verify", verify)
    rng = np.random.default_rng(9)
    template = [f"t{j}" for j in range(400)]
    rows = []
    for i in range(120):
        words = list(template)
        for slot in range(40):
            words[10 * slot] = f"s{slot}_{rng.integers(0, 2)}"
        rows.append((i, " ".join(words), "s"))
    for i in range(120, 130):                     # a few that do link: another document with four slots changed
        words = rows[i - 120][1].split()
        for slot in rng.choice(40, 4, replace=False):
            words[10 * slot] = f"s{slot}_{rng.integers(0, 2)}"
        rows.append((i, " ".join(words), "s"))
    got = {r.doc_id: r.component_id for r in jaccard_join.join_components(_docs(spark, rows)).collect()}
    sets = {i: set(zip(t.split(), t.split()[1:], t.split()[2:])) for i, t, _ in rows}
    label = {i: i for i in sets}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label and len(links) >= 10
    # of 8,385 pairs, those with the regions' first pivots and those that the signatures leave
    assert sum(compared[1:]) <= 3 * len(links) and sum(compared) < 1500


def test_pipeline_stages_keep_columns(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (13, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == docs.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_mixing_reaches_targets_with_null_and_shared_ids(spark):
    rows = [(None if i % 3 else 7, f"word{i} " * (1 + i % 9), f"s{i % 4}") for i in range(1200)]
    got = mixing.mix(_docs(spark, rows)).collect()
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        rate = own[0].target / own[0].source_size
        f = rate - int(rate)
        taken, spread = sum(r.copies * r.size for r in own), math.sqrt(sum(r.size ** 2 for r in own) * f * (1 - f))
        assert len(own) >= 50 and abs(taken - own[0].target) <= 3 * spread + 1e-6, source
