"""The manifest, the token files and the target resampling against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from biblioscope.llm import merkle, target_resampling, token_files
from biblioscope.llm.queries import op12_token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
SPEC = Path(public_tokenizers.path("word_bpe_49k.json"))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Word été <b>x</b>, 12 o'clock's\n" * 30_000            # about 1 MB


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, COLUMNS + extra)


# --- manifest -----------------------------------------------------------------

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])])


def climb(nodes):
    """Root of ordered digests, and every node's siblings (left, right) from below."""
    steps, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for own, p in enumerate(place):
            run = nodes[p // 8 * 8:p // 8 * 8 + 8]
            steps[own].append(("".join(run[:p % 8]), "".join(run[p % 8 + 1:])))
        place = [p // 8 for p in place]
        nodes = [H(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], steps


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for lang in langs:
        rs = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[lang] = rs, *climb([leaf(r) for r in rs])
    root, over = climb([made[x][1] for x in langs])
    out = []
    for lang, above in zip(langs, over):
        rs, sub, steps = made[lang]
        for r, step in zip(rs, steps):
            path = step + above
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = r[1] if r[1] is None or not touched else regex.sub("[A-Z]", lambda m: m[0].lower(), r[1])
            f = leaf((r[0], text, *r[2:]))
            for left, right in path:
                f = H(left, f, right)
            out.append((r[0], leaf(r), sub, root, H(*[a + b for a, b in path]), f, f == root))
    return sorted(out, key=repr)


def check_manifest(spark, rows):
    got = merkle.manifest(docs(spark, rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute_manifest(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    return want


def test_manifest_of_groups_of_all_sizes(spark):
    sizes = {"a": 1, "b": 7, "c": 8, "d": 9, "é": 65, "Z": 64, "": 2, None: 20}
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((i, f"Text {i} of A" if i % 5 else None, lang, None if i % 4 else "s", i if i % 3 else None))
            i += 1
    want = check_manifest(spark, rows)
    assert {r[-1] for r in want} == {True, False}


def test_manifest_null_ids_copies_and_long_texts(spark):
    rows = [(None, f"T{i % 3}", "a", "s", 1) for i in range(30)] + [(5, "Same", "b", None, None)] * 10 + [(6, LONG, "a", "s", 2), (3, "", "c", "", 0)]
    check_manifest(spark, rows)


def test_manifest_of_one_row_one_group_and_none(spark):
    check_manifest(spark, [(3, "One", "a", "s", 1)])
    check_manifest(spark, [(i, "One", None, "s", 1) for i in range(9)])
    check_manifest(spark, [(i, "One", str(i), "s", 1) for i in range(9)])
    assert merkle.manifest(docs(spark, [])).collect() == []


def test_manifest_ignores_other_columns(spark):
    rows = [(i, f"T {i}", "a", "s", 1) for i in range(10)]
    more = docs(spark, [(*r, "x", 1, "y", "z") for r in rows], ", grp string, place int, digest string, slot_0 string")
    assert sorted(merkle.manifest(more).collect()) == sorted(merkle.manifest(docs(spark, rows)).collect())


# --- token files --------------------------------------------------------------

PIECES = ["Word", "it's", "WE'LL", "’s", "été", "é", "́x", "ab12cd", "'''s", "--", "日本語", " ", "\u0085", "\x1c", "\x00", "\x7f", "İ", "ſ",
          "<|endoftext|>", "<|startoftext|>x", "<|", "ς", "Σ", " ", "a" * 100, "🙂🙂", "１２", " ", "\n", "\t\r", "\x0b"]


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(PIECES) | st.text(max_size=4), max_size=12).map("".join))
def test_encoding_is_the_librarys(text):
    encoder = token_files._encoder(SPEC.read_text(encoding="utf-8"))
    assert encoder.by_words
    assert encoder.encode(text).tolist() == encoder.whole.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_are_encoded_whole():
    spec = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    encoder = token_files._Encoder(spec)
    assert not encoder.by_words
    assert encoder.encode("Two words\n here").tolist() == encoder.whole.encode("Two words\n here", add_special_tokens=False).ids


def test_file_round_trip_and_views():
    rng = np.random.default_rng(3)
    made = [(i or None, rng.integers(0, 65536, n, dtype=np.uint16)) for i, n in enumerate([1, 15, 16, 17, 200, 1, 1, 33])]
    data = pa.py_buffer(token_files.file_bytes(made, {"slice": 4, "file": 0, "first": 7}, length=16, batch=3))
    file = token_files.Sequences(data)
    ids = np.concatenate([x for _, x in made])
    assert len(file) == -(-len(ids) // 16) and file.meta == {"slice": 4, "file": 0, "first": 7}
    assert np.array_equal(np.concatenate([file.ids(i)[file.mask(i)] for i in range(len(file))]), ids)
    assert sum(file.mask(i, "ends").sum() for i in range(len(file))) == len(made)
    for i in range(len(file)):                     # every sequence and mask lies in the file's own bytes
        for view in (file.ids(i), file.packed(i)):
            assert data.address <= view.ctypes.data and view.ctypes.data + view.nbytes <= data.address + data.size
    starts = np.concatenate([[0], np.cumsum([len(x) for _, x in made])])
    for (doc_id, at, got), (want_id, want), start in zip(file.documents(), made, starts, strict=False):
        assert (doc_id, at) == (want_id, start) and np.array_equal(got, want)
    with pytest.raises(IndexError):
        file.ids(len(file))


def brute_tokens(rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(str(SPEC))
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_query_on_the_test_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = op12_token_files(spark, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == brute_tokens(rows)


def test_token_files_nulls_copies_long_texts_and_small_files(spark, tmp_path):
    rows = [(9, LONG), (2, None), (4, ""), (3, 'say "x" <|endoftext|> y'), (7, "été's")] + [(i, f"d{i}") for i in range(20, 60)]
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, file string, slice int")
    token_files.write_sequences(frame, str(tmp_path / "out"), SPEC.read_text(encoding="utf-8"), length=64, file_ids=20)
    got = token_files.read_documents(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == brute_tokens(sorted(rows))
    file = next(f for f in sorted((tmp_path / "out").glob("part-*")) if f.stat().st_size)
    assert token_files.Sequences.open(str(file)).length == 64

    same = [(None, "copy me")] * 50 + [(None, None)] * 3 + [(5, "copy me")] * 50
    token_files.write_sequences(spark.createDataFrame(same, "doc_id long, text string"), str(tmp_path / "same"), SPEC.read_text(encoding="utf-8"))
    got = sorted(map(tuple, token_files.read_documents(spark, str(tmp_path / "same")).collect()), key=lambda r: r[1])
    assert Counter((r[0], r[2]) for r in got) == Counter((r[0], r[2]) for r in brute_tokens(same))
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()
    assert [r[0] is None for r in got] == [True] * 53 + [False] * 50

    token_files.write_sequences(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"), SPEC.read_text(encoding="utf-8"))
    assert token_files.read_documents(spark, str(tmp_path / "none")).collect() == []


# --- target resampling --------------------------------------------------------

def runs(text, longest):
    words = regex.findall(target_resampling.WORD, regex.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute_draw(rows, target, longest=1, buckets=10_000, percent=10, min_words=20):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, runs(text, longest)[1]))
    for text in target:
        t.update(map(bucket, runs(text, longest)[1]))
    S, T = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for doc_id, text in rows:
        words, feats = runs(text, longest)
        weight = sum(gain[bucket(f)] for f in feats)
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([len(words), doc_id, len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[0] >= min_words), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    k = percent * len(fit) // 100
    return sorted([(*r[1:], i + 1 if i < k else None) for i, r in enumerate(fit)]
                  + [(*r[1:], None) for r in out if r[0] < min_words], key=repr)


WORDS = ["Alpha", "beta", "gämma", "x1", "日本", "Ωmega", "don't", "a-b", "A", "İ"]
DRAWN = ([(i, " ".join(WORDS[(i * j + j * j) % 10] for j in range(15 + i % 12))) for i in range(80)]
         + [(None, " ".join(WORDS * 3))] * 12 + [(5, " ".join(WORDS * 3))] * 5 + [(90, None), (91, ""), (92, "..."), (93, LONG)])
TARGET = ["alpha beta beta", None, "", "gämma X1 日本 " * 5]


@pytest.mark.parametrize("longest", [1, 3])
def test_draw_matches_brute_force(spark, monkeypatch, longest):
    rows = spark.createDataFrame([(i, t, 1, "s") for i, t in DRAWN], "doc_id long, text string, rank int, bucket string")
    target = spark.createDataFrame(list(enumerate(TARGET)), "item_id long, text string")
    got = target_resampling.resample(rows, target, longest=longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = sorted(map(tuple, got.collect()), key=repr)
    assert got == brute_draw(DRAWN, TARGET, longest) and any(r[-1] for r in got)


def test_pieces_of_a_text_have_its_runs():
    text = " ".join(WORDS * 40).lower()
    whole = target_resampling._Buckets(3, 10_000).of(text)
    for limit in (1, 7, 50):
        cut = list(target_resampling._cut(text, limit))
        assert "".join(cut) == text and len(cut) > 1
        target_resampling._cut.__defaults__, old = (limit,), target_resampling._cut.__defaults__
        try:
            n, b = target_resampling._Buckets(3, 10_000).of(text)
        finally:
            target_resampling._cut.__defaults__ = old
        assert n == whole[0] and Counter(b.tolist()) == Counter(whole[1].tolist())


def test_draw_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([], "item_id long, text string")
    assert target_resampling.resample(none, target).collect() == []
    some = spark.createDataFrame(DRAWN[:30], "doc_id long, text string")
    assert sorted(map(tuple, target_resampling.resample(some, target).collect()), key=repr) == brute_draw(DRAWN[:30], [])
