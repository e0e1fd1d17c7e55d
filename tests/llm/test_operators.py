"""Each operator against its plain version, on texts with every odd case, clashing columns and empty tables."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from findling.llm import _kernel as K
from findling.llm import bpe, crf, licenses, merkle, packing, quality, repeats, sketch_join, token_scan, warc
from findling.llm._shared import Workspace, components, ordered

from . import brute
from .conftest import words

PATH = public_tokenizers.path("byte_bpe_50k.json")


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def library_ids(rows):
    codec = bpe.library(PATH)
    return {r[0]: x.ids for r, x in zip(rows, codec.encode_batch([r[1] or "" for r in rows], add_special_tokens=False), strict=True)}


# 1


def test_sketch_join(docs, rows):
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in table(sketch_join.sketch_join(docs)).items()}
    assert got == brute.components([r[:2] for r in rows])


def test_sketch_join_large_groups(spark, monkeypatch):
    """A chain and a star of near copies, so that large groups hold several components for a while."""
    monkeypatch.setattr(sketch_join, "GROUP_BLOCK", 7)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(40):
        own = list(base)
        for _ in range(rng.choice((1, 3, 4, 5))):
            own[rng.randrange(120)] = f"x{rng.randrange(999)}"
        texts.append((i, " ".join(own)))
    for i in range(40, 60):
        texts.append((i, " ".join(base[:60] + [f"y{i}_{j}" for j in range(70)])))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in table(sketch_join.sketch_join(frame)).items()}
    assert got == brute.components(texts)


def test_sketch_links(spark, monkeypatch):
    """Every link inside a cluster, each class of equal sets by its least document."""
    monkeypatch.setattr(sketch_join, "GROUP_BLOCK", 7)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    texts = [(0, " ".join(base)), (1, " ".join(base)), (100, None), (101, ""), (102, words(rng, 90))]
    for i in range(2, 40):
        own = list(base)
        for _ in range(rng.choice((1, 3, 4, 5))):
            own[rng.randrange(120)] = f"x{rng.randrange(999)}"
        texts.append((i, " ".join(own)))
    sets = {i: brute.shingles(t) for i, t in texts}
    linked = lambda x, y: 100 * len(x & y) >= 75 * len(x | y) > 0
    pairs = {(i, j) for i in sets for j in sets if i < j and linked(sets[i], sets[j])}
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, sketch_join.sketch_links(frame).collect()))
    assert got == sorted((i, j) for i, j in pairs if sets[i] != sets[j] and not {1} & {i, j}) and len(got) > 40
    counts = {r["doc_id"]: r["n_links"] for r in sketch_join.link_counts(frame).collect()}
    assert counts == {i: sum(i in p for p in pairs) for i in sets}
    assert sketch_join.sketch_links(frame.limit(0)).count() == 0


def test_sketch_join_odd_tables(spark, nothing):
    assert sketch_join.sketch_join(nothing).count() == 0 and sketch_join.one_of_each(nothing).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in sketch_join.sketch_join(twice).collect()) == [(0, None), (1, 1), (1, 1), (2, 1)]
    assert {r["doc_id"] for r in sketch_join.one_of_each(twice).collect()} == {1, None}


def test_sketch_join_below_the_threshold(spark, monkeypatch):
    """Many variants of one text whose similarities lie about the threshold: pieces are shared, few pairs link."""
    monkeypatch.setattr(sketch_join, "GROUP_BLOCK", 24)
    monkeypatch.setattr(sketch_join, "PIVOTS", 1)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(150):
        own = list(base)
        for at in rng.sample(range(150), rng.choice((2, 4, 4, 5, 5, 6))):
            own[at] = f"x{i}_{at}"
        texts.append((i, " ".join(own)))
    expected = brute.components(texts)
    assert 1 < len({c for _, c in expected.values()}) < 150
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in table(sketch_join.sketch_join(spark.createDataFrame(texts, "doc_id long, text string").repartition(4))).items()}
    assert got == expected


def thue_morse(n, flip=0):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


def test_equality_does_not_rest_on_a_rolling_hash(spark):
    """Thue-Morse words and their complements share every polynomial hash modulo a power of two."""
    texts = [(0, thue_morse(1024)), (1, thue_morse(1024, 1)), (2, thue_morse(64)), (3, thue_morse(64, 1))]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in table(sketch_join.sketch_join(frame)).items()} == brute.components(texts)
    raw, at = K.flatten(pa.array([t for _, t in texts]))
    assert len(np.unique(K.span_hash(raw, at[:-1], at[1:]))) == 4
    both = f"{thue_morse(1024)}\n{thue_morse(1024, 1)}\n" + words(random.Random(1), 60)
    assert quality.statistics(*K.flatten(pa.array([both])))["n_dup_lines"].tolist() == [0]
    codec = bpe.codec(PATH)
    expected = [x.ids for x in bpe.library(PATH).encode_batch([t for _, t in texts], add_special_tokens=False)]
    for chunked in (False, True):
        codec.clear()
        ids, of = codec.encode(raw, at, chunked=chunked)
        assert [ids[a:b].tolist() for a, b in zip(of[:-1], of[1:], strict=True)] == expected


def test_one_of_each_decides_by_row(spark):
    a, b, c = (words(random.Random(i), 80) for i in range(3))
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (8, None), (8, None), (None, b), (None, b)]
    kept = sorted(((r["doc_id"] or 0), r["text"] or "") for r in sketch_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert kept == sorted([(1, a), (0, b), (7, c), (8, ""), (8, "")])
    rows = rows[:5]
    kept = sorted(map(tuple, sketch_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert kept == sorted([(1, a), (5, b), (7, c)])


def test_parity_sketch_bounds():
    rng = np.random.default_rng(0)
    for n in (3, 10, 200, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[n // 5 :], rng.integers(0, 1 << 63, n // 6, dtype=np.uint64))))
        x, y = (np.frombuffer(sketch_join.short_sketch(s), np.uint64) for s in (a, b))
        size = min(len(x), len(y))
        far = int(np.bitwise_count(sketch_join.fold(x, size) ^ sketch_join.fold(y, size)).sum())
        assert far <= len(np.setxor1d(a, b))
        for c, count, emit in sketch_join.bands(len(a)):
            assert count > emit - 1 and len(sketch_join.first_pieces(a, c, count, emit, np.zeros(1 << 22, np.uint8))) == emit


# 2


def test_repeats(docs, rows):
    got = table(repeats.repeat_report(docs))
    expected = dict(zip([r[0] for r in rows], brute.repeats([r[:2] for r in rows]), strict=True))
    assert {i: tuple(r)[1:] for i, r in got.items()} == expected


def test_repeats_split_hot_cores(docs, rows, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 3)
    got = table(repeats.repeat_report(docs))
    expected = dict(zip([r[0] for r in rows], brute.repeats([r[:2] for r in rows]), strict=True))
    assert {i: tuple(r)[1:] for i, r in got.items()} == expected


def test_repeats_odd_tables(spark, nothing):
    assert repeats.repeat_report(nothing).count() == 0
    long = "".join(random.Random(3).choice("abcdefgh ") for _ in range(900))
    frame = spark.createDataFrame([(1, long), (1, long), (2, long[:450])], "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in repeats.repeat_report(frame).collect()) == [(1, 900, 900, 1), (1, 900, 900, 1), (2, 450, 450, 1)]
    kept = repeats.without_repeats(frame.withColumn("rk", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "rk"] and {r["text"] for r in kept.collect()} == {""}


def test_collection_transform():
    rng = np.random.default_rng(1)
    for _ in range(40):
        members = [rng.integers(1, 1 + rng.integers(2, 4), rng.integers(1, 40)).astype(np.uint16) for _ in range(rng.integers(1, 9))]
        width = int(rng.integers(1, 8))
        seen = Counter(tuple(x[i : i + width]) for x in members for i in range(len(x) - width + 1))
        expected = [[i for i in range(len(x) - width + 1) if seen[tuple(x[i : i + width])] > 1] for x in members]
        assert [list(x) for x in repeats.collection_repeats(members, np.ones(300, np.int32), width)] == expected


# 3


def test_quality(docs, rows):
    got = table(quality.quality_report(docs))
    stats, kept = brute.judge([(r[2], r[3], r[1]) for r in rows], quality)
    for r, s, k in zip(rows, stats, kept, strict=True):
        g = got[r[0]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) == s
        assert g["kept"] == k, r[0]
    assert not any(got[r[0]]["kept"] for r in rows if r[1] and "$$$" in r[1])


def test_quality_odd_tables(spark, docs, nothing):
    assert quality.quality_report(nothing).count() == 0
    assert quality.keep_good(docs).columns == docs.columns
    assert abs(quality.chi_square_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(quality.gamma_p(2.5, 3.0) - 0.6937810816) < 1e-6


def test_quality_small_groups(spark):
    rng = random.Random(8)
    text = lambda lang: words(rng, rng.randint(80, 120), lang)
    junk = lambda lang: " ".join(w + "$$$" for w in words(rng, 80, lang).split())
    rows = [(text("en"), "en", "big") for _ in range(200)] + [(junk("en"), "en", "rare"), (junk("fr"), "fr", "rare"), (junk("fr"), "fr", "other")]
    for clean in range(3):  # beside none, one and two clean leftovers
        frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(3)
        got = table(quality.quality_report(frame))
        assert [got[i]["kept"] for i in (200, 201, 202)] == [False] * 3, clean
        assert all(got[i]["kept"] for i in range(len(rows)) if i not in (200, 201, 202)), clean
        rows += [(text("en"), "en", "rare"), (text("fr"), "fr", "rare")]


# 4


def check_packing(pieces, ids, capacity=2048):
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append(p)
    for own in by.values():
        place = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == place
            place += p["length"]
        assert place <= capacity
    docs = {}
    for p in pieces:
        docs.setdefault(p["doc_id"], []).append(p)
    assert docs.keys() == ids.keys()
    for i, own in docs.items():
        full = [*ids[i], 0]
        own.sort(key=lambda p: p["piece"])
        assert [p["piece"] for p in own] == list(range(-(-len(full) // capacity)))
        assert all(p["length"] == capacity for p in own[1:]) and sum(p["length"] for p in own) == len(full)
        for p in own:
            assert p["ids_crc32"] == zlib.crc32(np.array(full[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
    return len(by)


def test_packing(docs, library_ids):
    pieces = packing.pack_documents(docs, PATH).collect()
    bins = check_packing(pieces, library_ids)
    counts = np.bincount([p["length"] for p in pieces], minlength=2049)
    assert packing.lower_bound(counts) <= bins <= packing.lower_bound(counts) + 1


def test_packing_exchanges(spark, monkeypatch):
    """Many small partitions, so that documents must move between them."""
    monkeypatch.setattr(packing, "PART_ITEMS", 20)
    monkeypatch.setattr(packing, "FAN_IN", 4)
    rng = random.Random(2)
    items = spark.createDataFrame([(i, rng.choice((1, 100, 700, 1024, 1025, 1500, 2047, 2048))) for i in range(600)], "row long, length long")
    placed = packing.pack(items, Workspace(spark, "test"))
    rows = placed.join(items, "row").collect()
    assert len(rows) == 600
    by = Counter()
    for r in rows:
        by[r["bin"]] += r["length"]
    assert max(by.values()) <= 2048
    bins, bound = packing.certificate(items, placed)
    assert bins == len(by) and bound <= bins <= bound + 2


def test_lower_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(4)
    for _ in range(30):
        length = rng.integers(1, 65, rng.integers(1, 60))
        bins, offset, count = packing.best_fit_decreasing(length, 64)
        assert packing.lower_bound(np.bincount(length, minlength=65), 64) <= count and np.bincount(bins, length).max() <= 64
    assert packing.lower_bound(np.bincount([40] * 7, minlength=65), 64) == 7
    assert packing.pack_documents


def test_packing_nothing(nothing):
    assert packing.pack_documents(nothing, PATH).count() == 0


# 5


def test_merkle(docs, rows):
    got = table(merkle.fingerprint_report(docs))
    order = sorted(rows, key=lambda r: r[0])
    for n, r in enumerate(order):
        text, other = r[1] or "", order[(n + 1) % len(order)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + other[:cut]
        g = got[r[0]]
        assert (g["n_chars"], g["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        own, new, after = (brute.merkle(x) for x in (text, edited, other))
        assert (g["fingerprint"], g["edited_fingerprint"]) == (own[0], new[0])
        assert (g["n_leaves"], g["n_edited_leaves"], g["n_shared_edited"], g["n_next_leaves"], g["n_shared_next"]) == (len(own[2]), len(new[2]), len(own[2] & new[2]), len(after[2]), len(own[2] & after[2]))
        dice = lambda x, y: 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0
        assert (g["near_edited"], g["near_next"]) == (dice(own[2], new[2]), dice(own[2], after[2]))
        differ = [i for i, (x, y) in enumerate(zip(own[1], new[1], strict=False)) if x != y]
        assert g["edit_paragraph"] == (differ[0] if differ else None if len(own[1]) == len(new[1]) else min(len(own[1]), len(new[1])))
        assert (g["fingerprint"] == g["edited_fingerprint"]) == (text == edited)


def test_merkle_leaves_end_by_content(spark):
    """An inserted character changes a few leaves, in prose, in scripts without spaces and in code on one line."""
    rng = random.Random(8)
    texts = [words(rng, 400), "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(2000)), "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(4000))]
    frame = spark.createDataFrame([(t, t[:50] + "x" + t[50:]) for t in texts], "a string, b string")
    sets = frame.select(merkle.names(merkle.tree(F.col("a"))), merkle.names(merkle.tree(F.col("b")))).collect()
    for a, b in sets:
        assert len(a) > 40 and len(set(a) & set(b)) >= len(a) - 2


def test_merkle_odd_tables(spark, nothing):
    assert merkle.fingerprint_report(nothing).count() == 0
    one = merkle.fingerprint_report(spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1.0
    twice = spark.createDataFrame([(1, "x" * 8), (1, "y" * 8), (2, "z" * 8), (None, None)], "doc_id long, text string")
    assert merkle.fingerprint_report(twice).count() == 4


def test_differing_paragraphs(spark):
    left = "one\ntwo\n\nthree\nfour\n\nfive"
    cases = [(1, left, left), (2, left, left.replace("four", "4")), (3, left, left + "\nsix"), (4, None, "x"), (5, left, "zero\n\n" + left)]
    frame = spark.createDataFrame(cases, "i long, l string, r string")
    got = sorted(tuple(r)[0:1] + tuple(r)[3:] for r in merkle.differing_paragraphs(frame, "l", "r").collect())
    assert got == [
        (2, "left", 1, 1),
        (2, "right", 1, 1),
        (3, "left", 2, 0),
        (3, "right", 2, 0),
        (3, "right", 2, 1),
        (4, "left", 0, 0),
        (4, "right", 0, 0),
        (5, "right", 0, 0),
        (5, "right", 0, 1),
        (5, "right", 0, 2),
    ]


# 6


def test_bpe(docs, rows, library_ids):
    got = table(bpe.bpe_report(docs, PATH))
    library = bpe.library(PATH)
    for r in rows:
        ids = library_ids[r[0]]
        assert tuple(got[r[0]])[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_bpe_joins():
    """White space, contractions and characters of several bytes at every kind of chunk end."""
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ß", " ", " ", "　", "\x85", "1", "2", "!", "?!", "\x00", "\x1c", "😀", "<|endoftext|>", "Word", "中文", "\r\n", "​", "x" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    raw, at = K.flatten(pa.array(texts, pa.string()))
    for special in (False, True):
        library = bpe.library(PATH)
        library.encode_special_tokens = special
        expected = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
        for chunked in (True, False):
            ids, of = bpe.Codec(PATH).encode(raw, at, chunked, ordinary=special)
            assert [ids[a:b].tolist() for a, b in zip(of[:-1], of[1:], strict=True)] == expected


def test_bpe_table_overflow(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_SLOTS", 64)
    codec, library = bpe.Codec(PATH), bpe.library(PATH)
    rng = random.Random(4)
    for _ in range(20):
        texts = [" ".join(str(rng.randrange(50)) for _ in range(40)) for _ in range(5)]
        raw, at = K.flatten(pa.array(texts))
        ids, of = codec.encode(raw, at)
        assert [ids[a:b].tolist() for a, b in zip(of[:-1], of[1:], strict=True)] == [library.encode(t).ids for t in texts]


def test_bpe_columns(docs, rows, nothing):
    coded = bpe.decode_column(bpe.encode_column(docs, PATH), PATH)
    assert {r["doc_id"]: r["decoded"] for r in coded.select("doc_id", "decoded").collect()} == {r[0]: r[1] or "" for r in rows}
    assert bpe.bpe_report(nothing, PATH).count() == 0


# 7


def test_forward_backward():
    rng = np.random.default_rng(0)
    model = crf.Model(["a", "b", "c"])
    model.move, model.first = rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = [0, 1, 5, 32, 33, 0, 100, 64]
    first = np.concatenate(([0], np.cumsum(lengths)))
    scores = rng.normal(size=(first[-1], 3)) * 2
    got = model.marginals(scores, first)
    for i, n in enumerate(lengths):
        if n:
            e, move = np.exp(scores[first[i] : first[i + 1]]), np.exp(model.move)
            ahead, back = np.zeros((n, 3)), np.ones((n, 3))
            ahead[0] = np.exp(model.first) * e[0]
            for t in range(1, n):
                ahead[t] = (ahead[t - 1] @ move) * e[t]
                ahead[t] /= ahead[t].sum()
            for t in range(n - 2, -1, -1):
                back[t] = move @ (e[t + 1] * back[t + 1])
                back[t] /= back[t].sum()
            share = ahead * back
            assert np.allclose(share / share.sum(1, keepdims=True), got[first[i] : first[i + 1]])


def test_language(docs, rows):
    got = table(crf.language_report(docs))
    clear = [r for r in rows if r[0] < 150]
    right = [got[r[0]]["lang_pred"] == r[2] for r in clear if got[r[0]]["held_out"]]
    assert len(right) > 20 and np.mean(right) > 0.95
    for r in rows:
        g = got[r[0]]
        assert g["held_out"] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) and 0 <= g["score"] <= 1
        if not any(c.isalpha() for c in r[1] or ""):
            assert (g["lang_pred"], g["score"]) == ("und", 0.0)
    assert got[next(r[0] for r in rows if r[1] == "日本語のテキスト")]["lang_pred"] in ("en", "fr", "de")


def test_language_needs_text_alone(spark, docs):
    """The same texts get the same predictions under other ids, labels of held-out rows, and batches."""
    model = crf.train([("en", "the ing there on at " * 20), ("fr", "eau qué leau ment " * 20)])
    raw, at = K.flatten(pa.array(["the ing on", "leau ment", "", "the ing on"]))
    labels, scores, _ = crf._judge(model, raw, at)
    assert labels == ["en", "fr", "und", "en"] and scores[0] == scores[3]
    alone = crf._judge(model, *K.flatten(pa.array(["the ing on"])))
    assert alone[1][0] == scores[0]


def test_code_switching(spark):
    model = crf.train([("en", "the thing on that er " * 40), ("fr", "eau qué leau ment ou " * 40)])
    frame = spark.createDataFrame([(1, "the thing on that the thing eau leau ment ou qué eau")], "doc_id long, text string")
    assert crf.label_words(frame, model).first()["word_labels"] == ["en"] * 6 + ["fr"] * 6


def test_language_odd_tables(spark, docs, nothing):
    assert crf.language_report(nothing).count() == 0
    plain = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert crf.language_report(plain).first()["lang_pred"] == "und"
    assert crf.keep_identified(docs).columns == docs.columns


# 8


def test_licenses(spark, docs, nothing):
    mit = licenses.KNOWN["MIT"]
    texts = [
        "MIT License\n\nCopyright (c) 2024 Some Body\n\n" + mit,
        "Copyright 1999-2001, X\n(c) 2003 Y\nAll rights reserved.\n" + mit.upper().replace(" ", "  ").replace("SUBLICENSE", "sub-licence"),
        mit + " and more",
        licenses.KNOWN["Unlicense"].replace("\n", "\r\n"),
        "Licensed under the Apache Licence, version 2.0",
        "",
        None,
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = table(licenses.license_scan(frame))
    assert [got[i]["license_id"] for i in range(7)] == ["MIT", "MIT", None, "Unlicense", "Apache-2.0-line", None, None]
    assert licenses.license_scan(docs).count() == docs.count() and licenses.license_scan(nothing).count() == 0
    clashing = frame.withColumn("digest", F.lit("x")).withColumn("license_id", F.lit("y")).withColumn("_digest", F.lit("z"))
    assert table(licenses.license_scan(clashing)) == got


def test_licenses_in_files(spark):
    """Every known wording under each title and notice, and as SQL finds them."""
    import duckdb

    notices = ["", "Copyright (c) Facebook, Inc. and its affiliates.\n", "Copyright 2019 The Authors. All rights reserved.\n", "© The Authors\n\n"]
    known = licenses.wordings()
    texts = [(i, notices[i % 4] + w.replace("\n", "\r\n" if i % 3 == 0 else "\n")) for i, (_, w) in enumerate(known)]
    got = table(licenses.license_scan(spark.createDataFrame(texts, "doc_id long, text string")))
    assert [got[i]["license_id"] for i in range(len(known))] == [k for k, _ in known]
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "BSL-1.0"} <= {k for k, _ in known}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    assert sorted(con.execute(licenses.oracle()).fetchall()) == sorted(tuple(r) for r in got.values())
    table_of = spark.createDataFrame([("own", "My own terms."), ("none", " ")], "license_id string, wording string")
    mine = licenses.license_scan(spark.createDataFrame([(1, "MY OWN TERMS"), (2, "")], "doc_id long, text string"), table_of)
    assert {r["doc_id"]: r["license_id"] for r in mine.collect()} == {1: "own", 2: None}


# 9


def test_warc(spark, monkeypatch):
    rng = random.Random(6)
    pages = [(i, f"http://x/{i}?q=é", rng.choice(["<p>same</p>", "", None, f"<p>{i}é</p>" * 30])) for i in range(200)]
    pages += [(500, None, "<p>same</p>"), (500, None, "<p>same</p>"), (None, None, "<i>none</i>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).withColumn("digest", F.lit("x"))
    for floor in (0, 5):
        space = Workspace(spark, "test-warc")
        folder, manifest = warc.write_archives(frame, space, floor, shard_bytes=20_000, roll_bytes=2_000)
        assert manifest.count() > 5 and manifest.agg(F.sum("records")).first()[0] == len(pages)
        again = warc.write_archives(frame.repartition(5), Workspace(spark, "test-warc"), floor, shard_bytes=20_000, roll_bytes=2_000)[1]
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, manifest.collect()))  # whatever the partitions
        best = {}
        for i, _, h in pages:
            key = (h or "").encode()
            best[key] = max(best.get(key, -1), -1 if i is None else i)
        responses = Counter()
        for r in warc.read_archives(folder, manifest).collect():
            html = next(h or "" for i, _, h in pages if i == r["page_id"]).encode()
            assert (r["payload_bytes"], r["payload_digest"]) == (len(html), base64.b32encode(hashlib.sha1(html).digest()).decode())
            if r["record_type"] == "revisit":
                assert r["refers_to"] == best[html] and r["html"] is None and len(html) >= floor
            else:
                responses[html] += 1
                assert r["refers_to"] is None and r["html"].encode() == html
        assert all(n == 1 for h, n in responses.items() if len(h) >= floor)
    monkeypatch.setattr(warc, "HOT_PAYLOAD", 3)
    assert warc.warc_report(frame).where("record_type = 'response'").count() == len({h or "" for _, _, h in pages})
    assert warc.warc_report(frame.limit(0)).count() == 0


# 10


def test_token_scan(docs, rows, nothing):
    library = bpe.library(PATH)
    library.encode_special_tokens = True
    got = {r["doc_id"]: r["n_tokens"] for r in token_scan.token_report(docs, PATH).collect()}
    assert got == {r[0]: len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows}
    assert token_scan.token_report(nothing, PATH).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 7, 100])
def test_separator_scan(spark, tmp_path, block):
    rng = random.Random(block)
    expected = []
    for f in range(4):
        ids = [rng.choice((5, 6, 9, 9)) for _ in range(rng.randint(0, 60) if f else 0)]
        (tmp_path / f"f{f}").write_bytes(np.array(ids, "<u2").tobytes())
        start = n = 0
        for i, x in enumerate(ids):
            if x == 9:
                expected.append((f"f{f}", n, start, i - start, True))
                start, n = i + 1, n + 1
        if start < len(ids):
            expected.append((f"f{f}", n, start, len(ids) - start, False))
    got = token_scan.count_tokens(spark, Workspace(spark, "test"), f"file://{tmp_path}", 9, 2, block)
    assert sorted(map(tuple, got.collect())) == sorted(expected)


# Shared


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 102)]
    got = {r["node"]: r["component"] for r in components(Workspace(spark, "test"), spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


class Counted(Workspace):
    """A workspace that knows how many rows each of its tables got."""

    def save(self, df, name, partition_by=None):
        out = super().save(df, name, partition_by)
        self.rows = {**getattr(self, "rows", {}), name: out.count()}
        return out


def test_components_contract(spark):
    """Edges inside a component are read once; what is left are edges between components."""
    rng = random.Random(3)
    cliques = [(100 * c + i, 100 * c + j) for c in range(4) for i in range(20) for j in range(i)]
    bridges = [(100 * c + 19, 100 * c + 119) for c in range(3)]
    space = Counted(spark, "test")
    edges = rng.sample(cliques + bridges, len(cliques + bridges))
    got = {r["node"]: r["component"] for r in components(space, spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {100 * c + i: 0 for c in range(4) for i in range(20)}
    read = sum(n for name, n in space.rows.items() if "edges" in name)
    assert read <= len(edges) + 10 and space.rows["t-edges-1"] <= 3
    nodes = rng.sample(range(10_000), 300)
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(260)]
    least = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert {r["node"]: r["component"] for r in components(Workspace(spark, "test"), spark.createDataFrame(edges, "a long, b long"), "t").collect()} == least


def test_sketch_join_reads_each_link_once(spark, monkeypatch):
    """Later steps look for components over the components so far, not over the links inside them."""
    monkeypatch.setattr(sketch_join, "GROUP_BLOCK", 7)
    given = []

    def spied(space, edges, label):
        given.append((label, edges.count()))
        return components(space, edges, label)

    monkeypatch.setattr(sketch_join, "components", spied)
    rng = random.Random(7)
    texts = []
    for i in range(60):  # one large group of near copies, and pairs that only small groups find
        own = [f"w{j}" for j in range(120)]
        for _ in range(rng.choice((1, 2, 3))):
            own[rng.randrange(120)] = f"x{rng.randrange(999)}"
        texts.append((i, " ".join(own)))
    for i in range(60, 80, 2):
        own = words(rng, 90)
        texts += [(i, own), (i + 1, own + " more")]
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in table(sketch_join.sketch_join(spark.createDataFrame(texts, "doc_id long, text string"))).items()}
    assert got == brute.components(texts)
    assert given[0][0] == "inside" and given[0][1] > 50
    assert all(n <= 30 for _, n in given[1:]) and len(given) > 1


def test_ordered(spark):
    values = [5, 3, 3, 9, None, 1, 7]
    frame = spark.createDataFrame([(v, 10 + i) for i, v in enumerate(values)], "k long, v long").repartition(4)
    got = [(r["k"], r["before"], r["following"]) for r in ordered(frame, "k", "v").orderBy(F.asc_nulls_first("k"), "v").collect()]
    total, expected = 0, []
    rows = sorted(((v, 10 + i) for i, v in enumerate(values)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    for n, (k, v) in enumerate(rows):
        expected.append((k, total, rows[n + 1][0] if n + 1 < len(rows) else None))
        total += v
    assert got == expected
