"""Substring dedup and BagMinHash against brute force, with the hard inputs of both."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from modengine.llm import bagminhash as B
from modengine.llm import substring as S
from modengine.llm.components import components
from modengine.llm.wordhash import hash_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, starts string, key string"


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    passage, other = words(rng, 60), words(rng, 33)
    texts = [" ".join(words(rng, rng.randrange(30, 200))) for _ in range(30)]
    texts += [" ".join(words(rng, 40) + passage + words(rng, 25)) for _ in range(12)]
    texts += [" ".join(other[:25] + words(rng, 10) + other + passage[20:] + other)]
    texts += [" ".join(words(rng, 19)), "", "   \n\t", "one two three", "one two three", "x " * 300, "é ü " * 50]
    base = words(rng, 300)
    for i in range(15):  # near copies: a few words changed
        near = list(base)
        for j in rng.sample(range(300), i % 6):
            near[j] = f"n{i}x{j}"
        texts.append("\n".join(near))
    texts += [texts[0], texts[0].replace(" ", "\n"), "long " + " ".join(words(rng, 30_000, 30))]
    return [(i * 3 % 101, t) for i, t in enumerate(texts)] + [(200, None)]


def frame(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "s", 0, "a", "b") for i, t in corpus], SCHEMA).repartition(5)


def brute_substrings(corpus, window=20):
    first, out = {}, {}
    docs = [(i, (t or "").encode().split()) for i, t in corpus]
    for i, w in docs:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, (i, p)), (i, p))
    for i, w in docs:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (i, p):
                gone[p : p + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def brute_classes(corpus):
    bags = {}
    for i, t in corpus:
        w = (t or "").encode().split()
        bags[i] = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    label = {i: i for i in bags}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in bags:
        for b in bags:
            if a < b:
                shared = sum((bags[a] & bags[b]).values())
                if shared and 5 * shared >= 4 * (sum(bags[a].values()) + sum(bags[b].values()) - shared):
                    x, y = sorted((find(a), find(b)))
                    label[y] = x
    return {i: find(i) for i in bags}


def test_substring_digest_equals_brute_force(spark, corpus, monkeypatch):
    want = brute_substrings(corpus)
    for size, seeds in ((1 << 10, 1 << 30), (6 << 20, 1 << 30), (6 << 20, 500)):  # many small blocks, one, and one that is split
        monkeypatch.setattr(S, "BLOCK_BYTES", size)
        monkeypatch.setattr(S, "BLOCK_SEEDS", seeds)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.substring_digest(frame(spark, corpus)).collect()}
        assert got == want
    assert sum(n for _, n, _ in want.values()) > 1000


def test_buffers_deal_seeds_to_blocks(corpus):
    rows = sorted((i, (t or "").encode()) for i, t in corpus)
    for size in (1, 7, len(rows)):
        seeds = [x for a in range(0, len(rows), size) for x in S._buffer_seeds(rows[a : a + size], 20, 6, 3, {})]
        assert {s["block"] for s in seeds} == {0, 1, 2}
        parts = [x for a in range(0, len(rows), size) for x in S._buffer_seeds(rows[a : a + size], 20, 6, 3, {1: 4})]
        assert {s["block"] for s in parts} == {0, 2, 1, 4, 7, 10}
        flat = lambda found: sorted(np.concatenate([np.frombuffer(s["seeds"], "<u8") for s in found]).tolist())
        assert flat(seeds) == flat(parts)


def test_parse_is_greedy_and_factors_are_maximal():
    """Against a scalar parse: look up, extend seed by seed as far as the first occurrence goes on alike, jump."""
    rng = np.random.default_rng(7)
    for round_ in range(60):
        sizes = rng.integers(1, 90, 6)
        doc = np.repeat(np.arange(6), sizes)
        pos = np.concatenate([np.sort(rng.choice(100, n, replace=False)) for n in sizes])
        seeds = rng.integers(0, 3 if round_ % 2 else 40, len(doc)).astype(np.uint64)
        if round_ % 3 == 0:
            seeds[doc == 3], seeds[doc == 5] = 7, 7
        crc = np.zeros(len(doc), np.uint32)
        at = {(int(d), int(p)): int(s) for d, p, s in zip(doc, pos, seeds, strict=True)}
        want = []
        for d in range(6):
            i = 0
            places = sorted(p for e, p in at if e == d)
            while i < len(places):
                p = places[i]
                ref = min(k for k, s in at.items() if s == at[d, p])
                if ref == (d, p):
                    i += 1
                    continue
                n = 1
                while (d, p + n) in at and (ref[0], ref[1] + n) in at and at[d, p + n] == at[ref[0], ref[1] + n]:
                    n += 1
                want.append((d, p, n, *ref))
                i += n
        got = S._parse(doc, crc, pos, seeds, S._first_in_order(seeds, np.lexsort((pos, doc, seeds))))
        assert [(int(x["doc"]), int(x["start"]), int(x["n"]), int(x["ref"]), int(x["ref_start"])) for x in got] == want


def test_removed_text_keeps_everything_else(spark, corpus):
    docs = frame(spark, corpus)
    out = {r.doc_id: r for r in S.remove_repeats(docs).collect()}
    want = brute_substrings(corpus)
    assert S.remove_repeats(docs).columns == docs.columns
    for i, t in corpus:
        kept = (out[i].text or "").split(" ") if out[i].text else []
        assert hashlib.sha256(b" ".join((out[i].text or "").encode().split())).hexdigest() == want[i][2], kept[:5]
        if not want[i][1]:
            assert out[i].text == t
        assert out[i].n_chars == (None if out[i].text is None else len(out[i].text))


def test_substring_repeated_and_null_ids(spark):
    text = " ".join(f"a{i}" for i in range(40))
    other = "b " + text
    rows = [(1, text), (1, text), (1, other), (None, text), (2, "c " + text)]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed) for r in S.substring_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # the null id is first; all others repeat it
    assert got == [(False, 0, 40, 0), (True, 1, 40, 40), (True, 1, 40, 40), (True, 1, 41, 40), (True, 2, 41, 40)]
    got = sorted((r.n_words, r.n_removed) for r in S.substring_digest(spark.createDataFrame(rows[:3], "doc_id long, text string")).collect())
    # equal places of equal ids are the same place; the shifted copy starts later
    assert got == [(40, 0), (40, 0), (41, 40)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.substring_digest(empty).count() == 0
    assert S.remove_repeats(empty).count() == 0
    assert B.near_duplicate_classes(empty).count() == 0
    assert B.drop_near_duplicates(empty).columns == empty.columns


def test_classes_equal_brute_force(spark, corpus):
    want = brute_classes(corpus)
    rows = B.near_duplicate_classes(frame(spark, corpus)).collect()
    assert {r.doc_id: r.class_id for r in rows} == want
    size = Counter(want.values())
    assert all(r.class_size == size[r.class_id] for r in rows)
    kept = B.drop_near_duplicates(frame(spark, corpus)).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))


def test_repeated_rows_keep_one(spark):
    text = " ".join(f"a{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (3, None), (3, None), (None, "x y z"), (5, "x y z")], "doc_id long, text string")
    kept = sorted(((r.doc_id is None, r.doc_id or 0) for r in B.drop_near_duplicates(docs).collect()))
    assert kept == [(False, 1), (False, 3), (False, 3), (True, 0)]
    classes = {(r.doc_id, r.class_id, r.class_size) for r in B.near_duplicate_classes(docs).collect()}
    assert classes == {(1, 1, 3), (2, 1, 3), (3, 3, 1), (None, None, 2), (5, None, 2)}


def test_signature_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, 40).astype(np.uint64)
    a, b = rng.integers(0, 9, 40), rng.integers(0, 9, 40)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    agree = []
    for shift in range(40):
        doc = np.concatenate([np.zeros(a.sum(), int), np.ones(b.sum(), int)])
        sig = B.signatures(doc, np.concatenate([np.repeat(keys, a), np.repeat(keys, b)]) + np.uint64(shift * 7919), 2)
        agree.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(agree) - true) < 4 * (true * (1 - true) / (40 * B.SLOTS)) ** 0.5


@pytest.mark.parametrize(("cell", "shingles"), [(1, 1 << 30), (2, 1 << 30), (100, 1), (100, 1 << 30)])
def test_cross_class_cells_find_links_behind_a_hub(spark, monkeypatch, cell, shingles):
    """A band whose largest class is like neither of two texts that are alike, in cells of several sizes."""
    monkeypatch.setattr(B, "CELL", cell)
    monkeypatch.setattr(B, "CELL_SHINGLES", shingles)
    sig, keys = np.zeros((6, B.SLOTS), np.uint32), np.arange(60, dtype=np.uint64).reshape(6, 10)
    sig[0], sig[1], sig[2] = 5, 7, 7
    sig[3:] = 9
    keys[2, :9], keys[5] = keys[1, :9], keys[3]  # 9 of 11 shared; equal
    nodes = spark.createDataFrame([(i, 10, sig[i].tobytes()) for i in range(6)], "node long, size int, sig binary")
    members = spark.createDataFrame([(1, 0, i) for i in range(6)], "key long, band int, node long")
    labels = spark.createDataFrame([(3, 3), (4, 3), (5, 5)], "node long, label long")
    sets = spark.createDataFrame([(i, np.sort(keys[i]).tobytes()) for i in range(6)], "node long, keys binary")
    got = {(r.a, r.b) for r in B._cross_links(members, labels, nodes, sets).collect()}
    assert got == {(1, 2), (3, 5)}


def test_components_of_a_long_chain(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (7, 3), (5, 5)]
    rng.shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_follow_bytes_split():
    texts = [b"", b" a", b"a b\x0b\x0cc\r\n", "é x y z".encode(), b"\x1c\x1d \x00a"]
    hashes, counts = hash_words(texts)
    split = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts]
    table = {}
    for h, w in zip(hashes.tolist(), split, strict=True):
        assert table.setdefault(w, h) == h
    assert len(set(table.values())) == len(table)
