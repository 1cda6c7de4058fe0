"""WARC, nearest neighbours, mixing and the pipeline against brute force, with hard inputs."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from modengine.llm import ann, mixing, warc

PAGE = "page_id long, url string, html string, digest string"


def pages():
    rng = random.Random(3)
    big = "<html>" + "é" * 700 + "</html>"
    inner = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(i, f"http://h/{i}", f"<p>{rng.random()}</p>" * rng.randrange(1, 60)) for i in range(60)]
    rows += [(100 + i, "http://same/", big) for i in range(7)] + [(200 + i, "u", "short") for i in range(3)]
    rows += [(300, "u", inner), (301, "u", "a" * 1000 + inner * 3), (302, "u", "a" * 1000 + inner * 3), (303, "u", "WARC/1.0\r\n"), (304, "u\r\nContent-Length: 3", "x WARC/1.0\r\nbroken")]
    rows += [(400, None, None), (401, "u", ""), (402, "u", "\r\n\r\n"), (403, "u", "line\r\n\r\n\r\n"), (-5, "u", "日本語 " * 400), (500, "u", big), (500, "u", big), (None, "u", "no id")]
    rng.shuffle(rows)
    return [(*r, "clash") for r in rows]


def test_warc_round_trip(spark):
    rows = pages()
    largest = defaultdict(lambda: None)
    for i, _, html, _ in rows:
        b = (html or "").encode()
        if i is not None and len(b) >= 1000:
            largest[b] = max(i, largest[b] if largest[b] is not None else i)
    want = Counter()
    for i, _, html, _ in rows:
        b = (html or "").encode()
        origin = largest[b]
        revisit = origin is not None and i != origin
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", origin if revisit else None)] += 1
    for n in (1, 6):
        docs = spark.createDataFrame(rows, PAGE).repartition(n)
        assert Counter(tuple(r) for r in warc.warc_round_trip(docs).collect()) == want
    assert warc.warc_round_trip(spark.createDataFrame([], PAGE)).count() == 0


def test_warc_shuffled_groups_equal_broadcast_ones(spark, tmp_path):
    docs = spark.createDataFrame(pages(), PAGE)
    warc.write_warc(docs, f"file://{tmp_path}/a", broadcast_groups=0)
    got = Counter(tuple(r) for r in warc.read_warc(spark, f"file://{tmp_path}/a").collect())
    assert got == Counter(tuple(r) for r in warc.warc_round_trip(docs).collect())


def test_warc_splits_of_a_file(spark, tmp_path):
    """Splits smaller than a record, so candidates of one file come from many tasks."""
    warc.write_warc(spark.createDataFrame(pages(), PAGE).coalesce(1), f"file://{tmp_path}/a")
    whole = Counter(tuple(r) for r in warc.read_warc(spark, f"file://{tmp_path}/a").collect())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert Counter(tuple(r) for r in warc.read_warc(spark, f"file://{tmp_path}/a").collect()) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_warc_scans_with_different_splits_agree(spark, tmp_path):
    """The second scan, for records that hold the magic, is cut into other tasks than the first."""
    warc.write_warc(spark.createDataFrame(pages(), PAGE).coalesce(1), f"file://{tmp_path}/a")
    path, before = f"file://{tmp_path}/a", spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    try:
        for first, second in ((2000, 2000), (2000, 3000), (700, 100_000)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(first))
            records = warc.saved(warc.verified(warc.saved(warc.candidates(spark, path), "places")), "records")
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(second))
            split = records.filter("payload_digest is null")
            found.append(Counter(tuple(r) for r in warc._joined(spark, path, split).select("at", "joined_bytes", "joined_digest").collect()))
            assert len(found[-1]) == split.count() >= 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] == found[2]


def test_warc_other_versions_and_broken_files(spark, tmp_path):
    record = lambda v, i, body: f"WARC/{v}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body) + 19}\r\n\r\nHTTP/1.1 200 OK\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_text(record("1.1", 1, "one WARC/1.1\r\nx") + record("1.0", 2, "two") + record("1.1", 3, "WARC/1.2 WARC/1.0"), newline="")
    (tmp_path / "w" / "b.warc").write_text(record("1.1", 4, "four") + record("1.1", 5, "cut off here")[:-14], newline="")
    (tmp_path / "w" / "c.warc").write_text("junk" + record("1.1", 6, "not reached"), newline="")
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()}
    sha = lambda s: (len(s), hashlib.sha1(s.encode()).hexdigest())
    assert got == {1: sha("one WARC/1.1\r\nx"), 2: sha("two"), 3: sha("WARC/1.2 WARC/1.0"), 4: sha("four"), 5: sha("cu")}


def test_warc_jumps_over_chained_fakes(spark):
    """Fakes whose chain leads back into the real one are reached only from where it does."""
    real = [(0, 100), (100, 250), (250, 300), (300, 400), (400, 500)]
    fakes = [(120, 140), (140, 250), (310, 320), (320, 380), (330, None), (420, 500), (450, 9999)]
    rows = [("f", a, b) for a, b in real + fakes] + [("g", 0, 10), ("g", 5, 20), ("g", 10, 20)]
    found = spark.createDataFrame(rows, "file string, at long, next long")
    got = sorted((r.file, r.at) for r in warc.verified(found).collect())
    assert got == [*(("f", a) for a, _ in real), ("g", 0), ("g", 10)]


def test_nearest_equals_brute_force_on_a_small_table(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 12)).round(3)
    rows = [(i, [float(v) for v in x[i]], "l") for i in range(300)]
    rows += [(400 + i, rows[0][1], "l") for i in range(40)] + [(i, [float(-v) for v in x[5]], "l") for i in (700, 800)]
    rows += [(1100 + i, [float(i + 1), float(i % 2)], "l") for i in range(5)] + [(1200, [1.0, 0.0], "l"), (1300, [2.5] * 3, "l")]  # other lengths
    rows += [(1400 + i, [(i + 1) * 1e-30] * 5, "l") for i in range(3)] + [(1500 + i, [(i - 1.5) * 1e30, 1e29, 0.0, 0.0], "l") for i in range(3)]  # tiny, huge
    rows += [(900, None, "l"), (901, [0.0] * 12, "l"), (902, [float("nan")] * 12, "l"), (903, [None] * 12, "l"), (904, [float("inf")] + [1.0] * 11, "l"), (None, [1.0] * 12, "l"), (500, rows[1][1], "l"), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    usable = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    want = {}
    for q in {i for i, _ in usable if i % 100 == 0}:
        best = {}
        for qi, qv in usable:
            if qi == q:
                for i, v in usable:
                    if i != q and len(v) == len(qv):
                        best[i] = min(best.get(i, np.inf), float(np.sqrt(((v - qv) ** 2).sum())))
        if best:
            want[q] = [(float(f"{d:.9g}"), i) for d, i in sorted((d, i) for i, d in best.items())[:10]]
    for cell, some in ((20_000, 2_000), (7, 2)):
        before = ann.CELL, ann.ASKED
        ann.CELL, ann.ASKED = cell, some
        try:
            got = defaultdict(list)
            for r in ann.nearest(df, df.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
                got[r.query_id].append((float(f"{r.score:.9g}"), r.vec_id))
        finally:
            ann.CELL, ann.ASKED = before
        hits = sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
        assert set(got) == set(want) and hits >= 0.97 and got[500][:2] == want[500][:2]
    assert ann.nearest(df.limit(0), df).count() == 0


@pytest.mark.parametrize("n", [2_000, 30_000])
def test_recall_on_clustered_vectors(n):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 64))
    x = centres[rng.integers(0, 40, n)] * 0.9 + rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    widths = ann.layout(n, 64)
    tables, probes = ann.effort(widths)
    asked = np.arange(0, n, n // 60)
    seen = [set() for _ in asked]
    for t in range(tables):
        keys, probed = ann._keys(x, t, widths, 1)[:, 0], ann._keys(x[asked], t, widths, probes)
        for s, p in zip(seen, probed, strict=True):
            s.update(np.flatnonzero(np.isin(keys, p)).tolist())
    recall = np.mean([len(s & set(np.argsort(((x - x[q]) ** 2).sum(1))[:10].tolist())) / 10 for s, q in zip(seen, asked, strict=True)])
    assert recall >= 0.9


def test_recall_through_buckets(spark):
    """The Spark operator where a question reads a part of the table only, and clusters with equal and near vectors."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12_000, 32)).astype(np.float32)
    x[3000:6000] = x[3000] + 0.01 * rng.normal(size=(3000, 32))
    x[6000:7000] = x[6000]
    widths = ann.layout(11_001, 32)
    tables, probes = ann.effort(widths)
    assert np.prod([2 * w for w in widths]) > probes  # not all buckets are read
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = defaultdict(list)
    for r in ann.nearest(df, df.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for q in range(0, 12_000, 100):
        d = ((x.astype(float) - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(got[q]) & set(np.lexsort((np.arange(len(d)), d))[:10].tolist()))
    assert len(got) == 120 and hits >= 0.95 * 1200


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(ann.hadamard(ann.hadamard(x)), x)
    assert np.allclose(np.linalg.norm(ann.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, topic string, weight string")


def corpus():
    rng = random.Random(9)
    rows = []
    for i in range(400):
        topic = rng.randrange(3)
        text = " ".join(f"t{topic}x{rng.randrange(12)}" for _ in range(rng.randrange(5, 60)))
        rows.append((i, text, rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c"]), len(text), "clash", "clash"))
    return [*rows, (1000, None, "en", "a", None, "x", "x"), (1001, "", None, None, 0, "x", "x"), (None, "null id doc", "en", "b", 0, "x", "x"), rows[3]]


def test_mixture_meets_targets(spark):
    df = docs_of(spark, corpus()).repartition(3)
    targets = {"source": {"a": 0.4, "b": 0.35, "c": 0.25}, "lang": {"en": 0.5, "de": 0.3, None: 0.2}}
    rows = mixing.mixture(df, targets, budget=0.4).collect()
    assert len(rows) == len(corpus())
    total = sum(r.n_tokens for r in rows)
    assert total == sum(len((t or "").split()) for _, t, *_ in corpus())
    for d in ("source", "lang"):
        for value, share in targets[d].items():
            assert sum(r.n_tokens * r.weight for r in rows if r[d] == value) / total == pytest.approx(share, abs=1e-6)
            drawn = sum(r.n_tokens * r.probability * r.multiplier for r in rows if r[d] == value)
            assert drawn / sum(r.n_tokens * r.probability * r.multiplier for r in rows) == pytest.approx(share, abs=1e-6)
    assert sum(r.n_tokens * r.probability for r in rows) == pytest.approx(0.4 * total, rel=1e-6)
    assert abs(sum(r.n_tokens for r in rows if r.sampled) / total - 0.4) < 0.15
    out = mixing.sample_mixture(df, targets, budget=0.4)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in rows if r.sampled)
    assert mixing.mixture(df.limit(0)).count() == 0


def test_mixture_over_many_cells_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-6)
    df = docs_of(spark, corpus())
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    small, large = (sorted(mixing.mixture(df, budget=0.6, driver_cells=n).collect(), key=key) for n in (10_000, 0))
    assert [r.doc_id for r in small] == [r.doc_id for r in large]
    for a, b in zip(small, large, strict=True):
        assert a.weight == pytest.approx(b.weight, rel=1e-4, abs=1e-9) and a.probability == pytest.approx(b.probability, rel=1e-4, abs=1e-9)


@pytest.mark.parametrize("driver_cells", [10_000, 0])
def test_mixture_equals_plain_arithmetic(spark, driver_cells, monkeypatch):
    """Weights, probabilities, draws and rows against dictionaries and bisection, on skewed data where cells are cut at 1."""
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-6 if driver_cells == 0 else mixing.TOLERANCE)  # fewer written rounds
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 40))), "en" if i % 9 else "xx", "hot" if i % 3 else f"s{i % 40}", 0, "x", "x") for i in range(300)]
    df = docs_of(spark, rows).repartition(3)
    got = mixing.mixture(df, {"lang": {"en": 0.5, "xx": 0.5, "none": 0.1}}, budget=0.7, driver_cells=driver_cells).collect()
    cells = Counter()
    for r in got:
        assert r.n_tokens == len(rows[r.doc_id][1].split())
        cells[r.source, r.lang, r.topic] += r.n_tokens
    total, mass = sum(cells.values()), {c: float(n) for c, n in cells.items()}
    targets = []
    for d in range(3):
        have = Counter()
        for c, n in cells.items():
            have[c[d]] += n
        raised = {v: n**0.7 for v, n in have.items()} if d != 1 else {"en": 0.5, "xx": 0.5}
        targets.append({v: total * x / sum(raised.values()) for v, x in raised.items()})
    for _ in range(500):
        for d in range(3):
            have = Counter()
            for c, m in mass.items():
                have[c[d]] += m
            mass = {c: m * targets[d][c[d]] / have[c[d]] for c, m in mass.items()}
    weight = {c: mass[c] / cells[c] for c in cells}
    low, high = 0.0, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(n * min(1, middle * weight[c]) for c, n in cells.items()) < 0.7 * total else (low, middle)
    draws = {r.doc_id: r.u for r in df.selectExpr("doc_id", f"pmod(xxhash64({mixing.SEED + 1}, doc_id), {1 << 53}L) / {float(1 << 53)}D AS u").collect()}
    cut = 0
    for r in got:
        c = (r.source, r.lang, r.topic)
        p = min(1.0, high * weight[c])
        cut += p == 1.0
        assert r.weight == pytest.approx(weight[c], rel=1e-3) and r.probability == pytest.approx(p, rel=1e-3)
        assert r.multiplier == pytest.approx(high * weight[c] / p, rel=1e-3)
        assert r.sampled == (draws[r.doc_id] < r.probability)
    assert cut and len(got) == 300
    if driver_cells == 0:
        return
    kept = mixing.sample_mixture(df, {"lang": {"en": 0.5, "xx": 0.5, "none": 0.1}}, budget=0.7, driver_cells=driver_cells).collect()
    assert sorted(tuple(r) for r in kept) == sorted(rows[r.doc_id] for r in got if r.sampled)


def test_raking_and_scale():
    tokens = np.array([10.0, 20, 30, 40, 0])
    codes = [np.array([0, 0, 1, 1, 0]), np.array([0, 1, 0, 1, 2])]
    w = mixing.rake(tokens, codes, [np.array([0.5, 0.5]), np.array([0.7, 0.3, 0.1])])
    mass = tokens * w
    assert np.allclose(np.bincount(codes[0], mass), [50, 50]) and np.allclose(np.bincount(codes[1], mass)[:2], [70, 30])
    for budget in (1.0, 50.0, 99.0, 100.0):
        f = mixing.scale(tokens, w, budget)
        assert (tokens * np.minimum(1, f * w)).sum() == pytest.approx(budget)


def test_bounded_probabilities_meet_marginals_that_cut_ones_miss():
    tokens = np.array([6000.0, 3000, 980, 12, 8])
    codes = [np.array([0, 1, 0, 2, 2]), np.array([0, 0, 1, 0, 1])]
    targets = [np.array([0.55, 0.448, 0.002]), np.array([0.92, 0.08])]
    w = mixing.rake(tokens, codes, targets)
    cut = np.minimum(1, mixing.scale(tokens, w, 7000) * w)
    p = mixing.bounded_probabilities(tokens, codes, targets, cut, 7000)
    assert (cut == 1).any() and (p >= 0).all() and (p <= 1).all() and (tokens * p).sum() == pytest.approx(7000)
    # 7000 x 0.448 is more than the 3000 there are: they are all drawn, and the two others share the rest by their targets
    assert np.bincount(codes[1], tokens * p) == pytest.approx(7000 * targets[1])
    want = np.array([4000 * 0.55 / 0.552, 3000, 4000 * 0.002 / 0.552])
    assert np.bincount(codes[0], tokens * p) == pytest.approx(want, rel=1e-3)
    assert len(mixing.bounded_probabilities(np.zeros(0), [np.zeros(0, int)], [np.zeros(0)], np.zeros(0), 0.0)) == 0


@pytest.mark.parametrize("driver_cells", [10_000, 0])
def test_bounded_mixture(spark, driver_cells, monkeypatch):
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-4 if driver_cells == 0 else mixing.TOLERANCE)
    monkeypatch.setattr(mixing, "TOPICS", 1)
    rows = [(i, "some words of a document here", "en" if i % 2 else "de", "rare" if i % 50 == 0 else "a" if i % 3 else "b", 0, "x", "x") for i in range(300)]
    df = docs_of(spark, rows).repartition(3)
    targets = {"source": {"a": 0.6, "b": 0.35, "rare": 0.05}, "lang": {"en": 0.5, "de": 0.5}}
    got = mixing.mixture(df, targets, budget=0.5, driver_cells=driver_cells, bounded=True).collect()
    share = lambda d, v: sum(r.probability for r in got if r[d] == v) / 150
    # six rows of "rare", all German, are at most 6/150; what is short goes to the other sources alike
    assert share("source", "rare") == pytest.approx(0.04, abs=1e-3) and share("source", "a") == pytest.approx(0.96 * 0.6 / 0.95, abs=1e-3)
    assert share("lang", "en") == pytest.approx(0.5, abs=1e-3)
    drawn = mixing.sample_mixture(df, targets, budget=0.5, driver_cells=driver_cells, bounded=True).collect()
    assert Counter(r.doc_id for r in drawn) == Counter(r.doc_id for r in got if r.sampled)
    assert mixing.sample_mixture(df.limit(0), driver_cells=driver_cells, bounded=True).count() == 0


def test_topics_separate_vocabularies():
    rng = np.random.default_rng(0)
    base = rng.random((3, mixing.FEATURES)) ** 6
    x = np.concatenate([base[t] + 0.02 * rng.random((50, mixing.FEATURES)) for t in range(3)])
    centres = mixing.fit_topics(x, 3)
    own = np.argmax(x @ centres.T, 1).reshape(3, 50)
    assert all(len(set(r)) == 1 for r in own) and len({r[0] for r in own}) == 3


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(11)
    words = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    passage = words(60)
    rows = [(i, " ".join(words(80)), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, " ".join(words(60) + passage + words(60)), "de", "s0", 0) for i in range(6)]
    rows += [(200 + i, rows[0][1] + " " * i, "en", "s0", 0) for i in range(5)] + [(300, "### " * 90, "en", "s0", 0), (301, "again and " * 60, "en", "s1", 0), (302, None, "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "substring_dedup", "mix_sources", "pack_sequences"]
    good = stage["quality"](spark, docs, str(tmp_path)).cache()
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(good) == [*range(60), *range(100, 106), *range(200, 205)]
    single = stage["near_dedup"](spark, good, str(tmp_path)).cache()
    assert ids(single) == [*range(60), *range(100, 106)]
    cut = stage["substring_dedup"](spark, single, str(tmp_path)).cache()
    lengths = {r.doc_id: len(r.text.split()) for r in cut.collect()}
    assert lengths[100] == 180 and all(lengths[100 + i] == 120 for i in range(1, 6)) and cut.columns == docs.columns
    mixed = stage["mix_sources"](spark, cut, str(tmp_path)).cache()
    assert set(ids(mixed)) < set(ids(cut)) and mixed.columns == docs.columns
    packed = P.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in packed}) == ids(mixed)


def test_topics_are_fitted_on_all_documents(spark, monkeypatch):
    """A vocabulary outside the sample moves the centres; ids, copies and partitions do not choose the sample."""
    monkeypatch.setattr(mixing, "SAMPLE", 20)
    rng = random.Random(5)
    texts = [" ".join(f"t{i % 3}x{rng.randrange(9)}" for _ in range(30)) for i in range(300)] + ["same words again"] * 150 + [None, ""]
    rows = [(i, t, "en", "a", 0, "x", "x") for i, t in enumerate(texts)]
    f = mixing._frequencies([(t or "").encode() for t in texts])[1].astype(float)
    x = f / np.maximum(np.linalg.norm(f, axis=1, keepdims=True), 1e-12)
    seen = []
    refine = mixing.refine_topics
    monkeypatch.setattr(mixing, "refine_topics", lambda *a, **k: seen.append(refine(*a, **k)) or seen[-1])
    parts = []
    for n, ids in ((1, True), (5, True), (3, False)):
        df = docs_of(spark, rows if ids else [(None, *r[1:]) for r in rows]).repartition(n)
        parts.append(Counter((r.n_tokens, r.topic) for r in mixing.mixture(df).collect()))
    assert parts[0] == parts[1] == parts[2] and len({t for _, t in parts[0]}) > 3
    centres = seen[0]
    assert all(np.array_equal(centres, c) for c in seen)
    own = np.argmax(x @ centres.T, 1)
    for t in range(len(centres)):
        s = x[own == t].sum(0)
        assert not s.any() or np.allclose(s / np.linalg.norm(s), centres[t], atol=1e-5)


def test_recall_on_even_vectors():
    """No close neighbours, as in the test table at its largest: 99 of 100 true neighbours are found."""
    n = 51_282
    x = np.random.default_rng(0).normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    widths = ann.layout(n, 64)
    tables, probes = ann.effort(widths)
    asked = np.arange(0, n, n // 200)
    seen = np.zeros((len(asked), n), bool)
    for t in range(tables):
        keys, probed = ann._keys(x, t, widths, 1)[:, 0], ann._keys(x[asked], t, widths, probes)
        for s, p in zip(seen, probed, strict=True):
            s |= np.isin(keys, p)
    near = np.argsort(-(x[asked] @ x.T), 1)[:, 1:11]
    assert np.take_along_axis(seen, near, 1).mean() >= 0.99
