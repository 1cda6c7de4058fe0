"""Near-duplicate classes by BagMinHash signatures over weighted word shingles.

A document is the multiset of its five-word shingles (a text of one to four words is one shingle). For each shingle the
weight axis is cut into the dyadic intervals [0,1), [1,2), [2,4), [4,8)...; every interval carries a Poisson process of
points (time, weight, slot) that is a function of the shingle alone, and a document of count c sees the points of weight
below c. A slot's value is its earliest point; two documents agree in a slot with exactly their weighted Jaccard
similarity (sum of minima over sum of maxima) as probability. Only points up to a time that fills all slots are made,
and that time grows where it did not suffice, so signatures are exact.

Signatures are cut into bands; rows that share a band are candidates, and the exact multiset overlap decides. Links are
found in two passes that never list the pairs of a group: first every member of a band against the band's first member,
then, where a band still holds several classes, the members of the smaller classes against all others.

Scale: exact copies are folded before anything else, with partial aggregation. What is exchanged is a signature of
``SLOTS`` x 4 bytes a distinct text, ``BANDS`` keys of 16 bytes, and the texts once. A band with the copies of a third
of the corpus is a minimum and a join that Spark can split.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modengine.llm.components import components
from modengine.llm.scratch import fresh_name, kept, saved, temporary_tables
from modengine.llm.wordhash import U64, hash_words, mix, row_slices, texts_of, window_hashes
from modengine.llm.workers import tidy, tidy_group

SHINGLE = 5
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
THRESHOLD = (4, 5)
#: Agreeing slots below which a pair of 0.8 is ruled out: five standard deviations under the mean.
LEAST_AGREEING = int(SLOTS * 0.8 - 5 * (SLOTS * 0.16) ** 0.5)
#: Members of a band that one task compares with as many others.
CELL = 2000
#: Shingles (8 bytes each) of the members of a band that one task holds, about.
CELL_SHINGLES = 2_000_000
CHUNK_BYTES = 1 << 20


def shingles(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash) of all shingles, words per document, and two 64-bit hashes of each word sequence."""
    words, counts = hash_words(texts)
    ends = np.cumsum(counts)
    begins = ends - counts
    place = np.arange(len(words)) - np.repeat(begins, counts)
    doc = np.repeat(np.arange(len(texts)), counts)
    full = np.flatnonzero(np.repeat(ends, counts) - np.arange(len(words)) >= k)
    hashes = window_hashes(words, k, 307)[full] if len(full) else np.empty(0, U64)
    sums = []
    for seed in (401, 503):  # order-sensitive: each word's hash is mixed with its place
        total = np.zeros(len(texts) + 1, U64)
        np.cumsum(mix(words ^ mix(place.astype(U64) + U64(seed))), out=(run := np.zeros(len(words) + 1, U64))[1:])
        total = run[ends] - run[begins]
        sums.append(mix(total + counts.astype(U64)))
    short = np.flatnonzero((counts > 0) & (counts < k))
    return np.concatenate([doc[full], short]), np.concatenate([hashes, sums[0][short]]), counts, sums[0], sums[1]


def _weights(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with their counts."""
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, hashes = doc[order], hashes[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])])) if len(doc) else np.empty(0, np.int64)
    return doc[first], hashes[first], np.diff(np.concatenate([first, [len(doc)]]))


def _fill(doc: np.ndarray, hashes: np.ndarray, weight: np.ndarray, limit: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and times of the slots of documents 0..len(limit)-1 from all points up to each one's ``limit``."""
    times, values = np.full(len(limit) * slots, np.inf), np.zeros(len(limit) * slots, np.uint32)
    level, which = 0, np.arange(len(doc))
    while len(which):
        low, width = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        d, c = doc[which], weight[which]
        state = mix(hashes[which] + U64((level + 1) * 0xD1342543DE82EF95 % 2**64))
        t, most, point = np.zeros(len(d)), limit[d], 0
        while len(d):
            u = mix(state + U64((2 * point + 1) * 0x9E3779B97F4A7C15 % 2**64))
            t = t - np.log(((u >> U64(11)).astype(np.float64) + 1) * 2.0**-53) / (slots * width)
            alive = t <= most
            if not alive.all():
                d, c, state, t, most = d[alive], c[alive], state[alive], t[alive], most[alive]
            v = mix(state + U64((2 * point + 2) * 0x9E3779B97F4A7C15 % 2**64))
            seen = low + ((v & U64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) * width < c
            at = d[seen] * slots + (((v[seen] >> U64(32)) * U64(slots)) >> U64(32)).astype(np.int64)
            ts, vs = t[seen], (mix(v[seen] ^ U64(0x5851F42D4C957F2D)) >> U64(32)).astype(np.uint32)
            np.minimum.at(times, at, ts)
            won = times[at] == ts
            values[at[won]] = vs[won]
            point += 1
        which = which[weight[which] > low + width]
        level += 1
    return values.reshape(-1, slots), times.reshape(-1, slots)


def signatures(doc: np.ndarray, hashes: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """BagMinHash values, a row for each document; rows of documents without shingles are zero."""
    doc, hashes, weight = _weights(doc, hashes)
    total = np.bincount(doc, weight, n_docs)
    out = np.zeros((n_docs, slots), np.uint32)
    left, spread = np.flatnonzero(total), np.log(slots) + 4
    while len(left):
        number = np.full(n_docs, -1)
        number[left] = np.arange(len(left))
        own = number[doc] >= 0
        values, times = _fill(number[doc[own]], hashes[own], weight[own], spread / total[left], slots)
        done = np.isfinite(times).all(1)
        out[left[done]] = values[done]
        left, spread = left[~done], spread * 2
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows).astype(U64)
    key = np.zeros((len(sig), bands), U64) + mix(np.arange(bands, dtype=U64) + U64(17))
    for r in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


_SCAN = "doc_key long, crc long, fold binary, size int, sig binary, bands array<long>"


@tidy
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in row_slices(whole, whole.schema.names[1], CHUNK_BYTES):
            texts = texts_of(batch.column(1))
            doc, hashes, counts, one, two = shingles(texts)
            sig = signatures(doc, hashes, len(texts))
            keys = band_keys(sig, BANDS, ROWS)
            on = np.flatnonzero(counts)
            fold = np.stack([one, two], 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(on)), pa.array([zlib.crc32(texts[i]) for i in on], pa.int64()), pa.array([fold[i].tobytes() for i in on], pa.binary()), pa.array(np.maximum(1, counts[on] - SHINGLE + 1), pa.int32()), pa.array([sig[i].tobytes() for i in on], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(on) + 1) * BANDS, pa.int32()), pa.array(keys[on].ravel()))],
                ["doc_key", "crc", "fold", "size", "sig", "bands"],
            )


@tidy
def _multisets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sorted keys of (shingle, occurrence)): a multiset as a set."""
    for whole in batches:
        for batch in row_slices(whole, whole.schema.names[1], CHUNK_BYTES):
            doc, hashes, *_ = shingles(texts_of(batch.column(1)))
            order = np.lexsort((hashes, doc))
            doc, hashes = doc[order], hashes[order]
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])])[: len(doc)]
            nth = np.arange(len(doc)) - np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0)) if len(doc) else doc
            keys = mix(hashes + nth.astype(U64) * U64(0xD1342543DE82EF95))
            keys = keys[np.lexsort((keys, doc))]
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([keys[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["node", "keys"])


@tidy
def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both multisets, those at or over the threshold."""
    num, den = THRESHOLD
    for batch in batches:
        kept = []
        for row in range(batch.num_rows):
            a, b = (np.frombuffer(batch.column(i)[row].as_buffer() or b"", "<u8") for i in (2, 3))
            if len(a) and len(b) and den * min(len(a), len(b)) >= num * max(len(a), len(b)):
                shared = len(np.intersect1d(a, b, assume_unique=True))
                if den * shared >= num * (len(a) + len(b) - shared):
                    kept.append(row)
        yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(kept, pa.int64())) for i in (0, 1)], ["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose multisets overlap enough."""
    one, two = (sets.select(F.col("node").alias(x), F.col("keys").alias(f"{x}_keys")) for x in ("a", "b"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    return both.select("a", "b", "a_keys", "b_keys").mapInArrow(_overlaps, "a long, b long")


def _partners(sig: np.ndarray, band: int, i: int) -> np.ndarray:
    """Members that ``i`` may be alike to and whose first band shared with it is ``band``: each pair has one such cell."""
    same = sig == sig[i]
    near = np.flatnonzero(same.sum(1) >= LEAST_AGREEING)
    shared = same[near].reshape(len(near), BANDS, ROWS).all(2)
    return near[shared.argmax(1) == band]


def _cell(table: pa.Table) -> tuple[np.ndarray, ...]:
    node, label, minor = (table.column(c).to_numpy() for c in ("node", "label", "minor"))
    return node, label, minor, np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(node), -1)


@tidy_group
def _flagged(table: pa.Table) -> pa.Table:
    """The members of a cell that have a partner of another class there."""
    node, label, minor, sig = _cell(table)
    band, found = table.column("band")[0].as_py(), np.zeros(len(node), bool)
    for i in np.flatnonzero(minor):
        near = _partners(sig, band, i)
        near = near[label[near] != label[i]]
        found[near] = True
        found[i] |= len(near) > 0
    return table.select(["key", "node"]).filter(pa.array(found))


@tidy_group
def _cell_links(table: pa.Table) -> pa.Table:
    """Links between classes of a cell, by exact overlap; pairs that earlier links already join are not compared."""
    num, den = THRESHOLD
    node, label, minor, sig = _cell(table)
    band, keys = table.column("band")[0].as_py(), [np.frombuffer(k, "<u8") for k in table.column("keys").to_pylist()]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    a, b = [], []
    for i in np.flatnonzero(minor):
        near = _partners(sig, band, i)
        for j in near[label[near] != label[i]]:
            x, y = find(int(label[i])), find(int(label[j]))
            n, m = len(keys[i]), len(keys[j])
            if x != y and den * min(n, m) >= num * max(n, m):
                shared = len(np.intersect1d(keys[i], keys[j], assume_unique=True))
                if den * shared >= num * (n + m - shared):
                    root[max(x, y)] = min(x, y)
                    a.append(min(node[i], node[j])), b.append(max(node[i], node[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _cross_links(members: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across classes that share a band. members: (key, band, node) of bands with several nodes.

    A band's members outside its largest class are compared with all others, in cells of bounded number and size; first
    by signature, then those with a partner by their multisets. A cell gives at most as many links as it joins classes.
    """
    known = members.join(labels, "node", "left").join(nodes.select("node", "size"), "node").select("key", "band", "node", "size", F.coalesce("label", "node").alias("label"))
    sizes = saved(known.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "band-classes")
    bands = sizes.groupBy("key").agg(F.max(F.struct("n", "label", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size")).filter("n > top.n")
    chunks = lambda n, size: F.ceil(F.greatest(n / CELL, size / CELL_SHINGLES)).cast("int")
    bands = bands.select("key", F.col("top.label").alias("major"), chunks(F.col("top.n"), F.col("top.size")).alias("majors"), chunks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("minors"))
    rows = known.join(bands, "key").withColumn("minor", F.col("label") != F.col("major"))
    chunk = F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))).cast("int")
    # cells: a chunk of the major class against a chunk of the others, and two chunks of the others
    with_majors = F.transform(F.sequence(F.lit(0), F.col("majors") - 1), lambda i: F.struct(F.lit(0).alias("kind"), i.alias("i"), chunk.alias("j")))
    with_minors = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda i: F.struct(F.lit(1).alias("kind"), F.least(i, chunk).alias("i"), F.greatest(i, chunk).alias("j")))
    own = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda j: F.struct(F.lit(0).alias("kind"), chunk.alias("i"), j.alias("j")))
    # where one cell holds all, the others meet each other there
    several = F.when(~F.col("minor"), own).when((F.col("majors") == 1) & (F.col("minors") == 1), with_majors).otherwise(F.concat(with_majors, with_minors))
    rows = saved(rows.select("key", "band", "node", "label", "minor", several.alias("cells")), "band-members")
    signed = rows.withColumn("cell", F.explode("cells")).drop("cells").join(nodes.select("node", "sig"), "node")
    flagged = saved(signed.groupBy("key", "cell").applyInArrow(_flagged, "key long, node long").distinct(), "flagged")
    again = rows.join(flagged, ["key", "node"]).join(nodes.select("node", "sig"), "node").join(sets, "node")
    cells = again.withColumn("cell", F.explode("cells")).drop("cells")
    return cells.groupBy("key", "cell").applyInArrow(_cell_links, "a long, b long").distinct()


def _doc_key(id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))


def _crc(text_col: str):
    return F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Scanned rows (doc_key, crc, fold) and folded texts (fold, doc_key, crc, label)."""
    rows = docs.select(_doc_key(id_col).alias("doc_key"), F.col(text_col).cast("string").alias("t"))
    scanned = saved(rows.mapInArrow(_scan, _SCAN), "signatures")
    folded = scanned.groupBy("fold").agg(F.min(F.struct("doc_key", "crc")).alias("first"), F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = saved(folded.select(F.monotonically_increasing_id().alias("node"), "fold", "first.*", "size", "sig", "bands"), "nodes")
    band_rows = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    hubs = band_rows.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    members = saved(band_rows.join(hubs.select("key", "hub"), "key"), "members")
    star = saved(members.filter("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "star")
    involved = members.select("node").distinct().join(nodes.select("node", "doc_key", "crc"), "node")
    texts = docs.select(_doc_key(id_col).alias("doc_key"), _crc(text_col).alias("crc"), F.col(text_col).cast("string").alias("t"))
    # equal rows give a node's multiset more than once
    once = Window.partitionBy("node").orderBy("crc")
    single = texts.join(involved, ["doc_key", "crc"]).withColumn("nth", F.row_number().over(once)).filter("nth = 1")
    sets = saved(single.select("node", "t").mapInArrow(_multisets, "node long, keys binary"), "multisets")
    links = saved(_verified(star, sets), "links")
    labels = saved(components(links), "labels")
    more = saved(_cross_links(members, labels, nodes, sets), "more-links")
    if not more.isEmpty():
        labels = saved(components(links.union(more)), "labels")
    labelled = nodes.select("node", "fold", "doc_key", "crc").join(labels, "node", "left")
    return scanned.select("doc_key", "crc", "fold"), labelled.select("fold", "doc_key", "crc", F.coalesce("label", "node").alias("label"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size) for each row of ``docs``.

    class_id is the smallest id among the rows linked by word-shingle similarity of 0.8 or more, directly or through
    others. Rows without a word (null, empty, blank) are
    alone: their own class, of size 1. Rows of equal word sequences share a class; a null id counts as the smallest.
    """
    with temporary_tables(docs.sparkSession):
        scanned, folded = _classes(docs, id_col, text_col)
        folded = saved(folded, "classes")
        sizes = scanned.groupBy("fold").agg(F.count("*").alias("copies")).join(folded, "fold")
        whole = sizes.groupBy("label").agg(F.min("doc_key").alias("class_id"), F.sum("copies").alias("class_size"))
        by_fold = folded.select("fold", "label").join(whole, "label").select("fold", "class_id", "class_size")
        found = kept(scanned.join(by_fold, "fold").select("doc_key", "class_id", "class_size"), "near-duplicates")
    has_word = F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    alone = docs.filter(~has_word).select(_doc_key(id_col).alias("doc_key"), _doc_key(id_col).alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    missing = lambda c: F.when(F.col(c) != -(2**63), F.col(c))
    return found.union(alone).select(missing("doc_key").alias("doc_id"), missing("class_id").alias("class_id"), "class_size")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, the one of the smallest id; rows without a word all stay."""
    key, crc, nth = (fresh_name(docs, k) for k in ("key", "crc", "nth"))
    with temporary_tables(docs.sparkSession):
        _, folded = _classes(docs, id_col, text_col)
        first = folded.groupBy("label").agg(F.min(F.struct("doc_key", "crc")).alias("k"))
        keepers = kept(first.select(F.col("k.doc_key").alias(key), F.col("k.crc").alias(crc)), "keepers")
    wordless = ~F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.withColumns({key: _doc_key(id_col), crc: _crc(text_col)}).join(keepers.withColumn(nth, F.lit(True)), [key, crc], "left").filter(F.col(nth) | wordless)
    order = Window.partitionBy(key, crc).orderBy(key)
    return rows.withColumn(nth, F.row_number().over(order)).filter((F.col(nth) == 1) | wordless).select(*docs.columns)
