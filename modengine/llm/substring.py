"""Substring dedup by relative Lempel-Ziv parsing against a distributed reference index.

Every document is factored against all text that comes before it (smaller id, or the same document further left). The
reference is indexed in blocks: a 20-word seed belongs to the block that the smallest hash among its 6-word grams picks
(so neighbouring seeds mostly go together, as one run with one location), and a block's index maps a seed to its first
occurrence. In each block a document is parsed greedily from left to right: the next seed is looked up, the factor that it
opens is extended along the reference as far as both go on alike, and the parse jumps behind it. The seed at a factor's
end, whose window straddles that end, is looked up next, so a factor that starts inside the tail of another one is found.
A factor holds at least one seed, so it has ``window`` words or more, and its words are a duplicate span.

Scale: one exchange of about 10 bytes a word, one of the texts. A map task first parses each buffer of its own documents
against the buffer, and only the first occurrence of a seed there goes on, so a passage that a third of all documents
share reaches its block once a buffer. Blocks are sized from the corpus; the seeds are counted by block before, and a
block with more than ``BLOCK_SEEDS`` (a gram of some boilerplate with varying rest) is split by seed. Seeds are told apart
by 64 bits besides the independent bits that choose the block; equal words always agree, different ones do not but with
a chance of 2^-64 a pair of seeds in a block.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modengine.llm.scratch import fresh_name
from modengine.llm.wordhash import U64, hash_words, mix, texts_of, window_hashes
from modengine.llm.workers import tidy, tidy_group

WINDOW = 20
GRAM = 6
#: Text bytes whose seeds one reference block holds, and that a map task buffers.
BLOCK_BYTES = 8 << 20
BUFFER_BYTES = 6 << 20
#: Tasks that blocks are dealt to, at most.
TASKS = 20_000
#: Seeds (8 bytes each) of a block beyond which it is split.
BLOCK_SEEDS = 4_000_000

SEEDS = "block long, docs binary, crcs binary, starts binary, lengths binary, seeds binary, spans binary"
SPANS = "doc_key long, crc long, start int, seeds int, ref_doc long, ref_start int"
_SPAN = np.dtype([("doc", "<i8"), ("crc", "<u4"), ("start", "<u4"), ("n", "<u4"), ("ref", "<i8"), ("ref_start", "<u4")])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values."""
    n, have, out = len(x) - w + 1, 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[:n], out[w - have : w - have + n])
    return out[:n]


def _parse(doc: np.ndarray, crc: np.ndarray, pos: np.ndarray, seeds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Greedy factors of seeds in order of (doc, crc, pos); ``first`` is the index of each seed's first occurrence."""
    n = len(seeds)
    hit = (doc[first] != doc) | (pos[first] < pos)
    hits = np.flatnonzero(hit)
    if not len(hits):
        return np.empty(0, _SPAN)
    ends = np.flatnonzero(np.concatenate([(doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1]) | (pos[1:] != pos[:-1] + 1), [True]]))
    room = ends[np.searchsorted(ends, np.arange(n))] + 1 - np.arange(n)  # seeds up to the end of a stretch
    most, rank = np.minimum(room[hits], room[first[hits]]).tolist(), np.concatenate([[0], np.cumsum(hit)])
    start, ref, opened, length, at = hits.tolist(), first[hits].tolist(), [], [], 0
    while at < len(start):
        i, r, limit, size, step = start[at], ref[at], most[at], 1, 16
        while size < limit:
            to = min(limit, size + step)
            other = seeds[i + size : i + to] != seeds[r + size : r + to]
            far = int(other.argmax())
            if other[far]:
                size += far
                break
            size, step = to, step * 4
        opened.append(i)
        length.append(size)
        at = int(rank[i + size])
    i = np.array(opened)
    out = np.empty(len(i), _SPAN)
    out["doc"], out["crc"], out["start"], out["n"], out["ref"], out["ref_start"] = doc[i], crc[i], pos[i], length, doc[first[i]], pos[first[i]]
    return out


def _first_in_order(seeds: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Index of the first of each seed's equals in ``order``, which puts equal seeds side by side."""
    new = np.concatenate([[True], seeds[order][1:] != seeds[order][:-1]])
    first = np.empty(len(order), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return first


def _buffer_seeds(rows: list[tuple[int, bytes]], window: int, gram: int, blocks: int, split: dict[int, int]) -> Iterator[dict]:
    """Runs of seeds by block, and the factors that this buffer of documents has within itself.

    Blocks in ``split`` are dealt out by seed to that many; such a part has the number block + blocks x part.
    """
    rows.sort(key=lambda r: (r[0], zlib.crc32(r[1])))
    words, counts = hash_words([t for _, t in rows])
    ends = np.cumsum(counts)
    room = np.repeat(ends, counts) - np.arange(len(words))  # words left in the document
    at = np.flatnonzero(room[: max(0, len(words) - window + 1)] >= window)
    if not len(at):
        return
    seeds = window_hashes(words, window, 101)[at]
    lead = _sliding_min(window_hashes(words, gram, 211), window - gram + 1)[at]
    which = np.searchsorted(ends, at, "right")
    ids, crcs = np.array([r[0] for r in rows], np.int64), np.array([zlib.crc32(t) for _, t in rows], np.uint32)
    doc, crc, pos = ids[which], crcs[which], at - (ends - counts)[which]
    # rows that share an id: first by place, not by row
    order = np.argsort(seeds, kind="stable") if len(ids) == len(np.unique(ids)) else np.lexsort((pos, doc, seeds))
    first = _first_in_order(seeds, order)
    hit = (doc[first] != doc) | (pos[first] < pos)
    spans = _parse(doc, crc, pos, seeds, first)
    keep = np.flatnonzero(~hit)
    doc, crc, pos, seeds, lead = doc[keep], crc[keep], pos[keep], seeds[keep], lead[keep]
    block = (mix(lead) % U64(blocks)).astype(np.int64)
    if split:
        hot = np.array(sorted(split), np.int64)
        place = np.minimum(np.searchsorted(hot, block), len(hot) - 1)
        parts = np.where(hot[place] == block, np.array([split[b] for b in hot.tolist()], np.int64)[place], 1)
        block = block + blocks * (mix(seeds ^ U64(0x5851F42D4C957F2D)) % parts.astype(U64)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (pos[1:] != pos[:-1] + 1) | (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1])]))
    length = np.diff(np.concatenate([start, [len(seeds)]]))
    block = block[start]
    order = np.argsort(block, kind="stable")
    start, length, block = start[order], length[order], block[order]
    take = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
    seeds = seeds[take]
    cut, seed_at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])), np.concatenate([[0], np.cumsum(length)])
    home = int(block[0]) if len(block) else 0
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        r = start[a:b]
        yield {"block": int(block[a]), "docs": doc[r].tobytes(), "crcs": crc[r].tobytes(), "starts": pos[r].astype("<u4").tobytes(), "lengths": length[a:b].astype("<u4").tobytes(), "seeds": seeds[seed_at[a] : seed_at[b]].tobytes(), "spans": spans.tobytes() if block[a] == home else b""}


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
    rows, size = [], 0
    for batch in batches:
        ids, column = batch.column(0).to_pylist(), batch.column(1)
        for i in range(0, len(ids), 512):
            for key, text in zip(ids[i : i + 512], texts_of(column.slice(i, 512)), strict=True):
                if rows and size + len(text) > BUFFER_BYTES:
                    yield rows
                    rows, size = [], 0
                rows.append((key, text))
                size += len(text)
    if rows:
        yield rows


def _seed_scan(window: int, gram: int, blocks: int, split: dict[int, int], schema: pa.Schema):
    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buffers(batches):
            out = list(_buffer_seeds(rows, window, gram, blocks, split))
            for i in range(0, len(out), 256):
                yield pa.RecordBatch.from_pylist(out[i : i + 256], schema)

    return scan


def _seed_counts(window: int, gram: int, blocks: int):
    """Seeds by block of each buffer: what differs within the buffer counts once, as in the scan."""

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buffers(batches):
            words, counts = hash_words([t for _, t in rows])
            ends = np.cumsum(counts)
            room = np.repeat(ends, counts) - np.arange(len(words))
            at = np.flatnonzero(room[: max(0, len(words) - window + 1)] >= window)
            if len(at):
                _, once = np.unique(window_hashes(words, window, 101)[at], return_index=True)
                lead = _sliding_min(window_hashes(words, gram, 211), window - gram + 1)[at[once]]
                block, n = np.unique((mix(lead) % U64(blocks)).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(n, pa.int64())], ["block", "n"])

    return scan


@tidy_group
def _block_factors(table: pa.Table) -> pa.Table:
    """One reference block: index its seeds by first occurrence and give the factors of all later ones."""
    join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    length, seeds = join("lengths", "<u4").astype(np.int64), join("seeds", "<u8")
    run = np.repeat(np.arange(len(length)), length)
    inside = np.arange(len(seeds)) - np.repeat(np.cumsum(length) - length, length)
    order = np.argsort(seeds, kind="stable")
    same = seeds[order][1:] == seeds[order][:-1]
    met = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]  # only seeds found again
    spans = join("spans", _SPAN)
    if len(met):
        run, inside, seeds = run[met], inside[met], seeds[met]
        doc, crc, pos = join("docs", "<i8")[run], join("crcs", "<u4")[run], join("starts", "<u4")[run].astype(np.int64) + inside
        order = np.lexsort((pos, crc, doc))
        doc, crc, pos, seeds = doc[order], crc[order], pos[order], seeds[order]
        spans = np.concatenate([spans, _parse(doc, crc, pos, seeds, _first_in_order(seeds, np.lexsort((pos, doc, seeds))))])
    return pa.table({"doc_key": spans["doc"], "crc": spans["crc"].astype(np.int64), "start": spans["start"].astype(np.int32), "seeds": spans["n"].astype(np.int32), "ref_doc": spans["ref"], "ref_start": spans["ref_start"].astype(np.int32)})


def _key(id_column: Column) -> Column:
    return F.coalesce(id_column.cast("long"), F.lit(-(2**63)))


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Factors that documents share with earlier text: ``SPANS``, each ``window + seeds - 1`` words from ``start``.

    Null text has no words; a null id comes before all others. Rows with one id are one document for the order: a
    place in one of them is a repeat of an earlier place in another, not of the same place. ``crc`` (of the text) tells
    such rows apart.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    schema = pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("docs", "crcs", "starts", "lengths", "seeds", "spans")]])
    rows = docs.select(_key(F.col(id_col)).alias("k"), F.col(text_col).cast("string").alias("t"))
    counts = rows.mapInArrow(_seed_counts(window, gram, blocks), "block long, n long").groupBy("block").agg(F.sum("n").alias("n"))
    split = {r["block"]: -(-r["n"] // BLOCK_SEEDS) for r in counts.filter(F.col("n") > BLOCK_SEEDS).collect()}  # one entry for BLOCK_SEEDS seeds at most
    seeds = rows.mapInArrow(_seed_scan(window, gram, blocks, split, schema), SEEDS)
    # a task has a few blocks however large the corpus is
    return seeds.repartition(min(blocks, TASKS), "block").groupBy("block").applyInArrow(_block_factors, SPANS)


def _with_spans(docs: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, dict[str, str]]:
    """All rows of ``docs`` with the starts and lengths (in seeds) of their factors."""
    names = {k: fresh_name(docs, k) for k in ("key", "crc", "starts", "seeds")}
    spans = factors(docs, id_col, text_col, window).groupBy("doc_key", "crc").agg(F.collect_list("start").alias(names["starts"]), F.collect_list("seeds").alias(names["seeds"]))
    spans = spans.withColumnsRenamed({"doc_key": names["key"], "crc": names["crc"]})
    keyed = docs.withColumns({names["key"]: _key(F.col(id_col)), names["crc"]: F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))})
    return keyed.join(spans, [names["key"], names["crc"]], "left"), names


def _covered(n: int, starts: list[int], seeds: list[int], window: int) -> np.ndarray:
    delta = np.zeros(n + 1, np.int64)
    s = np.asarray(starts, np.int64)
    np.add.at(delta, s, 1)
    np.add.at(delta, np.minimum(n, s + np.asarray(seeds, np.int64) + window - 1), -1)
    return np.cumsum(delta[:-1]) > 0


def _digests(window: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                n_words, n_removed, sha = [], [], []
                for text, starts, seeds in zip(texts_of(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    words = text.split()
                    n_words.append(len(words))
                    if starts:
                        gone = _covered(len(words), starts, seeds, window)
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    n_removed.append(n_words[-1] - len(words))
                    sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def substring_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space).

    Null and blank texts have no words and the digest of the empty string.
    """
    joined, names = _with_spans(docs, id_col, text_col, window)
    rows = joined.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), names["starts"], names["seeds"])
    return rows.mapInArrow(_digests(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _cut(window: int, column: int):
    import re

    word = re.compile(rb"[^\x20\x09-\x0D]+")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = part.column(column)
                out = texts.to_pylist()
                for row, (starts, seeds) in enumerate(zip(part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True)):
                    if not starts:
                        continue
                    text = out[row].encode()
                    bounds = [m.span() for m in word.finditer(text)]
                    gone = _covered(len(bounds), starts, seeds, window)
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                    pieces, at = [], 0
                    for a, b in zip(edge[::2], edge[1::2], strict=True):  # words a..b-1 go, with the blanks behind them
                        pieces.append(text[at : bounds[a][0]])
                        at = bounds[b][0] if b < len(bounds) else len(text)
                    out[row] = b"".join([*pieces, text[at:]]).decode()
                columns = [part.column(j) if j != column else pa.array(out, texts.type) for j in range(part.num_columns - 2)]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-2])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with every word that a repeated window covers cut out of ``text_col``; other bytes stay as they are.

    All rows and columns stay (a text may become empty or null stay null); an integer column ``n_chars`` is set to the
    new length where there is one.
    """
    joined, names = _with_spans(docs, id_col, text_col, window)
    rows = joined.select(*docs.columns, names["starts"], names["seeds"])
    out = rows.mapInArrow(_cut(window, docs.columns.index(text_col)), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
