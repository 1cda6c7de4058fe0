"""Best-fit packing of token pieces into sequences of a fixed length, with a bounded number of open sequences.

Each task packs the pieces of its share online: a piece goes to the open sequence with the least free space that still
holds it, found with a bitset over free space; if none does, a new one is opened, and when too many are open the
fullest closes. Pieces come in an order by hash, which mixes lengths, so few sequences stay badly filled.

Scale: texts are not exchanged; they are encoded where they are read and only the pieces' places and checksums (about 50
bytes each) go on. A task packs about ``SHARE`` pieces with ``OPEN`` open sequences, whatever the size of the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modengine.llm.scratch import saved
from modengine.llm.token_files import encoded
from modengine.llm.workers import tidy

LENGTH = 2048
OPEN = 1024
SHARE = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """At most ``most`` open sequences of ``size`` places, in a bitset keyed by free space."""

    def __init__(self, size: int = LENGTH, most: int = OPEN):
        self.size, self.most, self.bits, self.open, self.made = size, most, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of ``length``, 1 to ``size``."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            number, free = self.made, self.size
            self.made += 1
        rest = free - length
        if rest:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[rest].append(number)
            self.bits |= 1 << rest
            self.open += 1
        return number, self.size - free


def _pieces(path: str, length: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, ends in encoded(batches, path):
            starts = np.concatenate([[0], ends[:-1]])
            parts = -(-(ends - starts) // length)
            row = np.repeat(np.arange(len(ends)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            begin = starts[row] + piece * length
            stop = np.minimum(begin + length, ends[row])
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * begin).tolist(), (4 * stop).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * length), pa.array(stop - begin), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _pack(length: int, most: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(length, most), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, most_open: int = OPEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: PIECES, sequence_id, offset.

    A document is its ids and the end id 0 (null text: only that); only one longer than ``length`` is cut, into pieces
    of ``length`` and a last shorter one. Every row of ``docs`` is a document of its own, equal ids or not. Numbers of
    sequences are unique but not consecutive. The empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = saved(rows.mapInArrow(_pieces(tokenizer, length), PIECES), "pieces")
    shares = max(1, -(-pieces.count() // SHARE))
    order = F.xxhash64("ids_crc32", "doc_id", "piece")
    mixed = pieces.repartition(shares, order).sortWithinPartitions(order, "doc_id", "piece", "length")
    return mixed.mapInArrow(_pack(length, most_open), PIECES + ", sequence_id long, offset long")
