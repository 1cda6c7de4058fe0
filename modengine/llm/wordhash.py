"""Words of UTF-8 texts and their 64-bit hashes, computed with numpy over whole batches.

A word is a run of bytes other than blank and 0x09-0x0D, the same runs that ``bytes.split()`` gives. All hashes are
functions of the bytes alone, so every executor and every retry gets the same values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text hashed at once; a longer single text is taken whole.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` odd pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


_BYTE = constants(11, 256)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE_BYTES, 1 << int(n).bit_length()) + 1
    if size not in _powers:
        tables = tuple(np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, U64(b))])) for b in (_BASE, _INVERSE))
        if size > SLICE_BYTES + 1:
            return tables
        _powers[size] = tables
    return _powers[size]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of texts ``data[offsets[i]:offsets[i+1]]``, and the number in each text."""
    on = _IS_WORD[data]
    before, after = np.zeros_like(on), np.zeros_like(on)
    before[1:], after[:-1] = on[:-1], on[1:]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts, ends = np.flatnonzero(on & ~before), np.flatnonzero(on & ~after) + 1
    cuts = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(cuts)


def _hash_slice(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    if not len(data):
        return np.empty(0, U64), np.zeros(len(texts), np.int64)
    starts, ends, counts = word_bounds(data, offsets)
    power, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64)), counts


def hash_words(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text."""
    hashes, counts, part, size = [], [], [], 0
    for t in texts:
        if part and size + len(t) > SLICE_BYTES:
            h, c = _hash_slice(part)
            hashes.append(h), counts.append(c)
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        h, c = _hash_slice(part)
        hashes.append(h), counts.append(c)
    if not counts:
        return np.empty(0, U64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def window_hashes(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words (runs over text borders included; callers mask these)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    for j, c in enumerate(constants(seed, k)):
        out += words[j : j + n] * c
    return mix(out)


def texts_of(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return [t or b"" for t in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def row_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``column`` has about ``most`` bytes each, one row at least."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to
