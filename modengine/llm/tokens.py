"""Token ids of whole texts, equal to those of the tokenizers library, with numpy over slices of texts.

Both supported tokenizer kinds cut text into words before they merge bytes. Some places between two characters are such
cuts whatever stands around them: behind a visible character and before a blank, behind letters or digits that end, and
between a mark other than the apostrophe and a letter or digit. A slice of texts is cut there into pieces, Arrow numbers
the different pieces, the library encodes those that the worker does not remember, and the ids are gathered by number. No
Python step is taken for a word, only for a different piece. Next to characters whose class the tables do not know there
is no cut, so such a piece is only longer.
"""

from __future__ import annotations

import json
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers (some 200 bytes each); a full memory is emptied.
REMEMBERED = 400_000
#: Characters that the library encodes in one call, about.
CALL_CHARS = 1 << 18
# Classes of characters: blank or line feed, letter, digit, other visible mark, apostrophe, visible of unknown kind, unknown.
BLANK, LETTER, DIGIT, MARK, APOSTROPHE, VISIBLE, UNKNOWN = range(7)


def _byte_classes() -> np.ndarray:
    table = np.full(256, UNKNOWN, np.uint8)
    table[0x21:0x7F] = MARK
    table[[0x20, 0x0A]] = BLANK
    table[0x30:0x3A] = DIGIT
    table[0x41:0x5B] = table[0x61:0x7B] = LETTER
    table[0x27] = APOSTROPHE
    return table


def _cuts() -> np.ndarray:
    """Whether texts are cut between a character of class a and one of class b, at a * 8 + b."""
    cut = np.zeros((8, 8), bool)
    cut[LETTER : VISIBLE + 1, BLANK] = True
    cut[LETTER : DIGIT + 1, LETTER : APOSTROPHE + 1] = True
    cut[MARK, LETTER : DIGIT + 1] = True
    cut[LETTER, LETTER] = cut[DIGIT, DIGIT] = False
    return cut.ravel()


_WORD = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_CLASS, _CUT = _byte_classes().tobytes(), _cuts().tobytes().ljust(256, b"\0")
_LOWER = bytes(range(256)).lower()


def _mapped(data: np.ndarray, table: bytes) -> np.ndarray:
    """``table[data]``, which numpy would do with an index of eight bytes for each byte."""
    return np.frombuffer(bytearray(data).translate(table), np.uint8)


def classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 ``data`` belongs to."""
    out = _mapped(data, _CLASS)
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        first = data[lead]
        second = data[np.minimum(lead + 1, len(data) - 1)]
        third = data[np.minimum(lead + 2, len(data) - 1)]
        # U+00C0 to U+023F but the signs of multiplication and division
        letter = ((first == 0xC3) & (second != 0x97) & (second != 0xB7)) | ((first >= 0xC4) & (first <= 0xC8))
        # no white space: U+00A1 to U+0FFF, U+2010 to U+2027, U+2080 to U+2FFF, and all above U+3040
        dash = (first == 0xE2) & (((second == 0x80) & (third >= 0x90) & (third <= 0xA7)) | (second >= 0x82))
        seen = ((first == 0xC2) & (second >= 0xA1)) | ((first >= 0xC3) & (first <= 0xE0)) | dash | ((first == 0xE3) & (second >= 0x81)) | (first >= 0xE4)
        kind = np.where(letter, LETTER, np.where(seen, VISIBLE, UNKNOWN)).astype(np.uint8)
        for i, least in enumerate((0xC2, 0xC2, 0xE0, 0xF0)):
            some = (first >= least) & (lead + i < len(data))
            out[lead[some] + i] = kind[some]
    return out


def pieces(data: np.ndarray, ends: np.ndarray, drops_blanks: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of pieces, where each starts among them, and how many pieces the texts up to each of ``ends`` have.

    Blanks before a word belong to it, or go where the tokenizer drops them.
    """
    kind = classes(data)
    start = np.empty(len(data), bool)
    start[1:] = _mapped((kind[:-1] << 3) | kind[1:], _CUT)
    if drops_blanks:
        on = kind != BLANK
        start[1:] |= ~on[:-1]
    inner = np.concatenate([[0], ends[:-1]])
    start[inner[inner < len(data)]] = True
    if drops_blanks:
        start &= on
    places = np.flatnonzero(start)
    before = np.searchsorted(places, ends)
    if drops_blanks:
        data, places = data[on], np.flatnonzero(start[on])
    return data, places, before


def byte_alphabet() -> np.ndarray:
    """The characters that byte-level models use for bytes: visible Latin-1 stands for itself, the rest goes from U+0100.

    A line feed stays one here, as it stands between words.
    """
    visible = np.zeros(256, bool)
    visible[0x21:0x7F] = visible[0xA1:0xAD] = visible[0xAE:] = True
    out = np.arange(256, dtype="<u4")
    out[~visible] = 0x100 + np.arange(np.count_nonzero(~visible))
    out[0x0A] = 0x0A
    return out


class Encoder:
    """Ids as unsigned 32-bit integers, without special ids; the strings of special tokens in a text are ordinary text."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        parts = json.loads(Path(path).read_text())
        self.drops_blanks = '"Removed"' in json.dumps(parts["pre_tokenizer"])
        self.lowers = '"Lowercase"' in json.dumps(parts["normalizer"])
        self.alphabet = byte_alphabet()
        self._forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of this worker for ``path``."""
        if path not in cls._made:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            cls._made[path] = cls(path)
        return cls._made[path]

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.begin, self.length = np.empty(0, np.int64), np.empty(0, np.int64)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, different: pa.Array, new: np.ndarray) -> None:
        """Remember the ids of the pieces ``different[new]``, which are not known.

        A word of letters up to U+00FF, with one blank before it or none, is one word in normal form to both kinds of
        tokenizers: it goes to the library's model itself, in the alphabet of bytes. All others go through all its steps.
        """
        fresh = different.take(pa.array(new))
        try:
            words = pc.match_substring_regex(fresh.cast(pa.large_string()), _WORD).to_numpy(zero_copy_only=False)
        except pa.ArrowInvalid:  # not UTF-8
            words = np.zeros(len(fresh), bool)
        joined = b"\n".join(fresh.filter(pa.array(words)).to_numpy(zero_copy_only=False).tolist())
        if self.lowers:
            joined = joined.decode().lower().encode()
        mapped = self.alphabet[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-32-le").split("\n") if words.any() else []
        tokenize, flat, length, counts = self.tokenizer.model.tokenize, [], [], np.empty(len(new), np.int64)
        for word in mapped:
            ids = [t.id for t in tokenize(word)]
            flat += ids
            length.append(len(ids))
        counts[words] = length
        others = np.flatnonzero(~words)
        texts = [p.decode("utf-8", "replace") for p in fresh.take(pa.array(others)).to_pylist()]
        group, size, length = [], 0, []
        for n, text in enumerate(texts, 1):
            group.append(text)
            size += len(text) + 16
            if size > CALL_CHARS or n == len(texts):
                for ids in self._library(group):
                    flat += ids
                    length.append(len(ids))
                group, size = [], 0
        counts[others] = length
        total = len(flat)
        if self.used + total > len(self.ids):
            grown = np.empty(max(2 * len(self.ids), self.used + total), np.uint32)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + total] = flat
        begin, order = np.empty(len(new), np.int64), np.concatenate([np.flatnonzero(words), others])
        begin[order] = self.used + np.cumsum(counts[order]) - counts[order]
        self.begin, self.length = np.concatenate([self.begin, begin]), np.concatenate([self.length, counts])
        self.used += total

    def _numbers(self, different: pa.Array) -> np.ndarray:
        """The place in the memory of each piece."""
        if len(self.known) > REMEMBERED:
            self._forget()
        listed, base = different.to_numpy(zero_copy_only=False).tolist(), len(self.known)
        found = np.array(list(map(self.known.get, listed, repeat(-1))), np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            self._learn(different, new)
            found[new] = np.arange(base, base + len(new))
            self.known.update(zip([listed[i] for i in new.tolist()], range(base, base + len(new)), strict=True))
        return found

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` (string or binary; null is empty) and the end of each text's among them.

        ``end``, if given, is put behind the ids of each text.
        """
        binary = pc.fill_null(texts.cast(pa.large_binary()), b"")
        _, at, raw = binary.buffers()
        bounds = np.frombuffer(at, np.int64, len(binary) + 1, 8 * binary.offset) if len(binary) else np.zeros(1, np.int64)
        data = np.frombuffer(raw, np.uint8, int(bounds[-1] - bounds[0]), int(bounds[0])) if raw is not None and bounds[-1] > bounds[0] else np.empty(0, np.uint8)
        cut, start, upto = pieces(data, bounds[1:] - bounds[0], self.drops_blanks)
        if self.lowers:
            cut = _mapped(cut, _LOWER)
        offsets = np.append(start, len(cut)) if len(start) else np.zeros(1, np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(cut))]).dictionary_encode()
        del data, cut, start, offsets  # what is gathered below takes its place
        code = self._numbers(words.dictionary)[words.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
        del words
        length, begin = self.length[code], self.begin[code]
        done = np.cumsum(length)
        place = np.repeat(begin - done + length, length)
        place += np.arange(len(place))
        ids = self.ids[place]
        del code, length, begin, place
        last = np.where(upto > 0, done[np.maximum(upto, 1) - 1], 0) if len(done) else np.zeros(len(upto), np.int64)
        if end is None:
            return ids, last
        out = np.empty(len(ids) + len(last), np.uint32)
        stop = last + np.arange(len(last))
        body = np.ones(len(out), bool)
        body[stop] = False
        out[body], out[stop] = ids, end
        return out, stop + 1
