"""Licence scan: ordered signature rules behind a keyword prefilter, with priority and containment suppression.

A text is lower-cased (A-Z only) and cut into words. An Aho-Corasick pass over all rules' keywords tells which rules can
match; only their patterns run, over the words joined by one blank. Detections are ordered by priority; one that lies
inside a kept one of at least its priority is suppressed. The base phrases are always reported.

Scale: one pass where the texts are read, no exchange. The rules are part of the code, not of the data.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modengine.llm.license_rules import BASE, BASE_WEIGHT, RULES, Rule
from modengine.llm.wordhash import row_slices, texts_of

CHUNK_BYTES = 1 << 20
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,priority:int,first_word:long,last_word:long>>"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_ON = np.zeros(256, bool)
_ON[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def whole_words(pattern: str) -> re.Pattern:
    return re.compile(f"(?<![^ ])(?:{pattern})(?![^ ])")


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES, base: dict[str, str] = BASE):
        import ahocorasick

        self.rules = [(r, whole_words(r.pattern), frozenset(r.keywords)) for r in rules]
        self.base = [(whole_words(re.escape(p).replace(r"\ ", " ")), label, p.count(" ") + 1, frozenset(p.split())) for p, label in base.items()]
        self.find = ahocorasick.Automaton()
        for key in {k for _, _, keys in self.rules for k in keys} | {k for *_, keys in self.base for k in keys}:
            self.find.add_word(key, key)
        self.find.make_automaton()

    def scan(self, text: str) -> tuple[list[tuple[int, str]], list[tuple[str, int, int, int, float]]] | None:
        """Base places (word, label) and surviving detections (label, priority, first word, last word, weight)."""
        present = {key for _, key in self.find.iter(text)}
        bases = [b for b in self.base if b[3] <= present]
        rules = [r for r in self.rules if r[2] <= present]
        if not bases and not rules:
            return None
        joined = b" ".join(_WORD.findall(text.encode())).decode()
        starts = np.array([0, *(m.start() + 1 for m in re.finditer(" ", joined))])
        word = lambda at: int(np.searchsorted(starts, at, "right")) - 1
        places = [(word(m.start()), label) for pattern, label, _, _ in bases for m in pattern.finditer(joined)]
        found = [(rule, m.start(), m.end()) for rule, pattern, _ in rules for m in pattern.finditer(joined)]
        return places, [(r.label, r.priority, word(a), word(b - 1), r.weight) for r, a, b in suppress(found)]


def suppress(found: list[tuple[Rule, int, int]]) -> list[tuple[Rule, int, int]]:
    """Detections that lie in no other kept one of the same or a higher priority, by priority and place."""
    kept: list[tuple[Rule, int, int]] = []
    for priority in sorted({r.priority for r, _, _ in found}, reverse=True):
        reach, starts, most = [], sorted((a, b) for _, a, b in kept), -1
        for _, b in starts:
            reach.append(most := max(most, b))
        most = -1
        level = sorted((x for x in found if x[0].priority == priority), key=lambda x: (x[1], -x[2], x[0].label))
        for rule, a, b in level:
            above = bisect_right(starts, (a, 1 << 60))
            if b > most and not (above and reach[above - 1] >= b):
                kept.append((rule, a, b))
                most = b
    return kept


@cache
def _scanner() -> Scanner:
    return Scanner()


def _count_words(texts: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    on = _ON[data]
    starts = np.cumsum(on & ~np.concatenate([[False], on[:-1]]))
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    return np.diff(np.concatenate([[0], starts[ends]]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner, schema = _scanner(), None
    for whole in batches:
        for batch in row_slices(whole, whole.schema.names[1], CHUNK_BYTES):
            texts = texts_of(batch.column(1))
            rows = []
            for key, n, text in zip(batch.column(0).to_pylist(), _count_words(texts).tolist(), texts, strict=True):
                places, kept = scanner.scan(text.lower().decode()) or ([], [])
                at, base = [p for p, _ in places], {label for _, label in places}
                score = max([BASE_WEIGHT if base else 0.0, *(k[4] for k in kept)])
                rows.append({"doc_id": key, "n_words": n, "n_base": len(places), "first_word": min(at, default=None), "last_word": max(at, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {k[0] for k in kept})), "score": score, "detections": [{"label": k[0], "priority": k[1], "first_word": k[2], "last_word": k[3]} for k in kept]})
            schema = schema or pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64())])))])
            yield pa.RecordBatch.from_pylist(rows, schema)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: SCHEMA. Null text is empty; a text without a match has empty labels and score 0."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scan, SCHEMA)
