"""Word-list detectors: first exact match, fuzzy match, token and message tests.

Lexicons are small and become literal arrays. The dictionary of common words may have any size: a message carries the
array of those of its own candidate strings that the dictionary holds (``with_common_words``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modengine.functions.fixed import TWO_LETTER_WORDS

RELATIVE, MOST_EDITS = 0.35, 3
#: Words that a lexicon may have as a literal array.
MOST_WORDS = 10_000
#: Words of a dictionary that the workers hold; a larger one is joined.
MOST_COMMON = 600_000


@dataclass(frozen=True)
class Lexicon:
    """Fuzzy words and whole-token words, in lower case; fuzzy words are ASCII."""

    fuzzy: tuple[str, ...] = ()
    basic: tuple[str, ...] = ()

    def __post_init__(self):
        if bad := [w for w in self.fuzzy if not w.isascii() or not w]:
            raise ValueError(f"fuzzy words must be ASCII and not empty: {bad[:5]}")
        if max(len(self.fuzzy), len(self.basic)) > MOST_WORDS:
            raise ValueError(f"a lexicon has at most {MOST_WORDS} words")

    @classmethod
    def of(cls, fuzzy: Iterable[str] = (), basic: Iterable[str] = ()) -> Lexicon:
        tidy = lambda words: tuple(sorted({w.lower() for w in words}))
        return cls(tidy(fuzzy), tidy(basic))


def strings(values: Iterable[str]) -> Column:
    values = tuple(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_common(word: Column, common: Column) -> Column:
    """common: the dictionary words among the message's candidates."""
    n = F.length(word)
    digits = (n <= 4) & word.rlike("^[0-9]+$")
    return F.when(n == 0, F.lit(False)).when(n == 1, word.between("a", "z")).when(n == 2, word.isin(*TWO_LETTER_WORDS)).otherwise(F.coalesce(digits | F.array_contains(common, word), F.lit(False)))


def first_match(text: Column, words: Column) -> Column:
    """The word whose occurrence ends first in ``text``, of these the longest; null if none occurs."""
    places = F.transform(words, lambda w: F.struct(F.position(w, text).alias("at"), w.alias("word")))
    ends = F.transform(F.filter(places, lambda x: x["at"] > 0), lambda x: F.struct((x["at"] + F.length(x["word"])).alias("end"), (-F.length(x["word"])).alias("short"), x["word"].alias("word")))
    return F.array_min(ends)["word"]


def contains_any(text: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.position(w, text) > 0)


def max_distance(text: Column) -> Column:
    return F.when(F.length(text) <= 4, 1).when(F.length(text) <= 8, 2).otherwise(MOST_EDITS)


def _near(text: Column, words: Column) -> Column:
    """array of struct(distance, word): the words within the absolute and the relative edit distance for ``text``.

    Lengths are compared first, and a distance is computed once and only up to ``MOST_EDITS``.
    """
    close = F.filter(words, lambda w: F.abs(F.length(w) - F.length(text)) <= max_distance(text))
    measured = F.transform(close, lambda w: F.struct(F.levenshtein(w, text, MOST_EDITS).alias("distance"), w.alias("word")))
    # a distance beyond the bound is -1
    return F.filter(measured, lambda x: (x["distance"] >= 0) & (x["distance"] <= max_distance(text)) & (x["distance"] / F.greatest(F.length(x["word"]), F.length(text)) <= RELATIVE))


def _few(words: tuple[str, ...] | Column, text: Column) -> Column:
    """The words that have a length near to that of ``text``: a literal array for each length, for texts short enough."""
    if isinstance(words, Column):
        return words
    longest = max(map(len, words), default=0) + MOST_EDITS
    chosen = None
    for n in range(1, longest + 1):
        some = [w for w in words if abs(len(w) - n) <= MOST_EDITS]
        chosen = F.when(F.length(text) == n, strings(some)) if chosen is None else chosen.when(F.length(text) == n, strings(some))
    return strings(()) if chosen is None else chosen.otherwise(strings(()))


def fuzzy_match(text: Column, words: Column | tuple[str, ...]) -> Column:
    """Some word is near; a text of up to four characters does not match a word of its length at distance one."""
    strict = lambda x: (F.length(text) > 4) | (F.length(x["word"]) != F.length(text)) | (x["distance"] != 1)
    return F.exists(_near(text, _few(words, text)), strict)


def nearest_word(text: Column, words: Column | tuple[str, ...]) -> Column:
    """struct(distance, word) of the nearest word within the thresholds, ties to the first in order; null if none."""
    return F.array_min(_near(text, _few(words, text)))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def trimmed(token: Column) -> Column:
    return F.regexp_replace(token, "^[^a-z]+|[^a-z]+$", "")


def bad_token(token: Column, common: Column, lexicon: Lexicon) -> Column:
    """A lower-case token that the lists block."""
    fuzzy, basic = strings(lexicon.fuzzy), strings(lexicon.basic)

    def test(t: Column) -> Column:
        def exact(word: Column) -> Column:
            at, n = F.position(word, t), F.length(word)
            tail = at + n - 1 == F.length(t)
            return F.coalesce(((n >= 4) & ((at == 1) | tail)) | ((n == 3) & tail), F.lit(False))

        hit = F.array_contains(basic, t) | _let(first_match(t, fuzzy), exact) | ((F.length(t) >= 3) & fuzzy_match(t, lexicon.fuzzy))
        return (t != "") & ~is_common(t, common) & hit

    return _let(trimmed(token), test)


def bad_message(text: Column, common: Column, lexicon: Lexicon) -> Column:
    """Some token is blocked, or the only two tokens together are a basic word."""
    words = tokens(F.lower(text))
    split = (F.size(words) == 2) & F.array_contains(strings(lexicon.basic), F.array_join(words, ""))
    return F.exists(words, lambda t: bad_token(t, common, lexicon)) | split


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z\s]", "")


def _cover(words: Column, at: Column, length: Column) -> Column:
    """struct(first, low, high): where the first covered token starts in the joined text, and the covered positions."""
    start = F.struct(F.lit(0).alias("pos"), F.lit(-1).alias("first"), F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(1).alias("i"))

    def step(s: Column, t: Column) -> Column:
        end = s["pos"] + F.length(t)
        covers = (s["pos"] < at + length) & (end > at)
        opens = covers & (s["low"] == 0)
        return F.struct(end.alias("pos"), F.when(opens, s["pos"]).otherwise(s["first"]).alias("first"), F.when(opens, s["i"]).otherwise(s["low"]).alias("low"), F.when(covers, s["i"]).otherwise(s["high"]).alias("high"), (s["i"] + 1).alias("i"))

    return F.aggregate(words, start, step)


def spaced_hits(text: Column, lexicon: Lexicon) -> Column:
    """array of (word, at, first, blob, tokens): first occurrences of fuzzy words in a text without its blanks.

    Null where no word occurs. Linear in the text for each word that does.
    """

    def hits(words: Column, squished: Column) -> Column:
        def hit(word: Column) -> Column:
            made = lambda at: _let(_cover(words, at, F.length(word)), lambda c: _let(F.slice(words, c["low"], c["high"] - c["low"] + 1), lambda cover: F.struct(word.alias("word"), at.alias("at"), c["first"].alias("first"), F.array_join(cover, "").alias("blob"), cover.alias("tokens"))))
            return _let(F.position(word, squished) - 1, made)

        present = F.filter(strings(lexicon.fuzzy), lambda w: F.position(w, squished) > 0)
        return _let(present, lambda p: F.when(F.size(p) > 0, F.transform(p, hit)))

    return _let(tokens(_letters(text)), lambda words: _let(F.array_join(words, ""), lambda squished: hits(words, squished)))


def obfuscated(text: Column, common: Column, lexicon: Lexicon) -> Column:
    """A fuzzy word spread over tokens, or the uncommon rest of the message near to one."""

    def blocks(h: Column) -> Column:
        inside = h["at"] - h["first"]
        interior = (F.size(h["tokens"]) == 1) & (inside > 0) & (inside + F.length(h["word"]) < F.length(h["blob"]))
        all_common = F.forall(h["tokens"], lambda t: is_common(t, common))
        return ~is_common(h["blob"], common) & ~(all_common & (inside > 0)) & ~interior

    spread = F.coalesce(F.exists(spaced_hits(text, lexicon), blocks), F.lit(False))
    rest = F.array_join(F.filter(tokens(_letters(text)), lambda t: ~is_common(t, common)), "")
    return spread | _let(rest, lambda r: (F.length(r) >= 3) & fuzzy_match(r, lexicon.fuzzy))


def candidates(text: Column, lexicon: Lexicon) -> Column:
    """Every string of a message that a word test may look up in the dictionary."""
    blobs = F.coalesce(F.transform(spaced_hits(text, lexicon), lambda h: h["blob"]), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.transform(tokens(F.lower(text)), trimmed), tokens(_letters(text)), blobs))


def _keep(words: list[str], spark: SparkSession):
    """A function of Arrow batches whose last column is arrays: these without the strings that are not in ``words``."""
    known = spark.sparkContext.broadcast(pa.array(words, pa.string()))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(batch.num_columns - 1)
            values = found.flatten()
            inside = pc.is_in(values, value_set=known.value)
            ends = np.cumsum(np.concatenate([[0], pc.list_value_length(found).to_numpy(zero_copy_only=False)]))
            before = np.cumsum(np.concatenate([[0], inside.to_numpy(zero_copy_only=False)]))
            kept = pa.ListArray.from_arrays(pa.array(before[ends], pa.int32()), values.filter(inside))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], kept], batch.schema.names)

    return keep


def with_common_words(messages: DataFrame, candidate: Column, dictionary: DataFrame, key: str, out: str = "common", most: int = MOST_COMMON) -> DataFrame:
    """``messages`` with the array ``out`` of the candidates that ``dictionary`` (word) holds; ``key`` is unique.

    A dictionary of up to ``most`` words is counted, sent to the workers and looked up there, and no message moves. A
    larger one is joined: candidates are exploded, and each message goes along with one row of its own, whose word is in
    no dictionary and hot for no task. Only candidates that a common-word test would look up are: longer than two
    characters and not a short number.
    """
    looked_up = F.filter(F.array_distinct(candidate), lambda w: (F.length(w) > 2) & ~((F.length(w) <= 4) & w.rlike("^[0-9]+$")))
    looked_up = F.coalesce(looked_up, F.array().cast("array<string>"))
    known = dictionary.select(F.col("word").alias("__word")).filter("length(word) > 2").distinct()
    if not dictionary.isStreaming:
        held = [r[0] for r in known.limit(most + 1).collect()]
        if len(held) <= most:
            rows = messages.select("*", looked_up.alias(out))
            return rows.mapInArrow(_keep(held, messages.sparkSession), rows.schema)
    own = F.concat(F.lit("\0"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = messages.withColumn("__words", F.concat(F.array(own), looked_up)).select(F.struct(*messages.columns).alias("__row"), F.posexplode("__words").alias("__at", "__word"))
    rows = rows.select(F.col(f"__row.{key}").alias("__key"), F.when(F.col("__at") == 0, F.col("__row")).alias("__row"), "__word")
    joined = rows.join(known.withColumn("__known", F.lit(True)), "__word", "left")
    found = joined.groupBy("__key").agg(F.first("__row", ignorenulls=True).alias("__row"), F.collect_set(F.when(F.col("__known"), F.col("__word"))).alias(out))
    return found.select("__row.*", out)
