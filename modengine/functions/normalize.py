"""Text normalization against evasion, as column functions; only Unicode decomposition runs in Python, over Arrow.

The chain: invisible characters, Unicode decomposition, look-alikes, leet, separators. Null stays null.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from modengine.functions import fixed
from modengine.functions.fixed import B


def strip_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, f"[{fixed.ZERO_WIDTH}]", "")


def _decompose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: text and unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text)))


def decompose(text: Column) -> Column:
    """Compatibility decomposition without marks. ASCII texts go to the Python worker as null, so they cost nothing."""
    plain = F.pandas_udf(_decompose, "string")
    return F.coalesce(F.regexp_replace(plain(F.when(text.rlike(r"[^\x00-\x7F]"), text)), r"\p{M}", ""), text)


def decode_confusables(text: Column) -> Column:
    return F.translate(text, fixed.CYRILLIC + fixed.GREEK, fixed.CYRILLIC_AS + fixed.GREEK_AS)


def decode_leet_sequences(text: Column) -> Column:
    """Multi-character leet in one pass: the first sequence in order of precedence at each place.

    Characters that open no sequence are taken as one run.
    """
    tokens = "|".join(re.escape(sequence) for sequence, _ in fixed.LEET)
    opening = "".join(re.escape(c) for c in dict.fromkeys(sequence[0] for sequence, _ in fixed.LEET))
    found = F.regexp_extract_all(text, F.lit(f"(?s)({tokens}|[^{opening}]+|.)"), F.lit(1))
    letters = F.create_map(*[F.lit(x) for pair in fixed.LEET for x in pair])
    decoded = F.array_join(F.transform(found, lambda t: F.coalesce(F.try_element_at(letters, t), t)), "")
    return F.when(text.rlike(tokens), decoded).otherwise(text)


def decode_leet_chars(text: Column) -> Column:
    return F.translate(text, fixed.LEET_CHARS, fixed.LEET_AS)


def fold_dot_variants(text: Column) -> Column:
    return F.regexp_replace(text, fixed.DOT_VARIANTS, ".")


def drop_letter_dots(text: Column) -> Column:
    return F.regexp_replace(text, fixed.DOTS_BETWEEN_LETTERS, "")


def join_spaced_letters(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<={B}[a-zA-Z]) (?=[a-zA-Z]{B})", "")


def collapse_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, fixed.REPEATED_PUNCTUATION, "$1")


def tighten_separators(text: Column) -> Column:
    return F.regexp_replace(text, fixed.SEPARATOR_CLEANUP, "$1")


def drop_letter_brackets(text: Column) -> Column:
    return F.regexp_replace(text, fixed.BRACKET_CLEANUP, "")


def drop_letter_separators(text: Column) -> Column:
    return F.regexp_replace(text, fixed.INLINE_PUNCTUATION, "")


def collapse_repeats(text: Column) -> Column:
    """Three or more of a character become two; applied by some rules, not by the chain."""
    return F.regexp_replace(text, r"(.)\1{2,}", "$1$1")


STEPS = (strip_zero_width, decompose, decode_confusables, decode_leet_sequences, decode_leet_chars, fold_dot_variants, drop_letter_dots, join_spaced_letters, collapse_punctuation, tighten_separators, drop_letter_brackets, drop_letter_separators)


def normalize(text: Column) -> Column:
    for step in STEPS:
        text = step(text)
    return text


def name_variants(name: Column) -> Column:
    """A name in lower case, leet-decoded, without inner separators, and without long repeats: up to four strings."""
    lower = F.lower(name)
    decoded = decode_leet_chars(lower)
    bare = drop_letter_separators(decoded)
    return F.array_distinct(F.array(lower, decoded, bare, collapse_repeats(bare)))
