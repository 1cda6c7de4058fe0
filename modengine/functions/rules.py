"""Predicates of single messages. Null texts match nothing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from modengine.functions import fixed
from modengine.functions.fixed import B
from modengine.functions.normalize import collapse_repeats
from modengine.functions.words import strings


def illegal_characters(text: Column, blocks: Iterable[str]) -> Column:
    """Some character lies outside the named blocks; unknown names are ignored."""
    ranges = [fixed.BLOCKS[b] for b in blocks if b in fixed.BLOCKS]
    if not ranges:
        return F.length(text) > 0
    return text.rlike("[^" + "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in ranges) + "]")


def formatting_tag(text: Column) -> Column:
    return text.rlike(fixed.TAG)


def color_code(text: Column) -> Column:
    return text.rlike(fixed.COLOR_CODE)


def utf16_length(text: Column) -> Column:
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def too_long(text: Column, most: int) -> Column:
    return utf16_length(text) > most


def repeated_character(text: Column, most: int) -> Column:
    return text.rlike(rf"(.)\1{{{most},}}") if most > 0 else F.lit(False)


def server_name(text: Column, names: Iterable[str]) -> Column:
    """The first in order of the listed names that stands as a word in a text without line breaks; null if none does."""
    found = [F.when(F.lower(collapse_repeats(text)).rlike(rf"\A.*{B}\Q{n}\E{B}.*\z"), F.lit(n)) for n in sorted({n.lower() for n in names})]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def custom_pattern(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


#: Scripts that a token's non-ASCII characters are told apart by, where the JVM's own list is not given.
SCRIPTS = ("COMMON", "INHERITED", "LATIN", "CYRILLIC", "GREEK", "HEBREW", "ARABIC", "HAN", "HIRAGANA", "KATAKANA", "HANGUL", "THAI", "DEVANAGARI", "ARMENIAN", "GEORGIAN", "BENGALI", "TAMIL", "TELUGU")


def jvm_scripts(spark: SparkSession) -> tuple[str, ...]:
    """All scripts that the JVM knows."""
    return tuple(s.name() for s in spark.sparkContext._jvm.java.lang.Character.UnicodeScript.values())


def mixed_script(text: Column, scripts: Iterable[str] = SCRIPTS) -> Column:
    """Some token has non-ASCII characters of two scripts. ASCII is ignored."""
    one = "|".join(f"[\\x00-\\x7F\\p{{Is{s}}}]*" for s in scripts)
    return F.exists(F.split(text, r"\p{javaWhitespace}+"), lambda t: ~t.rlike(rf"(?s)\A(?:{one})\z"))


def text_is_name(text: Column, names: Iterable[str]) -> Column:
    return F.array_contains(strings(names), F.lower(text))
