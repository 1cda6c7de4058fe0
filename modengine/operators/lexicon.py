"""Administration of word lists and user sets as tables: every change returns a new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVEL = 2


def add_word(words: DataFrame, word: str) -> DataFrame:
    """(word, ...) with ``word`` in lower case, once; a column ``level`` gets its only level."""
    spark, low = words.sparkSession, word.lower()
    columns = [F.lit(low).alias("word")] + [F.lit(LEVEL).cast(words.schema[c].dataType).alias(c) for c in words.columns if c != "word"]
    new = spark.range(1).select(*columns).join(words.select("word"), "word", "left_anti")
    return words.unionByName(new.select(*words.columns))


def remove_word(words: DataFrame, word: str) -> DataFrame:
    return words.filter(F.col("word") != word.lower())


def has_word(words: DataFrame, word: str) -> bool:
    return not words.filter(F.col("word") == word.lower()).isEmpty()


def list_words(fuzzy: DataFrame | None = None, basic: DataFrame | None = None) -> DataFrame:
    """(word, kind) of either list or of both, one after the other."""
    parts = [df.select("word", F.lit(kind).alias("kind")) for df, kind in ((fuzzy, "fuzzy"), (basic, "basic")) if df is not None]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.orderBy("kind", "word")


def add_user(users: DataFrame, user_id: object) -> DataFrame:
    new = users.sparkSession.range(1).select(F.lit(user_id).cast(users.schema["user_id"].dataType).alias("user_id"))
    return users.select("user_id").union(new).distinct()


def remove_user(users: DataFrame, user_id: object) -> DataFrame:
    return users.select("user_id").filter(F.col("user_id") != user_id)


def toggle_user(users: DataFrame, user_id: object) -> DataFrame:
    """The set without the user if it holds the user, else with."""
    return remove_user(users, user_id) if not users.filter(F.col("user_id") == user_id).isEmpty() else add_user(users, user_id)


def set_user(users: DataFrame, user_id: object, on: bool) -> DataFrame:
    return (add_user if on else remove_user)(users, user_id)


def complete(options: DataFrame, prefix: str, column: str = "word") -> DataFrame:
    """Options that start with ``prefix`` in lower case."""
    return options.filter(F.startswith(F.lower(column), F.lit(prefix.lower()))).select(column).orderBy(column)
