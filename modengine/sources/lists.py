"""Word lists, dictionaries and user sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modengine.functions.words import MOST_WORDS, Lexicon

UUID = "(?i)^[0-9a-f]{1,8}-[0-9a-f]{1,4}-[0-9a-f]{1,4}-[0-9a-f]{1,4}-[0-9a-f]{1,12}$"


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word) of text files with words split by commas or lines; case stays."""
    lines = spark.read.text(path)
    return lines.select(F.explode(F.split("value", r"[,\r\n]+")).alias("word")).select(F.trim("word").alias("word")).filter("word <> ''").distinct()


def read_user_set(spark: SparkSession, path: str) -> DataFrame:
    """(user_id) of a JSON list of ids; entries that are no ids are left out, a broken file is empty."""
    text = spark.read.text(path, wholetext=True)
    ids = text.select(F.explode(F.from_json("value", "array<string>")).alias("user_id"))
    return ids.filter(F.col("user_id").rlike(UUID)).select(F.lower("user_id").alias("user_id")).distinct()


def write_user_set(users: DataFrame, path: str) -> None:
    """The whole set as one JSON list. The set is administered by hand and small."""
    listed = users.agg(F.sort_array(F.collect_set("user_id")).alias("ids"))
    listed.select(F.to_json("ids").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def lexicon(fuzzy: DataFrame, basic: DataFrame) -> Lexicon:
    """A lexicon from tables with a column word; more than ``MOST_WORDS`` words are an error, not cut."""
    read = lambda df: [r[0] for r in df.select("word").distinct().limit(MOST_WORDS + 1).collect()]
    return Lexicon.of(read(fuzzy), read(basic))
