"""Gates and lookups: who is not checked, and names for ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bypass_users(whitelist: DataFrame, bypass: DataFrame | None = None, users: DataFrame | None = None, ops: bool = False) -> DataFrame:
    """(user_id): users on either list, and operators where ``ops``."""
    out = whitelist.select("user_id")
    if bypass is not None:
        out = out.union(bypass.select("user_id"))
    if users is not None and ops:
        out = out.union(users.filter("is_op").select("user_id"))
    return out.filter("user_id is not null").distinct()


def bypass_flag(messages: DataFrame, exempt: DataFrame, out: str = "bypassed") -> DataFrame:
    """``messages`` with a flag; a message without a user is never exempt. Spark broadcasts the list where it is small."""
    marked = exempt.select("user_id").distinct().withColumn(out, F.lit(True))
    return messages.join(marked, "user_id", "left").withColumn(out, F.coalesce(out, F.lit(False)))


def resolve_names(names: DataFrame, users: DataFrame) -> DataFrame:
    """(name, user_id): ids by name, whatever the case; of several users with a name the smallest id; null if unknown."""
    known = users.select(F.lower("name").alias("key"), "user_id").groupBy("key").agg(F.min("user_id").alias("user_id"))
    return names.withColumn("key", F.lower("name")).join(known, "key", "left").drop("key")


def display_names(ids: DataFrame, users: DataFrame, out: str = "name") -> DataFrame:
    """``ids`` with the name of each user_id, or its first eight characters."""
    known = users.groupBy("user_id").agg(F.min("name").alias(out))
    return ids.join(known, "user_id", "left").withColumn(out, F.coalesce(out, F.substring(F.col("user_id").cast("string"), 1, 8)))
