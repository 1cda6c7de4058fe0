"""Stateful rules over event time: message rate, and floods of similar messages.

A user's messages are cut into spans of ``SPAN`` windows, and each span also gets the messages of one window before it,
so a user with a third of all messages is many small partitions of the same window function, not one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Windows in a span of a user's messages.
SPAN = 64


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def _spans(messages: DataFrame, window_ms: int) -> DataFrame:
    """Rows with span and own; a row in the last window of a span is also context of the next one."""
    width = SPAN * window_ms
    span = F.floor(F.col("ms") / width)
    carried = F.pmod(F.col("ms"), F.lit(width)) >= width - window_ms
    both = F.when(carried, F.array(F.struct(span.alias("span"), F.lit(True).alias("own")), F.struct((span + 1).alias("span"), F.lit(False).alias("own"))))
    return messages.withColumn("s", F.explode(F.coalesce(both, F.array(F.struct(span.alias("span"), F.lit(True).alias("own")))))).select("*", "s.*").drop("s")


def rate_counts(messages: DataFrame, seconds: int) -> DataFrame:
    """(msg_id, in_window): messages of the user in the window that ends with this one, by (ts, msg_id).

    A message exactly ``seconds`` old counts; of messages at one time only the earlier ids count.
    """
    window_ms = seconds * 1000
    rows = _spans(messages.select("msg_id", "user_id", millis(F.col("ts")).alias("ms")), window_ms)
    by = Window.partitionBy("user_id", "span")
    older = F.count("*").over(by.orderBy("ms").rangeBetween(Window.unboundedPreceding, -window_ms - 1))
    counted = rows.withColumn("in_window", F.row_number().over(by.orderBy("ms", "msg_id")) - older)
    return counted.filter("own").select("msg_id", "in_window")


def rate_limited(messages: DataFrame, most: int, seconds: int) -> DataFrame:
    """(msg_id) of messages over the limit."""
    return rate_counts(messages, seconds).filter(F.col("in_window") > most).select("msg_id")


def similarity(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length; two empty texts are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def limited(messages: DataFrame, rate: tuple[int, int] | None, flood: tuple[int, float, int] | None, text_col: str = "normalized") -> DataFrame:
    """``messages`` with ``limit``: "rate", "flood" or null, both rules with one exchange.

    rate: most messages and seconds; flood: seconds, least similarity and most similar messages. A message over the rate
    does not count for floods. A span's context reaches back by both windows, so that what counts as context of a flood
    has its own context of the rate.
    """
    rate_ms, flood_ms = 1000 * (rate[1] if rate else 0), 1000 * (flood[0] if flood else 0)
    rows = _spans(messages.withColumn("ms", millis(F.col("ts"))), max(1, rate_ms + flood_ms))
    by, limit = Window.partitionBy("user_id", "span"), F.lit(None).cast("string")
    if rate:
        older = F.count("*").over(by.orderBy("ms").rangeBetween(Window.unboundedPreceding, -rate_ms - 1))
        limit = F.when(F.row_number().over(by.orderBy("ms", "msg_id")) - older > rate[0], F.lit("rate"))
    rows = rows.withColumn("limit", limit)
    if flood:
        counted = F.when(F.col("limit").isNull(), F.struct("ms", "msg_id", F.col(text_col).alias("norm")))
        rows = rows.withColumn("before", F.collect_list(counted).over(by.orderBy("ms").rangeBetween(-flood_ms, 0)))
        earlier = lambda x: (x["ms"] < F.col("ms")) | (x["msg_id"] < F.col("msg_id"))
        similar = F.filter("before", lambda x: earlier(x) & (similarity(x["norm"], F.col(text_col)) >= flood[1]))
        rows = rows.filter("own").withColumn("limit", F.when(F.col("limit").isNull() & (F.size(similar) >= flood[2]), F.lit("flood")).otherwise(F.col("limit")))
    return rows.filter("own").select(*messages.columns, "limit")


def flooded(messages: DataFrame, seconds: int, least: float, most: int, text_col: str = "normalized") -> DataFrame:
    """(msg_id) of messages with ``most`` or more similar ones of the user before them in the window."""
    window_ms = seconds * 1000
    rows = _spans(messages.select("msg_id", "user_id", millis(F.col("ts")).alias("ms"), F.col(text_col).alias("norm")), window_ms)
    before = F.collect_list(F.struct("ms", "msg_id", "norm")).over(Window.partitionBy("user_id", "span").orderBy("ms").rangeBetween(-window_ms, 0))
    rows = rows.withColumn("before", before).filter("own")
    earlier = lambda x: (x["ms"] < F.col("ms")) | (x["msg_id"] < F.col("msg_id"))
    similar = F.filter("before", lambda x: earlier(x) & (similarity(x["norm"], F.col("norm")) >= least))
    return rows.filter(F.size(similar) >= most).select("msg_id")
