"""Messages: readers for batch and stream, private messages, and the sinks of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modengine.functions import fixed

MESSAGES = "msg_id long, ts timestamp, user_id string, user_name string, channel string, text string"


def read_messages(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.schema(MESSAGES).format(form).load(path)


def stream_messages(spark: SparkSession, path: str, form: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(MESSAGES).format(form)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly to all cores where their files have fewer splits than that, as a small table has.

    A message costs far more to check than to move. Large tables have more splits and are not moved.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def private_messages(raw: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``raw`` that are private-message commands, with the message as text.

    The word behind the command is the recipient, also for replies, and is not checked.
    """
    return raw.filter(F.col(text_col).rlike(fixed.PRIVATE_MESSAGE)).withColumn(text_col, F.regexp_extract(text_col, fixed.PRIVATE_MESSAGE, 2))


def audit_line(ts: Column, name: Column, user_id: Column, rule: Column, text: Column) -> Column:
    """``[date time] name (id) | rule | text``."""
    return F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("] "), F.coalesce(name, F.lit("?")), F.lit(" ("), F.coalesce(user_id.cast("string"), F.lit("-")), F.lit(") | "), rule, F.lit(" | "), text)


def audit_lines(decisions: DataFrame) -> DataFrame:
    c = F.col
    return decisions.filter("blocked").select(audit_line(c("ts"), c("user_name"), c("user_id"), c("rule"), c("text")).alias("value"))


def write_audit(decisions: DataFrame, path: str) -> None:
    audit_lines(decisions).write.mode("append").text(path)


def write_violations(found: DataFrame, path: str) -> None:
    """Append violations, partitioned by day so that pages of one user prune by time."""
    found.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def read_violations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("day")
