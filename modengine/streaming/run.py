"""Running a stream to its end into files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_path(spark, label: str) -> str:
    """A new path in the cluster's shared folder; in a temporary one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return f"{base.rstrip('/')}/modengine/{label}-{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame, label: str) -> DataFrame:
    """All rows that ``stream`` gives for what its sources hold now."""
    spark = stream.sparkSession
    path = shared_path(spark, label)
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
