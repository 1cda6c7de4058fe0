"""Tables that cut lineage, written where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temporary one where none is set and all runs on one host."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="modengine-")
        context.setCheckpointDir(base)
    return base.rstrip("/")


#: Folder that tables of the running operator go to; see ``temporary_tables``.
_folder: ContextVar[str | None] = ContextVar("modengine-scratch", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{_folder.get() or scratch_root(spark) + '/modengine'}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of tables, on any file system; nothing where there is none."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables ``saved`` inside are deleted at the end: what is returned must be ``kept``, or not depend on them."""
    path = scratch_path(spark, "temporary")
    before = _folder.set(path)
    try:
        yield
    finally:
        _folder.reset(before)
        delete(spark, path)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: later plans start from files, not from a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, label: str) -> DataFrame:
    """``saved`` outside the innermost ``temporary_tables``."""
    inner = _folder.get()
    before = _folder.set(inner.rsplit("/", 1)[0] if inner else None)
    try:
        return saved(df, label)
    finally:
        _folder.reset(before)


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name
