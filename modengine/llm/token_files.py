"""Token files: Parquet with one row a document, in ascending document order.

Columns: ``doc_id`` and ``n_tokens`` (delta-encoded), ``part`` and ``part_start`` (ids before the document within its
part), and ``tokens``, a list column with a dictionary of ids (bit-packed to the width that the row group needs). Row
groups and pages have fixed sizes and the writer adds page indexes, so a reader that selects a range of documents or
only the metadata columns does not touch the other pages.

Scale: the texts are exchanged once, by range of id; ids are made behind the exchange, so the larger id lists never
travel. Starts need only the sum of each part. A part holds about ``PART_BYTES`` of text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modengine.llm.scratch import scratch_path
from modengine.llm.tokens import Encoder
from modengine.llm.wordhash import row_slices

PART_BYTES = 32 << 20
END_ID = 0
CHUNK_BYTES = 6 << 20
#: Documents whose ids go back to Spark at once.
ROWS = 500
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, tokens array<int>"
WRITE = {
    "compression": "zstd",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#part_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, column: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with the ids of their texts (each with the end id behind it; null is the empty text) and the
    end of each text's ids."""
    encoder = Encoder.of(tokenizer)
    for whole in batches:
        for batch in row_slices(whole, whole.schema.names[column], CHUNK_BYTES):
            yield batch, *encoder.encode(batch.column(column), END_ID)


def _tokenise(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch, ids, ends in encoded(batches, path):
            starts = np.concatenate([[0], ends[:-1]])
            for at in range(0, len(ends), ROWS):  # Spark takes a batch of lists whole
                rows, to = slice(at, at + ROWS), ends[at : at + ROWS]
                tokens = pa.ListArray.from_arrays(pa.array(np.append(starts[at], to) - starts[at], pa.int32()), pa.array(ids[starts[at] : to[-1]].view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(to)), pa.array(np.full(len(to), part), pa.int32()), pa.array(before + starts[rows]), pa.array(to - starts[rows]), tokens], ["doc_id", "part", "part_start", "n_tokens", "tokens"])
            before += len(ids)

    return run


def write_token_files(docs: DataFrame, out: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as token files below ``out``, ids by the tokenizer file ``tokenizer``.

    Null text is empty (only the end id); rows of one id stay in the order of their texts; a null id comes first.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_tokenise(tokenizer), SCHEMA).write.options(**WRITE).parquet(out)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(4)
        values, offsets = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4"), lists.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(crc, pa.int64())], ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])


def token_digest(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in token files."""
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # reads two columns only
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = files.mapInArrow(_checksums, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def token_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write token files to the shared folder and digest what they hold."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer)
    return token_digest(read_token_files(spark, path))
