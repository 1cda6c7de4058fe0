"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

Vectors are scaled to unit length and turned by pseudo-random rotations (three rounds of random signs and a fast
Hadamard transform); a hash is the signed axis nearest to the turned vector, and a table's key joins the hashes of as
many rotations as the number of rows needs. A query looks into the ``probes`` keys that are nearest to it in each table.
The members of a bucket are compared with the queries that look into it by exact distance, and each query's best are
merged.

Equal vectors are folded first, those of queries too: only the ``k + 1`` smallest ids of a vector can be among a query's
``k`` nearest, so a vector that fills a third of the table is one entry with ``k + 1`` ids and one question. Buckets with
many entries or questions are split into a grid of cells of ``CELL`` entries and ``ASKED`` questions at most, about, so no
task holds an unbounded bucket. Vectors are compared with those of their own length.

Scale: what is exchanged is a vector a table for entries, and one a probed key for questions. Comparing where buckets meet
gives lists of ``k + 1`` a question and cell; pairs of ids would be more rows than there are vectors. Keys are computed
twice, for the sizes of buckets and for the search, rather than written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modengine.llm.scratch import saved
from modengine.llm.wordhash import U64, mix

K = 10
CELL, ASKED = 20_000, 2_000
#: Distances that a task holds at once.
PAIRS = 2_000_000
#: Entries that the mean bucket of a table has, about.
BUCKET = 200
#: Tables, and keys that a query looks into in each, for up to ``BASE_KEYS`` keys; beyond, they grow with the keys.
TABLES, PROBES, BASE_KEYS = 8, 16, 128
TABLES_POWER, PROBES_POWER = 0.25, 0.5
ROUNDS = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two long), orthonormal."""
    n, out, h = x.shape[1], x, 1
    while h < n:
        out = out.reshape(len(x), -1, 2, h)
        out = np.stack([out[:, :, 0] + out[:, :, 1], out[:, :, 0] - out[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return out / np.sqrt(n)


def _signs(seed: int, n: int) -> np.ndarray:
    return np.where(mix(np.arange(n, dtype=U64) + U64(seed * 1_000_003 + 7)) & U64(1), 1.0, -1.0)


def rotations(x: np.ndarray, table: int, widths: tuple[int, ...]) -> list[np.ndarray]:
    """Pseudo-random rotations of the rows, padded to a power of two; of each the first ``width`` coordinates."""
    n = max(2, 1 << (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), n))
    padded[:, : x.shape[1]] = x
    out = []
    for r, width in enumerate(widths):
        turned = padded
        for step in range(ROUNDS):
            turned = hadamard(turned * _signs(1 + step + ROUNDS * (r + len(widths) * table), n))
        out.append(turned[:, :width])
    return out


def layout(entries: int, dimensions: int, bucket: int = BUCKET) -> tuple[int, ...]:
    """Coordinates that each rotation of a key uses: as many keys as give buckets of about ``bucket`` entries."""
    n, keys, widths = max(2, 1 << (dimensions - 1).bit_length()), max(2.0, entries / bucket), []
    while keys > 2 * n:
        widths.append(n)
        keys /= 2 * n
    return (*widths, min(n, 1 << max(0, math.ceil(math.log2(keys / 2)))))


def effort(widths: tuple[int, ...]) -> tuple[int, int]:
    """Tables and probes for a layout: with more keys a neighbour's key is further down, and less of the table is read."""
    more = max(1.0, math.prod(2 * w for w in widths) / BASE_KEYS)
    return math.ceil(TABLES * more**TABLES_POWER), math.ceil(PROBES * more**PROBES_POWER)


def _keys(x: np.ndarray, table: int, widths: tuple[int, ...], probes: int) -> np.ndarray:
    """The keys of each row in a table that cost least, best first: (rows, up to ``probes``).

    A signed axis costs the square of what its coordinate lacks to the largest; a key costs the sum over its rotations.
    """
    both = [np.concatenate([t, -t], 1) for t in rotations(x, table, widths)]
    if probes == 1:
        code = np.zeros(len(x), np.int64)
        for b in both:
            code = code * b.shape[1] + np.argmax(b, 1)
        return code[:, None]
    order = [np.argsort(-b, 1, kind="stable")[:, :probes] for b in both]
    lack = [np.take_along_axis(b, o, 1) for b, o in zip(both, order, strict=True)]
    lack = [(v[:, :1] - v) ** 2 for v in lack]
    # a combination whose ranks multiply to more than ``probes`` has that many cheaper ones
    few = [c for c in product(*(range(o.shape[1]) for o in order)) if math.prod(i + 1 for i in c) <= probes]
    cost, code = np.zeros((len(x), len(few))), np.zeros((len(x), len(few)), np.int64)
    for n, c in enumerate(few):
        for j, i in enumerate(c):
            cost[:, n] += lack[j][:, i]
            code[:, n] = code[:, n] * both[j].shape[1] + order[j][:, i]
    return np.take_along_axis(code, np.argsort(cost, 1, kind="stable")[:, :probes], 1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.values if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().values
    return np.asarray(flat.to_numpy(zero_copy_only=False), float).reshape(len(column), -1) if len(column) else np.empty((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; divided by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _index(layouts: dict[int, tuple[int, ...]], probing: bool, vectors: bool = True):
    """Rows (id, vector) to one row for each table and, if ``probing``, for each key that a question looks into."""
    names = ["dim", "tab", "key", "id", *(["vector"] if vectors else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                sizes = pc.list_value_length(batch.column(1)).to_numpy()
                for dim in np.unique(sizes).tolist():
                    some = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                    x, (tables, probes) = unit(_matrix(some.column(1))), effort(layouts[dim])
                    for table in range(tables):
                        keys = _keys(x, table, layouts[dim], probes if probing else 1)
                        rows = pa.array(np.repeat(np.arange(len(x)), keys.shape[1]))
                        columns = [pa.array(np.full(len(rows), dim), pa.int32()), pa.array(np.full(len(rows), table), pa.int32()), pa.array(keys.ravel()), some.column(0).take(rows)]
                        yield pa.RecordBatch.from_arrays([*columns, *([some.column(1).take(rows)] if vectors else [])], names)

    return run


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``q`` from those of ``x``; components are summed in order, as a loop would."""
    total = np.zeros((len(q), len(x)))
    for a, b in zip(np.ascontiguousarray(x.T), q.T, strict=True):
        step = a[None, :] - b[:, None]
        step *= step
        total += step
    return np.sqrt(total)


_FOUND = "question long, near array<struct<score:double,entry:long>>"


def _nearest(k: int):
    """The ``k + 1`` nearest entries of each question in one cell of a bucket (its own may be among them)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        entries, scores, counts, own = [np.empty(0, np.int64)], [np.empty(0)], [[0]], left.column("id").to_numpy()
        if left.num_rows and right.num_rows:
            q, x = _matrix(left.column("vector")), _matrix(right.column("vector"))
            number = right.column("id").to_numpy()
            step = max(1, PAIRS // len(x))
            for at in range(0, len(q), step):
                d = _distances(x, q[at : at + step])
                reach = np.partition(d, k, 1)[:, k] if len(x) > k + 1 else np.full(len(d), np.inf)
                row, column = np.nonzero(d <= reach[:, None])
                order = np.lexsort((number[column], d[row, column], row))
                row, column = row[order], column[order]
                first = np.searchsorted(row, np.arange(len(d)))
                kept = np.arange(len(row)) - first[row] <= k
                entries.append(number[column[kept]])
                scores.append(d[row[kept], column[kept]])
                counts.append(np.bincount(row[kept], minlength=len(d)))
        else:
            own = own[:0]
        near = pa.StructArray.from_arrays([pa.array(np.concatenate(scores)), pa.array(np.concatenate(entries))], ["score", "entry"])
        return pa.table({"question": own, "near": pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), near)})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's ``k`` nearest other rows found, by Euclidean distance.

    Vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without an id. A vector
    is near only to vectors of its own length. Ties go to the smaller id. A row is never its own neighbour; rows that share
    an id are one item, as near as the nearest of them. No usable vector: no rows. Other columns are not read.
    """
    spark, width = vectors.sparkSession, "vector " + vectors.schema[vector_col].dataType.simpleString()

    def usable(df: DataFrame) -> DataFrame:
        fine = F.forall(vector_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(vector_col, lambda x: x != 0)
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter(F.col("id").isNotNull() & fine)

    # the smallest ids of equal vectors; the limit holds before the exchange too
    ranked = usable(vectors).distinct().withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).filter(F.col("n") <= k + 1)
    entries = saved(ranked.groupBy("vector").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    # an id may stand on several vectors, so entries get a number of their own
    entries = saved(entries.withColumn("entry", F.monotonically_increasing_id()), "entries")
    layouts = {r["dim"]: layout(r["n"], r["dim"]) for r in entries.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()}
    rows = usable(queries).distinct()
    asked = saved(rows.select("vector").distinct().withColumn("question", F.monotonically_increasing_id()), "questions")
    asking = rows.join(asked, "vector").select(F.col("id").alias("query_id"), "question")
    known = [r[0] for r in asked.select(F.size("vector")).distinct().collect() if r[0] not in layouts]
    layouts |= {dim: layout(1, dim) for dim in known}
    schema = "dim int, tab int, key long, id long"
    by = ("dim", "tab", "key")

    def keyed(df: DataFrame, number: str, probing: bool, whole: bool) -> DataFrame:
        return df.select(number, "vector").mapInArrow(_index(layouts, probing, whole), f"{schema}, {width}" if whole else schema)

    chunks = lambda most, out: F.ceil(F.count("*") / most).cast("int").alias(out)
    sizes = [keyed(entries, "entry", False, False).groupBy(*by).agg(chunks(CELL, "cells")).filter("cells > 1"), keyed(asked, "question", True, False).groupBy(*by).agg(chunks(ASKED, "asks")).filter("asks > 1")]
    large = saved(sizes[0].join(sizes[1], [*by], "full"), "large-buckets")
    one = lambda c: F.coalesce(c, F.lit(1))
    part = lambda c: F.pmod(F.xxhash64("id"), one(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), one(c) - 1))
    right = keyed(entries, "entry", False, True).join(large, [*by], "left").withColumn("cell", part("cells")).withColumn("ask", every("asks")).drop("cells", "asks")
    left = keyed(asked, "question", True, True).join(large, [*by], "left").withColumn("ask", part("asks")).withColumn("cell", every("cells")).drop("cells", "asks")
    grid = (*by, "cell", "ask")
    found = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInArrow(_nearest(k), _FOUND)
    # a question's lists are at most tables x probes x cells of k + 1 entries; an entry found twice has one score
    lists = found.groupBy("question").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    once = F.filter("near", lambda x, i: (i == 0) | (x != F.get("near", i - 1)))
    # cut at the score of place k + 1, ties included
    reach = F.filter("near", lambda x: x["score"] <= F.coalesce(F.get("near", F.lit(k))["score"], F.lit(float("inf"))))
    best = lists.select("question", once.alias("near")).select("question", F.explode(reach).alias("b")).select("question", "b.*")
    items = best.join(entries.select("entry", "ids"), "entry").select("question", "score", F.explode("ids").alias("vec_id"))
    items = items.groupBy("question", "vec_id").agg(F.min("score").alias("score"))
    first = items.withColumn("n", F.row_number().over(Window.partitionBy("question").orderBy("score", "vec_id"))).filter(F.col("n") <= k + 1).drop("n")
    pairs = asking.join(first, "question").filter("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
