"""Mixing sources to target weights: raking of token weights by iterative proportional fitting, then calibrated sampling.

Tokens are counted by cell (source, language, topic). Raking multiplies the cells' weights, dimension by dimension, until
each marginal has its target share. A document is drawn with probability min(1, scale x weight), where the scale makes the
expected tokens equal the budget; where a cell's probability is cut at 1, the drawn documents carry the rest as a
multiplier, so weighted tokens meet the targets in expectation. Drawn documents without multipliers meet them where the
probabilities are ``bounded``: raked again under the limit of 1, so that uncut cells of the same value take up what cut
ones lack. A value whose target is more than all its tokens is then drawn whole, and its dimension's others share the rest.

Topics come from spherical k-means over hashed word frequencies. Up to ``SAMPLE`` different frequencies (those of smallest
hash) only give the starting points; each round sums over all documents, in whole numbers, so the result does not depend
on partitions or ids. Topics, counts and weights are over all documents.

Scale: texts are not exchanged; a round reads 64 bytes a document and sums them by topic in each task, and counts by cell are aggregated in part before the exchange. Up to ``DRIVER_CELLS`` cells are
raked on the driver and their probabilities broadcast; more are raked as a table and joined by cell with salted keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from modengine.llm.scratch import delete, fresh_name, kept, saved, scratch_path, temporary_tables
from modengine.llm.wordhash import U64, hash_words, row_slices, texts_of
from modengine.llm.workers import tidy

TOPICS = 8
FEATURES = 64
SAMPLE = 2000
#: Rounds of k-means over all documents, at most, and parts of a unit that their sums count in.
TOPIC_ROUNDS, PARTS = 25, 1 << 24
DRIVER_CELLS = 50_000
SALTS = 64
ROUNDS, TOLERANCE = 200, 1e-9
#: Power of a value's share of the tokens that is its target share where no target is given.
TEMPER = 0.7
#: Expected share of all tokens that is drawn.
BUDGET = 0.5
SEED = 42
CHUNK_BYTES = 1 << 20
DIMENSIONS = ("source", "lang", "topic")


def _frequencies(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and its hashed word frequencies as bytes (largest 255)."""
    words, counts = hash_words(texts)
    cell = np.repeat(np.arange(len(counts)), counts) * FEATURES + (words % U64(FEATURES)).astype(np.int64)
    f = np.sqrt(np.bincount(cell, minlength=len(counts) * FEATURES).reshape(-1, FEATURES))
    return counts, np.rint(255 * f / np.maximum(f.max(1, keepdims=True, initial=0), 1)).astype(np.uint8)


def _measure(text_at: int, keep: list[int], names: list[str]):
    """Columns ``keep`` of each row, its number of words, and its frequencies."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, whole.schema.names[text_at], CHUNK_BYTES):
                counts, f = _frequencies(texts_of(batch.column(text_at)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(counts, pa.int64()), pa.array([r.tobytes() for r in f], pa.binary())], names)

    return run


def _assign(text_at: int, names: list[str], centres: np.ndarray):
    """All columns of each row, its number of words, and its topic."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, whole.schema.names[text_at], CHUNK_BYTES):
                counts, f = _frequencies(texts_of(batch.column(text_at)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(nearest_topic(f.astype(float), centres))], names)

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_topics(features: np.ndarray, topics: int = TOPICS, rounds: int = TOPIC_ROUNDS) -> np.ndarray:
    """Unit centroids by spherical k-means; starts with the farthest of the points from those chosen before."""
    x = _unit(features)
    if not len(x):
        return np.eye(1, FEATURES)
    chosen = [0]
    for _ in range(min(topics, len(x)) - 1):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
    centres = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, 1)
        sums = np.stack([x[own == t].sum(0) if (own == t).any() else centres[t] for t in range(len(centres))])
        centres = _unit(sums)
    return centres


def _topic_sums(centres: np.ndarray):
    """Rows of frequencies to the sum of unit vectors of each topic, one row a task and topic."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centres), FEATURES), np.int64)
        for batch in batches:
            f = _unpack(batch.column(0).to_pylist())
            own, parts = nearest_topic(f, centres), np.rint(PARTS * _unit(f)).astype(np.int64)
            for t in range(len(sums)):
                sums[t] += parts[own == t].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), *(pa.array(c) for c in sums.T)], ["topic", *(f"s{i}" for i in range(FEATURES))])

    return run


def refine_topics(features: DataFrame, centres: np.ndarray, rounds: int = TOPIC_ROUNDS) -> np.ndarray:
    """``centres`` after rounds of spherical k-means over all of ``features`` (one binary column), until none moves."""
    schema = ", ".join(["topic int", *(f"s{i} long" for i in range(FEATURES))])
    for _ in range(rounds):
        found = features.mapInArrow(_topic_sums(centres), schema).groupBy("topic").agg(*[F.sum(f"s{i}") for i in range(FEATURES)]).collect()
        sums = {r[0]: np.array(r[1:], float) for r in found}
        moved = _unit(np.stack([sums[t] if t in sums and sums[t].any() else c for t, c in enumerate(centres)]))
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def _unpack(rows) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, FEATURES).astype(float)


def nearest_topic(features: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """In whole numbers, so a row gets the same topic in any batch."""
    return np.argmax(features.astype(np.int64) @ np.rint(PARTS * centres).astype(np.int64).T, 1).astype(np.int32)


def _topic(features: Column, centres: np.ndarray) -> Column:
    return F.pandas_udf(lambda column: pd.Series(nearest_topic(_unpack(column), centres)), "int")(features)


def tempered(shares: Mapping, power: float = TEMPER) -> dict:
    """Target shares that flatten ``shares``."""
    raised = {k: v**power for k, v in shares.items() if v > 0}
    whole = sum(raised.values())
    return {k: v / whole for k, v in raised.items()}


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Weights of cells such that in each dimension the weighted tokens have the target shares of their total.

    A value without tokens cannot get any: its target is left out and the others are scaled to one.
    """
    mass = tokens.astype(float)
    if not len(mass):
        return mass
    total = mass.sum()
    wanted = []
    for code, target in zip(codes, targets, strict=True):
        t = np.where(np.bincount(code, mass, len(target)) > 0, target, 0.0)
        wanted.append(total * t / t.sum() if t.sum() else t)
    for _ in range(rounds):
        off = 0.0
        for code, want in zip(codes, wanted, strict=True):
            have = np.bincount(code, mass, len(want))
            off = max(off, float(np.abs(have - want).max()) / max(total, 1))
            mass = mass * np.where(have > 0, want / np.maximum(have, 1e-300), 0.0)[code]
        if off < TOLERANCE:
            break
    return np.divide(mass, tokens, out=np.ones_like(mass), where=tokens > 0)


def scale(tokens: np.ndarray, weights: np.ndarray, budget: float) -> float:
    """The factor for which the sum of tokens x min(1, factor x weight) is ``budget`` (or all, if that is less)."""
    order = np.argsort(-weights, kind="stable")
    w, t = weights[order], tokens[order].astype(float)
    full = np.concatenate([[0.0], np.cumsum(t)])  # tokens of cells cut at 1
    rest = np.concatenate([np.cumsum((w * t)[::-1])[::-1], [0.0]])
    for i in range(len(w)):
        if rest[i] > 0:
            factor = (budget - full[i]) / rest[i]
            if factor * w[i] <= 1:
                return max(factor, 0.0)
    return 1.0 / float(w[w > 0].min()) if (w > 0).any() else 0.0


def bounded_probabilities(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], start: np.ndarray, budget: float, rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities, raked from ``start``, for which each dimension's expected tokens share ``budget`` by the targets."""
    mass, total, wanted = tokens * start, max(float(tokens.sum()), 1.0), []
    for code, target in zip(codes, targets, strict=True):
        have = np.bincount(code, tokens, len(target))
        rate = np.divide(target, have, out=np.zeros(len(target)), where=have > 0)
        wanted.append(have * np.minimum(1, scale(have, rate, budget) * rate))
    for _ in range(rounds):
        off = 0.0
        for code, want in zip(codes, wanted, strict=True):
            have = np.bincount(code, mass, len(want))
            off = max(off, float(np.abs(have - want).max(initial=0)) / total)
            mass = np.minimum(tokens, mass * np.where(have > 0, want / np.maximum(have, 1e-300), 0.0)[code])
        if off < TOLERANCE:
            break
    return np.divide(mass, tokens, out=start.astype(float), where=tokens > 0)


def _rake_small(cells: DataFrame, targets: Mapping[str, Mapping], budget: float, bounded: bool = False) -> DataFrame:
    """(DIMENSIONS, weight, probability, factor) for each cell, on the driver: there are at most ``DRIVER_CELLS``."""
    rows = sorted(cells.collect(), key=lambda r: [(r[d] is not None, r[d]) for d in DIMENSIONS])
    tokens = np.array([r["tokens"] for r in rows], float)
    codes, wanted = [], []
    for d in DIMENSIONS:
        values = list(dict.fromkeys(r[d] for r in rows))
        number = {v: i for i, v in enumerate(values)}
        codes.append(np.array([number[r[d]] for r in rows], np.int64))
        goal = targets.get(d) or tempered(dict(zip(values, np.bincount(codes[-1], tokens, len(values)).tolist(), strict=True)))
        wanted.append(np.array([goal.get(v, 0.0) for v in values]))
    weights = rake(tokens, codes, wanted)
    factor = scale(tokens, weights, budget * tokens.sum())
    chances = np.minimum(1.0, factor * weights)
    if bounded:
        chances = bounded_probabilities(tokens, codes, wanted, chances, budget * tokens.sum())
    made = [(*(r[d] for d in DIMENSIONS), float(w), float(p), float(factor)) for r, w, p in zip(rows, weights, chances, strict=True)]
    schema = ", ".join(f"{d} {cells.schema[d].dataType.simpleString()}" for d in DIMENSIONS) + ", weight double, probability double, factor double"
    return cells.sparkSession.createDataFrame(made, schema)


def _rounds(now: DataFrame, goals: Mapping[str, DataFrame], total: float, rounds: int, bounded: bool) -> DataFrame:
    """``now`` with its ``mass`` raked to ``goals`` (value, goal) by dimension; ``bounded`` by the tokens of a cell.

    A step sums the mass of each value of a dimension, in part before the exchange, and joins the factors back; a round is
    a written table that replaces the one before.
    """
    spark, columns, path = now.sparkSession, now.columns, None
    for _ in range(rounds):
        off = 0.0
        for d in DIMENSIONS:
            sums = now.groupBy(F.col(d).alias("value")).agg(F.sum("mass").alias("mass_sum"))
            steps = sums.join(goals[d].select(F.col("value").alias("goal_value"), "goal"), F.col("value").eqNullSafe(F.col("goal_value")))
            steps = saved(steps.select("value", F.abs(F.col("mass_sum") - F.col("goal")).alias("off"), F.when(F.col("mass_sum") > 0, F.col("goal") / F.col("mass_sum")).otherwise(F.lit(0.0)).alias("step")), "rake-steps")
            off = max(off, steps.agg(F.max("off")).first()[0] or 0.0)
            raked = F.col("mass") * F.coalesce("step", F.lit(1.0))
            now = now.join(steps, F.col(d).eqNullSafe(F.col("value")), "left").withColumn("mass", F.least(F.col("tokens").cast("double"), raked) if bounded else raked).select(*columns)
        before, path = path, scratch_path(spark, "raked")
        now.write.parquet(path)
        now = spark.read.schema(now.schema).parquet(path)
        if before:
            delete(spark, before)
        if off < TOLERANCE * max(total, 1):
            break
    return now


def _factor(table: DataFrame, weight: Column, tokens: Column, budget: float) -> float:
    """``scale`` over a table: raises the factor until the rows that it cuts at 1 stay the same; each step is exact for
    the rows cut before it."""
    factor, cut = 0.0, -1
    while True:
        over = weight * factor > 1
        full, rest, n, least = table.agg(F.sum(F.when(over, tokens).otherwise(0.0)), F.sum(F.when(~over, weight * tokens).otherwise(0.0)), F.count_if(over), F.min(F.when(weight > 0, weight))).first()
        if n == cut:
            return factor
        if not rest:
            return 1.0 / least if least else 0.0
        cut, factor = n, max((budget - full) / rest, 0.0)


def _rake_large(cells: DataFrame, targets: Mapping[str, Mapping], budget: float, bounded: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """The same over a table of cells."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goals, caps = {}, {}
    for d in DIMENSIONS:
        have = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("have")).filter("have > 0")
        if targets.get(d):
            given = spark.createDataFrame(list(targets[d].items()), f"given {cells.schema[d].dataType.simpleString()}, goal double")
            have = have.join(given, F.col("value").eqNullSafe(F.col("given")), "left").select("value", "have", F.coalesce("goal", F.lit(0.0)).alias("goal"))
        else:
            have = have.select("value", "have", F.pow("have", F.lit(TEMPER)).alias("goal"))
        have = saved(have, "rake-goals")
        whole = have.agg(F.sum("goal")).first()[0] or 1.0
        goals[d] = have.select("value", (F.col("goal") * total / whole).alias("goal"))
        if bounded:
            rate = F.col("goal") / F.col("have")
            caps[d] = have.select("value", (F.col("have") * F.least(F.lit(1.0), rate * _factor(have, rate, F.col("have"), budget * total))).alias("goal"))
    now = _rounds(cells.withColumn("mass", F.col("tokens").cast("double")), goals, total, rounds, False)
    now = now.withColumn("weight", F.when(F.col("tokens") > 0, F.col("mass") / F.col("tokens")).otherwise(F.lit(1.0)))
    factor = float(_factor(now, F.col("weight"), F.col("tokens"), budget * total))
    now = now.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * factor))
    if bounded:
        now = _rounds(now.withColumn("mass", F.col("tokens") * F.col("probability")), caps, total, rounds, True)
        now = now.withColumn("probability", F.when(F.col("tokens") > 0, F.col("mass") / F.col("tokens")).otherwise(F.col("probability")))
    return now.select(*DIMENSIONS, "weight", "probability", F.lit(factor).alias("factor"))


def _starting_points(measured: DataFrame, feats: str, seed: int) -> np.ndarray:
    """Up to ``SAMPLE`` different frequencies: copies count once, and ids do not matter."""
    different = measured.agg(F.approx_count_distinct(feats)).first()[0]
    # some four times the sample pass the bound on the hash, however many tasks there are
    bound = min(2**63 - 1, -(2**63) + (4 * SAMPLE << 64) // max(1, different))
    hashed = measured.select(F.xxhash64(F.lit(seed), F.col(feats)).alias("h"), feats).filter(F.col("h") <= F.lit(bound))
    return _unpack([r[1] for r in hashed.distinct().orderBy("h", feats).limit(SAMPLE).collect()])


def _decided(docs: DataFrame, out: str, id_col: str, text_col: str, source_col: str, lang_col: str, targets: Mapping[str, Mapping] | None, budget: float, driver_cells: int, seed: int, texts: bool, bounded: bool) -> DataFrame:
    """``docs`` with a struct ``out``: topic, n_tokens, weight, probability, sampled. Without ``texts``, that column goes.

    Texts are read twice where they stay, rather than written in between.
    """
    words, feats, topic = (fresh_name(docs, f"{out}_{k}") for k in ("words", "features", "topic"))
    at, fields = docs.columns.index(text_col), docs.schema.fields
    keep = [i for i, f in enumerate(fields) if i != at and (not texts or f.name in (id_col, source_col, lang_col))]
    schema = StructType([*(fields[i] for i in keep), StructField(words, LongType()), StructField(feats, BinaryType())])
    measured = saved(docs.mapInArrow(_measure(at, keep, schema.names), schema), "mix-measured")
    centres = refine_topics(measured.select(feats), fit_topics(_starting_points(measured.filter(F.col(words) > 0), feats, seed)))
    rows = measured.withColumn(topic, _topic(F.col(feats), centres)).drop(feats)
    cells = saved(rows.groupBy(F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), F.col(topic).alias("topic")).agg(F.sum(words).alias("tokens")), "mix-cells")
    if texts:
        full = StructType([*fields, StructField(words, LongType()), StructField(topic, IntegerType())])
        rows = docs.mapInArrow(_assign(at, full.names, centres), full)
    few = cells.count() <= driver_cells
    with temporary_tables(docs.sparkSession):
        chances = (_rake_small if few else _rake_large)(cells, dict(targets or {}), budget, bounded)
        chances = chances if few else kept(chances, "mix-chances")
    names = {c: fresh_name(rows, f"{out}_{c}") for c in chances.columns}
    chances = chances.toDF(*names.values())
    on = F.col(source_col).eqNullSafe(F.col(names["source"])) & F.col(lang_col).eqNullSafe(F.col(names["lang"])) & (F.col(topic) == F.col(names["topic"]))
    if few:
        joined = rows.join(F.broadcast(chances), on)  # every row has its cell: topics are the same in both passes
    else:
        left, right = fresh_name(rows, f"{out}_salt"), fresh_name(rows, f"{out}_salts")
        chances = chances.withColumn(right, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn(left, F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).join(chances, on & (F.col(left) == F.col(right)))
    draw = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(id_col)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    p, w = F.col(names["probability"]), F.col(names["weight"])
    multiplier = F.when(p > 0, w * F.col(names["factor"]) / p).otherwise(F.lit(0.0))
    made = F.struct(F.col(topic).alias("topic"), F.col(words).alias("n_tokens"), w.alias("weight"), p.alias("probability"), multiplier.alias("multiplier"), (draw < p).alias("sampled"))
    return joined.select(*[c for c in docs.columns if texts or c != text_col], made.alias(out))


def mixture(docs: DataFrame, targets: Mapping[str, Mapping] | None = None, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", driver_cells: int = DRIVER_CELLS, seed: int = SEED, bounded: bool = False) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, multiplier, sampled) for each row of ``docs``.

    targets: for "source", "lang" or "topic" a mapping of values to shares; missing dimensions get the tempered shares
    of the corpus. Tokens are words; null text has none. Null sources and languages are values like others. Rows that
    share an id, the null id too, are drawn together. The empty table gives no rows. weight is the raked weight of a token, multiplier what a drawn document counts for
    beyond its probability. ``bounded``: see above.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    measured = _decided(slim, "mix", "doc_id", "text", "source", "lang", targets, budget, driver_cells, seed, texts=False, bounded=bounded)
    return measured.select("doc_id", "source", "lang", "mix.*")


def sample_mixture(docs: DataFrame, targets: Mapping[str, Mapping] | None = None, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", driver_cells: int = DRIVER_CELLS, seed: int = SEED, bounded: bool = False) -> DataFrame:
    """The drawn rows of ``docs``, with their columns; draws are those of ``mixture``."""
    out = fresh_name(docs, "mix")
    return _decided(docs, out, id_col, text_col, source_col, lang_col, targets, budget, driver_cells, seed, texts=True, bounded=bounded).filter(F.col(out)["sampled"]).select(*docs.columns)
