"""Quality rules with thresholds learned per language and source from mergeable quantile sketches; DataFrame functions only.

A sketch is a log-linear histogram: values keep their six leading bits, so a quantile is right to 1/32 of itself, counts
of two sketches simply add, and the result is the same whatever the order of merging. Sketches are made per (language,
source) over the documents that pass the base rules, merged to languages and to the whole, and the finest level with
enough documents sets a group's limits: the nine-tenths quantile plus three times its distance from the median, at least
a margin (and likewise below for word length). Limits are joined to the documents and decide.

Scale: no text is exchanged. Measures are row-local; what is exchanged is one count a (group, measure, bucket). Limits
are broadcast while there are at most ``BROADCAST_GROUPS`` groups, and otherwise joined with salted keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modengine.llm.scratch import fresh_name, kept, saved, temporary_tables

BLANKS = r"[ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"
REPEAT_WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A group with fewer documents takes the limits of its language, and a language those of the whole.
MIN_DOCS = 200
#: Groups (about 100 bytes each) up to which limits are broadcast.
BROADCAST_GROUPS = 50_000
SALTS = 64
#: Measures (per mille, or hundredths of a character) with the least distance of a limit from the quantile.
MARGINS = {"symbols_pm": 150, "dup_lines_pm": 300, "repeats_pm": 200, "word_len": 200}
BELOW = ("word_len",)


def measures(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    names = {k: fresh_name(docs, f"{out}{k}") for k in ("text", "words", "lines", "grams", "sorted", "places")}
    text, words, lines, grams, order, places = (F.col(names[k]) for k in names)
    keep = docs.columns
    step = docs.withColumn(names["text"], F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    step = step.withColumns({names["words"]: F.filter(F.split(text, BLANKS), lambda w: w != ""), names["lines"]: F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))})
    gram = F.transform(F.slice(words, 1, F.greatest(F.size(words) - (REPEAT_WINDOW - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, REPEAT_WINDOW)]))
    base = F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), F.size(F.split(text, SYMBOLS)).cast("long").alias("n_symbols"), F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))
    step = step.select(*keep, base.alias(names["text"]), gram.alias(names["grams"]))
    # only texts with a repeated window need its places: equal hashes are neighbours once sorted
    repeats = F.size(F.array_distinct(grams)) < F.size(grams)
    pairs = F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    step = step.select(*keep, text, F.when(repeats, F.sort_array(pairs)).otherwise(F.slice(pairs, 1, 0)).alias(names["sorted"]))
    twice = F.filter(order, lambda x, i: F.coalesce(x["h"] == F.get(order, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(order, i + 1)["h"], F.lit(False)))
    step = step.select(*keep, text, F.sort_array(F.transform(twice, lambda x: x["i"])).alias(names["places"]))
    covered = F.aggregate(F.transform(places, lambda p, k: F.coalesce(F.least(F.lit(REPEAT_WINDOW), p - F.get(places, k - 1)), F.lit(REPEAT_WINDOW))), F.lit(0).cast("long"), lambda total, n: total + n)
    made = F.struct(text["n_words"].alias("n_words"), text["word_chars"].alias("word_chars"), (text["n_symbols"] - 1).alias("n_symbols"), text["n_lines"].alias("n_lines"), text["n_dup_lines"].alias("n_dup_lines"), covered.alias("n_repeat_words"))
    # a filter on the measures must not be pushed below them: it would repeat their expressions for each use
    return step.select(*keep, F.when(F.monotonically_increasing_id() >= 0, made).alias(out))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def ratios(m: Column) -> dict[str, Column]:
    """The measures that get limits, as whole numbers; null where the text has no word."""
    whole = lambda a, b: F.when(b > 0, F.floor(a / b)).cast("long")
    return {"symbols_pm": whole(1000 * m["n_symbols"], m["word_chars"]), "dup_lines_pm": whole(1000 * m["n_dup_lines"], m["n_lines"]), "repeats_pm": whole(1000 * m["n_repeat_words"], m["n_words"]), "word_len": whole(100 * m["word_chars"], m["n_words"])}


def bucket(v: Column) -> Column:
    """The least value that shares the six leading bits of ``v``."""
    drop = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def sketches(measured: DataFrame, m: str, group: list[str]) -> DataFrame:
    """(lang, source, measure, bucket, n): the sketches of the documents that pass the base rules."""
    values = F.array(*[F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in ratios(F.col(m)).items()])
    good = measured.filter(~base_failed(F.col(m))).select(F.col(group[0]).alias("lang"), F.col(group[1]).alias("source"), F.explode(values).alias("v"))
    return good.groupBy("lang", "source", "v.measure", "v.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sum of sketches that share ``keys``."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, total, q10, q50, q90): the least bucket that reaches the share of the count."""
    by = Window.partitionBy(*keys, "measure")
    run = sketch.withColumns({"total": F.sum("n").over(by), "upto": F.sum("n").over(by.orderBy("bucket"))})
    reach = lambda tenths: F.min(F.when(10 * F.col("upto") >= tenths * F.col("total"), F.col("bucket"))).alias(f"q{tenths}0")
    return run.groupBy(*keys, "measure").agg(F.max("total").alias("total"), reach(1), reach(5), reach(9))


def limits(sketch: DataFrame) -> DataFrame:
    """(lang, source, limits) for each group of ``sketch``; limits is a map from measure to (low, high)."""
    margin = F.create_map(*[F.lit(x) for kv in MARGINS.items() for x in kv])[F.col("measure")].cast("long")
    high = F.col("q90") + F.greatest(3 * (F.col("q90") - F.col("q50")), margin)
    low = F.when(F.col("measure").isin(*BELOW), F.col("q10") - F.greatest(3 * (F.col("q50") - F.col("q10")), margin))
    bound = F.struct(low.alias("low"), high.alias("high"))

    def level(keys: list[str], name: str) -> DataFrame:
        found = _quantiles(merged(sketch, keys), keys).select(*keys, "measure", "total", bound.alias("b"))
        return found.groupBy(*keys).agg(F.max("total").alias(f"{name}_n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("measure", "b")))).alias(name))

    fine, mid, all_ = level(["lang", "source"], "fine"), level(["lang"], "mid"), level([], "all")
    both = fine.join(mid.withColumnRenamed("lang", "mid_lang"), F.col("lang").eqNullSafe(F.col("mid_lang")), "left").join(F.broadcast(all_))  # one row
    return both.select("lang", "source", F.when(F.col("fine_n") >= MIN_DOCS, F.col("fine")).when(F.col("mid_n") >= MIN_DOCS, F.col("mid")).otherwise(F.col("all")).alias("limits"))


def learned_limits(measured: DataFrame, m: str, group: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The table of ``limits`` from all rows of ``measured``."""
    with temporary_tables(measured.sparkSession):
        return kept(limits(saved(sketches(measured, m, list(group)), "quality-sketches")), "quality-limits")


def judged(measured: DataFrame, m: str, out: str, table: DataFrame, group: tuple[str, str] = ("lang", "source"), broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """``measured`` with a boolean ``out``: passes the base rules and the limits of its group in ``table``.

    Null languages and sources are groups like others. A group of which no document passes the base rules has no limits.
    """
    names = {k: fresh_name(measured, f"{out}_{k}") for k in ("lang", "source", "limits", "salt")}
    table = table.toDF(names["lang"], names["source"], names["limits"])
    on = F.col(group[0]).eqNullSafe(F.col(names["lang"])) & F.col(group[1]).eqNullSafe(F.col(names["source"]))
    if table.count() <= broadcast_groups:
        joined = measured.join(F.broadcast(table), on, "left")
    else:
        salt, right = names["salt"], fresh_name(measured, f"{out}_right")
        table = table.withColumn(right, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = measured.withColumn(salt, F.pmod(F.xxhash64(m), F.lit(SALTS)).cast("int"))
        joined = salted.join(table, on & (F.col(salt) == F.col(right)), "left")
    verdict = ~base_failed(F.col(m))
    for measure, value in ratios(F.col(m)).items():
        bound = F.col(names["limits"])[measure]
        verdict = verdict & F.coalesce(value <= bound["high"], F.lit(True)) & F.coalesce(value >= bound["low"], F.lit(True))
    return joined.select(*measured.columns, verdict.alias(out))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """A row for each row of ``docs``: the base measures, base_failed and kept.

    Null and empty texts have no words and fail; long texts are measured whole. Repeated rows are judged alike, and each
    counts in the sketches. The empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(group[0]).alias("lang"), F.col(group[1]).alias("source"))
    measured = saved(measures(slim, "text", "m").drop("text"), "quality-measures")
    rows = judged(measured, "m", "kept", learned_limits(measured, "m"))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", *[F.col(f"m.{f}").alias(f) for f in fields], base_failed(F.col("m")).alias("base_failed"), "kept")


def keep_good(docs: DataFrame, text_col: str = "text", group: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    Measures are made twice, for the limits and for the verdicts, rather than written with the texts in between.
    Null texts, repeated rows and the empty table are as in ``quality_report``.
    """
    m, passed = fresh_name(docs, "measures"), fresh_name(docs, "passed")
    measured = measures(docs, text_col, m)
    slim = measures(docs.select(*dict.fromkeys((text_col, *group))), text_col, m).select(*dict.fromkeys(group), m)
    return judged(measured, m, passed, learned_limits(slim, m, group), group).filter(F.col(passed)).select(*docs.columns)
