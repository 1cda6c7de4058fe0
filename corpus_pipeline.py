"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, packing. Each stage's rows are written as
Parquet in the shared folder and reread, so a lost executor costs at most part of one stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from modengine.llm.bagminhash import drop_near_duplicates
from modengine.llm.mixing import sample_mixture
from modengine.llm.packing import pack
from modengine.llm.quality import keep_good
from modengine.llm.scratch import saved
from modengine.llm.substring import remove_repeats

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's limits."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class of near duplicates."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that repeat an earlier passage."""
    return remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the target mixture; they carry no multipliers, so probabilities are raked under their bound."""
    return sample_mixture(docs, bounded=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each token piece in the training sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]
#: SQL can express neither the signatures nor the raking; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
