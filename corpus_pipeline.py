"""A corpus pipeline of four of the operators: toxicity, language ID, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns documents; the last
returns the packed pieces. Each stage's result is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, packing, sketch_dedup, toxicity
from tidemark.llm.names import free_name
from tidemark.llm.storage import cut

TOXIC_FROM = 0.7
SIMILARITY = 0.8
LEAST_POSTERIOR = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC_FROM; empty and null texts stay, as nothing in them is toxic."""
    model, name = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), free_name(docs, "toxicity")
    return toxicity.score(docs, model, name).filter((F.col(name) < TOXIC_FROM) | (F.coalesce(F.length("text"), F.lit(0)) == 0)).drop(name)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a posterior of LEAST_POSTERIOR or more; ``und`` goes."""
    name = free_name(docs, "language")
    found = language_id.predict(docs, language_id.train(docs), into=name)
    return found.filter((F.col(name)["lang_pred"] != language_id.UNKNOWN) & (F.col(name)["score"] >= LEAST_POSTERIOR)).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id; documents without words stay. Rows
    with a null doc_id are compared with nothing and all stay; of rows that repeat a doc_id and its text one stays."""
    groups = sketch_dedup.near_duplicates(docs, SIMILARITY)
    known, bare = docs.filter("doc_id is not null"), docs.filter("doc_id is null")
    kept = known.join(groups.filter("kept").select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)
    return kept.dropDuplicates(["doc_id", "text"]).unionByName(bare)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024, end_id=2)


STAGES = [("toxicity", drop_toxic), ("language_id", keep_languages), ("near_dedup", drop_near_duplicates), ("packing", pack)]
#: SQL cannot express the trained stages or the packing; tests/llm holds the near-duplicate and packing stages against brute
#: force and the trained stages by rates, and their models against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
