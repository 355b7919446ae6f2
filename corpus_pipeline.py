"""A training-data pipeline of five stages; each reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treegauge.llm import common as C
from treegauge.llm.decontam import decontaminate
from treegauge.llm.lang_ecoc import identify, learn
from treegauge.llm.minhash_tensor import near_duplicates
from treegauge.llm.mixing import blocks
from treegauge.llm.sharding import sharded

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and all where no language is learned; ambiguous texts, and texts of unlearned languages, stay."""
    model = learn(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    names = C.kept_names(docs.columns, ("lang_pred", "score", "ambiguous"))
    return identify(docs, model).where("lang_pred <> 'und'").select(*names).toDF(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id, once.

    Rows of one doc_id are one document, of which the least text stays. Rows without doc_id stay.
    """
    groups = near_duplicates(docs.select("doc_id", "text"), words=5, percent=80)
    stays = groups.where("kept").select("doc_id").distinct()
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    rows = docs.select("doc_id", "text", C.row_of(docs), F.xxhash64(*plain).alias("h_"))
    own = rows.where("doc_id is not null").join(stays, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("row_", F.struct("text", "h_")).alias("row_"))
    return own.select("row_").union(rows.where("doc_id is null").select("row_")).select("row_.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate(docs, C.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, once for each block in which it is shown."""
    return blocks(docs).select(*C.kept_names(docs.columns, ("block", "place_key"))).toDF(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    return sharded(docs, shards=8)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicate", near_duplicate),
    ("benchmark", benchmark),
    ("mixture", mixture),
    ("shards", shards),
]

#: SQL can't express the classifier and the MinHash tables; tests/llm has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = C.materialize(docs)
    return docs
