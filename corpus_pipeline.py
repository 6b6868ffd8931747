"""The training-data pipeline: five stages over ``documents``, each written and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the documents it keeps, with their columns, the last one the packed
pieces. ``run`` applies them in order; every result is written as Parquet to
the shared checkpoint folder and read back, so a lost executor repeats at most
one stage's task. Null or empty texts, repeated rows, extra columns and empty
tables pass as each stage's module describes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citesight.llm import chunk_dedup, decontaminate, packing, simhash, toxicity
from citesight.llm.common import stage, table
from citesight.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chunk_dedup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("chunk_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: Sum-of-squares packing and the trained model have no SQL form; tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
