"""The training-data pipeline: language ID, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is written as Parquet before the next.
The mix is written in its order, a range of it a file; packing takes its rows as it reads them.

Defined results: null and empty texts go in the first stage, as no language is known for them; of texts equal but for A-Z the
row with the largest doc_id stays; of near-duplicates that with the smallest; texts of any length are read whole; an empty
table gives an empty result; columns beyond those of ``documents`` are kept, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.exact_dedup import exact_dedup
from quillon.llm.language_id import keep_known_languages
from quillon.llm.minhash import near_dedup
from quillon.llm.mixing import mixed
from quillon.llm.packing import pack
from quillon.llm.shared import written
from quillon.session import table

#: Two stages (a trained classifier, signatures) can't be said in SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known_languages(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
