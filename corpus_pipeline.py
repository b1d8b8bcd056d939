"""A corpus pipeline of five stages over ``documents``; counted as part of the llm subpackage.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. Its rows are written as Parquet in the folder of
spark.checkpoint.dir and read again as the next stage's documents. All stages but the last return the columns of
their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mintleaf.llm import bpe, exact_dedup, language, mixing, near_dedup
from mintleaf.llm.common import written

#: The mix reads no source more often than this, and every document at least once.
REPETITION_LIMIT = 1.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null texts, texts without a letter, and texts of n-grams that no learned language has."""
    return language.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for A-Z case, the document with the largest id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a component of near copies, the document with the least id stays."""
    return near_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, by their weights in the mix, in the order of no particular source."""
    return mixing.mix(docs, repetition_limit=REPETITION_LIMIT)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens, ids (decimal, joined by one space) and decoded, for the 49k word-splitting vocabulary."""
    import public_tokenizers

    coded = bpe.encode_texts(docs.drop("n_tokens", "ids", "decoded"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(*[F.col(f"`{c}`") for c in coded.columns if c != "encoded"], "encoded.n_tokens", "encoded.ids", "encoded.decoded")


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: SQL can't express a trained classifier, nor a MinHash search; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
