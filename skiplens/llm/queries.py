"""The queries of this subpackage and their SQL, for ``__spark_entry__``.

Each query applies its operator to the whole of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import embed_dedup, langid, line_dedup, media, mixing, ngram_join, quality, sentencepiece_codec, suffix_dedup, toxicity
from .common import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(documents(spark, sf_dir)))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.store_media(documents(spark, sf_dir)))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest(documents(spark, sf_dir), sentencepiece_codec.Vocabulary.load())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(documents(spark, sf_dir)))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_line_dedup, op3_ngram_jaccard, op4_toxicity, op5_media_columns,
        op6_embedding_dedup, op7_quality, op8_sentencepiece, op9_mixing, op10_suffix_dedup,
    )
}
ORACLE_SQL = {"op2_line_dedup": line_dedup.ORACLE_SQL, "op9_mixing": mixing.ORACLE_SQL}
