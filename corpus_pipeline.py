"""A corpus pipeline: toxicity, line dedup, n-gram Jaccard join, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept; run() writes each result as Parquet to the shared checkpoint
folder and reads it again for the next.  The folder of the last but one stage
stays, since the result of run() is read from it.

All stages take an empty table (and return one), equal rows, repeated ids and
very long texts, which are handled whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skiplens.llm import line_dedup, mixing, ngram_join, sentencepiece_codec, toxicity
from skiplens.llm.common import checkpoint, documents, ensure_checkpoint_dir, held_out

#: Links between near copies, the classifier and token ids can't be expressed in SQL; tests/llm/test_pipeline.py
#: computes all stages again in plain Python, given only the classifier's scores.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels outside the held-out fold, doesn't reject.

    Null and empty texts score 0 and stay; so do rows with a null id unless
    their text is toxic.  Equal rows stay or go together.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("doc_id"), 4, 2))
    return toxicity.drop_toxic(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without their widely repeated lines; n_chars follows the text.

    Null texts stay null with their n_chars; rows with a null id stay as they
    are; rows that repeat an id count as one document.
    """
    out = line_dedup.dedup_lines(docs, carry=True)
    size = F.when(F.col("text").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast("long"))
    new = {"text": F.col("text"), "n_chars": size}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, of several such rows the one with the least hash.

    Texts that are null or without words, and rows with a null id, are linked
    with nothing and all stay.  Rows are told apart by a 64-bit hash of all
    their columns, and of equal rows in a group one stays.
    """
    tag = F.xxhash64(*docs.columns)
    rows = ngram_join.similar_documents(docs, tag=tag).where("n_shingles > 0 AND doc_id IS NOT NULL")
    rows = rows.groupBy("group", "doc_id", "tag").agg(F.count("*").alias("n"))
    keepers = rows.groupBy("group").agg(F.min(F.struct("doc_id", "tag")).alias("keeper"), F.sum("n").alias("rows")).where(F.col("rows") > 1)
    rows = checkpoint(rows.join(keepers, "group").select("doc_id", "tag", "n", (F.struct("doc_id", "tag") == F.col("keeper")).alias("kept")))
    keys = ["doc_id", "tag"]
    tagged = docs.withColumn("tag", tag)
    repeated = rows.where("kept AND n > 1").select(*keys)
    if repeated.isEmpty():
        return tagged.join(rows.where("NOT kept").select(*keys), keys, "left_anti").select(*docs.columns)
    once = tagged.join(repeated, keys, "left_semi").dropDuplicates(keys)
    others = tagged.join(rows.where("NOT kept OR n > 1").select(*keys), keys, "left_anti")
    return others.unionByName(once).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it.

    A null source is one of its own.  Null texts and those without words add
    nothing to the mix; they are taken by their hash like others.
    """
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of each row that is left: the ids of its text, and the hash of what they decode to.

    Null and empty texts have no ids; null ids of documents are passed on.
    """
    out = sentencepiece_codec.encode_texts(docs, sentencepiece_codec.Vocabulary.load(), lean=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("n-gram Jaccard join", one_of_each), ("mixing", mix), ("SentencePiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return STAGES[-1][1](spark, docs, sf_dir)
