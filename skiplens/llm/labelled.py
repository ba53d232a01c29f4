"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, seed: str) -> DataFrame:
    """(doc_id, text, label) of about `rows` labelled documents at most, drawn by a hash of the id.

    `usable` is a condition on doc_id.  Null ids and labels are left out; of
    several labels of an id the largest counts, of several documents of an id the
    one whose text has the least hash: rows are bounded, not only ids.
    """
    seen = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL").where(usable)
    seen = seen.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = seen.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    if n > rows:
        seen = seen.where(draw < rows / n)
    # its size is bounded by `rows`, whatever the size of the input
    found = docs.select("doc_id", "text").join(F.broadcast(seen.limit(2 * rows)), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
