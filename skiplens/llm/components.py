"""Connected components of a link table by alternating large and small stars.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).
Links never leave the executors; each round is written to the checkpoint
folder.  Minima are aggregated before they are shuffled, and the joins are
plain equi-joins, so AQE can split the partition of a vertex with many links.
What is left of up to LOCAL_LINKS links once each task has merged its own is
joined by one task, as a round costs five shuffles however few they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Links that one task looks at together, 16 bytes each.  More links in all than that go by rounds.
LOCAL_LINKS = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the components of the links (a, b): (vertex, smallest vertex of its component)."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    out = np.flatnonzero(label != np.arange(len(ids)))
    return ids[out], ids[label[out]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v, held = [], [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(np.concatenate(u), np.concatenate(v))], names=["u", "v"])

    for batch in batches:
        u.append(batch.column("u").to_numpy())
        v.append(batch.column("v").to_numpy())
        held += batch.num_rows
        if held >= LOCAL_LINKS:
            yield flush()
            u, v, held = [], [], 0
    if held:
        yield flush()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vertex, component) of all links at once."""
    got = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if got:
        vertex, low = forest(*(np.concatenate(x) for x in zip(*got, strict=True)))
        least = np.unique(low)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([vertex, least])), pa.array(np.concatenate([low, least]))], names=["vertex", "component"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) of every vertex with a link to another one; `component` is its smallest vertex.

    Links are pairs of longs in any order; rows with a null, loops and
    repeated links change nothing.  No links: an empty result.
    """
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = checkpoint(e.mapInArrow(_local, "u long, v long"))
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    before = mark(e)
    if before[0] <= LOCAL_LINKS:
        return e.coalesce(1).mapInArrow(_stars, "vertex long, component long")
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = large.where("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(small.union(least).distinct())
        after = mark(e)
        if after == before:
            break
        before = after
    stars = e.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return stars.union(e.select("v", "v").distinct())
