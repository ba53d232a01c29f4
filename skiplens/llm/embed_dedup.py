"""Embedding near-dedup: spherical k-means cells and blocked cosine products.

Equal vectors are merged first.  Centroids are fitted on a bounded sample, and
where one level of cells would be too coarse, each cell is divided again by
centroids fitted on a sample of its own vectors.  Every vector has a home cell
and also visits cells whose centroid is almost as near.  Within a cell, split
into blocks if it is large, cosines are taken as matrix products in double
precision, so no link below the threshold is ever made; a link is missed only
if neither vector visits the other's home.  Links are counted in place and
leave a task as counts and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from .common import checkpoint
from .components import connected_components, forest

#: Numbers in the sample that the cells are fitted on, and rounds of k-means.
FIT_VALUES, ROUNDS = 2_000_000, 10
#: Vectors wanted in a cell, the most cells of the first level and of the second in each of these, and the sample for one of these.
CELL_ROWS, MAX_TOP, MAX_SUB, SUB_ROWS = 2_000, 1_024, 64, 16
#: A vector visits cells whose centroid has a cosine at most this much below its home's.  2.0 visits all cells: exact, at the cost of all pairs of cells.
MARGIN = 0.08
#: Vectors in a block of a cell.
BLOCK_ROWS = 4_096
THRESHOLD = 0.9


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_cells(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Unit centroids [cell, dimension] of unit rows by spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), size=min(k, len(x)), replace=False))]
    for _ in range(ROUNDS):
        home = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


class Cells:
    """Cells of vectors of one length: top centroids, and for each of them perhaps its own; numbered from `base`."""

    def __init__(self, base: int, top: np.ndarray):
        self.base, self.top, self.sub = base, top, [None] * len(top)

    def number(self) -> int:
        """Gives the cells their numbers; returns the next free one."""
        size = [1 if s is None else len(s) for s in self.sub]
        self.first = self.base + np.concatenate([[0], np.cumsum(size)])
        return int(self.first[-1])

    def visits(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home of each unit row; row and cell of each visit, home included, by row and cell)."""
        sim = x @ self.top.T
        row, top = np.nonzero(sim >= sim.max(axis=1, keepdims=True) - margin)
        rows, cells, sims = [], [], []
        order = np.argsort(top, kind="stable")
        row, top = row[order], top[order]
        for t in np.unique(top):
            r = row[slice(*np.searchsorted(top, [t, t + 1]))]
            if self.sub[t] is None:
                near = sim[r, t][:, None]
            else:
                near = x[r] @ self.sub[t].T
            i, j = np.nonzero(near >= near.max(axis=1, keepdims=True) - margin)
            rows.append(r[i])
            cells.append(self.first[t] + j)
            sims.append(near[i, j])
        row, cell, near = np.concatenate(rows), np.concatenate(cells), np.concatenate(sims)
        best = np.full(len(x), -np.inf)
        np.maximum.at(best, row, near)
        order = np.lexsort((cell, row))
        row, cell, near = row[order], cell[order], near[order]
        at_home = np.flatnonzero(near == best[row])
        home = np.zeros(len(x), np.int64)
        home[row[at_home][::-1]] = cell[at_home][::-1]  # of equally near ones the first
        ok = near >= best[row] - margin
        return home, row[ok], cell[ok]


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the vectors of a column of lists without nulls."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(size) - size
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        yield at, flat[begin[at][:, None] + np.arange(dim)]


def _divide(dims: dict[int, Cells], parts: int):
    """A sample of one top cell to the centroids of its second level."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        top = table["top"][0].as_py()
        ((_, x),) = _matrices(table["x"].chunk(0))
        order = np.argsort(table["vertex"].to_numpy())
        c = fit_cells(unit_rows(x[order]), parts)
        return pa.Table.from_arrays([pa.array([top]), pa.array([x.shape[1]]), pa.array([c.astype(np.float64).tobytes()], pa.binary())], names=["top", "dim", "c"])

    return run


def _homes(dims: dict[int, Cells]):
    """(vertex, top cell, x): used to draw the samples of the second level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = np.full(batch.num_rows, -1)
            for at, x in _matrices(batch.column("x")):
                if (c := dims.get(x.shape[1])) is not None:
                    top[at] = c.first[np.argmax(unit_rows(x) @ c.top.T, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column("vertex"), pa.array(top, pa.int32()), batch.column("x")], names=["vertex", "top", "x"])

    return run


def _visited(batch: pa.RecordBatch, dims: dict[int, Cells], margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home of each row; row and cell of each visit, by row and cell).  A length that the sample missed is one cell."""
    home, rows, cells = np.zeros(batch.num_rows, np.int64), [], []
    for at, x in _matrices(batch.column("x")):
        if (c := dims.get(x.shape[1])) is None:
            h, r, v = np.full(len(at), x.shape[1]), np.arange(len(at)), np.full(len(at), x.shape[1])
        else:
            h, r, v = c.visits(unit_rows(x), margin)
        home[at] = h
        rows.append(at[r])
        cells.append(v)
    row, cell = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (rows, cells))
    order = np.lexsort((cell, row))
    return home, row[order], cell[order]


def _count(dims: dict[int, Cells], margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, row, cell = _visited(batch, dims, margin)
            both, n = np.unique(cell * 2 + (cell != home[row]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both >> 1), pa.array(both & 1), pa.array(n)], names=["cell", "guest", "n"])

    return run


_TASKS = "cell int, one int, two int, vertex long, copies long, home int, cells binary, x binary, side int"


def _deal(dims: dict[int, Cells], margin: float, homes: dict[int, int], guests: dict[int, int]):
    """Vectors to the tasks in which they meet others: (cell, block, block) of homes, or (cell, block, -1 - block) of homes and guests.

    A cell of one block of homes and one of guests is one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, row, cell = _visited(batch, dims, margin)
            vertex = batch.column("vertex").to_numpy()
            spread = (vertex.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)[row]
            names, inv = np.unique(cell, return_inverse=True)
            nh = np.array([homes.get(int(c), 0) for c in names], np.int64)[inv]
            ng = np.array([guests.get(int(c), 0) for c in names], np.int64)[inv]
            own = cell == home[row]
            single = (nh == 1) & (ng <= 1)
            copies = np.where(single, 1, np.where(own, nh + ng, nh))
            who = np.repeat(np.arange(len(row)), copies)
            k = np.arange(len(who)) - np.repeat(np.cumsum(copies) - copies, copies)
            mine, h = spread[who] % np.maximum(np.where(own, nh, ng)[who], 1), nh[who]
            with_home, o, s = own[who] & (k < h), own[who], single[who]
            one = np.where(s, 0, np.where(o, np.where(with_home, np.minimum(mine, k), mine), k))
            two = np.where(s, 0, np.where(o, np.where(with_home, np.maximum(mine, k), h - k - 1), -1 - mine))
            side = np.where(o, np.where(with_home & ~s & (k < mine), 1, 0), 2)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.array([cell[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
            raw: list[bytes] = [b""] * batch.num_rows
            for at, x in _matrices(batch.column("x")):
                for i, r in zip(at.tolist(), x, strict=True):
                    raw[i] = r.tobytes()
            take = pa.array(row[who])
            put = lambda x: pa.array(x, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [put(cell[who]), put(one), put(two), batch.column("vertex").take(take), batch.column("copies").take(take), put(home[row[who]]), lists.take(take), pa.array(raw, pa.binary()).take(take), put(side)],
                names=["cell", "one", "two", "vertex", "copies", "home", "cells", "x", "side"],
            )

    return run


_FOUND = "kind int, a long, b long"


def _products(threshold: float, kind: type):
    """One task: (0, vector, copies of vectors linked with it) and (1, vector, vector) of a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, vertex, copies, home = (table[c].to_numpy() for c in ("side", "vertex", "copies", "home"))
        cell, whole = table["cell"][0].as_py(), table["one"][0].as_py() == table["two"][0].as_py()
        raw = table["x"].chunk(0)
        x = unit_rows(np.frombuffer(raw.buffers()[2], kind)[: raw.buffers()[2].size // np.dtype(kind).itemsize].reshape(len(vertex), -1)) if raw.offset == 0 else unit_rows(np.stack([np.frombuffer(v.as_buffer(), kind) for v in raw]))
        left, found_a, found_b = np.flatnonzero(side == 0), [], []
        for right in ([left] if whole else []) + [np.flatnonzero(side == 1), np.flatnonzero(side == 2)]:
            for lo in range(0, len(left) if len(right) else 0, 512):
                part = left[lo : lo + 512]
                i, j = np.nonzero(x[part] @ x[right].T >= threshold)
                a, b = part[i], right[j]
                if right is left:
                    a, b = a[a < b], b[a < b]
                found_a.append(a)
                found_b.append(b)
        a, b = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_a, found_b))
        guest = np.flatnonzero(side[b] == 2)
        if len(guest):
            # a pair that also meets at the guest's home counts in the lower of both cells
            lists = [np.frombuffer(v.as_buffer(), np.int32) for v in table["cells"]]
            visits = (np.repeat(np.arange(len(lists)), [len(v) for v in lists]) << 32) | np.concatenate(lists)
            away = np.isin((a[guest] << 32) | home[b[guest]], visits)
            keep = np.ones(len(a), bool)
            keep[guest] = ~away | (home[b[guest]] > cell)
            a, b = a[keep], b[keep]
        n = np.bincount(a, weights=copies[b], minlength=len(vertex)) + np.bincount(b, weights=copies[a], minlength=len(vertex))
        at = np.flatnonzero(n)
        u, v = forest(vertex[a], vertex[b])
        kinds = np.concatenate([np.zeros(len(at), np.int32), np.ones(len(u), np.int32)])
        return pa.Table.from_arrays([pa.array(kinds), pa.array(np.concatenate([vertex[at], u])), pa.array(np.concatenate([n[at].astype(np.int64), v]))], names=["kind", "a", "b"])

    return run


def fit_all(classes: DataFrame, total: int, dim: float) -> dict[int, Cells]:
    """Cells for each length of vectors in a bounded sample of `classes`."""
    rows = max(1.0, FIT_VALUES / max(1.0, dim))
    draw = F.pmod(F.xxhash64("vec", F.lit("cells")), F.lit(1 << 30)) / float(1 << 30)
    sample = classes.where(draw < rows / max(1, total)).limit(int(2 * rows)).select("vertex", "x").toArrow().combine_chunks()
    out: dict[int, Cells] = {}
    if not sample.num_rows:
        return out
    vertex, base = sample["vertex"].to_numpy(), 1 << 20
    for at, x in _matrices(sample["x"].chunk(0)):
        wanted = total * len(at) / len(vertex) / CELL_ROWS
        out[x.shape[1]] = c = Cells(base, fit_cells(unit_rows(x[np.argsort(vertex[at])]), int(np.clip(wanted, 1, MAX_TOP))))
        base = c.number()
    parts = int(np.clip(np.ceil(total / CELL_ROWS / MAX_TOP), 1, MAX_SUB))
    if parts > 1:
        rate = min(1.0, MAX_TOP * parts * SUB_ROWS / total)
        drawn = classes.where(F.pmod(F.xxhash64("vec", F.lit("parts")), F.lit(1 << 30)) / float(1 << 30) < rate)
        drawn = drawn.select("vertex", "x").mapInArrow(_homes(out), f"vertex long, top int, x {classes.schema['x'].dataType.simpleString()}").where("top >= 0")
        # at most MAX_TOP * MAX_SUB centroids of each length
        for r in drawn.groupBy("top").applyInArrow(_divide(out, parts), "top long, dim long, c binary").collect():
            c = out[r["dim"]]
            c.sub[int(np.searchsorted(c.first, r["top"]))] = np.frombuffer(r["c"]).reshape(-1, r["dim"])
        base = 1 << 20
        for c in out.values():
            c.base = base
            base = c.number()
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row; other columns are ignored, whatever their names.

    Vectors of floats stay floats until they are multiplied, all others are doubles.

    * null vectors, zero ones, and those with a null or non-finite component: no links, a component of their own.
    * vectors of different lengths aren't linked.
    * equal vectors are linked whatever their number; rows that repeat an id count as vectors of their own.
    * null ids: no links, component and kept null.  Empty table: empty result.
    """
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(vector_col).cast(ArrayType(FloatType() if single else DoubleType())).alias("x"))
    finite = lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))
    usable = F.col("vec").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite) & F.exists("x", lambda y: y != 0)
    v = v.withColumn("x", F.when(usable, F.col("x")))
    keys = [F.xxhash64("x").alias("k1"), F.xxhash64(F.lit("second"), "x").alias("k2")]
    merged = v.where("x IS NOT NULL").groupBy("x").agg(F.min("vec").alias("vec"), F.count("*").alias("copies"))
    classes = checkpoint(merged.select(F.monotonically_increasing_id().alias("vertex"), "vec", "copies", "x", *keys))
    total, dim = classes.agg(F.count("*"), F.coalesce(F.avg(F.size("x")), F.lit(1.0))).first()
    dims = fit_all(classes, total, dim)
    rows = classes.select("vertex", "copies", "x")
    # a few numbers for each cell, of which there are MAX_TOP * MAX_SUB at most for a length
    count = rows.mapInArrow(_count(dims, margin), "cell long, guest long, n long").groupBy("cell", "guest").agg(F.sum("n").alias("n")).collect()
    blocks = [{r["cell"]: -(-r["n"] // BLOCK_ROWS) for r in count if r["guest"] == g} for g in (0, 1)]
    tasks = rows.mapInArrow(_deal(dims, margin, *blocks), _TASKS)
    found = checkpoint(tasks.groupBy("cell", "one", "two").applyInArrow(_products(threshold, np.float32 if single else np.float64), _FOUND))
    counts = found.where("kind = 0").groupBy(F.col("a").alias("vertex")).agg(F.sum("b").alias("n"))
    groups = connected_components(found.where("kind = 1"))
    named = classes.select("vertex", "vec", "copies", "k1", "k2").join(counts, "vertex", "left").join(groups, "vertex", "left")
    named = named.where("copies > 1 OR n IS NOT NULL").select("k1", "k2", "vec", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "vertex").alias("component"))
    lowest = named.groupBy("component").agg(F.min("vec").alias("least"))
    named = named.join(lowest, "component").select("k1", "k2", "n_links", "least")
    # equal vectors find their class by a 128-bit hash, so that no vector moves again
    out = v.select("vec", *[F.when(F.col("x").isNotNull(), k).alias(n) for k, n in zip(keys, ("k1", "k2"), strict=True)]).join(named, ["k1", "k2"], "left")
    component = F.coalesce("least", "vec")
    return out.select(F.col("vec").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec").isNotNull(), component).alias("component_id"), (F.col("vec") == component).alias("kept"))
