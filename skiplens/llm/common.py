"""Shared helpers: text slices, byte-level word scanning, checkpoints.

Texts cross into Python as Arrow buffers, so the numpy code below sees the
UTF-8 bytes of many documents at once and never builds Python strings.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at.  A longer text is a step of its own.
SLICE_BYTES = 1 << 20
#: Documents in one vectorised step at most (twelve bits of a sort key hold the index).
SLICE_DOCS = 4096

#: The ASCII white space of the contracts: blank and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder the cluster names; makes one only on a local master, where all tasks share this machine's disk."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="skiplens-checkpoint-")
    sc.setCheckpointDir(folder)


#: Lets Spark delete the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes `df` to the shared checkpoint folder, cuts its lineage and deletes the shuffles that led to it."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


#: Rows up to which a checked table of totals is broadcast; beyond, the join shuffles and AQE splits hot keys.
FEW_ROWS = 20_000


def few(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint if it has at most FEW_ROWS rows, else as it is."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


def id_bucket(col, modulus: int):
    """crc32 of the id as text, modulo `modulus`: the folds of the contracts."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(modulus)


def held_out(col, modulus: int, remainder: int):
    """Boolean fold flag; a null id is never held out and never learned from."""
    return F.coalesce(id_bucket(col, modulus) == F.lit(remainder), F.lit(False))


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on, idle or in the next stage, beside the executor's heap."""
    _POW.pop("long", None)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library: nothing to do


def lean(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """`f`, giving memory back before and after each group."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        out = f(table)
        give_back()
        return out

    return run


class TextSlice:
    """Some consecutive rows of a batch: `data` holds their bytes, row i is data[starts[i]:starts[i+1]]."""

    __slots__ = ("batch", "data", "lo", "starts")

    def __init__(self, batch: pa.RecordBatch, lo: int, data: np.ndarray, starts: np.ndarray):
        self.batch, self.lo, self.data, self.starts = batch, lo, data, starts

    def __len__(self) -> int:
        return len(self.starts) - 1

    def column(self, name: str) -> pa.Array:
        return self.batch.column(name).slice(self.lo, len(self))

    def doc_of_byte(self) -> np.ndarray:
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.starts))


def raw_strings(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets) of a string array; nulls are empty."""
    if arr.null_count:
        arr = arr.fill_null("" if not pa.types.is_binary(arr.type) and not pa.types.is_large_binary(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, buf = arr.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data, offsets


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", transform=None, max_bytes: int = SLICE_BYTES) -> Iterator[TextSlice]:
    """Cuts Arrow batches into slices of bounded bytes and rows; `transform` maps the Arrow column first."""
    for batch in batches:
        if not batch.num_rows:
            continue
        arr = batch.column(column)
        if transform is not None:
            arr = transform(arr)
        data, off = raw_strings(arr)
        lo = 0
        while lo < len(off) - 1:
            hi = int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1
            hi = min(max(hi, lo + 1), lo + SLICE_DOCS, len(off) - 1)
            yield TextSlice(batch, lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            _POW.pop("long", None)
            lo = hi
        del batch, arr, data, off
        give_back()


_POW: dict[str, tuple[np.ndarray, np.ndarray]] = {}
#: Powers that a worker keeps for good at most, 16 bytes each.
KEPT_POWERS = 4 * SLICE_BYTES
_BASE = 0x9E3779B97F4A7C15 | 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n; a worker keeps those for more than KEPT_POWERS until the slice or group is done."""
    for kept in _POW.values():
        if len(kept[0]) >= n:
            return kept[0][:n], kept[1][:n]
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        a = np.full(max(n, SLICE_BYTES + 1), base, _U)
        a[0] = 1
        out.append(np.cumprod(a, dtype=_U, out=a))
    _POW["all" if n <= KEPT_POWERS else "long"] = tuple(out)
    return out[0][:n], out[1][:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; works on a copy."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


#: A random 64-bit value for each byte.
BYTE64 = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of BYTE64[b] * base^i, one longer than data."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(BYTE64[data] * p[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end], independent of where it stands."""
    _, q = powers(len(prefix))
    return (prefix[end] - prefix[start]) * q[start]


def word_bounds(data: np.ndarray, starts: np.ndarray, is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each maximal run of bytes that aren't gaps, never across documents."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    gap = is_gap[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[:-1]
    first = np.flatnonzero(~gap & (before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = gap[1:]
    last = np.flatnonzero(~gap & (after | edge[1:])) + 1
    return first, last, np.searchsorted(starts, first, side="right") - 1


def sum_by_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))
