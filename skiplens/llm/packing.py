"""Rows that carry many values each as packed arrays.

A shuffle of single (hash, id) rows costs far more than the values in it; here
one row holds what a task sends to one block, as up to five numpy arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "key long, kind int, a binary, b binary, c binary, d binary, e binary"
_SCHEMA = pa.schema([("key", pa.int64()), ("kind", pa.int32()), *((x, pa.binary()) for x in "abcde")])


def packed(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (key, kind, array or None five times)."""
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32())]
    return pa.RecordBatch.from_arrays([*arrays, *(pa.array([None if x is None else x.tobytes() for x in c], pa.binary()) for c in cols[2:])], schema=_SCHEMA)


def values(x: pa.Scalar, dtype) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), dtype)


def joined(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.concatenate([values(x, dtype) for x in table[name]]) if table.num_rows else np.zeros(0, dtype)


def heads(*keys: np.ndarray) -> np.ndarray:
    """Positions at which sorted rows begin a new combination of keys."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def runs(head: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(begin, end) of the runs that begin at `head` in n rows."""
    return list(zip(head.tolist(), [*head[1:].tolist(), n], strict=True)) if len(head) else []


def text_totals(df: DataFrame, column: str) -> tuple[int, int]:
    """(rows, UTF-8 bytes of a column of texts)."""
    n, size = df.agg(F.count("*"), F.sum(F.octet_length(column))).first()
    return n, size or 0


def block_bits(size: int, block_bytes: int, low: int, high: int) -> int:
    """Bits of the number of blocks of about `block_bytes`."""
    return int(np.clip(np.ceil(np.log2(max(1, size / block_bytes))), low, high))
