"""Predicates as three-valued Columns over one file's partition values and statistics.

A Column here is FALSE only if no row of the file can match; NULL means
unknown.  NOT is pushed to the leaves first: a rewritten leaf must never be
negated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, FloatType, LongType, StringType, StructType, TimestampNTZType, TimestampType

from ..predicate.tree import SWAPPED, And, Col, Compare, IsNull, Lit, Or, PredicateError, Truth, columns, normal_form

_OPS = {"=": Column.__eq__, "<>": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


#: Fixed by the log format: where a field's metadata names its column in files and statistics.
PHYSICAL_NAME = "delta.columnMapping.physicalName"


def unknown() -> Column:
    return F.lit(None).cast("boolean")


def column_type(schema: StructType, col: Col) -> DataType:
    """Type of a column by exact, case-sensitive name; nested fields by path."""
    kind: DataType = schema
    for part in col.parts:
        if not isinstance(kind, StructType) or part not in kind.names:
            raise PredicateError(f"Column not found: {col.name}")
        kind = kind[part].dataType
    return kind


def number(text: str, kind: DataType | None) -> int | float:
    """A number as the column's type wants it: strictly for long and floating ones, else the narrowest that fits."""
    try:
        if isinstance(kind, LongType):
            return int(text)
        if isinstance(kind, DoubleType | FloatType):
            return float(text)
        return float(text) if any(c in text for c in ".eE") else int(text)
    except ValueError:
        raise PredicateError(f"Invalid {kind.simpleString() if kind else 'number'} '{text}'") from None


def literal(lit: Lit, kind: DataType | None) -> Column | None:
    """A literal to compare with a column of type `kind`; None if nothing is known about such a comparison."""
    if lit.kind == "null":
        return None
    if lit.kind == "number":
        value = number(str(lit.value), kind)
        return None if isinstance(kind, StringType | BooleanType) else F.lit(value)
    if lit.kind == "bool":
        return F.lit(lit.value) if kind is None or isinstance(kind, BooleanType) else None
    return F.lit(lit.value) if kind is None or isinstance(kind, StringType) else F.lit(lit.value).try_cast(kind)


@dataclass
class FileColumns:
    """Access to a file's values; `parts` are the partition columns."""

    schema: StructType
    parts: frozenset[str]
    values: str = "partition_values"
    stats: str = "stats"

    def is_partition(self, col: Col) -> bool:
        return col.name in self.parts

    def physical(self, col: Col) -> list[str]:
        """The names under which the log keeps a column: its own, or those that the schema maps it to."""
        kind, out = self.schema, []
        for part in col.parts:
            known = isinstance(kind, StructType) and part in kind.names
            out.append((kind[part].metadata or {}).get(PHYSICAL_NAME, part) if known else part)
            kind = kind[part].dataType if known else None
        return out

    def partition(self, col: Col) -> Column:
        """The text of a partition value; the empty one is NULL."""
        return F.nullif(F.col(self.values)[self.physical(col)[0]], F.lit(""))

    def has_partition(self, col: Col) -> Column:
        """Whether the log says anything about a partition value, NULL included."""
        return F.coalesce(F.map_contains_key(self.values, self.physical(col)[0]), F.lit(False))

    def stat(self, side: str, col: Col) -> Column:
        first, *rest = self.physical(col)
        out = F.col(f"{self.stats}.{side}")[first]
        return F.get_json_object(out, "$" + "".join(f"['{p}']" for p in rest)) if rest else out

    def low(self, col: Col, kind: DataType) -> Column:
        return self.stat("minValues", col).try_cast(kind)

    def high(self, col: Col, kind: DataType) -> Column:
        top = self.stat("maxValues", col).try_cast(kind)
        # other writers cut timestamps to milliseconds
        return top + F.expr("INTERVAL '0.001' SECOND") if isinstance(kind, TimestampType | TimestampNTZType) else top


def _constant(e: Compare) -> Column:
    if "null" in (e.left.kind, e.right.kind):
        return unknown()
    if e.left.kind != e.right.kind:
        return unknown()
    a, b = ((number(str(x.value), None) if x.kind == "number" else x.value) for x in (e.left, e.right))
    return _OPS[e.op](F.lit(a), F.lit(b))


def partition_leaf(e, f: FileColumns) -> Column:
    """Ordinary SQL on typed values: a NULL value matches no comparison; one that can't be cast, or that the log lacks, is unknown."""
    known = F.lit(True)
    for c in columns(e):
        known = known & f.has_partition(c)
    return F.when(known, _known_leaf(e, f))


def _known_leaf(e, f: FileColumns) -> Column:
    if isinstance(e, IsNull):
        raw = f.partition(e.operand)
        return raw.isNotNull() if e.negated else raw.isNull()
    if isinstance(e, Truth):
        raw = f.partition(e.operand)
        return F.when(raw.isNull(), F.lit(False)).otherwise(raw.try_cast("boolean") == F.lit(not e.negated))
    op, a, b = e.op, e.left, e.right
    if isinstance(a, Lit):
        op, a, b = SWAPPED[op], b, a
    kind = column_type(f.schema, a)
    raw = f.partition(a)
    if isinstance(b, Col):
        other = f.partition(b)
        return F.when(raw.isNull() | other.isNull(), F.lit(False)).otherwise(_OPS[op](raw.try_cast(kind), other.try_cast(column_type(f.schema, b))))
    if b.kind == "null":
        return F.lit(False)
    value = literal(b, kind)
    return F.when(raw.isNull(), F.lit(False)).otherwise(unknown() if value is None else _OPS[op](raw.try_cast(kind), value))


def stats_leaf(e, f: FileColumns) -> Column:
    """Whether a value between the file's bounds can satisfy the leaf."""
    if isinstance(e, IsNull):
        if isinstance(e.operand, Lit):
            return F.lit((e.operand.kind == "null") != e.negated)
        nulls = f.stat("nullCount", e.operand).try_cast("bigint")
        return nulls != F.col(f"{f.stats}.numRecords") if e.negated else nulls != F.lit(0)
    if isinstance(e, Truth):
        e = Compare("=", e.operand, Lit("bool", not e.negated))
    op, a, b = e.op, e.left, e.right
    if isinstance(a, Lit) and isinstance(b, Lit):
        return _constant(e)
    if isinstance(a, Lit):
        op, a, b = SWAPPED[op], b, a
    kind = column_type(f.schema, a)
    if isinstance(b, Col):
        return unknown()
    v = literal(b, kind)
    if v is None:
        return unknown()
    low, high = f.low(a, kind), f.high(a, kind)
    match op:
        case "=":
            return ~(high < v) & ~(low > v)
        case "<>":
            return (low != v) | (high != v)
        case "<":
            return low < v
        case "<=":
            return ~(low > v)
        case ">":
            return high > v
    return ~(high < v)


def lower(e, f: FileColumns, partitions: bool, stats: bool) -> Column:
    """Column of a tree in normal form; leaves of a kind that isn't asked for are unknown."""
    if isinstance(e, And):
        return lower(e.left, f, partitions, stats) & lower(e.right, f, partitions, stats)
    if isinstance(e, Or):
        return lower(e.left, f, partitions, stats) | lower(e.right, f, partitions, stats)
    kinds = {f.is_partition(c) for c in columns(e)}
    if kinds == {True}:
        return partition_leaf(e, f) if partitions else unknown()
    if True in kinds:
        return unknown()
    return stats_leaf(e, f) if stats else unknown()


def check(predicate, schema: StructType) -> None:
    """PredicateError for columns that don't exist, booleans that aren't, and literals that don't fit."""
    e = normal_form(predicate)
    stack = [e]
    while stack:
        x = stack.pop()
        if isinstance(x, And | Or):
            stack += [x.left, x.right]
            continue
        for c in columns(x):
            kind = column_type(schema, c)
            if isinstance(x, Truth) and not isinstance(kind, BooleanType):
                raise PredicateError(f"Column {c.name} is no boolean")
        if isinstance(x, Compare):
            for a, b in ((x.left, x.right), (x.right, x.left)):
                if isinstance(a, Col) and isinstance(b, Lit) and b.kind == "number":
                    number(str(b.value), column_type(schema, a))


def keep(predicate, f: FileColumns, mixed_or: str = "separate") -> Column:
    """Whether a file must be read.

    separate: partition leaves and statistics each decide with the others
    unknown; joint: both decide together, which also prunes through an OR of
    the two kinds.
    """
    e = normal_form(predicate)
    if mixed_or == "joint":
        return F.coalesce(lower(e, f, True, True), F.lit(True))
    if mixed_or != "separate":
        raise ValueError(f"mixed_or: {mixed_or}")
    return F.coalesce(lower(e, f, True, False), F.lit(True)) & F.coalesce(lower(e, f, False, True), F.lit(True))


def keep_partition(clauses: list, f: FileColumns) -> Column:
    out = F.lit(True)
    for c in clauses:
        out = out & F.coalesce(lower(normal_form(c), f, True, False), F.lit(True))
    return out
