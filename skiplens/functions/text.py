"""Display forms: as Columns for DataFrames, as Python for reports."""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def size_text(size: Column) -> Column:
    """Bytes up to 1023 B, then one decimal of KB, MB or GB, ties to even as in format_size()."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(UNITS[1:], 1):
        out = F.when(size >= 1024**k, F.format_string(f"%.1f {unit}", F.bround(size / float(1024**k), 1))).otherwise(out)
    return out


def percent_text(x: Column) -> Column:
    """Whole percents, ties to even."""
    return F.concat(F.bround(x, 0).cast("long").cast("string"), F.lit("%"))


def partition_text(values: Column) -> Column:
    """`partition(k=v, ...)` by key, empty without partitions."""
    parts = F.array_sort(F.transform(F.map_entries(values), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))))
    return F.when(F.size(parts) > 0, F.concat(F.lit("partition("), F.array_join(parts, ", "), F.lit(")"))).otherwise("")


def format_size(n: int) -> str:
    k = max(i for i in range(4) if n >= 1024**i or i == 0)
    return f"{n} B" if k == 0 else f"{n / 1024**k:.1f} {UNITS[k]}"


def stat_text(raw: str | None) -> str | None:
    """A bound as people write it: numbers without exponent or `.0`, anything else as it stands."""
    if raw is None:
        return None
    try:
        value = json.loads(raw)
    except ValueError:
        return raw
    if isinstance(value, bool) or not isinstance(value, int | float):
        return raw
    if isinstance(value, int):
        return str(value)
    return format(Decimal(repr(value)).normalize(), "f") if value == value and abs(value) != float("inf") else raw


def stats_text(stats: dict | None) -> str:
    """`stats(col: min..max, ...)` by column name."""
    bounds = column_bounds(stats)
    shown = []
    for name, b in sorted(bounds.items()):
        low, high = b.get("min"), b.get("max")
        if low is not None and high is not None:
            shown.append(f"{name}: {low}..{high}")
        elif low is not None:
            shown.append(f"{name}: {low}..")
        elif high is not None:
            shown.append(f"{name}: ..{high}")
    return f"  stats({', '.join(shown)})" if shown else "  [no stats]"


def column_bounds(stats: dict | None) -> dict[str, dict]:
    """min, max and null_count by column; nested columns by dotted path."""
    out: dict[str, dict] = {}
    for side, name in (("minValues", "min"), ("maxValues", "max"), ("nullCount", "null_count")):
        for column, raw in ((stats or {}).get(side) or {}).items():
            for path, value in _leaves(column, raw):
                if value is not None:
                    out.setdefault(path, {})[name] = value if name != "null_count" else int(value) if value.lstrip("-").isdigit() else None
    return {k: {n: x for n, x in v.items() if x is not None} for k, v in out.items()}


def _leaves(path: str, raw: str | None):
    if raw is not None and raw.startswith("{"):
        try:
            inner = json.loads(raw)
        except ValueError:
            inner = None
        if isinstance(inner, dict):
            for k, v in inner.items():
                yield from _leaves(f"{path}.{k}", v if isinstance(v, str) else json.dumps(v) if v is not None else None)
            return
    yield path, stat_text(raw)
