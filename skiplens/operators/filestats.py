"""Per-file statistics: parsing them from logs, and computing them for any DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

STATS = "numRecords bigint, minValues map<string,string>, maxValues map<string,string>, nullCount map<string,string>"


def parse_stats(text: Column) -> Column:
    """Struct of STATS from the JSON text of an action; malformed or missing text is NULL."""
    s = F.from_json(text, STATS)
    useful = s["numRecords"].isNotNull() | s["minValues"].isNotNull() | s["maxValues"].isNotNull()
    return F.when(useful, s)


def has_stats(stats: Column) -> Column:
    """Whether a file has a record count or the bounds of any column."""
    some = lambda m: F.coalesce(F.size(F.map_keys(stats[m])), F.lit(0)) > 0
    return F.coalesce(stats["numRecords"].isNotNull() | some("minValues") | some("maxValues"), F.lit(False))


def compute_stats(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each file (its `keys`) with ``num_records`` and, for each column c, ``min_c, max_c, nulls_c``."""
    aggs = [F.count("*").alias("num_records")]
    for c in columns:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.count_if(F.col(c).isNull()).alias(f"nulls_{c}")]
    return df.groupBy(*keys).agg(*aggs)


def stats_json(stats: DataFrame, columns: list[str]) -> Column:
    """The JSON text that describes a row of compute_stats().

    Timestamps go in as text: to_json cuts them to milliseconds, and a bound
    that is cut is none.
    """
    stamps = {f.name for f in stats.schema.fields if isinstance(f.dataType, TimestampType | TimestampNTZType)}
    side = lambda p: F.struct(*[(F.col(f"{p}_{c}").cast("string") if f"{p}_{c}" in stamps else F.col(f"{p}_{c}")).alias(c) for c in columns])
    return F.to_json(F.struct(F.col("num_records").alias("numRecords"), side("min").alias("minValues"), side("max").alias("maxValues"), side("nulls").alias("nullCount")))


def add_lines(stats: DataFrame, columns: list[str], path: Column, version: Column, partition: dict[str, Column], with_stats: Column | None = None, size: Column | None = None) -> DataFrame:
    """(commit_version, line_no, line): an add action as JSON for each row of compute_stats()."""
    text = stats_json(stats, columns)
    if with_stats is not None:
        text = F.when(with_stats, text)
    values = F.create_map(*[x for k, v in partition.items() for x in (F.lit(k), v)]) if partition else F.from_json(F.lit("{}"), "map<string,string>")
    action = F.struct(path.alias("path"), values.alias("partitionValues"), (F.col("num_records") * 100 if size is None else size).alias("size"), text.alias("stats"))
    return stats.select(version.cast("long").alias("commit_version"), F.lit(0).alias("line_no"), F.to_json(F.struct(action.alias("add"))).alias("line"))
