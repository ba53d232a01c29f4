"""Log replay: the newest action of each file wins."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .filestats import parse_stats


def live_files(actions: DataFrame, version: int | None = None) -> DataFrame:
    """Files that are part of the table: ``path, size, partition_values, stats, commit_version, line_no``.

    One aggregation by (path, deletion vector) finds the newest action; it
    combines before the shuffle, so a file that is rewritten in every commit
    sends one row a task.
    """
    if version is not None:
        actions = actions.where(F.col("commit_version") <= version)
    either = F.coalesce(F.col("add.path"), F.col("remove.path"))
    vector = F.coalesce(F.col("add.deletionVector"), F.col("remove.deletionVector"))
    touched = actions.where("add IS NOT NULL OR remove IS NOT NULL").select(either.alias("path"), vector.alias("vector"), "commit_version", "line_no", "add")
    newest = touched.groupBy("path", "vector").agg(F.max_by(F.struct("add", "commit_version", "line_no"), F.struct("commit_version", "line_no")).alias("a"))
    add = "a.add"
    return newest.where(f"{add} IS NOT NULL").select(
        "path", F.col(f"{add}.size").alias("size"), F.col(f"{add}.partitionValues").alias("partition_values"),
        parse_stats(F.col(f"{add}.stats")).alias("stats"), "a.commit_version", "a.line_no",
    )


def table_version(actions: DataFrame) -> DataFrame:
    return actions.agg(F.max("commit_version").alias("version"))


def table_metadata(actions: DataFrame) -> DataFrame:
    """The last metadata of the log in one row: ``schema_string, partition_columns``."""
    last = F.max_by(F.col("metaData"), F.struct("commit_version", "line_no"))
    return actions.where("metaData IS NOT NULL").agg(last.alias("m")).select(F.col("m.schemaString").alias("schema_string"), F.coalesce("m.partitionColumns", F.array().cast("array<string>")).alias("partition_columns"))


def schema_of(schema_string: str) -> StructType:
    return StructType.fromJson(json.loads(schema_string))
