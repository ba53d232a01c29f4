"""Writes tables with a log: data files with their statistics, commits, removes and checkpoints."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filestats import add_lines, compute_stats


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A file with exactly this text, on whatever file system the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_commit(spark: SparkSession, table: str, version: int, lines: list[str]) -> None:
    write_text(spark, f"{table}/_delta_log/{version:020d}.json", "".join(f"{x}\n" for x in lines))


def metadata_line(schema_json: str, partition_columns: list[str]) -> str:
    return json.dumps({"metaData": {"id": "table", "format": {"provider": "parquet", "options": {}}, "schemaString": schema_json, "partitionColumns": partition_columns, "configuration": {}}})


def remove_lines(paths: list[str]) -> list[str]:
    return [json.dumps({"remove": {"path": p, "dataChange": True}}) for p in paths]


def write_log(spark: SparkSession, table: str, lines: DataFrame) -> None:
    """Commits of (commit_version, line_no, line) rows, one file for each version."""
    commits: dict[int, list[str]] = {}
    for r in lines.orderBy("commit_version", "line_no").toLocalIterator():
        commits.setdefault(r["commit_version"], []).append(r["line"])
    for version, text in commits.items():
        write_commit(spark, table, version, text)


def write_table(df: DataFrame, table: str, partition_columns: list[str], files: int = 1) -> DataFrame:
    """A table of version 0 with about `files` files for each partition; returns its add actions as log lines."""
    spark = df.sparkSession
    keys = [F.col(c) for c in partition_columns]
    spread = df.repartition(*keys, F.pmod(F.xxhash64(*df.columns), F.lit(files))) if keys else df.repartition(files)
    spread.write.mode("append").partitionBy(*partition_columns).parquet(table)
    back = spark.read.schema(df.schema).option("basePath", table).parquet(table)
    columns = [c for c in df.columns if c not in partition_columns]
    stats = compute_stats(back.withColumn("__file", F.col("_metadata.file_path")).withColumn("__size", F.col("_metadata.file_size")), ["__file", "__size", *partition_columns], columns)
    # paths in a log are relative to the table
    path = F.concat_ws("/", F.slice(F.split("__file", "/"), -1 - len(partition_columns), 1 + len(partition_columns)))
    lines = add_lines(stats, columns, path, F.lit(0), {c: F.col(c).cast("string") for c in partition_columns}, size=F.col("__size"))
    write_commit(spark, table, 0, [metadata_line(df.schema.json(), partition_columns), *(r["line"] for r in lines.orderBy("line").toLocalIterator())])
    return lines
