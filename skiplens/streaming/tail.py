"""A stream of log actions, for tables that are written while they are watched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.log import COMMIT_FILE, parse_lines


def stream_log(spark: SparkSession, table: str, max_files: int = 1000) -> DataFrame:
    """Actions of new commits as they appear; same columns as read_log()."""
    raw = spark.readStream.schema("value string").option("wholetext", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", max_files).format("text").load(f"{table.rstrip('/')}/_delta_log")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    lines = raw.select(F.when(name.rlike(COMMIT_FILE), F.substring(name, 1, 20).cast("long")).alias("commit_version"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return parse_lines(lines.where("commit_version IS NOT NULL"))
