"""Transaction logs as DataFrames of actions.

A log is a folder of commit files named by version, one JSON action a line.
Lines are parsed with only the fields that are used; a line that isn't JSON is
no action.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import TableError

ACTION = (
    "add struct<path:string,partitionValues:map<string,string>,size:bigint,stats:string,deletionVector:struct<storageType:string,pathOrInlineDv:string,offset:int>>,"
    "remove struct<path:string,deletionVector:struct<storageType:string,pathOrInlineDv:string,offset:int>>,"
    "metaData struct<schemaString:string,partitionColumns:array<string>>"
)
COMMIT_FILE = r"^\d{20}\.json$"
#: A checkpoint in one file or in numbered parts.
CHECKPOINT_FILE = r"^(\d{20})\.checkpoint(?:\.(\d{10})\.(\d{10}))?\.parquet$"


def parse_lines(lines: DataFrame) -> DataFrame:
    """(commit_version, line_no, add, remove, metaData) from (commit_version, line_no, line)."""
    parsed = lines.select("commit_version", "line_no", F.from_json("line", ACTION).alias("action"))
    return parsed.select("commit_version", "line_no", "action.*").where("add IS NOT NULL OR remove IS NOT NULL OR metaData IS NOT NULL")


def read_log(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """Actions of all commits up to `version`, read in parallel by block of a file.

    `line_no` grows along a commit, but has gaps: it is made of the start of
    the line's block and the line's place among the rows of its task, which
    reads a block from front to back.
    """
    files = spark.read.text(f"{table.rstrip('/')}/_delta_log", lineSep="\n", pathGlobFilter="*.json")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    place = F.monotonically_increasing_id().bitwiseAND(2**33 - 1)
    line_no = (F.col("_metadata.file_block_start").cast("decimal(19,0)") * F.lit(2**33) + place).cast("decimal(38,0)")
    commits = files.select(F.when(name.rlike(COMMIT_FILE), F.substring(name, 1, 20).cast("long")).alias("commit_version"), line_no.alias("line_no"), F.col("value").alias("line")).where("commit_version IS NOT NULL")
    if version is not None:
        commits = commits.where(F.col("commit_version") <= version)
    return parse_lines(commits)


def read_checkpoint(spark: SparkSession, paths: str | list[str], version: int) -> DataFrame:
    """Actions of a checkpoint in Parquet, as of `version`; they come before any line of later commits."""
    raw = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    if "sidecar" in raw.columns and raw.where("sidecar IS NOT NULL").limit(1).count():
        raise TableError(f"The checkpoint of version {version} keeps its files in sidecars, which can't be read")
    parts = [F.from_json(F.to_json(n), ACTION.split(f"{n} ", 1)[1].split(",remove ")[0].split(",metaData ")[0]).alias(n) if n in raw.columns else F.lit(None).alias(n) for n in ("add", "remove", "metaData")]
    return raw.select(F.lit(version).cast("long").alias("commit_version"), F.lit(-1).alias("line_no"), *parts)


def _log_names(spark: SparkSession, log: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []


def find_checkpoint(names: list[str], version: int | None = None) -> tuple[int, list[str]] | None:
    """(version, file names) of the newest checkpoint at or below `version` of which no part is missing."""
    found: dict[tuple[int, int], list[str]] = {}
    for n in sorted(names):
        if (m := re.match(CHECKPOINT_FILE, n)) and (version is None or int(m[1]) <= version):
            found.setdefault((int(m[1]), int(m[3] or 1)), []).append(n)
    whole = [(v, files) for (v, parts), files in found.items() if len(files) >= parts]
    # a file of its own and a single numbered part hold the same actions: one is enough
    return max(((v, files[:1] if len(files) > 1 and re.match(r"^\d{20}\.checkpoint\.parquet$", files[-1]) else files) for v, files in whole), default=None)


def read_table_log(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """Actions up to `version`: of the newest checkpoint and all commits after it, none of which may be missing."""
    log = f"{table.rstrip('/')}/_delta_log"
    names = _log_names(spark, log)
    point = find_checkpoint(names, version)
    first = point[0] + 1 if point else 0
    commits = {int(n[:20]) for n in names if re.match(COMMIT_FILE, n)}
    later = {v for v in commits if v >= first and (version is None or v <= version)}
    if gone := set(range(first, max(later, default=first - 1) + 1)) - later:
        raise TableError(f"The log of '{table}' lacks the commit of version {min(gone)} and a checkpoint that holds it")
    actions = read_log(spark, table, version)
    if point is None:
        return actions
    old = read_checkpoint(spark, [f"{log}/{n}" for n in point[1]], point[0])
    return old.where("add IS NOT NULL OR remove IS NOT NULL OR metaData IS NOT NULL").unionByName(actions.where(F.col("commit_version") > point[0]))
