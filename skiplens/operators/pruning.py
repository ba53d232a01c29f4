"""Pruning by phases: flags for every file, and all counts in one aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..predicate import Analysis, analyze, parse
from .filestats import has_stats
from .lowering import FileColumns, check, keep, keep_partition

PARTITION_PHASE = "Partition pruning"
SKIPPING_PHASE = "Data skipping (min/max statistics)"


@dataclass
class Phase:
    name: str
    predicate: str
    flag: str  # column of `files`


@dataclass
class Pruning:
    """`files` has a flag for each phase; a file that a phase drops stays dropped."""

    files: DataFrame
    phases: list[Phase]
    analysis: Analysis | None

    def counts(self) -> DataFrame:
        """One row: total_files, files_with_stats, and the files kept by each phase."""
        kept = [F.count_if(p.flag).alias(p.flag) for p in self.phases]
        return self.files.agg(F.count("*").alias("total_files"), F.count_if("has_stats").alias("files_with_stats"), *kept)

    def phase_table(self) -> DataFrame:
        """A row for each phase: phase, name, input_files, output_files, pruned_files, pruning_pct."""
        c = self.counts()
        before, rows = F.col("total_files"), []
        for k, p in enumerate(self.phases):
            after = F.col(p.flag)
            rows.append(F.struct(F.lit(k + 1).alias("phase"), F.lit(p.name).alias("name"), before.alias("input_files"), after.alias("output_files"), F.greatest(before - after, F.lit(0)).alias("pruned_files"), pruning_pct(before, after).alias("pruning_pct")))
            before = after
        return c.select(F.explode(F.array(*rows)).alias("p")).select("p.*") if rows else c.sparkSession.createDataFrame([], "phase int, name string, input_files long, output_files long, pruned_files long, pruning_pct double")


def pruning_pct(before: Column, after: Column) -> Column:
    share = F.greatest(before - after, F.lit(0)).cast("double") / F.nullif(before, F.lit(0)).cast("double") * 100
    return F.coalesce(share, F.lit(0.0))


def prune(files: DataFrame, predicate: str | None, schema: StructType, partition_columns: list[str], mixed_or: str = "separate") -> Pruning:
    """Flags the files of live_files() by phase; the plan adds a projection and no shuffle."""
    files = files.withColumn("has_stats", has_stats(F.col("stats")))
    if predicate is None:
        return Pruning(files, [], None)
    tree = parse(predicate)
    analysis = analyze(tree, partition_columns)
    check(tree, schema)
    f = FileColumns(schema, frozenset(partition_columns))
    phases, before = [], F.lit(True)
    if analysis.partition:
        files = files.withColumn("kept_1", keep_partition(analysis.partition, f))
        phases.append(Phase(PARTITION_PHASE, analysis.partition_safe, "kept_1"))
        before = F.col("kept_1")
    if analysis.stats or analysis.mixed:
        files = files.withColumn("kept_2", before & keep(tree, f, mixed_or))
        shown = " AND ".join(x for x in (analysis.stats_safe, analysis.unsplittable) if x)
        phases.append(Phase(SKIPPING_PHASE, shown, "kept_2"))
    return Pruning(files, phases, analysis)
