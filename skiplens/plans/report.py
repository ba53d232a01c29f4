"""The report on one table, from its log to text, JSON and assertions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import column_bounds, format_size, stats_text
from ..operators.pruning import Pruning, prune
from ..operators.replay import live_files, schema_of, table_metadata, table_version
from ..sources.log import read_table_log
from ..sources.storage import TableError


def _pct(before: int, after: int) -> float:
    return max(before - after, 0) / before * 100 if before else 0.0


@dataclass
class Report:
    """Counts of one run; the rows of files are collected only where they are shown."""

    table: str
    version: int
    predicate: str | None
    pruning: Pruning
    stats_mode: str = "strict"
    total_files: int = 0
    files_with_stats: int = 0
    kept: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        row = self.pruning.counts().first().asDict()
        self.total_files = row["total_files"]
        self.files_with_stats = self.total_files if self.stats_mode == "log_entry" else row["files_with_stats"]
        self.kept = [row[p.flag] for p in self.pruning.phases]

    @property
    def total_pruning_pct(self) -> float:
        return _pct(self.total_files, self.kept[-1]) if self.kept else 0.0

    def ordered_files(self) -> DataFrame:
        """Newest commit first, in the order of its lines."""
        return self.pruning.files.orderBy(F.desc("commit_version"), "line_no")

    def candidates(self, k: int) -> Iterator[Row]:
        """Files that come into phase `k`; the driver holds one partition of them at a time."""
        files = self.ordered_files()
        return (files.where(self.pruning.phases[k - 1].flag) if k else files).toLocalIterator()

    def inputs(self) -> list[int]:
        return [self.total_files, *self.kept[:-1]][: len(self.kept)]

    def text(self, verbose: bool = False) -> str:
        out = [f"Delta table: {self.table}", f"Version:     {self.version}"]
        if self.predicate is not None:
            out.append(f"Predicate:   {self.predicate}")
        out += ["", f"Files in snapshot: {self.total_files:,}"]
        for k, (phase, before, after) in enumerate(zip(self.pruning.phases, self.inputs(), self.kept, strict=True)):
            dropped = max(before - after, 0)
            out += ["", f"Phase {k + 1}: {phase.name}", f"  predicate:       {phase.predicate}"]
            out.append(f"  files remaining: {after:,}  (-{dropped:,}, {_pct(before, after):.0f}% pruned)")
            if verbose:
                out += ["", *(self._line(r, phase.flag) for r in self.candidates(k))]
        if len(self.kept) > 1:
            out += ["", f"Total reduction: {self.total_files:,} -> {self.kept[-1]:,} files ({self.total_pruning_pct:.0f}% pruned)"]
        return "\n".join(out)

    @staticmethod
    def _line(r, flag: str) -> str:
        tag = "KEPT   " if r[flag] else "DROPPED"
        stats = r["stats"].asDict() if r["stats"] else None
        records = f"  {stats['numRecords']} records" if stats and stats["numRecords"] is not None else ""
        parts = ", ".join(sorted(f"{k}={'null' if v is None else v}" for k, v in (r["partition_values"] or {}).items()))
        return f"  [{tag}] {r['path'].rsplit('/', 1)[-1]}  ({format_size(r['size'] or 0)}{records})" + (f"  partition({parts})" if parts else "") + stats_text(stats)

    def document(self) -> dict:
        phases = []
        for k, (phase, before, after) in enumerate(zip(self.pruning.phases, self.inputs(), self.kept, strict=True)):
            files = [self._file(r, phase.flag) for r in self.candidates(k)]
            phases.append({"name": phase.name, "predicate": phase.predicate, "input_files": before, "output_files": after, "pruned_files": max(before - after, 0), "pruning_pct": _pct(before, after), "files": files})
        out = {
            "table": self.table, "version": self.version, "predicate": self.predicate, "total_files": self.total_files,
            "final_files": self.kept[-1] if self.kept else self.total_files, "total_pruning_pct": self.total_pruning_pct,
            "stats_coverage": {"files_with_stats": self.files_with_stats, "total_files": self.total_files, "pct": self.files_with_stats / self.total_files * 100 if self.total_files else 0.0},
            "phases": phases,
        }
        if (a := self.pruning.analysis) is not None:
            out["analysis"] = {"confidence": a.confidence, "notes": a.notes, "partition_safe": a.partition_safe, "stats_safe": a.stats_safe, "unsplittable": a.unsplittable}
        return out

    def _file(self, r, flag: str) -> dict:
        stats = r["stats"].asDict() if r["stats"] else None
        out = {"path": r["path"], "size": r["size"], "status": "kept" if r[flag] else "dropped", "has_stats": self.stats_mode == "log_entry" or r["has_stats"]}
        if r["partition_values"]:
            out["partition_values"] = r["partition_values"]
        if stats and stats["numRecords"] is not None:
            out["num_records"] = stats["numRecords"]
        if bounds := column_bounds(stats):
            out["stats"] = bounds
        return out

    def json(self) -> str:
        return json.dumps(self.document(), indent=2, sort_keys=True)

    def missing_stats(self) -> list[str]:
        if self.stats_mode == "log_entry":
            return []
        return [r["path"] for r in self.ordered_files().where("NOT has_stats").select("path").toLocalIterator()]

    def failures(self, min_pruning: float | None = None, assert_stats: bool = False) -> list[str]:
        out = []
        if min_pruning is not None and self.total_pruning_pct < min_pruning:
            out.append(f"ASSERTION FAILED: total pruning {self.total_pruning_pct:.1f}% is below threshold {min_pruning:.1f}%")
        if assert_stats and (missing := self.missing_stats()):
            out.append("\n".join([f"ASSERTION FAILED: {len(missing)} file(s) missing statistics:", *(f"  {p}" for p in missing)]))
        return out


def report(spark: SparkSession, path: str, shown: str | None = None, predicate: str | None = None, version: int | None = None, mixed_or: str = "separate", stats_mode: str = "strict") -> Report:
    """Reads the log once and prunes with `predicate`; `version` travels back in time."""
    actions = read_table_log(spark, path, version).cache()
    meta, newest = table_metadata(actions).first(), table_version(actions).first()["version"]
    if newest is None or meta["schema_string"] is None:
        actions.unpersist()
        raise TableError(f"No table at '{shown or path}': its log has no metadata")
    files = live_files(actions)
    pruning = prune(files, predicate, schema_of(meta["schema_string"]), list(meta["partition_columns"]), mixed_or)
    return Report(shown or path, newest, predicate, pruning, stats_mode)


def compare(before: Report, after: Report) -> DataFrame:
    """Files of two reports side by side: path, in_before, in_after, kept_before, kept_after."""
    def side(r: Report, name: str) -> DataFrame:
        last = F.col(r.pruning.phases[-1].flag) if r.pruning.phases else F.lit(True)
        return r.pruning.files.select("path", F.lit(True).alias(f"in_{name}"), last.alias(f"kept_{name}"))

    out = side(before, "before").join(side(after, "after"), "path", "full")
    return out.select("path", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_before", "in_after", "kept_before", "kept_after")])
