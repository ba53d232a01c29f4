"""Command line: which files a predicate lets a reader skip, and why."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.report import compare, report
from .sources.storage import hadoop_options, storage_options, table_path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skiplens", description=__doc__)
    p.add_argument("path", help="table folder or URL (s3://, az://, gs://)")
    p.add_argument("-w", "--where", help="predicate")
    p.add_argument("-v", "--verbose", action="store_true", help="list files by phase (text only; JSON always lists them)")
    p.add_argument("--format", default="text", help="text or json; anything else is text")
    p.add_argument("--min-pruning", type=float, help="fail if total pruning is below this percentage")
    p.add_argument("--assert-stats", action="store_true", help="fail if a live file has no statistics")
    p.add_argument("--region", help="cloud region")
    p.add_argument("--option", action="append", default=[], help="storage option KEY=VALUE, repeatable")
    p.add_argument("--env-creds", action="store_true", help="take credentials from the environment")
    p.add_argument("--public", action="store_true", help="unsigned requests")
    p.add_argument("--version-as-of", type=int, help="look at an older version")
    p.add_argument("--compare-to", type=int, metavar="VERSION", help="then list files that an older version or its pruning treats otherwise")
    p.add_argument("--mixed-or", choices=("separate", "joint"), default="separate", help="how clauses on both kinds of columns are evaluated")
    p.add_argument("--stats-mode", choices=("strict", "log_entry"), default="strict", help="what counts as having statistics")
    return p


def differences(both: DataFrame) -> list[str]:
    """Lines on the files that two reports treat differently, by path."""
    state = lambda x: F.when(~F.col(f"in_{x}"), "absent").when(F.col(f"kept_{x}"), "kept").otherwise("dropped")
    rows = both.select("path", state("before").alias("a"), state("after").alias("b")).where("a <> b").orderBy("path")
    return [f"{r['path']}: {r['a']} -> {r['b']}" for r in rows.toLocalIterator()]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        given = storage_options(args.region, args.public, args.env_creds, args.option)
        path, options = table_path(args.path, given), hadoop_options(given, args.path)
        if spark is None:
            builder = SparkSession.builder.appName("skiplens").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
            for k, v in options.items():
                builder = builder.config(f"spark.hadoop.{k}" if k.startswith("fs.") else k, v)
            spark = builder.getOrCreate()
        r = report(spark, path, args.path, args.where, args.version_as_of, args.mixed_or, args.stats_mode)
        out = r.json() if args.format == "json" else r.text(args.verbose)
        failures = r.failures(args.min_pruning, args.assert_stats)
        if args.compare_to is not None:
            old = report(spark, path, args.path, args.where, args.compare_to, args.mixed_or, args.stats_mode)
            out += "".join(f"\n{line}" for line in differences(compare(old, r)))
    except Exception as e:  # noqa: BLE001  any failure is one line on stderr and nothing on stdout
        print(f"Error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1
    print(out)
    for f in failures:
        print(f, file=sys.stderr)
    if args.min_pruning and args.where is None:
        print("Hint: without --where nothing is pruned.", file=sys.stderr)
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
