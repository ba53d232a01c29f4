"""Queries over virtual tables, and the SQL that says what they must return.

Files are made of the rows of a table that share a partition value and a key.
Their statistics are computed, written as JSON log actions, replayed and
pruned, while the SQL states the expected answer as one GROUP BY.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import basename, partition_text, percent_text, size_text
from ..operators.filestats import add_lines, compute_stats, has_stats
from ..operators.lowering import FileColumns, keep
from ..operators.pruning import prune
from ..operators.replay import live_files, table_metadata, table_version
from ..predicate import analyze, parse
from ..sources.log import parse_lines
from . import table_queries

Query = Callable[[SparkSession, str], DataFrame]

COLUMNS = ["l_orderkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_linestatus", "maybe"]


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its file key, and a column that is null never, sometimes or always in a file."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.expr("l_orderkey div 1000")
    maybe = F.when(key % 3 == 0, None).when((key % 3 == 1) | (F.col("l_tax") <= 0.04), F.col("l_tax"))
    return t.select("l_returnflag", "l_orderkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_linestatus", key.alias("key"), maybe.alias("maybe"))


def _path(part: str | None) -> Column:
    tail = F.concat(F.lit("part-"), F.col("key").cast("string"), F.lit(".parquet"))
    return F.concat(F.lit(f"{part}="), F.col(part), F.lit("/"), tail) if part else tail


def lineitem_files(spark: SparkSession, sf_dir: str, flat: bool = False, with_stats: Column | None = None) -> tuple[DataFrame, StructType, list[str]]:
    """(live files, schema, partition columns) after a round trip through a log."""
    t = _lineitem(spark, sf_dir)
    part = None if flat else "l_returnflag"
    columns = [*COLUMNS, "l_returnflag"] if flat else COLUMNS
    stats = compute_stats(t, ["key"] if flat else ["l_returnflag", "key"], columns)
    lines = add_lines(stats, columns, _path(part), F.col("key"), {} if flat else {part: F.col(part)}, with_stats)
    return live_files(parse_lines(lines)), t.drop("key").schema, [] if flat else [part]


def pruned(predicate: str, spark: SparkSession, sf_dir: str, flat: bool = False, mixed_or: str = "separate", no_stats: bool = False) -> DataFrame:
    """Each file with its state after both phases."""
    files, schema, parts = lineitem_files(spark, sf_dir, flat, F.col("key") % 5 != 0 if no_stats else None)
    p = prune(files, predicate, schema, parts, mixed_or)
    have = {x.flag for x in p.phases}
    first = F.col("kept_1") if "kept_1" in have else F.lit(True)
    last = F.col("kept_2") if "kept_2" in have else first
    return p.files.select("path", first.alias("after_partition"), last.alias("after_skipping"))


#: The files of lineitem in SQL.  `{stats}` can take the bounds away.
_BASE = """
WITH t AS (SELECT *, l_orderkey // 1000 AS key, CASE WHEN (l_orderkey // 1000) % 3 = 0 THEN NULL
  WHEN (l_orderkey // 1000) % 3 = 1 OR l_tax <= 0.04::DOUBLE THEN l_tax END AS maybe FROM lineitem),
g AS (SELECT {keys} key, count(*)::BIGINT AS n, min(l_orderkey) AS o_lo, max(l_orderkey) AS o_hi, min(l_quantity) AS q_lo, max(l_quantity) AS q_hi,
  min(l_extendedprice) AS e_lo, max(l_extendedprice) AS e_hi, min(l_shipdate) AS d_lo, max(l_shipdate) AS d_hi,
  min(l_linestatus) AS s_lo, max(l_linestatus) AS s_hi, min(maybe) AS m_lo, max(maybe) AS m_hi, (count(*) FILTER (WHERE maybe IS NULL))::BIGINT AS m_no,
  min(l_returnflag) AS r_lo, max(l_returnflag) AS r_hi FROM t GROUP BY {keys} key),
f AS (SELECT *, {path} AS path FROM g)
"""
BASE = _BASE.format(keys="l_returnflag,", path="'l_returnflag=' || l_returnflag || '/part-' || key || '.parquet'")
FLAT = _BASE.format(keys="", path="'part-' || key || '.parquet'")


def _sql(first: str, last: str, base: str = BASE) -> str:
    """FALSE drops a file, NULL keeps it, and what the first phase drops stays dropped."""
    return f"{base} SELECT path, coalesce({first}, true) AS after_partition, coalesce({first}, true) AND coalesce({last}, true) AS after_skipping FROM f"


#: name: (predicate, first phase in SQL, second phase in SQL)
PRUNING = {
    "partition_prune_eq": ("l_returnflag = 'A'", "l_returnflag = 'A'", "true"),
    "partition_prune_ne": ("l_returnflag != 'A'", "l_returnflag <> 'A'", "true"),
    "partition_prune_range": ("l_returnflag >= 'N' AND 'R' > l_returnflag", "l_returnflag >= 'N' AND l_returnflag < 'R'", "true"),
    "partition_prune_in": ("l_returnflag IN ('A', 'R')", "l_returnflag IN ('A', 'R')", "true"),
    "partition_prune_not_in": ("l_returnflag NOT IN ('R')", "l_returnflag <> 'R'", "true"),
    "partition_prune_not": ("NOT l_returnflag = 'A'", "l_returnflag <> 'A'", "true"),
    "partition_prune_or": ("l_returnflag = 'A' OR l_returnflag = 'N'", "l_returnflag IN ('A', 'N')", "true"),
    "partition_prune_between": ("l_returnflag BETWEEN 'A' AND 'N'", "l_returnflag BETWEEN 'A' AND 'N'", "true"),
    "partition_prune_is_null": ("l_returnflag IS NULL", "false", "true"),
    "partition_prune_null_literal": ("l_returnflag = NULL", "false", "true"),
    "skip_eq": ("l_orderkey = 4321", "true", "4321 BETWEEN o_lo AND o_hi"),
    "skip_ne": ("l_linestatus <> 'F'", "true", "s_lo <> 'F' OR s_hi <> 'F'"),
    "skip_lt": ("l_orderkey < 2500", "true", "o_lo < 2500"),
    "skip_le": ("l_orderkey <= 2000", "true", "o_lo <= 2000"),
    "skip_gt": ("l_extendedprice > 90000.5", "true", "e_hi > 90000.5::DOUBLE"),
    "skip_ge": ("l_shipdate >= '2001-10-15'", "true", "d_hi >= TIMESTAMP '2001-10-15'"),
    "skip_reversed": ("5000 < l_orderkey", "true", "o_hi > 5000"),
    "skip_negative": ("l_quantity > -10", "true", "q_hi > -10"),
    "skip_not": ("NOT (l_orderkey < 3000 OR l_orderkey > 6000)", "true", "o_hi >= 3000 AND o_lo <= 6000"),
    "skip_between": ("l_orderkey BETWEEN 1500 AND 3500", "true", "o_hi >= 1500 AND o_lo <= 3500"),
    "skip_not_between": ("l_orderkey NOT BETWEEN 1000 AND 13999", "true", "o_lo < 1000 OR o_hi > 13999"),
    "skip_in": ("l_orderkey IN (10, 7007, 99999999)", "true", "10 BETWEEN o_lo AND o_hi OR 7007 BETWEEN o_lo AND o_hi OR 99999999 BETWEEN o_lo AND o_hi"),
    "skip_not_in": ("l_linestatus NOT IN ('F', 'O')", "true", "(s_lo <> 'F' OR s_hi <> 'F') AND (s_lo <> 'O' OR s_hi <> 'O')"),
    "skip_is_null": ("maybe IS NULL", "true", "m_no <> 0"),
    "skip_is_not_null": ("maybe IS NOT NULL", "true", "m_no <> n"),
    "skip_null_column": ("maybe > 0.07", "true", "m_hi > 0.07::DOUBLE"),
    "skip_or": ("l_orderkey < 1200 OR l_orderkey > 12800", "true", "o_lo < 1200 OR o_hi > 12800"),
    "skip_column_pair": ("l_quantity < l_extendedprice", "true", "NULL::BOOLEAN"),
    "combined_phases": ("l_returnflag = 'A' AND l_orderkey > 8000", "l_returnflag = 'A'", "o_hi > 8000"),
    "combined_nested": ("((((l_orderkey > 8000)))) AND (l_returnflag = 'A' OR l_returnflag = 'R')", "l_returnflag IN ('A', 'R')", "o_hi > 8000"),
    "combined_precedence": ("l_returnflag <> 'A' AND (l_returnflag = 'N' OR l_returnflag = 'A')", "l_returnflag <> 'A' AND l_returnflag IN ('N', 'A')", "true"),
    "skip_mixed_separate": ("l_returnflag = 'A' OR l_orderkey > 8000", "true", "true"),
}
_VARIANTS = {
    "skip_mixed_joint": ("l_returnflag = 'A' OR l_orderkey > 8000", {"mixed_or": "joint"}, _sql("true", "l_returnflag = 'A' OR o_hi > 8000")),
    "skip_no_stats": ("l_orderkey > 8000", {"no_stats": True}, _sql("true", "CASE WHEN key % 5 = 0 THEN NULL ELSE o_hi > 8000 END")),
    "flat_table": ("l_returnflag = 'A' AND l_orderkey > 8000", {"flat": True}, _sql("true", "NOT (r_hi < 'A' OR r_lo > 'A') AND o_hi > 8000", FLAT)),
}


def file_stats_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = compute_stats(_lineitem(spark, sf_dir), ["l_returnflag", "key"], ["l_quantity", "maybe"])
    return s.select("l_returnflag", F.col("key").cast("long").alias("key"), "num_records", "min_l_quantity", "max_l_quantity", "min_maybe", "max_maybe", "nulls_maybe")


def stats_roundtrip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of events after JSON and back; timestamps must keep their microseconds."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.dayofmonth("ts"))
    s = compute_stats(e, ["event_type", "day"], ["ts", "value", "user_id"])
    lines = add_lines(s, ["ts", "value", "user_id"], F.concat_ws("/", "event_type", F.col("day").cast("string")), F.col("day"), {"event_type": F.col("event_type")})
    f = live_files(parse_lines(lines))
    low, high = F.col("stats.minValues"), F.col("stats.maxValues")
    return f.select("path", F.col("stats.numRecords").alias("num_records"), low["ts"].cast("timestamp_ntz").alias("min_ts"), high["ts"].cast("timestamp_ntz").alias("max_ts"), low["value"].cast("double").alias("min_value"), high["value"].cast("double").alias("max_value"), low["user_id"].cast("bigint").alias("min_user_id"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of a table of orders: adds, removes of some, re-adds of some of these, two metadata actions."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("key", F.expr("o_orderkey div 500"))
    s = compute_stats(o, ["o_orderstatus", "key"], ["o_totalprice"])
    path = F.concat_ws("/", "o_orderstatus", F.col("key").cast("string"))
    add = partial(add_lines, columns=["o_totalprice"], path=path, partition={"o_orderstatus": F.col("o_orderstatus")})
    removed = s.where("key % 7 = 0").select((F.col("key") + 100_000).cast("long").alias("commit_version"), F.lit(0).alias("line_no"), F.to_json(F.struct(F.struct(path.alias("path")).alias("remove"))).alias("line"))
    again = add(s.where("key % 14 = 0"), version=F.col("key") + 200_000, size=F.lit(1).cast("long"))
    meta = spark.sql("""SELECT * FROM VALUES (0L, 9, '{"metaData":{"schemaString":"{}","partitionColumns":["old"]}}'), (0L, 8, 'no json'), (150000L, 0, '{"metaData":{"schemaString":"{}","partitionColumns":["o_orderstatus"]}}') AS t(commit_version, line_no, line)""")
    return parse_lines(add(s, version=F.col("key")).union(removed).union(again).union(meta))


def live_files_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_files(_history(spark, sf_dir)).select("path", "size", "commit_version", F.col("stats.numRecords").alias("num_records"))


def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_files(_history(spark, sf_dir), version=150_000).select("path", "commit_version")


def table_version_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_version(_history(spark, sf_dir))


def partition_columns_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_metadata(_history(spark, sf_dir)).select(F.array_join("partition_columns", ",").alias("partition_columns"))


def phase_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, schema, parts = lineitem_files(spark, sf_dir)
    return prune(files, "l_returnflag = 'A' AND l_orderkey > 8000", schema, parts).phase_table()


def stats_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _, _ = lineitem_files(spark, sf_dir, with_stats=F.col("key") % 5 != 0)
    n, total = F.count_if(has_stats(F.col("stats"))), F.count("*")
    return files.agg(n.alias("files_with_stats"), total.alias("total_files"), F.coalesce(n / F.nullif(total, F.lit(0)) * 100.0, F.lit(0.0)).alias("pct"))


def missing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _, _ = lineitem_files(spark, sf_dir, with_stats=F.col("key") % 5 != 0)
    return files.where(~has_stats(F.col("stats"))).select("path")


def per_file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reports show of each candidate of the second phase."""
    files, schema, parts = lineitem_files(spark, sf_dir)
    p = prune(files, "l_returnflag = 'A' AND l_orderkey > 8000", schema, parts)
    return p.files.where("kept_1").select(
        basename(F.col("path")).alias("name"), F.when(F.col("kept_2"), "kept").otherwise("dropped").alias("status"),
        F.col("stats.numRecords").alias("num_records"), partition_text(F.col("partition_values")).alias("partition"), "has_stats",
    )


def size_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _, _ = lineitem_files(spark, sf_dir)
    return files.select("path", "size", size_text(F.col("size")).alias("size_text"))


def min_pruning_assert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether thresholds around the true percentage pass: equality does."""
    files, schema, parts = lineitem_files(spark, sf_dir)
    t = prune(files, "l_returnflag = 'A'", schema, parts).phase_table()
    pct = F.col("pruning_pct")
    return t.select(percent_text(pct).alias("shown"), (pct >= 10).alias("passes_10"), (pct >= pct).alias("passes_itself"), (pct >= 99).alias("passes_99"))


CLASSIFIED = ("l_returnflag = 'A'", "l_quantity > 50", "l_returnflag = 'A' AND l_quantity > 50", "l_returnflag = 'A' OR l_quantity > 50", "l_returnflag = 'A' AND (l_returnflag = 'N' OR l_quantity > 50) AND l_tax < 100")


def predicate_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for k, text in enumerate(CLASSIFIED):
        a = analyze(parse(text), ["l_returnflag"])
        rows.append((k, a.partition_safe, a.stats_safe, a.unsplittable, a.confidence, len(a.notes)))
    return spark.createDataFrame(rows, "id int, partition_safe string, stats_safe string, unsplittable string, confidence string, notes int")


SOUND = ("l_returnflag = 'A' AND l_extendedprice > 100000", "NOT (l_orderkey < 3000 OR l_returnflag = 'R')", "maybe IS NULL OR l_quantity BETWEEN 2 AND 3", "NOT maybe <= 0.05 AND l_shipdate < '1996-01-01'")


def soundness_no_false_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that match but whose file was dropped, by predicate: none.  Rows are counted by file before they meet the files."""
    files, schema, parts = lineitem_files(spark, sf_dir)
    f = FileColumns(schema, frozenset(parts))
    dropped = files.select("path", *[(~keep(parse(text), f)).alias(f"drop_{k}") for k, text in enumerate(SOUND)])
    rows = _lineitem(spark, sf_dir).withColumn("path", _path("l_returnflag"))
    hits = rows.groupBy("path").agg(*[F.count_if(F.expr(text)).alias(f"hits_{k}") for k, text in enumerate(SOUND)])
    lost = hits.join(dropped, "path").agg(*[F.coalesce(F.sum(F.when(F.col(f"drop_{k}"), F.col(f"hits_{k}")).otherwise(0)), F.lit(0)).alias(f"lost_{k}") for k in range(len(SOUND))])
    return lost.select(F.explode(F.array(*[F.struct(F.lit(k).alias("id"), F.col(f"lost_{k}").alias("lost_rows")) for k in range(len(SOUND))])).alias("x")).select("x.*")


QUERIES: dict[str, Query] = {
    **{name: partial(pruned, predicate) for name, (predicate, _, _) in PRUNING.items()},
    **{name: partial(pruned, predicate, **options) for name, (predicate, options, _) in _VARIANTS.items()},
    "file_stats_lineitem": file_stats_lineitem,
    "stats_roundtrip_events": stats_roundtrip_events,
    "live_files_replay": live_files_replay,
    "time_travel": time_travel,
    "table_version": table_version_query,
    "partition_columns_last_wins": partition_columns_last_wins,
    "phase_table": phase_table,
    "stats_coverage": stats_coverage,
    "missing_stats": missing_stats,
    "per_file_status": per_file_status,
    "size_text": size_text_query,
    "min_pruning_assert": min_pruning_assert,
    "predicate_classification": predicate_classification,
    "soundness_no_false_drop": soundness_no_false_drop,
    **table_queries.QUERIES,
}

_ORDERS = """
WITH s AS (SELECT o_orderstatus, o_orderkey // 500 AS key, count(*)::BIGINT AS n FROM orders GROUP BY ALL),
p AS (SELECT *, o_orderstatus || '/' || key AS path FROM s)
"""

ORACLE_SQL = {
    **{name: _sql(first, last) for name, (_, first, last) in PRUNING.items()},
    **{name: sql for name, (_, _, sql) in _VARIANTS.items()},
    "file_stats_lineitem": f"{BASE} SELECT l_returnflag, key::BIGINT AS key, n AS num_records, q_lo AS min_l_quantity, q_hi AS max_l_quantity, m_lo AS min_maybe, m_hi AS max_maybe, m_no AS nulls_maybe FROM f",
    "stats_roundtrip_events": "SELECT event_type || '/' || day(ts) AS path, count(*)::BIGINT AS num_records, min(ts) AS min_ts, max(ts) AS max_ts, min(value) AS min_value, max(value) AS max_value, min(user_id) AS min_user_id FROM events GROUP BY event_type, day(ts)",
    "live_files_replay": f"{_ORDERS} SELECT path, CASE WHEN key % 14 = 0 THEN 1 ELSE n * 100 END::BIGINT AS size, (key + CASE WHEN key % 14 = 0 THEN 200000 ELSE 0 END)::BIGINT AS commit_version, n AS num_records FROM p WHERE key % 7 <> 0 OR key % 14 = 0",
    "time_travel": f"{_ORDERS} SELECT path, key::BIGINT AS commit_version FROM p WHERE key % 7 <> 0",
    "table_version": f"{_ORDERS} SELECT greatest(max(key), 150000, max(CASE WHEN key % 7 = 0 THEN key + 100000 END), max(CASE WHEN key % 14 = 0 THEN key + 200000 END))::BIGINT AS version FROM p",
    "partition_columns_last_wins": "SELECT 'o_orderstatus' AS partition_columns",
    "phase_table": f"""{BASE}, c AS (SELECT count(*)::BIGINT AS a, (count(*) FILTER (WHERE l_returnflag = 'A'))::BIGINT AS b, (count(*) FILTER (WHERE l_returnflag = 'A' AND o_hi > 8000))::BIGINT AS c FROM f)
SELECT 1::INT AS phase, 'Partition pruning' AS name, a AS input_files, b AS output_files, a - b AS pruned_files, (a - b)::DOUBLE / a::DOUBLE * 100 AS pruning_pct FROM c
UNION ALL SELECT 2::INT, 'Data skipping (min/max statistics)', b, c, b - c, (b - c)::DOUBLE / b::DOUBLE * 100 FROM c""",
    "stats_coverage": f"{BASE} SELECT (count(*) FILTER (WHERE key % 5 <> 0))::BIGINT AS files_with_stats, count(*)::BIGINT AS total_files, (count(*) FILTER (WHERE key % 5 <> 0))::DOUBLE / count(*)::DOUBLE * 100 AS pct FROM f",
    "missing_stats": f"{BASE} SELECT path FROM f WHERE key % 5 = 0",
    "per_file_status": f"{BASE} SELECT 'part-' || key || '.parquet' AS name, CASE WHEN o_hi > 8000 THEN 'kept' ELSE 'dropped' END AS status, n AS num_records, 'partition(l_returnflag=A)' AS partition, true AS has_stats FROM f WHERE l_returnflag = 'A'",
    "size_text": f"{BASE} SELECT path, n * 100 AS size, CASE WHEN n * 100 >= 1073741824 THEN printf('%.1f GB', n * 100 / 1073741824.0::DOUBLE) WHEN n * 100 >= 1048576 THEN printf('%.1f MB', n * 100 / 1048576.0::DOUBLE) WHEN n * 100 >= 1024 THEN printf('%.1f KB', n * 100 / 1024.0::DOUBLE) ELSE (n * 100) || ' B' END AS size_text FROM f",
    "min_pruning_assert": f"{BASE}, c AS (SELECT (count(*) FILTER (WHERE l_returnflag <> 'A'))::DOUBLE / count(*)::DOUBLE * 100 AS pct FROM f) SELECT round_even(pct, 0)::BIGINT || '%' AS shown, pct >= 10 AS passes_10, true AS passes_itself, pct >= 99 AS passes_99 FROM c",
    "predicate_classification": """SELECT * FROM (VALUES
  (0::INT, 'l_returnflag = ''A''', NULL::VARCHAR, NULL::VARCHAR, 'Exact', 0::INT),
  (1, NULL, 'l_quantity > 50', NULL, 'Conservative', 0),
  (2, 'l_returnflag = ''A''', 'l_quantity > 50', NULL, 'Conservative', 0),
  (3, NULL, NULL, 'l_returnflag = ''A'' OR l_quantity > 50', 'Incomplete', 1),
  (4, 'l_returnflag = ''A''', 'l_tax < 100', 'l_returnflag = ''N'' OR l_quantity > 50', 'Incomplete', 1)
) AS t(id, partition_safe, stats_safe, unsplittable, confidence, notes)""",
    "soundness_no_false_drop": "SELECT id::INT AS id, 0::BIGINT AS lost_rows FROM range(4) AS r(id)",
    **table_queries.ORACLE_SQL,
}
