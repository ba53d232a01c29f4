"""Queries over tables with a log on disk, and over log lines made for one case each, with their SQL.

Logs are written to the shared checkpoint folder and read back through the
same functions as the command line uses.
"""

from __future__ import annotations

import contextlib
import io
import json
import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..cli import differences, main
from ..functions.text import column_bounds, format_size, stats_text
from ..operators.filestats import add_lines, compute_stats
from ..operators.lowering import PHYSICAL_NAME
from ..operators.pruning import prune
from ..operators.replay import live_files
from ..sources.log import parse_lines, read_table_log
from ..sources.storage import TableError, hadoop_options, storage_options, table_path
from ..sources.writer import metadata_line, remove_lines, write_commit, write_log, write_table
from .report import compare, report


def _folder(spark: SparkSession, name: str) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise TableError("spark.checkpoint.dir must name a shared folder")
        import tempfile

        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skiplens-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4()}"


def _order_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, StructType]:
    """An add line for each status and 100 keys of orders; version = key modulo 7, lines by status and key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderstatus", "o_orderkey", "o_custkey", F.expr("o_orderkey div 100").alias("key"))
    s = compute_stats(o, ["o_orderstatus", "key"], ["o_orderkey", "o_custkey"])
    path = F.concat(F.lit("o_orderstatus="), "o_orderstatus", F.lit("/part-"), F.lpad(F.col("key").cast("string"), 8, "0"), F.lit(".parquet"))
    lines = add_lines(s, ["o_orderkey", "o_custkey"], path, F.col("key") % 7, {"o_orderstatus": F.col("o_orderstatus")})
    place = F.ascii(F.get_json_object("line", "$.add.partitionValues.o_orderstatus")).cast("long") * 100_000_000 + F.regexp_extract(F.get_json_object("line", "$.add.path"), r"part-0*(\d+)", 1).cast("long")
    schema = StructType([StructField("o_orderkey", LongType()), StructField("o_custkey", LongType()), StructField("o_orderstatus", StringType())])
    return lines.withColumn("line_no", place + 1), schema


def orders_table(spark: SparkSession, sf_dir: str) -> str:
    """A table of orders whose log is written to disk; its data files are only described."""
    lines, schema = _order_lines(spark, sf_dir)
    folder = _folder(spark, "orders")
    head = spark.createDataFrame([(0, 0, metadata_line(schema.json(), ["o_orderstatus"])), (0, 1, "no json")], "commit_version long, line_no int, line string")
    write_log(spark, folder, lines.unionByName(head))
    return folder


WHERE = "o_orderstatus = 'F' AND o_orderkey > 5000"
_FILES = """
WITH f AS (SELECT o_orderstatus, o_orderkey // 100 AS key, count(*)::BIGINT AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi, min(o_custkey) AS c_lo, max(o_custkey) AS c_hi,
  'o_orderstatus=' || o_orderstatus || '/part-' || lpad((o_orderkey // 100)::VARCHAR, 8, '0') || '.parquet' AS path, ((o_orderkey // 100) % 7)::BIGINT AS version FROM orders GROUP BY ALL),
c AS (SELECT count(*)::BIGINT AS a, (count(*) FILTER (WHERE o_orderstatus = 'F'))::BIGINT AS b, (count(*) FILTER (WHERE o_orderstatus = 'F' AND hi > 5000))::BIGINT AS c, max(version) AS v FROM f)
"""


def log_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live files of a log read from disk, next to files that are no commits."""
    folder = orders_table(spark, sf_dir)
    write_commit(spark, f"{folder}/_delta_log/_tmp", 9, [json.dumps({"add": {"path": "no"}})])
    return live_files(read_table_log(spark, folder)).select("path", "commit_version", F.col("stats.numRecords").alias("num_records"))


def checkpoint_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after commits 0 to 3 went into a checkpoint and their files were deleted; commit 7 removes a status."""
    folder = orders_table(spark, sf_dir)
    log = f"{folder}/_delta_log"
    old = read_table_log(spark, folder, 3).select("add", "remove", "metaData")
    old.coalesce(1).write.parquet(f"{folder}/checkpoint")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(path(f"{folder}/checkpoint")) if f.getPath().getName().startswith("part-"))
    fs.rename(part, path(f"{log}/{3:020d}.checkpoint.parquet"))
    for v in range(4):
        fs.delete(path(f"{log}/{v:020d}.json"), False)
    gone = [r["path"] for r in live_files(read_table_log(spark, folder)).where("partition_values['o_orderstatus'] = 'P'").select("path").toLocalIterator()]
    write_commit(spark, folder, 7, remove_lines(gone))
    return live_files(read_table_log(spark, folder)).select("path", F.col("stats.numRecords").alias("num_records"))


def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text report without its path, line by line."""
    lines = report(spark, orders_table(spark, sf_dir), "orders", WHERE).text().split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")


def report_json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the JSON document, in its order by commit."""
    doc = json.loads(report(spark, orders_table(spark, sf_dir), "orders", WHERE).json())
    rows = [(k, f["path"], f["status"], f["num_records"], f["has_stats"], f["partition_values"]["o_orderstatus"], f["stats"]["o_orderkey"]["min"], f["stats"]["o_orderkey"]["null_count"]) for k, p in enumerate(doc["phases"], 1) for f in p["files"]]
    return spark.createDataFrame(rows, "phase int, path string, status string, num_records long, has_stats boolean, part string, min_key string, nulls int")


def report_json_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, coverage and classification of the JSON document; total pruning over two phases."""
    doc = json.loads(report(spark, orders_table(spark, sf_dir), "orders", WHERE).json())
    a, c = doc["analysis"], doc["stats_coverage"]
    row = (doc["table"], doc["version"], doc["predicate"], doc["total_files"], doc["final_files"], doc["total_pruning_pct"], c["files_with_stats"], c["pct"], a["confidence"], a["partition_safe"], a["stats_safe"], len(a["notes"]), doc["phases"][-1]["output_files"])
    return spark.createDataFrame([row], "table string, version long, predicate string, total_files long, final_files long, total_pruning_pct double, files_with_stats long, pct double, confidence string, partition_safe string, stats_safe string, notes int, last_phase long")


def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which files are listed."""
    rows = [(k, r["path"]) for k, r in enumerate(report(spark, orders_table(spark, sf_dir)).ordered_files().select("path").toLocalIterator())]
    return spark.createDataFrame(rows, "place int, path string")


def stats_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics as the verbose report writes them, by column name."""
    rows = live_files(parse_lines(_order_lines(spark, sf_dir)[0])).select("path", "size", "stats").toLocalIterator()
    made = [(r["path"], format_size(r["size"]), stats_text(r["stats"].asDict()), json.dumps(column_bounds(r["stats"].asDict())["o_custkey"], sort_keys=True)) for r in rows]
    return spark.createDataFrame(made, "path string, size string, shown string, custkey string")


def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the newest version has and version 2 hasn't."""
    folder = orders_table(spark, sf_dir)
    lines = differences(compare(report(spark, folder, predicate=WHERE, version=2), report(spark, folder, predicate=WHERE)))
    return spark.createDataFrame([(x,) for x in lines], "line string")


#: Command lines after the path: (name, arguments).
CLI = (
    ("plain", []), ("pruned", ["-w", WHERE]), ("json wins over -v", ["-w", WHERE, "--format", "json", "-v"]), ("unknown format", ["-w", WHERE, "--format", "xml"]),
    ("enough", ["-w", WHERE, "--min-pruning", "1"]), ("too little", ["-w", WHERE, "--min-pruning", "100"]), ("no predicate", ["--min-pruning", "5"]),
    ("stats", ["--assert-stats"]), ("both fail after the report", ["-w", "o_orderkey > 0", "--min-pruning", "50", "--region", "eu", "--public", "--env-creds", "--option", "a=b"]),
    ("unknown column", ["-w", "nope = 1"]), ("case counts", ["-w", "O_ORDERKEY = 1"]), ("function", ["-w", "upper(o_orderstatus) = 'F'"]), ("subquery", ["-w", "o_orderkey = (SELECT 1)"]),
    ("like", ["-w", "o_orderstatus LIKE 'F%'"]), ("arithmetic", ["-w", "o_orderkey + 1 > 3"]), ("not a number", ["-w", "o_orderkey = 1.5"]), ("bare column", ["-w", "o_orderkey"]),
    ("empty", ["-w", ""]), ("open", ["-w", "(("]), ("bad option", ["--option", "x"]),
)


def cli_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes, and the first words of standard output and of the errors."""
    folder, rows = orders_table(spark, sf_dir), []
    path = folder.removeprefix("file:")
    for name, args in CLI:
        out, err = io.StringIO(), io.StringIO()
        with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
            code = main([path if folder.startswith("file:") else folder, *args], spark)
        rows.append((name, code, (out.getvalue().split() or [""])[0], (err.getvalue().split() or [""])[0]))
    return spark.createDataFrame(rows, "name string, code int, out string, err string")


def written_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written with its data, read back through its log: rows by partition as the statistics and the files say."""
    folder = _folder(spark, "written")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")
    write_table(nation, folder, ["n_regionkey"], files=2)
    files = live_files(read_table_log(spark, folder))
    write_commit(spark, folder, 1, remove_lines([r["path"] for r in files.where("partition_values['n_regionkey'] = '4'").select("path").collect()]))
    live = live_files(read_table_log(spark, folder))
    told = live.groupBy(F.col("partition_values")["n_regionkey"].cast("int").alias("n_regionkey")).agg(F.sum("stats.numRecords").alias("told"), F.min(F.col("stats.minValues")["n_nationkey"].cast("int")).alias("lo"), F.min(F.col("size") > 0).alias("sized"))
    found = spark.read.schema(nation.schema).parquet(folder).withColumn("path", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    found = found.join(live.select(F.element_at(F.split("path", "/"), -1).alias("path")), "path", "left_semi").groupBy("n_regionkey").agg(F.count("*").alias("found"))
    return told.join(found, "n_regionkey").select("n_regionkey", "told", "found", "lo", "sized")


def _cases(spark: SparkSession, sf_dir: str, values: dict[str, str], low: str, high: str, schema: StructType, parts: list[str], predicates: tuple[str, ...], keep_null: bool = True) -> DataFrame:
    """Which files, one for each supplier, stay for each predicate."""
    t = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    made = F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("key"), F.expr(v).cast("string").alias("value")) for n, v in values.items()])) if values else F.from_json(F.lit("{}"), "map<string,string>")
    made = made if keep_null else F.map_filter(made, lambda _, v: v.isNotNull())
    stats = F.to_json(F.struct(F.lit(2).alias("numRecords"), F.expr(low).alias("minValues"), F.expr(high).alias("maxValues")))
    line = F.to_json(F.struct(F.struct(F.col("k").cast("string").alias("path"), made.alias("partitionValues"), F.lit(1).alias("size"), stats.alias("stats")).alias("add")), {"ignoreNullFields": "false"})
    files, out = live_files(parse_lines(t.select(F.lit(0).cast("long").alias("commit_version"), F.lit(0).alias("line_no"), line.alias("line")))), None
    for text in predicates:
        p = prune(files, text, schema, parts)
        kept = p.files.select(F.lit(text).alias("predicate"), F.col("path").cast("long").alias("k"), F.col(p.phases[-1].flag).alias("kept"))
        out = kept if out is None else out.unionByName(kept)
    return out


_LONG, _BOOL = LongType(), BooleanType()
_SOME = "CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 'abc' ELSE CAST(k % 4 AS STRING) END"
_FLAG, _TOP = "named_struct('b', k % 3 = 0)", "named_struct('b', k % 3 <> 1)"
_V = "named_struct('v', k)"
#: name: (partition values, low and high in SQL, schema, partition columns, NULL values kept, {predicate: SQL})
CASES = {
    "partition_null_and_bad_cast": ({"p": _SOME}, _V, _V, StructType([StructField("p", _LONG), StructField("v", _LONG)]), ["p"], True, {
        "p > 2": "CASE WHEN k % 4 = 0 THEN false WHEN k % 4 = 1 THEN true ELSE k % 4 > 2 END", "NOT p > 2": "CASE WHEN k % 4 = 0 THEN false WHEN k % 4 = 1 THEN true ELSE k % 4 <= 2 END",
        "p IS NULL": "k % 4 = 0", "p IS NOT NULL AND v < 20": "k % 4 <> 0 AND k < 20", "p = NULL": "false"}),
    "partition_missing_key": ({"p": _SOME}, _V, _V, StructType([StructField("p", _LONG), StructField("v", _LONG)]), ["p"], False, {
        "p > 2": "k % 4 IN (0, 1, 3)", "p IS NULL": "k % 4 = 0"}),
    "partition_pair": ({"p": "k % 5", "q": "k % 3"}, _V, _V, StructType([StructField("p", _LONG), StructField("q", _LONG), StructField("v", _LONG)]), ["p", "q"], True, {
        "p = q": "k % 5 = k % 3", "NOT p <= q": "k % 5 > k % 3", "p < v": "true"}),
    "boolean_columns": ({}, _FLAG, _TOP, StructType([StructField("b", _BOOL)]), [], True, {
        "b": "k % 3 <> 1", "NOT b": "k % 3 <> 0", "b = true": "k % 3 <> 1", "b <> true": "k % 3 <> 0", "false = b": "k % 3 <> 0"}),
    "nested_column": ({}, "named_struct('a', named_struct('b', named_struct('c', k)))", "named_struct('a', named_struct('b', named_struct('c', k + 5)))",
        StructType([StructField("a", StructType([StructField("b", StructType([StructField("c", _LONG)]))]))]), [], True, {"a.b.c > 30": "k + 5 > 30", "a.b.c BETWEEN 10 AND 12": "k + 5 >= 10 AND k <= 12"}),
    "physical_names": ({"col-1": "k % 4"}, "named_struct('col-2', k)", "named_struct('col-2', k)",
        StructType([StructField("p", _LONG, True, {PHYSICAL_NAME: "col-1"}), StructField("v", _LONG, True, {PHYSICAL_NAME: "col-2"})]), ["p"], True, {"p = 2": "k % 4 = 2", "p = 2 AND v > 40": "k % 4 = 2 AND k > 40"}),
    "constant_clauses": ({"p": "k % 4"}, _V, _V, StructType([StructField("p", _LONG), StructField("v", _LONG)]), ["p"], True, {
        "1 = 2 OR v < 9": "k < 9", "1 < 2 AND v >= 9": "k >= 9", "NULL IS NOT NULL OR v = 3": "k = 3"}),
}


def cases(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    values, low, high, schema, parts, keep_null, predicates = CASES[name]
    return _cases(spark, sf_dir, values, low, high, schema, parts, tuple(predicates), keep_null)


#: Options by connector: (URL, region, unsigned, environment, options).
PATHS = (
    ("s3://b/t/", "eu", False, False, ["AWS_ENDPOINT=http://h:1"]), ("s3://b/t", None, True, False, []), ("az://c/t", None, False, False, ["account_name=acc", "account_key=k=1"]), ("az://c/t", None, False, True, ["account_name=acc"]),
    ("gs://b/t", None, True, False, []), ("gcs://b/t/", None, False, False, ["service_account=/x.json"]), ("hdfs:///t/", None, True, False, ["fs.x=1"]),
)


def storage_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and settings that stand for URLs and options."""
    rows = []
    for k, (url, region, public, env, options) in enumerate(PATHS):
        given = storage_options(region, public, env, options)
        rows.append((k, table_path(url, given), json.dumps(hadoop_options(given, url), sort_keys=True)))
    return spark.createDataFrame(rows, "id int, path string, settings string")


QUERIES = {
    **{f.__name__: f for f in (log_listing, checkpoint_replay, report_text, report_json_files, report_json_totals, newest_first, stats_display, version_compare, cli_runs, written_table, storage_settings)},
    **{name: partial(cases, name) for name in CASES},
}


def _case_sql(predicates: dict[str, str]) -> str:
    quoted = lambda x: x.replace("'", "''")
    return " UNION ALL ".join(f"SELECT '{quoted(p)}' AS predicate, s_suppkey AS k, {sql} AS kept FROM (SELECT s_suppkey, s_suppkey AS k FROM supplier)" for p, sql in predicates.items())


def _share(a: str, b: str) -> str:
    return f"({a} - {b})::DOUBLE / {a}::DOUBLE * 100"


def _phase_lines(first: int, k: int, name: str, predicate: str, a: str, b: str) -> str:
    texts = ["''", f"'Phase {k}: {name}'", "'  predicate:       " + predicate.replace("'", "''") + "'", f"format('  files remaining: {{:,}}  (-{{:,}}, {{}}% pruned)', {b}, {a} - {b}, round_even({_share(a, b)}, 0)::BIGINT)"]
    return " UNION ALL ".join(f"SELECT {first + i}::INT, {t} FROM c" for i, t in enumerate(texts))


ORACLE_SQL = {
    "log_listing": f"{_FILES} SELECT path, version AS commit_version, n AS num_records FROM f",
    "checkpoint_replay": f"{_FILES} SELECT path, n AS num_records FROM f WHERE o_orderstatus <> 'P'",
    "report_text": f"""{_FILES} SELECT 0::INT AS line_no, 'Delta table: orders' AS line FROM c UNION ALL SELECT 1, 'Version:     ' || v FROM c
UNION ALL SELECT 2, 'Predicate:   {WHERE.replace("'", "''")}' FROM c UNION ALL SELECT 3, '' FROM c UNION ALL SELECT 4, format('Files in snapshot: {{:,}}', a) FROM c
UNION ALL {_phase_lines(5, 1, "Partition pruning", "o_orderstatus = 'F'", "a", "b")} UNION ALL {_phase_lines(9, 2, "Data skipping (min/max statistics)", "o_orderkey > 5000", "b", "c")}
UNION ALL SELECT 13, '' FROM c UNION ALL SELECT 14, format('Total reduction: {{:,}} -> {{:,}} files ({{}}% pruned)', a, c, round_even({_share("a", "c")}, 0)::BIGINT) FROM c""",
    "report_json_files": f"""{_FILES} SELECT 1::INT AS phase, path, CASE WHEN o_orderstatus = 'F' THEN 'kept' ELSE 'dropped' END AS status, n AS num_records, true AS has_stats, o_orderstatus AS part, lo::VARCHAR AS min_key, 0::INT AS nulls FROM f
UNION ALL SELECT 2, path, CASE WHEN hi > 5000 THEN 'kept' ELSE 'dropped' END, n, true, o_orderstatus, lo::VARCHAR, 0 FROM f WHERE o_orderstatus = 'F'""",
    "report_json_totals": f"""{_FILES} SELECT 'orders' AS "table", v AS version, '{WHERE.replace("'", "''")}' AS predicate, a AS total_files, c AS final_files, {_share("a", "c")} AS total_pruning_pct, a AS files_with_stats, 100.0::DOUBLE AS pct,
'Conservative' AS confidence, 'o_orderstatus = ''F''' AS partition_safe, 'o_orderkey > 5000' AS stats_safe, 0::INT AS notes, c AS last_phase FROM c""",
    "newest_first": f"{_FILES} SELECT (row_number() OVER (ORDER BY version DESC, ascii(o_orderstatus), key) - 1)::INT AS place, path FROM f",
    "stats_display": f"""{_FILES} SELECT path, CASE WHEN n * 100 < 1024 THEN (n * 100) || ' B' ELSE printf('%.1f KB', n * 100 / 1024.0::DOUBLE) END AS size,
'  stats(o_custkey: ' || c_lo || '..' || c_hi || ', o_orderkey: ' || lo || '..' || hi || ')' AS shown, '{{"max": "' || c_hi || '", "min": "' || c_lo || '", "null_count": 0}}' AS custkey FROM f""",
    "version_compare": f"{_FILES} SELECT path || ': absent -> ' || CASE WHEN o_orderstatus = 'F' AND hi > 5000 THEN 'kept' ELSE 'dropped' END AS line FROM f WHERE version > 2",
    "cli_runs": """SELECT * FROM (VALUES ('plain', 0::INT, 'Delta', ''), ('pruned', 0, 'Delta', ''), ('json wins over -v', 0, '{', ''), ('unknown format', 0, 'Delta', ''), ('enough', 0, 'Delta', ''),
('too little', 1, 'Delta', 'ASSERTION'), ('no predicate', 1, 'Delta', 'ASSERTION'), ('stats', 0, 'Delta', ''), ('both fail after the report', 1, 'Delta', 'ASSERTION'),
('unknown column', 1, '', 'Error:'), ('case counts', 1, '', 'Error:'), ('function', 1, '', 'Error:'), ('subquery', 1, '', 'Error:'), ('like', 1, '', 'Error:'), ('arithmetic', 1, '', 'Error:'),
('not a number', 1, '', 'Error:'), ('bare column', 1, '', 'Error:'), ('empty', 1, '', 'Error:'), ('open', 1, '', 'Error:'), ('bad option', 1, '', 'Error:')) AS t(name, code, out, err)""",
    "written_table": "SELECT n_regionkey, count(*)::BIGINT AS told, count(*)::BIGINT AS found, min(n_nationkey) AS lo, true AS sized FROM nation WHERE n_regionkey <> 4 GROUP BY n_regionkey",
    "storage_settings": """SELECT * FROM (VALUES (0::INT, 's3a://b/t', '{"fs.s3a.endpoint": "http://h:1", "fs.s3a.endpoint.region": "eu"}'),
(1, 's3a://b/t', '{"fs.s3a.aws.credentials.provider": "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"}'),
(2, 'abfss://c@acc.dfs.core.windows.net/t', '{"fs.azure.account.key.acc.dfs.core.windows.net": "k=1"}'),
(3, 'abfss://c@acc.dfs.core.windows.net/t', '{"fs.azure.account.auth.type": "OAuth", "fs.azure.account.oauth.provider.type": "org.apache.hadoop.fs.azurebfs.oauth2.MsiTokenProvider"}'),
(4, 'gs://b/t', '{"fs.gs.auth.type": "UNAUTHENTICATED"}'), (5, 'gs://b/t', '{"fs.gs.auth.service.account.json.keyfile": "/x.json"}'), (6, 'hdfs:///t', '{"fs.x": "1"}')) AS t(id, path, settings)""",
    **{name: _case_sql(c[-1]) for name, c in CASES.items()},
}
