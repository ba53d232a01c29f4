"""The pruning engine against log fixtures written here, and its soundness on real rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from skiplens.cli import main
from skiplens.functions.text import format_size, size_text, stat_text
from skiplens.operators.filestats import add_lines, compute_stats
from skiplens.operators.pruning import prune
from skiplens.operators.replay import live_files
from skiplens.plans.report import report
from skiplens.predicate import PredicateError, analyze, parse, to_sql
from skiplens.sources.log import parse_lines, read_log
from skiplens.sources.storage import TableError, hadoop_options, storage_options, table_path
from skiplens.streaming.tail import stream_log

FIELDS = [("name", "string"), ("age", "integer"), ("country", "string"), ("score", "double")]
#: Fixed values of the fixtures: country, size, rows, ages, scores, names.
PARTITIONED = [
    ("DE", 1147, 5, (20, 35), (75.3, 92.0), ("Fritz", "Liesel")), ("DE", 1133, 4, (40, 60), (65.5, 88.9), ("Dieter", "Wolfgang")),
    ("US", 1121, 4, (18, 29), (78.2, 95.0), ("Alice", "Diana")), ("US", 1093, 3, (31, 55), (71.5, 93.4), ("Eve", "Grace")),
    ("IT", 1159, 5, (22, 38), (76.8, 91.5), ("Alessandro", "Sofia")), ("IT", 1112, 3, (41, 65), (68.0, 80.1), ("Giovanni", "Roberto")),
]
FLAT = [
    (4, (18, 29), ("AL", "US"), (72.1, 91.0)), (5, (20, 35), ("AT", "US"), (68.5, 93.2)), (4, (30, 55), ("DE", "US"), (65.5, 88.9)),
    (3, (22, 50), ("AT", "IT"), (76.8, 95.0)), (5, (40, 65), ("CH", "US"), (71.5, 92.0)), (3, (25, 45), ("AT", "DE"), (75.3, 80.1)),
]


def _meta(parts, fields=FIELDS):
    schema = {"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in fields]}
    return {"metaData": {"id": "x", "schemaString": json.dumps(schema), "partitionColumns": parts}}


def _add(path, size, rows, bounds, parts, **more):
    stats = {"numRecords": rows, "minValues": {k: v[0] for k, v in bounds.items()}, "maxValues": {k: v[1] for k, v in bounds.items()}, "nullCount": dict.fromkeys(bounds, 0)}
    return {"add": {"path": path, "size": size, "partitionValues": parts, "dataChange": True, "stats": json.dumps(stats), **more}}


def _write(root, commits):
    log = root / "_delta_log"
    log.mkdir(parents=True)
    for v, actions in enumerate(commits):
        (log / f"{v:020d}.json").write_text("\n".join(a if isinstance(a, str) else json.dumps(a) for a in actions) + "\n")
    return str(root)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    p = [[_add(f"country={c}/part-{v}.parquet", size, n, {"age": age, "score": score, "name": name}, {"country": c})] for v, (c, size, n, age, score, name) in enumerate(PARTITIONED)]
    p[0].insert(0, _meta(["country"]))
    f = [_meta([]), *(_add(f"part-{k}.parquet", 1147, n, {"age": a, "country": c, "score": s}, {}) for k, (n, a, c, s) in enumerate(FLAT, 1))]
    e = [[_meta(["region"], [("id", "integer"), ("region", "string"), ("value", "double")])]]
    return {"P": _write(root / "p", p), "F": _write(root / "f", [f]), "E": _write(root / "e", e)}


@pytest.mark.parametrize(("table", "predicate", "kept"), [
    ("P", "country = 'DE'", [2]), ("P", "age > 30", [5]), ("P", "age > 60", [1]), ("P", "age > 40 AND country = 'DE'", [2, 1]), ("P", "age > 0", [6]),
    ("P", "country = 'DE' OR country = 'US'", [4]), ("P", "country IN ('DE','IT')", [4]), ("P", "NOT country = 'DE'", [4]), ("P", "country NOT IN ('US')", [4]),
    ("P", "age IS NOT NULL", [6]), ("P", "age > 1000", [0]), ("P", "age > -10", [6]), ("P", "country = 'New Zealand'", [0]), ("P", "age NOT BETWEEN 100 AND 200", [6]),
    ("P", "((((age > 40)))) AND (country = 'DE')", [2, 1]), ("P", "country = 'US' AND age > 30", [2, 1]), ("P", "age BETWEEN 40 AND 60", [3]), ("P", "score > 90.5", [4]),
    ("P", "(country = 'DE' OR country = 'IT') AND age > 40", [4, 2]), ("P", "country BETWEEN 'A' AND 'F'", [2]), ("P", "country IS NULL", [0]), ("P", "country = 'DE' OR age > 50", [6]),
    ("F", "country = 'DE' AND age > 40", [4]), ("E", "region = 'EU'", [0]), ("P", None, []),
])
def test_survivors(spark, tables, table, predicate, kept):
    assert report(spark, tables[table], predicate=predicate).kept == kept


def test_mixed_or_joint(spark, tables):
    assert report(spark, tables["P"], predicate="country = 'DE' OR age > 50", mixed_or="joint").kept == [4]


@pytest.mark.parametrize("bad", ["nope = 1", "UPPER(country) = 'DE'", "country =", "", "country = (SELECT 1)", "country LIKE 'D%'", "age >>> 3", "age + 1 > 3", "age", "TRUE", "age IN ()", "age = 1 x"])
def test_rejected(spark, tables, bad, capsys):
    assert main([tables["P"], "-w", bad], spark) == 1
    out = capsys.readouterr()
    assert out.out == "" and out.err.startswith("Error: ")


def test_text_and_json(spark, tables, capsys):
    assert main([tables["P"], "-w", "age > 40 AND country = 'DE'", "-v"], spark) == 0
    text = capsys.readouterr().out
    assert "Files in snapshot: 6" in text and "files remaining: 2  (-4, 67% pruned)" in text and "Total reduction: 6 -> 1 files (83% pruned)" in text
    assert "  [KEPT   ] part-1.parquet  (1.1 KB  4 records)  partition(country=DE)  stats(age: 40..60, name: Dieter..Wolfgang, score: 65.5..88.9)" in text
    assert text.count("[DROPPED]") == 5  # four in the first phase, one of two in the second
    assert main([tables["P"], "-w", "age > 40 AND country = 'DE'", "--format", "json"], spark) == 0
    doc = json.loads(capsys.readouterr().out)
    assert (doc["version"], doc["total_files"], doc["final_files"], doc["stats_coverage"]["pct"]) == (5, 6, 1, 100.0)
    assert [len(p["files"]) for p in doc["phases"]] == [6, 2]
    assert doc["analysis"]["confidence"] == "Conservative"


def test_assertions(spark, tables, capsys):
    where = ["-w", "age > 40 AND country = 'DE'"]
    assert main([tables["P"], *where, "--min-pruning", "83", "--assert-stats"], spark) == 0
    assert main([tables["P"], *where, "--min-pruning", "84"], spark) == 1
    assert main([tables["F"], "-w", "country = 'DE' AND age > 40", "--min-pruning", "90"], spark) == 1
    assert "33.3%" in capsys.readouterr().err
    assert main([tables["P"], "--min-pruning", "1"], spark) == 1
    assert main(["/no/such/table"], spark) == 1


def test_gaps(spark, tmp_path, capsys):
    add = lambda p, **m: {"add": {"path": p, "size": 1, "partitionValues": {"k": m.pop("k", None)}, **m}}
    fields = [("k", "long"), ("v", "long"), ("b", "boolean")]
    nested = json.dumps({"numRecords": 1, "minValues": {"v": 5}, "maxValues": {"v": 5}, "nullCount": {"v": 0}})
    path = _write(tmp_path / "t", [
        [_meta(["v"], fields), _meta(["k"], fields), add("none", k="1"), "no json", add("bad", k="x", stats="{"), add("null", stats=nested), add("gone", k="2"), add("back", k="3")],
        [{"remove": {"path": "gone"}}, {"remove": {"path": "back"}}], [add("back", k="4", stats=nested)],
    ])
    r = report(spark, path, predicate="k > 0")
    rows = {x["path"]: x["kept_1"] for x in r.pruning.files.collect()}
    assert rows == {"none": True, "bad": True, "null": False, "back": True}  # what can't be cast is kept, null matches nothing
    assert report(spark, path, predicate="v = 6").kept == [2]
    assert report(spark, path, predicate="v = NULL").kept == [4] and report(spark, path, predicate="k = NULL").kept == [0]
    assert report(spark, path, predicate="b AND NOT b").kept == [4]
    assert report(spark, path, version=0).total_files == 5
    assert main([path, "--assert-stats"], spark) == 1
    assert "2 file(s) missing statistics" in capsys.readouterr().err
    assert main([path, "--assert-stats", "--stats-mode", "log_entry"], spark) == 0


@pytest.mark.parametrize("block", ["128m", "4k"])
def test_line_order(spark, tmp_path, block):
    """Files are listed by commit and line, and the last line on a file counts, also where a commit is read in blocks."""
    add = lambda p: {"add": {"path": p, "size": 1, "partitionValues": {}}}
    gone = lambda p: {"remove": {"path": p}}
    names = [[f"{v}-{k * 7919 % 2003}" for k in range(2003)] for v in range(3)]
    commits = [[_meta(["name"]), _meta([]), *map(add, n)] for n in names]
    commits[1] = [gone("back"), *commits[1], *map(gone, names[0][:900]), add("back"), add("gone"), "", gone("gone")]
    path = _write(tmp_path / "t", commits)
    log = tmp_path / "t" / "_delta_log" / f"{2:020d}.json"
    log.write_bytes(log.read_bytes().replace(b"\n", b"\r\n"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        r = report(spark, path)
        assert [x["path"] for x in r.ordered_files().collect()] == names[2] + names[1] + ["back"] + names[0][900:]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("parts", [1, 2])
def test_checkpoint(spark, tmp_path, capsys, parts):
    """A table whose early commits were cleaned up after a checkpoint."""
    add = lambda k: _add(f"f{k}", 10, 1, {"age": (k, k)}, {"country": "DE" if k else None})
    path = _write(tmp_path / "t", [[_meta(["country"]), add(0)], [add(1)], [{"remove": {"path": "f1"}}, add(2)], [add(3), {"remove": {"path": "f0"}}], [add(4)]])
    log = tmp_path / "t" / "_delta_log"
    want = {v: {r["path"] for r in report(spark, path, version=v).pruning.files.collect()} for v in (2, 3, 4)}
    live = read_log(spark, path, 2).where("coalesce(add.path, '') <> 'f1'").select("add", "remove", "metaData")
    live.repartition(parts).write.parquet(str(tmp_path / "c"))
    files = sorted((tmp_path / "c").glob("part-*.parquet"))
    assert len(files) == parts
    for k, f in enumerate(files, 1):
        f.rename(log / (f"{2:020d}.checkpoint.parquet" if parts == 1 else f"{2:020d}.checkpoint.{k:010d}.{parts:010d}.parquet"))
    for v in range(3):
        (log / f"{v:020d}.json").unlink()
    for v, paths in want.items():
        r = report(spark, path, predicate="country = 'DE' AND age > 2", version=v)
        assert r.version == v and {x["path"] for x in r.pruning.files.collect()} == paths and r.files_with_stats == len(paths)
    assert want[4] == {"f2", "f3", "f4"} and report(spark, path, predicate="age > 2").kept == [2]
    assert main([path], spark) == 0 and "Files in snapshot: 3" in capsys.readouterr().out
    (log / f"{3:020d}.json").unlink()
    assert main([path], spark) == 1 and "lacks the commit of version 3" in capsys.readouterr().err


def test_compare(spark, tables, capsys):
    assert main([tables["P"], "-w", "age > 30", "--compare-to", "4"], spark) == 0
    assert capsys.readouterr().out.rstrip().endswith("country=IT/part-5.parquet: absent -> kept")


def test_physical_names(spark, tmp_path):
    """Values under mapped names are found; a key that the log lacks drops nothing."""
    fields = [{"name": n, "type": "long", "nullable": True, "metadata": {"delta.columnMapping.physicalName": f"col-{n}"}} for n in ("k", "v")]
    meta = {"metaData": {"id": "x", "schemaString": json.dumps({"type": "struct", "fields": fields}), "partitionColumns": ["k"]}}
    path = _write(tmp_path / "t", [[meta, _add("a", 1, 1, {"col-v": (5, 5)}, {"col-k": "1"}), _add("b", 1, 1, {"col-v": (9, 9)}, {"col-k": "2"}), _add("c", 1, 1, {"col-v": (9, 9)}, {})]])
    assert report(spark, path, predicate="k = 1").kept == [2] and report(spark, path, predicate="k = 2 AND v > 6").kept == [2, 2] and report(spark, path, predicate="v < 6").kept == [1]


def test_stream(spark, tables, tmp_path):
    q = stream_log(spark, tables["P"]).writeStream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("tail").where("add IS NOT NULL").count() == 6


def test_analysis():
    a = analyze(parse("country = 'IT' AND (country = 'DE' OR price > 50) AND price < 100"), ["country"])
    assert (a.partition_safe, a.stats_safe, a.confidence, len(a.notes)) == ("country = 'IT'", "price < 100", "Incomplete", 1)
    assert analyze(parse("country = 'IT'"), ["country"]).confidence == "Exact"
    assert to_sql(parse("a != 1 and not b in (1,2)")) == "a <> 1 AND NOT b IN (1, 2)"
    with pytest.raises(PredicateError):
        parse("((")


def test_small_functions():
    assert [format_size(n) for n in (0, 1023, 1024, 1536, 5 << 20, 3 << 30)] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 MB", "3.0 GB"]
    assert [stat_text(x) for x in ("92.0", "1e21", "7", "abc", "true", None)] == ["92", "1" + "0" * 21, "7", "abc", "true", None]
    assert storage_options("eu", True, True, ["A=b=c", "a=d"]) == {"region": "eu", "skip_signature": "true", "allow_env": "true", "a": "d"}
    with pytest.raises(TableError):
        storage_options(options=["x"])
    assert table_path("s3://bucket/t/") == "s3a://bucket/t" and table_path("hdfs:///x/") == "hdfs:///x"
    assert hadoop_options({"region": "eu", "skip_signature": "true"}, "gs://b/t") == {"fs.gs.auth.type": "UNAUTHENTICATED"}
    assert hadoop_options({"account_name": "a", "account_key": "k"}, "az://c/t") == {"fs.azure.account.key.a.dfs.core.windows.net": "k"}


def test_size_text(spark):
    """The Column rounds as format_size() does: to even where a size lies between two tenths."""
    fixed = {6400: "6.2 KB", 19200: "18.8 KB", 134400: "131.2 KB", 13 << 18: "3.2 MB", 15 << 18: "3.8 MB", 13 << 28: "3.2 GB", (1 << 20) - 1: "1024.0 KB", 1023: "1023 B"}
    rng = random.Random(5)
    sizes = [*fixed, 0, 1, *range(0, 1 << 20, 1280), *(rng.randrange(1 << rng.randint(1, 50)) for _ in range(3000)), *(m << (4 + 10 * k) for k in (1, 2) for m in range(64, 4000, 4))]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", size_text(F.col("n")).alias("t")).collect()
    assert [r["t"] for r in rows] == [format_size(n) for n in sizes]
    assert [r["t"] for r in rows[: len(fixed)]] == list(fixed.values())


def _random(rng, depth=0):
    if depth < 3 and rng.random() < 0.6:
        kind = rng.choice(("AND", "OR", "NOT"))
        return f"NOT ({_random(rng, depth + 1)})" if kind == "NOT" else f"({_random(rng, depth + 1)}) {kind} ({_random(rng, depth + 1)})"
    c = rng.choice(("p", "x", "y"))
    v = rng.randint(-2, 8)
    return rng.choice((f"{c} {rng.choice(('=', '<>', '<', '<=', '>', '>='))} {v}", f"{c} IS NULL", f"{c} IS NOT NULL", f"{c} IN ({v}, {v + 2})", f"{c} NOT BETWEEN {v} AND {v + 2}", "x < y"))


def test_soundness(spark):
    """No file with a matching row is dropped, in either mode, and joint keeps a subset."""
    rng = random.Random(3)
    rows = [(f"f{k}", None if k == 11 else k % 4, rng.choice((None, k, k + rng.randint(0, 2))), rng.choice((None, rng.randint(0, 8)))) for k in range(12) for _ in range(4)]
    df = spark.createDataFrame(rows, "f string, p long, x long, y long").cache()
    stats = compute_stats(df, ["f", "p"], ["x", "y"])
    lines = add_lines(stats, ["x", "y"], F.col("f"), F.lit(0), {"p": F.col("p").cast("string")}, F.col("f") != "f3")
    files = live_files(parse_lines(lines)).cache()
    for _ in range(12):
        text = _random(rng)
        need = {r["f"] for r in df.where(text).select("f").distinct().collect()}
        kept = []
        for mode in ("separate", "joint"):
            p = prune(files, text, df.select("p", "x", "y").schema, ["p"], mode)
            kept.append({r["path"] for r in p.files.where(p.phases[-1].flag).collect()})
        assert need <= kept[1] <= kept[0], text


def test_queries_have_sql():
    from skiplens.plans import queries

    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)
