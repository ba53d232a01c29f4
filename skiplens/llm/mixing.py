"""Mixing sources to target weights with hash-threshold histograms.

Each document has a fixed 60-bit hash.  A source whose target is r times its
size takes every document floor(r) times and once more those below a hash
threshold; r <= 1 and r <= 2 are the two nested budgets.  The threshold is
found by summing words per (source, hash bucket), taking whole buckets up to
the budget and refining only the bucket in which it is crossed.  Documents are
then filtered by their hash: nothing is sorted, and only (id, source, size,
hash) rows and histograms of a fixed width per source ever move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, few

#: Bits of the hash that one round of the histogram looks at, and the rounds.
BITS, ROUNDS = 12, 5
WORD = r"[^\x20\x09-\x0D]+"


def text_size(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Water filling in closed form: by rising cap / weight, a source is full if
    giving every later one its share of what is left would overfill it.
    The windows run over one row per source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").cast("binary").asc_nulls_last())
    s = s.withColumn("rank", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy(F.lit(0))
    fill = everything.orderBy((F.col("cap") / F.col("weight")).asc(), "rank")
    s = s.withColumns({
        "budget": F.sum("source_size").over(everything) * F.lit(float(share)),
        "before": F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "rest": F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    level = (F.col("budget") - F.col("before")) / F.col("rest")
    s = s.withColumn("open_level", F.when(level * F.col("weight") < F.col("cap"), level))
    # the first source that isn't full fixes the level for all later ones
    s = s.withColumn("level", F.first("open_level", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return s.select("source", "source_size", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(b_source, threshold): documents whose `hash` is below it hold about `extra` words.

    Each round sums words by the next `BITS` bits of the hash, only within the
    bucket that the round before left open, so five rounds of 4,096 buckets
    settle 60 bits.  What remains open is one hash value, taken or left whole,
    whichever is nearer to the budget.  A source without words has no row.
    """
    left = budgets.select(F.col("source").alias("b_source"), F.lit(0).cast("long").alias("base"), F.col("extra").cast("double").alias("left"))
    for r in range(ROUNDS):
        shift = 60 - BITS * (r + 1)
        inside = rows.join(few(left), _same("source", "b_source")).where(F.shiftright("hash", shift + BITS) == F.shiftright("base", shift + BITS))
        bucket = F.shiftright("hash", shift).bitwiseAND((1 << BITS) - 1)
        hist = inside.groupBy("b_source", "base", "left", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("b_source").orderBy("bucket")
        hist = hist.withColumn("total", F.sum("words").over(upto))
        crossing = F.min(F.when(F.col("total") > F.col("left"), F.struct("bucket", "words", "total")))
        found = hist.groupBy("b_source", "base", "left").agg(crossing.alias("x")).where("x IS NOT NULL")
        left = checkpoint(found.select(
            "b_source",
            (F.col("base") + F.col("x.bucket") * F.lit(1 << shift)).alias("base"),
            (F.col("left") - (F.col("x.total") - F.col("x.words"))).alias("left"),
            F.col("x.words").alias("open"),
        ))
    take = F.col("left") * 2 >= F.col("open")
    return left.select("b_source", (F.col("base") + take.cast("long")).alias("threshold"))


def row_hash(id_col: str, text_col: str) -> Column:
    """60 bits from the id and, so that different rows that repeat an id differ, the length of the text."""
    name = F.concat_ws(":", F.col(id_col).cast("string"), F.length(text_col).cast("string"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, cap: float) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, size, hash) of each row, (p_source, source_size, target, whole, threshold) of each source)."""
    rows = checkpoint(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), text_size(F.col(text_col)).alias("size"), row_hash(id_col, text_col).alias("hash")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # a hair below a whole number counts as that number
    targets = source_targets(rows, weights, share, cap).withColumn("whole", F.floor(ratio + 1e-12))
    targets = checkpoint(targets.withColumn("extra", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))))
    cuts = thresholds(rows, targets)
    plan = targets.join(cuts, _same("source", "b_source"), "left").select(F.col("source").alias("p_source"), "source_size", "target", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold"))
    return rows, checkpoint(plan)


def _copies(h: Column) -> Column:
    return (F.col("whole") + (h < F.col("threshold")).cast("long")).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """How often the mix takes each document: ``doc_id, source, size, source_size, target, copies, taken``.

    One row per input row, whatever its other columns.

    * null text has size 0; a document of size 0 is counted as taken by its hash and adds no words.
    * null source is a source of its own, last in the order; a null id has a hash like any other.
    * rows with equal id and length share a hash and are taken or left together.
    * a source of size 0 has target 0 and takes nothing; empty table: empty result.
    """
    rows, plan = _planned(docs, id_col, text_col, source_col, weights, share, cap)
    out = rows.join(few(plan), _same("source", "p_source")).withColumn("copies", _copies(F.col("hash")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: the rows of `docs`, with all their columns, as often as mix_sources() takes them."""
    _, plan = _planned(docs, id_col, text_col, source_col, weights, share, cap)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).alias("source"), row_hash(id_col, text_col).alias("hash"))
    out = row.join(few(plan), _same("source", "p_source")).withColumn("copies", _copies(F.col("hash"))).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, length(text)::VARCHAR)), 1, 15))::BIGINT AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(rank % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM r),
f AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
o AS (SELECT *, CASE WHEN (budget - before) / rest * weight < cap THEN (budget - before) / rest END AS open_level FROM f),
v AS (SELECT *, first_value(open_level IGNORE NULLS) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM o),
t AS (SELECT source, source_size, coalesce(level * weight, cap) AS target FROM v),
e AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-12::DOUBLE)::BIGINT AS whole FROM t),
b AS (SELECT *, greatest(target - whole * source_size, 0) AS extra FROM e),
h AS (SELECT d.source, d.hash, b.extra, sum(d.size) AS words FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source GROUP BY ALL),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY hash) AS total FROM h),
x AS (SELECT source, min(CASE WHEN total > extra THEN {'hash': hash, 'miss': extra - (total - words), 'words': words} END) AS x FROM c GROUP BY source),
p AS (SELECT source, x.hash + CASE WHEN x.miss * 2 >= x.words THEN 1 ELSE 0 END AS threshold FROM x)
SELECT d.doc_id, d.size, b.source_size, b.target,
  ((b.whole + CASE WHEN d.hash < coalesce(p.threshold, 0) THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source
"""
