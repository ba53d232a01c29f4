"""Line dedup, in DataFrame functions throughout.

Long enough lines are exploded with their positions as 128-bit hashes of their
normalised form (never as text), distinct documents are counted per hash, and
the positions of lines over the threshold go back to their rows.  A row is put
together again from the slices between its dropped positions, in time linear
in its lines; the text moves at most once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, few

#: The characters stripped from both ends of a line: blank and \t \n \v \f \r.
STRIPPED = "\x20\x09\x0a\x0b\x0c\x0d"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(STRIPPED))


def line_key(line: Column) -> Column:
    """The normalised form by which lines are compared.

    `translate` looks every character up; a line of one byte a character has no
    capitals but A-Z, and `lower` does the same to it at once.
    """
    bare = _bare(line)
    return F.when(F.octet_length(line) == F.length(line), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _hash(key: Column) -> Column:
    return F.unhex(F.md5(key.cast("binary")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, carry: bool = False) -> DataFrame:
    """Drops lines whose key has `min_chars` code points or more and stands in `min_docs` documents or more.

    The document with the largest id that holds such a line keeps all its copies
    of it.  Returns one row per input row: ``doc_id, text, n_lines, n_dropped``,
    and with `carry` the whole input row but its text as the struct ``row``;
    other input columns are ignored, so their names can't clash.

    * null text: one empty line, kept; the text returned is null.  Empty text: the same, and ''.
    * a text all of whose lines go becomes ''.
    * very long texts, also of one line repeated: time and memory grow with the number of lines.
    * null ids: such rows are neither counted nor changed.
    * rows that repeat an id count as one document and lose the same lines; of equal rows
      each is returned.  They are told apart by a 64-bit hash and the length of the text.
    * empty table: empty result.
    """
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")] if carry else []
    name = F.struct(F.length("text").alias("n"), F.xxhash64("text").alias("x"))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *rest)
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    # two steps: a text must not go through the explosion with each of its lines; an inner explosion would
    # split each text once more, for a filter of its own, and a hash that can be null be made once more, for another
    held = d.where("doc_id IS NOT NULL").select("doc_id", name.alias("name"), lines.alias("lines"))
    held = held.select("doc_id", "name", F.posexplode_outer("lines").alias("pos", "line")).where(F.length("line") >= min_chars)
    held = held.where(F.length(_bare(F.col("line"))) >= min_chars).select("doc_id", "name", "pos", F.coalesce(_hash(line_key(F.col("line"))), F.lit(b"")).alias("h"))
    often = held.groupBy("h").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    # written, so that the join has no aggregation below it and a line in very many documents can be split over tasks
    often = few(checkpoint(often.select("h", "keeper")))
    drops = held.join(often, "h").where(F.col("doc_id") != F.col("keeper"))
    # equal rows of one id send equal positions; a set holds no more of them than the text has lines
    drops = drops.groupBy("doc_id", "name").agg(F.array_sort(F.collect_set("pos")).alias("drops"))
    told = d.withColumn("name", name).join(drops, ["doc_id", "name"], "left").select("doc_id", "text", lines.alias("lines"), "drops", *["row"] * carry)
    n = F.size("lines")
    cuts = F.arrays_zip(F.concat(F.array(F.lit(-1)), "drops").alias("a"), F.concat("drops", F.array(n)).alias("b"))
    between = F.flatten(F.transform(cuts, lambda c: F.slice("lines", c["a"] + 2, c["b"] - c["a"] - 1)))
    text = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(between, "\n"))
    return told.select("doc_id", text.alias("text"), n.cast("long").alias("n_lines"), F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"), *["row"] * carry)


def digest(result: DataFrame) -> DataFrame:
    """The thin view of the query: sizes and the hash of what is kept."""
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, (o.key IS NOT NULL AND k.doc_id <> o.keeper) AS lost FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE lost))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
