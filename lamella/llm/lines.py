"""Line dedup (4): lines that recur across documents go, except in the document with the largest id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WS, ascii_lower, checkpoint, read


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WS)))


def _hashed(key: Column) -> Column:
    """128 bits: two independently seeded hashes."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """All columns of ``docs`` with the text's kept lines, plus ``n_lines`` and ``n_dropped``.

    A line's key is the line stripped of white space and lower-cased (A-Z). Keys of ``min_chars`` code points or
    more that ``min_docs`` documents hold lose all their lines but those of the largest id. A null or empty text is
    one empty line. Documents are told apart by id: rows that share one count once, and all rows of the largest id keep
    the line; a null id is a document below every other. Other columns stay, whatever their names, but for ``n_lines`` and
    ``n_dropped``, which are replaced. An empty table gives an empty table.

    Plan: distinct line hashes leave each row once, counts combine map-side per hash, and hashes that enough rows hold join
    back to (id, hash) rows (an equi-join that AQE splits where a line is hot). Only these are told apart by id; texts move
    once, by id.
    """
    lines = F.split(F.coalesce(F.col("_text"), F.lit("")), "\n")
    rest = [c for c in docs.columns if c not in (id_col, text_col, "n_lines", "n_dropped")]
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(0).alias("_end")).alias("_rest")
    )
    long_keys = F.filter(F.transform(lines, _key), lambda k: F.char_length(k) >= min_chars)
    held = rows.select(
        "_id", F.explode(F.array_distinct(F.transform(long_keys, _hashed))).alias("h")
    ).select("_id", "h.h1", "h.h2")
    often = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2")
    shared = checkpoint(held.join(often, ["h1", "h2"]))
    one = shared.groupBy("h1", "h2", "_id").agg(F.lit(1).alias("one"))
    frequent = one.groupBy("h1", "h2").agg(F.count("one").alias("n"), F.max("_id").alias("keep")).filter(F.col("n") >= min_docs)
    drops = (
        shared.join(frequent.select("h1", "h2", "keep"), ["h1", "h2"])
        .filter(~F.col("_id").eqNullSafe(F.col("keep")))
        .groupBy("_id")
        .agg(F.collect_set(F.struct("h1", "h2")).alias("_drop"))
        .withColumnRenamed("_id", "_drop_id")
    )
    gone = lambda l: (F.char_length(_key(l)) >= min_chars) & F.array_contains(F.col("_drop"), _hashed(_key(l)))
    kept = F.when(F.col("_drop").isNull(), lines).otherwise(F.filter(lines, lambda l: ~gone(l)))
    return (
        rows.join(drops, F.col("_id").eqNullSafe(F.col("_drop_id")), "left")
        .withColumn("_kept", kept)
        .select(
            *[
                F.col("_id").alias(c) if c == id_col else F.array_join("_kept", "\n").alias(c) if c == text_col else F.col("_rest").getField(c).alias(c)
                for c in docs.columns
                if c not in ("n_lines", "n_dropped")
            ],
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size("_kept")).cast("long").alias("n_dropped"),
        )
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (
  SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (
  SELECT k.doc_id, k.line, k.pos, f.key IS NOT NULL AND k.doc_id <> f.keep AS gone
  FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLE = {"op4_line_dedup": OP4_SQL}
