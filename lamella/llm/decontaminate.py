"""Benchmark decontamination (10), native: a prefix-filtered containment join of 8-word windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, checkpoint, read, small

#: ASCII that separates words: everything but digits and letters
_DELIMITERS = "".join(map(chr, [*range(0x01, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: prefix tokens that may be broadcast; larger benchmarks join by shuffle
BROADCAST_ROWS = 100_000


def benchmark_words(text: Column) -> Column:
    """Lower-cased words: runs of digits, letters and anything outside ASCII. Null has none."""
    clean = F.translate(F.coalesce(text, F.lit("")), _DELIMITERS + UPPER, " " * len(_DELIMITERS) + LOWER)
    return F.array_remove(F.split(F.replace(clean, F.lit("\x00"), F.lit(" ")), " "), "")


def item_windows(items: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """(item, win): distinct windows of ``width`` words; a shorter item, if it has words, is one window."""
    w = items.select(F.col(item_col).alias("item"), benchmark_words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return w.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, width))).alias("win")).distinct()


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 8,
    min_items: int = 2,
) -> DataFrame:
    """(id, n_words, n_hit, items, contaminated) for every distinct id of ``docs``.

    A document word is hit if it lies in an occurrence of any item's window; ``items`` holds the sorted ids (as
    strings) of the items with occurring windows; ``contaminated`` is ``size(items) >= min_items``. Null and empty
    texts have no words. Rows that share an id add up, each with its own words and hits. An empty ``items`` hits
    nothing. Items with a null id are left out. Other columns play no part.

    A window occurs only where its rarest word does, so each window's prefix is that one word, rarity being counted
    over all documents. Where the prefixes are few enough to broadcast, document words meet them while the text is being
    exploded, and positional bounds and the comparison of the whole window follow in the same pass. Beyond that, words
    travel without their texts as (text, position, word), and the places that pass the bounds go back to the texts once.
    Either way only verified occurrences are counted.
    """
    words = docs.select(
        F.col(id_col).alias("_id"), benchmark_words(F.col(text_col)).alias("w"), F.xxhash64(text_col).alias("_text")
    )
    windows = item_windows(items.filter(F.col(item_col).isNotNull()), item_col, item_text_col, width)
    windows = windows.groupBy("win").agg(F.collect_set(F.col("item").cast("string")).alias("win_items"))
    vocabulary = small(windows.select(F.explode("win").alias("t")).distinct(), BROADCAST_ROWS)
    counts = (
        words.select(F.explode("w").alias("t")).join(vocabulary, "t").groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    )
    rarest = F.min(F.struct(F.coalesce("c", F.lit(0)), "t", "o"))
    prefixes = (
        windows.select("win", "win_items", F.posexplode("win").alias("o", "t"))
        .join(counts, "t", "left")
        .groupBy("win")
        .agg(rarest.alias("r"), F.first("win_items").alias("win_items"))
        .select("win", "win_items", F.col("r.t").alias("t"), F.col("r.o").alias("o"), F.size("win").alias("len"))
    )
    prefixes = checkpoint(prefixes)
    at = F.col("p") - F.col("o")
    inside = (at >= 0) & (at + F.col("len") <= F.col("n"))
    same = F.slice("w", F.col("s") + 1, F.col("len")) == F.col("win")
    if prefixes.count() <= BROADCAST_ROWS:
        found = (
            words.select("_id", "_text", "w", F.size("w").alias("n"), F.posexplode("w").alias("p", "t"))
            .join(F.broadcast(prefixes), "t")
            .filter(inside)
            .withColumn("s", at)
            .filter(same)
            .select("_id", "_text", "s", "len", "win_items")
        )
    else:
        numbered = prefixes.withColumn("k", F.xxhash64("win"))
        places = (
            words.select("_id", "_text", F.size("w").alias("n"), F.posexplode("w").alias("p", "t"))
            .join(numbered.select("t", "o", "len", "k"), "t")
            .filter(inside)
            .groupBy("_id", "_text")
            .agg(F.collect_set(F.struct(at.alias("s"), "k")).alias("at"))
            .select(F.col("_id").alias("i"), F.col("_text").alias("x"), "at")
        )
        found = (
            words.join(places, F.col("_id").eqNullSafe(F.col("i")) & F.col("_text").eqNullSafe(F.col("x")))
            .select("_id", "_text", "w", F.explode("at").alias("a"))
            .select("_id", "_text", "a.s", "a.k", F.slice("w", F.col("a.s") + 1, width).alias("w"))
            .join(numbered.select("k", "win", "len", "win_items"), "k")
            .filter(F.slice("w", F.lit(1), F.col("len")) == F.col("win"))
            .select("_id", "_text", "s", "len", "win_items")
        )
    hits = (
        found.groupBy("_id", "_text")
        .agg(
            F.collect_set(F.sequence(F.col("s"), F.col("s") + F.col("len") - 1)).alias("spans"),
            F.collect_set("win_items").alias("its"),
        )
        .select("_id", "_text", F.size(F.array_distinct(F.flatten("spans"))).cast("long").alias("hit"), F.array_distinct(F.flatten("its")).alias("its"))
    )
    none = F.array().cast("array<string>")
    sizes = words.select("_id", "_text", F.size("w").cast("long").alias("n"), F.lit(1).cast("long").alias("rows"), F.lit(0).cast("long").alias("hit"), none.alias("its"))
    zero = F.lit(0).cast("long")
    texts = sizes.unionByName(hits.withColumns({"n": zero, "rows": zero})).repartition("_id")
    texts = texts.groupBy("_id", "_text").agg(F.sum("n").alias("n"), (F.sum("rows") * F.max("hit")).alias("hit"), F.max("its").alias("its"))
    return (
        texts.groupBy("_id")
        .agg(
            F.sum("n").alias("n_words"),
            F.sum("hit").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("its")))).alias("items"),
        )
        .select(F.col("_id").alias(id_col), "n_words", "n_hit", "items", (F.size("items") >= min_items).alias("contaminated"))
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with their columns.

    Each row is judged by its own text, whatever its id: null and repeated ids do not make several rows one document, and
    equal texts have one fate. Null and empty texts stay. Columns may have any names.
    """
    key = F.md5(F.col(text_col))
    texts = docs.filter(F.col(text_col) != "").select(key.alias("_key"), F.col(text_col))
    bad = contamination(texts, items, "_key", text_col, **kw).filter("contaminated")
    name = "_bad"
    while name in docs.columns:
        name += "_"
    return docs.join(bad.select(F.col("_key").alias(name)), key == F.col(name), "left_anti")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (
  SELECT DISTINCT item_id, w[s : s + 7] AS win, least(len(w), 8) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
x AS (
  SELECT doc_id, n, s, w[s : s + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
o AS (SELECT DISTINCT x.doc_id, x.s, x.n, v.item_id FROM x JOIN v ON x.win = v.win AND x.n = v.n),
h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM o)) GROUP BY doc_id),
i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(i.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""

QUERIES = {"op10_benchmark_decontamination": op10_benchmark_decontamination}
ORACLE = {"op10_benchmark_decontamination": OP10_SQL}
