"""A corpus from raw documents: toxicity, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents`` (and any
others that ``docs`` has, whatever their names). An empty table gives an empty table in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.decontaminate import drop_contaminated
from lamella.llm.jaccard import link_components
from lamella.llm.lines import dedup_lines
from lamella.llm.mixing import mix_sources
from lamella.llm.toxicity import score_toxicity, train_toxicity
from lamella.session import shared_folder


def _apart(columns: list[str], name: str) -> str:
    """``name``, or with underscores after it, so that it is none of ``columns``."""
    while name in columns:
        name += "_"
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below 0.3; labels are learnt from all rows whose crc32(doc_id as text) mod 4 is not 2.

    Each row is judged by its text: null and empty texts score as empty ones, equal texts alike. Without toxic labels all stay.
    """
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=remainder != 2)
    rest = [c for c in docs.columns if c != "text"]  # the text goes beside them, once
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), "text")
    kept = score_toxicity(row, model).filter("score < 0.3")
    return kept.select(*[(F.col("row").getField(c) if c in rest else F.col("text")).alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that recur in other documents; n_chars follows the text.

    Documents are told apart by id, a null id being one; null texts come out empty. See ``dedup_lines``.
    """
    out = dedup_lines(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group linked by 5-word shingles with J >= 0.8.

    Rows are told apart by hashes of all their columns, not by id: rows with a null id are documents like others and
    come after all ids, rows that share an id survive if they are not linked, and of repeated rows one is left. Null,
    empty and blank texts link with nothing and all stay.
    """
    h1, h2 = _apart(docs.columns, "_h1"), _apart(docs.columns, "_h2")
    blank = ~F.coalesce(F.col("text").rlike("[^ \\x09-\\x0D]"), F.lit(False))
    rows = docs.filter(~blank).withColumns({h1: F.xxhash64(F.lit(21), *docs.columns), h2: F.xxhash64(F.lit(22), *docs.columns)})
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(h1).alias("h1"), F.col(h2).alias("h2"))
    keep = link_components(rows.select(row.alias("row"), "text"), "row").filter(F.col("row").eqNullSafe(F.col("component_id")))
    keep = keep.select(F.col("row.h1").alias(h1), F.col("row.h2").alias(h2)).distinct()
    kept = rows.dropDuplicates([h1, h2]).join(keep, [h1, h2], "left_semi")
    return kept.select(*docs.columns).unionByName(docs.filter(blank))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no window of a benchmark item occurs; null and empty texts stay, equal texts have one fate."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=1).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes, with ``taken`` words (their size once or twice).

    Texts without words have nothing to take and go; rows that share an id are taken alike; a null source is one.
    """
    return mix_sources(docs).filter("taken > 0")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]
#: toxicity is learnt and the mix is chosen by hashes: no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written and read again, as Parquet in the shared folder. A stage's
    folder goes when the next one's is complete; the result reads the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        path = f"{base}/{i}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        before = path
    return docs
