"""Structured Streaming: arriving text tables as lines, and what of them can be told as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.sources.star import file_path


def arriving_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, n, line) of files as they arrive in a folder; each file is read whole, once."""
    whole = spark.readStream.option("wholetext", "true").text(folder).select(file_path(F.col("_metadata.file_path")).alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))


def exposures(lines: DataFrame) -> DataFrame:
    """(path, n, total): exposures of acquisition logs seen so far and their dose, as a running aggregate over arriving lines."""
    dose = F.expr("try_cast(regexp_extract(line, '^\\\\s*ExposureDose\\\\s*=\\\\s*(.*)$', 1) AS double)")
    return lines.select("path", dose.alias("dose")).filter("dose IS NOT NULL").groupBy("path").agg(F.count("dose").alias("n"), F.sum("dose").alias("total"))
