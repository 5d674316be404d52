"""String functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: suffixes stripped from series names, the longest that matches first
NAME_SUFFIX = r"(\.mrc_\d+(?:\.\d+)?Apx\.mrc|\.mrc\.tomostar|\.tomostar|\.mrc)$"


def clean_name(c: Column, suffixes: list[str] | None = None) -> Column:
    """Name without its longest known suffix; own ``suffixes`` replace the built-in ones."""
    import re

    pattern = NAME_SUFFIX
    if suffixes is not None:
        pattern = "(" + "|".join(re.escape(s) for s in sorted(suffixes, key=len, reverse=True)) + ")$"
    return F.regexp_replace(c, pattern, "")


def basename(c: Column) -> Column:
    """Last part of a POSIX path."""
    return F.element_at(F.split(c, "/"), -1)


def stem(c: Column) -> Column:
    """Last part of a Windows or POSIX path without its last extension."""
    return F.regexp_replace(basename(F.regexp_replace(c, r"\\", "/")), r"(?<=.)\.[^.]*$", "")


def compact_float(c: Column) -> Column:
    """Four decimals without trailing zeros; negative zero is 0, null stays null."""
    return F.when(c.isNotNull(), F.regexp_replace(F.regexp_replace(F.format_string("%.4f", c), r"\.?0+$", ""), "^-0$|^$", "0"))


def stack_path(folder: Column, series: Column, windows: bool = False) -> Column:
    """Path of a series' stack; Windows paths escape backslashes, then the drive's colon."""
    path = F.concat(folder, F.lit("/"), series, F.lit("/"), series, F.lit(".st"))
    if not windows:
        return path
    return F.replace(F.replace(F.replace(path, F.lit("/"), F.lit("\\")), F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:"))


# Fixed value: tomogram names that tell their series.
TOMOGRAM = r"^(?:.*/)?(.+)\.mrc_[\d.]+Apx\.mrc$"


def xml_path(c: Column, folder: str, pattern: str = TOMOGRAM, suffix: str = ".mrc.xml") -> Column:
    """Path of a tomogram's XML: the pattern's first group with ``suffix``; null where the name does not begin with a match."""
    begins = "^(?:" + pattern + ")"
    return F.when(c.rlike(begins), F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_extract(c, begins, 1), F.lit(suffix)))


def list_entries(c: Column) -> Column:
    """Entries of a newline list; one trailing empty entry is dropped."""
    parts = F.split(c, "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def log_time(c: Column) -> Column:
    """Acquisition time with a four- or two-digit year; null if neither fits."""
    c = F.regexp_replace(F.trim(c), " +", " ")
    return F.coalesce(F.try_to_timestamp(c, F.lit("dd-MMM-yyyy HH:mm:ss")), F.try_to_timestamp(c, F.lit("dd-MMM-yy HH:mm:ss")))
