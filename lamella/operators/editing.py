"""Editing tilt series: joins of tilts with their logs, structure checks, deletion, diagnosis, one row a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.functions.text import basename, compact_float, stem

from .tilts import angle_fit, match_by_name_or_position

#: correlation below which a log does not follow the angles
FOLLOWS = 0.8


def problems(df: DataFrame, series: str, missing: Column, example: Column) -> DataFrame:
    """(series, n_missing, example) of the series that lack something; any miss stops a series."""
    return df.filter(missing).groupBy(series).agg(F.count(F.lit(1)).alias("n_missing"), F.min(example).alias("example"))


def with_acquisition(tilts: DataFrame, log: DataFrame, series: str, movie: str) -> tuple[DataFrame, DataFrame]:
    """Tilts with ``log_dose`` of the movie with the same stem, and the series in which a movie is not in the log.

    ``log`` has (series, movie stem, log_dose).
    """
    key = stem(F.col(movie))
    right = log.select(F.col(series).alias("_s"), F.col("movie").alias("_m"), "log_dose", F.lit(True).alias("_in"))
    joined = tilts.join(right, (F.col(series) == F.col("_s")) & (key == F.col("_m")), "left")
    return joined.drop("_s", "_m", "_in"), problems(joined, series, F.col("_in").isNull(), key)


def with_views(tilts: DataFrame, log: DataFrame, series: str, index: str) -> DataFrame:
    """Tilts with ``log_tilt`` of view index + 1, and ``in_log``."""
    right = log.select(F.col(series).alias("_s"), F.col("view").alias("_v"), F.col("tilt").alias("log_tilt"), F.lit(True).alias("_in"))
    out = tilts.join(right, (F.col(series) == F.col("_s")) & (F.col(index) + 1 == F.col("_v")), "left")
    return out.withColumn("in_log", F.coalesce("_in", F.lit(False))).drop("_s", "_v", "_in")


def log_angles(joined: DataFrame, series: str, index: str, angle: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tilts of ``with_views`` with ``new_angle`` (sign matched to the old ones; null where the log is silent), and
    (series, n, corr, error): without a single view, or with ``strict`` where the log does not follow, an error."""
    fit = angle_fit(joined.filter("in_log"), series, angle, "log_tilt")
    every = joined.select(series).distinct().join(fit, series, "left")
    after = F.abs(F.col("corr")) if not strict else F.col("corr") * F.col("sign")
    error = F.when(F.col("n").isNull(), F.lit("no view of the log is a tilt"))
    if strict:
        error = error.when((F.col("n") > 2) & (after < FOLLOWS), F.lit("the log does not follow the angles"))
    every = every.withColumn("error", error)
    out = joined.join(every.select(F.col(series).alias("_s"), "sign"), F.col(series) == F.col("_s"), "left")
    return out.withColumn("new_angle", F.col("sign") * F.col("log_tilt")).drop("_s", "sign"), every.drop("sign")


def reference_order(tilts: DataFrame, reference: DataFrame, series: str, index: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Tilts with ``view``, their 1-based place in the reference (the first backup; without one, their own), and the
    series that hold names the reference lacks."""
    ref = reference.groupBy(F.col(series).alias("_s"), F.col(name).alias("_n")).agg(F.max(F.col(index) + 1).alias("_v"))
    known = reference.select(F.col(series).alias("_k")).distinct()
    out = tilts.join(ref, (F.col(series) == F.col("_s")) & (F.col(name) == F.col("_n")), "left").join(known, F.col(series) == F.col("_k"), "left")
    lost = F.col("_k").isNotNull() & F.col("_v").isNull()
    bad = problems(out, series, lost, F.col(name))
    return out.withColumn("view", F.when(F.col("_k").isNull(), F.col(index) + 1).otherwise(F.col("_v"))).drop("_s", "_n", "_v", "_k"), bad


def tilt_count(elements: DataFrame) -> DataFrame:
    """(series, n): entries of UseTilt."""
    return elements.filter("tag = 'UseTilt'").groupBy("series").agg(F.max(F.size("entries")).alias("n"))


def structure_errors(elements: DataFrame) -> DataFrame:
    """(series, n, errors): lists of another length, indexed elements whose IDs are not 0..n-1, per-tilt grids whose node
    count or slices do not fit. Rows as ``tiltxml.element_rows`` gives them."""
    n = tilt_count(elements)
    rows = elements.join(n, "series", "left")
    tag = F.concat(F.lit("<"), F.col("tag"), F.lit(">"))
    upto = lambda c: F.sequence(F.lit(0), F.greatest(c, F.lit(1)) - 1)
    size = F.size("entries")
    wrong = rows.filter(F.col("id").isNull() & F.col("zs").isNull() & F.col("entries").isNotNull() & (size > 1) & (size != F.col("n")))
    wrong = wrong.select("series", F.concat(tag, F.lit(" has "), size.cast("string"), F.lit(" entries")).alias("e"))
    ids = rows.filter("id IS NOT NULL").groupBy("series", "tag", "n").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    ids = ids.filter(F.col("ids") != upto(F.col("n"))).select("series", F.concat(tag, F.lit(" has other IDs than 0..n-1")).alias("e"))
    grids = rows.filter((F.col("depth") == F.col("n")) & F.col("zs").isNotNull())
    nodes = grids.filter(F.size("zs") != F.col("width") * F.col("height") * F.col("n"))
    nodes = nodes.select("series", F.concat(tag, F.lit(" has "), F.size("zs").cast("string"), F.lit(" nodes")).alias("e"))
    slices = grids.filter(F.array_sort(F.array_distinct("zs")) != upto(F.col("n")))
    slices = slices.select("series", F.concat(tag, F.lit(" has other slices than 0..n-1")).alias("e"))
    found = wrong.unionByName(ids).unionByName(nodes).unionByName(slices)
    unread = elements.filter("error IS NOT NULL").select("series", F.col("error").alias("e"))
    found = found.unionByName(unread).groupBy("series").agg(F.array_sort(F.collect_list("e")).alias("errors"))
    every = elements.select("series").distinct().join(n, "series", "left")
    return every.join(found, "series", "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))


def flip(tilts: DataFrame, series: str, index: str, use: str, keep: str) -> DataFrame:
    """(series, use_tilt, changed, kept): the new UseTilt list, how many entries change and how many are true."""
    new = F.when(F.col(keep), "True").otherwise("False")
    listed = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), new.alias("v"))))
    return tilts.groupBy(series).agg(
        F.transform(listed, lambda x: x["v"]).alias("use_tilt"),
        F.sum((F.col(use).cast("string") != new).cast("long")).alias("changed"),
        F.sum(F.col(keep).cast("long")).alias("kept"),
    )


def tomostar_rows(rows: DataFrame, tilts: DataFrame, series: str) -> tuple[DataFrame, DataFrame]:
    """Table rows (series, n, movie, ...) with the tilt ``i`` they stand for (by unique names, else by place) and
    ``by_name``; and the series whose numbers of rows and tilts differ (series, n_rows, n_tilts)."""
    left = rows.withColumn("_name", basename(F.col("movie")))
    right = tilts.select(F.col(series), F.col("i"), basename(F.col("movie")).alias("_name"))
    matched = match_by_name_or_position(left.withColumnRenamed("n", "i"), right, series, "_name", "i").withColumnRenamed("i", "n").withColumnRenamed("r_index", "i")
    counts = rows.groupBy(series).agg(F.count(F.lit(1)).alias("n_rows")).join(tilts.groupBy(series).agg(F.count(F.lit(1)).alias("n_tilts")), series)
    return matched.drop("_name"), counts.filter("n_rows <> n_tilts")


def replaced(line: Column, position: Column, value: Column) -> Column:
    """The line with the token at ``position`` (from 0) replaced, all spacing kept; a null value keeps the line."""
    pattern = F.concat(F.lit(r"^(\s*(?:\S+\s+){"), position.cast("string"), F.lit(r"})\S+"))
    return F.coalesce(F.regexp_replace(line, pattern, F.concat(F.lit("$1"), value)), line)


def set_column(matched: DataFrame, series: str, name: str, value: str, match_sign: bool = False) -> DataFrame:
    """Matched table rows with column ``name`` set in ``line`` where ``value`` is not null; with ``match_sign`` the values'
    sign follows the column's where they clearly run against it. Series without the column keep their lines."""
    at = F.array_position("columns", name).cast("int") - 1
    old = F.expr("try_cast(get(tokens, _at) AS double)")
    rows = matched.withColumn("_at", at).withColumn("_old", F.when(F.col("_at") >= 0, old))
    if match_sign:
        fit = angle_fit(rows.filter(F.col(value).isNotNull()), series, "_old", value).select(F.col(series).alias("_s"), F.col("sign").alias("_g"))
        rows = rows.join(fit, F.col(series) == F.col("_s"), "left").drop("_s")
    else:
        rows = rows.withColumn("_g", F.lit(1))
    new = F.when(F.col("_at") >= 0, compact_float(F.coalesce("_g", F.lit(1)) * F.col(value)))
    return rows.withColumn("line", replaced(F.col("line"), F.greatest("_at", F.lit(0)), new)).drop("_at", "_old", "_g")


def kept_lines(lines: DataFrame, dropped: DataFrame, series: str) -> DataFrame:
    """(series, text): a file's numbered lines without those of ``dropped`` (series, n), joined again."""
    stay = lines.join(dropped.select(series, "n"), [series, "n"], "left_anti")
    return stay.groupBy(series).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))


def range_text(views: Column) -> Column:
    """Distinct views as text, '1-3,5,7-8'; '-' without any, 'n/a' for null."""
    v = F.array_sort(F.array_distinct(views))
    start = F.filter(v, lambda x: ~F.array_contains(v, x - 1))
    end = F.filter(v, lambda x: ~F.array_contains(v, x + 1))
    runs = F.transform(F.arrays_zip(start.alias("a"), end.alias("b")), lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat_ws("-", r["a"], r["b"])))
    return F.when(views.isNull(), "n/a").when(F.size(v) == 0, "-").otherwise(F.array_join(runs, ","))


def diagnosis_table(series: DataFrame, delete: bool) -> DataFrame:
    """The report: (series, n, kept and removed views by log, XML and table, check).

    ``series`` has (series, n, log, xml, table, unknown, kind, reason): sets of views numbered as in the original series
    (null: no such source), rows of the table that are no tilt, and what became of the series.
    """
    every = F.sequence(F.lit(1), F.col("n"))
    log = F.filter("log", lambda v: v <= F.col("n"))
    gone = lambda c: F.when(c.isNotNull(), F.array_except(every, c))
    same = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    outside = log.isNotNull() & (F.size(F.array_except("xml", log)) > 0)
    subset = log.isNotNull() & ~outside & ~same(F.col("xml"), log)
    differs = ~same(F.col("table"), F.col("xml")) if delete else ~same(F.col("table"), F.col("present"))
    say = lambda when, text: F.when(when, F.lit(text) if isinstance(text, str) else text)
    here = F.col("table").isNotNull()
    hard = F.concat_ws(
        "; ",
        say(outside, "XML keeps views outside the log"),
        say(here & (F.col("unknown") > 0), F.concat(F.col("unknown").cast("string"), F.lit(" table rows are no tilts"))),
        say(here & (F.col("unknown") == 0) & differs, "table and XML differ"),
    )
    notes = F.concat_ws(
        "; ", F.col("reason"), say(subset, "subset of the log"), say(~here, "no table"), *([] if delete else [say(here, "the table keeps all rows")])
    )
    check = (
        F.when(F.col("kind") != "ok", F.concat(F.upper("kind"), F.lit(": "), F.coalesce("reason", F.lit(""))))
        .when(hard != "", F.concat(F.lit("MISMATCH: "), hard))
        .when(notes != "", F.concat(F.lit("OK ("), notes, F.lit(")")))
        .otherwise("OK")
    )
    cells = {}
    for name, c in (("log", log), ("xml", F.col("xml")), ("table", F.col("table"))):
        cells |= {f"{name}_kept": range_text(c), f"{name}_removed": range_text(gone(c))}
    return series.select("series", "n", *[c.alias(k) for k, c in cells.items()], check.alias("check"))
