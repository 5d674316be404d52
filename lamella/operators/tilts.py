"""Tilt-series operators: dose, selection, deletion, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: tolerances within which values count as equal
DOSE_TOLERANCE, ANGLE_TOLERANCE = 0.01, 0.005


def accumulated_dose(df: DataFrame, series: str, order: list[str], dose: str) -> DataFrame:
    """``pre_dose``: dose of all earlier exposures of the series."""
    w = Window.partitionBy(series).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("pre_dose", F.coalesce(F.sum(dose).over(w), F.lit(0.0)))


def acquisition_key(stamp: str, time: str, z: str, series: str) -> Column:
    """TimeStamp if every row of a series has one, else the parsed time if all parse, else ZValue."""
    w = Window.partitionBy(series)
    missing = lambda c: F.max(F.col(c).isNull()).over(w)
    return F.when(~missing(stamp), F.col(stamp).cast("double")).when(~missing(time), F.col(time).cast("timestamp").cast("double")).otherwise(F.col(z).cast("double"))


def keep_mask(
    df: DataFrame, series: str, index: str, in_log: str, angle: str, dose: str, all_true: bool = False, n_tilts: int | None = None, max_tilt: float | None = None
) -> DataFrame:
    """``keep``: everything, or the ``n_tilts`` lowest-dose views of the log, or those whose |angle| does not exceed
    that of the lowest-dose view by more than ``max_tilt``, or the views of the log; the first of these that is set."""
    if all_true:
        return df.withColumn("keep", F.lit(True))
    inside = F.col(in_log)
    if n_tilts is not None:
        w = Window.partitionBy(series, in_log).orderBy(dose, index)
        return df.withColumn("keep", inside & (F.row_number().over(w) <= n_tilts))
    if max_tilt is not None:
        w = Window.partitionBy(series)
        zero = F.min_by(F.abs(F.col(angle)), F.when(inside, F.struct(dose, index))).over(w)
        return df.withColumn("keep", F.coalesce(inside & (F.abs(F.col(angle)) <= zero + max_tilt), F.lit(False)))
    return df.withColumn("keep", inside)


def view_ranges(df: DataFrame, series: str, view: str) -> DataFrame:
    """(series, ranges): distinct views as text, '1-3,5,7-8'."""
    v = df.select(series, F.col(view).cast("long").alias("v")).filter("v IS NOT NULL").distinct()
    v = v.withColumn("island", F.col("v") - F.row_number().over(Window.partitionBy(series).orderBy("v")))
    runs = v.groupBy(series, "island").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    runs = runs.withColumn("r", F.struct("a", text.alias("t")))
    return runs.groupBy(series).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"]), ",").alias("ranges"))


def delete_and_renumber(df: DataFrame, series: str, index: str, gone: Column) -> DataFrame:
    """Rows that stay, with ``new_index`` from 0."""
    w = Window.partitionBy(series).orderBy(index)
    return df.filter(~F.coalesce(gone, F.lit(False))).withColumn("new_index", (F.row_number().over(w) - 1).cast("long"))


def contiguous(df: DataFrame, series: str, key: str, name: str = "id") -> DataFrame:
    """``name``: the keys of a series renumbered 1.. in order, equal keys alike."""
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(series).orderBy(key)).cast("long"))


def with_files(df: DataFrame, movie: str, files: DataFrame) -> DataFrame:
    """Tilts with ``file``: the first of ``files`` (path) whose name begins with the movie's stem and a dot, .mrc before others."""
    from lamella.functions.text import basename, stem

    named = files.select("path", basename(F.col("path")).alias("_f")).distinct()
    named = named.withColumn("_k", F.explode(F.expr("transform(filter(sequence(1, length(_f)), i -> substr(_f, i, 1) = '.'), i -> substr(_f, 1, i - 1))")))
    best = named.groupBy("_k").agg(F.min(F.struct((F.col("_f") != F.concat("_k", F.lit(".mrc"))).alias("other"), "_f", "path"))["path"].alias("file"))
    return df.join(best, stem(F.col(movie)) == F.col("_k"), "left").drop("_k")


def angle_fit(df: DataFrame, series: str, old: str, new: str) -> DataFrame:
    """(series, n, corr, sign): correlation 1 without variance or with two views at most; sign -1 from -0.8 down."""
    r = F.coalesce(F.corr(old, new), F.lit(1.0))
    out = df.filter(F.col(old).isNotNull() & F.col(new).isNotNull()).groupBy(series).agg(F.count(F.lit(1)).alias("n"), r.alias("corr"))
    out = out.withColumn("corr", F.when(F.col("n") > 2, F.when(F.isnan("corr"), 1.0).otherwise(F.col("corr"))).otherwise(F.lit(1.0)))
    return out.withColumn("sign", F.when((F.col("n") > 2) & (F.col("corr") <= -0.8), -1).otherwise(1))


def override(old: Column, new: Column) -> Column:
    """Lists position by position; null keeps the old entry."""
    return F.zip_with(old, new, lambda o, n: F.coalesce(n, o))


def differences(df: DataFrame, series: str, index: str, old: str, new: str, tolerance: float) -> DataFrame:
    """(series, n_changed, worst, worst_index) over values that differ by more than the tolerance."""
    d = F.abs(F.col(old) - F.col(new))
    changed = df.withColumn("_d", d).filter(F.col("_d") > tolerance)
    return changed.groupBy(series).agg(
        F.count(F.lit(1)).alias("n_changed"), F.max("_d").alias("worst"), F.min_by(index, F.struct(-F.col("_d"), F.col(index))).alias("worst_index")
    )


def match_by_name_or_position(left: DataFrame, right: DataFrame, series: str, name: str, index: str) -> DataFrame:
    """Left rows with ``r_index``: by name where both sides of a series hold the same, unique names, else by position."""
    def names(df: DataFrame, out: str) -> DataFrame:
        return df.groupBy(series).agg(F.array_sort(F.collect_list(name)).alias(out))

    by = names(left, "_l").join(names(right, "_r"), series)
    by = by.select(series, ((F.col("_l") == F.col("_r")) & (F.size("_l") == F.size(F.array_distinct("_l")))).alias("by_name"))
    pos = lambda df: df.withColumn("_p", F.row_number().over(Window.partitionBy(series).orderBy(index)))
    r = pos(right).select(F.col(series).alias("_s"), F.col(name).alias("_n"), F.col("_p").alias("_q"), F.col(index).alias("r_index"))
    l = pos(left).join(by, series)  # noqa: E741
    key = lambda c, n, p: F.when(F.col("by_name"), F.concat(F.lit("n:"), F.col(n).cast("string"))).otherwise(F.concat(F.lit("p:"), F.col(p).cast("string")))
    r = r.join(by.withColumnRenamed(series, "_s2"), F.col("_s") == F.col("_s2")).select("_s", key("", "_n", "_q").alias("_k"), "r_index")
    l = l.withColumn("_k2", key("", name, "_p"))  # noqa: E741
    return l.join(r, (F.col(series) == F.col("_s")) & (F.col("_k2") == F.col("_k")), "left").drop("_s", "_k", "_k2", "_p")


def diagnosis(kept: Column, planned: Column, logged: Column) -> dict[str, Column]:
    """Set columns of a series: what is missing, what is extra, and a verdict."""
    missing, extra = F.array_sort(F.array_except(planned, kept)), F.array_sort(F.array_except(kept, planned))
    outside = F.array_sort(F.array_except(kept, logged))
    verdict = (
        F.when((F.size(missing) == 0) & (F.size(extra) == 0), F.lit("ok"))
        .when(F.size(missing) == 0, F.lit("needs deletion"))
        .when(F.size(extra) == 0, F.lit("over-deleted"))
        .otherwise(F.lit("inconsistent"))
    )
    return {"missing": missing, "extra": extra, "outside_log": outside, "verdict": verdict}


def view_attenuation(df: DataFrame, series: str, angle: str, index: str) -> DataFrame:
    """``attenuation``: weighted mean of the nearby tilt increments (2 for the nearest, 1/1.5 for the next) over their mean."""
    w = Window.partitionBy(series).orderBy(F.desc(angle), index)
    whole = Window.partitionBy(series)
    gap = lambda k: F.lag(F.col(angle), k + 1).over(w) - F.lag(F.col(angle), k).over(w)
    ahead = lambda k: F.lead(F.col(angle), k).over(w) - F.lead(F.col(angle), k + 1).over(w)
    terms = [(gap(0), 2.0), (ahead(0), 2.0), (gap(1), 1 / 1.5), (ahead(1), 1 / 1.5)]
    total = sum((F.coalesce(g * c, F.lit(0.0)) for g, c in terms), F.lit(0.0))
    weight = sum((F.when(g.isNotNull(), c).otherwise(0.0) for g, c in terms), F.lit(0.0))
    n = F.count(F.lit(1)).over(whole)
    mean = (F.max(angle).over(whole) - F.min(angle).over(whole)) / F.nullif(n - 1, F.lit(0))
    return df.withColumn("attenuation", F.when(n > 1, total / F.nullif(weight, F.lit(0.0)) / F.nullif(mean, F.lit(0.0))).otherwise(1.0))


def arc_length(df: DataFrame, group: list[str], order: list[str], pos: list[str]) -> DataFrame:
    """``arc``: length of the polyline up to each point, from 0."""
    w = Window.partitionBy(*group).orderBy(*order)
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in pos), F.lit(0.0)))
    return df.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("arc", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def moving_average(df: DataFrame, group: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """``smooth``: mean over ``width`` points with zeros beyond the ends, which keep their values; short groups stay."""
    w = Window.partitionBy(*group).orderBy(*order)
    frame = w.rowsBetween(-(width // 2), (width - 1) // 2)
    at, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(*group))
    plain = (at == 1) | (at == n) | (n < width) if width > 1 else F.lit(True)
    return df.withColumn("smooth", F.when(plain, F.col(value)).otherwise(F.sum(value).over(frame) / float(width)))
