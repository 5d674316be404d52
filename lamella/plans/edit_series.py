"""Editing many tilt series: one row a series, what goes wrong in one is a status and does not stop the others.

The plan is relational (selection, matching, checks); only the texts of a series are edited by a kernel. ``plan`` reads
and decides, ``commit`` writes: backups first, then each file beside and renamed.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.text import basename, compact_float, stem
from lamella.operators import editing as E
from lamella.operators import tilts as L
from lamella.session import checkpoint
from lamella.sources import logs, tiltxml
from lamella.sources.star import numbered_lines


def acquisition_names(series: str) -> list[str]:
    """Names under which a series' acquisition log may stand, best first."""
    root = os.path.splitext(series)[0]
    return [f"{series}.mdoc", f"{series}.mrc.mdoc", f"{series}.st.mdoc", f"{root}.mdoc", f"{root}.mrc.mdoc"]


def table_names(series: str) -> list[str]:
    """Names under which a series' table may stand, best first."""
    return [f"{series}.tomostar", f"{os.path.splitext(series)[0]}.tomostar"]


def located(series: DataFrame, files: DataFrame, suffixes: list[str], strip: bool) -> DataFrame:
    """(series, path) of the best candidate: series + suffix, then (``strip``) the series without its extension + suffix."""
    root = F.regexp_replace("series", r"(?<=.)\.[^.]*$", "")
    names = [F.concat("series", F.lit(s)) for s in suffixes] + [F.concat(root, F.lit(s)) for s in suffixes[: 2 if len(suffixes) > 1 else 1] if strip]
    wanted = series.select("series", F.posexplode(F.array(*names)).alias("priority", "name"))
    found = files.select("path", basename(F.col("path")).alias("name")).distinct()
    return logs.locate(wanted.join(found, "name").select("series", "path", "priority"), files)


def _read(spark: SparkSession, read, path: str, schema: str) -> DataFrame:
    """What ``read`` gives; no rows where nothing matches the path."""
    try:
        spark.read.format("binaryFile").load(path).schema  # noqa: B018
        return read(spark, path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def plan(
    spark: SparkSession,
    xml: str,
    stacks: str,
    tables: str,
    acquisition: str | None = None,
    all_true: bool = False,
    n_tilts: int | None = None,
    max_tilt: float | None = None,
    delete: bool = False,
    angles_from_log: bool = False,
) -> DataFrame:
    """A row a series: status (kind "ok", "skip", "abort" or "error", and reason), new bytes of its XML and text of its
    table (null: unchanged), and the report of ``editing.diagnosis_table``.

    ``xml`` is a glob pattern; logs are at ``stacks``/<series>/taSolution.log, tables in ``tables``, acquisition logs in
    ``acquisition``. Views of the log are those of the first backup (<xml>.bak) where there is one.
    """
    if delete and all_true:
        raise ValueError("keeping all tilts deletes nothing")
    series = checkpoint(tiltxml.read_series(spark, xml))
    backup = _read(spark, tiltxml.read_series, xml + ".bak", "path string, xml string, encoding string, series string")
    backup = backup.join(series.select("series"), "series", "left_semi")
    elements, old = checkpoint(tiltxml.element_rows(series)), tiltxml.element_rows(backup)

    def rows(e: DataFrame) -> DataFrame:
        lists = e.groupBy("series").agg(*[F.max(F.when(F.col("tag") == t, F.col("entries"))).alias(t) for t in ("UseTilt", "Angles", "Dose", "MoviePath")])
        at = lambda c: F.get(c, F.col("i"))
        out = lists.select("*", F.posexplode("UseTilt").alias("i", "use"))
        return out.select("series", "i", "use", at("Angles").cast("double").alias("angle"), at("Dose").cast("double").alias("dose"), at("MoviePath").alias("movie"))

    tilts = checkpoint(rows(elements).withColumn("name", basename(F.col("movie"))))
    before = rows(old).withColumn("name", basename(F.col("movie")))
    # the reference: the backup where there is one, else the series itself
    reference = checkpoint(before.unionByName(tilts.join(before.select("series").distinct(), "series", "left_anti")))
    current, stale = E.reference_order(tilts, reference, "series", "i", "name")

    log = _read(spark, logs.read_alignment_log, f"{stacks}/*/taSolution.log", "path string, view int, tilt double")
    log = checkpoint(log.select(F.element_at(F.split("path", "/"), -2).alias("series"), "view", "tilt"))
    seen = E.with_views(reference, log, "series", "i")
    status = series.select("series").join(log.select("series").distinct().withColumn("_log", F.lit(True)), "series", "left")
    status = status.join(stale.select("series", F.lit(True).alias("_stale")), "series", "left")
    reasons = [(F.col("_log").isNull() & F.lit(not all_true or angles_from_log), "skip", F.lit("no taSolution.log")), (F.col("_stale").isNotNull(), "abort", F.lit("stale backup"))]
    if acquisition is not None:
        files = _read(spark, logs.listing, f"{acquisition}/*.mdoc", "path string")
        place = checkpoint(located(series, files, [".mdoc", ".mrc.mdoc", ".st.mdoc"], True))
        log_rows = _read(spark, logs.read_acquisition_log, f"{acquisition}/*.mdoc", "path string, zvalue int, movie string, dose double, stamp double, time timestamp")
        log_rows = log_rows.join(place, "path")
        bad = logs.acquisition_problems(log_rows).join(place, "path").groupBy("series").agg(F.min("problem").alias("_mdoc"))
        ordered = log_rows.withColumn("_key", L.acquisition_key("stamp", "time", "zvalue", "series"))
        doses = L.accumulated_dose(ordered, "series", ["_key", "zvalue"], "dose").select("series", "movie", F.col("pre_dose").alias("log_dose"))
        seen, missing = E.with_acquisition(seen, doses, "series", "movie")
        seen = seen.withColumn("dose", F.coalesce("log_dose", "dose"))
        status = status.join(place.select("series", F.lit(True).alias("_place")), "series", "left").join(bad, "series", "left")
        status = status.join(missing.select("series", F.concat(F.col("n_missing").cast("string"), F.lit(" movies not in the acquisition log")).alias("_miss")), "series", "left")
        reasons += [(F.col("_place").isNull(), "skip", F.lit("no mdoc")), (F.coalesce("_mdoc", "_miss").isNotNull(), "abort", F.concat(F.lit("mdoc: "), F.coalesce("_mdoc", "_miss")))]
    else:
        seen = seen.withColumn("log_dose", F.lit(None).cast("double"))
    if angles_from_log:
        seen, fit = E.log_angles(seen, "series", "i", "angle")
        weak = F.when((F.col("n") > 2) & (F.abs("corr") < E.FOLLOWS), F.format_string("log angles did not fit (corr %.2f); log used", F.abs("corr")))
        status = status.join(fit.select("series", F.col("error").alias("_fit"), weak.alias("note")), "series", "left")
        reasons.append((F.col("_fit").isNotNull(), "abort", F.col("_fit")))
    else:
        seen, status = seen.withColumn("new_angle", F.lit(None).cast("double")), status.withColumn("note", F.lit(None).cast("string"))
    # the log's angle counts in the selection where it has the view
    seen = seen.withColumn("_a", F.coalesce("log_tilt", "angle"))
    chosen = checkpoint(L.keep_mask(seen, "series", "i", "in_log", "_a", "dose", all_true, n_tilts, max_tilt))
    picked = chosen.select("series", (F.col("i") + 1).alias("view"), "keep", "log_dose", "new_angle")
    current = checkpoint(current.join(picked, ["series", "view"], "left").withColumn("keep", F.coalesce("keep", F.lit(False))))

    lists = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c.alias("v")))), lambda x: x["v"])
    some = lambda c: F.when(F.count(c) > 0, lists(compact_float(F.col(c))))
    edits = current.groupBy("series").agg(
        some("log_dose").alias("Dose"), some("new_angle").alias("Angles"), lists(F.when(F.col("keep"), "True").otherwise("False")).alias("flipped"),
        F.array_sort(F.collect_list(F.when(~F.col("keep"), F.col("i")))).alias("excluded"), F.count(F.lit(1)).alias("n_now"),
    )
    files = _read(spark, logs.listing, f"{tables}/*.tomostar", "path string")
    place = checkpoint(located(series, files, [".tomostar"], True))
    table = _read(spark, logs.read_tomostar, f"{tables}/*.tomostar", "path string, n int, line string, tokens array<string>, columns array<string>").join(place, "path")
    table = checkpoint(table.withColumn("movie", logs.column(table, "wrpMovieName")))
    matched, uneven = E.tomostar_rows(table, tilts, "series")
    matched = matched.join(current.select("series", "i", "keep", "log_dose", "new_angle"), ["series", "i"], "left")
    matched = E.set_column(matched, "series", "wrpDose", "log_dose")
    matched = E.set_column(matched, "series", "wrpAngleTilt", "new_angle", True)
    lines = _read(spark, numbered_lines, f"{tables}/*.tomostar", "path string, n int, line string").join(place, "path")
    lines = lines.join(matched.select("series", "n", F.col("line").alias("_new")), ["series", "n"], "left").withColumn("line", F.coalesce("_new", "line"))
    texts = E.kept_lines(lines.select("series", "n", "line"), matched.filter(~F.col("keep")) if delete else matched.limit(0), "series")

    status = status.join(edits, "series", "left").join(texts, "series", "left").join(uneven.select("series", F.lit(True).alias("_uneven")), "series", "left")
    errors = E.structure_errors(elements)
    status = status.join(errors, "series", "left")
    if delete:
        todo = (F.size("excluded") > 0) | F.col("Dose").isNotNull() | F.col("Angles").isNotNull()
        reasons += [
            (F.size("excluded") == F.col("n_now"), "abort", F.lit("would delete all tilts")),
            (todo & (F.size("errors") > 0), "abort", F.concat(F.lit("XML structure inconsistent: "), F.array_join("errors", "; "))),
            (todo & F.col("text").isNull(), "skip", F.lit("no tomostar")),
            (todo & F.col("_uneven").isNotNull(), "abort", F.lit("table rows do not match the tilts")),
        ]
    reasons.insert(0, (F.exists("errors", lambda e: e.startswith("unexpected") | e.startswith("no root")) | F.col("n_now").isNull(), "error", F.lit("cannot read the XML")))
    kind, reason = F.lit("ok"), F.col("note")
    for when, k, why in reversed(reasons):
        kind, reason = F.when(when, k).otherwise(kind), F.when(when, why).otherwise(reason)
    status = checkpoint(status.withColumns({"kind": kind, "reason": reason}))

    ready = status.filter("kind = 'ok'").select("series", "Dose", "Angles", "text", F.when(F.lit(not delete), F.col("flipped")).alias("UseTilt"), F.when(F.lit(delete), F.col("excluded")).alias("gone"))
    changed = tiltxml.edited(series.join(ready, "series")).select("series", "content", F.when(F.lit(delete) | F.col("Dose").isNotNull() | F.col("Angles").isNotNull(), F.col("text")).alias("table_text"))

    views = current.groupBy("series").agg(F.collect_set(F.when(F.col("use") == "True", F.col("view"))).alias("now"), F.collect_set(F.when(F.col("keep"), F.col("view"))).alias("planned"), F.collect_set("view").alias("present"))
    named = reference.select("series", "name", (F.col("i") + 1).alias("view"))
    rows_in = table.select("series", basename(F.col("movie")).alias("name")).join(named, ["series", "name"], "left")
    held = rows_in.groupBy("series").agg(F.collect_set("view").alias("held"), F.sum(F.col("view").isNull().cast("long")).alias("unknown"))
    logged = log.groupBy("series").agg(F.collect_set("view").alias("log"))
    count = reference.groupBy("series").agg(F.count(F.lit(1)).cast("int").alias("n"))
    ok = F.col("kind") == "ok"
    report = status.select("series", "kind", "reason").join(count, "series", "left").join(logged, "series", "left").join(views, "series", "left").join(held, "series", "left")
    report = report.withColumn("xml", F.when(ok, F.col("planned")).otherwise(F.col("now")))
    report = report.withColumn("table", F.when(ok & F.lit(delete), F.array_intersect("held", "xml")).otherwise(F.col("held"))).withColumn("unknown", F.coalesce("unknown", F.lit(0)))
    report = E.diagnosis_table(report, delete)
    out = status.select("series", "kind", "reason", F.size("excluded").alias("n_excluded")).join(changed, "series", "left").join(report, "series")
    return out.join(series.select("series", "path"), "series").join(place.select("series", F.col("path").alias("table_path")), "series", "left")


def commit(planned: DataFrame, backups: str | None = None) -> int:
    """Write the files of a plan that is "ok", after copying the old ones (to ``backups`` or beside); returns the series written."""
    done = 0
    for r in planned.filter("kind = 'ok' AND content IS NOT NULL").toLocalIterator():
        path = r["path"]
        logs.backup(path, None if backups is None else os.path.join(backups, os.path.basename(path)))
        if r["table_path"] and r["table_text"] is not None:
            logs.backup(r["table_path"])
        logs.replace_file(path, bytes(r["content"]))
        if r["table_path"] and r["table_text"] is not None:
            logs.replace_file(r["table_path"], r["table_text"].encode())
        done += 1
    return done


__all__ = ["acquisition_names", "commit", "located", "plan", "stem", "table_names"]
