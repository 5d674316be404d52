"""Further operators as queries: editing, readers fed with lines, alignment, picks, binding.

Stand-ins as in ``queries``: users of ``events`` are tilt series, their events tilts; lines of files are put together from
columns and read back by the readers.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import align
from .functions import ctf as C
from .functions import grids as G
from .functions import text as T
from .operators import curation as U
from .operators import editing as E
from .operators import filaments as M
from .operators import picks as P
from .operators import split as S
from .operators import stats as A
from .operators import tilts as L
from .operators import voxels as V
from .plans import binder as B
from .queries import GRID, LABELS, VOX, query, r6, table, voxels
from .sources import logs, writers

CF = lambda x: rf"regexp_replace(regexp_replace(printf('%.4f', {x}), '\.?0+$', ''), '^-0$|^$', '0')"
TILTS = "t AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value, event_type, value - 50 AS angle FROM events)"


def tilts(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("user_id", "event_id", (F.row_number().over(w) - 1).alias("i"), "value", "event_type", (F.col("value") - 50).alias("angle"))


# ------------------------------------------------------------ joins of tilts with their logs
MOVIES = r"""m AS (SELECT user_id, event_id, event_type || '_' || (event_id % 50) AS stem FROM events),
g AS (SELECT user_id, stem, CAST(min(event_id) AS DOUBLE) AS log_dose FROM m WHERE event_id % 3 <> 0 GROUP BY ALL)"""


def _movies(spark, d):
    e = table(spark, d, "events")
    name = F.concat_ws("_", "event_type", (F.col("event_id") % 50).cast("string"))
    left = e.select("user_id", "event_id", F.concat(F.lit("D:\\frames\\"), name, F.lit(".tif")).alias("movie"))
    log = e.filter("event_id % 3 <> 0").groupBy("user_id", name.alias("movie")).agg(F.min("event_id").cast("double").alias("log_dose"))
    return E.with_acquisition(left, log, "user_id", "movie")


@query(f"WITH {MOVIES} SELECT event_id, log_dose FROM m LEFT JOIN g USING (user_id, stem)")
def acquisition_join(spark, d):
    return _movies(spark, d)[0].select("event_id", "log_dose")


@query(f"WITH {MOVIES} SELECT m.user_id, count(*) AS n_missing, min(m.stem) AS example FROM m LEFT JOIN g USING (user_id, stem) WHERE g.stem IS NULL GROUP BY 1")
def acquisition_missing(spark, d):
    return _movies(spark, d)[1]


LOGGED = f"{TILTS}, lg AS (SELECT user_id, event_id % 60 + 1 AS view, max(value) - 50 AS tilt FROM events WHERE event_id % 7 <> 0 GROUP BY ALL), j AS (SELECT t.*, lg.tilt, lg.view IS NOT NULL AS in_log FROM t LEFT JOIN lg ON t.user_id = lg.user_id AND t.i + 1 = lg.view)"


def _viewed(spark, d):
    e = table(spark, d, "events").filter("event_id % 7 <> 0")
    log = e.groupBy("user_id", (F.col("event_id") % 60 + 1).alias("view")).agg((F.max("value") - 50).alias("tilt"))
    return E.with_views(tilts(spark, d), log, "user_id", "i")


@query(f"WITH {LOGGED} SELECT event_id, in_log, round(tilt, 6) AS log_tilt FROM j")
def log_views(spark, d):
    return _viewed(spark, d).select("event_id", "in_log", r6("log_tilt").alias("log_tilt"))


@query(f"""WITH {LOGGED}, f AS (SELECT user_id, count(*) AS n, coalesce(corr(angle, tilt), 1) AS r FROM j WHERE in_log GROUP BY 1)
SELECT event_id, round(CASE WHEN n > 2 AND r <= -0.8 THEN -1 ELSE 1 END * tilt, 6) AS new_angle FROM j LEFT JOIN f USING (user_id)""")
def log_angles(spark, d):
    return E.log_angles(_viewed(spark, d), "user_id", "i", "angle")[0].select("event_id", r6("new_angle").alias("new_angle"))


@query(f"""WITH {TILTS}, r AS (SELECT t.* FROM t WHERE user_id % 2 = 0),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM t WHERE event_type <> 'error')
SELECT c.event_id, CASE WHEN c.user_id % 2 = 0 THEN r.i ELSE c.k END + 1 AS view FROM c LEFT JOIN r ON c.user_id = r.user_id AND c.event_id = r.event_id""")
def reference_order(spark, d):
    t = tilts(spark, d).withColumn("name", F.col("event_id").cast("string"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    now = t.filter("event_type <> 'error'").withColumn("i", F.row_number().over(w) - 1)
    return E.reference_order(now, t.filter("user_id % 2 = 0"), "user_id", "i", "name")[0].select("event_id", F.col("view").cast("long").alias("view"))


@query(f"""WITH {TILTS} SELECT user_id, string_agg(CASE WHEN value > 30 THEN 'True' ELSE 'False' END, ',' ORDER BY i) AS use_tilt,
 count(*) FILTER ((event_type <> 'error') <> (value > 30)) AS changed, count(*) FILTER (value > 30) AS kept FROM t GROUP BY 1""")
def flip_use(spark, d):
    t = tilts(spark, d).withColumns({"use": F.when(F.col("event_type") != "error", "True").otherwise("False"), "keep": F.col("value") > 30})
    return E.flip(t, "user_id", "i", "use", "keep").withColumn("use_tilt", F.array_join("use_tilt", ","))


def _rows(spark, d):
    e = table(spark, d, "events")
    line = F.format_string("  a/m%d.tif   %.2f  x", F.col("event_id"), F.col("value"))
    rows = e.select("user_id", F.col("event_id").alias("n"), F.concat(F.lit("a/m"), F.col("event_id").cast("string"), F.lit(".tif")).alias("movie"), line.alias("line"))
    rows = rows.withColumns({"tokens": F.split(F.trim("line"), r"\s+"), "columns": F.array(F.lit("wrpMovieName"), F.lit("wrpAngleTilt"))})
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    t = e.select("user_id", (F.row_number().over(w) - 1).alias("i"), F.concat(F.lit("b/m"), F.col("event_id").cast("string"), F.lit(".tif")).alias("movie"))
    return rows, t


ROWS = "x AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS i FROM events)"


@query(f"""WITH {ROWS}, f AS (SELECT user_id, count(*) AS n, coalesce(corr(CAST(printf('%.2f', value) AS DOUBLE), i * -1.5), 1) AS r FROM x WHERE i % 4 <> 0 GROUP BY 1)
SELECT event_id, CASE WHEN i % 4 = 0 THEN '  a/m' || event_id || '.tif   ' || printf('%.2f', value) || '  x'
 ELSE '  a/m' || event_id || '.tif   ' || {CF('CAST(CASE WHEN n > 2 AND r <= -0.8 THEN 1.5 ELSE -1.5 END * i AS DOUBLE)')} || '  x' END AS line FROM x LEFT JOIN f USING (user_id)""")
def table_set_column(spark, d):
    rows, t = _rows(spark, d)
    matched = E.tomostar_rows(rows, t, "user_id")[0].withColumn("new", F.when(F.col("i") % 4 != 0, F.col("i") * -1.5))
    return E.set_column(matched, "user_id", "wrpAngleTilt", "new", True).select(F.col("n").alias("event_id"), "line")


@query(f"""WITH {ROWS} SELECT user_id, string_agg('  a/m' || event_id || '.tif   ' || printf('%.2f', value) || '  x', chr(10) ORDER BY event_id) AS text FROM x WHERE i % 3 <> 0 GROUP BY 1""")
def table_drop_rows(spark, d):
    rows, t = _rows(spark, d)
    gone = E.tomostar_rows(rows, t, "user_id")[0].filter("i % 3 = 0")
    return E.kept_lines(rows.select("user_id", "n", "line"), gone, "user_id")


@query("""WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS t, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
g AS (SELECT conv_id, any_value(n) AS n, count(*) FILTER (role = 'user') AS nu FROM c GROUP BY 1)
SELECT conv_id AS series, n, array_to_string(list_sort(list_filter([
 CASE WHEN nu > 1 AND nu <> n THEN '<Dose> has ' || nu || ' entries' END,
 CASE WHEN conv_id % 3 = 0 THEN '<TiltPS1D> has other IDs than 0..n-1' END,
 CASE WHEN conv_id % 4 = 0 AND n > 1 THEN '<GridCTF> has ' || (n - 1) || ' nodes' END,
 CASE WHEN conv_id % 4 = 0 AND n > 1 THEN '<GridCTF> has other slices than 0..n-1' END], lambda e: e IS NOT NULL)), '|') AS errors FROM g""")
def structure_errors(spark, d):
    c = table(spark, d, "conversations").withColumn("t", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("int"))
    none = lambda kind: F.lit(None).cast(kind)
    shape = lambda series, tag, i=none("int"), w=none("int"), depth=none("int"), entries=none("array<string>"), zs=none("array<int>"): [
        series.alias("series"), F.lit(0).alias("k"), F.lit(tag).alias("tag"), i.alias("id"), w.alias("width"), w.alias("height"), depth.alias("depth"), entries.alias("entries"), zs.alias("zs"), none("string").alias("error"),
    ]
    g = c.groupBy("conv_id").agg(F.collect_list(F.col("t").cast("string")).alias("all"), F.collect_list(F.when(F.col("role") == "user", "x")).alias("user"), F.count(F.lit(1)).cast("int").alias("n"), F.array_sort(F.collect_list("t")).alias("ts"))
    ids = c.select(*shape(F.col("conv_id"), "TiltPS1D", i=F.when(F.col("conv_id") % 3 == 0, F.col("t") + 1).otherwise(F.col("t"))))
    part = F.when((F.col("conv_id") % 4 == 0) & (F.col("n") > 1), F.slice("ts", 1, F.greatest(F.col("n") - 1, F.lit(1)))).otherwise(F.col("ts"))
    rows = ids.unionByName(g.select(*shape(F.col("conv_id"), "UseTilt", entries=F.col("all")))).unionByName(g.select(*shape(F.col("conv_id"), "Dose", entries=F.col("user"))))
    rows = rows.unionByName(g.select(*shape(F.col("conv_id"), "GridCTF", w=F.lit(1), depth=F.col("n"), zs=part)))
    return E.structure_errors(rows).select("series", F.col("n").cast("long").alias("n"), F.array_join("errors", "|").alias("errors"))


@query("""WITH s AS (SELECT user_id AS series, 9 AS n, list_sort(list(DISTINCT event_id % 9 + 1) FILTER (event_type = 'click' OR event_id % 9 < 4)) AS x, list_sort(list(DISTINCT event_id % 9 + 1) FILTER (event_type <> 'error' OR event_id % 9 < 4)) AS l FROM events GROUP BY 1),
o AS (SELECT series, n, coalesce(x, []) AS x, coalesce(l, []) AS l, series % 5 = 0 AS skip, CASE WHEN series % 3 = 0 THEN NULL ELSE coalesce(x, []) END AS t FROM s)
SELECT series, len(x) AS n_kept, CASE WHEN skip THEN 'SKIP: no log' WHEN len(list_filter(x, lambda v: NOT list_contains(l, v))) > 0 THEN 'MISMATCH: XML keeps views outside the log'
 WHEN x <> l AND t IS NULL THEN 'OK (subset of the log; no table)' WHEN x <> l THEN 'OK (subset of the log)' WHEN t IS NULL THEN 'OK (no table)' ELSE 'OK' END AS "check" FROM o""")
def diagnosis_report(spark, d):
    view = F.col("event_id") % 9 + 1
    low = F.col("event_id") % 9 < 4
    s = table(spark, d, "events").groupBy(F.col("user_id").alias("series")).agg(F.collect_set(F.when((F.col("event_type") == "click") | low, view)).alias("xml"), F.collect_set(F.when((F.col("event_type") != "error") | low, view)).alias("log"))
    s = s.withColumns({"n": F.lit(9).cast("long"), "unknown": F.lit(0), "present": F.col("xml"), "kind": F.when(F.col("series") % 5 == 0, "skip").otherwise("ok"), "reason": F.when(F.col("series") % 5 == 0, "no log")})
    s = s.withColumn("table", F.when(F.col("series") % 3 != 0, F.col("xml")))
    out = E.diagnosis_table(s, True).join(s.select("series", F.size("xml").cast("long").alias("n_kept")), "series")
    return out.select("series", "n_kept", "check")


@query("""WITH d AS (SELECT DISTINCT user_id, event_id % 12 + 1 AS v FROM events), i AS (SELECT *, v - row_number() OVER (PARTITION BY user_id ORDER BY v) AS k FROM d),
r AS (SELECT user_id, min(v) AS a, max(v) AS b FROM i GROUP BY user_id, k)
SELECT user_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM r GROUP BY 1""")
def range_text(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.col("event_id") % 12 + 1).alias("v")).select("user_id", E.range_text(F.col("v")).alias("ranges"))


# ------------------------------------------------------------ files and names
@query(r"""WITH s AS (SELECT page_id, 'ts_' || page_id || '.mrc' AS series FROM pages)
SELECT series, CASE page_id % 5 WHEN 0 THEN series || '.mdoc' WHEN 1 THEN series || '.mrc.mdoc' WHEN 2 THEN series || '.st.mdoc' WHEN 3 THEN 'ts_' || page_id || '.mdoc' END AS name
FROM s WHERE page_id % 5 <> 4""")
def locate_acquisition(spark, d):
    from .plans.edit_series import located

    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("ts_"), F.col("page_id").cast("string"), F.lit(".mrc")).alias("series"))
    k = F.col("page_id") % 5
    own = F.when(k == 0, F.concat("series", F.lit(".mdoc"))).when(k == 1, F.concat("series", F.lit(".mrc.mdoc"))).when(k == 2, F.concat("series", F.lit(".st.mdoc")))
    own = own.when(k == 3, F.concat(F.regexp_replace("series", r"\.mrc$", ""), F.lit(".mdoc")))
    worse = F.when(k == 0, F.concat("series", F.lit(".st.mdoc")))  # a candidate of a lower rank beside it
    files = p.select(F.concat(F.lit("/m/"), own).alias("path")).unionByName(p.select(F.concat(F.lit("/m/"), worse).alias("path"))).filter("path IS NOT NULL")
    found = located(p.select("series"), files, [".mdoc", ".mrc.mdoc", ".st.mdoc"], True)
    return found.select("series", T.basename(F.col("path")).alias("name"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '/r/m' || event_id || '.mrc' WHEN event_id % 4 = 1 THEN '/r/m' || event_id || '.eer' END AS file FROM events""")
def movie_files(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("../f/m"), F.col("event_id").cast("string"), F.lit(".tif")).alias("movie"))
    path = lambda end: F.concat(F.lit("/r/m"), F.col("event_id").cast("string"), F.lit(end)).alias("path")
    files = e.filter("event_id % 4 < 2").select(path(".eer")).unionByName(e.filter("event_id % 4 = 0").select(path(".mrc")))
    return L.with_files(e, "movie", files).select("event_id", "file")


@query(r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/x/ts_' || page_id || '.mrc.xml' WHEN page_id % 3 = 1 THEN '/x/a.b_' || page_id || '.mrc.xml' END AS xml FROM pages""")
def xml_path(spark, d):
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 3
    name = F.when(k == 0, F.concat(F.lit("rec/ts_"), i, F.lit(".mrc_10.00Apx.mrc"))).when(k == 1, F.concat(F.lit("a.b_"), i, F.lit(".mrc_7Apx.mrc"))).otherwise(F.concat(F.lit("ts_"), i, F.lit(".mrc")))
    return table(spark, d, "pages").select("page_id", T.xml_path(name, "/x/").alias("xml"))


@query(r"""SELECT page_id, 'C\:\\t\\s' || page_id || '\\s' || page_id || '.st' AS win, '/t/s' || page_id || '/s' || page_id || '.st' AS unix FROM pages""")
def stack_paths(spark, d):
    s = F.concat(F.lit("s"), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", T.stack_path(F.lit("C:\\t"), s, True).alias("win"), T.stack_path(F.lit("/t"), s).alias("unix"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 3 ELSE 4 END AS n, CASE WHEN page_id % 2 = 0 THEN '' ELSE 'z' END AS last FROM pages")
def list_entries(spark, d):
    text = F.when(F.col("page_id") % 2 == 0, "a\nb\n\n").otherwise("a\n\nb\nz")
    x = table(spark, d, "pages").select("page_id", T.list_entries(text).alias("e"))
    return x.select("page_id", F.size("e").alias("n"), F.element_at("e", -1).alias("last"))


@query("SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t FROM events")
def log_time(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "dd-MMM-yyyy  HH:mm:ss")).otherwise(F.date_format("ts", "dd-MMM-yy  HH:mm:ss"))
    return e.select("event_id", F.unix_timestamp(T.log_time(text)).alias("t"))


# ------------------------------------------------------------ readers fed with lines
def _lines(df, key, rows):
    """(path, n, line): ``rows`` are arrays of lines by key."""
    return df.select(F.col(key).cast("string").alias("path"), F.posexplode(rows).alias("n", "line"))


def _lists(spark, d, *entries):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").withColumn("i", F.row_number().over(w)).withColumns({f"v{k}": x for k, x in enumerate(entries)})
    listed = F.array_sort(F.collect_list(F.struct("i", *[f"v{k}" for k in range(len(entries))])))
    return e.groupBy("user_id").agg(listed.alias("l"))


@query(f"WITH {TILTS} SELECT CAST(user_id AS VARCHAR) AS path, CAST(i + 1 AS INTEGER) AS view, CAST(printf('%.2f', value) AS DOUBLE) AS tilt FROM t")
def alignment_log(spark, d):
    x = _lists(spark, d, F.format_string("%5d   85.00  %.2f  0.1  1.0  0  0  0.5", F.col("i"), F.col("value")))
    rows = F.concat(F.array(F.lit("any text"), F.lit(" view   rotation    tilt")), F.transform("l", lambda r: r["v0"]), F.array(F.lit(""), F.lit(" view   rotation    tilt"), F.lit("  77 0 1.0 0")))
    return logs.alignment_log(_lines(x, "user_id", rows)).select("path", "view", "tilt")


@query(f"""WITH {TILTS} SELECT CAST(user_id AS VARCHAR) AS path, CAST(i AS INTEGER) AS zvalue, 'm' || event_id AS movie, CAST(printf('%.3f', value) AS DOUBLE) AS dose, CAST(event_id AS DOUBLE) AS stamp FROM t""")
def acquisition_log(spark, d):
    at = F.col("i") - 1
    x = _lists(spark, d, F.format_string("[ZValue = %d]\nSubFramePath = D:\\f\\m%d.eer\nExposureDose = %.3f\nTimeStamp = %d\nNote = [x]\n", at, F.col("event_id"), F.col("value"), F.col("event_id")))
    rows = F.split(F.concat(F.lit("PixelSpacing = 1.0\n[T = title]\nExposureDose = 9\n"), F.array_join(F.transform("l", lambda r: r["v0"]), "\n")), "\n")
    return logs.acquisition_log(_lines(x, "user_id", rows)).select("path", "zvalue", "movie", "dose", "stamp")


@query(f"WITH {TILTS} SELECT CAST(user_id AS VARCHAR) AS path, CAST(i + 6 AS INTEGER) AS n, 'm' || event_id || '.tif' AS movie, CAST(printf('%.2f', value) AS DOUBLE) AS dose FROM t")
def tomostar_rows(spark, d):
    x = _lists(spark, d, F.format_string("  m%d.tif   %.2f", F.col("event_id"), F.col("value")))
    head = F.array(*[F.lit(t) for t in ("", "data_", "", "loop_", "_wrpMovieName #1", "_wrpDose #2")])
    rows = logs.tomostar(_lines(x, "user_id", F.concat(head, F.transform("l", lambda r: r["v0"]), F.array(F.lit(""), F.lit("  late.tif  1")))))
    return rows.select("path", "n", logs.column(rows, "wrpMovieName").alias("movie"), logs.column(rows, "wrpDose").cast("double").alias("dose"))


@query(f"WITH {TILTS} SELECT i AS _row, CAST(printf('%.2f', value) AS DOUBLE) AS x, CAST(event_id AS DOUBLE) AS y, CAST(i AS DOUBLE) AS z FROM t WHERE user_id = (SELECT min(user_id) FROM t)")
def text_coordinates(spark, d):
    e = table(spark, d, "events")
    x = _lists(spark, d, F.format_string("%.2f, %d  %d", F.col("value"), F.col("event_id"), F.col("i") - 1))
    x = x.join(e.agg(F.min("user_id").alias("user_id")), "user_id")
    return logs.coordinates(_lines(x, "user_id", F.concat(F.array(F.lit("x y z"), F.lit("# note"), F.lit("")), F.transform("l", lambda r: r["v0"]))))


@query("SELECT CAST(page_id AS VARCHAR) AS path, '_rlnA,_rlnB' AS columns, CAST(CASE WHEN page_id % 2 = 0 THEN 6 ELSE 5 END AS INTEGER) AS first FROM pages WHERE page_id % 5 <> 0")
def loop_header(spark, d):
    even = F.array(*[F.lit(t) for t in ("", "data_", "loop_", "_rlnA #1", " _rlnB #2", "", "a\tb", "_rlnC")])
    odd = F.array(*[F.lit(t) for t in ("data_", "_other", "loop_", "_rlnA", "_rlnB #2", "1 2")])
    p = table(spark, d, "pages").withColumn("r", F.when(F.col("page_id") % 5 == 0, F.array(F.lit("data_"), F.lit("_rlnA #1"))).when(F.col("page_id") % 2 == 0, even).otherwise(odd))
    return logs.loop_header(_lines(p, "page_id", F.col("r"))).withColumn("columns", F.array_join("columns", ","))


def _xml(spark, d):
    x = _lists(spark, d, F.col("value").cast("string"))
    part = lambda tag: F.concat(F.lit(f"<{tag}>"), F.array_join(F.transform("l", lambda r: r["v0"]), "\n"), F.lit(f"</{tag}>"))
    use = F.concat(F.lit("<UseTilt>"), F.array_join(F.transform("l", lambda r: F.when(r["i"] % 3 == 0, "False").otherwise("True")), "\n"), F.lit("</UseTilt>"))
    nodes = F.array_join(F.transform("l", lambda r: F.concat(F.lit('<Node X="0" Y="0" Z="'), (r["i"] - 1).cast("string"), F.lit('" Value="'), r["v0"], F.lit('" />'))), "\n")
    return x.select(F.col("user_id").cast("string").alias("path"), F.concat(F.lit("<TiltSeries>"), part("Angles"), use, F.lit("<GridCTF>"), nodes, F.lit("</GridCTF></TiltSeries>")).alias("xml"))


@query(f"WITH {TILTS} SELECT CAST(user_id AS VARCHAR) AS path, i, round(value, 6) AS angle, (i + 1) % 3 <> 0 AS use, CAST(0 AS DOUBLE) AS dose FROM t")
def xml_tilts(spark, d):
    return logs.tilts(_xml(spark, d)).select("path", F.col("i").cast("long").alias("i"), r6("angle").alias("angle"), "use", "dose")


@query("SELECT CAST(user_id AS VARCHAR) AS path, CAST(round_even(avg(CAST(trunc(value * 10000) AS BIGINT)), 0) AS DOUBLE) AS defocus FROM events GROUP BY 1")
def mean_defocus(spark, d):
    return logs.mean_defocus(_xml(spark, d))


@query("SELECT CAST(page_id AS VARCHAR) AS path, CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS DOUBLE) / 4 ELSE 2.5 END AS pixel, CASE WHEN page_id % 3 = 0 THEN '100,200,' || page_id END AS dims FROM pages")
def settings_values(spark, d):
    i = F.col("page_id").cast("string")
    param = lambda k, v: F.concat(F.lit(f'<Param Name="{k}" Value="'), v, F.lit('" />'))
    size = F.when(F.col("page_id") % 2 == 0, param("PixelSize", (F.col("page_id") / 4).cast("string"))).otherwise(param("PixelSizeMean", F.lit("2.5")))
    box = F.when(F.col("page_id") % 3 == 0, F.concat(param("DimensionsX", F.lit("100")), param("DimensionsY", F.lit("199.6")), param("DimensionsZ", i))).otherwise(F.lit(""))
    x = table(spark, d, "pages").select(i.alias("path"), F.concat(F.lit("<Settings><Import>"), size, F.lit("</Import><Tomo>"), box, F.lit("</Tomo></Settings>")).alias("xml"))
    return logs.settings(x).select("path", "pixel", F.array_join(F.transform("dims", lambda v: v.cast("string")), ",").alias("dims"))


@query("""WITH f AS (SELECT user_id, CAST(round_even(avg(value * 100), 0) AS DOUBLE) AS d FROM events WHERE user_id % 4 <> 0 GROUP BY 1)
SELECT event_id, CASE WHEN f.d IS NULL THEN 's' || user_id || chr(9) || 'x' || chr(9) || '7' ELSE 's' || user_id || chr(9) || printf('%.6f', f.d) || chr(9) || '7' END AS line, CASE WHEN f.d IS NULL THEN 'no defocus' END AS reason
FROM events LEFT JOIN f USING (user_id)""")
def defocus_lines(spark, d):
    e = table(spark, d, "events")
    name = F.concat(F.lit("s"), F.col("user_id").cast("string"))
    f = e.filter("user_id % 4 <> 0").groupBy(name.alias("path")).agg(F.bround(F.avg(F.col("value") * 100), 0).alias("defocus"))
    stars = e.select(F.col("event_id").alias("n"), name.alias("name"), F.concat_ws("\t", name, F.lit("x"), F.lit("7")).alias("line")).withColumn("tokens", F.split("line", "\t"))
    return writers.with_defocus(stars, f, 1, "name").withColumnRenamed("n", "event_id")


@query("""SELECT vec_id AS _row, k, CASE k WHEN 0 THEN '.color 1 0.8 0' WHEN 1 THEN printf('.sphere %.2f %.2f %.2f 3.00', x, y, z) WHEN 2 THEN '.color 0 0.6 1'
 ELSE printf('.arrow %.2f %.2f %.2f %.2f %.2f %.2f 0.6', x, y, z, x + tx * 8, y + ty * 8, z + tz * 8) END AS line FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y,
 CAST(embedding[3] AS DOUBLE) * 100 AS z, CAST(embedding[4] AS DOUBLE) AS tx, CAST(embedding[5] AS DOUBLE) AS ty, CAST(embedding[6] AS DOUBLE) AS tz FROM embeddings), (SELECT CAST(unnest(range(4)) AS INTEGER) AS k)""")
def overlay_lines(spark, d):
    e = F.col("embedding")
    at = {c: e[i].cast("double") * 100 for i, c in enumerate("xyz")} | {f"t{c}": e[i + 3].cast("double") for i, c in enumerate("xyz")}
    return writers.overlay(table(spark, d, "embeddings").select(F.col("vec_id").alias("_row"), *[c.alias(k) for k, c in at.items()]))


@query("""WITH s AS (SELECT 's' || page_id AS series, row_number() OVER (ORDER BY 's' || page_id) AS id FROM pages)
SELECT CAST(id AS INTEGER) AS id, 'meta.row.ebt' || id || '.OrigStack=/t/' || series || '/' || series || '.st' AS line FROM s""")
def project_rows(spark, d):
    s = table(spark, d, "pages").select(F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("series"))
    return writers.project_lines(s, "/t/").filter("k = 1").select("id", "line")


# ------------------------------------------------------------ alignment, sizes, weights
@query("""SELECT event_id, CAST(round_even(event_id / 2.0, 0) * 2 AS BIGINT) AS even, round(CASE WHEN event_id % 7 < 4 THEN event_id % 7 ELSE event_id % 7 - 7 END / (7 * 2.5), 6) AS f7,
 round(CASE WHEN event_id % 8 < 4 THEN event_id % 8 ELSE event_id % 8 - 8 END / 8.0, 6) AS f8, CAST(greatest(greatest(floor(value * 10 / 150), 1) - CASE WHEN greatest(floor(value * 10 / 150), 1) % 2 = 0 THEN 1 ELSE 0 END, 1) AS INTEGER) AS strips FROM events""")
def sizes_and_frequencies(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", align.even(i).alias("even"), r6(align.frequency(i % 7, F.lit(7), 2.5)).alias("f7"), r6(align.frequency(i % 8, F.lit(8))).alias("f8"), align.strips(F.col("value") * 10, 15.0).alias("strips"))


@query("""SELECT event_id, round(cos(a), 6) AS a11, round(sin(a), 6) AS a12, round(-sin(a), 6) AS a21, round(cos(a), 6) AS a22, round(0.5 - (cos(a) * u + sin(a) * v), 6) AS dx, round(0.5 - (cos(a) * v - sin(a) * u), 6) AS dy
FROM (SELECT event_id, radians(value) AS a, value * 3 / 2.5 - 49.5 AS u, event_id / 2.5 - 79.5 AS v FROM events)""")
def alignment_transform(spark, d):
    t = align.transform(F.col("value"), F.col("value") * 3, F.col("event_id"), 2.5, F.lit(100), F.lit(160))
    return table(spark, d, "events").select("event_id", *[r6(c).alias(k) for k, c in t.items()])


@query("""SELECT user_id, greatest(CAST(ceil((c * 720 + s * 512) / 2.0) * 2 AS BIGINT), 700) AS w, greatest(CAST(ceil((s * 720 + c * 512) / 2.0) * 2 AS BIGINT), 702) AS h
FROM (SELECT user_id, max(abs(cos(radians(value)))) AS c, max(abs(sin(radians(value)))) AS s FROM events GROUP BY 1)""")
def aligned_size(spark, d):
    w, h = align.aligned_size(F.col("value"), F.lit(720), F.lit(512), F.lit(700), F.lit(701))
    return table(spark, d, "events").groupBy("user_id").agg(w.cast("long").alias("w"), h.cast("long").alias("h"))


@query("""SELECT event_id, round(value / 100 * 0.5 * CASE WHEN event_type <> 'error' THEN 1 ELSE 1e-4 END * 1.1, 6) AS scale, round(least(-value, -3.0 * (event_id % 50)) + 2.0 - 5.0, 6) AS bfactor FROM events""")
def tilt_weight_grids(spark, d):
    w = F.col("value") / 100
    scale, b = C.tilt_weights(F.lit(0.0), F.col("event_id") % 50, F.col("event_type") != "error", w, -F.col("value"), F.lit(0.5), F.lit(2.0), global_weight=1.1, global_bfactor=-5.0)
    return table(spark, d, "events").select("event_id", r6(scale).alias("scale"), r6(b).alias("bfactor"))


@query("""WITH g AS (SELECT event_id, p, least(floor(p), 2) AS k FROM (SELECT event_id, least(greatest(value / 100, 0), 1) * 3 AS p FROM events))
SELECT event_id, round(([0.0, 1.0, 4.0, 9.0])[CAST(k AS INTEGER) + 1] * (1 - (p - k)) + ([0.0, 1.0, 4.0, 9.0])[CAST(k AS INTEGER) + 2] * (p - k), 6) AS v FROM g""")
def grid_linear(spark, d):
    import numpy as np

    return table(spark, d, "events").select("event_id", r6(G.grid_column(np.array([0.0, 1.0, 4.0, 9.0]), F.col("value") / 100)).alias("v"))


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS most FROM events WHERE event_id % 11 <> 0 GROUP BY 1""")
def tail_percentiles(spark, d):
    e = table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 22 == 0, float("nan")).when(F.col("event_id") % 11 == 0, float("inf")).otherwise(F.col("value")))
    out = A.tail_percentiles(e, "value", ["event_type"])
    return out.select("event_type", *[r6(c).alias(c) for c in ("p50", "p90", "p99", "most")])


# ------------------------------------------------------------ picks and particles
EMB = "v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y, CAST(embedding[3] AS DOUBLE) * 100 AS z FROM embeddings)"


def _points(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("_row"), "label", *[(e[i].cast("double") * 100).alias(c) for i, c in enumerate("xyz")])


@query(f"""WITH {EMB}, p AS (SELECT vec_id // 2 AS pair, arg_min(x, vec_id) AS x0, arg_min(y, vec_id) AS y0, arg_min(z, vec_id) AS z0, arg_max(x, vec_id) AS x1, arg_max(y, vec_id) AS y1, arg_max(z, vec_id) AS z1, count(*) AS n FROM v GROUP BY 1),
q AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy, z1 - z0 AS dz, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) + (z1 - z0) * (z1 - z0)) AS r FROM p)
SELECT pair AS _row, trunc((x0 + x1) * 0.5 * 4) + 0.0 AS cx, trunc((y0 + y1) * 0.5 * 4) + 0.0 AS cy, round(CASE WHEN n = 2 THEN degrees(acos(greatest(-1, least(1, dz / r)))) END, 6) AS tilt, round(CASE WHEN n = 2 THEN degrees(atan2(dy, -dx)) END, 6) AS psi FROM q""")
def pair_particles(spark, d):
    out = P.particles(P.pairs(_points(spark, d), []), 4.0, 9.98, F.lit("m"))
    alone = F.col("n") == 1
    c = {"cx": F.col("rlnCoordinateX"), "cy": F.col("rlnCoordinateY"), "tilt": F.when(~alone, r6("rlnAngleTilt")), "psi": F.when(~alone, r6("rlnAnglePsi"))}
    return out.select("_row", *[v.alias(k) for k, v in c.items()])


@query("SELECT vec_id AS _row, 'odd number of points' AS problem FROM (SELECT vec_id // 2 AS vec_id, count(*) AS n FROM embeddings GROUP BY 1) WHERE n = 1")
def pair_problems(spark, d):
    return P.problems(P.particles(P.pairs(_points(spark, d), []), 4.0, 9.98, F.lit("m"))).filter("problem LIKE 'odd%'")


@query(f"WITH {EMB} SELECT vec_id, round((z - 3.0 / 5.0) * (5.0 / 2.5), 6) AS cz, round((y - 2.0 / 5.0) * (5.0 / 2.5), 6) AS cy, round((x - 1.0 / 5.0) * (5.0 / 2.5), 6) AS cx FROM v")
def voxel_centres(spark, d):
    p = _points(spark, d).select(F.col("_row").alias("vec_id"), *[F.col(c).alias(f"rlnCoordinate{c.upper()}") for c in "xyz"], *[F.lit(float(k)).alias(o) for k, o in enumerate(P.ORIGINS, 1)])
    return P.voxel_centres(p, 2.5, 5.0).select("vec_id", *[r6(c).alias(c) for c in ("cz", "cy", "cx")])


@query(f"WITH {EMB} SELECT vec_id FROM v WHERE NOT (round_even(z, 0) BETWEEN 0 AND 9 AND round_even(y, 0) BETWEEN 0 AND 9 AND round_even(x, 0) BETWEEN 0 AND 9)")
def outside_volume(spark, d):
    return V.outside(_points(spark, d).select(F.col("_row").alias("vec_id"), *[F.col(c).alias(f"c{c}") for c in "xyz"]), (10, 10, 10)).select("vec_id")


BOUND = "l_partkey AS rlnOpticsGroup, l_quantity AS rlnCoordinateX, l_tax AS rlnCoordinateY, l_discount AS rlnCoordinateZ, l_extendedprice AS rlnOriginXAngst"


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * p_size - l_extendedprice / 1000, 6) AS px, round(l_tax * p_size, 6) AS py, round(l_discount * p_size, 6) AS pz FROM lineitem JOIN part ON l_partkey = p_partkey""")
def bound_positions(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("rlnOpticsGroup"), F.lit("t").alias("rlnMicrographName"), F.col("l_quantity").alias("rlnCoordinateX"), F.col("l_tax").alias("rlnCoordinateY"), F.col("l_discount").alias("rlnCoordinateZ"), (F.col("l_extendedprice") / 1000).alias("rlnOriginXAngst"))
    optics = table(spark, d, "part").select(F.col("p_partkey").alias("rlnOpticsGroup"), F.col("p_size").alias("rlnImagePixelSize"))
    b = B.bind(li, optics)
    joined = B.with_optics(li, optics, ["rlnImagePixelSize"], b.optics_key)
    return joined.select("l_orderkey", "l_linenumber", *[r6(c).alias(k) for k, c in zip(("px", "py", "pz"), b.positions(), strict=True)])


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS best, CAST(-(l_orderkey * 10 + l_linenumber) AS DOUBLE) AS first FROM lineitem")
def metric_columns(spark, d):
    li = table(spark, d, "lineitem").withColumn("_row", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumnRenamed("l_quantity", "rlnMaxValueProbDistribution")
    return li.select("l_orderkey", "l_linenumber", B.quality(li.columns, "auto", "_row").alias("best"), B.quality(li.columns, "first", "_row").alias("first"))


@query("""WITH c AS (SELECT l_partkey, l_suppkey, l_linenumber % 8 AS reasons FROM lineitem), f AS (SELECT l_partkey, count(*) AS n, count(*) FILTER (reasons <> 0) AS flagged, count(*) FILTER (reasons & 1 <> 0) AS position,
 count(*) FILTER (reasons & 2 <> 0) AS orientation, count(*) FILTER (reasons & 4 <> 0) AS flipped FROM c GROUP BY l_partkey) SELECT * FROM f ORDER BY flagged / n DESC, l_partkey LIMIT 5""")
def worst_filaments(spark, d):
    c = table(spark, d, "lineitem").withColumn("reasons", F.col("l_linenumber") % 8).withColumn("keep", F.col("reasons") == 0).withColumn("tube", F.lit(1))
    return M.filament_report(c, "l_partkey", "tube", 5).drop("tube")


# ------------------------------------------------------------ masks and curation
@query(LABELS + ", s AS (SELECT vol, label, count(*) AS size, CAST(max(z + y * 0.5) AS DOUBLE) AS peak FROM l GROUP BY 1, 2) SELECT vol, label, size, CASE WHEN label % 3 = 0 THEN 0 ELSE peak END AS peak FROM s")
def island_peaks(spark, d):
    v = F.when(F.col("label") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("z") + F.col("y") * 0.5)
    return V.islands(V.label(voxels(spark, d), "26").withColumn("v", v), "v").select("vol", "label", "size", "peak")


@query(f"WITH {VOX} SELECT vol, count(*) AS n FROM v WHERE z - 10 > 0 GROUP BY 1")
def mask_totals(spark, d):
    return V.binarise(voxels(spark, d).withColumn("v", F.col("z") - 10)).groupBy("vol").agg(F.count(F.lit(1)).alias("n"))


def _state(spark, d):
    return U.Curation.start(voxels(spark, d), GRID)


SIZES = LABELS + ", s AS (SELECT vol, label, count(*) AS size, CAST(floor((min(z) + max(z)) / 2) AS BIGINT) AS zc FROM l GROUP BY 1, 2)"


@query(SIZES + " SELECT vol, label FROM s WHERE (size < 2) <> (label % 2 = 0)")
def curation_toggle(spark, d):
    s = _state(spark, d).at_least(2).invert()
    return s.toggle(s.all().filter("label % 2 = 0")).chosen.select("vol", "label")


@query(SIZES + " SELECT vol, label FROM s WHERE zc BETWEEN 6 AND 12 AND size >= 2")
def curation_within(spark, d):
    return _state(spark, d).within(6, 12).at_least(2).chosen.select("vol", "label")


@query(SIZES + ", kept AS (SELECT vol, label, row_number() OVER (PARTITION BY vol ORDER BY label) AS new FROM s WHERE size >= 2) SELECT l.vol, l.z, l.y, l.x, kept.new AS label FROM l JOIN kept ON l.vol = kept.vol AND l.label = kept.label")
def curation_result(spark, d):
    return _state(spark, d).at_least(2).result().select("vol", "z", "y", "x", "label")


@query("SELECT lower(l_returnflag) || '_' || lower(l_linestatus) || '_x.star' AS path, CAST(2 AS BIGINT) AS times FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)")
def split_name_collisions(spark, d):
    li = table(spark, d, "lineitem").select(F.lower("l_returnflag").alias("a"), F.lower("l_linestatus").alias("b"), "l_orderkey")
    odd = li.select(F.concat_ws("_", "a", "b").alias("a"), F.lit("x").alias("b"), "l_orderkey").unionByName(li.select("a", F.concat_ws("_", "b", F.lit("x")).alias("b"), "l_orderkey"))
    return S.collisions(S.split_plan(odd, ["a", "b"], "l_orderkey"))


# ------------------------------------------------------------ order, lines and matrices
@query("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN user_id % 3 = 0 AND event_id % 2 = 0 THEN NULL ELSE event_id * 2.0 END AS stamp, CASE WHEN user_id % 6 = 0 THEN NULL ELSE date_trunc('second', ts) END AS t, 1000000 - event_id AS z FROM events),
m AS (SELECT user_id, bool_or(stamp IS NULL) AS ms, bool_or(t IS NULL) AS mt FROM e GROUP BY 1)
SELECT event_id, CAST(CASE WHEN NOT ms THEN stamp WHEN NOT mt THEN epoch(t) ELSE z END AS DOUBLE) AS key FROM e JOIN m USING (user_id)""")
def acquisition_order(spark, d):
    e = table(spark, d, "events").withColumns({
        "stamp": F.when((F.col("user_id") % 3 == 0) & (F.col("event_id") % 2 == 0), F.lit(None)).otherwise(F.col("event_id") * 2.0),
        "t": F.when(F.col("user_id") % 6 != 0, F.date_trunc("second", "ts")),
        "z": 1000000 - F.col("event_id"),
    })
    return e.select("event_id", L.acquisition_key("stamp", "t", "z", "user_id").alias("key"))


@query("""SELECT event_id AS i, printf('%12.7f%12.7f%12.7f%12.7f%12.3f%12.3f', cos(a), sin(a), -sin(a), cos(a), 0.5 - (cos(a) * u + sin(a) * v), 0.5 - (cos(a) * v - sin(a) * u)) AS line
FROM (SELECT event_id, radians(value) AS a, value * 3 / 2.5 - 49.5 AS u, (event_id % 97) / 2.5 - 79.5 AS v FROM events)""")
def transform_lines(spark, d):
    t = table(spark, d, "events").select(F.col("event_id").alias("i"), F.col("value").alias("axis"), (F.col("value") * 3).alias("x"), (F.col("event_id") % 97).alias("y"))
    return writers.transforms(t, 2.5, 100, 160)


@query("SELECT event_id AS i, printf('%9.2f', value + 1.5) AS angle, printf('%.6f', value / 100) AS weight FROM events")
def angle_and_weight_lines(spark, d):
    t = table(spark, d, "events").select(F.col("event_id").alias("i"), F.col("value").alias("angle"), (F.col("value") / 100).alias("scale"))
    return writers.tilt_angles(t, 1.5).withColumnRenamed("line", "angle").join(writers.view_weights(t).withColumnRenamed("line", "weight"), "i")


@query("""SELECT vec_id, round(cos(p) * cos(t) * cos(r) - sin(p) * sin(r), 6) AS m00, round(-cos(p) * cos(t) * sin(r) - sin(p) * cos(r), 6) AS m01, round(cos(p) * sin(t), 6) AS m02, round(-sin(t) * cos(r), 6) AS m20, round(cos(t), 6) AS m22
FROM (SELECT vec_id, radians(x) AS r, radians(y) AS t, radians(z) AS p FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y, CAST(embedding[3] AS DOUBLE) * 100 AS z FROM embeddings))""")
def euler_matrix(spark, d):
    from .functions import orient as O

    m = O.matrix_zyz(F.col("x"), F.col("y"), F.col("z"))
    return _points(spark, d).select(F.col("_row").alias("vec_id"), *[r6(m[i][j]).alias(f"m{i}{j}") for i, j in ((0, 0), (0, 1), (0, 2), (2, 0), (2, 2))])
