"""Every relational operator as a query over the test tables, with the same question in SQL.

Stand-ins: the first three components of ``embeddings`` are coordinates with ``label`` as tomogram; ``events`` are
views of a tilt series (a user) with ``value`` as angle or dose; ``lineitem`` and ``part`` are particles and optics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import ctf as C
from .functions import orient as O
from .functions import text as T
from .operators import dedup as D
from .operators import split as S
from .operators import stats as A
from .operators import tilts as L
from .operators import voxels as V
from .plans import binder as B

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


# ------------------------------------------------------------ particles
P_SQL = """p AS (SELECT vec_id AS id, label AS g, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
 CAST(embedding[3] AS DOUBLE) AS z, CAST(vec_id % 7 AS DOUBLE) AS q FROM embeddings)"""
DEDUP_SQL = f"""WITH {P_SQL},
n AS (SELECT a.id, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) AS d FROM p a JOIN p b ON a.g = b.g
 AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) < 0.1
 AND (b.q, b.x, b.y, b.z, b.id) > (a.q, a.x, a.y, a.z, a.id) GROUP BY a.id)"""


def particles(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("g"), *[e[i].cast("double").alias(c) for i, c in enumerate("xyz")], (F.col("vec_id") % 7).cast("double").alias("q")
    )


def marked(spark, d):
    return D.mark_duplicates(particles(spark, d), "g", ["x", "y", "z"], "q", "id", 0.1)


@query(DEDUP_SQL + " SELECT p.id, p.g, n.d IS NULL AS keep FROM p LEFT JOIN n ON p.id = n.id")
def dedup_keep(spark, d):
    return marked(spark, d).select("id", "g", "keep")


@query(DEDUP_SQL + " SELECT id, round(d, 6) AS removed_distance FROM n")
def dedup_removed_distance(spark, d):
    return marked(spark, d).filter("NOT keep").select("id", r6("removed_distance").alias("removed_distance"))


@query(DEDUP_SQL + " SELECT p.g, count(*) AS initial, count(n.id) AS removed, min(p.id) AS first_row FROM p LEFT JOIN n ON p.id = n.id GROUP BY p.g")
def dedup_group_stats(spark, d):
    return D.group_stats(marked(spark, d), "g", "id")


@query(DEDUP_SQL + " SELECT count(*) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(min(d), 6) AS least, round(max(d), 6) AS most, round(stddev_pop(d), 6) AS std FROM n")
def dedup_distance_summary(spark, d):
    out = D.distance_summary(marked(spark, d))
    return out.select("n", *[r6(c).alias(c) for c in out.columns if c != "n"])


@query("""WITH e AS (SELECT min(value) AS a, max(value) AS b FROM events), n AS (
 SELECT CAST(least(floor((value - a) * 50 / (b - a)), 49) AS INTEGER) AS bin, count(*) AS n FROM events, e WHERE value IS NOT NULL GROUP BY 1)
SELECT CAST(i.bin AS INTEGER) AS bin, coalesce(n.n, 0) AS n FROM range(50) i(bin) LEFT JOIN n ON i.bin = n.bin""")
def value_histogram(spark, d):
    return D.histogram(table(spark, d, "events"), "value", 50).select("bin", "n")


@query(f"WITH {P_SQL} SELECT a.id AS l_id, b.id AS r_id FROM p a JOIN p b ON a.g = b.g AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) < 0.08 AND a.id < b.id")
def distance_pairs(spark, d):
    p = particles(spark, d)
    return D.within_distance_join(p, p, ["g"], ["x", "y", "z"], 0.08).filter("l_id < r_id").select("l_id", "r_id")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first_row, concat(l_returnflag, '_', l_linestatus, '.star') AS path FROM lineitem GROUP BY ALL")
def split_group_counts(spark, d):
    li = table(spark, d, "lineitem").withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return S.split_plan(li, ["l_returnflag", "l_linestatus"], "row")


@query("""SELECT CAST(len(list_filter([10.0, 20.0, 30.0], lambda b: b <= l_quantity)) AS INTEGER) AS bin,
 CASE len(list_filter([10.0, 20.0, 30.0], lambda b: b <= l_quantity)) WHEN 0 THEN 'lt10' WHEN 1 THEN '10-20' WHEN 2 THEN '20-30' ELSE 'ge30' END AS label,
 count(*) AS n FROM lineitem GROUP BY ALL""")
def split_range_bins(spark, d):
    b = S.range_bin(F.col("l_quantity"), [10, 20, 30])
    return table(spark, d, "lineitem").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("label", S.range_label(F.col("bin"), [10, 20, 30]))


@query("""SELECT upper(l_returnflag) || '_' || CASE WHEN l_quantity < 25 THEN 'lt25' ELSE 'ge25' END AS label, count(*) AS n FROM lineitem GROUP BY ALL""")
def split_combo_labels(spark, d):
    li = table(spark, d, "lineitem").withColumn("range", S.range_label(S.range_bin(F.col("l_quantity"), [25]), [25]))
    return S.split_plan(li, ["l_returnflag", "range"], "l_orderkey", "").select(F.col("path").alias("label"), "n")


@query("""SELECT lower(l_returnflag) || '.star' AS path, count(*) AS times FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem) GROUP BY 1 HAVING count(*) > 1""")
def split_collisions(spark, d):
    li = table(spark, d, "lineitem").select(F.lower("l_returnflag").alias("a"), "l_linestatus", "l_orderkey")
    plan = S.split_plan(li, ["a", "l_linestatus"], "l_orderkey").withColumn("path", F.concat("a", F.lit(".star")))  # names by the first key only
    return S.collisions(plan)


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * (2.5 / 1.25) + 3.0, 6) AS rlnCoordinateX, round(l_quantity * (2.5 / 1.25) - 1.0, 6) AS wrpCoordinateY1,
 CAST(1.25 AS DOUBLE) AS rlnPixelSize FROM lineitem""")
def scale_coords(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("rlnCoordinateX"), F.col("l_quantity").alias("wrpCoordinateY1"), F.lit(2.5).alias("rlnPixelSize")
    )
    out = S.set_pixel_size(S.rescale(li, 2.5, 1.25, {"X": 3.0, "Y": -1.0}), 1.25)
    return out.withColumns({c: r6(c) for c in ("rlnCoordinateX", "wrpCoordinateY1")})


@query("SELECT array_to_string(list_transform(list_sort(list(DISTINCT CAST(p_size AS DOUBLE))), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS sizes FROM part")
def pixel_profile(spark, d):
    return S.pixel_profile(table(spark, d, "part"), "p_size").select(F.array_join(F.transform("sizes", lambda x: x.cast("long").cast("string")), ",").alias("sizes"))


@query("SELECT p_brand, count(*) FILTER (abs(p_size - 25.0) > 1e-8 + 1e-5 * 25) > 0 AS mismatched FROM part GROUP BY 1")
def pixel_mismatch(spark, d):
    sizes = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set(F.col("p_size").cast("double")).alias("s"))
    return sizes.select("p_brand", S.mismatch(F.col("s"), 25.0).alias("mismatched"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * p_size - l_tax, 6) AS pos FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def optics_join(spark, d):
    li = table(spark, d, "lineitem").withColumn("rlnOpticsGroup", F.col("l_partkey"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("rlnOpticsGroup"), "p_size")
    return B.with_optics(li, part, ["p_size"]).select("l_orderkey", "l_linenumber", r6(F.col("l_quantity") * F.col("p_size") - F.col("l_tax")).alias("pos"))


@query("SELECT o_custkey, count(*) AS n FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_nationkey < 12) GROUP BY 1")
def optics_missing(spark, d):
    c = table(spark, d, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"))
    return B.unknown_optics(table(spark, d, "orders"), c, "o_custkey")


# ------------------------------------------------------------ tilt series
@query("SELECT event_id, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS pre_dose FROM events")
def dose_accumulate(spark, d):
    return L.accumulated_dose(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", r6("pre_dose").alias("pre_dose"))


def views(spark, d):
    return table(spark, d, "events").select(
        "user_id", "event_id", (F.col("event_type") != "error").alias("in_log"), (F.col("value") - 50).alias("angle"), (F.col("event_id") % 101).cast("double").alias("dose"), "event_type", "ts", "value"
    )


VIEWS = "v AS (SELECT user_id, event_id, event_type <> 'error' AS in_log, value - 50 AS angle, CAST(event_id % 101 AS DOUBLE) AS dose, event_type, ts, value FROM events)"


@query(f"WITH {VIEWS} SELECT event_id, in_log AND row_number() OVER (PARTITION BY user_id, in_log ORDER BY dose, event_id) <= 5 AS keep FROM v")
def keep_n_lowest(spark, d):
    return L.keep_mask(views(spark, d), "user_id", "event_id", "in_log", "angle", "dose", n_tilts=5).select("event_id", "keep")


@query(f"""WITH {VIEWS}, z AS (SELECT user_id, arg_min(abs(angle), dose * 1e9 + event_id) AS a0 FROM v WHERE in_log GROUP BY 1)
SELECT event_id, coalesce(in_log AND abs(angle) <= a0 + 20, false) AS keep FROM v LEFT JOIN z USING (user_id)""")
def keep_max_tilt(spark, d):
    return L.keep_mask(views(spark, d), "user_id", "event_id", "in_log", "angle", "dose", max_tilt=20.0).select("event_id", "keep")


@query("SELECT event_id, true AS keep FROM events")
def keep_all(spark, d):
    return L.keep_mask(views(spark, d), "user_id", "event_id", "in_log", "angle", "dose", all_true=True).select("event_id", "keep")


@query(f"WITH {VIEWS} SELECT event_id, in_log AS keep FROM v")
def keep_in_log(spark, d):
    return L.keep_mask(views(spark, d), "user_id", "event_id", "in_log", "angle", "dose").select("event_id", "keep")


@query("""WITH d AS (SELECT DISTINCT user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS v FROM events),
i AS (SELECT *, v - row_number() OVER (PARTITION BY user_id ORDER BY v) AS k FROM d), r AS (SELECT user_id, min(v) AS a, max(v) AS b FROM i GROUP BY user_id, k)
SELECT user_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM r GROUP BY user_id""")
def view_ranges(spark, d):
    days = table(spark, d, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("1970-01-01")).alias("day"))
    return L.view_ranges(days, "user_id", "day")


@query(f"WITH {VIEWS} SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS new_index FROM v WHERE in_log")
def delete_tilts(spark, d):
    return L.delete_and_renumber(views(spark, d), "user_id", "event_id", ~F.col("in_log")).select("event_id", "new_index")


@query("SELECT user_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS id FROM events")
def renumber_views(spark, d):
    return L.contiguous(table(spark, d, "events"), "user_id", "event_type").select("user_id", "event_id", "id")


@query("""WITH c AS (SELECT event_type, count(*) AS n, corr(event_id, value) AS r FROM events GROUP BY 1)
SELECT event_type, n, round(CASE WHEN n > 2 THEN coalesce(r, 1) ELSE 1 END, 6) AS corr, CASE WHEN n > 2 AND r <= -0.8 THEN -1 ELSE 1 END AS sign FROM c""")
def angle_sign_corr(spark, d):
    e = table(spark, d, "events").withColumn("i", F.col("event_id").cast("double"))
    return L.angle_fit(e, "event_type", "i", "value").withColumn("corr", r6("corr"))


@query("""WITH s AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_quantity > 20 GROUP BY 1)
SELECT o_orderkey, round(coalesce(s.total, o_totalprice), 2) AS price FROM orders LEFT JOIN s ON o_orderkey = l_orderkey""")
def override_values(spark, d):
    s = table(spark, d, "lineitem").filter("l_quantity > 20").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))
    o = table(spark, d, "orders")
    out = L.override(F.array("o_totalprice"), F.array("total"))
    return o.join(s, o.o_orderkey == s.l_orderkey, "left").select("o_orderkey", F.round(out[0], 2).alias("price"))


@query(f"""WITH {VIEWS}, x AS (SELECT *, abs(dose - value) AS dd FROM v WHERE abs(dose - value) > 30)
SELECT user_id, count(*) AS n_changed, round(max(dd), 6) AS worst, arg_min(event_id, (-dd, event_id)) AS worst_index FROM x GROUP BY 1""")
def value_diffs(spark, d):
    return L.differences(views(spark, d), "user_id", "event_id", "dose", "value", 30.0).withColumn("worst", r6("worst"))


@query("""WITH a AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN role ELSE CAST(turn AS VARCHAR) END AS name FROM conversations),
b AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN role ELSE CAST(turn AS VARCHAR) END AS name FROM conversations),
n AS (SELECT x.conv_id, x.l = y.l AND len(x.l) = len(list_distinct(x.l)) AS by_name FROM (SELECT conv_id, list_sort(list(name)) AS l FROM a GROUP BY 1) x
 JOIN (SELECT conv_id, list_sort(list(name)) AS l FROM b GROUP BY 1) y ON x.conv_id = y.conv_id),
pa AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM a), pb AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM b)
SELECT pa.conv_id, pa.turn, n.by_name, pb.turn AS r_index FROM pa JOIN n ON pa.conv_id = n.conv_id
LEFT JOIN pb ON pb.conv_id = pa.conv_id AND ((n.by_name AND pb.name = pa.name) OR (NOT n.by_name AND pb.p = pa.p))""")
def name_match_or_position(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    name = lambda k: F.when(F.col("conv_id") % k == 0, F.col("role")).otherwise(F.col("turn").cast("string")).alias("name")
    a, b = c.select("conv_id", "turn", name(2)), c.select("conv_id", "turn", name(3))
    return L.match_by_name_or_position(a, b, "conv_id", "name", "turn").select("conv_id", "turn", "by_name", "r_index")


@query("""WITH s AS (SELECT user_id, coalesce(list_sort(list(DISTINCT event_id % 7) FILTER (event_type = 'click')), []) AS kept, coalesce(list_sort(list(DISTINCT event_id % 7) FILTER (event_type = 'view')), []) AS planned FROM events GROUP BY 1),
x AS (SELECT user_id, list_sort(list_filter(planned, lambda i: NOT list_contains(kept, i))) AS m, list_sort(list_filter(kept, lambda i: NOT list_contains(planned, i))) AS e FROM s)
SELECT user_id, array_to_string(m, ',') AS missing, array_to_string(e, ',') AS extra,
 CASE WHEN len(m) = 0 AND len(e) = 0 THEN 'ok' WHEN len(m) = 0 THEN 'needs deletion' WHEN len(e) = 0 THEN 'over-deleted' ELSE 'inconsistent' END AS verdict FROM x""")
def diagnosis_sets(spark, d):
    day = F.col("event_id") % 7
    s = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_type") == "click", day)).alias("k"), F.collect_set(F.when(F.col("event_type") == "view", day)).alias("p"))
    x = L.diagnosis(F.col("k"), F.col("p"), F.col("p"))
    join = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return s.select("user_id", join(x["missing"]).alias("missing"), join(x["extra"]).alias("extra"), x["verdict"].alias("verdict"))


@query("""WITH o AS (SELECT user_id, event_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n,
 lag(value, 1) OVER w AS p1, lag(value, 2) OVER w AS p2, lead(value, 1) OVER w AS n1, lead(value, 2) OVER w AS n2,
 (max(value) OVER (PARTITION BY user_id) - min(value) OVER (PARTITION BY user_id)) AS span FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id))
SELECT event_id, round(CASE WHEN n > 1 THEN (coalesce((p1 - value) * 2.0, 0) + coalesce((value - n1) * 2.0, 0) + coalesce((p2 - p1) / CAST(1.5 AS DOUBLE), 0) + coalesce((n1 - n2) / CAST(1.5 AS DOUBLE), 0))
 / (CASE WHEN p1 IS NOT NULL THEN 2.0 ELSE 0 END + CASE WHEN n1 IS NOT NULL THEN 2.0 ELSE 0 END + CASE WHEN p2 IS NOT NULL THEN 1 / CAST(1.5 AS DOUBLE) ELSE 0 END + CASE WHEN n2 IS NOT NULL THEN 1 / CAST(1.5 AS DOUBLE) ELSE 0 END)
 / nullif(span / (n - 1), 0) ELSE 1 END, 6) AS attenuation FROM o""")
def view_attenuation(spark, d):
    return L.view_attenuation(table(spark, d, "events"), "user_id", "value", "event_id").select("event_id", r6("attenuation").alias("attenuation"))


@query("""WITH s AS (SELECT event_id, user_id, ts, coalesce(sqrt((value - lag(value) OVER w) * (value - lag(value) OVER w)), 0) AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS arc FROM s""")
def arc_length(spark, d):
    return L.arc_length(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["value"]).select("event_id", r6("arc").alias("arc"))


@query("""WITH s AS (SELECT event_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS t
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(CASE WHEN i = 1 OR i = n OR n < 5 THEN value ELSE t / 5.0 END, 6) AS smooth FROM s""")
def moving_average(spark, d):
    return L.moving_average(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 5).select("event_id", r6("smooth").alias("smooth"))


# ------------------------------------------------------------ orientation and contrast
@query("""SELECT vec_id, round(degrees(acos(greatest(-1, least(1, z / n)))), 6) AS tilt, round(degrees(atan2(y, -x)), 6) AS psi FROM (
 SELECT vec_id, x, y, z, sqrt(x * x + y * y + z * z) AS n FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings))""")
def dipole_euler(spark, d):
    p = particles(spark, d)
    _, tilt, psi = O.dipole_euler(F.col("x"), F.col("y"), F.col("z"))
    return p.select(F.col("id").alias("vec_id"), r6(tilt).alias("tilt"), r6(psi).alias("psi"))


@query("""WITH t AS (SELECT vec_id, x / n AS x, y / n AS y, z / n AS z FROM (SELECT vec_id, x, y, z, sqrt(x * x + y * y + z * z) AS n FROM (
 SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)))
SELECT vec_id, round(CASE WHEN abs(z) <= 0.95 THEN 90.0 ELSE degrees(atan2(-x * z, y)) END, 6) AS rot, round(degrees(acos(z)), 6) AS tilt FROM t""")
def tangent_euler(spark, d):
    n = O.norm(F.col("x"), F.col("y"), F.col("z"))
    rot, tilt, _ = O.tangent_euler(F.col("x") / n, F.col("y") / n, F.col("z") / n)
    return particles(spark, d).select(F.col("id").alias("vec_id"), r6(rot).alias("rot"), r6(tilt).alias("tilt"))


@query("""SELECT vec_id, round(-cos(radians(p)) * sin(radians(t)), 6) AS ax, round(sin(radians(p)) * sin(radians(t)), 6) AS ay, round(cos(radians(t)), 6) AS az
FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 90 AS t, CAST(embedding[2] AS DOUBLE) * 180 AS p FROM embeddings)""")
def helical_axis(spark, d):
    ax = O.helical_axis(F.col("x") * 90, F.col("y") * 180)
    return particles(spark, d).select(F.col("id").alias("vec_id"), *[r6(c).alias(n) for c, n in zip(ax, ("ax", "ay", "az"), strict=True)])


_LAM = C.wavelength(300.0)


@query(f"""SELECT event_id, round(0.07 * cos(a) - sqrt(1 - 0.07 * 0.07) * sin(a), 6) AS ctf FROM (SELECT event_id,
 pi() * CAST({_LAM!r} AS DOUBLE) * (-(value / 50.0) * 1e4) * s * s + pi() * 0.5 * 2.7e7 * CAST({_LAM**3!r} AS DOUBLE) * s * s * s * s AS a FROM (SELECT event_id, value, (event_id % 100) / 1000.0 AS s FROM events))""")
def ctf_curve(spark, d):
    s = (F.col("event_id") % 100) / F.lit(1000.0)
    return table(spark, d, "events").select("event_id", r6(C.ctf(s, F.col("value") / 50.0)).alias("ctf"))


@query("""SELECT event_id, round(exp(-0.5 * value / ((0.24499 * pow(sqrt(greatest(s * s, 1e-8)), CAST(-1.6649 AS DOUBLE)) + 2.8141) * 0.8)), 6) AS weight
FROM (SELECT event_id, value, CAST((event_id % 100) / 500.0 AS DOUBLE) AS s FROM events)""")
def dose_curve(spark, d):
    s = (F.col("event_id") % 100) / F.lit(500.0)
    return table(spark, d, "events").select("event_id", r6(C.dose_curve(s, F.col("value"), 200.0)).alias("weight"))


@query(f"WITH {VIEWS} SELECT event_id, round(cos(radians(angle)) * CASE WHEN in_log THEN 1.0 ELSE 1e-4 END, 6) AS scale, round(-4.0 * dose, 6) AS bfactor FROM v")
def tilt_weight(spark, d):
    scale, b = C.tilt_weights(F.col("angle"), F.col("dose"), F.col("in_log"))
    return views(spark, d).select("event_id", r6(scale).alias("scale"), r6(b).alias("bfactor"))


# ------------------------------------------------------------ voxels
GRID = (20, 20, 20)
VOX = "v AS (SELECT DISTINCT label AS vol, CAST(greatest(0, least(19, floor(embedding[1] * 20 + 10))) AS BIGINT) AS z, CAST(greatest(0, least(19, floor(embedding[2] * 20 + 10))) AS BIGINT) AS y, CAST(greatest(0, least(19, floor(embedding[3] * 20 + 10))) AS BIGINT) AS x FROM embeddings)"


def voxels(spark, d):
    e = F.col("embedding")
    c = lambda i: F.greatest(F.lit(0), F.least(F.lit(19), F.floor(e[i] * 20 + 10))).cast("long")
    return table(spark, d, "embeddings").select(F.col("label").alias("vol"), c(0).alias("z"), c(1).alias("y"), c(2).alias("x")).distinct()


LABELS = f"""WITH RECURSIVE {VOX},
k AS (SELECT *, (z * 20 + y) * 20 + x AS k FROM v),
e AS (SELECT a.vol, a.k AS a, b.k AS b FROM k a JOIN k b ON a.vol = b.vol AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
r AS (SELECT vol, a, b FROM e UNION SELECT r.vol, r.a, e.b FROM r JOIN e ON r.vol = e.vol AND r.b = e.a),
m AS (SELECT vol, a AS k, min(b) AS root FROM r GROUP BY 1, 2),
l AS (SELECT k.vol, k.z, k.y, k.x, dense_rank() OVER (PARTITION BY k.vol ORDER BY m.root) AS label FROM k JOIN m ON k.vol = m.vol AND k.k = m.k)"""


@query(LABELS + " SELECT vol, z, y, x, label FROM l")
def components(spark, d):
    return V.label(voxels(spark, d), "26")


@query(LABELS + """ SELECT vol, label, count(*) AS size, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1,
 CAST(floor((min(z) + max(z)) / 2) AS BIGINT) AS zc, CAST(floor((min(y) + max(y)) / 2) AS BIGINT) AS yc, CAST(floor((min(x) + max(x)) / 2) AS BIGINT) AS xc FROM l GROUP BY 1, 2""")
def island_table(spark, d):
    return V.islands(V.label(voxels(spark, d), "26"))


@query(LABELS + """, s AS (SELECT vol, label, row_number() OVER (PARTITION BY vol ORDER BY label) AS new FROM (SELECT vol, label FROM l GROUP BY 1, 2 HAVING count(*) >= 3))
SELECT l.vol, l.z, l.y, l.x, s.new AS label FROM l JOIN s ON l.vol = s.vol AND l.label = s.label""")
def island_filter(spark, d):
    return V.keep_islands(V.label(voxels(spark, d), "26"), F.col("size") >= 3).select("vol", "z", "y", "x", "label")


def _mask(spark, d):
    return V.dilate_ball(voxels(spark, d), GRID, 2.0)


def _ball_sql(r2, r):
    return f"""m AS (SELECT DISTINCT v.vol, v.z + i AS z, v.y + j AS y, v.x + h AS x FROM v, range(-{r}, {r} + 1) a(i), range(-{r}, {r} + 1) b(j), range(-{r}, {r} + 1) c(h)
 WHERE i * i + j * j + h * h <= {r2} AND v.z + i BETWEEN 0 AND 19 AND v.y + j BETWEEN 0 AND 19 AND v.x + h BETWEEN 0 AND 19)"""


def _erode_sql(most, flat):
    return f"""WITH {VOX}, {_ball_sql(4, 2)},
o AS (SELECT i, j, h FROM range(-1, 2) a(i), range(-1, 2) b(j), range(-1, 2) c(h) WHERE abs(i) + abs(j) + abs(h) BETWEEN 1 AND {most} {'AND i = 0' if flat else ''}),
n AS (SELECT m.*, m.z + i AS nz, m.y + j AS ny, m.x + h AS nx FROM m, o WHERE m.z + i BETWEEN 0 AND 19 AND m.y + j BETWEEN 0 AND 19 AND m.x + h BETWEEN 0 AND 19),
b AS (SELECT DISTINCT n.vol, n.z, n.y, n.x FROM n LEFT JOIN m ON n.vol = m.vol AND n.nz = m.z AND n.ny = m.y AND n.nx = m.x WHERE m.vol IS NULL)
SELECT m.vol, m.z, m.y, m.x FROM m ANTI JOIN b ON m.vol = b.vol AND m.z = b.z AND m.y = b.y AND m.x = b.x"""


def _erosion(name, connectivity, most, flat):
    def f(spark, d):
        return V.erode(_mask(spark, d), GRID, connectivity)

    f.__name__ = name
    query(_erode_sql(most, flat))(f)


for _n, _c, _m, _f in (("erode_xy4", "xy4", 1, True), ("erode_xy8", "xy8", 2, True), ("erode_3d6", "6", 1, False), ("erode_3d18", "18", 2, False), ("erode_3d26", "26", 3, False)):
    _erosion(_n, _c, _m, _f)


@query(f"WITH {VOX}, {_ball_sql(4, 2)} SELECT vol, z, y, x FROM m")
def dilate_ball(spark, d):
    return _mask(spark, d)


@query(f"""WITH {VOX}, {_ball_sql(4, 2)},
n AS (SELECT m.*, m.z + i AS nz, m.y + j AS ny, m.x + h AS nx FROM m, range(-1, 2) a(i), range(-1, 2) b(j), range(-1, 2) c(h) WHERE i * i + j * j + h * h <= 1),
b AS (SELECT DISTINCT n.vol, n.z, n.y, n.x FROM n LEFT JOIN m ON n.vol = m.vol AND n.nz = m.z AND n.ny = m.y AND n.nx = m.x WHERE m.vol IS NULL)
SELECT m.vol, m.z, m.y, m.x FROM m ANTI JOIN b ON m.vol = b.vol AND m.z = b.z AND m.y = b.y AND m.x = b.x""")
def erode_ball(spark, d):
    return V.erode_ball(_mask(spark, d), GRID, 1.0)


@query(f"WITH {VOX} SELECT vol, z, y, x FROM v WHERE z BETWEEN 5 AND 12")
def crop_z(spark, d):
    return V.crop_z(voxels(spark, d), 5, 12)


@query("""WITH p AS (SELECT label AS vol, vec_id AS label, CAST(embedding[1] AS DOUBLE) * 20 + 10 AS cz, CAST(embedding[2] AS DOUBLE) * 20 + 10 AS cy, CAST(embedding[3] AS DOUBLE) * 20 + 10 AS cx FROM embeddings),
c AS (SELECT p.vol, p.label, z, y, x, (z - cz) * (z - cz) + (y - cy) * (y - cy) + (x - cx) * (x - cx) AS d2 FROM p, range(20) a(z), range(20) b(y), range(20) e(x)
 WHERE abs(z - cz) <= 2 AND abs(y - cy) <= 2 AND abs(x - cx) <= 2)
SELECT vol, z, y, x, arg_min(label, (d2, label)) AS label FROM c WHERE d2 <= 4 GROUP BY 1, 2, 3, 4""")
def paint_spheres(spark, d):
    e = F.col("embedding")
    p = table(spark, d, "embeddings").select(F.col("label").alias("vol"), F.col("vec_id").alias("label"), *[(e[i].cast("double") * 20 + 10).alias(f"c{c}") for i, c in enumerate("zyx")])
    out = V.paint_spheres(p, GRID, 2.0)
    return out.select("vol", *[F.col(c).cast("long").alias(c) for c in "zyx"], "label")


# ------------------------------------------------------------ statistics
@query("""SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS least, round(max(value), 6) AS most, round(quantile_cont(value, 0.01), 6) AS p1,
 round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(max(value) - min(value), 6) AS span FROM events GROUP BY 1""")
def robust_stats(spark, d):
    out = A.robust_stats(table(spark, d, "events"), "value", ["event_type"])
    return out.select("event_type", *[r6(c).alias(c) for c in out.columns if c != "event_type"])


SHELLS = "s AS (SELECT least(CAST(trunc(sqrt(CAST(embedding[1] AS DOUBLE) * CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE) * CAST(embedding[2] AS DOUBLE)) / 0.05) AS INTEGER), 7) AS shell, CAST(embedding[3] AS DOUBLE) AS a, CAST(embedding[4] AS DOUBLE) AS b, CAST(embedding[5] AS DOUBLE) AS c, CAST(embedding[6] AS DOUBLE) AS d FROM embeddings)"


def _shells(spark, d):
    e = F.col("embedding")
    x, y = e[0].cast("double"), e[1].cast("double")
    return table(spark, d, "embeddings").select(A.shell(F.sqrt(x * x + y * y), 0.05, 8).alias("shell"), *[e[i + 2].cast("double").alias(c) for i, c in enumerate("abcd")])


@query(f"WITH {SHELLS} SELECT shell, round(coalesce(sum(a * c + b * d) / nullif(sqrt(sum(a * a + b * b) * sum(c * c + d * d)), 0), 0), 6) AS fsc FROM s GROUP BY 1")
def shell_sums(spark, d):
    return A.shell_correlation(_shells(spark, d), "shell", "a", "b", "c", "d").withColumn("fsc", r6("fsc"))


@query(f"WITH {SHELLS}, m AS (SELECT shell, avg(a * a + b * b) AS p FROM s GROUP BY 1) SELECT CAST(i.i AS INTEGER) AS shell, round(coalesce(p, 0), 6) AS power FROM range(12) i(i) LEFT JOIN m ON m.shell = i.i")
def radial_profile(spark, d):
    s = _shells(spark, d).withColumn("p", F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    return A.radial_profile(s, "shell", "p", 12).withColumn("power", r6("power"))


@query("""WITH v AS (SELECT user_id, var_pop(value) AS variance FROM events GROUP BY 1) SELECT user_id, round(variance, 6) AS variance FROM v
ORDER BY v.variance DESC, user_id LIMIT (SELECT greatest(1, CAST(round_even(count(*) * 0.25, 0) AS BIGINT)) FROM v)""")
def top_variance_slices(spark, d):
    return A.top_variance(table(spark, d, "events"), "user_id", "value", 0.25).withColumn("variance", r6("variance"))


@query("""WITH c AS (SELECT event_type, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day, avg(value) AS m FROM events GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER p AS n, lag(m) OVER p AS pm, lag(day) OVER p AS pd FROM c WINDOW p AS (PARTITION BY event_type ORDER BY day)),
a AS (SELECT *, max(CASE WHEN m >= 50 AND n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up FROM w)
SELECT event_type, round(arg_min(pd + (pm - 50) / (pm - m) * (day - pd), day), 6) AS at FROM a WHERE up = 1 AND m < 50 AND pm >= 50 GROUP BY 1""")
def first_crossing(spark, d):
    c = table(spark, d, "events").groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("1970-01-01")).alias("day")).agg(F.avg("value").alias("m"))
    return A.first_crossing(c, ["event_type"], "day", "m", 50.0).withColumn("at", r6("at"))


# ------------------------------------------------------------ text
@query(r"""SELECT page_id, regexp_replace(n, '(\.mrc_\d+(?:\.\d+)?Apx\.mrc|\.mrc\.tomostar|\.tomostar|\.mrc)$', '') AS name FROM (SELECT page_id,
 'ts_' || page_id || CASE page_id % 5 WHEN 0 THEN '.mrc' WHEN 1 THEN '.tomostar' WHEN 2 THEN '.mrc.tomostar' WHEN 3 THEN '.mrc_10.00Apx.mrc' ELSE '.star' END AS n FROM pages)""")
def clean_name(spark, d):
    k = F.col("page_id") % 5
    end = F.when(k == 0, ".mrc").when(k == 1, ".tomostar").when(k == 2, ".mrc.tomostar").when(k == 3, ".mrc_10.00Apx.mrc").otherwise(".star")
    return table(spark, d, "pages").select("page_id", T.clean_name(F.concat(F.lit("ts_"), F.col("page_id").cast("string"), end)).alias("name"))


@query(r"""SELECT page_id, regexp_replace(list_extract(string_split(replace('D:\frames\' || url || '.eer.tif', '\', '/'), '/'), -1), '\.[^.]*$', '') AS stem FROM pages""")
def movie_stem(spark, d):
    return table(spark, d, "pages").select("page_id", T.stem(F.concat(F.lit("D:\\frames\\"), F.col("url"), F.lit(".eer.tif"))).alias("stem"))


@query(r"""SELECT event_id, regexp_replace(regexp_replace(printf('%.4f', value / 7 - 5), '\.?0+$', ''), '^-0$|^$', '0') AS num FROM events""")
def compact_float(spark, d):
    return table(spark, d, "events").select("event_id", T.compact_float(F.col("value") / 7 - 5).alias("num"))


from . import queries_more  # noqa: E402, F401  registers its queries
