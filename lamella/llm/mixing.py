"""Mixing sources to target weights (3): min-cost flow over membership patterns, then seeded selection."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import checkpoint, read

WORDS = r"[^ \t\n\x0B\f\r]+"
#: membership patterns the driver plans for one by one; they count combinations of sources, not documents
MAX_PATTERNS = 20_000


def share_targets(sizes: list[float], weights: list[float], total: float, cap: float) -> list[float]:
    """``total`` shared by weight; what exceeds ``cap`` times a size is shared again among the rest."""
    target, free = [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        left = total - sum(t for i, t in enumerate(target) if i not in set(free))
        whole = sum(weights[i] for i in free)
        part = {i: left * weights[i] / whole for i in free}
        over = [i for i in free if part[i] > cap * sizes[i]]
        for i in over or free:
            target[i] = cap * sizes[i] if over else part[i]
        if not over:
            break
        free = [i for i in free if i not in set(over)]
    return target


def min_cost_flow(arcs: list[tuple[int, int, float, float]], n: int, source: int, sink: int) -> list[float]:
    """Flow on each arc (tail, head, capacity, cost) of a maximum flow of least cost.

    Primal-dual: distances by cost from the source, then blocking flows along arcs on shortest paths, until none is left.
    The phases are as many as different path costs, not as many as paths.
    """
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        for x, y, z, v in ((a, b, c, w), (b, a, 0.0, -w)):
            out[x].append(len(to))
            to.append(y), cap.append(z), cost.append(v)
    eps = 1e-9 * max([1.0, *(c for _, _, c, _ in arcs)])
    while True:
        dist, queue, queued = [float("inf")] * n, [source], {source}
        dist[source] = 0.0
        for x in queue:
            queued.discard(x)
            for e in out[x]:
                if cap[e] > eps and dist[x] + cost[e] < dist[to[e]] - 1e-12:
                    dist[to[e]] = dist[x] + cost[e]
                    if to[e] not in queued:
                        queued.add(to[e])
                        queue.append(to[e])
        if dist[sink] == float("inf"):
            return [arcs[i][2] - cap[2 * i] for i in range(len(arcs))]
        tight = lambda x, e: cap[e] > eps and abs(dist[x] + cost[e] - dist[to[e]]) <= 1e-12  # noqa: B023, E731
        while True:  # blocking flows on the shortest arcs, level by level
            level, queue = [-1] * n, [source]
            level[source] = 0
            for x in queue:
                for e in out[x]:
                    if level[to[e]] < 0 and tight(x, e):
                        level[to[e]] = level[x] + 1
                        queue.append(to[e])
            if level[sink] < 0:
                break
            at, path, x = [0] * n, [], source
            while True:
                if x == sink:
                    push = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    path, x = [], source
                    continue
                while at[x] < len(out[x]):
                    e = out[x][at[x]]
                    if level[to[e]] == level[x] + 1 and tight(x, e):
                        break
                    at[x] += 1
                if at[x] < len(out[x]):
                    path.append(out[x][at[x]])
                    x = to[path[-1]]
                elif x == source:
                    break
                else:
                    x = to[path.pop() ^ 1]
                    at[x] += 1


@dataclass
class MixPlan:
    source_size: dict  # source -> words of the documents it holds
    target: dict  # source -> words aimed at
    take: dict  # pattern (tuple of sources) -> words to take


def plan_mix(patterns: dict[tuple, int], weights=(5, 2, 1), share: float = 1.5, repeats: int = 2) -> MixPlan:
    """Words to take from each membership pattern.

    Sources in code-point order, null last, get ``weights`` in turn and share ``share`` times all words, each at most
    ``repeats`` times its own. Each pattern sends words to its sources through ``repeats`` parallel arcs, the r-th
    copy of a word costing r, so that text is repeated only when no fresh text can fill a quota.
    """
    source_size: dict = {}
    for p, size in patterns.items():
        for s in p:
            source_size[s] = source_size.get(s, 0) + size
    sources = sorted(source_size, key=lambda s: (s is None, s or ""))
    sizes = [float(source_size[s]) for s in sources]
    aims = share_targets(
        sizes, [float(weights[i % len(weights)]) for i in range(len(sources))], share * sum(patterns.values()), float(repeats)
    )
    number = {s: 1 + i for i, s in enumerate(sources)}
    arcs, first = [], {}
    sink = 1 + len(sources) + len(patterns)
    for i, (p, size) in enumerate(patterns.items()):
        node = 1 + len(sources) + i
        first[p] = len(arcs)
        arcs += [(0, node, float(size), float(r)) for r in range(repeats)]
        arcs += [(node, number[s], float(repeats * size), 0.0) for s in p]
    arcs += [(number[s], sink, t, 0.0) for s, t in zip(sources, aims, strict=True)]
    flow = min_cost_flow(arcs, sink + 1, 0, sink)
    take = {p: sum(flow[k : k + repeats]) for p, k in first.items()}
    return MixPlan(source_size, dict(zip(sources, aims, strict=True)), take)


def _cut(sized: DataFrame, quota: DataFrame) -> DataFrame:
    """(pattern, cut): documents of a pattern with h < cut hold about ``rest`` words.

    Two histograms of 4096 hash buckets narrow each pattern down to one bucket in 2**24; only its documents are ordered.
    """
    def crossing(rows: DataFrame, bucket: Column, kept: list[str]) -> DataFrame:
        w = Window.partitionBy("pattern").orderBy("b")
        return (
            rows.groupBy("pattern", "rest", "before", *kept, bucket.alias("b"))
            .agg(F.sum("size").alias("s"))
            .withColumn("upto", F.col("before") + F.sum("s").over(w))
            .filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("s") < F.col("rest")))
            .select("pattern", "rest", (F.col("upto") - F.col("s")).alias("before"), *kept, "b")
        )

    rows = sized.filter(F.col("size") > 0).join(F.broadcast(quota), "pattern")
    one = checkpoint(crossing(rows.withColumn("before", F.lit(0).cast("long")), F.shiftright("h", 51), []))
    one = one.withColumnRenamed("b", "b1")
    rows = sized.filter(F.col("size") > 0).join(F.broadcast(one), "pattern").filter(F.shiftright("h", 51) == F.col("b1"))
    two = checkpoint(crossing(rows, F.shiftright("h", 39).bitwiseAND(4095), ["b1"])).withColumnRenamed("b", "b2")
    rows = (
        sized.filter(F.col("size") > 0)
        .join(F.broadcast(two), "pattern")
        .filter((F.shiftright("h", 51) == F.col("b1")) & (F.shiftright("h", 39).bitwiseAND(4095) == F.col("b2")))
        .groupBy("pattern", "rest", "before", "h")
        .agg(F.sum("size").alias("s"))
    )
    upto = F.col("before") + F.sum("s").over(Window.partitionBy("pattern").orderBy("h"))
    lowest = (F.col("b1") * 4096 + F.col("b2")) * 2**39
    taken = (
        rows.withColumn("upto", upto)
        .filter(F.col("upto") - F.col("s") / 2 <= F.col("rest"))  # the last one if that comes nearer
        .groupBy("pattern")
        .agg((F.max("h") + 1).alias("cut"))
    )
    return two.join(taken, "pattern", "left").select("pattern", F.coalesce("cut", lowest.cast("long")).alias("cut"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sources_col: str = "source",
    weights: tuple = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
    seed: int = 17,
) -> DataFrame:
    """All rows and columns of ``docs`` plus ``size``, ``source_size``, ``target`` and ``taken``.

    ``sources_col`` is a string, or an array of strings where sources overlap (``source_size`` and ``target`` are
    then those of the first in order). ``taken`` is the words of the row's text times its copies, 0 to ``repeats``.
    A null source is a source of its own, placed last; an empty array belongs to none and takes nothing. Null and
    empty texts have size 0. Copies are chosen by a hash of ``seed`` and the id, so reruns agree; rows that share an
    id get equal copies. Whole documents are taken: a source's words miss its target by at most half a document. Other
    columns stay, whatever their names, but for the four new ones, which are replaced. An empty table gives an empty table.

    Only one row per membership pattern reaches the driver. Of more than MAX_PATTERNS patterns, the largest are planned as
    they are and documents of the others count for their first source alone: all keep their place in the mix. Texts never
    move: the plan comes down to a hash threshold per pattern, which is joined back by broadcast.
    """
    kind = docs.schema[sources_col].dataType
    member = F.col(sources_col)
    pattern = F.array_sort(F.array_distinct(member)) if isinstance(kind, T.ArrayType) else F.array(member.cast("string"))
    json_of = lambda p: F.to_json(F.struct(p.alias("p")))
    whole = F.coalesce(pattern, F.array(F.lit(None).cast("string")))
    inside = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns], F.lit(0).alias("_end")).alias("row"),
        json_of(whole).alias("pattern"),
        json_of(F.slice(whole, 1, 1)).alias("first"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS)).cast("long").alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 1).alias("h"),
    )
    sized = checkpoint(inside.select("pattern", "first", "size", "h"))
    found = sized.groupBy("pattern", "first").agg(F.sum("size").alias("size"))
    largest = found.orderBy(F.desc("size"), "pattern").limit(MAX_PATTERNS + 1).collect()
    if len(largest) > MAX_PATTERNS:
        least = largest[-1]["size"]
        fold = lambda df: df.join(found.filter(F.col("size") <= least).select("pattern", F.lit(True).alias("fold")), "pattern", "left").withColumn("pattern", F.when(F.col("fold"), F.col("first")).otherwise(F.col("pattern"))).drop("fold")
        inside, sized = fold(inside), checkpoint(fold(sized))
    found = sized.groupBy("pattern").agg(F.sum("size").alias("size")).collect()  # MAX_PATTERNS rows, and one a source
    keys = {r["pattern"]: tuple(json.loads(r["pattern"]).get("p", [])) for r in found}
    plan = plan_mix({keys[r["pattern"]]: r["size"] for r in found}, weights, share, repeats)
    rows = []
    for r in sorted(found, key=lambda r: r["pattern"]):
        p, size = keys[r["pattern"]], r["size"]
        take = plan.take[p]
        base = min(repeats, int(take // size)) if size else 0
        lead = p[0] if p else None
        rows.append((r["pattern"], base, take - base * size if base < repeats else 0.0, plan.source_size.get(lead, 0), float(plan.target.get(lead, 0.0))))
    spark = docs.sparkSession
    quota = spark.createDataFrame(rows, "pattern string, base int, rest double, source_size long, target double")
    cuts = checkpoint(_cut(sized, quota.filter("rest > 0").select("pattern", "rest")))
    final = quota.join(cuts, "pattern", "left").select("pattern", "base", F.coalesce("cut", F.lit(0)).alias("cut"), "source_size", "target")
    new = ("size", "source_size", "target", "taken")
    taken = F.col("size") * (F.col("base") + (F.col("h") < F.col("cut")).cast("int"))
    return inside.join(F.broadcast(final), "pattern").select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns if c not in new], "size", "source_size", "target", taken.alias("taken")
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op3_mixing": op3_mixing}
ORACLE: dict[str, str] = {}
