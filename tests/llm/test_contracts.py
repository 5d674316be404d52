"""Cases at the edges: clashing names, repeated rows, hot groups, limits forced small, brute force beside the operators."""

import itertools
import math
import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

llm = pytest.importorskip("lamella.llm")
from lamella.llm import decontaminate, jaccard, knn, lines, mixing, packs, suffix_array, toxicity  # noqa: E402

from test_operators import expected_components  # noqa: E402


def test_lines_count_documents_not_rows(spark):
    line = "a line that is long enough to count, over forty"
    rows = [(1, line + f"\nx{i}") for i in range(5)] + [(2, line)] + [(10 + i, "another line of more than forty characters\nend") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_lines": F.lit("old"), "h1": F.lit(0), "one": F.lit(1), "keep": F.lit(2)})
    got = Counter((r["doc_id"], r["text"], r["n_dropped"]) for r in lines.dedup_lines(docs).collect())
    want = Counter((i, t if i < 10 or i == 14 else "end", int(10 <= i < 14)) for i, t in rows)
    assert got == want and lines.dedup_lines(docs).columns == ["doc_id", "text", "h1", "one", "keep", "n_lines", "n_dropped"]


def test_groups_of_every_size_link(spark, monkeypatch):
    """Copies beyond the blocks' sizes, and passages that 11, 12 and 13 texts hold."""
    for name, value in (("BLOCK", 8), ("PIVOTS", 2), ("STREAM", 16)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(8)
    new = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    rows = []
    for size in (2, 11, 12, 13, 16, 17, 40):
        base = new(60)
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(60)] = new(1)[0]
            rows.append(copy)
    for holders in (11, 12, 13, 30):  # a passage and a tail: linked or not by the tail's length
        passage = new(70)
        rows += [passage + new(rng.randrange(2, 30)) for _ in range(holders)]
        tails = [new(15) for _ in range(holders // 2)]
        rows += [passage + tails[k % len(tails)] + new(k % 3) for k in range(holders)]  # rare tails, each of a few texts
    rows = [(i, " ".join(w), None) for i, w in enumerate(rows)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_components(docs).collect()}
    assert got == expected_components(rows)


def test_decontamination_by_shuffle_equals_broadcast(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(rng.randrange(1, 14)) for _ in range(25)]
    rows = []
    for i in range(40):
        w = text(rng.randrange(0, 60))
        for k in rng.sample(range(25), rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = items[k]
        rows.append((i % 30 if i % 7 else None, " ".join(w)))
    rows += rows[:5] + [(50, None), (51, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_bad": F.lit(1), "w": F.lit(2), "_id": F.lit("x")})
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    run = lambda: sorted(map(str, decontaminate.contamination(docs, bench).collect()))
    small = run()
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert run() == small

    hits, found = Counter(), {}
    for i, t in rows:
        w, hit = (t or "").split(), set()
        for k, x in enumerate(items):
            for win in [x[j : j + 8] for j in range(max(len(x) - 7, 1))]:
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        found.setdefault(i, set()).add(str(k))
        hits[i] += len(hit)
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench).collect()}
    assert set(got) == set(hits) and any(r["contaminated"] for r in got.values())
    for i, r in got.items():
        items_of = sorted(found.get(i, set()))
        assert (r["n_hit"], r["items"], r["contaminated"]) == (hits[i], items_of, len(items_of) >= 2)
    left = decontaminate.drop_contaminated(docs, bench, min_items=1)
    assert left.columns == docs.columns and left.filter("doc_id = 51").count() == 1


def test_mixing_keeps_columns_of_any_name(spark, monkeypatch):
    names = ("_size", "_h", "_pattern", "base", "cut", "_ss", "_tg", "h", "pattern", "row", "first", "rest", "size")
    rows = [(i, "w " * (i % 5), ["a", "b", None][i % 3], *[7] * len(names)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 30 and all(r[n] == 7 for r in got for n in names if n != "size") and all(r["size"] == r["doc_id"] % 5 for r in got)
    many = spark.createDataFrame([(i, "w " * (1 + i % 3), [f"s{i % 4}", f"s{i % 7}"]) for i in range(60)], "doc_id long, text string, source array<string>")
    whole = mixing.mix_sources(many)
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 5)
    folded = mixing.mix_sources(many)
    for out in (whole, folded):
        assert out.count() == 60 and out.filter("taken > 2 * size").count() == 0
    assert folded.agg(F.sum("taken")).first()[0] > 0


def test_flow_is_maximal_and_cheapest():
    """Against successive cheapest paths, one unit at a time."""
    rng = random.Random(6)
    for _ in range(30):
        n = rng.randrange(4, 9)
        arcs = [(rng.randrange(n), rng.randrange(n), float(rng.randrange(1, 5)), float(rng.randrange(4))) for _ in range(3 * n)]
        arcs = [a for a in arcs if a[0] != a[1]]
        flow = mixing.min_cost_flow(arcs, n, 0, n - 1)
        cap, total, cost = [[c, 0.0] for _, _, c, _ in arcs], 0, 0.0
        while True:
            dist, via = [math.inf] * n, [None] * n
            dist[0] = 0.0
            for _ in range(n):
                for i, (a, b, _, w) in enumerate(arcs):
                    for x, y, side, v in ((a, b, 0, w), (b, a, 1, -w)):
                        if cap[i][side] > 0 and dist[x] + v < dist[y] - 1e-9:
                            dist[y], via[y] = dist[x] + v, (x, i, side)
            if dist[n - 1] == math.inf:
                break
            x = n - 1
            while x:
                y, i, side = via[x]
                cap[i][side] -= 1
                cap[i][1 - side] += 1
                x = y
            total, cost = total + 1, cost + dist[n - 1]
        out = sum(f for f, (a, _, _, _) in zip(flow, arcs) if a == 0) - sum(f for f, (_, b, _, _) in zip(flow, arcs) if b == 0)
        assert out == pytest.approx(total) and sum(f * a[3] for f, a in zip(flow, arcs)) == pytest.approx(cost)


def test_top_k_rejects_what_it_cannot_score(spark):
    rows = [(0, [1.0, 2.0]), (1, []), (2, [3.0]), (3, [3.0]), (3, [3.0]), (0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in knn.top_k(df, F.col("vec_id") == 0).collect())
    assert got == [(0, 1, 2, 256 * 768), (0, 2, 3, 256 * 768), (0, 3, 3, 256 * 768), (0, 4, 1, 0)]
    with pytest.raises(ValueError):
        knn.top_k(df.unionByName(spark.createDataFrame([(9, [1e20, 0.0])], df.schema)), F.col("vec_id") == 0)


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(3)
    trigram = np.log(rng.dirichlet(np.ones(27), (27, 27)))
    r = toxicity.Restorer(trigram)
    t = trigram.tolist()

    def price(parts):
        s, x, y = 0.0, 26, 26
        for letters, cost in parts:
            s -= cost
            for ch in " " if letters is None else letters:
                z = 26 if ch == " " else ord(ch) - 97
                s += t[x][y][z] if z != 26 or y != 26 else 0.0
                x, y = (26, 26) if z == 26 else (y, z)
        return s + (t[x][y][26] if y != 26 else 0.0)

    for token in ("1d10t", "s.c_um", "aab0", "pp!xx1", "@@b-c", "z9", "a..b"):
        runs = [(c, len(list(g))) for c, g in itertools.groupby(token)]
        every = itertools.product(*[r.readings(c, n) for c, n in runs])
        best = max(every, key=price)
        read = r.word(token)
        assert read == "".join(" " if x is None else x for x, _ in best)


def test_toxicity_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (1, "you idiot"), (2, None), (3, "x " * 5000 + "idiot"), (None, "fine words")], "doc_id long, text string").withColumns({"score": F.lit("old"), "y": F.lit(1)})
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels))
    got = out.collect()
    assert out.columns == ["doc_id", "text", "y", "score"] and len(got) == 5 and len({r["score"] for r in got if r["doc_id"] == 1}) == 1


def test_suffix_sorting_of_repeats_and_ties(spark):
    piece = "0123456789" * 12
    rows = [(3, piece), (3, piece), (1, "ab" + piece[:70] + "yz"), (5, piece[:49]), (None, piece), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit(0), "uid": F.lit(1)})
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_array.drop_repeated_bytes(docs).collect())
    def removed(i, t):
        first = [x for j, x in rows if x and j is not None and (i is None or j < i)]
        gone = set()
        for k in range(len(t) - 49):
            if any(t[k : k + 50] in x for x in first):
                gone |= set(range(k, k + 50))
        return len(gone), sum(k - 1 not in gone for k in gone)
    assert got == Counter((i, len(t or ""), *removed(i, t or "")) for i, t in rows)


def test_suffix_sorting_holds_one_slice_of_a_bucket():
    """Pairs of spans that differ in their first byte: all strings but the first of the larger id's span are repeats."""
    n, size, rng = 32_000, 62, np.random.default_rng(8)
    text = np.repeat(rng.integers(97, 123, (n // 2, size)).astype(np.uint8), 2, axis=0)
    text[1::2, 0] = 65
    key = np.repeat(np.sort(rng.integers(0, 2**63, n // 2).astype(np.uint64)), 2)
    got = [(key[h::2], (np.arange(h, n, 2), np.full(n // 2, size, np.uint8), text[h::2].tobytes())) for h in (0, 1)]
    tracemalloc.start()
    try:
        small, large = suffix_array._judge_suffixes(50)(got)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (small == 0).all() and (large == (1 << 13) - 2).all()
    assert peak < 60e6  # 2 MB of spans


def test_suffix_array_frees_each_round_before_the_next(spark, monkeypatch):
    """Releases after the first, which sees the sum that buckets are counted by, leave no shuffle files of the call behind."""
    files = lambda: set(re.findall(r"shuffle_(\d+)_", spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ")))
    old, left, free = files(), [], packs.release

    def release(session):
        free(session)
        for _ in range(20):  # files go in the background
            if files() <= old:
                break
            time.sleep(0.1)
        left.append(files() - old)

    for module in (packs, suffix_array):
        monkeypatch.setattr(module, "release", release, raising=False)
    text = " ".join(f"w{i * i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{i} {text[i:]}") for i in range(12)], "doc_id long, text string")
    assert suffix_array.drop_repeated_bytes(docs).filter("n_removed > 0").count() == 11
    assert left[1:] == [set()] * 4


def test_pipeline_of_an_empty_table_and_odd_names(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    kind = "doc_id long, text string, lang string, source string, n_chars long, _h1 int, score string, n_lines int, row int, _bad int, base int"
    rows = [(1, "a fine text of some words that stays as it is", "en", "a", 45, 1, "s", 2, 3, 4, 5), (None, None, None, None, None, 1, "s", 2, 3, 4, 5)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some in ([], rows):
        docs = spark.createDataFrame(some, kind)
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name == "mixing":
                assert set(docs.columns) <= set(out.columns) and out.count() == len(some) // 2
            else:
                assert out.columns == docs.columns and out.count() == len(some)
                assert all((r["score"], r["n_lines"], r["row"], r["_bad"], r["base"]) == ("s", 2, 3, 4, 5) for r in out.collect())


def _late(spark, n, last, where="true"):
    """Ids below n; the ``last`` of them by the hash that once chose which 30,000 labelled rows training reads."""
    ids = [r[0] for r in spark.range(n).filter(where).orderBy(F.xxhash64(F.lit(5), "id"), "id").collect()]
    assert len(ids) - last > 30_000
    return set(ids[-last:])


def test_toxicity_learns_from_every_labelled_row(spark):
    n, toxic = 30_200, _late(spark, 30_200, 60)
    docs = spark.createDataFrame([(i, f"scumbag w{i % 97}" if i in toxic else f"fine w{i % 97}") for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in range(n)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, model).select("doc_id", "score").collect()
    assert {r["doc_id"] for r in got if r["score"] >= 0.3} == toxic


def test_toxicity_training_against_plain_counts(spark):
    rows = [(i, f"you 1d10t number {i}" if i % 3 == 0 else f"good number {i}") for i in range(60)] + [(60, "ab"), (61, ""), (62, None), (62, "cd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = [(i, int(i % 3 == 0)) for i in range(64)] + [(0, 1)]
    labels = spark.createDataFrame(known, "doc_id long, toxic int")
    models = [toxicity.train_toxicity(x, labels) for x in (docs.repartition(5), docs.coalesce(1).orderBy(F.desc("doc_id")))]
    assert np.array_equal(models[0].trigram, models[1].trigram) and np.array_equal(models[0].hashes, models[1].hashes)
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].link == models[1].link

    counts = np.full((27, 27, 27), 0.02)
    held = [(i, t or "", y) for i, t in rows for j, y in known if i == j]
    for _, t, _ in held:
        a = b = 26
        for z in [ord(c) - 97 if "a" <= c <= "z" else 26 for c in t] + [26]:
            if (b, z) != (26, 26):
                counts[a, b, z] += 1
            a, b = (26, 26) if z == 26 else (b, z)
    bigram = counts.sum(0)
    smooth = counts + 5 * (bigram / bigram.sum(-1, keepdims=True))[None]
    assert np.allclose(models[0].trigram, np.log(smooth / smooth.sum(-1, keepdims=True)))

    by = {}
    for _, t, y in held:
        for h in set(toxicity.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), toxicity.Restorer(models[0].trigram))[2].tolist()):
            by.setdefault(h, [0, 0])[y] += 1
    all1 = sum(y for *_, y in held)
    odds = {h: math.log((p + 0.5) / (q + 0.5)) - math.log((all1 + 1) / (len(held) - all1 + 1)) - toxicity.CONFIDENCE * math.sqrt(1 / (p + 0.5) + 1 / (q + 0.5)) for h, (q, p) in by.items() if p >= 3}
    odds = {h: w for h, w in odds.items() if w > 0.5}
    assert dict(zip(models[0].hashes.tolist(), models[0].weights[:, 0].tolist(), strict=True)) == pytest.approx(odds)


def test_toxicity_link_over_repeated_rows(spark):
    rng = np.random.default_rng(4)
    m, s = rng.integers(0, 4, 300) / 2, rng.integers(0, 5, 300).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(2 - m - np.log1p(s)))).astype(int)
    points = spark.createDataFrame(list(zip(m.tolist(), s.tolist(), y.tolist(), strict=True)), "m double, s double, y int").groupBy("m", "s", "y").agg(F.count(F.lit(1)).alias("n"))
    z, b = np.stack([np.ones(300), m, np.log1p(s)], 1), np.array(toxicity._fit_link(points))
    slope = z.T @ (y - 1 / (1 + np.exp(-z @ b))) - 0.05 * b * [0, 1, 1]
    assert np.abs(slope).max() < 1e-5


def test_pipeline_toxicity_learns_from_every_labelled_row(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    learnt = "pmod(crc32(cast(cast(id AS string) AS binary)), 4) <> 2"
    n, toxic = 40_400, _late(spark, 40_400, 60, learnt)
    docs = spark.createDataFrame([(f"w{i % 97}", i, f"scumbag w{i % 97}" if i in toxic else f"fine w{i % 97}") for i in range(n)], "lang string, doc_id long, text string")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(n)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = pipeline.toxicity(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} == {tuple(r) for r in docs.collect() if r["doc_id"] not in toxic}


def test_pipeline_toxicity_sends_texts_once_and_by_the_chunk(spark, tmp_path, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    text = "some plain words " * 8_000
    rows = [(i, None if i == 3 else "" if i == 4 else f"{i} {text}", i * 2) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").coalesce(1)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, cls = [], type(docs)
    whole = cls.mapInArrow

    def watched(self, func, schema, *rest):
        def sizes(batches):
            for out in func(batches):
                yield pa.RecordBatch.from_arrays([pa.array([out.num_rows]), pa.array([out.nbytes])], names=["rows", "bytes"])

        if "score" in getattr(schema, "names", []):
            seen.append((self.columns, self.schema, whole(self, sizes, "rows long, bytes long").collect()))
        return whole(self, func, schema, *rest)

    monkeypatch.setattr(cls, "mapInArrow", watched)
    out = pipeline.toxicity(spark, docs, str(tmp_path))
    assert Counter(tuple(r) for r in out.collect()) == Counter(rows) and out.columns == docs.columns
    ((columns, schema, batches),) = seen
    assert columns == ["row", "text"] and "text" not in schema["row"].dataType.names
    assert sum(r["rows"] for r in batches) == len(rows) and max(r["bytes"] for r in batches) < (1 << 20) + 200_000
