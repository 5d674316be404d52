"""Each operator against brute force on a fixture with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

llm = pytest.importorskip("lamella.llm")
from lamella.llm import decontaminate, jaccard, knn, licenses, lines, lm_score, mixing, recompress, suffix_array, toxicity  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, source string, n long, c long, _id string, size string, hh int, w string, t string"


def words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", x or "")


def texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    out = [None, "", "  \n ", "one", "One two three", "one two three"]
    passage, line = make(60), "  A Line that many documents share, and longer than forty. "
    for i in range(40):
        body = make(rng.randint(20, 150)).split(" ")
        if i % 3 == 0:
            body[10:10] = passage.split(" ")
        text = " ".join(body)
        if i % 2 == 0:
            text += "\n" + line + "\n" + make(5)
        out.append(text)
    base = make(200).split(" ")
    for i in range(12):
        copy = list(base)
        copy[rng.randrange(200)] = f"edit{i}"
        out.append(" ".join(copy))
    out += [out[10], out[10], out[20].upper(), "x " * 300, "ab" * 200, make(6000)]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i, t, [None, "b", "a"][i % 3]) for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, "k", "z", 3, "w", "t") for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_lines(docs, rows, empty):
    strip = " \t\n\x0b\x0c\r"
    held = defaultdict(set)
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            k = x.strip(strip).translate(LOWER)
            if len(k) >= 40:
                held[k].add(i)
    got = by_id(lines.dedup_lines(docs))
    for i, t, _ in rows:
        parts = (t or "").split("\n")
        gone = [len(h := held[x.strip(strip).translate(LOWER)]) >= 5 and max(h) != i for x in parts]
        assert got[i]["text"] == "\n".join(x for x, g in zip(parts, gone) if not g)
        assert (got[i]["n_lines"], got[i]["n_dropped"]) == (len(parts), sum(gone))
        assert got[i]["hh"] == 3 and got[i]["_id"] == "k"
    assert lines.dedup_lines(empty).count() == 0


def test_recompression(docs, rows, empty):
    count = Counter(tuple(w[i : i + 35]) for _, t, _ in rows for w in [words(t)] for i in range(len(w) - 34))
    got = by_id(recompress.drop_repeats(docs))
    removed = 0
    for i, t, _ in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 34):
            if count[tuple(w[j : j + 35])] > 1:
                gone[j : j + 35] = [True] * 35
        removed += sum(gone)
        assert got[i]["text"] == " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), sum(gone))
    assert removed > 500
    assert recompress.drop_repeats(empty).count() == 0


def test_suffix_array(docs, rows, empty):
    first = {}
    raw = [(i, (t or "").encode()) for i, t, _ in rows]
    for i, x in raw:
        for j in range(len(x) - 49):
            first.setdefault(x[j : j + 50], i)
    got = by_id(suffix_array.drop_repeated_bytes(docs))
    for i, x in raw:
        cover = np.zeros(len(x) + 1, int)
        for j in range(len(x) - 49):
            if first[x[j : j + 50]] < i:
                cover[j] += 1
                cover[j + 50] -= 1
        gone = np.cumsum(cover)[: len(x)] > 0
        assert bytes(got[i]["kept"]) == np.frombuffer(x, np.uint8)[~gone].tobytes()
        assert got[i]["n_spans"] == int((gone & ~np.r_[False, gone[:-1]][: len(gone)]).sum())
    assert suffix_array.drop_repeated_bytes(empty).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 250])
def test_two_stage_order(letters):
    rng = np.random.default_rng(letters)
    for n in (1, 2, 60, 400):
        t = rng.integers(0, letters, n).astype(np.uint8)
        order = suffix_array.two_stage_suffix_order(t, 56)
        cut = [t.tobytes()[i : i + 56] for i in order]
        assert sorted(order) == list(range(n)) and cut == sorted(cut)


def expected_components(rows):
    sets = []
    for _, t, _ in rows:
        w = words((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return {i: (len(s), rows[r][0]) for (i, _, _), s, r in zip(rows, sets, root)}


def test_jaccard(docs, rows, empty):
    got = by_id(jaccard.link_components(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == expected_components(rows)
    assert jaccard.link_components(empty).count() == 0


def test_jaccard_keys_follow_shingles():
    assert [jaccard.key_width(n, 24) for n in (0, 10**8, 10**9, 10**11, 10**14)] == [3, 4, 4, 5, 6]
    assert all(n / 64 / 256 ** jaccard.key_width(n, 64) <= 0.5 for n in (10**k for k in range(17)))


def test_jaccard_near_limit(spark):
    """Edited copies on both sides of the limit, at sizes from tiny to some hundred words."""
    rng = random.Random(5)
    rows = []
    for n in (5, 6, 7, 8, 9, 12, 20, 40, 90, 300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for edits in range(0, max(2, n // 12)):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy + [f"t{rng.randrange(99)}"] * (edits % 2)), None))
    got = by_id(jaccard.link_components(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == expected_components(rows)


def test_decontamination(spark, docs, rows, empty):
    def bench_words(x):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOWER))

    some = [" ".join(words(rows[k][1])[3:20]) for k in (8, 9, 12)] + ["one two", None, "", "One, TWO; three"]
    items = spark.createDataFrame(list(enumerate(some)), "item_id long, text string")
    got = by_id(decontaminate.contamination(docs, items))
    for i, t, _ in rows:
        w, hit, found = bench_words(t), set(), set()
        for k, x in enumerate(some):
            v = bench_words(x)
            for j in range(max(len(v) - 7, 1) if v else 0):
                win = v[j : j + 8]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        found.add(str(k))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(found))
    assert decontaminate.contamination(empty, items).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(docs, items.limit(0)).collect()} == {0}


def test_top_k(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.2, (130, 6)).astype(np.float32)
    x[5] = x[6] = x[7] = x[8]  # ties
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(200, None, 0), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (202, [float("inf")] + [0.0] * 5, 0), (None, [0.0] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    y = np.floor(256 * x.astype(float)).astype(int)
    for pivots in (1, 9):
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in knn.top_k(df, F.col("vec_id") % 10 == 0, pivots=pivots).collect()}
        want = {}
        for q in range(0, 130, 10):
            best = sorted((-int(y[q] @ y[v]), v) for v in range(130) if v != q)[:5]
            want |= {(q, k): (v, -s) for k, (s, v) in enumerate(best, 1)}
        assert got == want
    assert knn.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_top_k_repeated_query_id(spark):
    rows = [(50, [1.0, 0.0])] * 6 + [(i, [230 / 256, 0.0]) for i in range(1, 6)] + [(60 + i, [-1.0, i / 256]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for pivots in (1, 2, 7, 64):
        got = [(r["rank"], r["vec_id"], r["score"]) for r in knn.top_k(df, F.col("vec_id") == 50, pivots=pivots).collect()]
        assert sorted(got) == [(i, i, 256 * 230) for i in range(1, 6)]


def test_lm_base_and_probability(docs, rows, empty):
    learn = F.col("doc_id") % 3 != 0
    got = by_id(lm_score.score_texts(docs, learn))
    tokens = {i: [*words((t or "").translate(LOWER)), None] for i, t, _ in rows}
    c = Counter(x for i, w in tokens.items() if i % 3 for x in w)
    n, v = sum(c.values()), len(c)
    for i, w in tokens.items():
        assert got[i]["n_tokens"] == len(w) and got[i]["train_tokens"] == n and got[i]["n_known"] == sum(c[x] > 0 for x in w)
        assert math.isclose(got[i]["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert got[i]["score"] <= 0
    assert lm_score.score_texts(empty, learn).count() == 0
    assert all(math.isfinite(r["score"]) for r in lm_score.score_texts(docs, F.lit(False)).collect())


def test_lm_score_from_first_principles(spark):
    """Counts, expectation, marginals and the Dirichlet-multinomial again, segmentations being enumerated one by one."""
    pieces = {b" ab": 0.2, b" a": 0.1, b"ba": 0.2, b"b": 0.1, b"a": 0.1, b"abab": 0.2, b" abc": 0.1}
    name = lambda x: int(lm_score.spans_hash(lm_score.prefix_sums(lm_score.BYTE[np.frombuffer(x, np.uint8)], lm_score.P1), np.array([0]), np.array([len(x)]), lm_score.P1)[0])
    single = [bytes([b]) for b in range(256)]
    order = [*pieces, *single]
    logs = np.log(np.r_[list(pieces.values()), np.full(256, 1e-9)])
    logs -= np.log(np.exp(logs).sum())
    hashes = np.array([name(x) for x in pieces] + [name(x) ^ 5 for x in single], np.uint64)

    def ways(x: bytes):
        if not x:
            yield []
        for k in range(1, len(x) + 1):
            if x[:k] in pieces:
                yield from ([order.index(x[:k])] + w for w in ways(x[k:]))
            elif k == 1:
                yield from ([len(pieces) + x[0]] + w for w in ways(x[1:]))

    prob = lambda x, p: sum(math.prod(p[i] for i in w) for w in ways(x))
    texts = ["abab abcab", "ABAB abab baba", None, "abcabc zzzz", "abab qqqq abcab abab", "neverseen abab"]
    learnt = [0, 1, 2, 3]
    split = [[*words((t or "").lower()), None] for t in texts]
    c = Counter(x for i in learnt for x in split[i])
    first = trained = np.exp(logs)
    for _ in range(lm_score.ITERATIONS):
        counts = np.zeros(len(order))
        for w in {x for x in c if x}:
            whole = prob(b" " + w.encode(), trained)
            for way in ways(b" " + w.encode()):
                np.add.at(counts, way, math.prod(trained[i] for i in way) / whole)
        prior = counts + 1e-3 * counts.sum() * first
        trained = counts + 1e-2 * counts.sum() * prior / prior.sum()
        trained /= trained.sum()
    ends, types = len(learnt), {x: k for x, k in c.items() if x}
    n, v = sum(c.values()), len(c)
    once, twice = (sum(k == m for k in types.values()) for m in (1, 2))
    d = min(max(once / (once + 2 * twice), 0.1), 0.95)
    end_share = (ends + 1) / (n + 2)
    back = lambda x: end_share if x is None else prob(b" " + x.encode(), trained) * (1 - end_share)
    every = lambda x, less=0: max(c[x] - less - d, 0) / n + d * v / n * back(x)
    p = lambda x, less=0: max(c[x] - less - d, 0) / n + d * v / n * every(x, less)

    def score(w, a, less=False):
        out = -sum(math.log(a + i) for i in range(len(w)))
        for x, k in Counter(w).items():
            q = a * p(x, k if less else 0)
            out += sum(math.log(q + i) for i in range(k))
        return out

    best = max(lm_score.GRID, key=lambda a: sum(score(split[i], a, True) for i in learnt))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in lm_score.score_texts(docs, F.col("doc_id") < 4, pieces=(hashes, logs)).collect()}
    assert {r["concentration"] for r in got.values()} == {best}
    for i, w in enumerate(split):
        want = (score(w, best) + math.log((ends + 1) / (ends + lm_score.CLASSES))) / math.log(10)
        assert math.isclose(got[i]["score"], want, rel_tol=1e-5), (i, got[i], want)


def test_lattice_sums_all_segmentations():
    hashes, logs = lm_score.vocabulary_pieces()
    lattice = lm_score.Lattice(hashes, logs)
    name = dict(zip(hashes[: lattice.pieces].tolist(), logs.tolist()))

    def total(x: bytes) -> float:
        if not x:
            return 1.0
        out = 0.0
        for k in range(1, min(16, len(x)) + 1):
            h = int(lm_score.spans_hash(lm_score.prefix_sums(lm_score.BYTE[np.frombuffer(x[:k], np.uint8)], lm_score.P1), np.array([0]), np.array([k]), lm_score.P1)[0])
            p = name.get(h, logs[lattice.pieces + x[0]] if k == 1 else None)
            out += math.exp(p) * total(x[k:]) if p is not None else 0.0
        return out

    for word in (b" the", b" zq\xc3\xa9", b" tion", b" abab"):
        got, counts = lattice.words(np.frombuffer(word, np.uint8), np.array([0, len(word)]), np.ones((1, 1)))
        assert math.isclose(got[0], math.log(total(word)), rel_tol=1e-9)
    x = np.array([1e-9, 0.3, 5.0, 2e5])
    for n in (0, 1, 2, 7, 300):
        want = [math.lgamma(v + n) - math.lgamma(v) for v in x]
        assert np.allclose(lm_score.rising(x, np.full(4, n)), want, rtol=1e-6, atol=1e-9)


def test_lattice_of_long_words():
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    known = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i)))
    long = max((x.strip("▁").lower().encode() for x in known), key=len)
    hashes, logs = lm_score.vocabulary_pieces()
    lattice = lm_score.Lattice(hashes, logs)
    number = {h: i for i, h in enumerate(hashes[: lattice.pieces].tolist())}

    def marginal(x):
        buf, alpha = np.frombuffer(x, np.uint8), [0.0] + [-math.inf] * len(x)
        sums = lm_score.prefix_sums(lm_score.BYTE[buf], lm_score.P1)
        for i in range(len(x)):
            for k in range(1, len(x) - i + 1):
                p = number.get(int(lm_score.spans_hash(sums, np.array([i]), np.array([i + k]), lm_score.P1)[0]), lattice.pieces + x[i] if k == 1 else None)
                if p is not None:
                    alpha[i + k] = np.logaddexp(alpha[i + k], alpha[i] + logs[p])
        return alpha[-1]

    some = [b" " + long, b" the", b" " + "日本語の文章は空白なしで書かれる".encode() * 4, b" " + b"x" * 55 + long * 3, b" " + b"thing" * 13, b" " + b"ab" * 31 + b"a"]
    off = np.cumsum([0, *map(len, some)])
    got, counts = lattice.words(np.frombuffer(b"".join(some), np.uint8), off, np.ones((len(some), 1)))
    assert np.allclose(got, [marginal(x) for x in some], rtol=1e-9)
    assert np.allclose(got, lattice.words(np.frombuffer(b"".join(some), np.uint8), off))
    assert counts.sum() > 0 and np.isfinite(counts).all()


def test_mixing(docs, rows, empty):
    got = by_id(mixing.mix_sources(docs.drop("size")))
    size = {i: len(words(t)) for i, t, _ in rows}
    of = {i: s for i, _, s in rows}
    whole = {s: sum(size[i] for i in size if of[i] == s) for s in ("a", "b", None)}
    aims = mixing.share_targets([whole[s] for s in ("a", "b", None)], [5.0, 2.0, 1.0], 1.5 * sum(size.values()), 2.0)
    for s, aim in zip(("a", "b", None), aims):
        ids = [i for i in size if of[i] == s]
        assert aim <= 2 * whole[s] + 1e-6
        assert abs(sum(got[i]["taken"] for i in ids) - aim) <= max(size[i] for i in ids)
        assert all(got[i]["target"] == pytest.approx(aim) and got[i]["source_size"] == whole[s] for i in ids)
    assert all(r["taken"] <= 2 * r["size"] and r["size"] == size[i] for i, r in got.items())
    again = by_id(mixing.mix_sources(docs.drop("size").repartition(5)))
    assert all(again[i]["taken"] == r["taken"] for i, r in got.items())
    assert mixing.mix_sources(empty.drop("size")).count() == 0


def test_min_cost_flow_spreads_overlap():
    plan = mixing.plan_mix({("a",): 100, ("a", "b"): 100, ("b",): 100}, weights=(1, 1), share=1.0)
    assert sum(plan.take.values()) == pytest.approx(300)
    assert all(v == pytest.approx(100) for v in plan.take.values())  # nothing is repeated while fresh text is left


def test_toxicity(spark, empty):
    rng = random.Random(2)
    plain = ["".join(rng.choice("aeiostrnld") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(30)]
        toxic = int(i % 5 == 0)
        if toxic:
            word = rng.choice(["scumbag", "moronic", "idiotic"])
            w[rng.randrange(30)] = word if i < 300 else word.replace("o", "0").replace("i", "1") if "o" in word else "s c u m b a g"
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    rows += [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels + [(950, None)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, labels, learn=F.col("doc_id") < 300)
    got = by_id(toxicity.score_toxicity(docs, model))
    assert len(got) == 402 and all(0 <= r["score"] <= 1 for r in got.values())
    late = [(i % 5 == 0, got[i]["score"] >= 0.3) for i in range(300, 400)]
    assert sum(a == b for a, b in late) >= 95
    assert toxicity.score_toxicity(empty, model).count() == 0
    none = toxicity.train_toxicity(docs, labels.limit(0))
    assert {r["score"] < 0.01 for r in toxicity.score_toxicity(docs, none).collect()} == {True}


def test_restoration():
    text = ("the idiot was pathetic and stupid " * 200).encode()
    code = np.full(256, 26)
    code[97:123] = np.arange(26)
    c = np.r_[26, 26, code[np.frombuffer(text, np.uint8)], 26]
    counts = np.full((27, 27, 27), 0.01)
    np.add.at(counts, (np.where(c[1:-1] == 26, 26, c[:-2]), c[1:-1], c[2:]), 1)
    r = toxicity.Restorer(np.log(counts / counts.sum(-1, keepdims=True)))
    for disguise in ("1d10t", "id.i.ot", "iddiiot", "idiooooot", "1d!0t"):
        assert r.word(disguise) == "idiot"
    assert r.word("pa7h3t1c") == "pathetic"


def test_restoration_of_long_and_spaced_text():
    text = ("you are such a scumbag and the idiot was pathetic and stupid " * 200).encode()
    code = np.full(256, 26)
    code[97:123] = np.arange(26)
    c = np.r_[26, 26, code[np.frombuffer(text, np.uint8)], 26]
    counts = np.full((27, 27, 27), 0.01)
    np.add.at(counts, (np.where(c[1:-1] == 26, 26, c[:-2]), c[1:-1], c[2:]), 1)
    r = toxicity.Restorer(np.log(counts / counts.sum(-1, keepdims=True)))

    def found(text, word):
        """Whether the features of ``text`` have all those of ``word``."""
        of = lambda x: set(toxicity.features(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]), r)[2].tolist())
        return of(word) <= of(text)

    assert found("such a s c u m b a g", "scumbag") and found("y o u i d i o t", "idiot")
    assert found(" ".join("youarestupid" * 20 + "scumbag"), "scumbag")  # beyond 200 letters
    assert found(" ".join("the" + "idiot" + "the"), "idiot")
    assert found("_".join(["the", "stupid"] * 8 + ["sc.um.bag"]), "scumbag")  # a token beyond 60 bytes
    assert found("the " * 3 + "1d10t" + "!" * 80, "idiot")


def test_licenses(spark, docs, rows, empty):
    mit = licenses.TEMPLATES["mit"]
    more = spark.createDataFrame([(1000, f"text\n{mit}\nmore {mit}"), (1001, mit.upper()), (1002, None), (1002, None)], "doc_id long, text string")
    got = by_id(licenses.scan_licenses(more))
    assert (got[1000]["license"], got[1000]["n_matches"]) == ("mit", 2) and got[1001]["dice"] == 1.0
    assert got[1002]["license"] is None and licenses.scan_licenses(more).count() == 4
    assert licenses.scan_licenses(docs).count() == len(rows) and licenses.scan_licenses(empty).count() == 0


def test_licenses_in_any_layout(spark):
    import textwrap

    t, full = licenses.TEMPLATES, licenses.full_texts()
    story = lambda k: " ".join(f"tale{k}x{j}" for j in range(80))
    wrap = lambda x, n: "\n".join(textwrap.wrap(x, n))
    cases = {
        "gpl-3.0-header": f"{story(0)}\n{wrap(t['gpl-3.0-header'], 72)}\n{story(1)}",
        "apache-2.0-header": f"{story(0)}\n{wrap(t['apache-2.0-header'], 76)}\n{story(1)}",
        "mit": f"{story(0)} {t['mit']} {story(1)}",
        "mit-paragraph-1": f"{story(2)}\n" + " ".join(full["mit-paragraph-1"].split()),
        "mit-text": f"Copyright 2001 Somebody\n\n{full['mit-text']}",
        "gpl-3-text": f"{story(3)}\n{full['gpl-3-text']}\n{story(4)}",
    }
    docs = spark.createDataFrame(list(enumerate(cases.values())) + [(90, story(5)), (91, f"{t['mit']} " * 3)], "doc_id long, text string")
    got = by_id(licenses.scan_licenses(docs))
    assert {i: got[i]["license"] for i in range(len(cases))} == dict(enumerate(cases))
    assert (got[2]["dice"], got[2]["n_matches"], got[90]["n_matches"]) == (1.0, 1, 0)


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, t, "en", ["a", "b"][i % 2], len(t or "")) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    some = [(k, " ".join(words(rows[8][1])[5 * k : 5 * k + 12])) for k in range(2)] + [(9, " ".join(words(rows[17][1])[:9]))]
    spark.createDataFrame(some, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "mixing":
            assert now.columns == docs.columns
        if name == "near_duplicates":
            left = {r["doc_id"]: r["text"] for r in now.collect()}
            comps = expected_components(sorted((r["doc_id"], r["text"], None) for r in spark.read.parquet(f"{tmp_path}/line_dedup").collect()))
            assert set(left) == {i for i, (_, c) in comps.items() if i == c}
    ids = {r["doc_id"] for r in now.collect()}
    assert not {8, 17} & ids and {r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).collect()} == ids


def test_pipeline_null_and_repeated_ids(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(None, text(0), "en"), (None, text(1), "en"), (None, text(1), "en"), (None, None, "en"), (None, None, "en"), (None, " \n", "en")]
    rows += [(7, text(2), "en"), (7, text(2), "en"), (7, text(3), "de"), (None, text(4), "en"), (9, text(4), "en"), (8, text(4), None), (3, "", "en"), (3, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = Counter(tuple(r) for r in pipeline.near_duplicates(spark, docs, str(tmp_path)).collect())
    once = [(None, text(0), "en"), (None, text(1), "en"), (7, text(2), "en"), (7, text(3), "de"), (8, text(4), None)]
    assert got == Counter(once + [r for r in rows if not (r[1] or "").strip()])

    part = lambda a, k: " ".join(words(text(a))[k : k + 10])
    spark.createDataFrame([(k, part(1, 10 * k)) for k in range(2)] + [(2, part(2, 0)), (3, part(3, 0))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter(tuple(r) for r in pipeline.decontamination(spark, docs, str(tmp_path)).collect())
    assert got == Counter(r for r in rows if r[1] not in (text(1), text(2), text(3)))  # one item is enough
