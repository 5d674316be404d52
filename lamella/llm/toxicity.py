"""Toxicity (6): noisy-channel restoration of disguised words, then evidence from restored words.

Model, all trained here from all labelled rows; what is counted over them is counted in Spark:

* a character trigram model over a-z and the word boundary;
* evidence weights of word features (whole word and its first 4, 5 and 6 bytes): the lower confidence bound of the
  log odds, so chance hits of rare words weigh little;
* a logistic link from a text's strongest evidence and its sum, fitted on evidence that each half of the labelled rows
  gets from the weights of the other half.

Restoration: a token is a lattice of its character runs. Plain letters have one reading; look-alike symbols may be
letters or separators; repeated letters may be one or two; single characters in a row may be one word or several. Viterbi
picks the reading that the character model and the channel's costs like best, in time linear in the token's length. Tokens whose lattice has one path are left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.session import checkpoint, ship

from ._common import BYTE, P1, chunks, lower_bytes, prefix_sums, read, release, spans_hash, trim, word_spans
from .packs import packs, unpack

#: rows of counts that a task holds before it sends them
HELD = 1 << 19
PREFIXES = (4, 5, 6)
#: standard errors that a weight gives up
CONFIDENCE = 2.5
#: longest tokens whose restoration is remembered
CACHED = 60
# what a character may stand for besides itself, with the cost of that reading
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "", ".": "", "-": "", "_": "", "~": "", "'": "",
}
SUBSTITUTE, SEPARATE, BREAK, COLLAPSE = 0.7, 0.7, 6.0, 1.0

_letter = np.zeros(256, bool)
_letter[97:123] = True
_letter[128:] = True
_az = np.zeros(256, bool)
_az[97:123] = True
_look = np.zeros(256, bool)
_look[[ord(c) for c in LOOKALIKE]] = True
_strong = np.zeros(256, bool)
_strong[[ord(c) for c in "0123456789@$!|+"]] = True


@dataclass
class ToxicModel:
    trigram: np.ndarray = field(default_factory=lambda: np.full((27, 27, 27), -math.log(27)))
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))  # all rows, without half 0, without half 1
    link: tuple = (-50.0, 0.0, 0.0)


class Restorer:
    """Viterbi over the character lattice of a token."""

    def __init__(self, trigram: np.ndarray):
        self.t = trigram.tolist()
        self.word = lru_cache(50_000)(self._word)

    @staticmethod
    def readings(c: str, n: int) -> list[tuple[str, float]]:
        """Readings of a run: (letters, cost); None breaks the word."""
        if "a" <= c <= "z":
            return [(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, COLLAPSE)] if n == 2 else [(c, 0.0), (c * 2, COLLAPSE)]
        if c not in LOOKALIKE:
            return [(None, 0.0)]
        out: list = [(x * k, SUBSTITUTE * k) for x in LOOKALIKE[c] for k in ((1, 2) if n > 1 else (1,))]
        if c.isdigit() or c == "@":
            return [*out, (None, BREAK)]
        return [*out, ("", SEPARATE), (None, BREAK)]

    def readings_of(self, token: str) -> list[str]:
        return [self.word(token) if len(token) <= CACHED else self._word(token)]

    def spaced(self, run: str) -> list[str]:
        """Readings of a run of single characters: as one word, and with words that end before any character."""
        return [*self.readings_of(run), self._decode(run, True)]

    def _word(self, token: str) -> str:
        return self._decode(token, False)

    def _decode(self, token: str, breaks: bool) -> str:
        best: dict = {(26, 26): (0.0, None)}  # (last two letters): score, chain of (chain before, letters)
        for c, run in groupby(token):
            n, step = sum(1 for _ in run), {}
            options = self.readings(c, n)
            if breaks:  # a word's end costs the boundary that the character model expects
                if n > 1 and "a" <= c <= "z":
                    options = [*options, (f"{c} {c}", 0.0 if n == 2 else COLLAPSE)]
                ends = [(s + self.t[x][y][26], o) for (x, y), (s, o) in best.items() if y != 26]
                if ends:
                    s, o = max(ends, key=itemgetter(0))
                    if (26, 26) not in best or best[26, 26][0] < s:
                        best[26, 26] = (s, (o, " "))
            for (a, b), (score, text) in best.items():
                for letters, cost in options:
                    s, x, y = score - cost, a, b
                    for ch in " " if letters is None else letters:
                        if ch == " ":
                            s += self.t[x][y][26] if y != 26 else 0.0
                            x, y = 26, 26
                        else:
                            z = ord(ch) - 97
                            s += self.t[x][y][z]
                            x, y = y, z
                    if (x, y) not in step or step[x, y][0] < s:
                        step[x, y] = (s, (text, " " if letters is None else letters))
            best = step
        _, o = max(((s + (self.t[x][y][26] if y != 26 else 0.0), o) for (x, y), (s, o) in best.items()), key=itemgetter(0))
        out = []
        while o is not None:
            o, letters = o
            out.append(letters)
        return "".join(reversed(out))


def disguised(data: np.ndarray, off: np.ndarray) -> list[tuple[int, str, bool]]:
    """(document index, token, spaced) of tokens whose lattice has several paths, and of joined runs of single characters."""
    s, e, doc = word_spans(data, off)
    if not len(s):
        return []
    n = len(data)
    look, az = _look[data], _az[data]
    left, right = np.zeros(n, bool), np.zeros(n, bool)
    left[1:], right[:-1] = az[:-1], az[1:]
    odd = look & left & right | _strong[data] & (left | right) & ~(data == ord("!"))
    if n > 2:
        odd[2:] |= az[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    total = np.zeros(n + 1, np.int64)
    np.cumsum(odd, out=total[1:])
    letters = np.zeros(n + 1, np.int64)
    np.cumsum(az, out=letters[1:])
    pick = (total[e] > total[s]) & (letters[e] - letters[s] >= 2)
    raw = data.tobytes()
    out = [(int(doc[i]), raw[s[i] : e[i]].decode("utf-8", "replace"), False) for i in np.flatnonzero(pick)]
    one = (e - s == 1) & (az | _strong[data])[s]
    joins = one[1:] & one[:-1] & (doc[1:] == doc[:-1]) & (s[1:] - e[:-1] == 1)
    if joins.any():
        edge = np.flatnonzero(np.diff(np.r_[0, joins.view(np.int8), 0]))
        for a, b in zip(edge[::2], edge[1::2], strict=True):  # words a..b stand one by one
            if b - a >= 2:
                out.append((int(doc[a]), "".join(chr(c) for c in data[s[a : b + 1]]), True))
    return out


def features(data: np.ndarray, off: np.ndarray, restorer: Restorer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, word's number, feature hash) of the words of texts, restored ones besides."""
    data = lower_bytes(data)
    added = []
    for d, token, spaced in disguised(data, off):
        read_as = restorer.spaced if spaced else restorer.readings_of
        for w in " ".join(read_as(token.strip(".,;:!?\"'()[]"))).split():
            if len(w) > 2:
                added.append((d, w.encode()))
    parts, base = [], 0
    extra = b" ".join(w for _, w in added)
    at = np.cumsum([0, *(len(w) + 1 for _, w in added)])
    for buf, owner in ((data, None), (np.frombuffer(extra, np.uint8), np.array([d for d, _ in added], np.int64))):
        if not len(buf):
            continue
        inside = np.zeros(len(buf) + 2, bool)
        inside[1:-1] = _letter[buf]
        start, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        if owner is None:
            cut = off[1:-1]
            cut = cut[(cut > 0) & (cut < len(buf))]
            start[cut] |= inside[1:-1][cut]
            end[cut - 1] |= inside[1:-1][cut - 1]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        doc = np.searchsorted(off, s, "right") - 1 if owner is None else owner[np.searchsorted(at, s, "right") - 1]
        sums, number = prefix_sums(BYTE[buf], P1), np.arange(len(s)) + base
        base += len(s)
        keep = e - s >= 3
        s, e, doc, number = s[keep], e[keep], doc[keep], number[keep]
        parts.append((doc, number, spans_hash(sums, s, e, P1) ^ np.uint64(1)))
        for k in PREFIXES:
            long = e - s > k
            parts.append((doc[long], number[long], spans_hash(sums, s[long], s[long] + k, P1)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def evidence(model: ToxicModel, data: np.ndarray, off: np.ndarray, restorer: Restorer) -> np.ndarray:
    """(documents, sets, 2): the strongest word's evidence and the sum over distinct features, by each set of weights."""
    n, sets = len(off) - 1, model.weights.shape[1]
    out = np.zeros((n, sets, 2))
    if not len(model.hashes):
        return out
    doc, word, h = features(data, off, restorer)
    first = np.zeros(1 << 16, bool)
    first[(model.hashes >> np.uint64(48)).astype(np.int64)] = True
    near = np.flatnonzero(first[(h >> np.uint64(48)).astype(np.int64)])
    at = np.searchsorted(model.hashes, h[near])
    at[at == len(model.hashes)] = 0
    hit = model.hashes[at] == h[near]
    doc, word, at = doc[near][hit], word[near][hit], at[hit]
    _, once = np.unique(doc * len(model.hashes) + at, return_index=True)
    for k in range(sets):
        w = np.maximum(model.weights[at, k], 0)
        np.maximum.at(out[:, k, 0], doc, w)
        np.add.at(out[:, k, 1], doc[once], w[once])
    return out


def _fit_link(points: DataFrame) -> tuple:
    """Logistic regression with a small ridge over ``points`` (m, s, y, n: how often), by Newton steps.

    Each step sums gradient and Hessian over all rows in Spark. Nine digits are kept: the order of sums has no say.
    """
    z, pairs, b = (F.lit(1.0), F.col("m"), F.log1p("s")), [(i, j) for i in range(3) for j in range(i + 1)], np.zeros(3)
    for _ in range(30):
        at = sum((z[i] * float(b[i]) for i in range(3)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.least(at, F.lit(30.0)), F.lit(-30.0))))
        rows = points.select(p.alias("p"), "y", "n", *[z[i].alias(f"z{i}") for i in range(3)])
        g, h = F.expr("n * (y - p)"), F.expr("n * p * (1 - p)")
        sums = rows.agg(*[F.sum(g * F.col(f"z{i}")) for i in range(3)], *[F.sum(h * F.col(f"z{i}") * F.col(f"z{j}")) for i, j in pairs]).first()
        hess = np.zeros((3, 3))
        for (i, j), x in zip(pairs, sums[3:], strict=True):
            hess[i, j] = hess[j, i] = x
        step = np.linalg.solve(hess + np.diag([1e-6, 0.05, 0.05]), np.array(sums[:3]) - 0.05 * b * [0, 1, 1])
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(np.round(b, 9).tolist())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(groups of the texts, bytes, offsets) of packs, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            data, off = unpack(batch.column("x")[i].as_py())
            yield batch.column("ids").slice(i, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64), data, off


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each h once, with the sums of its rows of n."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
    return h[first], np.add.reduceat(n[order], first) if len(h) else n


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    learn=None,
) -> ToxicModel:
    """Fit on all rows of ``labels`` that ``learn`` (a Column) keeps.

    Null labels and ids are left out; a repeated label row counts again. Without a toxic label nothing is toxic. The order
    of rows has no say. The driver holds the model alone: 32 bytes a feature that three toxic texts hold and that speaks
    for them.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if learn is not None:
        known = known.filter(learn)
    known = known.select(F.col(id_col).alias("_id"), (F.col(label_col).cast("int") > 0).cast("int").alias("y"))
    half = F.pmod(F.xxhash64(F.lit(11), "_id"), F.lit(2)).cast("int")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(known.hint("merge"), "_id")
    texts = packs(texts.select((half * 2 + F.col("y")).alias("group"), "text"), "group", "text")

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3 + 4, np.int64)  # of trigrams, then of texts by group
        code = np.full(256, 26, np.int64)
        code[97:123] = np.arange(26)
        for group, data, off in _packed(batches):
            c = np.r_[26, 26, np.insert(code[lower_bytes(data)], off[1:-1], 26), 26]  # no word crosses into the next text
            keep = ~((c[1:-1] == 26) & (c[2:] == 26))
            b = c[1:-1]
            a = np.where(b == 26, 26, c[:-2])
            total[: 27**3] += np.bincount(((a * 27 + b) * 27 + c[2:])[keep], minlength=27**3)
            total[27**3 :] += np.bincount(group, minlength=4)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])
        trim()

    model = ToxicModel()
    counts = np.zeros(27**3 + 4)
    for k, n in texts.mapInArrow(letters, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        counts[k] += n
    release(spark)  # the join; a job after its own, as the last job's files stay
    n = counts[27**3 :].tolist()
    counts = counts[: 27**3].reshape(27, 27, 27) + 0.02
    bigram = counts.sum(0)
    smooth = counts + 5 * (bigram / bigram.sum(-1, keepdims=True))[None]
    model.trigram = np.log(smooth / smooth.sum(-1, keepdims=True))
    trigram = model.trigram
    if n[1] + n[3] == 0:
        return model

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, held = Restorer(trigram), []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def row(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), *(pa.array(n[:, i].astype(np.int64)) for i in range(4))], names=["h", "a0", "a1", "b0", "b1"]
            )

        for group, data, off in _packed(batches):
            doc, _, h = features(data, off, restorer)
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            u, inverse = np.unique(h[new], return_inverse=True)
            of = np.bincount(inverse * 4 + group[doc[new]], minlength=4 * len(u)).reshape(-1, 4).astype(np.int32)
            held.append((u, of))
            if sum(len(x) for x, _ in held) > HELD:
                held = [merged()]
                if len(held[0][0]) > HELD // 2:
                    yield row(*held[0])
                    held = []
        if held:
            yield row(*merged())
        trim()

    rows = texts.mapInArrow(counted, "h long, a0 long, a1 long, b0 long, b1 long")
    rows = rows.groupBy("h").agg(*[F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1")])

    def weight(n1, n0, all1: float, all0: float):
        odds = F.log((n1 + 0.5) / (n0 + 0.5)) - math.log((all1 + 1) / (all0 + 1))
        return odds - CONFIDENCE * F.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))

    c = F.col
    top = (
        rows.filter(c("a1") + c("b1") >= 3)
        .withColumns(
            {
                "w": weight(c("a1") + c("b1"), c("a0") + c("b0"), n[1] + n[3], n[0] + n[2]),
                "w0": weight(c("b1"), c("b0"), n[3], n[2]),
                "w1": weight(c("a1"), c("a0"), n[1], n[0]),
            }
        )
        .filter(c("w") > 0.5)
        .select("h", "w", "w0", "w1")
        .toArrow()  # the model: features of toxic texts, not rows
    )
    h = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    model.hashes, model.weights = h[order], np.stack([top[k].to_numpy() for k in ("w", "w0", "w1")], 1)[order]
    now = ToxicModel(trigram, model.hashes, model.weights)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(trigram)
        for group, data, off in _packed(batches):
            x = evidence(now, data, off, restorer)[np.arange(len(group)), 1 + group // 2]
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array((group % 2).astype(np.int32))], names=["m", "s", "y"])
        trim()

    points = texts.mapInArrow(calibrate, "m double, s double, y int").groupBy("m", "s", "y").agg(F.count(F.lit(1)).alias("n"))
    model.link = _fit_link(checkpoint(points))
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """All rows and columns of ``docs`` (without the text unless ``keep_text``) plus ``score``, 0 to 1.

    Each row is scored by its whole text alone: repeated rows and ids get equal scores, null and blank texts the score of
    an empty one. An input column named ``score`` is replaced; all others stay. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != "score" and (keep_text or c != text_col)]
    source = docs.select(*kept, *([] if text_col in kept else [text_col]))
    schema = docs.select(*kept).schema.add("score", "double")

    whole = ToxicModel(model.trigram, model.hashes, model.weights[:, :1])  # the halves' weights only fit the link
    b = np.array(model.link)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(whole.trigram)
        for batch in batches:
            for lo, hi, data, off in chunks(batch, text_col):  # rows go back by the chunk: none waits for the batch's last
                x = evidence(whole, data, off, restorer)[:, 0]
                z = np.stack([np.ones(len(x)), x[:, 0], np.log1p(x[:, 1])], 1) @ b
                rows = [batch.column(c).slice(lo, hi - lo) for c in kept]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], names=[*kept, "score"])
        trim()

    return source.mapInArrow(scored, schema)


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, read(spark, sf_dir, "labels"), learn=_remainder(4) != 2)
    return score_toxicity(docs, model, keep_text=False).select(
        "doc_id",
        F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE: dict[str, str] = {}
