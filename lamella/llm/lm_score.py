"""LM scoring (2): subword lattice likelihood.

A document's lattice has an arc for every piece of an existing unigram vocabulary that its bytes hold, and one for every
whole word. Arcs do not cross the blanks between words, so the forward recursion over a document is the product of its
words' marginals: each distinct word's is computed once a class of texts, in log space, over all its segmentations. The
vocabulary's own scores weight the pieces first; one expectation step over the distinct training words of a class
re-weights them, since unseen words resemble types rather than tokens. The whole-word arc carries the word's discounted share of the training tokens, by class
of texts and overall, the pieces what the discounts leave. A text's tokens (its words, then one end) are an exchangeable
sequence with that base measure: a Dirichlet-multinomial whose concentration is chosen over all training texts, each scored
without its own counts.

Counting is distributed: every distinct token of the corpus is one row. Packs of texts send their distinct tokens to
buckets of the vocabulary and get counts and marginals back, so nothing that grows with it is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BYTE, P1, checkpoint, lower_bytes, mix, prefix_sums, read, release, spans_hash, trim, word_spans
from .packs import BUCKET, buckets_for, cells, merged, packs, round_trip, unpack

#: re-weightings of the pieces
ITERATIONS = 1
#: concentrations tried
GRID = (300.0, 1000.0, 3000.0, 10000.0, 1e6)
#: bytes of the vocabulary's longest piece
MAX_PIECE = 25
#: longest words whose arcs are all held at once
STRETCH = 64
FLOOR = math.log(1e-9)
#: classes of texts, and buckets of short words that tell them apart
CLASSES, SHORT = 4, 256
STEP = 0x9E3779B97F4A7C15  # between the keys of a token in two classes


def vocabulary_pieces(path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, log probabilities) of the pieces of a sentencepiece model; bytes 0-255 come last as fallbacks.

    Scores of merge order count as ranks of Zipf's law; scores that are log probabilities are taken as they are.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    pieces, scores = [], []
    for i in range(sp.get_piece_size()):
        if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i)):
            pieces.append(sp.id_to_piece(i).replace("▁", " ").encode())
            scores.append(sp.get_score(i))
    s = np.array(scores)
    ranks = len(s) > 1 and np.allclose(np.sort(s), np.sort(np.round(s))) and s.min() < -1000
    logs = -np.log(2.7 - s) if ranks else s.copy()
    seen: dict[bytes, float] = {}
    for p, x in zip(pieces, logs.tolist(), strict=True):
        q = p.lower()  # texts are lower-cased: letter case is no difference between pieces
        if len(q) <= MAX_PIECE and q.strip(b" ") == q.lstrip(b" ") and q not in (b"", b" "):
            seen[q] = float(np.logaddexp(seen[q], x)) if q in seen else x
    buf = np.frombuffer(b"".join(seen), np.uint8)
    ends = np.cumsum([len(p) for p in seen])
    sums = prefix_sums(BYTE[buf], P1)
    h = spans_hash(sums, np.r_[0, ends[:-1]], ends, P1)
    one = np.arange(256, dtype=np.uint8)
    h = np.r_[h, spans_hash(prefix_sums(BYTE[one], P1), np.arange(256), np.arange(256) + 1, P1) ^ np.uint64(5)]
    logs = np.r_[np.fromiter(seen.values(), float), np.full(256, FLOOR)]
    return h, logs - np.log(np.exp(logs).sum())


class Lattice:
    """Forward and backward recursions over the segmentations of many words at once."""

    def __init__(self, hashes: np.ndarray, logs: np.ndarray):
        self.logs, self.hashes = logs, hashes
        self.mask = np.uint64((1 << 18) - 1)
        self.pieces = len(hashes) - 256
        own = hashes[: self.pieces]
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(own & self.mask).astype(np.int64)] = True
        # pieces by slot; those that share a slot are tried in turn, in tables by other bits
        self.slots, left, shift = [], np.arange(self.pieces), 0
        while len(left) and shift < 44:
            table = np.full(1 << 18, -1, np.int32)
            table[((own[left] >> np.uint64(shift)) & self.mask).astype(np.int64)] = left
            self.slots.append((np.uint64(shift), table))
            at = table[((own[left] >> np.uint64(shift)) & self.mask).astype(np.int64)]
            left, shift = left[at != left], shift + 9

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, or -1."""
        out = np.full(len(h), -1, np.int64)
        near = np.flatnonzero(self.maybe[(h & self.mask).view(np.int64)])
        for shift, table in self.slots:
            x = h[near]
            at = table[((x >> shift) & self.mask).view(np.int64)]
            ok = (at >= 0) & (self.hashes[at] == x)
            out[near[ok]] = at[ok]
            near = near[~ok]
        return out

    def arcs(self, buf: np.ndarray, start: np.ndarray, width: int, upto: int | None = None) -> list[list[np.ndarray]]:
        """piece[i][L]: for words of equal ``width`` at ``start``, the piece on bytes [i, i + L), or -1; for i < ``upto``."""
        sums = prefix_sums(BYTE[buf], P1)
        out = []
        for i in range(width if upto is None else min(upto, width)):
            row = []
            for size in range(1, min(MAX_PIECE, width - i) + 1):
                p = self.find(spans_hash(sums, start + i, start + i + size, P1))
                if size == 1:
                    p = np.where(p < 0, self.pieces + buf[start + i].astype(np.int64), p)
                row.append(p)
            out.append(row)
        return out

    def forward(self, arcs: list, n: int, width: int) -> np.ndarray:
        alpha = np.full((width + 1, n), -np.inf)
        alpha[0] = 0
        logs = np.r_[self.logs, -np.inf]
        for i in range(width):
            for size, p in enumerate(arcs[i], 1):
                on = np.flatnonzero(p >= 0)
                if len(on):
                    alpha[i + size, on] = np.logaddexp(alpha[i + size, on], alpha[i, on] + logs[p[on]])
        return alpha

    def backward(self, arcs: list, n: int, width: int) -> np.ndarray:
        beta = np.full((width + 1, n), -np.inf)
        beta[width] = 0
        for i in range(width - 1, -1, -1):
            for size, p in enumerate(arcs[i], 1):
                on = np.flatnonzero(p >= 0)
                if len(on):
                    beta[i, on] = np.logaddexp(beta[i, on], beta[i + size, on] + self.logs[p[on]])
        return beta

    def stretched(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray, weight: np.ndarray | None, counts: np.ndarray | None) -> np.ndarray:
        """Marginals of words of any length; arcs are held for one stretch at a time. Adds to ``counts`` if given."""
        width, words = int(size.max()), np.arange(len(size))
        logs = np.r_[self.logs, -np.inf]

        def stretch(a: int):
            """(byte, length, words, pieces) of the arcs that start in the stretch at ``a``."""
            m = min(STRETCH + MAX_PIECE - 1, width - a)
            text = buf[np.minimum(start[:, None] + np.arange(a, a + m), (start + size - 1)[:, None])].ravel()
            for i, row in enumerate(self.arcs(text, words * m, m, STRETCH), a):
                for n, p in enumerate(row, 1):
                    on = np.flatnonzero((p >= 0) & (i + n <= size))
                    if len(on):
                        yield i, n, on, p[on]

        alpha = np.full((width + 1, len(size)), -np.inf)
        alpha[0] = 0
        for a in range(0, width, STRETCH):
            for i, n, on, p in stretch(a):
                alpha[i + n, on] = np.logaddexp(alpha[i + n, on], alpha[i, on] + logs[p])
        out = alpha[size, words]
        if counts is None:
            return out
        beta = np.full((width + 1, len(size)), -np.inf)
        beta[size, words] = 0
        for a in range((width - 1) // STRETCH * STRETCH, -1, -STRETCH):
            for i, n, on, p in reversed([*stretch(a)]):
                beta[i, on] = np.logaddexp(beta[i, on], beta[i + n, on] + logs[p])
                post = np.exp(alpha[i, on] + logs[p] + beta[i + n, on] - out[on])
                for c in range(len(counts)):
                    some = weight[on, c] > 0
                    counts[c] += np.bincount(p[some], weights=(post * weight[on, c])[some], minlength=counts.shape[1])
        return out

    def words(self, buf: np.ndarray, off: np.ndarray, weight: np.ndarray | None = None):
        """Natural-log marginals of the words buf[off[k]:off[k+1]]; with ``weight`` (words, classes), expected piece counts too.

        Words beyond ``STRETCH`` bytes are scored in stretches; pieces span their edges.
        """
        size = np.diff(off)
        out = np.zeros(len(size))
        counts = np.zeros((weight.shape[1], len(self.hashes))) if weight is not None else None
        long = np.flatnonzero(size > STRETCH)
        long = long[np.argsort(size[long], kind="stable")][::-1]
        while len(long):  # the longest first: a block has at most 2**18 padded bytes, or one word
            n = max(1, (1 << 18) // int(size[long[0]]))
            g, long = long[:n], long[n:]
            out[g] = self.stretched(buf, off[:-1][g], size[g], None if counts is None else weight[g], counts)
        owner = np.flatnonzero(size <= STRETCH)
        starts, widths = off[:-1][owner], size[owner]
        order = np.argsort(widths, kind="stable")
        edges = np.flatnonzero(np.diff(widths[order])) + 1
        for group in np.split(order, edges):
            width = int(widths[group[0]]) if len(group) else 0
            block = max(1 << 10, (1 << 18) // max(width, 1))
            for k in range(0, len(group) if width else 0, block):
                g = group[k : k + block]
                span = (starts[g][:, None] + np.arange(width)).ravel()
                arcs = self.arcs(buf[span], np.arange(len(g)) * width, width)
                alpha = self.forward(arcs, len(g), width)
                np.add.at(out, owner[g], alpha[width])
                if counts is None:
                    continue
                beta = self.backward(arcs, len(g), width)
                w = weight[owner[g]]
                for i in range(width):
                    for n, p in enumerate(arcs[i], 1):
                        on = np.flatnonzero(p >= 0)
                        post = np.exp(alpha[i, on] + self.logs[p[on]] + beta[i + n, on] - alpha[width, on])
                        for c in range(len(counts)):
                            some = w[on, c] > 0
                            counts[c] += np.bincount(p[on][some], weights=(post * w[on, c])[some], minlength=counts.shape[1])
        return (out, counts) if counts is not None else out


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Batches joined to about ``rows`` rows, so that words of one width are many."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def tokens(data: np.ndarray, off: np.ndarray):
    """(lower-cased bytes, starts, ends, document, hash) of words."""
    data = lower_bytes(data)
    s, e, doc = word_spans(data, off)
    return data, s, e, doc, spans_hash(prefix_sums(BYTE[data], P1), s, e, P1)


def rising(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log Gamma(x + n) - log Gamma(x) for x > 0 and whole n >= 0."""

    def gammaln(z):  # Stirling's series, moved up by 8
        shift = np.log(z)
        for k in range(1, 8):
            shift = shift + np.log(z + k)
        z = z + 8
        return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) - shift

    out = np.log(x)
    many = n > 1
    out = np.where(n == 0, 0.0, out)
    if many.any():
        xm, nm = x[many], n[many].astype(float)
        two = nm == 2
        big = np.zeros(len(xm))
        big[two] = np.log(xm[two]) + np.log1p(xm[two])
        xr, nr = xm[~two], nm[~two]
        # ln Gamma(x+n) - ln Gamma(x) = ln x + (ln Gamma(x+n) - ln Gamma(x+1)): stable for small x
        big[~two] = np.log(xr) + gammaln(xr + nr) - gammaln(xr + 1)
        out[many] = big
    return out


def short_words(data: np.ndarray, s: np.ndarray, e: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(documents, SHORT): counts of words of up to three bytes by bucket."""
    on = np.flatnonzero(e - s <= 3)
    s, size = s[on], (e - s)[on]
    code = size.astype(np.uint64)
    for k in range(3):
        code = code * np.uint64(256) + np.where(size > k, data[np.minimum(s + k, len(data) - 1)], 0).astype(np.uint64)
    return np.bincount(doc[on] * SHORT + (mix(code) % np.uint64(SHORT)).astype(np.int64), minlength=n * SHORT).reshape(n, SHORT)


def class_weights(together: np.ndarray, texts: float) -> np.ndarray:
    """(SHORT, CLASSES) log weights from counts of texts that hold two buckets: k-means of the leading directions of their
    pointwise mutual information, then the share of each bucket among texts with a class's buckets."""
    own = np.maximum(np.diag(together), 0.0)
    seen = np.flatnonzero(own > max(3.0, 0.002 * texts))
    out = np.zeros((SHORT, CLASSES))
    if len(seen) < 2 * CLASSES:
        return out
    m = together[np.ix_(seen, seen)]
    pmi = np.log((m + 0.5) * texts / ((own[seen][:, None] + 0.5) * (own[seen][None] + 0.5)))
    values, vectors = np.linalg.eigh(pmi)
    lead = np.argsort(-np.abs(values))[: CLASSES + 1]
    x = vectors[:, lead] * np.sqrt(np.abs(values[lead]))
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
    centre = [int(np.argmax(own[seen]))]
    for _ in range(CLASSES - 1):
        far = np.min([((x - x[c]) ** 2).sum(1) for c in centre], axis=0) * np.log1p(own[seen])
        centre.append(int(np.argmax(far)))
    c = x[centre]
    for _ in range(50):
        group = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.stack([x[group == k].mean(0) if (group == k).any() else c[k] for k in range(CLASSES)])
    share = np.stack([m[:, group == k].sum(1) + 1e-3 * own[seen] / texts + 1e-9 for k in range(CLASSES)], 1)
    share /= share.sum(0, keepdims=True)
    base = own[seen] / own[seen].sum()
    out[seen] = np.log(share + 1e-4 * base[:, None]) - np.log(base[:, None])
    return out


def _terms(k, ck, c, sub, n, train, stat: dict):
    """Per (text, token) row: for each concentration the score's term, then the leave-one-out terms; base; known."""
    total, types = stat["total"], stat["types"]

    def p(own, all_):
        every = np.maximum(all_ - stat["discount"], 0) / total + stat["back"] * np.exp(sub)
        return np.maximum(own - stat["k_discount"][k], 0) / stat["k_total"][k] + stat["k_back"][k] * every

    x, q = p(ck, c), p(ck - n, c - n)[train]
    own = [rising(np.maximum(a * x, 1e-300), n) for a in GRID]
    tiny = x < 1e-290  # long unseen words: their first factor is known by its logarithm
    for a, y in zip(GRID, own, strict=True):
        y[tiny] += np.log(a * stat["k_back"][k[tiny]] * stat["back"]) + sub[tiny] - np.log(1e-300)
    out = []
    for a in GRID:
        y = np.zeros(len(c))
        y[train] = rising(a * np.maximum(q, 1e-300), n[train])
        out.append(y)
    return own, out, n * np.log10((c + 1) / (total + types + 1)), np.where(c > 0, n, 0)


#: what a bucket tells of a token: training counts in the text's class and overall, log marginal of the word's pieces
ANSWER = np.dtype([("ck", "<i8"), ("c", "<i8"), ("sub", "<f4")])


def _look_up(got: list, known: list) -> list[np.ndarray]:
    """A judge that finds every token in the bucket's part of the vocabulary."""
    keys = np.concatenate([k for k, _ in known]) if known else np.zeros(0, np.uint64)
    table = np.zeros(len(keys), ANSWER)
    for j, name in enumerate(ANSWER.names):
        table[name] = np.concatenate([p[j] for _, p in known]) if known else table[name]
    order = np.argsort(keys)
    keys = keys[order]
    return [table[order[np.searchsorted(keys, k)]] for k, _ in got]


def score_texts(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    pieces: tuple[np.ndarray, np.ndarray] | None = None,
) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, concentration) for each row of ``docs``.

    Rows for which ``learn`` holds train the model; all rows are scored. A null or empty text is the end token alone.
    Rows that share an id, or are equal, are texts of their own; a null id is an id; other columns play no part. With
    nothing to learn from, base_score is that of an empty corpus and score comes from the vocabulary's pieces alone. Long
    texts cost memory in proportion to one text. ``score`` and ``base_score`` are log10 probabilities.
    """
    spark = docs.sparkSession
    hashes, logs = vocabulary_pieces() if pieces is None else pieces
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("train")).alias("key"), F.col(text_col).alias("text"))
    packed = packs(keyed, "key", "text")

    def opened(batch: pa.RecordBatch, i: int):
        """(bytes, offsets, whether a row trains) of a pack."""
        return *unpack(batch.column("x")[i].as_py()), batch.column("ids").slice(i, 1).flatten().field("train").to_numpy(zero_copy_only=False)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, texts = np.zeros((SHORT, SHORT)), 0
        for batch in batches:
            for i in range(batch.num_rows):
                data, off, train = opened(batch, i)
                data = lower_bytes(data)
                held_by = (short_words(data, *word_spans(data, off), len(train))[train] > 0).astype(np.float32)
                m += held_by.T @ held_by
                texts += int(train.sum())
        i, j = np.nonzero(np.triu(m))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[i * SHORT + j, -1]), pa.array(np.r_[m[i, j], texts].astype(np.int64))], names=["k", "n"])

    met, texts = np.zeros(SHORT * SHORT), 0
    for k, n in packed.mapInArrow(together, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        if k < 0:
            texts = n
        else:
            met[k] = n  # at most SHORT * SHORT / 2 rows
    met = met.reshape(SHORT, SHORT)
    by_class = class_weights(np.maximum(met, met.T), float(max(texts, 1)))

    def classed(data, off):
        """(lower-cased bytes, starts, ends, document, hash of words; class of documents)."""
        data, s, e, doc, h = tokens(data, off)
        n = len(off) - 1
        return data, s, e, doc, h, (short_words(data, s, e, doc, n) @ by_class).argmax(1)

    cs = [f"c{k}" for k in range(CLASSES)]
    counts_type = ", ".join(f"{c} long" for c in cs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words with their classes and training counts, merged over some packs; the empty word counts training texts."""
        held: dict = {"h": [], "n": [], "m": [], "w": []}
        ends = np.zeros(CLASSES, np.int64)

        def merge() -> pa.RecordBatch:
            u, first, inverse = np.unique(np.concatenate(held["h"]), return_index=True, return_inverse=True)
            n, m = np.zeros((len(u), CLASSES)), np.zeros((len(u), CLASSES), bool)
            np.add.at(n, inverse, np.concatenate(held["n"]))
            np.logical_or.at(m, inverse, np.concatenate(held["m"]))
            w = pa.concat_arrays(held["w"]).take(pa.array(first)).cast(pa.binary())
            mask = (m * (1 << np.arange(CLASSES))).sum(1).astype(np.int64)
            for x in held.values():
                x.clear()
            return pa.RecordBatch.from_arrays([w, pa.array(mask), *(pa.array(n[:, k].astype(np.int64)) for k in range(CLASSES))], names=["w", "m", *cs])

        for batch in batches:
            for i in range(batch.num_rows):
                data, off, train = opened(batch, i)
                data, s, e, doc, h, kind = classed(data, off)
                ends += np.bincount(kind[train], minlength=CLASSES)
                u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                cell = inverse * CLASSES + kind[doc]
                held["h"].append(u)
                held["n"].append(np.bincount(cell, weights=train[doc], minlength=len(u) * CLASSES).reshape(-1, CLASSES))
                held["m"].append(np.bincount(cell, minlength=len(u) * CLASSES).reshape(-1, CLASSES) > 0)
                size = (e - s)[first]
                end = np.cumsum(size)
                span = np.repeat(s[first] - np.r_[0, end[:-1]], size) + np.arange(end[-1] if len(end) else 0)
                held["w"].append(
                    pa.Array.from_buffers(
                        pa.large_binary(), len(u), [None, pa.py_buffer(np.r_[0, end].astype(np.int64)), pa.py_buffer(data[span])]
                    )
                )
                if sum(map(len, held["h"])) > 1 << 20:
                    yield merge()
        if held["h"]:
            yield merge()
        yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([0]), *(pa.array([int(n)]) for n in ends)], names=["w", "m", *cs])
        trim()

    words = packed.mapInArrow(count, f"w binary, m long, {counts_type}").groupBy("w")
    every_word = checkpoint(words.agg(F.bit_or("m").alias("m"), *[F.sum(c).alias(c) for c in cs]))
    release(spark)
    all_of = sum((F.col(c) for c in cs), F.lit(0))
    vocabulary = every_word.filter("w <> X''").withColumn("c", all_of)
    of_end = every_word.filter("w = X''").select(*cs).first()
    k_ends = np.array([float(of_end[c]) if of_end else 0.0 for c in cs])
    ends = int(k_ends.sum())

    def expected(weights: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces over the distinct training words of each class, under log ``weights`` by class."""

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattices, total = [Lattice(hashes, x) for x in weights], np.zeros((CLASSES, len(hashes)))
            for batch in gathered(batches):
                for k, lattice in enumerate(lattices):
                    w = batch.column("w").filter(pa.array(batch.column(cs[k]).to_numpy() > 0))
                    total[k] += lattice.words(*_marked(w), np.ones((len(w), 1)))[1][0]
            at = np.flatnonzero(total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["k", "x"])
            trim()

        out = np.zeros(CLASSES * len(hashes))
        for k, x in vocabulary.filter("c > 0").select("w", *cs).mapInArrow(expect, "k long, x double").groupBy("k").agg(F.sum("x")).collect():
            out[k] = x  # one row a class and piece of the vocabulary
        return out.reshape(CLASSES, -1)

    trained = np.tile(logs, (CLASSES, 1))
    for _ in range(ITERATIONS):
        counts = expected(trained)
        smooth = counts.sum(0) + 1e-3 * max(counts.sum(), 1.0) * np.exp(logs)
        smooth = counts + 1e-2 * np.maximum(counts.sum(1, keepdims=True), 1.0) * smooth / smooth.sum()
        trained = np.log(smooth / smooth.sum(1, keepdims=True))

    numbers = []  # tokens, types, types seen once and twice: of each class, then overall
    for c in [*cs, "c"]:
        numbers += [F.sum(c), F.sum((F.col(c) > 0).cast("long")), F.sum((F.col(c) == 1).cast("long")), F.sum((F.col(c) == 2).cast("long"))]
    numbers = np.array([float(x or 0) for x in vocabulary.agg(*[x.alias(f"n{i}") for i, x in enumerate(numbers)]).collect()[0]]).reshape(-1, 4)

    def discounts(n, v, n1, n2, more: float):
        """(tokens, types, discount, weight of the back-off) with the end token's count ``more``."""
        n, v = n + more, v + (more > 0)
        d = min(max(n1 / (n1 + 2 * n2), 0.1), 0.95) if n1 else 0.5
        return (n, v, d, d * v / n) if n else (1.0, 0.0, 0.0, 1.0)

    total, types = int(numbers[-1, 0] + ends), int(numbers[-1, 1] + (ends > 0))
    per = np.array([discounts(*numbers[k], k_ends[k]) for k in range(CLASSES)])
    a_total, _, a_discount, a_back = discounts(*numbers[-1], ends)
    stat = {"total": a_total if total else 0.0, "types": float(types), "discount": a_discount, "back": a_back, "k_total": per[:, 0], "k_discount": per[:, 2], "k_back": per[:, 3]}
    if not total:
        stat["total"], stat["types"] = 1.0, -1.0  # base_score of an empty corpus: log10(1 / 1)
    class_log = np.log((k_ends + 1) / (ends + CLASSES))
    end_share = (ends + 1) / (total + 2)

    buckets = max(buckets_for(packed, 0), -(-int(numbers[:-1, 1].sum()) // BUCKET))

    def marginal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vocabulary by bucket: a row for each word and class it occurs in, with its marginal."""
        lattices = [Lattice(hashes, x) for x in trained]
        for batch in gathered(batches):
            n = np.stack([batch.column(c).to_numpy() for c in cs], 1)
            mask = batch.column("m").to_numpy()
            buf, off = _marked(batch.column("w"))
            bare, o = np.delete(buf, off[:-1]), off - np.arange(len(off))
            h = spans_hash(prefix_sums(BYTE[bare], P1), o[:-1], o[1:], P1)
            word, k = np.nonzero((mask[:, None] >> np.arange(CLASSES)) & 1)
            sub = np.zeros(len(word))
            for j in range(CLASSES):
                some = batch.column("w").filter(pa.array((mask >> j) & 1 == 1))
                sub[k == j] = lattices[j].words(*_marked(some)) + math.log1p(-end_share)
            keys = class_keys(h[word], k)
            order = np.argsort(keys)
            word, k, sub = word[order], k[order], sub[order]
            parts = n[word, k], n[word].sum(1), sub.astype(np.float32)
            bs, xs = cells(keys[order], buckets, 7, lambda s: tuple(x[s] for x in parts))  # noqa: B023
            yield pa.RecordBatch.from_arrays([pa.array(bs, pa.int32()), pa.array(xs, pa.binary())], names=["b", "x"])
        trim()

    given = vocabulary.mapInArrow(marginal, "b int, x binary")
    asked = round_trip(packed, lambda batch, i: (np.unique(_keys(classed, *opened(batch, i)[:2])[0]), lambda s: None), _look_up, ANSWER, buckets, "found", 7, given)
    steps = len(GRID)
    names = [f"s{i}" for i in range(2 * steps)]
    id_type = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, off, train = opened(batch, i)
                keys, doc, kind = _keys(classed, data, off)
                m = len(train)
                found = merged(batch, i, "found", ANSWER)
                code, n = np.unique(doc * max(len(found), 1) + np.unique(keys, return_inverse=True)[1], return_counts=True)
                doc, at = code // max(len(found), 1), code % max(len(found), 1)
                f = found[at] if len(code) else found
                own, loo, base, known = _terms(kind[doc], f["ck"].astype(float), f["c"].astype(float), f["sub"].astype(float), n, train[doc], stat)
                e_own, e_loo, e_base, e_known = _terms(kind, k_ends[kind], np.full(m, float(ends)), np.full(m, math.log(end_share)), np.ones(m, np.int64), train, stat)
                sums = lambda x, y: np.bincount(doc, weights=x, minlength=m) + y  # noqa: B023, E731
                size = np.bincount(doc, weights=n, minlength=m).astype(np.int64) + 1
                out = [sums(x, y) + class_log[kind] - rising(np.full(m, a), size) for x, y, a in zip(own, e_own, GRID, strict=True)]
                out += [sums(x, y) - rising(np.full(m, a), size) for x, y, a in zip(loo, e_loo, GRID, strict=True)]
                ids = batch.column("ids").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [ids.field("id"), pa.array(train), pa.array(size), pa.array(sums(known, e_known).astype(np.int64)), pa.array(sums(base, e_base)), *map(pa.array, out)],
                    names=["id", "train", "n_tokens", "n_known", "base", *names],
                )
        trim()

    scored = asked.mapInArrow(score, f"id {id_type}, train boolean, n_tokens long, n_known long, base double, " + ", ".join(f"{c} double" for c in names))
    scored = checkpoint(scored)
    fit = scored.filter("train").agg(*[F.sum(c).alias(c) for c in names[steps:]]).collect()[0]
    best = max(range(steps), key=lambda i: fit[i]) if fit[0] is not None else 2
    return scored.select(
        F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), (F.col(names[best]) / math.log(10)).alias("score"), F.lit(GRID[best]).alias("concentration"),
    )


def class_keys(h: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Keys of tokens in classes."""
    return mix(h + np.uint64(STEP) * kind.astype(np.uint64))


def _keys(classed, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, document) of a pack's words and the documents' classes."""
    _, _, _, doc, h, kind = classed(data, off)
    return class_keys(h, kind[doc]), doc, kind


def _marked(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the words, each with the space that marks a word's start."""
    words = words.cast(pa.large_binary())
    off = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if len(words) else np.zeros(0, np.uint8)
    off = off - off[0]
    return np.insert(raw, off[:-1], 32), off + np.arange(len(off))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
    out = score_texts(docs, learn=rest != 2)
    return out.withColumn("held_out", F.coalesce(rest == 2, F.lit(False))).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "concentration"
    )


QUERIES = {"op2_lm_scoring": op2_lm_scoring}
ORACLE: dict[str, str] = {}
