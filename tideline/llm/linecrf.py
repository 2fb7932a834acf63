"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Features: shares of kinds of bytes, word lengths, words that repeat their predecessors, lines
that repeat in the text, and the same of the line before and after it. Lines take the label of their document for
learning; the sample is bounded: DOCS labelled rows with the least hashes of their ids, of texts of MOST_BYTES bytes at
most; a doc_id counts once. Length-weighted forward-backward marginals make up the document's share of good text, and a
logistic curve of that alone, fitted on the same sample, turns it into a score. All lines of all texts of a batch advance together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import few, keyed, real_id, slices, span_hash, text_buffer, word_bounds

DOCS, MOST_BYTES = 3_000, 32_768
#: Kinds of bytes of which each line's share is a feature.
KINDS = [np.isin(np.arange(256), list(k)) for k in (b"#*$%&", b"|<>{}[]", b"!?", b"0123456789", bytes(range(0x41, 0x5B)), b".,;:", b" \t", bytes(range(0x80, 0x100)))]
NOT_BREAK = np.arange(256) != 0x0A


def lines(buf: np.ndarray, off: np.ndarray):
    """Starts and ends of the nonempty lines, and by text the offsets into them."""
    return word_bounds(buf, off, NOT_BREAK)


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By line the features, by text the offsets of its lines, and by line its length."""
    starts, ends, own = lines(buf, off)
    n, size = len(starts), (ends - starts).astype(np.float64)
    between = lambda x: (lambda t: t[ends] - t[starts])(np.concatenate([[0], np.cumsum(x, dtype=np.int32)]))
    shares = [np.sqrt(between(k[buf]) / size) for k in KINDS]
    ws, we, _ = word_bounds(buf, off)
    wl = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    words = np.maximum(wl[1] - wl[0], 1)
    h = span_hash(buf, ws, we)
    total = lambda x: (lambda t: t[wl[1]] - t[wl[0]])(np.concatenate([[0], np.cumsum(x, dtype=np.int64)]))
    stutter = np.zeros(len(h), bool)
    stutter[1:] = h[1:] == h[:-1]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(own))
    key = span_hash(buf, starts, ends)
    order = np.lexsort((key, doc))
    again = np.zeros(n, bool)
    if n:
        same = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        again[order[1:]] = same
        again[order[:-1]] |= same
    # long words that the text has among its near equals before: cycles of junk
    echo = np.zeros(len(h), bool)
    if len(h) > 1:
        by = np.lexsort((np.arange(len(h)), h, np.searchsorted(off, ws, "right")))
        near = (h[by[1:]] == h[by[:-1]]) & (by[1:] - by[:-1] < 64)
        long = (we - ws) >= 6
        echo[by[1:]] = near & long[by[1:]]
    base = np.stack([*shares, np.log1p(size) / 8, total(we - ws) / words / 10, total(stutter) / words, total(echo) / words, again.astype(float), size < 12], axis=1).astype(np.float32) if n else np.zeros((0, len(KINDS) + 6), np.float32)
    before, after = np.zeros_like(base), np.zeros_like(base)
    before[1:], after[:-1] = base[:-1], base[1:]
    before[own[:-1][own[:-1] < n]] = 0
    after[own[1:][own[1:] > 0] - 1] = 0
    return np.concatenate([base, before, after, np.ones((n, 1), np.float32)], axis=1), own, size


def marginals(odds: np.ndarray, own: np.ndarray, trans: np.ndarray, learn: bool = False):
    """Probabilities that each line is good, from its log odds and the 2 x 2 log transitions; with learn also the expected transitions and log normalisers."""
    n = np.diff(own)
    by = np.argsort(-n, kind="stable")
    first, length = own[by], n[by]
    good = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    emit = np.stack([1 - good, good], axis=1)
    move = np.exp(trans)
    fore, back = np.empty_like(emit), np.ones_like(emit)
    scale, steps = np.ones(len(emit)), int(length.max(initial=0))
    live = np.searchsorted(-length, -np.arange(steps + 1), "left")
    for t in range(steps):
        at = first[: live[t]] + t
        a = emit[at] * (fore[at - 1] @ move if t else 0.5)
        scale[at] = a.sum(axis=1)
        fore[at] = a / scale[at][:, None]
    for t in range(steps - 2, -1, -1):
        at = first[: live[t + 1]] + t
        b = (emit[at + 1] * back[at + 1]) @ move.T
        back[at] = b / b.sum(axis=1, keepdims=True)
    both = fore * back
    p = both[:, 1] / np.maximum(both.sum(axis=1), 1e-300)
    if not learn:
        return p
    inner = np.ones(len(emit), bool)
    inner[own[:-1][n > 0]] = False
    at = np.flatnonzero(inner)
    pair = fore[at - 1][:, :, None] * move * (emit[at] * back[at])[:, None, :]
    return p, (pair / np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0), at


class Model:
    def __init__(self, x: list[np.ndarray], y: np.ndarray, rounds: int = 150, ridge: float = 1e-4):
        own = np.concatenate([[0], np.cumsum([len(a) for a in x])])
        size = np.concatenate([np.expm1(a[:, len(KINDS)] * 8) for a in x])
        x = np.concatenate(x)
        self.mean, self.sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        self.mean[-1], self.sd[-1] = 0, 1
        x = (x - self.mean) / self.sd
        line = np.repeat(y, np.diff(own)).astype(float)
        # each document weighs the same, whatever its number of lines
        weight = np.repeat(1 / np.maximum(np.diff(own), 1), np.diff(own))
        weight /= weight.sum()
        w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
        m, v, k = [np.zeros_like(w), np.zeros_like(trans)], [np.zeros_like(w), np.zeros_like(trans)], len(y)
        for t in range(1, rounds + 1):
            p, moved, at = marginals(x @ w, own, trans, learn=True)
            seen = np.zeros((2, 2))
            np.add.at(seen, (line[at - 1].astype(int), line[at].astype(int)), 1)
            grads = [x.T @ ((line - p) * weight) - ridge * w, (seen - moved) / max(1, len(at)) - 1e-3 * trans]
            for i, (param, g) in enumerate(zip((w, trans), grads)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                param += 0.1 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
            np.clip(trans, -1.5, 1.5, out=trans)  # lines of one document share its label: without a bound the chain would never change
        self.w, self.trans = w, trans
        z = np.stack([np.ones(k), self.share(x, own, size, ready=True)], axis=1)
        c = np.zeros(2)
        for _ in range(50):  # Newton steps of a logistic regression with a small ridge
            q = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
            c += np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + 0.05 * np.eye(2), z.T @ (y - q) - 0.05 * c)
        self.curve = c

    def share(self, x, own, size, ready: bool = False) -> np.ndarray:
        """By text the length-weighted mean marginal of its lines, as log odds; 0 without a line."""
        p = marginals((x if ready else (x - self.mean) / self.sd) @ self.w, own, self.trans)
        total = lambda v: (lambda t: t[own[1:]] - t[own[:-1]])(np.concatenate([[0], np.cumsum(v)]))
        n = np.maximum(total(size), 1e-9)
        mean = np.clip(np.where(n > 1e-6, total(size * p) / n, 0.5), 1e-4, 1 - 1e-4)
        return np.log(mean / (1 - mean))

    def score(self, buf, off):
        x, own, size = features(buf, off)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * self.share(x, own, size), -30, 30)))


def held_out(column):
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(5)) == 0


def learn(docs: DataFrame, labels: DataFrame, most: int = DOCS) -> Model | None:
    """Of labelled rows outside the held-out fifth; None if they do not have both labels."""
    marked = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").alias("quality"))
    rows = keyed(docs)
    fits = rows.select("id", "crc", F.octet_length("text").alias("n")).where(F.col("n") <= MOST_BYTES).join(few(marked), "id")
    chosen = fits.groupBy("id").agg(F.min("crc").alias("crc"), F.max("quality").alias("quality")).orderBy(F.xxhash64("id"), "id").limit(most)
    rows = rows.join(F.broadcast(chosen), ["id", "crc"]).select("id", "crc", "quality", "text").dropDuplicates(["id", "crc"])

    def run(batches):
        for b in batches:
            for part in slices(b, "text"):
                x, own, _ = features(*text_buffer(part.column(3)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([x[own[i] : own[i + 1]].tobytes() for i in range(len(part))], pa.binary())], ["id", "crc", "quality", "x"])

    got = rows.mapInArrow(run, "id long, crc long, quality int, x binary").toPandas().sort_values(["id", "crc"])
    got = got[got.x.map(len) > 0]
    if got.quality.nunique() < 2:
        return None
    width = 3 * (len(KINDS) + 6) + 1
    return Model([np.frombuffer(x, np.float32).reshape(-1, width).astype(np.float64) for x in got.x], got.quality.to_numpy().astype(float))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each row of docs: id, crc and score, the probability of label 1.

    Null and empty texts have no line: their share of good text is one half. Without labels of both kinds all scores are 0.5.
    Rows that repeat get equal scores; labels that repeat a doc_id count once, by the largest; an empty table gives an empty
    result."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches):
        model = sent.value
        for b in batches:
            for part in slices(b, "text", 2 << 20):
                buf, off = text_buffer(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(model.score(buf, off) if model else np.full(len(part), 0.5))], ["id", "crc", "score"])

    return keyed(docs).mapInArrow(run, "id long, crc long, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op10: one row for each document."""
    return scored(docs, labels).select(real_id(), F.coalesce(held_out(real_id()), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
