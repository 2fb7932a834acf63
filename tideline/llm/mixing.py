"""Mixing sources to target weights by soft membership.

Domains are the (quality, toxic) pairs of the labelled table. A softmax regression predicts each document's domain
posteriors from the presence of words and from shape. Its vocabulary: over all labelled rows, counts by domain of
documents that have a word's bucket (2**BUCKETS buckets), of which the FEATURES with the largest chi-square are used. It
is fitted on a bounded sample of labelled rows, SAMPLE at most, the least hashes of their ids.

Rates: nonnegative document rates r minimise the squared differences of the expected token totals of domains,
sum_i r_i t_i p_id, from targets, each relative to the domain's present tokens, plus RIDGE times the token-weighted squared
distance of r from 1, which chooses among the many minima. They are r_i = max(0, 1 - p_i y): gradient steps on the k values
y, preconditioned by the k x k curvature of the rows with r_i > 0, so neither long texts nor small domains slow a step. A
round sends one row of sums to the driver. Rounds end where the gradient vanishes; if it does not, an error is raised.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U64, discard, few, ints, keyed, real_id, slices, span_hash, text_buffer, whole_row, word_bounds, written

BUCKETS, FEATURES, SAMPLE = 16, 384, 20_000
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes counted by the shape features.
MARKS = [np.isin(np.arange(256), list(map(ord, x))) for x in ("#*$%&", "|<>{}[]", "!?", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "\n")]


def document_words(batch, column: str):
    """By row slices: the slice, bytes, offsets, and for each word (a run of letters, A-Z lowered) its document and bucket; and whitespace-word counts."""
    for part in slices(batch, column):
        buf, off = text_buffer(part.column(part.schema.get_field_index(column)))
        starts, ends, own = word_bounds(buf, off, LETTER)
        bucket = (span_hash(LOWER[buf], starts, ends) >> U64(64 - BUCKETS)).astype(np.int64)
        tokens = np.diff(word_bounds(buf, off)[2])
        yield part, buf, off, np.repeat(np.arange(len(part)), np.diff(own)), bucket, tokens


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of values between successive offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def shape(buf, off, tokens) -> np.ndarray:
    size = np.maximum(np.diff(off), 1)
    shares = [np.sqrt(sums(m[buf], off) / size) for m in MARKS]
    return np.stack([*shares, np.log1p(tokens) / 8, np.diff(off) / np.maximum(tokens, 1) / 10], axis=1)


PARSED = "id long, crc long, tokens long, shape binary, words binary"


def parsed(docs: DataFrame, rows: bool = False) -> DataFrame:
    """id, crc, tokens, shape (float32) and words (the distinct buckets, as two bytes each) of each row of docs; with rows also the row itself."""
    more = ["row"] if rows else []

    def run(batches):
        for b in batches:
            at = 0
            for part, buf, off, doc, bucket, tokens in document_words(b, "text"):
                n = len(part)
                pair = np.unique(doc << BUCKETS | bucket)
                ends = np.searchsorted(pair, np.arange(n + 1) << BUCKETS)
                form = shape(buf, off, tokens).astype("<f4")
                made = [pa.array(tokens), blobs(form, np.arange(n + 1) * form.shape[1] * 4), blobs((pair & (1 << BUCKETS) - 1).astype("<u2"), ends * 2)]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(at, n) for i in (0, 1)), *made, *(column(b, c).slice(at, n) for c in more)], ["id", "crc", "tokens", "shape", "words", *more])
                at += n

    own = keyed(docs, *([whole_row(docs)] if rows else []))
    return written(own.mapInArrow(run, PARSED + "".join(f", {c} {own.schema[c].dataType.simpleString()}" for c in more)), "parsed")


def blobs(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def word_pairs(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each distinct word of the rows of a batch of parsed()."""
    buf, off = text_buffer(column(b, "words"))
    return np.repeat(np.arange(len(b)), np.diff(off) // 2), np.frombuffer(buf.tobytes(), "<u2").astype(np.int64)


def presence(b: pa.RecordBatch, place: np.ndarray) -> np.ndarray:
    """For each row of a batch of parsed() 1 for the chosen buckets that it has (place: bucket to column or -1)."""
    x = np.zeros((len(b), place.max(initial=-1) + 1), np.uint8)
    doc, bucket = word_pairs(b)
    at = place[bucket]
    x[doc[at >= 0], at[at >= 0]] = 1
    return x


def matrix(present: np.ndarray, form: bytes) -> np.ndarray:
    """Features of each row: presence of chosen buckets, shape, and 1."""
    n = len(present)
    return np.concatenate([present.astype(np.float32), np.frombuffer(form, "<f4").reshape(n, -1), np.ones((n, 1), np.float32)], axis=1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Softmax regression by accelerated gradient steps on scaled features; the last one, 1, is the intercept."""
    x = x.astype(np.float32)
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 0.01)
    mean[-1], sd[-1] = 0, 1
    x = (x - mean) / sd
    w = np.zeros((x.shape[1], k), np.float32)
    v, goal = w.copy(), np.eye(k, dtype=np.float32)[y]
    bound = 0.5 * np.linalg.norm(x.T @ x / len(x), 2) + ridge
    for i in range(rounds):
        new = v - (x.T @ (softmax(x @ v) - goal) / len(x) + ridge * v) / bound
        v, w = new + i / (i + 3) * (new - w), new
    w = w / sd[:, None]
    w[-1] -= mean[:-1] @ w[:-1]
    return w


def posteriors(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, carry: bool = False) -> tuple[DataFrame, list[str]]:
    """id, crc, tokens and p (array by domain) of each row of docs, and the domains' names; with carry also row, all of its columns.

    No labelled row: one domain, `all`. Labels that repeat a doc_id count once, by their largest values."""
    marked = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.concat(F.lit("q"), F.max("quality"), F.lit("t"), F.max("toxic")).alias("domain"))
    domains = sorted(r[0] for r in marked.select("domain").distinct().collect())  # pairs of label values
    rows = parsed(docs, carry)
    known = rows.join(few(written(marked, "marked")), "id")
    schema = "domain string, bucket int, n long"

    def count(batches):
        total = {}
        for b in batches:
            names = np.array(column(b, "domain").to_pylist(), object)
            doc, bucket = word_pairs(b)
            for d in set(names):
                t = total.setdefault(d, np.zeros((1 << BUCKETS) + 1, np.int64))
                t[:-1] += np.bincount(bucket[(names == d)[doc]], minlength=1 << BUCKETS)
                t[-1] += (names == d).sum()
        for d, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_pydict({"domain": [d] * len(at), "bucket": at.astype(np.int32), "n": t[at]})

    k = max(1, len(domains))
    place, w = np.full(1 << BUCKETS, -1), None
    if k > 1:
        counts = known.select("words", "domain").mapInArrow(count, schema).groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most k 2**BUCKETS rows
        table = np.zeros((k, (1 << BUCKETS) + 1))
        table[counts.domain.map({d: i for i, d in enumerate(domains)}), counts.bucket] = counts.n
        n, have = table[:, -1:], table[:, :-1]
        share = have.sum(0) / max(1, n.sum())
        chi = ((have - n * share) ** 2 / np.maximum(n * share * (1 - share), 1e-9)).sum(0)
        chi[have.sum(0) < 5] = 0
        best = np.sort(np.argsort(-chi, kind="stable")[:FEATURES])
        place[best] = np.arange(len(best))
        chosen = known.select("id", "crc", "domain").distinct().orderBy(F.xxhash64("id", "crc"), "id", "crc").limit(sample)
        learn = rows.join(F.broadcast(chosen), ["id", "crc"]).select("id", "crc", "domain", "shape", "words")

        def features(batches):
            for b in batches:
                bits = np.packbits(presence(b, place), axis=1)
                yield pa.RecordBatch.from_arrays([*(column(b, n) for n in ("id", "crc", "domain", "shape")), blobs(bits, np.arange(len(b) + 1) * bits.shape[1])], ["id", "crc", "domain", "shape", "bits"])

        # rows that repeat (id, crc) count once: sample rows at most, of about 100 bytes
        got = learn.mapInArrow(features, "id long, crc long, domain string, shape binary, bits binary").dropDuplicates(["id", "crc"]).toPandas().sort_values(["id", "crc"])
        w = np.zeros((len(best) + len(MARKS) + 3, k))
        if not got.empty:
            bits = np.frombuffer(b"".join(got.bits), np.uint8).reshape(len(got), -1)
            w = fit(matrix(np.unpackbits(bits, axis=1, count=len(best)), b"".join(got["shape"])), got.domain.map({d: i for i, d in enumerate(domains)}).to_numpy(), k)

    def predict(batches):
        for b in batches:
            n, (form, off) = len(b), text_buffer(column(b, "shape"))
            p = softmax(matrix(presence(b, place), form.tobytes()) @ w) if k > 1 else np.ones((n, 1))
            own = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.round(p.astype(np.float64), 9).ravel()))
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("id", "crc", "tokens")), own, *(column(b, c) for c in more)], ["id", "crc", "tokens", "p", *more])

    more = ["row"] if carry else []
    kept = rows.select("id", "crc", "tokens", "shape", "words", *more)
    return kept.mapInArrow(predict, "id long, crc long, tokens long, p array<double>" + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in more)), domains or ["all"]


#: Weight of the rates' distance from 1 against the domains' relative errors; step lengths tried in a round; and the
#: gradient, relative to a domain's tokens, at which rounds end.
RIDGE, LENGTHS, FLAT = 1e-5, (1.0, 1 / 4, 1 / 16, 1 / 64), 1e-6


def rates(members: DataFrame, targets: np.ndarray, rounds: int = 60, rows: DataFrame | None = None) -> tuple[DataFrame, np.ndarray]:
    """members (tokens, p), or else the given rows of the same values, with rate, and the expected totals at the end. Targets: tokens by domain.

    Tokens and targets are scaled by the corpus's. Raises RuntimeError if `rounds` steps do not reach the minimum. A domain's
    error there is RIDGE times its y of its tokens: nearly none, except where posteriors put the target out of reach."""
    k = len(targets)
    total = float(members.agg(F.sum("tokens")).first()[0] or 0) or 1.0
    goal = targets / total

    def fitted(t: np.ndarray, p: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(t > 0, np.maximum(0.0, 1 - p @ y), 1.0)

    def arrays(b):
        return ints(b.column(b.schema.get_field_index("tokens"))).astype(float), b.column(b.schema.get_field_index("p")).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)

    def sums_at(places: np.ndarray) -> np.ndarray:
        """By place (a y): half the weighted sum of squared rates, the domains' totals and their curvature."""

        def run(batches):
            got = np.zeros((len(places), 1 + k + k * k))
            for b in batches:
                t, p = arrays(b)
                t /= total
                for one, y in zip(got, places):
                    r = fitted(t, p, y)
                    one += np.concatenate([[t @ (r * r) / 2], (r * t) @ p, ((p * (t * (r > 0))[:, None]).T @ p).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([got.ravel()])], ["v"])

        def add(batches):
            got = sum((b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1).sum(axis=0) for b in batches if len(b)), np.zeros(len(places) * (1 + k + k * k)))
            yield pa.RecordBatch.from_arrays([pa.array([got])], ["v"])

        # without a key: one row of partial sums a task, and one task that adds them
        got = members.select("tokens", "p").mapInArrow(run, "v array<double>").repartition(1).mapInArrow(add, "v array<double>").first()
        return np.array(got[0] if got else np.zeros(len(places) * (1 + k + k * k))).reshape(len(places), -1)

    y = np.zeros(k)
    now = at = sums_at(y[None])[0]
    now = now[1 : k + 1]
    live = now > 0  # the others' totals are 0 at any rates
    for turn in range(rounds + 1):
        e = at[1 : k + 1]
        slope = np.where(live, goal - e + RIDGE * now * y, 0.0)
        if (np.abs(slope) <= FLAT * now).all():
            break
        if turn == rounds:
            raise RuntimeError(f"rates did not converge in {rounds} rounds: gradient relative to tokens {(np.abs(slope)[live] / now[live]).max():.2g}")
        curve = at[k + 1 :].reshape(k, k) + np.diag(np.where(live, RIDGE * now, 1.0))
        places = y - np.array(LENGTHS)[:, None] * np.linalg.solve(curve, slope)
        tried = sums_at(places)
        best = int(np.argmin(tried[:, 0] + places @ np.where(live, goal, 0.0) + RIDGE / 2 * (places * places) @ now))
        y, at = places[best], tried[best]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fitted(*arrays(b), y))], [*b.schema.names, "rate"])

    out = members if rows is None else rows
    return out.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in out.dtypes) + ", rate double"), e * total


#: Shares of each domain's tokens to be kept, by (quality, toxic): good text whole, low quality halved, toxic text a tenth.
KEEP = {"q1t0": 1.0, "q0t0": 0.5, "q1t1": 0.1, "q0t1": 0.0}


def mixed(docs: DataFrame, labels: DataFrame, keep: dict[str, float] = KEEP, targets: dict[str, float] | None = None, carry: bool = False) -> tuple[DataFrame, list[str]]:
    """For each row of docs: id, crc, tokens, p, rate and copies, and the domains' names; with carry also row, all its columns as a struct.

    targets: tokens by domain to be reached; a domain that is not named keeps what it has. Without targets they are each
    domain's expected tokens times keep (1 if not named). copies: the rate's whole part, and one more with the probability
    of the rest, by a hash of the id and text, so that expected copies are the rates. Null and empty texts have no tokens
    and rate 1. Rows that repeat count each. An empty table gives an empty result."""
    found, domains = posteriors(docs, labels, carry=carry)
    members = written(found.drop("row"), "members")
    now = members.agg(*(F.sum(F.col("tokens") * F.get("p", F.lit(i))) for i in range(len(domains)))).first()
    now = [float(v or 0) for v in now]
    if targets is None:
        goal = [v * keep.get(d, 1.0) for d, v in zip(domains, now)]
    else:
        if unknown := sorted(set(targets) - set(domains)):
            raise ValueError(f"no such domains: {unknown}")
        goal = [float(targets.get(d, v)) for d, v in zip(domains, now)]
    # whole rows are stored once: their posteriors are predicted again where rates are applied
    rated, _ = rates(members, np.array(goal), rows=found if carry else None)
    chance = F.pmod(F.xxhash64("id", "crc", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return rated.withColumn("copies", F.floor(F.col("rate") + chance).cast("int")), domains


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op8: doc_id, tokens, domain (the likeliest), its posterior, rate and copies."""
    rows, domains = mixed(docs, labels)
    best = F.array_max("p")
    return rows.select(real_id(), "tokens", F.get(F.array(*map(F.lit, domains)), F.array_position("p", best).cast("int") - 1).alias("domain"), best.alias("posterior"), F.round("rate", 6).alias("rate"), "copies")
