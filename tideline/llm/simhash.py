"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: a bit is 1 if it is set in over half of the XXH64 (seed 42) of the text's three-word shingles.

Links: fingerprints within the radius. Distinct fingerprints are cut in m blocks; two of them that differ in at most r
bits agree in at least m - r blocks, so each choice of m - r blocks is a key, and rows that share a key are compared. m
follows the number of distinct fingerprints so that keys stay selective: every choice is exact. A task holds
fingerprints vertically, one array of 64-bit words for each bit plane, so that one instruction updates 64 distances;
carry-save counters of two bits and an overflow plane count the differing bits, and words whose 64 distances have all
overflowed are abandoned. A task returns a star for each of its connected sets and never the pairs.

similar() links texts by sets of shingles: fingerprints of 128 bits and a radius that no blocks make selective. Sizes of the
sets decide who meets, cells of both bound the tasks, adders of carry-save counters count all bits, and sets are compared last.

Components: alternating large-star and small-star rounds over the stars, as joins; each round is written to the shared
folder. Exact copies share a fingerprint and are one node, whatever their number.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U64, few, ints, keyed, mix, real_id, written

TILE = 2048
LARGE = 4 * TILE
ALL = U64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned fingerprint of a text; 0 if it has no word."""
    words = text.lower().split()  # of bytes: lowers A-Z only, splits at \x20 and \x09-\x0D
    if not words:
        return 0
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, k = (ends - size).tolist(), min(shingle, len(words))
    ends = ends[k - 1 :].tolist()
    total, one, n, digest = np.zeros(64, np.int64), 1 << 16, len(ends), xxhash.xxh64_intdigest
    for at in range(0, n, one):
        h = np.fromiter((digest(flat[s:e], 42) for s, e in zip(starts[at : at + one], ends[at : at + one])), U64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """id, crc and fp (signed) of each row of docs. Null text: no words."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in b.column(2)), U64, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["id", "crc", "fp"])

    return keyed(docs).mapInArrow(run, "id long, crc long, fp long")


# ---------------------------------------------------------------- links


def planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of words (more if fps have several each): bit j of word w of row b is bit b of fps[64 w + j]. Padding repeats no fingerprint: see pairs()."""
    n = -len(fps) % 64
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8 * (fps.shape[1] if fps.ndim > 1 else 1)), axis=1, bitorder="little").T
    return np.ascontiguousarray(np.packbits(np.pad(bits, ((0, 0), (0, n))), axis=1, bitorder="little")).view("<u8")


def pairs(queries: np.ndarray, fps: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j) with queries[i] within radius (at most 3) of fps[j]."""
    vertical = planes(fps)
    sign = np.where((queries[None, :] >> np.arange(64, dtype=U64)[:, None]) & U64(1), ALL, U64(0))
    shape = (len(queries), vertical.shape[1])
    ones, twos, over = (np.zeros(shape, U64) for _ in range(3))
    q = w = None
    for b in range(64):
        if b and b % 8 == 0:  # abandon words of which every distance is beyond the counters
            live = np.flatnonzero(over.ravel() != ALL) if q is None else np.flatnonzero(over != ALL)
            q, w = (live // shape[1], live % shape[1]) if q is None else (q[live], w[live])
            ones, twos, over = (x.ravel()[live] for x in (ones, twos, over))
            if not len(live):
                break
        differ = vertical[b][None, :] ^ sign[b][:, None] if q is None else vertical[b][w] ^ sign[b][q]
        carry = ones & differ
        ones ^= differ
        over |= twos & carry
        twos ^= carry
    far = over | {3: U64(0), 2: ones & twos, 1: twos, 0: ones | twos}[radius]
    bits = np.unpackbits((~far).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(q) else np.zeros((0, 64), np.uint8)
    at, j = np.nonzero(bits)
    j = w[at] * 64 + j
    real = j < len(fps)
    return q[at][real], j[real]


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(fps: np.ndarray, radius: int = 3, free: tuple = tuple(range(64))) -> np.ndarray:
    """Labels of distinct fingerprints that are linked within the radius. free: the bits in which they may differ.

    A set beyond LARGE is split anew by the pigeonhole principle over its free bits, as long as there are enough of them."""
    n = len(fps)
    if n > LARGE and len(free) >= 2 * (radius + 1):
        label, parts = np.arange(n), np.array_split(np.array(free), radius + 1)
        for part in parts:
            mask = U64(sum(1 << int(b) for b in part))
            order = np.argsort(fps & mask, kind="stable")
            key = (fps & mask)[order]
            cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), n]
            rest = tuple(b for b in free if b not in set(part.tolist()))
            for rows in runs(cut):
                own = order[rows[0] : rows[1]]
                if len(own) > 1:
                    got = linked(fps[own], radius, rest if rows[2] else free[: 2 * radius]) if len(own) > TILE else all_linked(fps[own], radius)
                    label = stars(n, np.concatenate([own, np.arange(n)]), np.concatenate([own[got], label]))
        return label
    return all_linked(fps, radius)


def runs(cut: list[int], most: int = TILE):
    """Groups of whole buckets of up to most rows; a larger bucket stands alone. (from, to, is one bucket)"""
    at, k = 0, 0
    while k < len(cut) - 1:
        k += 1
        while k < len(cut) - 1 and cut[k + 1] - cut[at] <= most:
            k += 1
        yield cut[at], cut[k], k == at + 1
        at = k


def all_linked(fps: np.ndarray, radius: int) -> np.ndarray:
    label, n = np.arange(len(fps)), len(fps)
    for at in range(0, n, TILE):
        i, j = pairs(fps[at : at + TILE], fps[at:], radius)
        label = stars(n, np.concatenate([i + at, np.arange(n)]), np.concatenate([j + at, label]))
    return label


def plan_blocks(n: int, radius: int) -> list[int]:
    """Masks of the keys: m blocks of which m - radius must agree; the fewest keys under which about 64 of n random rows share one."""
    for m in range(radius + 1, 2 * radius + 3):
        parts = [sum(1 << int(b) for b in p) for p in np.array_split(np.arange(64), m)]
        keys = [sum(c) for c in combinations(parts, m - radius)]
        if n / 2 ** min(k.bit_count() for k in keys) <= 64:
            break
    return keys


def links(distinct: DataFrame, n: int, radius: int = 3) -> DataFrame:
    """Stars (a, b) of linked fingerprints of the table distinct (fp), which has n rows."""
    masks = plan_blocks(n, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))).alias("k")
    rows = distinct.select("fp", keys).select("k.t", "k.key", "fp").repartition("t", "key").sortWithinPartitions("t", "key")
    free = [tuple(b for b in range(64) if not m >> b & 1) for m in masks]

    def compare(t, key, fp):
        cut = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (t[1:] != t[:-1])) + 1).tolist(), len(fp)]
        for at, to, one in runs(cut):
            if to - at > 1:
                own = fp[at:to]
                label = linked(own, radius, free[t[at]]) if one else all_linked(own, radius)
                if (far := np.flatnonzero(label != np.arange(len(own)))).size:
                    yield pa.RecordBatch.from_arrays([pa.array(own[far].view(np.int64)), pa.array(own[label[far]].view(np.int64))], ["a", "b"])

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        for b in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, b.columns)]
            t, key, fp = held
            if len(fp) >= LARGE and (last := np.flatnonzero((key != key[-1]) | (t != t[-1]))).size:  # the last bucket may go on
                k = last[-1] + 1
                yield from compare(t[:k], key[:k], fp[:k].view(U64))
                held = [x[k:] for x in held]
        if len(held[0]):
            yield from compare(held[0], held[1], held[2].view(U64))

    return rows.mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- components


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the least node of its component) for each node of edges (a, b), by large-star and small-star rounds."""
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        edges = written(small, "edges")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """For each row of docs: id, crc, fp (signed 64-bit), root (a fingerprint that names its component) and component_id,
    the least doc_id that links reach (null if none has one).

    Texts without words have fingerprint 0 and are linked like any other. Rows that repeat a doc_id are kept apart by their texts."""
    prints = written(fingerprints(docs, shingle), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    roots = components(links(nodes.select("fp"), nodes.count(), radius))
    known = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("low").alias("component"))
    return prints.join(known.join(least, "root").select("fp", "root", "component"), "fp").select("id", "crc", "fp", "root", real_id("component").alias("component_id"))


# ---------------------------------------------------------------- similarity of shingle sets

#: Bits in which the 128-bit fingerprints of two sets may differ. At similarity 0.8 a bit differs with probability 0.151: more do with 1.5e-4.
RADIUS = 34
#: Nodes that a cell compares with about as many others, or hashes of nodes that come with their sets.
CELL, HASHES = 1 << 15, 1 << 22
#: Queries and words of 64 nodes that one instruction takes.
QUERIES, WORDS = 256, 64
#: Close pairs by node up to which a cell returns them as rows.
DENSE = 8


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles; of a shorter text, of all its words. Words as in fingerprint()."""
    words = text.lower().split()
    k = min(shingle, len(words))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)), U64)) if words else np.zeros(0, U64)


def set_print(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of a set in two words: of its hashes, and of these mixed once more."""
    total = np.zeros(128, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        h = hashes[at : at + (1 << 14)]
        total += np.unpackbits(np.stack([h, mix(h)], axis=1).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")


def counters(planes_of) -> list[np.ndarray]:
    """The number of ones at each place of the given planes, bit by bit from the lowest: carry-save adders of three planes."""
    levels: list[list] = [[]]

    def put(x, at):
        if at == len(levels):
            levels.append([])
        levels[at].append(x)
        if len(levels[at]) == 3:
            a, b, c = levels[at]
            half = a ^ b
            levels[at] = [half ^ c]
            put((a & b) | (half & c), at + 1)

    for x in planes_of:
        put(x, 0)
    at = 0
    while at < len(levels):
        if len(levels[at]) == 2:
            a, b = levels[at]
            levels[at] = [a ^ b]
            put(a & b, at + 1)
        at += 1
    return [x[0] for x in levels]


def near(queries: np.ndarray, vertical: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j) with queries[i], of several words each, within radius of lane j of the planes."""
    bits = np.unpackbits(np.ascontiguousarray(queries).view(np.uint8), axis=1, bitorder="little").T
    sign = np.where(bits == 1, ALL, U64(0))
    count = counters(v[None, :] ^ s[:, None] for v, s in zip(vertical, sign))
    far, even = np.zeros_like(count[0]), np.full_like(count[0], ALL)
    for at in range(len(count) - 1, -1, -1):
        if radius >> at & 1:
            even &= count[at]
        else:
            far |= even & count[at]
            even &= ~count[at]
    if radius >> len(count):
        far[:] = 0
    word = np.flatnonzero(far != ALL)
    at, lane = np.nonzero(np.unpackbits((~far.ravel()[word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return word[at] // vertical.shape[1], word[at] % vertical.shape[1] * 64 + lane


def close(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, same: bool, least: float, radius: int):
    """Pairs (i, j) of fingerprints x and y within the radius whose sets' sizes sx and sy, both ascending, allow the similarity. same: x is y, i < j."""
    vertical = planes(y)
    for at in range(0, len(x), QUERIES):
        own = sx[at : at + QUERIES]
        first = at if same else int(np.searchsorted(sy, least * own[0] - 1e-6))
        stop = int(np.searchsorted(sy, own[-1] / least + 1e-6, "right"))
        for w in range(first // 64, -(-stop // 64), WORDS):
            i, j = near(x[at : at + QUERIES], vertical[:, w : w + WORDS], radius)
            i, j = i + at, j + 64 * w
            good = j < stop
            i, j = i[good], j[good]
            good = np.minimum(sx[i], sy[j]) >= least * np.maximum(sx[i], sy[j]) - 1e-6
            if same:
                good &= i < j
            if good.any():
                yield i[good], j[good]


def size_classes(least: float) -> np.ndarray:
    """Least sizes of classes. Sets alike by least are of the same class or of neighbours."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(int(edges[-1] / least + 1e-6) + 1)
    return np.array(edges)


def deal(nodes: DataFrame, parts: dict[int, int]) -> DataFrame:
    """A row for each cell in which a node is compared: a class (level) is cut in so many parts, and each part meets each of
    its class and of the next one."""
    names = [c for c in nodes.columns if c != "level"]

    def run(batches):
        for b in batches:
            node, level = ints(b.column(0)), ints(b.column(b.schema.get_field_index("level")))
            for k in np.unique(level).tolist():
                own = np.flatnonzero(level == k)
                i = (mix(node[own].view(U64)) % U64(parts[k])).astype(np.int64)
                meet = [(2 * k, np.minimum(i, j), np.maximum(i, j), i > j) for j in range(parts[k])]
                meet += [(2 * k + 1, i, j, i < 0) for j in range(parts.get(k + 1, 0))] + [(2 * k - 1, j, i, i >= 0) for j in range(parts.get(k - 1, 0))]
                rows = [b.column(b.schema.get_field_index(c)).take(pa.array(own)) for c in names]
                for kind, left, right, side in meet:
                    cell = ((kind << 24) + left << 24) + right + np.zeros(len(own), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(side.astype(np.int32)), *rows], ["cell", "side", *names])

    cells = sum(p * (p + 1) // 2 + p * parts.get(k + 1, 0) for k, p in parts.items())
    dealt = nodes.mapInArrow(run, "cell long, side int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema if f.name != "level"))
    return dealt.repartition(max(1, min(cells, 10_000)), "cell").sortWithinPartitions("cell", "side", "size", "node")


def cells_of(batches):
    """Of each cell the columns of both of its sides, (node, fingerprint, size and more columns), and whether they are the same."""
    held = None
    for b in chain(batches, [None]):
        if b is not None:
            new = [np.array([*c.to_pylist(), None], object)[:-1] if pa.types.is_binary(c.type) else ints(c) for c in b.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if held is None or not len(held[0]):
            continue
        cuts = [0, *(np.flatnonzero(held[0][1:] != held[0][:-1]) + 1).tolist(), *([len(held[0])] if b is None else [])]
        for at, to in zip(cuts[:-1], cuts[1:]):
            cell, side, node, low, high, *more = (x[at:to] for x in held)
            columns = [node, np.stack([low, high], axis=1).view(U64), *more]
            kind, left, right = cell[0] >> 48, cell[0] >> 24 & 0xFFFFFF, cell[0] & 0xFFFFFF
            same, k = bool(kind % 2 == 0 and left == right), int(np.searchsorted(side, 1))
            yield (columns, columns, same) if same else ([c[:k] for c in columns], [c[k:] for c in columns], same)
        held = [x[cuts[-1] :] for x in held]


def compared(dealt: DataFrame, least: float, radius: int) -> DataFrame:
    """Close pairs (a, b) of nodes. Of a cell with many the nodes that have one, with b null."""

    def run(batches):
        for (nx, x, sx), (ny, y, sy), same in cells_of(batches):
            held, n, has_x, has_y = [], 0, np.zeros(len(nx), bool), np.zeros(len(ny), bool)
            for i, j in close(x, y, sx, sy, same, least, radius):
                has_x[i] = has_y[j] = True
                n += len(i)
                held = [*held, (nx[i], ny[j])] if n <= DENSE * (len(nx) + len(ny)) else []
            if n > DENSE * (len(nx) + len(ny)):
                held = [(np.concatenate([nx[has_x], ny[has_y]]), None)]
            for a, b in held:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def alike(one: np.ndarray, others: list[np.ndarray], least: float) -> np.ndarray:
    """Which of other sets, sorted and not empty, are alike to one set."""
    n = np.fromiter(map(len, others), np.int64, len(others))
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    common = np.add.reduceat(hit.astype(np.int64), np.cumsum(n) - n)
    return common >= least * (len(one) + n - common)


def joined(dealt: DataFrame, least: float, radius: int) -> DataFrame:
    """Links (a, b) of close nodes of which the sets are alike; in each cell only those that join what it has not joined before."""

    def run(batches):
        for (nx, x, sx, bx), (ny, y, sy, by), same in cells_of(batches):
            label, shift = np.arange(len(nx) + (0 if same else len(ny))), 0 if same else len(nx)
            a, b = [], []
            for i, j in close(x, y, sx, sy, same, least, radius):
                order = np.argsort(i, kind="stable")
                cut = np.flatnonzero(np.diff(i[order], prepend=-1, append=-1))
                for at, to in zip(cut[:-1], cut[1:]):
                    k, js = i[order[at]], j[order[at:to]]
                    one = np.frombuffer(bx[k], U64)
                    step = max(1, (1 << 22) // len(one))
                    for part in range(0, len(js), step):
                        some = js[part : part + step]
                        some = some[label[some + shift] != label[k]]
                        if len(some):
                            some = some[alike(one, [np.frombuffer(by[q], U64) for q in some], least)]
                            reached, first = np.unique(label[some + shift], return_index=True)
                            a += [nx[k]] * len(first)
                            b += ny[some[first]].tolist()
                            if len(first):
                                label[np.isin(label, reached)] = label[k]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def similar(docs: DataFrame, least: float = 0.8, shingle: int = 5, radius: int = RADIUS) -> DataFrame:
    """For each row of docs: id, crc and root, which names the component of texts whose sets of shingles are alike by Jaccard `least`.

    Nodes are distinct sets. Linked are those whose SimHash fingerprints lie within the radius and whose sets, compared as a
    whole, are alike. At this radius no blocks of bits are selective, so all nodes whose sizes allow the similarity are compared,
    bit-sliced. Texts of nodes that close pairs connect meet once, in one task that follows the pairs; where a cell has many
    pairs or a group many texts the nodes meet again in cells with their sets, so that pairs of a large group are never rows."""
    levels = size_classes(least)

    def set_of(t):
        return shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle)

    def sketch(batches):
        for b in batches:
            sets = [set_of(t) for t in b.column(2)]
            node = np.fromiter((xxhash.xxh64_intdigest(x.tobytes()) for x in sets), U64, len(b))
            prints = np.array([set_print(x) for x in sets], U64).reshape(-1, 2).view(np.int64)
            size = np.fromiter(map(len, sets), np.int64, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, (node.view(np.int64), prints[:, 0].copy(), prints[:, 1].copy(), size, np.searchsorted(levels, size, "right")))], ["id", "crc", "node", "low", "high", "size", "level"])

    rows = written(keyed(docs).mapInArrow(sketch, "id long, crc long, node long, low long, high long, size long, level long"), "sketches")
    nodes = written(rows.where("size > 0").groupBy("node", "low", "high", "size", "level").agg(F.min(F.struct("id", "crc")).alias("own")), "nodes")
    parts = {r.level: -(-r.n // CELL) for r in nodes.groupBy("level").agg(F.count("*").alias("n")).collect()}
    found = written(compared(deal(nodes.select("node", "low", "high", "size", "level"), parts), least, radius), "pairs")

    # close nodes by groups that close pairs connect; a group beyond HASHES, or with nodes whose pairs are no rows, is dealt to cells
    edges = written(found.where("b is not null").distinct(), "close")
    group = components(edges)
    ends = group.selectExpr("node", "root", "false AS dense").union(group.selectExpr("root AS node", "root", "false AS dense"))
    ends = ends.union(found.where("b is null").selectExpr("a AS node", "a AS root", "true AS dense"))
    own = nodes.join(ends.groupBy("node").agg(F.min("root").alias("root"), F.max("dense").alias("dense")), "node")
    large = own.groupBy("root").agg((F.max("dense") | (F.sum("size") > HASHES)).alias("large"))
    members = written(own.join(large, "root").select("node", "low", "high", "size", "level", "own.id", "own.crc", "root", "large"), "close-nodes")

    def texts_of(some: DataFrame) -> DataFrame:
        """some with the nodes' texts, which move only if some is too large to broadcast; rows that repeat (id, crc) repeat."""
        return keyed(docs).join(few(some, 2 * some.count()), ["id", "crc"]).drop("id", "crc")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        node = ints(left["node"]).tolist()
        sets, label = dict(zip(node, (set_of(t) for t in left["text"]))), {k: k for k in node}

        def root(k):
            while label[k] != k:
                label[k] = k = label[label[k]]
            return k

        joining = []
        for a, b in zip(ints(right["a"]).tolist(), ints(right["b"]).tolist()):
            if (x := root(a)) != (y := root(b)) and alike(sets[a], [sets[b]], least)[0]:
                label[x] = y
                joining.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in joining], pa.int64()), "b": pa.array([b for _, b in joining], pa.int64())})

    small = members.where("not large").select("id", "crc", "node", "root")
    texts = texts_of(small).repartition("root").dropDuplicates(["root", "node"])
    pairs = edges.join(small.select(F.col("node").alias("a"), F.col("root").alias("group")), "a")
    links = texts.groupBy("root").cogroup(pairs.groupBy("group")).applyInArrow(compare, "a long, b long")
    many = members.where("large").drop("root", "large")
    if not many.isEmpty():

        def with_sets(batches):
            for b in batches:
                text = b.column(b.schema.get_field_index("text"))
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array([set_of(t).tobytes() for t in text], pa.binary())], [*names, "hashes"])

        names = ["node", "low", "high", "size", "level"]
        sets = written(texts_of(many).dropDuplicates(["node"]).mapInArrow(with_sets, "node long, low long, high long, size long, level long, hashes binary"), "sets")
        parts = {r.level: -(-r.n // HASHES) for r in sets.groupBy("level").agg(F.sum("size").alias("n")).collect()}
        links = links.union(joined(deal(sets, parts), least, radius))
    return rows.join(components(links), "node", "left").select("id", "crc", F.coalesce("root", "node").alias("root"))


def query(docs: DataFrame) -> DataFrame:
    """op4: doc_id, fingerprint, component_id."""
    return near_duplicates(docs).select(real_id(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
