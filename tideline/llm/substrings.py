"""Substring dedup by prefix-partitioned suffix trees.

A suffix starts at a word and is cut after `span` words, as nodes below that depth decide nothing. Suffixes are split by
variable-length prefixes into groups of about `group` suffixes. The prefix is not the suffix's own, by which each would
travel alone with all its words, but that of its anchor: the place among its words whose next four have the least hash.
Equal suffixes have equal anchors, and successive suffixes mostly share theirs, so they travel as one run of words. One
scan counts suffixes by the hash of the first 1, 2 and 4 words from their anchor, and a suffix goes by the shortest prefix
whose count fits a group. Suffixes of a bin of four words that still holds more are split by the hash of all their words,
so that the number of groups follows that of suffixes.

Most suffixes occur once, and their words need not travel. So a group first gets fingerprints of FINGERPRINT bits, and
leaves out suffixes whose fingerprint no other document has: these are leaves below no deep node. The runs of the others
are fetched from their documents with their words. Fingerprints decide nothing else: of a group's suffixes one in some
thousands is fetched in vain.

Each group builds its subtree from the root down, by the words themselves: a node's suffixes are sorted by their next
words, which gives its children; leaves and nodes of one document are left there, as they decide nothing. What is left at
the depth of `span` words are the deep internal nodes. Their leaves in other documents than the node's least are removed,
and successive ones make up the maximal repeats. Hashes only say where suffixes meet.

Before the shuffle a task keeps, of suffixes in its block with equal words, those of the least document; the others are
already decided. So a passage in a third of all documents reaches its group once for each block. Runs travel as blobs of
byte planes. The decided places come back to the documents by row buckets of bounded size.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U64, chained, ints, keyed, mix, pack, plan_bytes, real_id, row_bucket, slices, span_hash, text_buffer, unpack, word_bounds, written

DEPTHS = (1, 2, 4)
#: Bits by which suffixes of a group are held against one another before their words are.
FINGERPRINT = 32
BLOB = "kind int, place int, origin int, ids binary, crcs binary, n binary, pos binary, size binary, code binary, words binary"
#: Bytes of files for each row bucket in the last stage.
BUCKET_BYTES = 8 << 20


def suffixes(buf: np.ndarray, off: np.ndarray, span: int):
    """Word hashes, first words of documents, and the places (word indexes) that have span words of one document from there on."""
    starts, ends, own = word_bounds(buf, off)
    n = np.diff(own)
    last = np.repeat(own[1:] - span, n)
    return span_hash(buf, starts, ends), own, np.flatnonzero(np.arange(len(starts)) <= last)


def prefixes(h: np.ndarray, at: np.ndarray, span: int, bits: int) -> list[np.ndarray]:
    """For each depth the bin of every suffix's prefix, which starts at its anchor."""
    depths = [d for d in DEPTHS if d <= span]
    least = chained(h, depths[-1])
    place, have, wide = np.arange(len(least)), 1, span - depths[-1] + 1
    while have < wide and len(least):
        step = min(have, wide - have)
        later = least[step:] < least[:-step]
        least = np.where(later, least[step:], least[:-step])
        place = np.where(later, place[step:], place[:-step])
        have += step
    return [(chained(h ^ U64(0x5851F42D4C957F2D), d)[place[at]] >> U64(64 - bits)).astype(np.int64) for d in depths]


def routes(docs: DataFrame, span: int, group: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of each (depth, bin), -1 where suffixes go by a longer prefix, and how many groups a bin of the last depth has."""

    def count(batches):
        total = np.zeros((len([d for d in DEPTHS if d <= span]), 1 << bits), np.int64)
        for b in batches:
            for part in slices(b, "text"):
                h, _, at = suffixes(*text_buffer(part.column(2)), span)
                for d, bins in enumerate(prefixes(h, at, span, bits)):
                    total[d] += np.bincount(bins, minlength=1 << bits)
        d, bins = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"d": d.astype(np.int32), "bin": bins.astype(np.int32), "n": total[d, bins]})

    got = docs.mapInArrow(count, "d int, bin int, n long").groupBy("d", "bin").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((len([d for d in DEPTHS if d <= span]), 1 << bits), np.int64)
    if got.num_rows:
        total[ints(got["d"]), ints(got["bin"])] = ints(got["n"])
    place, pieces, first = np.full(total.shape, -1, np.int32), -(-total[-1] // group), 0
    for d, n in enumerate(total):
        fits = np.flatnonzero((n > 0) & (n <= group))
        if len(fits):
            place[d, fits] = first + np.cumsum(n[fits]) // group
            first = int(place[d, fits].max()) + 1
    over = np.flatnonzero(pieces > 1)
    place[-1, over] = first + np.cumsum(pieces[over]) - pieces[over]
    return place, np.maximum(pieces, 1)


def routed(h: np.ndarray, at: np.ndarray, span: int, bits: int, whole: np.ndarray, route) -> np.ndarray:
    """The group of each suffix. whole: hashes of all their words, which split large bins."""
    place, pieces = route
    to = np.full(len(at), -1, np.int64)
    bins = prefixes(h, at, span, bits)
    for d, own in enumerate(bins):
        to = np.where(to < 0, place[d, own], to)
    by = pieces[bins[-1]]
    return np.where(by > 1, place[-1, bins[-1]] + (whole >> U64(40)).astype(np.int64) % by, to)


def numbered(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Words as numbers into their vocabulary: equal numbers if and only if equal bytes."""
    size = ends - starts
    stops = np.cumsum(size)
    flat = buf[np.repeat(starts - (stops - size), size) + np.arange(int(size.sum()))]
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], stops]).astype(np.int64)), pa.py_buffer(flat)])
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def of_runs(ids: np.ndarray, head: np.ndarray, which=np.minimum) -> np.ndarray:
    """By row the least (or largest) id of its run; head: first rows of runs."""
    return np.repeat(which.reduceat(ids, head), np.diff(head, append=len(ids))) if len(ids) else ids


def deep_nodes(word: np.ndarray, at: np.ndarray, ids: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaves (indexes of at) below nodes of span words that hold several ids, by node, and the first leaf of each node.

    word: numbers of words; a suffix is the span of them from at on. Level by level, several words a level."""
    wide = max(1, int(word.max(initial=0)).bit_length())
    live, node, depth = np.arange(len(at)), np.zeros(len(at), U64), 0
    head = np.zeros(min(1, len(at)), np.int64)
    while depth < span and len(live):
        many = max(1, (64 - int(node[-1]).bit_length()) // wide)
        for _ in range(min(many, span - depth)):
            node = (node << U64(wide)) | word[at[live] + depth].astype(U64)
            depth += 1
        order = np.argsort(node, kind="stable")
        live, node = live[order], node[order]
        head = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        keep = of_runs(ids[live], head) < of_runs(ids[live], head, np.maximum)
        live, node = live[keep], node[keep]
        new = np.concatenate([[True], node[1:] != node[:-1]])[: len(node)]
        head, node = np.flatnonzero(new), np.cumsum(new).astype(U64)
    return live, head


def blob(kind: int, place: int, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, crcs: np.ndarray, size: bytes = b"", code: bytes = b"", words: bytes = b"", origin: int = -1) -> dict:
    """Rows in order of doc: documents once with their numbers of rows, places as differences."""
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    step = np.diff(pos, prepend=0)
    step[first] = pos[first]
    counts = np.diff(first, append=len(doc)).astype(np.uint32)
    places = {"ids": pack(ids[doc[first]]), "crcs": pack(crcs[doc[first]].astype(np.uint32)), "n": pack(counts), "pos": pack(step.astype(np.int32))}
    return {"kind": kind, "place": place, "origin": origin, **places, "size": size, "code": code, "words": words}


def unblob(t: pa.Table):
    """ids, crcs and pos of all rows of the blobs, by row."""
    ids, crcs, pos = [], [], []
    for r in t.select(["ids", "crcs", "n", "pos"]).to_pylist():
        n = unpack(r["n"], np.uint32).astype(np.int64)
        ids.append(np.repeat(unpack(r["ids"], np.int64), n))
        crcs.append(np.repeat(unpack(r["crcs"], np.uint32), n).astype(np.int64))
        step = unpack(r["pos"], np.int32).astype(np.int64)
        total, first = np.cumsum(step), np.cumsum(n) - n
        pos.append(total - np.repeat(total[first] - step[first], n))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, crcs, pos))


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of n values each, one after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def runs(to: np.ndarray, at: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, crcs: np.ndarray, word: np.ndarray, vocabulary: pa.Array, span: int):
    """Blobs (kind 0) of the runs of successive suffixes of one document and one group, with their words."""
    if not len(at):
        return
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (to[1:] != to[:-1])]))
    size = np.diff(first, append=len(at))
    order = np.argsort(to[first], kind="stable")
    first, size = first[order], size[order]
    cuts = np.flatnonzero(np.concatenate([[True], to[first[1:]] != to[first[:-1]], [True]]))
    for a, z in zip(cuts[:-1], cuts[1:]):
        own, n = first[a:z], size[a:z]
        code, names = pd.factorize(word[spread(at[own], n + span - 1)])
        words = zlib.compress(b" ".join(vocabulary.take(pa.array(names)).to_pylist()), 1)
        yield blob(0, int(to[own[0]]), doc[own], pos[own], ids, crcs, pack(n.astype(np.uint32)), pack(code.astype(np.uint32)), words)


def by_bucket(kind: int, ids: np.ndarray, crcs: np.ndarray, pos: np.ndarray, buckets: int, origin: int = -1):
    """Blobs of places, by row bucket."""
    if not len(ids):
        return
    bucket = row_bucket(ids, crcs, buckets)
    order = np.lexsort((pos, crcs, ids, bucket))
    ids, crcs, pos, bucket = ids[order], crcs[order], pos[order], bucket[order]
    doc = np.cumsum(np.concatenate([[False], (ids[1:] != ids[:-1]) | (crcs[1:] != crcs[:-1])]))
    heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield blob(kind, int(bucket[a]), doc[a:b], pos[a:b], ids[heads], crcs[heads], origin=origin)


def located(rid: np.ndarray, rcrc: np.ndarray, pos: np.ndarray, ids: np.ndarray, crcs: np.ndarray):
    """Places with the index of the row that they are of; again for rows that repeat (id, crc), which have equal texts."""
    name = lambda i, c: mix(mix(i.view(U64)) + c.astype(U64))
    names = name(ids, crcs)
    order = np.argsort(names, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], (rid[1:] != rid[:-1]) | (rcrc[1:] != rcrc[:-1])]))
    want, size = name(rid[head], rcrc[head]), np.diff(head, append=len(rid))
    low, high = np.searchsorted(names[order], want, "left"), np.searchsorted(names[order], want, "right")
    for k in range(int((high - low).max(initial=0))):
        on = np.repeat(low + k < high, size)
        yield pos[on], order[np.repeat(low + k, size)[on]]


COLUMNS = ["kind", "place", "origin", "ids", "crcs", "n", "pos", "size", "code", "words"]


def table(rows) -> pa.Table:
    kinds = {"kind": pa.int32(), "place": pa.int32(), "origin": pa.int32()}
    return pa.Table.from_pylist(list(rows), schema=pa.schema([(n, kinds.get(n, pa.binary())) for n in COLUMNS]))


def settled(whole: np.ndarray, at: np.ndarray, ids: np.ndarray, word: np.ndarray, span: int) -> np.ndarray:
    """Of suffixes in a block, with hashes of their words and ids, whether one of a smaller id has the same words."""
    lost = np.zeros(len(at), bool)
    if len(at) < 2:
        return lost
    narrow = len(at) < 1 << 24
    tag = np.sort((whole << U64(24)) | np.arange(len(at), dtype=U64)) if narrow else None
    order = (tag & U64((1 << 24) - 1)).astype(np.int64) if narrow else np.argsort(whole, kind="stable")
    head, ranked = np.flatnonzero(np.concatenate([[True], whole[order[1:]] != whole[order[:-1]]])), ids[order]
    least = of_runs(ranked, head)
    first = of_runs(np.where(ranked == least, np.arange(len(order)), len(order)), head)
    later = np.flatnonzero(ranked > least)
    a, b = at[order[later]], at[order[first[later]]]
    alike = np.ones(len(later), bool)
    for j in range(span):
        alike &= word[a + j] == word[b + j]
    lost[order[later[alike]]] = True
    return lost


def repeated(docs: DataFrame, texts: DataFrame, span: int, group: int, bits: int, buckets: int) -> DataFrame:
    """Blobs (kind 1, place: a row bucket) of the places of all windows that also start in a document with a smaller id.

    docs: keyed(); texts: with their row buckets."""
    route = docs.sparkSession.sparkContext.broadcast(routes(docs, span, group, bits))

    def scatter(batches):
        for b in batches:
            for part in slices(b, "text"):
                ids, crcs = ints(part.column(0)), ints(part.column(1))
                buf, off = text_buffer(part.column(2))
                starts, ends, _ = word_bounds(buf, off)
                h, own, at = suffixes(buf, off, span)
                if not len(at):
                    continue
                word, _ = numbered(buf, starts, ends)
                whole = chained(h, span)[at]
                doc = np.searchsorted(own, at, "right") - 1
                pos = at - own[doc]
                lost = settled(whole, at, ids[doc], word, span)
                yield from table(by_bucket(1, ids[doc[lost]], crcs[doc[lost]], pos[lost], buckets)).to_batches()
                to = routed(h, at, span, bits, whole, route.value)
                key = (whole & U64((1 << FINGERPRINT) - 1)).astype(np.uint32)
                rest = np.flatnonzero(~lost)
                rest = rest[np.argsort(to[rest].astype(np.uint16) if to.max() < 1 << 16 else to[rest], kind="stable")]
                cuts = np.flatnonzero(np.concatenate([[True], to[rest[1:]] != to[rest[:-1]], [True]]))
                own_rows = (rest[a:z] for a, z in zip(cuts[:-1], cuts[1:]))
                yield from table(blob(0, int(to[r[0]]), doc[r], pos[r], ids, crcs, code=pack(key[r])) for r in own_rows).to_batches()

    def candidates(t: pa.Table) -> pa.Table:
        if t.num_rows and t["kind"][0].as_py() == 1:
            return t
        ids, crcs, pos = unblob(t)
        key = np.concatenate([unpack(c, np.uint32) for c in t["code"].to_pylist()])
        order = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]]))
        ranked = ids[order]
        go = order[of_runs(ranked, head) < of_runs(ranked, head, np.maximum)]
        return table(by_bucket(2, ids[go], crcs[go], pos[go], buckets, int(t["place"][0].as_py())))

    found = written(docs.mapInArrow(scatter, BLOB).groupBy("kind", "place").applyInArrow(candidates, BLOB), "candidates")

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return table([])
        ids, crcs = ints(left["id"]), ints(left["crc"])
        buf, off = text_buffer(left["text"])
        starts, ends, own = word_bounds(buf, off)
        rid, rcrc, pos = unblob(right)
        counts = [int(unpack(n, np.uint32).sum()) for n in right["n"].to_pylist()]
        origin = np.repeat(ints(right["origin"]).astype(np.int64), counts)
        # rows that repeat (id, crc) have equal texts: the first one serves all
        which, row = next(located(rid, rcrc, np.arange(len(rid)), ids, crcs))
        order = np.lexsort((pos[which], row))
        row, pos, origin = row[order], pos[which[order]], origin[which[order]]
        at = own[row] + pos
        edge = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + span, -1)
        used = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        word = np.zeros(len(starts), np.int64)
        word[used], vocabulary = numbered(buf, starts[used], ends[used])
        return table(runs(origin, at, row, pos, ids, crcs, word, vocabulary, span))

    def subtree(t: pa.Table) -> pa.Table:
        ids, crcs, pos = unblob(t)
        names = [zlib.decompress(w).split(b" ") for w in t["words"].to_pylist()]
        number = pa.array([x for w in names for x in w], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        base = np.cumsum([0, *map(len, names)])
        word = np.concatenate([number[k + unpack(c, np.uint32).astype(np.int64)] for k, c in zip(base, t["code"].to_pylist())])
        size = np.concatenate([unpack(n, np.uint32) for n in t["size"].to_pylist()]).astype(np.int64)
        begin = np.cumsum(size + span - 1) - (size + span - 1)
        ids, crcs, pos, at = np.repeat(ids, size), np.repeat(crcs, size), spread(pos, size), spread(begin, size)
        live, head = deep_nodes(word, at, ids, span)
        ranked = ids[live]
        lost = live[ranked > of_runs(ranked, head)]
        return table(by_bucket(1, ids[lost], crcs[lost], pos[lost], buckets))

    asked = texts.groupBy("place").cogroup(found.where("kind = 2").groupBy("place")).applyInArrow(fetch, BLOB)
    return found.where("kind = 1").unionByName(asked.groupBy("place").applyInArrow(subtree, BLOB))


def deduplicated(docs: DataFrame, span: int = 13, group: int = 1_500_000, bits: int = 14) -> DataFrame:
    """For each row of docs: id, crc, n_words, n_removed and kept_text (kept words joined by one space).

    A word is removed if it is inside a window of span words that also starts in a document with a smaller doc_id; rows
    without doc_id come last and rows of one doc_id never remove one another. Null text: no words. Texts of fewer words
    than span keep all."""
    rows = keyed(docs)
    size = plan_bytes(docs)
    buckets = max(8, size // BUCKET_BYTES)
    texts = rows.withColumn("place", F.expr(f"cast(pmod(xxhash64(id, crc), {buckets}L) as int)"))
    found = repeated(rows, texts, span, group, bits, buckets)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, crcs = ints(left["id"]), ints(left["crc"])
        buf, off = text_buffer(left["text"])
        starts, ends, own = word_bounds(buf, off)
        gone = np.zeros(len(starts) + 1, np.int64)
        if right.num_rows:
            for at, which in located(*unblob(right), ids, crcs):
                at = own[which] + at
                np.add.at(gone, at, 1)
                np.add.at(gone, at + span, -1)
        gone = np.cumsum(gone)[:-1] > 0
        n, whole = np.diff(own), np.concatenate([[0], np.cumsum(gone)])
        removed = whole[own[1:]] - whole[own[:-1]]
        flat, kept = buf.tobytes(), []
        for i in range(len(ids)):
            w = flat[off[i] : off[i + 1]].split()
            if removed[i]:
                w = [x for x, g in zip(w, gone[own[i] : own[i + 1]].tolist()) if not g]
            kept.append(b" ".join(w))
        return pa.table({"id": left["id"], "crc": left["crc"], "n_words": n, "n_removed": removed, "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    return texts.groupBy("place").cogroup(found.groupBy("place")).applyInArrow(cut, "id long, crc long, n_words long, n_removed long, kept_text string")


def query(docs: DataFrame) -> DataFrame:
    """op3: one row for each document."""
    return deduplicated(docs).select(real_id(), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB's statement of op3, from the definition.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS pos, w FROM d WHERE len(w) >= 13),
k AS (SELECT doc_id, pos, array_to_string(list_slice(w, pos, pos + 12), ' ') AS win FROM p),
m AS (SELECT win, min(doc_id) AS low FROM k GROUP BY win HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS x FROM k JOIN m USING (win) WHERE doc_id > low),
r AS (SELECT doc_id, count(*) AS n, list(x) AS xs FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed,
sha256(coalesce(array_to_string(CASE WHEN r.n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(r.xs, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
