"""Suffix-array dedup of byte strings: sharded induced sorting with permuted common prefixes.

A string of `span` bytes that occurs twice holds, at the same place of each occurrence, the least hash of its GRAM-byte
substrings. These anchors, one in about 170 bytes, are grouped by hash. An anchor's context reaches as far as the
windows of span bytes around it. Equal contexts, found by their hashes, are repeated as a whole and need no more. Of each
group with several contexts one of each kind is fetched; anchors are dealt to shards, whose contexts are joined and
sorted, about SORTED bytes of whole groups at a time, into suffix arrays: suffixes are classified, leftmost-smaller substrings sorted recursively, the rest induced.
Before, contexts shrink to the windows that another may share, and an anchor whose contexts are of more than SORTED bytes is
compared window by window, as its equal windows lie alike around it.
Permuted common prefixes of span bytes or more mark the runs of suffixes that repeat; a run counts if it stands for two
different places of the corpus. Before the shuffle each task joins the equal contexts of a block into one row, so that a
passage in a third of all documents reaches its group once for each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .induced import common_prefixes, suffix_array
from .kernel import U64, ints, keyed, mix, pack, plan_bytes, real_id, row_bucket, slices, text_buffer, unpack, written
from .substrings import located

GRAM = 64
#: Bytes of text treated at once, and of a longer text's pieces.
BLOCK = 2 << 20
BYTES = mix(np.arange(1, 257, dtype=U64))
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SCHEMA = "kind int, place int, ids binary, crcs binary, pos binary, size binary, left binary, h binary, c binary"
NAMES = ["kind", "place", "ids", "crcs", "pos", "size", "left", "h", "c"]
#: Bytes of files for each shard and for each row bucket.
SHARD_BYTES = 4 << 20
#: Bytes of contexts that one suffix array sorts.
SORTED = 1 << 19
#: Ranges of a window's distance to its anchor by which contexts are looked up for a match.
RANGES = 8
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        p = np.full(max(n, 1 << 16), base, U64)
        p[0] = 1
        _POWERS[base] = np.multiply.accumulate(p)
    return _POWERS[base][:n]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    return np.concatenate([[U64(0)], np.cumsum(BYTES[buf] * powers(BASE, len(buf)))])


def range_hash(p: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial hashes of buf[start:stop]."""
    return mix((p[stop] - p[start]) * powers(INVERSE, len(p))[start])


def anchors(buf: np.ndarray, off: np.ndarray, span: int):
    """Of one block of texts: text, place, hash, and bytes of context to the left and right of each anchor, and the contexts' hashes."""
    n, wide = len(buf), span - GRAM + 1
    empty = np.zeros(0, np.int64)
    if n < span:
        return empty, empty, empty.view(U64), empty, empty, empty.view(U64)
    p = prefix_sums(buf)
    h = mix((p[GRAM:] - p[:-GRAM]) * powers(INVERSE, n - GRAM + 1))
    low = (h & U64((1 << 64) - (1 << 24))) | np.arange(len(h), dtype=U64)
    have = 1
    while have < wide:
        step = min(have, wide - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    ends = np.repeat(off[1:], np.diff(off))
    whole = ends[: len(low)] - np.arange(len(low)) >= span
    mark = np.zeros(n, bool)
    mark[(low[whole] & U64((1 << 24) - 1)).astype(np.int64)] = True
    at = np.flatnonzero(mark)
    doc = np.searchsorted(off, at, "right") - 1
    left, right = np.minimum(span - GRAM, at - off[doc]), np.minimum(span, off[doc + 1] - at)
    c = mix(range_hash(p, at - left, at + right) + (left * 1024 + right).astype(U64))
    return doc, at - off[doc], h[at], left, right, c


def blocks(part: pa.RecordBatch, span: int):
    """Anchors of a slice; a long text is treated in pieces that overlap by two contexts and keep their own anchors."""
    buf, off = text_buffer(part.column(2))
    if len(part) > 1 or len(buf) <= 2 * BLOCK:
        yield anchors(buf, off, span)
        return
    for at in range(0, len(buf), BLOCK):
        first = max(0, at - 2 * span)
        piece = buf[first : at + BLOCK + 2 * span]
        doc, pos, *rest = anchors(piece, np.array([0, len(piece)]), span)
        own = (pos + first >= at) & (pos + first < at + BLOCK)
        yield doc[own], pos[own] + first, *(x[own] for x in rest)


def rows(kind: int, place: np.ndarray, ids, crcs, pos, size, left=None, h=None, c=None):
    """One blob for each place."""
    if not len(place):
        return
    order = np.lexsort((pos, ids, place))
    cuts = np.flatnonzero(np.concatenate([[True], place[order[1:]] != place[order[:-1]], [True]]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = order[a:b]
        opt = lambda x, kind: b"" if x is None else pack(x[own].astype(kind))
        yield {"kind": kind, "place": int(place[own[0]]), "ids": pack(ids[own]), "crcs": pack(crcs[own].astype(np.uint32)), "pos": pack(pos[own].astype(np.uint32)), "size": pack(size[own].astype(np.uint16)), "left": opt(left, np.uint16), "h": opt(h, U64), "c": opt(c, U64)}


def batches_of(made) -> list[pa.RecordBatch]:
    return table_of(made).to_batches()


def table_of(made) -> pa.Table:
    kinds = {"kind": pa.int32(), "place": pa.int32()}
    return pa.Table.from_pylist(list(made), schema=pa.schema([(n, kinds.get(n, pa.binary())) for n in NAMES]))


#: Column types of blobs and of the arrays that they hold.
TYPES = {"ids": (np.int64, np.int64), "crcs": (np.uint32, np.int64), "pos": (np.uint32, np.int64), "size": (np.uint16, np.int64), "left": (np.uint16, np.int64), "h": (U64, U64), "c": (U64, U64)}


def unrow(t: pa.Table, *names: str) -> list[np.ndarray]:
    out = []
    for n in names:
        kind, to = TYPES[n]
        parts = [unpack(b, kind) for b in t[n].to_pylist()]
        out.append((np.concatenate(parts) if parts else np.zeros(0, kind)).astype(to))
    return out


def gathered(text: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The strings of n bytes at begin, one after the other."""
    return text[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def parts(n: np.ndarray, most: int):
    """Ranges of strings of n bytes that hold about most bytes each."""
    part = (np.cumsum(n) - n) // most
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return zip(cuts, np.append(cuts[1:], len(n)))


def shared(*keys: np.ndarray) -> np.ndarray:
    """Whether another row has the same keys."""
    order = np.lexsort(keys)
    same = np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in keys])
    out = np.zeros(len(order), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def matchable(text: np.ndarray, begin: np.ndarray, n: np.ndarray, left: np.ndarray, h: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """By context the least and largest distance before its anchor at which a window that another one may share begins.

    Equal windows lie alike around their anchor. Those that begin first to last bytes before it all hold the bytes from
    first before it to span - last after it: contexts that share these with no other have no match in that range. Where
    no range has one, the largest is -1."""
    least, most = np.full(len(n), span), np.full(len(n), -1)
    edges = np.linspace(0, span - GRAM + 1, RANGES + 1).astype(np.int64)
    key = np.zeros((RANGES, len(n)), U64)
    reach = [(left >= first) & (n - left >= span - (stop - 1)) for first, stop in zip(edges[:-1], edges[1:])]
    for a, b in parts(n, SORTED):
        p = prefix_sums(text[begin[a] : begin[b - 1] + n[b - 1]])
        at = begin[a:b] - begin[a] + left[a:b]
        for r in range(RANGES):
            k = np.flatnonzero(reach[r][a:b])
            key[r, a + k] = range_hash(p, at[k] - edges[r], at[k] + span - (edges[r + 1] - 1))
    for r in range(RANGES):
        k = np.flatnonzero(reach[r])
        k = k[shared(key[r, k], h[k])]
        least[k] = np.minimum(least[k], edges[r])
        most[k] = edges[r + 1] - 1
    return least, most


def windows_alike(text: np.ndarray, begin: np.ndarray, n: np.ndarray, left: np.ndarray, span: int):
    """Of one anchor's contexts the ranges (context, begin, end) that windows equal to one of another context cover.

    Equal windows lie alike around the anchor, so each distance to it is compared by itself: eight bytes for each window
    instead of a suffix array of all contexts."""
    wide = span - GRAM + 1
    h = np.zeros((wide, len(n)), U64)
    reach = lambda d, a, b: a + np.flatnonzero((left[a:b] >= d) & (n[a:b] - left[a:b] >= span - d))
    for a, b in parts(n, SORTED):
        own = gathered(text, begin[a:b], n[a:b])
        p, at = prefix_sums(own), np.cumsum(n[a:b]) - n[a:b] + left[a:b]
        for d in range(wide):
            k = reach(d, a, b)
            h[d, k] = range_hash(p, at[k - a] - d, at[k - a] - d + span)
    hit = np.zeros((len(n), wide), bool)
    for d in range(wide):
        k = reach(d, 0, len(n))
        hit[k, wide - 1 - d] = shared(h[d, k])
    edge = np.diff(hit.astype(np.int8), axis=1, prepend=0, append=0)
    which, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    zero = left[which] - (wide - 1)
    return which, zero + first, zero + last + span


#: Of a context's size the bit that says: this context is known to occur more than once.
MANY = 1 << 15


def repeated(docs: DataFrame, texts: DataFrame, span: int, shards: int, buckets: int) -> DataFrame:
    """Blobs (place: a row bucket) of byte ranges that windows which occur twice cover. docs: keyed(); texts: with their buckets."""

    def scatter(batches):
        for b in batches:
            for part in slices(b, "text", BLOCK):
                ids, crcs = ints(part.column(0)), ints(part.column(1))
                for doc, pos, h, left, right, c in blocks(part, span):
                    if not len(doc):
                        continue
                    order = np.lexsort((c, h))
                    new = np.concatenate([[True], (h[order[1:]] != h[order[:-1]]) | (c[order[1:]] != c[order[:-1]])])
                    head = np.flatnonzero(new)
                    n = np.diff(head, append=len(order))
                    many = np.zeros(len(order), bool)
                    many[order] = np.repeat(n > 1, n)
                    i, k = ids[doc], crcs[doc]
                    size = left + right
                    yield from batches_of(rows(1, row_bucket(i[many], k[many], buckets), i[many], k[many], pos[many] - left[many], size[many]))
                    go = order[head]
                    place = (h[go] % U64(shards)).astype(np.int64)
                    yield from batches_of(rows(0, place, i[go], k[go], pos[go], size[go] | np.where(many[go], MANY, 0), left[go], h[go], c[go]))

    def group(t: pa.Table) -> pa.Table:
        if t["kind"][0].as_py() == 1:
            return t
        ids, crcs, pos, size, left, h, c = unrow(t, "ids", "crcs", "pos", "size", "left", "h", "c")
        known, size = size >= MANY, size & (MANY - 1)
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
        head = np.flatnonzero(new)
        n = np.diff(head, append=len(order))
        many = (n > 1) | np.logical_or.reduceat(known[order], head)
        out = order[np.repeat(many, n) & ~known[order]]
        made = list(rows(1, row_bucket(ids[out], crcs[out], buckets), ids[out], crcs[out], (pos - left)[out], size[out]))
        # anchors with several contexts: one of each
        hh = h[head]
        first = np.flatnonzero(np.concatenate([[True], hh[1:] != hh[:-1]]))
        kinds = np.diff(first, append=len(hh))
        ask = np.repeat(kinds > 1, kinds)
        rep, flag = order[head[ask]], many[ask]
        made += rows(2, row_bucket(ids[rep], crcs[rep], buckets), ids[rep], crcs[rep], (pos - left)[rep], size[rep] | np.where(flag, MANY, 0), left[rep], hh[ask])
        return table_of(made)

    found = written(docs.mapInArrow(scatter, SCHEMA).groupBy("kind", "place").applyInArrow(group, SCHEMA), "contexts")

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if right.num_rows and left.num_rows:
            ids, crcs = ints(left["id"]), ints(left["crc"])
            buf, off = text_buffer(left["text"])
            asks = unrow(right, "ids", "crcs", "pos", "size", "left", "h")
            order = np.lexsort((asks[1], asks[0]))
            rid, rcrc, start, size, before, h = (x[order] for x in asks)
            for which, row in located(rid, rcrc, np.arange(len(rid)), ids, crcs):
                begin, many, n = off[row] + start[which], size[which] >= MANY, size[which] & (MANY - 1)
                shard = (h[which] % U64(shards)).astype(np.int64)
                by = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.concatenate([[True], shard[by[1:]] != shard[by[:-1]], [True]]))
                for a, b in zip(cuts[:-1], cuts[1:]):
                    own = by[a:b]
                    many_own = np.repeat(begin[own] - (np.cumsum(n[own]) - n[own]), n[own]) + np.arange(n[own].sum())
                    out.append({"kind": 0, "place": int(shard[own[0]]), "ids": pack(rid[which[own]]), "crcs": pack(rcrc[which[own]].astype(np.uint32)), "pos": pack(start[which[own]].astype(np.uint32)), "size": pack((n[own] | np.where(many[own], MANY, 0)).astype(np.uint16)), "left": pack(before[which[own]].astype(np.uint16)), "h": buf[many_own].tobytes(), "c": pack(h[which[own]])})
                break  # rows that repeat (id, crc) have equal contexts, which are known to repeat
        return table_of(out)

    def shard(t: pa.Table) -> pa.Table:
        ids, crcs, start, size, left, h = unrow(t, "ids", "crcs", "pos", "size", "left", "c")
        text = np.frombuffer(b"".join(t["h"].to_pylist()), np.uint8)
        n = size & (MANY - 1)
        begin = np.cumsum(n) - n
        least, most = matchable(text, begin, n, left, h, span)
        order = np.flatnonzero(most >= 0)
        # a context shrinks to the windows that may have a match
        most = np.minimum(most, left)
        n = np.minimum(most + span - least, n - left + most)
        begin, start, left, size = begin + left - most, start + left - most, most, n | size & MANY
        order = order[np.argsort(h[order], kind="stable")]
        if not len(order):
            return table_of([])
        # one suffix array for each run of whole groups of about SORTED bytes; a larger group alone, window by window
        head = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]]]))
        bulk = np.add.reduceat(n[order], head)
        large = bulk > SORTED
        part = np.cumsum(np.where(large, 0, bulk)) // SORTED
        alone = large | np.concatenate([[False], large[:-1]])
        cuts = np.flatnonzero(np.concatenate([[True], alone[1:] | (part[1:] != part[:-1])]))
        made = []
        for a, b in zip(cuts, np.append(cuts[1:], len(head))):
            own = order[head[a] : head[b] if b < len(head) else None]
            if large[a]:
                k, at, stop = windows_alike(text, begin[own], n[own], left[own], span)
                k = own[k]
                made += rows(1, row_bucket(ids[k], crcs[k], buckets), ids[k], crcs[k], start[k] + at, stop - at)
            else:
                made += sorted_shard(ids[own], crcs[own], start[own], size[own], gathered(text, begin[own], n[own]))
        return table_of(made)

    def sorted_shard(ids, crcs, start, size, text) -> list[dict]:
        many, size = size >= MANY, size & (MANY - 1)
        # contexts one after the other, a separator after each
        first = np.cumsum(size + 1) - size - 1
        place = np.arange(len(text)) + np.repeat(np.arange(len(size)), size)
        s = np.full(len(text) + len(size) + 1, 1, np.uint16)
        s[place] = text.astype(np.uint16) + 2
        s[-1] = 0
        sa = suffix_array(s)
        # bytes for comparison; a window of span bytes never holds a separator
        flat = np.zeros(len(s), np.uint8)
        flat[place] = text
        plcp = common_prefixes(flat, sa, first, first + np.maximum(0, size - span + 1), span)
        deep = plcp[sa] >= span
        whole = np.zeros(len(s), bool)
        which = np.repeat(np.arange(len(size)), np.maximum(0, size - span + 1))
        offset = np.arange(len(which)) - np.repeat(np.cumsum(np.maximum(0, size - span + 1)) - np.maximum(0, size - span + 1), np.maximum(0, size - span + 1))
        whole[first[which] + offset] = True
        context = np.zeros(len(s), np.int64)
        context[first[which] + offset] = which
        # a suffix without span bytes of its own breaks a run, as its bytes beyond the context are not compared
        deep &= whole[sa] & np.concatenate([[False], whole[sa[:-1]]])
        head = np.flatnonzero(~deep)
        n = np.diff(head, append=len(sa))
        own = context[sa]
        name = mix(mix(ids.view(U64)) + crcs.astype(U64))[own] + (start[own] + sa - first[own]).astype(U64)
        twice = (np.minimum.reduceat(name, head) != np.maximum.reduceat(name, head)) | np.logical_or.reduceat(many[own] & whole[sa], head)
        hit = sa[np.repeat(twice & (n > 1), n)]
        hit = np.sort(hit)
        # successive windows of a context as one range
        new = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (context[hit[1:]] != context[hit[:-1]])])) if len(hit) else np.zeros(0, np.int64)
        begin, last = hit[new], hit[np.append(new[1:], len(hit)) - 1] if len(hit) else hit
        k = context[begin]
        return list(rows(1, row_bucket(ids[k], crcs[k], buckets), ids[k], crcs[k], start[k] + begin - first[k], last - begin + span))

    asked = texts.groupBy("place").cogroup(found.where("kind = 2").groupBy("place")).applyInArrow(fetch, SCHEMA)
    return found.where("kind = 1").unionByName(asked.groupBy("place").applyInArrow(shard, SCHEMA))


def deduplicated(docs: DataFrame, span: int = 400) -> DataFrame:
    """For each row of docs: id, crc, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary).

    A byte is removed if a string of span bytes that covers it also starts anywhere else, in any text or the same one;
    all occurrences go. Null text: empty. Rows that repeat remove one another if they have span bytes."""
    if not GRAM <= span < MANY // 2:
        raise ValueError(f"span must be between {GRAM} and {MANY // 2 - 1}")
    source, size = keyed(docs), plan_bytes(docs)
    shards = buckets = max(8, size // SHARD_BYTES)
    texts = source.withColumn("place", F.expr(f"cast(pmod(xxhash64(id, crc), {buckets}L) as int)"))
    found = repeated(source, texts, span, shards, buckets)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, crcs = ints(left["id"]), ints(left["crc"])
        buf, off = text_buffer(left["text"])
        gone = np.zeros(len(buf) + 1, np.int32)
        if right.num_rows:
            rid, rcrc, start, n = unrow(right, "ids", "crcs", "pos", "size")
            order = np.lexsort((rcrc, rid))
            for which, row in located(rid[order], rcrc[order], order, ids, crcs):
                np.add.at(gone, off[row] + start[which], 1)
                np.add.at(gone, off[row] + start[which] + n[which], -1)
        gone = np.cumsum(gone, dtype=np.int32)[:-1] > 0
        run = gone.copy()
        run[1:] &= ~gone[:-1]
        edge = off[(off < len(buf))]
        run[edge] = gone[edge]
        total = lambda x: np.concatenate([np.zeros(1, np.int32), np.cumsum(x, dtype=np.int32)])[off].astype(np.int64)  # noqa: E731  a bucket is far below 2 GiB
        removed = np.diff(total(gone))
        kept_off = np.concatenate([[0], np.cumsum(np.diff(off) - removed)])
        kept = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(kept_off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf[~gone]))])
        return pa.table({"id": left["id"], "crc": left["crc"], "n_bytes": np.diff(off), "n_removed": removed, "n_spans": np.diff(total(run)), "kept": kept.cast(pa.binary())})

    return texts.groupBy("place").cogroup(found.groupBy("place")).applyInArrow(cut, "id long, crc long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(docs: DataFrame) -> DataFrame:
    """op5: one row for each document."""
    return deduplicated(docs).select(real_id(), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
