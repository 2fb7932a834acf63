"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

A bucket's suffixes are induced wave by wave: all suffixes that stand in a bucket at a time induce their predecessors
with one stable distribution, so that a pass costs a few instructions for each symbol of the alphabet and each run.
"""

from __future__ import annotations

import numpy as np

from .kernel import U64, span_hash

#: Symbols up to which a reduced string is sorted by another level of induced sorting; beyond it by doubling its ranks.
SYMBOLS = 1024


def classify(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than the next one (the last, a unique least symbol, is), and the places of leftmost such."""
    n = len(s)
    up = np.append(s[1:] > s[:-1], True)
    same = np.append(s[1:] == s[:-1], False)
    nearest = np.minimum.accumulate(np.where(same, n, np.arange(n))[::-1])[::-1]
    small = up[nearest]
    return small, np.flatnonzero(small[1:] & ~small[:-1]) + 1


def induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """The order of all suffixes that follows from seeds, the leftmost-smaller ones in order."""
    size = np.bincount(s, minlength=k)
    tail = np.cumsum(size)
    head = tail - size
    sa = np.full(len(s), -1, np.int64)
    own = s[seeds]
    count = np.bincount(own, minlength=k)
    by = np.argsort(own, kind="stable")
    sa[np.repeat(tail - count - (np.cumsum(count) - count), count) + np.arange(len(seeds))] = seeds[by]
    larger = ~small

    def place(j: np.ndarray, fill: np.ndarray, sign: int):
        c = s[j]
        by = np.argsort(c, kind="stable")
        c, j = c[by], j[by]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        many = np.diff(first, append=len(c))
        rank = np.arange(len(c)) - np.repeat(first, many)
        sa[fill[c] + rank if sign > 0 else fill[c] - 1 - rank] = j
        fill[c[first]] += sign * many

    used = np.flatnonzero(size)
    fill = head.copy()
    for c in used:
        at = head[c]
        while at < fill[c]:
            j, at = sa[at : fill[c]] - 1, fill[c]
            j = j[j >= 0]
            j = j[larger[j]]
            if len(j):
                place(j, fill, 1)
        if count[c]:
            j = sa[tail[c] - count[c] : tail[c]] - 1
            j = j[j >= 0]
            j = j[larger[j]]
            if len(j):
                place(j, fill, 1)
    top, fill = fill, tail.copy()  # top: where the larger ones of each bucket end
    sa[0] = len(s) - 1
    fill[s[-1]] -= 1
    for c in used[::-1]:
        at = tail[c]
        if c == s[-1]:
            continue
        while at > fill[c]:
            j, at = sa[fill[c] : at][::-1] - 1, fill[c]
            j = j[j >= 0]
            j = j[small[j]]
            if len(j):
                place(j, fill, -1)
        if top[c] > head[c]:
            j = sa[head[c] : top[c]][::-1] - 1
            j = j[j >= 0]
            j = j[small[j]]
            if len(j):
                place(j, fill, -1)
    return sa


def doubled(s: np.ndarray) -> np.ndarray:
    """The suffix array of s by doubling of ranks, of which only those not yet unique are sorted again."""
    n, k = len(s), 1
    size = np.bincount(s)
    rank = (np.cumsum(size) - size)[s]
    todo = np.flatnonzero(size[s] > 1)
    while len(todo):
        after = todo + k
        key = rank[todo] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        key, todo = key[order], todo[order]
        old = rank[todo]
        here = np.arange(len(todo))
        start = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), here, 0))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(new, here, 0))
        rank[todo] = old + first - start
        heads = np.flatnonzero(new)
        todo = todo[np.repeat(np.diff(heads, append=len(todo)) > 1, np.diff(heads, append=len(todo)))]
        k *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of the suffixes of s: nonnegative integers of which the last is the only least one."""
    k = int(s.max()) + 1
    s = s.astype(np.uint16 if k <= 1 << 16 else np.int64)
    small, lms = classify(s)
    if len(s) < 3 or not len(lms):
        return doubled(s.astype(np.int64))
    sa = induce(s, small, lms, k)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    # names: leftmost-smaller substrings that are equal are neighbours in order
    ends = np.append(lms[1:] + 1, len(s))
    wide = s.view(np.uint8)
    h = np.zeros(len(s), U64)
    h[lms] = span_hash(wide, lms * s.itemsize, ends * s.itemsize)
    name = np.zeros(len(s), np.int64)
    name[order] = np.concatenate([[0], np.cumsum(h[order[1:]] != h[order[:-1]])])
    reduced = name[lms]
    most = int(reduced.max()) + 1
    if most < len(lms):
        seeds = lms[suffix_array(reduced) if most <= SYMBOLS else doubled(reduced)]
    else:
        seeds = order
    return induce(s, small, seeds, k)


def common_prefixes(buf: np.ndarray, sa: np.ndarray, starts: np.ndarray, stops: np.ndarray, most: int) -> np.ndarray:
    """By text place: the length, up to most, of the prefix common with the suffix before it in order, for places in starts:stops.

    A lane for each range goes through its places in turn; a place has at least the next to last length less one."""
    before = np.full(len(buf), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([buf, np.zeros(most + 16, np.uint8)])
    eight = np.ndarray((len(buf) + most + 8,), "<u8", padded, strides=(1,))
    plcp = np.zeros(len(buf), np.int32)
    live = np.flatnonzero(starts < stops)
    at, stop, h = starts[live].copy(), stops[live], np.zeros(len(live), np.int64)
    while len(at):
        other = before[at]
        x = eight[at + h] ^ eight[np.maximum(other, 0) + h]
        low = x & (~x + U64(1))
        same = np.where(x == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) >> 3)
        same[other < 0] = 0
        h += same
        over = (same < 8) | (h >= most)
        done = at[over]
        plcp[done] = np.minimum(h[over], most)
        h[over] = np.maximum(np.minimum(h[over], most) - 1, 0)
        at[over] += 1
        keep = at < stop
        if not keep.all():
            at, stop, h = at[keep], stop[keep], h[keep]
    return plcp
