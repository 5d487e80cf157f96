"""Suffix arrays by induced sorting, and permuted longest common prefixes, with NumPy.

A suffix is S-type if it is smaller than the next one and L-type otherwise; the leftmost S-type suffixes of each run (LMS)
are sorted first, and all others are induced from them bucket by bucket: left to right for L, right to left for S. Within a bucket,
what one scan induces is handled as a whole, so the work is linear with a small number of array operations for each bucket.
LMS suffixes are ordered by naming their substrings, which a first induction has sorted, and ordering the string of names
recursively; once names are too many for bucket scans to pay, the string of names is ordered by doubling its ranks.
"""

from __future__ import annotations

import numpy as np

#: Above so many different symbols a string is ordered by rank doubling.
SYMBOLS = 4096


def _types(t: np.ndarray) -> np.ndarray:
    """Which suffixes are S-type. The last symbol is the smallest and unique."""
    change = np.flatnonzero(t[:-1] != t[1:])
    smaller = t[change] < t[change + 1]
    return np.r_[np.repeat(smaller, np.diff(np.r_[-1, change])), True]


def _spread(sa: np.ndarray, t: np.ndarray, found: np.ndarray, edge: np.ndarray, forward: bool) -> None:
    """Put the suffixes ``found``, in this order, at the edges of their buckets and move the edges."""
    symbol = t[found]
    order = np.argsort(symbol, kind="stable")
    symbol = symbol[order]
    starts = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
    sizes = np.diff(np.r_[starts, len(symbol)])
    within = np.arange(len(symbol)) - np.repeat(starts, sizes)
    first = edge[symbol]
    sa[first + within if forward else first - 1 - within] = found[order]
    edge[symbol[starts]] += sizes if forward else -sizes


def _induce(t: np.ndarray, s: np.ndarray, begins: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that follows from LMS suffixes in the order given."""
    sa = np.full(len(t), -1, np.int64)
    tails = ends.copy()
    _spread(sa, t, lms[::-1], tails, forward=False)
    lms_from = tails
    heads = begins.copy()
    for c in range(len(begins)):
        if begins[c] == ends[c]:
            continue
        at = begins[c]
        while at < heads[c]:
            scan, at = sa[at : heads[c]], heads[c]
            before = scan[scan > 0] - 1
            before = before[~s[before]]
            if len(before):
                _spread(sa, t, before, heads, forward=True)
        scan = sa[lms_from[c] : ends[c]]
        before = scan[scan > 0] - 1
        before = before[~s[before]]
        if len(before):
            _spread(sa, t, before, heads, forward=True)
    tails = ends.copy()
    for c in range(len(begins) - 1, -1, -1):
        if begins[c] == ends[c]:
            continue
        at = ends[c]
        while at > tails[c]:
            scan, at = sa[tails[c] : at][::-1], tails[c]
            before = scan[scan > 0] - 1
            before = before[s[before]]
            if len(before):
                _spread(sa, t, before, tails, forward=False)
        scan = sa[begins[c] : heads[c]][::-1]
        before = scan[scan > 0] - 1
        before = before[s[before]]
        if len(before):
            _spread(sa, t, before, tails, forward=False)
    sa[0] = len(t) - 1
    return sa


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """The suffix array of a string with many symbols: sort by pairs of ranks, twice as far each time, where ranks are shared."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    ordered = names[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    sa = order
    step = 1
    while True:
        alone = first & np.r_[first[1:], True]
        open_at = np.flatnonzero(~alone)  # places in sa whose rank is shared; places of a group are contiguous
        if not len(open_at):
            return sa
        who = sa[open_at]
        then = np.where(who + step < n, rank[np.minimum(who + step, n - 1)], -1)
        keys = rank[who] * (n + 1) + then + 1
        by = np.argsort(keys, kind="stable")
        sa[open_at] = who[by]
        keys = keys[by]
        new = np.r_[True, keys[1:] != keys[:-1]]
        first[open_at] = new
        rank[sa[open_at]] = np.maximum.accumulate(np.where(new, open_at, 0))
        step *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of ``t`` in order. Symbols are 0, 1, ...; the last is 0 and stands nowhere else."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    sizes = np.bincount(t)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    s = _types(t)
    is_lms = s & np.r_[False, ~s[:-1]]
    lms = np.flatnonzero(is_lms)
    sa = _induce(t, s, begins, ends, lms)
    ordered = sa[is_lms[sa]]
    # substrings up to the next LMS suffix; equal neighbours in the order get the same name
    length = np.empty(n, np.int64)
    length[lms] = np.diff(np.r_[lms, n - 1]) + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    pairs = np.flatnonzero(same)
    for k in range(0, len(pairs), 1 << 16):
        part = pairs[k : k + (1 << 16)]
        size = length[a[part]]
        starts = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(starts, size)
        differ = t[np.repeat(a[part], size) + step] != t[np.repeat(b[part], size) + step]
        same[part] = ~np.logical_or.reduceat(differ, starts)
    names = np.empty(n, np.int64)
    names[ordered] = np.cumsum(np.r_[0, ~same])
    reduced = names[lms]
    symbols = int(names[ordered[-1]]) + 1
    if symbols < len(lms):
        ordered = lms[suffix_array(reduced) if symbols <= SYMBOLS else _by_doubling(reduced)]
    return _induce(t, s, begins, ends, ordered)


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp): for each start, the start of the suffix before it in the order, and their common prefix's length.

    Bytes ``text`` with an end that stands nowhere else. Where the bytes before the two suffixes are equal, the value is that of
    the start before, less one; so only the other starts are compared, eight bytes at a time.
    """
    n = len(text)
    phi = np.empty(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    padded = np.r_[text, np.zeros(16, np.uint8)]
    words = np.ndarray((n + 8,), np.dtype("<u8"), padded.tobytes(), strides=(1,))
    fresh = np.ones(n, bool)
    follow = np.flatnonzero(phi[1:] > 0) + 1
    fresh[follow] = text[follow - 1] != text[phi[follow] - 1]
    at = np.flatnonzero(fresh & (phi >= 0))
    plcp = np.zeros(n, np.int64)
    other, done = phi[at], np.zeros(len(at), np.int64)
    active = np.arange(len(at))
    while len(active):
        x = words[at[active] + done[active]] ^ words[other[active] + done[active]]
        equal = x == 0
        part = active[~equal]
        x = x[~equal]
        done[part] += np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8
        active = active[equal]
        done[active] += 8
    plcp[at] = done
    last = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    plcp = plcp[last] - (np.arange(n) - last)
    plcp[sa[0]] = 0
    return phi, np.maximum(plcp, 0)
