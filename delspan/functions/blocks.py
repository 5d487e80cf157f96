"""Columns of reads as flat NumPy arrays: operations of CIGAR strings, aligned bases, counts by position bin, sliding medians.

What follows works on whole Arrow batches, however long a read, a region or its list of operations is; nothing is done read by read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LETTERS = np.frombuffer(b"MIDNSHP=X", np.uint8)
QUERY, REFERENCE, ALIGNED = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"MIS=X", b"MDN=X", b"M=X"))
IS_LETTER = np.isin(np.arange(256), LETTERS)
#: 1 to 4 for A, C, G, T in either case.
BASE = np.zeros(256, np.uint8)
BASE[np.frombuffer(b"ACGTacgt", np.uint8)] = [1, 2, 3, 4] * 2


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all strings one after another, where each begins and the last ends); nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, ends


def operations(cigars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, letter, length) of each operation, in order. A letter with no number before it is none."""
    raw, ends = letters(cigars)
    at = np.flatnonzero(IS_LETTER[raw[ends[0] : ends[-1]]]) + ends[0]
    of = np.searchsorted(ends, at, side="right") - 1
    before = np.r_[-1, at[:-1]] if len(at) else at
    first = np.maximum(ends[of], before + 1)  # where the number may begin
    length, digits = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    going, power, k = np.ones(len(at), bool), 1, 1
    while going.any() and k < 19:
        p = at - k
        d = raw[np.maximum(p, 0)].astype(np.int64) - 48
        going &= (p >= first) & (d >= 0) & (d <= 9)
        length += np.where(going, d * power, 0)
        digits += going
        power *= 10
        k += 1
    real = digits > 0
    return of[real], raw[at[real]], length[real]


def offsets(of: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """What the operations before each one of the same string take."""
    total = np.cumsum(taken) - taken
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])[: len(of)]
    return total - np.repeat(total[first], np.diff(np.r_[first, len(of)]))


def placed(cigars: pa.Array, starts: pa.Array) -> pa.StructArray:
    """``ref_end`` and ``ops`` (op, len, q, r): each operation with the read and reference positions where it begins."""
    of, op, length = operations(cigars)
    q = offsets(of, np.where(QUERY[op], length, 0))
    taken = np.where(REFERENCE[op], length, 0)
    start = np.asarray(starts.fill_null(0), np.int64)
    r = start[of] + offsets(of, taken)
    spans = np.bincount(of, taken, len(cigars)).astype(np.int64)
    none = (spans == 0) | np.asarray(starts.is_null()) | np.asarray(cigars.is_null())
    names = pa.DictionaryArray.from_arrays(pa.array(np.searchsorted(np.sort(LETTERS), op).astype(np.int8)), pa.array([chr(x) for x in np.sort(LETTERS)]))
    each = pa.StructArray.from_arrays([names.cast(pa.string()), *(pa.array(x) for x in (length, q, r))], ["op", "len", "q", "r"])
    ops = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(cigars) + 1)), pa.int32()), each, mask=cigars.is_null())
    return pa.StructArray.from_arrays([pa.array(start + spans, mask=none), ops], ["ref_end", "ops"])


def spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place within it) for each of so many places."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def counted_bases(starts: pa.Array, cigars: pa.Array, seqs: pa.Array, quals: pa.Array, min_quality: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(read, position, base from 1 to 4) of each aligned A, C, G or T of that quality or more, by read and position."""
    of, op, length = operations(cigars)
    start = np.asarray(starts.fill_null(0), np.int64)
    q, r = offsets(of, np.where(QUERY[op], length, 0)), start[of] + offsets(of, np.where(REFERENCE[op], length, 0))
    seq, seq_ends = letters(seqs)
    qual, qual_ends = letters(quals)
    readable = np.minimum(np.diff(seq_ends), np.diff(qual_ends))
    known = ~np.asarray(starts.is_null())
    some = np.flatnonzero(ALIGNED[op] & known[of])
    size = np.clip(np.minimum(length[some], readable[of[some]] - q[some]), 0, None)
    which, k = spread(size)
    which = some[which]
    row, place = of[which], q[which] + k
    base = BASE[seq[seq_ends[row] + place]] if len(row) else np.zeros(0, np.uint8)
    good = np.flatnonzero((base > 0) & (qual[qual_ends[row] + place] >= min_quality + 33)) if len(row) else np.zeros(0, np.int64)
    return row[good], (r[which] + k)[good], base[good]


def sliding_medians(values: np.ndarray, sizes: np.ndarray, frame: int, rows: int = 512) -> np.ndarray:
    """The medians of all whole frames (an odd number of values) of each of many stretches, one after another.

    A histogram of each stretch is moved one value at a time, and its middle with it. Stretches are cut into overlapping parts of ``rows`` frames, so that many
    are moved side by side.
    """
    frames = np.maximum(sizes - frame + 1, 0)
    if not frames.sum():
        return np.empty(0, np.float64)
    known, rank = np.unique(values, return_inverse=True)
    begins = np.cumsum(sizes) - sizes
    part_of, k = spread(-(-frames // rows))
    first = begins[part_of] + k * rows
    count = np.minimum(rows, frames[part_of] - k * rows)
    out = np.empty(frames.sum(), known.dtype)
    put = np.cumsum(count) - count
    together = max(1, (1 << 25) // len(known))  # parts whose histograms are held at once
    for s in range(0, len(first), together):
        own = slice(s, s + together)
        order = np.argsort(-count[own], kind="stable")  # the longest first, so those that still go on stand in front
        at, left, to = first[own][order], count[own][order], put[own][order]
        n = np.arange(len(at))
        histogram = np.zeros((len(at), len(known)), np.int16)
        for j in range(frame):
            histogram[n, rank[at + j]] += 1
        middle, below = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        going = len(at)
        for j in range(int(left[0])):
            going = int(np.searchsorted(-left[:going], -j, side="left"))  # parts with more than j frames
            if j:
                gone, new = rank[at[:going] + j - 1], rank[at[:going] + j + frame - 1]
                histogram[n[:going], gone] -= 1
                histogram[n[:going], new] += 1
                below[:going] += (new < middle[:going]).astype(np.int64) - (gone < middle[:going])
            m, b = middle[:going], below[:going]
            move = np.flatnonzero(b > frame // 2)
            while len(move):
                m[move] -= 1
                b[move] -= histogram[move, m[move]]
                move = move[b[move] > frame // 2]
            more = b + histogram[n[:going], m]
            move = np.flatnonzero(more <= frame // 2)
            while len(move):
                b[move] = more[move]
                m[move] += 1
                more[move] = b[move] + histogram[move, m[move]]
                move = move[more[move] <= frame // 2]
            out[to[:going] + j] = known[m]
    return out.astype(np.float64)


def segmented_kmeans(points: np.ndarray, sizes: np.ndarray, centres: np.ndarray, rounds: int) -> np.ndarray:
    """Lloyd's algorithm for many sets of points side by side: the labels.

    ``points``: all sets one after another; ``centres``: set, cluster, coordinate. Ties go to the lowest label, an empty cluster to the zero point. A set
    whose labels have stopped changing is left alone.
    """
    starts = np.cumsum(sizes) - sizes
    k, d = centres.shape[1:]
    centres = centres.astype(np.float64)
    labels = np.full(len(points), -1, np.int64)
    active = np.flatnonzero(sizes)
    for _ in range(rounds):
        if not len(active):
            break
        of, place = spread(sizes[active])
        at = starts[active][of] + place
        x = points[at]
        own = centres[active]
        best, label = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        for c in range(k):
            far = ((x - own[of, c]) ** 2).sum(1)
            closer = far < best
            best[closer], label[closer] = far[closer], c
        first = np.cumsum(sizes[active]) - sizes[active]
        changed = np.logical_or.reduceat(labels[at] != label, first)
        labels[at] = label
        n = np.bincount(of * k + label, minlength=len(active) * k)
        sums = np.stack([np.bincount(of * k + label, x[:, j], len(n)) for j in range(d)], 1)
        means = (sums / np.maximum(n, 1)[:, None]).reshape(-1, k, d)
        active, means = active[changed], means[changed]
        centres[active] = means
    return labels


def scatter(points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """The squared distances of each set's points (whole numbers) from their clusters' means, summed up.

    It comes from whole sums and doesn't depend on the order of points or clusters, so that equal clusterings are equal.
    """
    starts = np.cumsum(sizes) - sizes
    of, _ = spread(sizes)
    own = points - points[starts][of]
    key = of * k + labels
    n = np.maximum(np.bincount(key, minlength=len(sizes) * k), 1)
    squares = np.add.reduceat((own**2).sum(1), starts).astype(np.float64)
    terms = sum(np.bincount(key, own[:, j], len(n)) ** 2 for j in range(points.shape[1])) / n
    return squares - np.sort(terms.reshape(-1, k), axis=1).sum(1)


def seeds(points: np.ndarray, sizes: np.ndarray, k: int, draws: np.ndarray) -> np.ndarray:
    """Rows of ``k`` first centres of each set: one at random, each other one with a chance as its squared distance from the nearest so far.

    ``points`` are whole numbers, so that sums are exact. ``draws``: set, centre; random numbers from 0 to 2^62.
    """
    starts = np.cumsum(sizes) - sizes
    of, place = spread(sizes)
    chosen = np.empty((len(sizes), k), np.int64)
    chosen[:, 0] = draws[:, 0] % sizes
    far = np.full(len(points), np.iinfo(np.int64).max)
    for c in range(1, k):
        far = np.minimum(far, ((points - points[starts + chosen[:, c - 1]][of]) ** 2).sum(1))
        total = np.cumsum(far)
        before = total[starts] - far[starts]
        whole = total[starts + sizes - 1] - before
        at = np.searchsorted(total, before + draws[:, c] % np.maximum(whole, 1), side="right") - starts
        chosen[:, c] = np.where(whole > 0, at, draws[:, c] % sizes)  # all points are centres already
    return chosen


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where neighbours differ in any of the keys: the first place of each run."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    change = np.zeros(len(keys[0]) - 1, bool)
    for key in keys:
        change |= np.asarray(key[1:] != key[:-1])
    return np.flatnonzero(np.r_[True, change])


def slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, most):
            yield batch.slice(s, most)
