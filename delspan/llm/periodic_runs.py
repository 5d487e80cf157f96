"""Operator 11: runs of words that repeat with a period, by enhanced suffix arrays.

A *run* is a stretch of words with smallest period ``q`` (words ``q`` apart are identical), at least ``LEAST`` words and ``TIMES`` periods
long, that no neighbouring word extends with that period. Each is found through the square at its right end, which the next word breaks
off: the suffixes that start at the square and at its second half share exactly ``q`` words.

Texts are words numbered within each document, so suffixes of two documents never share a word, and each document ends in a number of its
own. Suffixes are sorted by doubling ranks; the ranks of each step are kept, so that common prefixes are found by halving steps. Every stretch of the
suffix array whose neighbours share at least ``depth`` words, and some exactly that many (an interval of common prefixes), is split where they share no
more. For each suffix of all parts but the largest, the suffixes ``depth`` words before and after it are looked up in the inverse suffix array:
within the same interval, but another part, they make a square that ends there. Parts left out are the largest of their interval, so a suffix is looked
up at most as often as the logarithm of its document's length. Squares are rotated to the left as far as they go, by ranks again, which gives
the run; of runs over the same words the one of the smallest period stays. Intervals are numbers in arrays, no tree is built.

A document's arrays are held by one task: about 150 bytes a word, a text of ten million words needs 1.5 GB. Short documents are sorted together, about
``CHUNK_WORDS`` words at a time.

Defined results: null and empty texts, and those of white space, have no words, no run and an empty rest; rows are documents of their own, so repeated
rows or ids give repeated results; an empty table gives an empty result; runs of equal length are ordered by start, then period. A null id
leaves the text as it is in :func:`rewritten`. Other columns are kept by :func:`periodic_runs` and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_only, lean

LEAST, TIMES = 6, 4
CHUNK_WORDS = 1 << 18


def numbered(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words, where documents begin): equal words of a document have one number; each document ends in one of its own."""
    out, begins, base, at = [], [], 0, 0
    for words in documents:
        seen: dict[bytes, int] = dict.fromkeys(words, 0)
        for k, word in enumerate(seen, base):
            seen[word] = k
        begins.append(at)
        at += len(words) + 1
        out.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
        base += len(seen)
        out.append(np.array([base], np.int32))
        base += 1
    return np.concatenate(out), np.array(begins, np.int64)


def ranked(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks by the first 1, 2, 4, ... words). Suffixes with the same rank share so many words."""
    n = len(symbols)
    places = np.arange(n, dtype=np.int32)
    sa = np.argsort(symbols, kind="stable").astype(np.int32)
    ordered = symbols[sa]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(first, places, 0))
    levels, step = [rank], 1
    while True:
        open_at = np.flatnonzero(~(first & np.r_[first[1:], True]))  # places whose rank is shared
        if not len(open_at):
            return sa, levels
        who = sa[open_at]
        keys = levels[-1][who].astype(np.int64) * n + levels[-1][who + step]  # what is shared holds no end, so there is a suffix behind it
        by = np.argsort(keys, kind="stable")
        sa[open_at], keys = who[by], keys[by]
        new = np.r_[True, keys[1:] != keys[:-1]]
        first[open_at] = new
        rank = levels[-1].copy()
        rank[sa[open_at]] = np.maximum.accumulate(np.where(new, open_at, 0))
        levels.append(rank)
        step *= 2


def _shared(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words the suffixes at ``a`` and ``b`` share, or the stretches that end before them."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    total = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = (a - (1 << k), b - (1 << k)) if back else (a, b)
        inside = (x >= 0) & (y >= 0) & (x < len(levels[k])) & (y < len(levels[k]))
        same = np.flatnonzero(inside)
        same = same[levels[k][x[same]] == levels[k][y[same]]]
        total[same] += 1 << k
        move = -(1 << k) if back else 1 << k
        a[same] += move
        b[same] += move
    return total


def _smaller(values: np.ndarray, least: np.ndarray, at: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest places before and after ``at`` with a value below ``least``; the first and the last value are below all."""
    tables = [values]
    while (1 << len(tables)) <= longest:
        last, width = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.minimum(last[:-width], last[width:]))
    before, after = at.copy(), at.copy()  # all values in [before, at) and (at, after] are large enough
    for k in range(len(tables) - 1, -1, -1):
        width = 1 << k
        x = np.maximum(before - width, 0)
        before = np.where((before >= width) & (tables[k][x] >= least), x, before)
        y = np.minimum(after + 1, len(tables[k]) - 1)
        after = np.where((after + 1 < len(tables[k])) & (tables[k][y] >= least), after + width, after)
    return before - 1, after + 1


def find_runs(symbols: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) in order of start and period. ``longest``: words of the longest document."""
    n = len(symbols)
    sa, levels = ranked(symbols)
    isa = levels[-1].astype(np.int64)
    lcp = np.zeros(n + 1, np.int32)  # lcp[k]: what places k - 1 and k share
    with_same = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    lcp[with_same] = _shared(levels, sa[with_same - 1], sa[with_same])
    cuts = with_same
    depth = lcp[cuts]
    low, high = _smaller(lcp, depth, cuts, longest + 1)  # the interval has the places low, ..., high - 1
    # cuts of an interval next to one another: it starts at low, and is the one with this end there
    order = np.lexsort((cuts, high, low))
    cuts, depth, low, high = cuts[order], depth[order].astype(np.int64), low[order], high[order]
    new = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])][: len(cuts)]
    starts = np.flatnonzero(new)
    if not len(starts):
        return np.empty((0, 3), np.int64)
    # parts: one before each cut, and one after the last of each interval
    begin = np.r_[0, cuts[:-1]]
    begin[starts] = low[starts]
    last = np.r_[starts[1:], len(cuts)] - 1
    begin, end = np.r_[begin, cuts[last]], np.r_[cuts, high[last]]
    of = np.r_[np.cumsum(new) - 1, np.arange(len(starts))]
    size = end - begin
    by = np.lexsort((size, of))
    largest = by[np.r_[of[by][1:] != of[by][:-1], True]]
    small = np.ones(len(size), bool)
    small[largest] = False
    begin, size, of = begin[small], size[small], of[small]
    found = []
    for s, e in _blocks(size):
        which = np.repeat(np.arange(s, e), size[s:e])
        place = np.arange(len(which)) - np.repeat(np.cumsum(size[s:e]) - size[s:e], size[s:e]) + begin[which]
        i, d = sa[place].astype(np.int64), depth[starts][of[which]]
        lo, hi, own, stop = low[starts][of[which]], high[starts][of[which]], begin[which], begin[which] + size[which]
        for j, first in ((i + d, i), (i - d, i - d)):
            inside = np.flatnonzero((j >= 0) & (j < n))
            p = isa[j[inside]]
            square = inside[(p >= lo[inside]) & (p < hi[inside]) & ((p < own[inside]) | (p >= stop[inside]))]
            found.append(np.stack([first[square], d[square]], 1))
    squares = np.unique(np.concatenate(found), axis=0)
    start, period = squares[:, 0], squares[:, 1]
    more = _shared(levels, start, start + period, back=True)
    rows = np.stack([start - more, 2 * period + more, period], 1)
    rows = rows[rows[:, 1] >= np.maximum(least, times * rows[:, 2])]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    keep = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)][: len(rows)]
    rows = rows[keep]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _blocks(sizes: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(start, end) of neighbours of about ``most`` together."""
    total = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + most, side="right")))
        yield start, end
        start = end


def runs_of(documents: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """The (start, length, period) of the runs of each document."""
    if not documents:
        return []
    symbols, begins = numbered(documents)
    rows = find_runs(symbols, max(map(len, documents)), least, times)
    of = np.searchsorted(begins, rows[:, 0], side="right") - 1
    rows[:, 0] -= begins[of]
    edges = np.searchsorted(of, np.arange(len(documents) + 1))
    return [rows[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run contains after its first period, joined by spaces."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()])


def periodic_runs(df: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The rows of ``df`` as the struct ``row``, with ``runs`` (start, length, period in words, in order) and ``collapsed`` (the text without repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        fields = ["start", "length", "period"]

        def work(part: pa.RecordBatch, documents: list[list[bytes]]) -> pa.RecordBatch:
            found = runs_of(documents, least, times)
            flat = np.concatenate(found)
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            runs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields))
            left = pa.array([collapsed(w, r).decode() for w, r in zip(documents, found, strict=True)], pa.string())
            return pa.RecordBatch.from_arrays([part.column(0), runs, left], ["row", "runs", "collapsed"])

        for batch in batches:
            start, held, documents = 0, 0, []
            for k, text in enumerate(batch.column(1)):
                documents.append((text.as_py() or "").encode().split())  # ASCII white space only, as these are bytes
                held += len(documents[-1]) + 1
                if held >= CHUNK_WORDS or k + 1 == batch.num_rows:
                    yield work(batch.slice(start, k + 1 - start), documents)
                    start, held, documents = k + 1, 0, []

    rows = df.select(F.struct(*df.columns).alias("row"), F.col(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"row {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def rewritten(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, of which a tenth of all documents repeat a stretch of words to their end."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = F.when(n > 0, g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return F.when((h % 10 == 0) & (n > 0), text).otherwise(F.col(text_col))


def run_digests(df: DataFrame) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` of rewritten texts, with ``collapsed``."""
    found = periodic_runs(df.select("doc_id", rewritten().alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.select("row.doc_id", "runs", "collapsed", best.alias("best"), lines.alias("lines"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "collapsed",
    )


def brute_force(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """The runs by comparing all words each period apart; for tests."""
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        k = 0
        while k + q < n:
            if words[k] != words[k + q]:
                k += 1
                continue
            start = k
            while k + q < n and words[k] == words[k + q]:
                k += 1
            if k + q - start >= max(least, times * q) and (start, k + q) not in out:
                out[start, k + q] = q
    return sorted((s, e - s, q) for (s, e), q in out.items())
