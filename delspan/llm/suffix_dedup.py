"""Operator 6: removal of repeated passages by sharded suffix arrays.

Removed is each byte covered by a string of ``LENGTH`` bytes that also starts anywhere else in the table, in the same document
or another one; matches never cross documents.

Shards. Every window of ``LENGTH`` bytes names the least hash among its ``GRAM``-byte strings, the leftmost one if several are
least. Equal windows name the same string at the same offset, so windows can be dealt out by what they name and equal ones meet.
Consecutive windows that name one place form a *run*; its bytes are a segment that holds exactly these windows whole. What travels first
are hashes of segments, not bytes. Equal segments are one class; a class of two or more is repeated as a whole, however many copies
it has, and its copies are not expanded. Only where different segments name the same string are their bytes cut
out, once for each class, and dealt into shards of about ``SHARD_BYTES``. A string that more than ``CROWDED`` classes name could make a shard
of any size; the windows of its classes are counted by (string, offset, hash of the window) instead, ``PART`` neighbours at a time first, so that equal
bytes are one row before they are dealt and no group of rows is held by a task.

In each shard the segments, with a separator after each, are sorted by induced sorting (:mod:`suffix_sorting`), and a
window is repeated if it shares ``LENGTH`` bytes with the suffix before or after it, by the permuted longest common prefixes.

Defined results: a null text counts as empty; texts shorter than ``LENGTH`` lose nothing; overlapping repeats count; rows
with equal texts (repeated rows too) are different documents, so both lose the repeated text; an empty table gives an empty
result. Kept bytes may begin or end within a character. Other columns are kept by :func:`without_repeats` and not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, give_back, keep_only, lean, materialize
from .shingles import mix
from .suffix_sorting import permuted_lcp, suffix_array

LENGTH, GRAM = 400, 32
SHARD_BYTES = 500_000
CHUNK_BYTES = 500_000
#: The windows of a string named by more classes than this are counted by their hashes, in pieces of ``PART`` windows.
CROWDED, PART = 64, 32
SEPARATOR, END = 0xFF, 0xFE  # bytes that UTF-8 never has
BYTE_HASH = mix(np.arange(256, dtype=np.uint64), 77)
ODD = 0x9E3779B97F4A7C15


def named(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the string, place named) for the window at each start; the leftmost least hash of its strings."""
    h, size, power = BYTE_HASH[data], 1, ODD
    while size < gram:  # hashes of strings twice as long, each time
        h = h[:-size] * np.uint64(power) + h[size:]
        power = power * power & 0xFFFFFFFFFFFFFFFF
        size *= 2
    h = mix(h)
    least, place, width, need = h, np.arange(len(h), dtype=np.int32), 1, length - gram + 1
    while width < need:
        step = min(width, need - width)
        left = least[:-step] <= least[step:]
        least, place = np.where(left, least[:-step], least[step:]), np.where(left, place[:-step], place[step:])
        width += step
    return least, place


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, first start, windows, offset of the named place, its hash, hash of the segment) of each run."""
    out: list[tuple[np.ndarray, ...]] = []
    for s, e in chunks(texts, CHUNK_BYTES):
        joined = b"".join(texts[s:e])
        if len(joined) < LENGTH:
            continue
        ends = np.cumsum([len(t) for t in texts[s:e]])
        least, place = named(np.frombuffer(joined, np.uint8))
        text_of = np.searchsorted(ends, np.arange(len(place)), side="right")
        whole = np.arange(len(place)) + LENGTH <= ends[text_of]
        first = np.flatnonzero(whole & np.r_[True, (place[1:] != place[:-1]) | ~whole[:-1]])
        if not len(first):
            continue
        stop = np.flatnonzero(whole & np.r_[(place[1:] != place[:-1]) | ~whole[1:], True]) + 1
        view = memoryview(joined)
        segments = np.fromiter((xxhash.xxh3_64_intdigest(view[a : b + LENGTH - 1]) for a, b in zip(first.tolist(), stop.tolist(), strict=True)), np.uint64, len(first))
        begin = np.r_[0, ends[:-1]][text_of[first]]
        out.append((text_of[first] + s, first - begin, stop - first, place[first] - first, least[first].view(np.int64), segments.view(np.int64)))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else tuple(np.empty(0, np.int64) for _ in range(6))


def _intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return edge[::2], edge[1::2] - 1


def repeated_windows(segments: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each segment the (first, last) starts of windows that also stand elsewhere in the shard."""
    sizes = np.array([len(s) for s in segments])
    text = np.frombuffer(b"".join(s + bytes([SEPARATOR]) for s in segments) + bytes([END]), np.uint8)
    symbols = text.astype(np.int16) + 1
    symbols[-1] = 0
    sa = suffix_array(symbols)
    phi, plcp = permuted_lcp(text, sa)
    long = np.flatnonzero(plcp >= LENGTH)
    flags = np.zeros(len(text), bool)
    flags[long] = True
    flags[phi[long]] = True
    begins = np.cumsum(sizes + 1) - sizes - 1
    return [_intervals(flags[b : b + n - LENGTH + 1]) for b, n in zip(begins, sizes, strict=True)]


def _crowded_marks(texts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``key, segment, windows, place, low, high``: the windows that stand in two classes or more; and the tables that this reads.

    texts: text, cuts (classes to cut out of it)
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        names = ["key", "segment", "windows", "place", "low", "far", "piece", "hashes"]
        types = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.list_(pa.int64())]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            rows = []
            for text, cuts in zip(batch.column(0), batch.column(1), strict=True):
                raw = memoryview(text.as_py().encode())
                for c in cuts.as_py():
                    windows, place, first = c["windows"], c["place"], c["first"]
                    own = np.fromiter((xxhash.xxh3_64_intdigest(raw[w : w + LENGTH]) for w in range(first, first + windows)), np.uint64, windows).view(np.int64)
                    # windows by how far before the named place they start, PART at a time
                    for band in range((place - windows + 1) // PART, place // PART + 1):
                        low, high = max(0, place - band * PART - PART + 1), min(windows - 1, place - band * PART)
                        hashes = own[low : high + 1]
                        piece = int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))
                        rows.append((c["key"], c["segment"], windows, place, low, place - low, piece, hashes))
                if len(rows) >= 8192:
                    yield flush(rows)
                    rows = []
            if rows:
                yield flush(rows)

    same = ["key", "segment", "windows", "place"]
    of = ["key", "far", "piece"]
    pieces = texts.mapInArrow(lean(hashed), "key long, segment long, windows int, place int, low int, far int, piece long, hashes array<long>")
    pieces = materialize(pieces.dropDuplicates([*same, "low"]), "pieces")  # repeated rows of one document bring their classes twice
    kinds = materialize(pieces.groupBy(*of).agg(F.count("*").alias("times"), F.min("hashes").alias("hashes")), "kinds")
    windows = kinds.select(*of, "times", F.posexplode("hashes").alias("k", "hash")).withColumn("offset", F.col("far") - F.col("k"))
    at = ["key", "offset", "hash"]
    repeated = windows.groupBy(*at).agg(F.count("*").alias("n")).where("n > 1").select(*at)
    shared = windows.where("times = 1").join(repeated, at).groupBy(*of).agg(F.collect_list("k").alias("ks"))
    edge = lambda step: F.sort_array(F.filter("ks", lambda k: ~F.array_contains("ks", k + step)))
    shared = shared.select(*of, F.explode(F.arrays_zip(edge(-1).alias("a"), edge(1).alias("b"))).alias("span")).select(*of, "span.a", "span.b")
    whole = kinds.where("times > 1").select(*of, F.lit(0).alias("a"), (F.size("hashes") - 1).alias("b"))
    marks = pieces.select(*same, "low", *of[1:]).join(whole.unionByName(shared), of)
    return marks.select(*same, (F.col("low") + F.col("a")).alias("low"), (F.col("low") + F.col("b")).alias("high")), [pieces, kinds]


def repeats(docs: DataFrame) -> DataFrame:
    """``tk, n, spans``: for each text (``tk``: its hash, ``n``: its bytes) with repeats, the byte ranges they cover. docs: doc_id, tk, text."""
    spark = docs.sparkSession
    key_type = dict(docs.dtypes)["doc_id"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        names = ["doc_id", "tk", "n", "key", "segment", "windows", "place", "copies", "firsts"]
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                copies: dict[bytes, list[int]] = {}
                for k, text in enumerate(part.column(2).to_pylist()):
                    if text is not None and len(text) * 4 >= LENGTH and len(raw := text.encode()) >= LENGTH:
                        copies.setdefault(raw, []).append(k)
                texts = [*copies]
                ids = part.column(0).to_pylist()
                which = [min(rows, key=lambda k: (ids[k] is not None, ids[k])) for rows in copies.values()]
                text, first, windows, place, key, segment = runs(texts)
                if not len(text):
                    continue
                # equal runs of one text, as in text that goes round in circles, are one row
                order = np.lexsort((first, place, windows, segment, key, text))
                text, first, windows, place, key, segment = (x[order] for x in (text, first, windows, place, key, segment))
                new = np.r_[True, (text[1:] != text[:-1]) | (key[1:] != key[:-1]) | (segment[1:] != segment[:-1]) | (windows[1:] != windows[:-1]) | (place[1:] != place[:-1])]
                at = np.flatnonzero(new)
                ends = np.r_[at, len(first)].astype(np.int32)
                firsts = pa.ListArray.from_arrays(pa.array(ends), pa.array(first.astype(np.int32)))
                text, windows, place, key, segment = (x[at] for x in (text, windows, place, key, segment))
                row = pa.array(np.array(which)[text])
                sizes, times = np.array([len(t) for t in texts], np.int64), np.array([len(r) for r in copies.values()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(row), part.column(1).take(row), pa.array(sizes[text]), pa.array(key), pa.array(segment), *(pa.array(x.astype(np.int32)) for x in (windows, place)), pa.array(times[text] * np.diff(ends)), firsts],
                    names,
                )

    found = docs.mapInArrow(lean(find), f"doc_id {key_type}, tk long, n long, key long, segment long, windows int, place int, copies long, firsts array<int>")
    found = materialize(found, "runs")
    same = ["key", "segment", "windows", "place"]
    classes = found.groupBy(*same).agg(F.sum("copies").alias("copies"), F.min(F.struct("doc_id", "tk", F.col("firsts")[0].alias("first"))).alias("at"))
    classes = materialize(classes, "all_classes")
    of_key = classes.groupBy("key").agg(F.sum("copies").alias("all"), F.count("*").alias("classes")).where(F.col("all") > 1)
    every, classes = classes, materialize(classes.join(of_key.select("key", "classes"), "key").select(*same, "copies", "classes", "at.*"), "classes")
    discard(every)
    several, crowded = classes.where(F.col("classes").between(2, CROWDED)), classes.where(F.col("classes") > CROWDED)
    bytes_in = several.agg(F.sum(F.col("windows") + LENGTH)).first()[0] or 0
    shards = bytes_in // SHARD_BYTES + 1

    def with_cuts(of: DataFrame) -> DataFrame:
        wanted = of.groupBy("doc_id", "tk").agg(F.collect_list(F.struct(*same, "first")).alias("cuts"))
        return docs.join(wanted.select(F.col("doc_id").alias("of"), F.col("tk").alias("tk2"), "cuts"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tk") == F.col("tk2"))).select("text", "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", *same, "bytes"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            rows, held = [], 0
            for text, cuts in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_py().encode()
                for c in cuts.as_py():
                    key, windows, first = c["key"], c["windows"], c["first"]
                    rows.append((key % shards, key, c["segment"], windows, c["place"], raw[first : first + windows + LENGTH - 1]))
                    held += windows + LENGTH
                if held >= 4 << 20:
                    yield flush(rows)
                    rows, held = [], 0
            if rows:
                yield flush(rows)

    pieces = with_cuts(several).mapInArrow(lean(cut), "shard long, key long, segment long, windows int, place int, bytes binary")

    def sort(shard: pd.DataFrame) -> pd.DataFrame:
        keep_only()
        shard = shard.drop_duplicates(same)  # repeated rows of one document bring their segments twice
        out = []
        marks = repeated_windows(shard["bytes"].tolist())
        for own, (low, high) in zip(shard[same].itertuples(index=False), marks, strict=True):
            out += [(*own, a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        give_back()
        return pd.DataFrame(out, columns=[*same, "low", "high"]).astype("int64")

    marks = pieces.groupBy("shard").applyInPandas(sort, "key long, segment long, windows int, place int, low int, high int")
    read = [found, classes]
    if not crowded.isEmpty():
        more, tables = _crowded_marks(with_cuts(crowded))
        marks = marks.unionByName(more)
        read += tables
    alone = classes.where("copies > 1").select(*same, F.lit(0).alias("low"), (F.col("windows") - 1).alias("high"))
    marks = materialize(marks.join(classes.where("copies > 1"), same, "left_anti").select(*same, "low", "high").unionByName(alone), "marks")
    spans = found.join(marks, same).select("tk", "n", F.explode("firsts").alias("first"), "low", "high").select("tk", "n", F.struct((F.col("first") + F.col("low")).alias("a"), (F.col("first") + F.col("high") + LENGTH).alias("b")).alias("span"))
    spans = materialize(spans.groupBy("tk", "n").agg(F.collect_set("span").alias("spans")), "spans")
    discard(marks, *read)
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that touch or overlap, joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` as the struct ``row``, with ``n_bytes, spans`` (removed byte ranges), ``kept`` (the other bytes) and ``text`` (as characters, without cut ones)."""
    tk = F.xxhash64(text_col)
    found = repeats(df.select(F.col(id_col).alias("doc_id"), tk.alias("tk"), F.col(text_col).alias("text")))
    n = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(text_col).alias("text"), tk.alias("tk"), n.alias("n_bytes"))
    joined = rows.join(found.withColumnRenamed("n", "n_bytes"), ["tk", "n_bytes"], "left")

    @F.pandas_udf("spans array<struct<a:int,b:int>>, kept binary, text string")
    def strip(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        keep_only()
        for texts, spans in batches:
            out = []
            for text, own in zip(texts, spans, strict=True):
                if own is None:
                    out.append(([], None, None))
                    continue
                raw = text.encode()
                ranges = merged([(s["a"], s["b"]) for s in own])
                at, kept = 0, []
                for a, b in ranges:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join([*kept, raw[at:]])
                out.append(([{"a": a, "b": b} for a, b in ranges], left, left.decode("utf-8", "ignore")))
            yield pd.DataFrame(out, columns=["spans", "kept", "text"])
        give_back()

    has = F.col("spans").isNotNull()
    # not to be run again for each column or filter that reads its result
    removed = joined.withColumn("s", strip.asNondeterministic()(F.when(has, F.col("text")), "spans"))
    kept = F.when(has, F.col("s.kept")).otherwise(F.coalesce("text", F.lit("")).cast("binary"))
    return removed.select("row", "n_bytes", F.col("s.spans").alias("spans"), kept.alias("kept"), F.when(has, F.col("s.text")).otherwise(F.col("text")).alias("text"))


def removal_digests(df: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, text`` of what :func:`without_repeats` returns."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["b"] - s["a"])
    found = without_repeats(df.select("doc_id", "text"))
    return found.select("row.doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "text")


def drop_repeats(df: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of ``df`` with repeated passages taken out of their texts; rows of which nothing is left go.

    Cut characters are dropped with the passage; ``length_col``, if there is one, becomes the new number of characters.
    """
    found = without_repeats(df, text_col=text_col).where((F.size("spans") == 0) | (F.octet_length("kept") > 0))
    cols = []
    for c in df.columns:
        own = F.col("row").getField(c)
        if c == text_col:
            cols.append(F.col("text").alias(c))
        elif c == length_col:
            cols.append(F.when(F.size("spans") == 0, own).otherwise(F.length("text").cast(dict(df.dtypes)[c])).alias(c))
        else:
            cols.append(own.alias(c))
    return found.select(*cols)


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by a table of all strings; for tests."""
    seen: dict[bytes, int] = {}
    raws = [(t or "").encode() for t in texts]
    for raw in raws:
        for k in range(len(raw) - length + 1):
            seen[raw[k : k + length]] = seen.get(raw[k : k + length], 0) + 1
    out = []
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone]) if raw else b""
        out.append((len(raw), int(gone.sum()), len(_intervals(gone)[0]), hashlib.sha256(kept).hexdigest()))
    return out
