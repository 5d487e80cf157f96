"""Operator 4: embedding near-duplicates by random-hyperplane signs in several tables.

Equal vectors are one class from the start. In each of ``tables`` tables a class falls into the bucket of its signs against
``bits`` random hyperplanes. ``bits`` follows the logarithm of the number of classes, so that buckets of unrelated vectors hold about
``BUCKET`` of them, and ``tables`` is what a pair at the threshold needs to meet with probability ``recall``. Closer pairs meet more surely.

Into the buckets go ids and ``SKETCH_BITS`` further signs only. Pairs whose sketches differ by no more than ``DOUBT`` standard deviations above what a
pair at the threshold is expected to (one in three million such pairs differs by more) are candidates, and their cosines are computed exactly, in
doubles, from the vectors, which are joined to them. Where candidates are more than ``DENSE`` times the members of a piece of work, as among
many near copies, the bucket is dense and no pairs leave it: vectors are sent to it, all its cosines are computed there, a pair
counts there if it meets neither in a bucket that isn't dense nor in an earlier table, and what leaves are sums of links for each class and a
spanning forest of the links. So nothing that is sent grows with the square of a group. A bucket above ``BLOCK`` classes is split into blocks, and every pair of blocks is a piece
of work of its own: nothing is dropped. Components come from :mod:`components`.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths don't link; repeated rows are vectors of their own, linked with each other; a null id is reported with
a null component and not kept. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep_only, lean, materialize, partitions_for
from .components import connected_components
from .vectors import matrices, usable

THRESHOLD, RECALL, SEED, BLOCK, BUCKET = 0.95, 0.998, 7, 2048, 1024
SKETCH_BITS, DOUBT, DENSE = 128, 5.0, 4
#: Pairs whose sketches are compared at a time.
AT_ONCE = 1 << 19


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for n classes."""
    bits = max(6, math.ceil(math.log2(max(n, 1) / BUCKET + 1)))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def most_apart(threshold: float) -> int:
    """In how many bits the sketches of a pair at the threshold differ at most."""
    p = math.acos(threshold) / math.pi
    return math.floor(SKETCH_BITS * p + DOUBT * math.sqrt(SKETCH_BITS * p * (1 - p)))


def signatures(x: np.ndarray, bits: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket in each table, sketch) of each vector."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], tables * bits + SKETCH_BITS))
    signs = x @ planes > 0
    codes = signs[:, : tables * bits].reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
    return codes, np.packbits(signs[:, tables * bits :], axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def close_pairs(side: np.ndarray, sketches: np.ndarray, apart: int, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The pairs of one piece of work whose sketches are close, and whether they are more than ``most`` (then they are of no use).

    side: 0 and 1 for a pair of blocks, else all 0.
    """
    first = np.flatnonzero(side == 0)
    across = len(first) < len(side)
    second = np.flatnonzero(side == 1) if across else first
    words = sketches.view(np.uint64)
    left, right, n = [], [], 0
    step = max(1, AT_ONCE // max(1, len(second)))
    for s in range(0, len(first), step):
        part = first[s : s + step]
        far = sum(np.bitwise_count(words[part, k][:, None] ^ words[second, k][None, :]).astype(np.uint16) for k in range(words.shape[1]))
        a, b = np.nonzero(far <= apart)
        a, b = part[a], second[b]
        if not across:
            a, b = a[a < b], b[a < b]
        left.append(a), right.append(b)
        n += len(a)
        if n > most:
            return a, b, True
    none = np.empty(0, np.int64)
    return np.concatenate(left) if left else none, np.concatenate(right) if right else none, False


def dense_links(ids: np.ndarray, mult: np.ndarray, x: np.ndarray, codes: np.ndarray, side: np.ndarray, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links of each) and forest edges (u, v) of one piece of work of a dense bucket. codes: negative where the bucket is dense."""
    n = len(ids)
    first = np.flatnonzero(side == 0)
    across = len(first) < n
    second = np.flatnonzero(side == 1) if across else first
    links, label = np.zeros(n), np.arange(n)
    step = max(1, AT_ONCE // max(1, len(second)))
    for s in range(0, len(first), step):
        part = first[s : s + step]
        a, b = np.nonzero(x[part] @ x[second].T >= threshold)
        a, b = part[a], second[b]
        if not across:
            a, b = a[a < b], b[a < b]
        own = np.ones(len(a), bool)
        for t in range(codes.shape[1]):
            if t != table:
                own &= (codes[a, t] != codes[b, t]) | ((codes[a, t] < 0) & (t > table))
        a, b = a[own], b[own]
        links += np.bincount(a, weights=mult[b], minlength=n) + np.bincount(b, weights=mult[a], minlength=n)
        while True:  # join the labels of linked classes, then the labels' labels, until nothing changes
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            new = new[new][label]
            if (new == label).all():
                break
            label = new
    linked, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(n))
    return ids[linked], links[linked].astype(np.int64), ids[moved], ids[label[moved]]


def pieces(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Sorted rows cut so that rows with equal first ``keys`` columns stay together; several such groups to a table."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, rows]) if held is not None else rows
        last = np.stack([held.column(k).to_numpy() for k in range(keys)], axis=1)
        same = np.flatnonzero((last != last[-1]).any(axis=1))  # the last key may go on in the next batch
        cut = int(same[-1]) + 1 if len(same) else 0
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None:
        yield held


def groups(table: pa.Table, keys: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the rows of each key with two rows or more."""
    columns = np.stack([table.column(k).to_numpy() for k in range(keys)], axis=1)
    starts = np.flatnonzero(np.r_[True, (columns[1:] != columns[:-1]).any(axis=1)])
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(columns)], strict=True):
        if e - s > 1:
            yield s, e


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    whole = usable(F.col("vector")) & F.col("vec_id").isNotNull()
    classes = materialize(rows.where(whole).groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("mult")), "vectors")
    n = classes.count()
    bits, tables = plan(n, threshold, recall)
    apart = most_apart(threshold)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in batches:
            for at, x in matrices(batch.column(1)):
                codes, sketches = signatures(x, bits, tables, seed)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), x.shape[1], np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * tables), pa.array(codes.ravel())), pa.array([r.tobytes() for r in sketches], pa.binary())],
                    ["id", "dim", "codes", "sketch"],
                )

    encoded = materialize(classes.select("id", "vector").mapInArrow(lean(encode), "id long, dim int, codes array<long>, sketch binary"), "codes")
    placed = encoded.select("id", "dim", "sketch", F.posexplode("codes").alias("t", "code"))
    sizes = placed.groupBy("dim", "t", "code").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    sizes = materialize(sizes.select("dim", "t", "code", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "buckets")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # a block meets itself and every other one: (i, j) with i <= j, where the class stands on the side that is its own block
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, block).alias("i"), F.greatest(k, block).alias("j"), (block > k).cast("int").alias("side")))
    key = ["dim", "t", "code", "i", "j"]

    def work(placed: DataFrame, *columns: str) -> DataFrame:
        """The rows of each piece of work, side by side."""
        rows = placed.join(sizes, ["dim", "t", "code"], "left").fillna(1, ["blocks"]).withColumn("p", F.explode(others)).select("dim", "t", "code", "p.i", "p.j", "p.side", "id", *columns)
        return rows.repartition(partitions_for(spark, n * tables * 64.0), *key)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        names, types = ["a", "b", "dim", "t", "code"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        for table in pieces(batches, 5):
            bucket = [table.column(k).to_numpy() for k in range(3)]
            side, ids = table.column(5).to_numpy(), table.column(6).to_numpy()
            sketches = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint8).reshape(len(ids), -1)
            out: list[list] = [[np.empty(0, np.int64)] for _ in range(5)]
            for s, e in groups(table, 5):
                a, b, many = close_pairs(side[s:e], sketches[s:e], apart, DENSE * (e - s))
                if many:  # the bucket, without pairs
                    a = b = np.zeros(1, np.int64)
                found = [np.full(1, -1)] * 2 if many else [ids[s:e][a], ids[s:e][b]]
                for into, column in zip(out, [*found, *(np.full(len(a), c[s]) for c in bucket)], strict=True):
                    into.append(column)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t.to_pandas_dtype())) for c, t in zip(out, types, strict=True)], names)

    sifted = work(placed, "sketch").sortWithinPartitions(*key).mapInArrow(lean(sift), "a long, b long, dim int, t int, code long")
    sifted = materialize(sifted, "sifted")  # a dense piece's row has ids -1, which no pair of equal ids has
    bucket = ["dim", "t", "code"]
    dense = materialize(sifted.where("a = b").select(*bucket).distinct(), "dense")
    pairs = sifted.where("a <> b").join(dense, bucket, "left_anti").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = classes.select("id", "vector", "mult")
    pairs = pairs.join(of.select(F.col("id").alias("a"), F.col("vector").alias("x"), F.col("mult").alias("mult_a")), "a").join(of.select(F.col("id").alias("b"), F.col("vector").alias("y"), F.col("mult").alias("mult_b")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in batches:
            for (at, x), (_, y) in zip(matrices(batch.column(2)), matrices(batch.column(3)), strict=True):  # only vectors of one length share a bucket
                linked = pa.array(at[np.einsum("ij,ij->i", unit(x), unit(y)) >= threshold])
                yield pa.RecordBatch.from_arrays([batch.column(k).take(linked) for k in (0, 1, 4, 5)], ["a", "b", "mult_a", "mult_b"])

    linked = pairs.select("a", "b", "x", "y", "mult_a", "mult_b").mapInArrow(lean(compare), "a long, b long, mult_a long, mult_b long")
    linked = materialize(linked, "linked")
    links = linked.select(F.col("a").alias("id"), F.col("mult_b").alias("n")).unionAll(linked.select(F.col("b").alias("id"), F.col("mult_a").alias("n")))
    edges = linked.select(F.col("a").alias("u"), F.col("b").alias("v"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for table in pieces(batches, 5):
            t, side, ids, mult = (table.column(k).to_numpy() for k in (1, 5, 6, 7))
            codes, vectors = table.column(8).combine_chunks(), table.column(9).combine_chunks()
            codes = np.asarray(codes.flatten()).reshape(-1, tables)
            for s, e in groups(table, 5):
                ((_, x),) = matrices(vectors[s:e])
                found, sums, u, v = dense_links(ids[s:e], mult[s:e], unit(x), codes[s:e], side[s:e], int(t[s]), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[found, u]), pa.array([*[None] * len(found), *v.tolist()], pa.int64()), pa.array(np.r_[sums, np.zeros(len(u), np.int64)])], ["u", "v", "n"])

    written = [encoded, sizes, sifted, dense]
    if not dense.isEmpty():
        members = materialize(placed.drop("sketch").join(dense, bucket), "members")
        in_dense = members.groupBy("id").agg(F.collect_set("t").alias("ts"))  # at most as many as tables
        flagged = encoded.join(in_dense, "id").select("id", F.transform("codes", lambda c, t: F.when(F.array_contains("ts", t), -1 - c).otherwise(c)).alias("codes"))
        rows_of = members.join(flagged, "id").join(of, "id")
        more = work(rows_of, "mult", "codes", "vector").sortWithinPartitions(*key).mapInArrow(lean(link), "u long, v long, n long")
        more = materialize(more, "dense_links")
        links = links.unionAll(more.where("v is null").select(F.col("u").alias("id"), "n"))
        edges = edges.unionAll(more.where("v is not null").select("u", "v"))
        written.append(members)
    parts_of = connected_components(edges)
    sums = links.groupBy("id").agg(F.sum("n").alias("n"))
    result = classes.join(sums, "id", "left").join(parts_of, "id", "left").select(F.col("vector").alias("of"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("component_id", "id").alias("component"))
    found = rows.where(whole).join(result, F.col("vector") == F.col("of")).select("vec_id", "n", "component")
    none = rows.where(~whole).select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component"))  # apart, not as one key of the join
    discard(*written)
    return found.unionAll(none).select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))


NEAR_DUPLICATES_SQL = """
WITH RECURSIVE g AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda y: y <> 0)) > 0),
e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
c(id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.v, c.r FROM c JOIN e ON e.u = c.id WHERE c.r < e.v)
SELECT m.vec_id, CAST((SELECT count(*) FROM e WHERE e.u = m.vec_id) AS BIGINT) AS n_links, CAST(min(c.r) AS BIGINT) AS component_id, m.vec_id = min(c.r) AS kept
FROM embeddings m JOIN c ON c.id = m.vec_id GROUP BY m.vec_id
"""
