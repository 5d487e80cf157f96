"""Connected components of a distributed edge table by alternating large-star and small-star steps.

Each round joins every vertex with the least vertex of its neighbourhood and rewrites edges towards it; only minima are
aggregated, so no neighbourhood is ever gathered, and a vertex with very many neighbours is a skewed join side that
Spark splits. The number of rounds grows with the logarithm of the longest path. Every round ends in a written table, and the
one before it is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, materialize

EDGES = 1 << 19


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each id to the least id that it is connected with by these edges."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new][label]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars in place of a task's own edges, ``EDGES`` at a time: fewer edges and shorter paths before anything is shuffled."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    some = False
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        some = True
        if sum(len(u) for u, _ in held) >= EDGES:
            u, v = stars(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
            held = []
    if some and held:
        u, v = stars(*map(np.concatenate, zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component_id`` (the least id of the component) for each id in ``edges`` (``u, v``, whole numbers) that has another neighbour.

    Loops, repeated edges, either direction and null ends are allowed; edges with a null end connect nothing.
    """
    tidy = edges.where(edges.u.isNotNull() & edges.v.isNotNull() & (edges.u != edges.v)).select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    now = materialize(tidy.mapInArrow(lean(contract), "u long, v long").distinct(), "edges")
    before = None
    while True:
        n, mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if n == 0 or (n, mark) == before:
            break
        before = n, mark
        # large star: each vertex connects its greater neighbours with the least of its neighbourhood
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large_star")
        discard(now)
        # small star: each vertex connects its lesser neighbours and itself with the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        now = materialize(small.distinct(), "small_star")
        discard(large)
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionAll(roots)
