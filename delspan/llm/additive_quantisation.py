"""Operator 2: approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one word from each of ``STAGES`` full-dimensional codebooks. The codebooks are trained one
after another on what the earlier ones leave of a bounded sample (``SAMPLE`` vectors); every vector of the table is
then coded by beam search over all stages. With the codes are stored the norms of the vector, of its coded sum and of
what is left. A query's inner product with a candidate is read from lookup tables (one number for each word) and
scaled by the two norms.

The searched rows are dealt into blocks by their ids, and so are the queries; each pair of blocks is a piece of work, large enough that tables of less
than ``QUERY_BLOCK`` queries send each vector once. In it
every candidate is scored from the tables, and all those are ranked again by exact inner products whose estimate, with
``MARGIN`` standard errors of its own residual norm, reaches the ``k``-th best estimate. So groups of near copies,
which codes can't tell apart, are ranked exactly as a whole, and no fixed number of candidates cuts them. Copies of
one vector are scored once, with their ``k + 1`` smallest ids, which suffice for any list of ``k``.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids;
queries find only vectors of their length; repeated rows count once; of an id with several vectors the best score counts, asked or found; ties go to the smaller id; fewer candidates
than ``k`` are all returned; no query or no candidate gives no row. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep_only, lean, materialize
from .vectors import matrices, usable

STAGES, WORDS, BEAM, ROUNDS, SAMPLE, SEED = 16, 256, 4, 6, 8192, 11
MARGIN = 3.0
LENGTHS = 64
BLOCK, QUERY_BLOCK = 16_384, 8_192


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words * words).sum(1) - 2 * (x @ words.T), axis=1)


def train(sample: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Codebooks (stages, words, dimensions); the first word of every book but the first is zero."""
    rng = np.random.default_rng(seed)
    left = sample.astype(np.float32)
    books = np.zeros((STAGES, WORDS, sample.shape[1]), np.float32)
    for m in range(STAGES):
        words = left[rng.choice(len(left), WORDS, replace=len(left) < WORDS)]
        for _ in range(ROUNDS):
            if m:
                words[0] = 0
            at = _nearest(left, words)
            order = np.argsort(at, kind="stable")
            used, starts = np.unique(at[order], return_index=True)
            sums = np.add.reduceat(left[order], starts, axis=0)
            words[used] = sums / np.diff(np.r_[starts, len(at)])[:, None]
        if m:
            words[0] = 0
        books[m] = words
        left = left - words[_nearest(left, words)]
    return books


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, what is left) of each vector by beam search: the ``BEAM`` best sums are kept from stage to stage."""
    n, d = x.shape
    left = x.astype(np.float32)[:, None, :]
    codes = np.zeros((n, 1, 0), np.uint8)
    for words in books:
        beams = left.shape[1]
        # |left - word|^2 without the part that all words share
        far = (left * left).sum(2)[:, :, None] + (words * words).sum(1) - 2 * (left.reshape(-1, d) @ words.T).reshape(n, beams, -1)
        far = far.reshape(n, -1)
        best = np.argpartition(far, BEAM - 1, axis=1)[:, :BEAM]
        beam, word = best // len(words), best % len(words)
        left = np.take_along_axis(left, beam[:, :, None], 1) - words[word]
        codes = np.concatenate([np.take_along_axis(codes, beam[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
    best = np.argmin((left * left).sum(2), axis=1)
    return codes[np.arange(n), best], left[np.arange(n), best]


def _search(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, exact scores) of the k best found; own: each query's own id, which is left out."""
    order = np.argsort(ids, kind="stable")
    ids, x, codes, norms = ids[order], x[order], codes[order], norms[order]
    _, first, group = np.unique(x.view(f"V{x.shape[1] * x.itemsize}").ravel(), return_index=True, return_inverse=True)
    members = np.argsort(group, kind="stable")  # by class, then id
    starts = np.r_[0, np.cumsum(np.bincount(group))]
    x, codes, norms = x[first], codes[first].astype(np.int64) + np.arange(STAGES) * WORDS, norms[first]
    scale = (norms[:, 0] / np.maximum(norms[:, 1], 1e-30)).astype(np.float32)
    doubt = (MARGIN * norms[:, 2] / np.sqrt(x.shape[1])).astype(np.float32)
    flat = books.reshape(-1, x.shape[1])
    columns = np.ascontiguousarray(codes.T)
    for q, mine in zip(queries, own, strict=True):
        table = flat @ q.astype(np.float32)
        score = np.zeros(len(x), np.float32)
        for column in columns:
            score += table[column]
        score *= scale
        need = min(k + 1, len(x))  # the query itself may be among them
        least = np.partition(score, len(x) - need)[len(x) - need]
        picked = np.flatnonzero(score + doubt * np.float32(np.linalg.norm(q)) >= least)
        exact = x[picked].astype(np.float64) @ q
        if len(picked) > 2 * need:
            keep = exact >= np.partition(exact, len(picked) - need)[len(picked) - need]
            picked, exact = picked[keep], exact[keep]
        found_ids, found = [], []
        for c, s in zip(picked, exact, strict=True):
            copies = ids[members[starts[c] : min(starts[c] + k + 1, starts[c + 1])]]
            copies = copies[copies != mine]
            found_ids.append(copies)
            found.append(np.full(len(copies), s))
        near, scores = np.concatenate(found_ids), np.concatenate(found)
        best = np.lexsort((near, -scores))[:k]
        yield mine, near[best], scores[best]


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``is_query`` its k nearest others by inner product."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(usable(F.col(vector_col)) & F.col("id").isNotNull())
    rows = materialize(rows.dropDuplicates(["id", "vector"]).withColumn("dim", F.size("vector")), "vectors")
    counts = {r.dim: r for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).orderBy("dim").limit(LENGTHS + 1).collect()}
    if len(counts) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths: each has codebooks of its own")
    books = {}
    for dim, c in counts.items():
        every = max(1, c.n // SAMPLE)
        sample = rows.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(every)) == 0)).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()
        x = matrices(sample.column(0).combine_chunks())
        books[dim] = train(x[0][1] if x else np.ones((1, dim)))
    shared = spark.sparkContext.broadcast(books)
    kind = np.float32 if "float" in dict(rows.dtypes)["vector"] else np.float64
    blocks = F.create_map(*(F.lit(v) for d, c in counts.items() for v in (d, -(-c.n // BLOCK)))) if counts else F.create_map(F.lit(0), F.lit(1))
    asked = F.create_map(*(F.lit(v) for d, c in counts.items() for v in (d, max(1, -(-c.q // QUERY_BLOCK))))) if counts else F.create_map(F.lit(0), F.lit(1))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch.column(1)):
                for s in range(0, len(at), 2048):
                    part = x[s : s + 2048]
                    codes, left = encode(part, shared.value[x.shape[1]])
                    norms = np.stack([np.linalg.norm(part, axis=1), np.linalg.norm(part - left, axis=1), np.linalg.norm(left, axis=1)], axis=1).astype(np.float32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at[s : s + 2048])), pa.array(np.full(len(part), x.shape[1], np.int32)), *(pa.array([r.tobytes() for r in y], pa.binary()) for y in (part.astype(kind), codes, norms))],
                        ["id", "dim", "x", "codes", "norms"],
                    )

    coded = rows.select("id", "vector").mapInArrow(lean(code), "id long, dim int, x binary, codes binary, norms binary")
    coded = coded.withColumn("c", F.pmod(F.xxhash64("id"), blocks[F.col("dim")]).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), asked[F.col("dim")] - 1)))
    queries = rows.where("asks").select("id", "dim", "vector", F.pmod(F.xxhash64("id"), asked[F.col("dim")]).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), blocks[F.col("dim")] - 1)).alias("c"))

    def search(block: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        keep_only()
        out = []
        if len(block) and len(asking):
            dim = int(block["dim"].iloc[0])
            as_matrix = lambda c, t: np.frombuffer(b"".join(block[c]), t).reshape(len(block), -1)
            asking = asking.sort_values("id")
            found = _search(np.stack(asking["vector"]).astype(np.float64), asking["id"].to_numpy(), block["id"].to_numpy(), as_matrix("x", kind), as_matrix("codes", np.uint8), as_matrix("norms", np.float32), shared.value[dim], k)
            out = [pd.DataFrame({"query_id": q, "vec_id": near, "score": scores}) for q, near, scores in found]
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    key = ["dim", "c", "q"]
    found = coded.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
