"""Reference sequence around windows, its embedding, and reduced context vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN, COMPONENTS, LEAST_BASES = 2500, 8, 10
#: Components in a block of sums of products, and rows that are left of each block when tasks have been added up once.
GRAM, MERGERS = 64, 32


def sequences(windows: DataFrame, contigs: DataFrame, span: int = SPAN, chunk: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``window_id, seq`` and the windows' columns ``keep``: ``span`` bases of the reference around each window's centre, clamped to the contig, upper case.

    Contigs are (chrom, chunk_start, seq) with chunks of equal size (see :func:`rechunk`), not much shorter than ``span``. Each chunk gets what follows it, as
    far as a window that begins in it can reach. A window then needs one row, found by (chrom, chunk); nothing is gathered by window, and
    no contig is put together whole. Contigs' lengths are broadcast, so that windows are dealt by (chrom, chunk) and never by chromosome alone.
    """
    if chunk is None:
        chunk = contigs.agg(F.max(F.length("seq"))).first()[0] or 1
    lengths = contigs.groupBy("chrom").agg(F.max(F.col("chunk_start") + F.length("seq")).alias("contig_length"))
    rows = windows.join(F.broadcast(lengths), "chrom").withColumn("centre", F.floor((F.col("start") + F.col("end")) / 2))
    rows = rows.withColumn("a", F.greatest(F.col("centre") - span // 2, F.lit(0))).withColumn("b", F.least(F.col("centre") + span // 2, "contig_length")).where("b > a")
    wanted = rows.select("window_id", *(F.col(c).alias(f"kept_{c}") for c in keep), "chrom", "a", (F.col("b") - F.col("a")).cast("int").alias("n"), F.floor(F.col("a") / chunk).alias("k"))
    own = F.floor(F.col("chunk_start") / chunk)
    parts = contigs.withColumn("k", F.explode(F.sequence(F.greatest(own - -(-span // chunk), F.lit(0)), own)))
    reach = F.least((F.col("k") + 1) * chunk + span - F.col("chunk_start"), F.length("seq")).cast("int")
    parts = parts.where(reach > 0).groupBy("chrom", "k").agg(F.array_sort(F.collect_list(F.struct("chunk_start", F.substr("seq", F.lit(1), reach).alias("seq")))).alias("p"))
    whole = parts.select("chrom", "k", F.col("p")[0]["chunk_start"].alias("first"), F.upper(F.array_join("p.seq", "")).cast("binary").alias("text"))  # bytes are found at their place
    seq = F.substr("text", (F.col("a") - F.col("first") + 1).cast("int"), "n").cast("string")
    return wanted.join(whole, ["chrom", "k"]).select("window_id", *(F.col(f"kept_{c}").alias(c) for c in keep), seq.alias("seq"))


def kmer_frequencies(k: int = 3) -> Callable[[str], np.ndarray]:
    """The embedder that ships: relative frequencies of the 4^k strings of A, C, G and T, in alphabetical order."""
    code = np.full(256, -1, np.int64)
    code[np.frombuffer(b"ACGT", np.uint8)] = range(4)

    def embed(seq: str) -> np.ndarray:
        letters = code[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
        n = max(0, len(letters) - k + 1)
        parts = [letters[i : i + n] for i in range(k)]
        number = sum(p * 4 ** (k - 1 - i) for i, p in enumerate(parts))
        known = np.all([p >= 0 for p in parts], axis=0)
        out = np.bincount(number[known], minlength=4**k).astype(np.float32)
        return out / max(out.sum(), 1)

    return embed


def embeddings(seqs: DataFrame, make: Callable[[], Callable[[str], np.ndarray]], size: int) -> DataFrame:
    """``seqs`` with ``context_raw``, each sequence's embedding, in place of ``seq``; ``make`` is called once in each worker. Short sequences give zeros.

    Equal sequences of a batch are embedded once; no sequence is dealt for that.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make()
        for batch in batches:
            found = {s: np.asarray(embed(s), np.float32) for s in batch.dropna().unique() if len(s) >= LEAST_BASES}
            none = np.zeros(size, np.float32)
            yield pd.Series([found.get(s, none) for s in batch])

    return seqs.select(*(c for c in seqs.columns if c != "seq"), run("seq").alias("context_raw"))


def fit_pca(train: DataFrame, k: int = COMPONENTS) -> PipelineModel:
    """Centring and PCA on ``context_raw`` of training rows."""
    rows = train.where(F.col("context_raw").isNotNull()).select(array_to_vector(F.col("context_raw").cast("array<double>")).alias("raw"))
    return Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False), PCA(k=k, inputCol="centred", outputCol="reduced")]).fit(rows)


def apply_pca(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds ``context``; each component's sign is such that its largest loading is positive."""
    loadings = model.stages[-1].pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])
    out = model.transform(rows.withColumn("raw", array_to_vector(F.col("context_raw").cast("array<double>"))))
    signed = F.zip_with(vector_to_array("reduced"), F.array(*map(F.lit, signs.tolist())), lambda x, s: (x * s).cast("float"))
    return out.withColumn("context", signed).drop("raw", "centred", "reduced")


def explained(model: PipelineModel) -> list[float]:
    return model.stages[-1].explainedVariance.toArray().tolist()


def _sums(rows: DataFrame, products: bool) -> DataFrame:
    """``i, n, total, products``: of each component the count and sum and, if asked for, its products with the components from the ``GRAM``-block of ``i`` on.

    Each task adds up its vectors (X'X of an Arrow batch at a time) and hands on one row for each block of ``GRAM`` components; blocks of many tasks are added in two
    steps, so no task holds more than some of them. All vectors have one length; null vectors are left out.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten(), np.float64).reshape(batch.num_rows, -1)
                n, total = n + len(x), total + x.sum(0)
                gram = gram + x.T @ x if products else gram
        if n:
            d = len(total)
            starts = list(range(0, d, GRAM))
            blocks = [gram[s : s + GRAM, s:].ravel() for s in starts] if products else [np.empty(0)] * len(starts)
            columns = [pa.array(starts), pa.array([n] * len(starts)), pa.array([d] * len(starts)), pa.array([total[s : s + GRAM] for s in starts], pa.list_(pa.float64())), pa.array(blocks, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["start", "n", "d", "total", "products"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                start, n, d = (batch.column(k)[row].as_py() for k in range(3))
                own = held.setdefault(start, [0, d, 0.0, 0.0])
                own[0] += n
                own[2] = own[2] + np.asarray(batch.column(3)[row].values)
                own[3] = own[3] + np.asarray(batch.column(4)[row].values)
        for start, (n, d, total, found) in sorted(held.items()):
            yield pa.RecordBatch.from_arrays([pa.array([start]), pa.array([n]), pa.array([d]), pa.array([total], pa.list_(pa.float64())), pa.array([found], pa.list_(pa.float64()))], ["start", "n", "d", "total", "products"])

    schema = "start long, n long, d long, total array<double>, products array<double>"
    parts = rows.where(F.col("context_raw").isNotNull()).select("context_raw").mapInArrow(add, schema).withColumn("part", F.spark_partition_id() % MERGERS)
    parts = parts.repartition("start", "part").drop("part").mapInArrow(merge, schema)
    return parts.repartition("start").mapInArrow(merge, schema)


def mean_vector(rows: DataFrame) -> DataFrame:
    """``i, mean`` of ``context_raw``."""
    each = _sums(rows, products=False).select("start", "n", F.posexplode("total").alias("k", "x"))
    return each.select((F.col("start") + F.col("k")).cast("int").alias("i"), (F.col("x") / F.col("n")).alias("mean"))


def covariance(rows: DataFrame) -> DataFrame:
    """``i, j, cov`` (population) of ``context_raw`` for i <= j, from blocks of sums of products."""
    sums = _sums(rows, products=True)
    means = sums.select(F.posexplode("total").alias("k", "x"), "start", "n").select((F.col("start") + F.col("k")).alias("i"), (F.col("x") / F.col("n")).alias("mean"))
    each = sums.select("start", "n", (F.col("d") - F.col("start")).alias("width"), F.posexplode("products").alias("k", "x"))
    each = each.select((F.col("start") + F.floor(F.col("k") / F.col("width"))).alias("i"), (F.col("start") + F.col("k") % F.col("width")).alias("j"), (F.col("x") / F.col("n")).alias("xy")).where("i <= j")
    each = each.join(means.withColumnRenamed("mean", "mi"), "i").join(means.select(F.col("i").alias("j"), F.col("mean").alias("mj")), "j")
    return each.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), (F.col("xy") - F.col("mi") * F.col("mj")).alias("cov"))


def rechunk(contigs: DataFrame, size: int = 4096) -> DataFrame:
    """Contig chunks joined into chunks that begin at multiples of ``size``; chunks may not span such a multiple."""
    parts = contigs.groupBy("chrom", F.floor(F.col("chunk_start") / size).alias("k")).agg(F.array_sort(F.collect_list(F.struct("chunk_start", "seq"))).alias("p"))
    return parts.select("chrom", F.col("p")[0]["chunk_start"].alias("chunk_start"), F.array_join(F.transform("p", lambda x: x["seq"]), "").alias("seq"))
