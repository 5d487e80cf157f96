"""Operator 3: token counts by a two-tier lookup, without shuffling pre-tokens.

Tier one is a broadcast table of the token counts of frequent pre-tokens. It is built from a bounded sample of
documents (``SAMPLE_DOCS``) and holds at most ``TABLE_SIZE`` entries, so its size never follows the input. Tier
two is a cache in each worker for all other pre-tokens; what neither holds is encoded by the tokenizer library,
a batch of pre-tokens at a time. The table only saves work: every pre-token of every whole text is counted, and
the counts are the library's whatever the table holds.

Pre-tokens are the chunks of :mod:`sentencepiece_bpe`, across whose borders no piece reaches, so the count of a
text is the sum over its pre-tokens.

Defined results: a null text counts as empty (0 bytes, 0 tokens); rows are treated one by one, so repeated rows
give repeated results and an empty table an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, keep_only, lean
from .sentencepiece_bpe import SPACE, default_model, load

TABLE_SIZE = 1 << 16
SAMPLE_DOCS = 4_000
CACHE_SIZE = 500_000
LIMIT = 4096


class Counts:
    """Token counts of pre-tokens by the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunks = load(path).chunks
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def library_counts(self, chunks: list[str]) -> list[int]:
        """A line feed before the chunk is a piece of its own and keeps the library's leading space apart: two ids too many."""
        return [len(ids) - 2 for ids in self.library.encode(["\n" + c.replace(SPACE, " ") for c in chunks], num_threads=1)]

    def count(self, texts: list[str | None], table: dict[str, int]) -> list[int]:
        cut = [self.chunks(t or "") for t in texts]
        if len(self.young) >= CACHE_SIZE:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing: dict[str, None] = {}
        for chunks in cut:
            for c in chunks:
                if c not in table and c not in young:
                    n = old.get(c)
                    if n is None:
                        missing[c] = None
                    else:
                        young[c] = n
        new = [c for c in missing if c]
        known = dict(zip(new, self.library_counts(new), strict=True))
        young.update((c, n) for c, n in known.items() if len(c) <= 64)
        out = []
        for chunks in cut:
            total = 0
            for c in chunks:
                n = table.get(c)
                if n is None:
                    n = young.get(c)
                    if n is None:
                        n = known[c] if c else 0
                total += n
            out.append(total)
        return out


_loaded: dict[str, Counts] = {}
KEPT["counts"] = _loaded.clear


def counter(path: str) -> Counts:
    if path not in _loaded:
        _loaded[path] = Counts(path)
    return _loaded[path]


def frequent_table(df: DataFrame, text_col: str, path: str, size: int = TABLE_SIZE, sample_docs: int = SAMPLE_DOCS) -> dict[str, int]:
    """Token counts of the ``size`` pre-tokens most frequent in about ``sample_docs`` documents, picked by the text's hash."""
    every = max(1, df.count() // sample_docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = counter(path).chunks
        for batch in batches:
            seen = Counter(c for t in batch.column(0).to_pylist() for c in chunks(t) if len(c) <= 64)
            top = seen.most_common(size)
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["chunk", "n"])

    # a copied text counts once, so a hot group of copies neither fills the sample nor empties it
    picked = df.where(F.col(text_col).isNotNull() & (F.pmod(F.xxhash64(text_col), F.lit(every)) == 0)).select(F.col(text_col).alias("text")).dropDuplicates(["text"]).limit(4 * sample_docs)
    rows = picked.mapInArrow(lean(cut), "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(size).select("chunk").collect()
    frequent = [r.chunk for r in rows if r.chunk]
    return dict(zip(frequent, counter(path).library_counts(frequent), strict=True))


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row; over_limit: more than ``limit`` tokens."""
    path = model or default_model()
    table = df.sparkSession.sparkContext.broadcast(frequent_table(df, text_col, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("counts", "pieces")
        counts, frequent = counter(path), table.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counts.count(part.column(1).to_pylist(), frequent), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    key = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(lean(run), f"doc_id {key}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
