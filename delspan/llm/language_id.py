"""Operator 1: language identification with hyperdimensional profiles.

Every letter has a random vector of ones and minus ones. A trigram's vector binds (multiplies) its letters' vectors, the first
rolled by two places and the second by one; a text's profile bundles (adds) the vectors of its trigrams, each
weighed by the square root of its count, so that a line repeated many times doesn't speak for the whole text. A language's
prototype bundles the unit profiles of its training documents. A text gets the language whose prototype, taken from the mean of all prototypes,
has the greatest cosine with its own profile, taken from the same mean; the score is that cosine with the plain prototype.

Texts are lower-cased; runs of other characters than letters become one blank, with a blank at either end. Every letter of Unicode has a
vector of its own, drawn from its code point.

Training looks at text and label only, of a bounded sample: about ``TRAIN_DOCS`` different labelled texts outside the held-out
fold, as many of each label as far as it has them, and ``LEAST`` of each at least. Prediction looks at the text only, the whole of it.

:func:`keep_identified` rejects texts that don't resemble any language: those without letters, and those whose greatest centred cosine isn't
``CHANCE`` standard deviations above what a random vector has. If nothing was learned, it keeps all texts with letters.

Defined results: a null text, or one without letters, is ``und`` with score 0; so is every text if nothing was
learned. Ties go to the label that is first in code-point order. Rows are treated one by one, so repeated rows give repeated
results and an empty table an empty result; a null id counts as the empty string in the fold; other columns are not looked at.
More than ``LABELS`` labels are an error: their prototypes go to every worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import KEPT, give_back, keep_only, lean

DIMENSIONS, SEED, TRAIN_DOCS, LABELS, CHANCE = 1024, 5, 20_000, 8_000, 3.0
#: Different texts of each label that are learned from, as far as it has them, however many labels there are.
LEAST = 16
#: A worker holds the vectors of so many letters, and draws those of others anew.
HELD_LETTERS = 4_096
UNKNOWN = "und"


def letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


class Profiles:
    """Letter vectors, and the profiles of texts."""

    def __init__(self) -> None:
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.row: dict[int, int] = {}
        #: The letters' vectors, rolled by two places, by one, and as they are.
        self.letters = np.zeros((3, 64, DIMENSIONS), np.int8)

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        """Where the vectors of these (different) letters stand."""
        if len(self.row) + len(codes) > max(HELD_LETTERS, len(codes)):
            self.row = {}
        for c in codes.tolist():
            if c not in self.row:
                k = len(self.row)
                if k == self.letters.shape[1]:
                    self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)], axis=1)
                v = letter_vector(c)
                self.letters[:, k] = np.roll(v, 2), np.roll(v, 1), v
                self.row[c] = k
        return np.array([self.row[c] for c in codes.tolist()], np.int64)

    def profile(self, text: str | None) -> np.ndarray | None:
        """The bundle of a text's trigrams; None if it has no letter."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.concatenate(([0], np.where(self.is_letter[codes], codes, 0), [0])).astype(np.int64)
        codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]
        if len(codes) < 3:
            return None
        letters, codes = np.unique(codes, return_inverse=True)
        rows, n = self._rows(letters), len(letters)
        grams, counts = np.unique((codes[:-2] * n + codes[1:-1]) * n + codes[2:], return_counts=True)
        weights = np.sqrt(counts).astype(np.float32)
        a, b, c = self.letters
        out = np.zeros(DIMENSIONS, np.float32)
        for s in range(0, len(grams), 512):
            part = grams[s : s + 512]
            bound = a[rows[part // (n * n)]] * b[rows[part // n % n]] * c[rows[part % n]]
            out += weights[s : s + 512] @ bound.astype(np.float32)
        return out


_profiles: list[Profiles] = []
KEPT["profiles"] = _profiles.clear


def profiles() -> Profiles:
    keep_only("profiles")
    if not _profiles:
        _profiles.append(Profiles())
    return _profiles[0]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(df: DataFrame, text_col: str, label_col: str, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """(labels, unit prototypes) from the texts of ``df`` with the smallest hashes of each label, about ``train_docs`` different ones, and ``LEAST`` of each label.

    Different texts are counted and ranked by their hashes, not rows, so a text in many rows takes nobody's place.
    """
    rows = df.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    hashes = rows.select("label", "h").distinct()
    labels = hashes.groupBy("label").agg(F.count("*").alias("n"))
    found = labels.agg(F.count("*")).first()[0]
    if found > LABELS:
        raise ValueError(f"{label_col} has more than {LABELS} different labels")
    if not found:
        return [], np.zeros((0, DIMENSIONS))
    each = max(LEAST, train_docs // found)
    # tables by label have at most LABELS rows; of a label's hashes the lowest part, in which four times as many are expected; the smallest of these are ranked
    part = F.least(F.lit(1.0), 4 * each / F.col("n")) * float(1 << 64) - float(1 << 63)
    low = hashes.join(F.broadcast(labels), "label").where(F.col("h").cast("double") <= part)
    place = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    last = low.withColumn("place", place).where(F.col("place") <= each).groupBy("label").agg(F.max("h").alias("last"))
    sample = rows.join(F.broadcast(last), "label").where("h <= last").select("label", "text").dropDuplicates(["label", "text"])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = profiles()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                p = own.profile(text.as_py())
                if p is not None and p.any():
                    sums[label] = sums.get(label, 0) + p / np.linalg.norm(p).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([*sums]), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["label", "v"])

    parts = sample.mapInArrow(lean(bundle), "label string, v array<double>")
    found = parts.select("label", F.posexplode("v").alias("k", "x")).groupBy("label", "k").agg(F.sum("x").alias("x")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v")).orderBy("label").collect()
    labels = [r.label for r in found]
    vectors = np.array([[x for _, x in r.v] for r in found]).reshape(len(labels), DIMENSIONS)
    return labels, (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).round(9) if labels else vectors


def predictor(labels: list[str], plain: np.ndarray) -> Callable[[str | None], tuple[str, float, float]]:
    """text -> (label, score, greatest centred cosine)"""
    own = profiles()
    mean = plain.mean(axis=0) if len(labels) > 1 else np.zeros(DIMENSIONS)
    apart = plain - mean
    apart = apart / np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-12)

    def predict(text: str | None) -> tuple[str, float, float]:
        p = own.profile(text) if labels else None
        if p is None:
            return UNKNOWN, 0.0, 0.0
        unit = p.astype(np.float64) / max(np.linalg.norm(p), 1e-12)
        centred = unit - mean
        near = apart @ centred
        best = int(np.argmax(near))
        return labels[best], float(min(1.0, max(0.0, plain[best] @ unit))), float(near[best] / max(np.linalg.norm(centred), 1e-12))

    return predict


def _learned(df: DataFrame, id_col: str, text_col: str, label_col: str, train_docs: int) -> Broadcast:
    return df.sparkSession.sparkContext.broadcast(learn(df.where(~held_out(F.col(id_col))), text_col, label_col, train_docs))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row."""
    shared = _learned(df, id_col, text_col, label_col, train_docs)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = predictor(*shared.value)
        for batch in batches:
            found = [of(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = df.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(predict), f"doc_id {dict(df.dtypes)[id_col]}, held_out boolean, lang_pred string, score double")


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of ``df`` whose text resembles a language, as they are. Only the text goes to Python."""
    shared = _learned(df, id_col, text_col, label_col, train_docs)

    @F.pandas_udf("boolean")
    def resembles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        labels, plain = shared.value
        of, own = predictor(labels, plain), profiles()
        least = CHANCE / np.sqrt(DIMENSIONS)
        for texts in batches:
            yield pd.Series([of(t)[2] > least if labels else own.profile(t) is not None for t in texts], dtype=bool)
        give_back()

    return df.where(resembles.asNondeterministic()(F.col(text_col)))
