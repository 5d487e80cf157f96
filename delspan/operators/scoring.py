"""Scoring windows with a model, fitting one, and turning scores into calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD, PASS_ABOVE, MIN_QUALITY = 0.5, 0.7, 0.5


def softmax(logit0: Column, logit1: Column) -> tuple[Column, Column]:
    """(probability of class 1, predicted class); a tie is class 0."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(logit0 - logit1)), (logit1 > logit0).cast("int")


def score(rows: DataFrame, features: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``prob`` and ``pred`` from a supplied model, which ``load`` makes once in each worker: features of a batch to probabilities.

    A row for which the model fails, or without features, gets (0.0, 0).
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            out = np.full(len(batch), np.nan)
            good = np.array([x is not None for x in batch], bool)
            if good.any():
                try:
                    out[good] = model(np.stack(batch[good].to_list()))
                except Exception:  # a model may raise anything; one bad row must not take its batch along
                    for k in np.flatnonzero(good):
                        try:
                            out[k] = model(np.stack([batch.iloc[k]]))[0]
                        except Exception:  # noqa: S110
                            pass
            yield pd.Series(out)

    prob = F.nanvl(run(F.col(features)), F.lit(None).cast("double"))
    return with_prediction(rows.withColumn("prob", prob), threshold)


def with_prediction(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``prob`` without nulls, and ``pred``: strictly above the threshold."""
    rows = rows.withColumn("prob", F.coalesce("prob", F.lit(0.0)))
    return rows.withColumn("pred", (F.col("prob") > threshold).cast("int"))


def fit_classifier(train: DataFrame, features: list[str], weight: str = "weight") -> PipelineModel:
    """Logistic regression on window features with class weights."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), LogisticRegression(weightCol=weight, labelCol="label", maxIter=20, regParam=1e-3)]).fit(train)


def apply_classifier(rows: DataFrame, model: PipelineModel, threshold: float = THRESHOLD) -> DataFrame:
    out = model.transform(rows).withColumn("prob", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    return with_prediction(out, threshold)


def calls(rows: DataFrame, threshold: float = THRESHOLD, drop_zero_start: bool = True, pass_above: float = PASS_ABOVE) -> DataFrame:
    """``chrom, start, end, quality, filter_status`` of rows predicted positive; a missing or (by default) zero coordinate makes no call."""
    rows = with_prediction(rows, threshold).where((F.col("pred") == 1) & F.col("chrom").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull())
    if drop_zero_start:
        rows = rows.where((F.col("start") != 0) & (F.col("end") != 0))
    return rows.select("chrom", "start", "end", F.col("prob").alias("quality"), F.when(F.col("prob") > pass_above, "PASS").otherwise("LowQual").alias("filter_status"))
