"""Scores of feature rows: injected models, linear scores, bands of cutoffs and decisions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite


class Classifier(Protocol):
    def predict_proba(self, rows: pd.DataFrame) -> np.ndarray: ...


class Regressor(Protocol):
    def predict(self, rows: pd.DataFrame) -> np.ndarray: ...


@dataclass(frozen=True)
class Linear:
    """A fixed linear regressor."""

    weights: Mapping[str, float]
    bias: float

    def predict(self, rows: pd.DataFrame) -> np.ndarray:
        return self.bias + sum(w * rows[name].to_numpy() for name, w in self.weights.items())


@dataclass(frozen=True)
class Logistic(Linear):
    """A fixed linear classifier."""

    def predict_proba(self, rows: pd.DataFrame) -> np.ndarray:
        one = 1 / (1 + np.exp(-self.predict(rows)))
        return np.stack([1 - one, one], axis=1)


def linear(weights: Mapping[str, float], bias: float, missing: float = 0.0) -> Column:
    """A logistic score of columns; null, NaN and infinite features count as `missing`."""
    total = F.lit(bias)
    for name, w in weights.items():
        x = F.col(name)
        total = total + w * F.coalesce(finite(x), F.lit(missing))
    return 1 / (1 + F.exp(-total))


def scored(df: DataFrame, features: list[str], model: Classifier | Regressor, missing: float | None = None) -> DataFrame:
    """Add `score` (null if the model fails on its batch) and `model_error`.

    Batches of rows go to the broadcast model as a pandas frame of the features, null ones as NaN or `missing`. A
    model with predict_proba gives the probability of its second class, another its prediction.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, model_error string")
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[features].astype(float)
        if missing is not None:
            rows = rows.replace([np.inf, -np.inf], np.nan).fillna(missing)
        try:
            classify = getattr(shared.value, "predict_proba", None)
            score = np.asarray(classify(rows))[:, 1] if classify else np.asarray(shared.value.predict(rows))
            return pd.DataFrame({"score": score.astype(float), "model_error": [None] * len(rows)})
        except Exception as e:  # the rows are decided as model errors, with the reason
            return pd.DataFrame({"score": [None] * len(rows), "model_error": [f"predict_failed:{type(e).__name__}"] * len(rows)}).astype({"score": float})

    out = df.withColumn("_out", run(F.struct(*[F.col(f).cast("double").alias(f) for f in features])))
    return out.withColumns({"score": F.nanvl("_out.score", F.lit(None).cast("double")), "model_error": F.col("_out.model_error")}).drop("_out")


def decision(score: Column, cutoff: float | Column, has_data: Column, failed: Column, flag: Column | None = None) -> Column:
    """SKIP_NO_DATA, SKIP_MODEL_ERROR, REJECT at the cutoff or by the flag, else PASS."""
    reject = score >= cutoff if flag is None else flag | (score >= cutoff)
    return F.when(~has_data, "SKIP_NO_DATA").when(failed, "SKIP_MODEL_ERROR").when(reject, "REJECT").otherwise("PASS")


def band(score: Column, cutoffs: Mapping[str, float], none: str = "none") -> Column:
    """The name of the highest cutoff that a score reaches."""
    out = F.lit(none)
    for name, cut in sorted(cutoffs.items(), key=lambda x: x[1]):
        out = F.when(score >= cut, name).otherwise(out)
    return F.when(score.isNotNull(), out)
