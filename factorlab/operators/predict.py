"""Predictions of fitted models over new covariates, as joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.cells import to_cells
from . import criteria
from .algebra import matmul
from .fit import Fit


def coefficients(fit: Fit, a: DataFrame) -> DataFrame:
    """B = C A: cells (basis, sample). The Q x R coefficients are a small table; A stays where it is.

    Of a reduced-rank fit: B1 = C X2 Y2, for old or new Y2 (a).
    """
    if fit.family in ("rrr", "rrr_signed"):
        inner = list(range(1, fit.c.shape[1] + 1))
        a = matmul(to_cells(a.sparkSession, fit.extra["x2"], inner, fit.covariates), a)
        return matmul(to_cells(a.sparkSession, fit.c, list(range(1, fit.rank + 1)), inner), a)
    return matmul(to_cells(a.sparkSession, fit.c, list(range(1, fit.rank + 1)), fit.covariates), a)


def predict(fit: Fit, a: DataFrame, kind: str = "response") -> DataFrame:
    """response: cells of X C A; prob: of X times B's shares per sample; class: (col, label, value) of the likeliest row."""
    if kind not in ("response", "prob", "class"):
        raise ValueError("kind is response, prob or class")
    spark = a.sparkSession
    b = coefficients(fit, a)
    if fit.family in ("signed", "rrr_signed") and kind != "response":
        b = b.withColumn("value", F.greatest("value", F.lit(0.0)))
    if kind != "response":
        b = criteria.membership(b)
    out = matmul(to_cells(spark, fit.x, fit.rows, list(range(1, fit.rank + 1))), b)
    return criteria.hard_labels(out) if kind == "class" else out


def classes(fit: Fit, a: DataFrame, actual: DataFrame | None = None) -> DataFrame:
    """(col, label[, actual]): the row of the largest prediction of each sample (reduced-rank fits: of X1 C X2 Y2 itself, others:
    of the shares), and with the cells actual the row of its largest value (the first of ties; null where it has none)."""
    kind = "response" if fit.family in ("rrr", "rrr_signed") else "prob"
    out = criteria.hard_labels(predict(fit, a, kind)).select("col", "label")
    return out if actual is None else out.join(criteria.hard_labels(actual).select("col", F.col("label").alias("actual")), "col", "left")


def path_coefficients(spark: SparkSession, fit: Fit) -> DataFrame:
    """(type, basis, covariate, estimate) of a path model: every entry of C1 (from the endogenous rows) and C2 (exogenous)."""
    if fit.family != "ffb":
        raise ValueError("path coefficients are those of path models")
    parts = (("C1", fit.c, fit.rows), ("C2", fit.extra["c2"], fit.covariates))
    rows = [(kind, fit.bases[i], str(names[j]), float(v)) for kind, m, names in parts for (i, j), v in np.ndenumerate(m)]
    return spark.createDataFrame(rows, "type string, basis string, covariate string, estimate double")


def confusion(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """(actual, predicted, n) of (col, label) tables."""
    joined = actual.select("col", F.col("label").alias("actual")).join(predicted.select("col", F.col("label").alias("predicted")), "col")
    return joined.groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def accuracy(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))


def response(fit: Fit, a):
    """X B of a dense fit for new covariates a (arrays); of a reduced-rank fit for new Y2."""
    return fit.x @ fit.c @ fit.extra["x2"] @ a if fit.family in ("rrr", "rrr_signed") else fit.fitted(a)
