"""Labelled matrices as DataFrames of cells (row, col, value[, weight]), and their other shapes.

Rows are features (few: they index the model), columns are samples (many: they are rows of Spark tables). A NULL or NaN
value, or an absent cell of a masked matrix, is missing: weight 0 and value 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_long(df: DataFrame, row: str | Column, col: str | Column, value: str | Column, weight: str | Column | None = None) -> DataFrame:
    """Cells summed by (row, col); with a weight, missing values (NULL, NaN) get value 0 and weight 0."""
    name = lambda c, n: (F.col(c) if isinstance(c, str) else c).alias(n)
    cells = df.select(name(row, "row"), name(col, "col"), name(value, "value"), *([name(weight, "weight")] if weight is not None else []))
    number = F.col("value").cast("double")
    if weight is None:
        return cells.groupBy("row", "col").agg(F.sum(F.when(~F.isnan(number), number)).alias("value"))
    missing = number.isNull() | F.isnan(number)
    w = F.coalesce(F.nanvl(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    return cells.select("row", "col", F.when(missing | (w == 0), 0.0).otherwise(number).alias("value"), F.when(missing, 0.0).otherwise(w).alias("weight"))


def from_wide(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """Each column a feature (row), each table row a sample (col)."""
    columns = columns or [c for c in df.columns if c != key]
    return df.select(F.col(key).alias("col"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["col"], columns, "row", "value").select("row", "col", "value")


@dataclass(frozen=True)
class Formula:
    """Feature columns and covariate columns (empty: no covariates) that a formula names."""

    features: list[str]
    covariates: list[str]


def parse_formula(formula: str, columns: list[str]) -> Formula:
    """`Y1 + Y2 ~ A1 + A2`; `.` on one side takes the columns that the other doesn't; `~ 0` and `~ -1` mean no covariates."""
    if formula.count("~") != 1:
        raise ValueError("a formula has one ~")
    sides = [[x for x in re.split(r"[\s+]+", s.strip()) if x] for s in formula.split("~")]
    if sides[1] in (["0"], ["-1"]):
        sides[1] = []
    elif not sides[1]:
        raise ValueError("name covariates, or none with ~ 0")
    if "." in sides[0] and "." in sides[1]:
        raise ValueError("`.` can stand on one side only")
    for side, other in ((0, 1), (1, 0)):
        if "." in sides[side]:
            sides[side] = [c for c in columns if c not in sides[other]]
    unknown = [c for s in sides for c in s if c not in columns]
    if unknown:
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    if not sides[0]:
        raise ValueError("no feature is left")
    return Formula(*sides)


def from_formula(df: DataFrame, formula: str, key: str) -> tuple[DataFrame, DataFrame | None]:
    """(feature cells, covariate cells or None) of a table with one sample a row."""
    found = parse_formula(formula, [c for c in df.columns if c != key])
    return from_wide(df, key, found.features), from_wide(df, key, found.covariates) if found.covariates else None


def from_edges(df: DataFrame, src: str, dst: str, weight: str | None = None) -> DataFrame:
    """Symmetric adjacency cells: (Y + Y') / 2 of the summed edges."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    edges = df.select(F.col(src).alias("row"), F.col(dst).alias("col"), w.alias("value"))
    both = edges.union(edges.select(F.col("col").alias("row"), F.col("row").alias("col"), "value"))
    return both.groupBy("row", "col").agg((F.sum("value") / 2).alias("value"))


def from_series(df: DataFrame, time: str, step: str, variable: str | Column, value: str | Column = "*") -> DataFrame:
    """(t, var, value) on a regular grid of steps (`day`, `month`, ..): sums (or counts) per step, 0 where nothing fell."""
    var = F.col(variable) if isinstance(variable, str) else variable
    measure = F.count("*").cast("double") if value == "*" else F.sum(value).cast("double")
    seen = df.select(F.date_trunc(step, F.col(time)).alias("ts"), var.alias("var"), *([] if value == "*" else [value])).groupBy("ts", "var").agg(measure.alias("value"))
    ends = seen.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = ends.select(F.posexplode(F.sequence("a", "b", F.expr(f"INTERVAL 1 {step.upper()}"))).alias("t", "ts"))
    full = grid.crossJoin(seen.select("var").distinct())  # steps times variables: the size of the result
    return full.join(seen, ["ts", "var"], "left").select(F.col("t").cast("bigint").alias("t"), "var", F.coalesce("value", F.lit(0.0)).alias("value"))


def one_hot(df: DataFrame, key: str, label: str) -> DataFrame:
    """Cells of the label matrix: levels (sorted) by samples, 0 or 1."""
    keyed = df.select(F.col(key).alias("col"), F.col(label).cast("string").alias("label"))
    levels = keyed.where("label IS NOT NULL").agg(F.array_sort(F.collect_set("label")).alias("levels"))
    return keyed.crossJoin(F.broadcast(levels)).select("col", "label", F.explode("levels").alias("row")).select("row", "col", F.when(F.col("label") == F.col("row"), 1.0).otherwise(0.0).alias("value"))


def row_labels(cells: DataFrame) -> list:
    """The features in order; there are as many as the model has rows."""
    return [r[0] for r in cells.select("row").distinct().orderBy("row").collect()]


def rows_and_gaps(cells: DataFrame) -> tuple[list, bool]:
    """row_labels(), and whether any value is missing (NULL or NaN), in one pass."""
    missing = F.col("value").isNull() | F.isnan(F.col("value").cast("double"))
    found = cells.groupBy("row").agg(F.max(missing).alias("missing")).orderBy("row").collect()
    return [r["row"] for r in found], any(r["missing"] for r in found)


def samples(cells: DataFrame, rows: list | None = None, name: str = "y") -> DataFrame:
    """One row per sample: (col, name ARRAY<DOUBLE>) in the order of rows; absent cells are 0."""
    rows = row_labels(cells) if rows is None else rows
    known = F.map_from_entries(F.collect_list(F.struct("row", "value")))
    grouped = cells.where(F.col("row").isin(rows) if len(rows) <= 500 else F.lit(True)).groupBy("col").agg(known.alias("m"))
    return grouped.select("col", F.transform(F.array(*[F.lit(r) for r in rows]), lambda r: F.coalesce(F.try_element_at("m", r), F.lit(0.0))).alias(name))


def to_numpy(cells: DataFrame, absent: float = 0.0, value: str = "value", rows: list | None = None, cols: list | None = None, most: int = 20_000_000) -> tuple[np.ndarray, list, list]:
    """Dense (array, rows, cols) of a model-sized matrix; larger ones than `most` cells are refused."""
    table = cells.select("row", "col", value).limit(most + 1).toPandas()
    if len(table) > most:
        raise ValueError("too large for the driver: use a plan over samples")
    rows = sorted(table["row"].unique().tolist()) if rows is None else rows
    cols = sorted(table["col"].unique().tolist()) if cols is None else cols
    out = np.full((len(rows), len(cols)), float(absent))
    ri, ci = {r: i for i, r in enumerate(rows)}, {c: i for i, c in enumerate(cols)}
    out[[ri[r] for r in table["row"]], [ci[c] for c in table["col"]]] = table[value].to_numpy(float)
    return out, rows, cols


def to_cells(spark: SparkSession, array: np.ndarray, rows: list | None = None, cols: list | None = None) -> DataFrame:
    """Cells of a model-sized array; rows and cols default to 1..n."""
    array = np.atleast_2d(np.asarray(array, float))
    rows = list(range(1, array.shape[0] + 1)) if rows is None else rows
    cols = list(range(1, array.shape[1] + 1)) if cols is None else cols
    kind = lambda x: "bigint" if x and isinstance(x[0], (int, np.integer)) else "string"
    data = [(r, c, float(v)) for r, line in zip(rows, array, strict=True) for c, v in zip(cols, line, strict=True)]
    return spark.createDataFrame(data, f"row {kind(rows)}, col {kind(cols)}, value double")
