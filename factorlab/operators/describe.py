"""Graphs as DOT text, plot data and summaries of fits."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .criteria import membership
from .fit import Fit


def edges(cells: DataFrame, threshold: float = 0.0, table: DataFrame | None = None, level: float = 0.05) -> DataFrame:
    """(row, col, value) of the edges to draw: significant ones where a coefficient table knows them, else by size."""
    if table is None:
        return cells.where(F.abs("value") >= threshold)
    known = table.select(F.col("basis").alias("row"), F.col("covariate").alias("col"), F.col("p_value").alias("p"))
    return cells.join(known, ["row", "col"], "left").where(F.coalesce(F.col("p") < level, F.abs("value") >= threshold)).select("row", "col", "value", "p")


def linked_nodes(nodes: DataFrame, drawn: DataFrame) -> DataFrame:
    """Nodes (name) with an edge."""
    ends = drawn.select(F.col("row").alias("name")).union(drawn.select(F.col("col").alias("name")))
    return nodes.join(ends, "name", "left_semi")


def identifier(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.]", "_", name)


def stars(p: float | None) -> str:
    return "" if p is None else "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else ""


def _number(v: float, digits: int) -> str:
    return f"{v:.{digits}f}"


def dot(groups: dict[str, list[str]], links: list[tuple], *, digits: int = 2, scale: float = 5.0, rankdir: str = "LR") -> str:
    """A DOT digraph: a cluster of nodes per group, and links (from, to, value[, p]); negative ones dashed, width by size."""
    most = max((abs(link[2]) for link in links), default=1.0) or 1.0
    lines = ["digraph model {", f"  graph [rankdir={rankdir}, compound=true];", "  node [shape=box, fontname=Helvetica];"]
    for k, (title, names) in enumerate(groups.items()):
        lines += [f"  subgraph cluster_{k} {{", f'    label="{title}";', *(f'    {identifier(n)} [label="{n}"];' for n in names), "  }"]
    for source, target, value, *p in links:
        width = max(0.5, abs(value) * scale / most)
        dash = ", style=dashed" if value < 0 else ""
        lines.append(f'  {identifier(source)} -> {identifier(target)} [label="{_number(value, digits)}{stars(p[0] if p else None)}", penwidth={width:.2f}{dash}];')
    return "\n".join([*lines, "}"])


def _links(m: np.ndarray, sources: list[str], targets: list[str], threshold: float) -> list[tuple]:
    return [(s, t, float(m[i, j])) for i, t in enumerate(targets) for j, s in enumerate(sources) if abs(m[i, j]) >= threshold]


def fit_dot(fit: Fit, threshold: float = 0.01, kind: str = "YXA") -> str:
    """Graph of a fit: covariates -> bases -> rows (YXA), bases -> rows (YX) or covariates -> rows (YA); models of pairs,
    paths and networks have their own layout."""
    bases = list(fit.bases)
    rows, covariates = [str(r) for r in fit.rows], [str(r) for r in fit.covariates]
    if fit.family == "net":
        return dot({"Nodes": rows, "Communities": bases}, _links(fit.x, bases, rows, threshold) + [(bases[i], bases[j], float(fit.c[i, j])) for i in range(fit.rank) for j in range(i + 1, fit.rank) if abs(fit.c[i, j]) >= threshold])
    if fit.family in ("rrr", "rrr_signed"):
        factors = list(fit.factors)
        inputs = [f"in_{r}" for r in covariates]
        return dot({"Y2": inputs, "Encoder": factors, "Decoder": bases, "Y1": rows}, _links(fit.extra["x2"], inputs, factors, threshold) + _links(fit.c, factors, bases, threshold) + _links(fit.x, bases, rows, threshold))
    if fit.family == "ffb":
        return dot({"Exogenous": covariates, "Factors": bases, "Endogenous": rows}, _links(fit.extra["c2"], covariates, bases, threshold) + _links(fit.c, rows, bases, threshold) + _links(fit.x, bases, rows, threshold))
    if kind == "YX" or not covariates:
        return dot({"Factors": bases, "Y": rows}, _links(fit.x, bases, rows, threshold))
    if kind == "YA":
        return dot({"A": covariates, "Y": rows}, _links(fit.x @ fit.c, covariates, rows, threshold))
    return dot({"A": covariates, "Factors": bases, "Y": rows}, _links(fit.c, covariates, bases, threshold) + _links(fit.x, bases, rows, threshold))


def ar_dot(fit: Fit, threshold: float = 0.01) -> str:
    """Lagged variables (grouped by lag) -> bases -> variables."""
    bases, rows = list(fit.bases), [str(r) for r in fit.rows]
    groups: dict[str, list[str]] = {}
    for name in map(str, fit.covariates):
        m = re.search(r"_([0-9]+)$", name)
        groups.setdefault(f"Lag {m[1]}" if m else "Constant", []).append(name)
    return dot(groups | {"Factors": bases, "Y": rows}, _links(fit.c, list(map(str, fit.covariates)), bases, threshold) + _links(fit.x, bases, rows, threshold))


def heatmap(panels: dict[str, DataFrame]) -> DataFrame:
    """(panel, row, col, value) of several matrices."""
    out = None
    for name, cells in panels.items():
        part = cells.select(F.lit(name).alias("panel"), F.col("row").cast("string").alias("row"), F.col("col").cast("string").alias("col"), "value")
        out = part if out is None else out.unionByName(part)
    return out


def trace_table(spark: SparkSession, fit: Fit) -> DataFrame:
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(fit.trace)], "iteration int, objective double")


def summary(spark: SparkSession, fit: Fit) -> DataFrame:
    """One row: family, sizes, objective, iterations, convergence, sparsity of X and C, negative mass of C."""
    mass = float(np.abs(fit.c).sum())
    row = (fit.family, fit.x.shape[0], fit.rank, fit.c.shape[1], fit.objective, fit.iterations, fit.converged, float((fit.x < 1e-4).mean()), float((np.abs(fit.c) < 1e-4).mean()), float(-fit.c[fit.c < 0].sum()) / mass if mass else 0.0)
    return spark.createDataFrame([row], "family string, features int, rank int, columns int, objective double, iterations int, converged boolean, x_sparsity double, c_sparsity double, negative_mass double")


def relabel(fit: Fit, rows: dict | None = None, covariates: dict | None = None, bases: list[str] | None = None, factors: list[str] | None = None) -> Fit:
    """The fit with features and covariates renamed, and its bases and (of reduced-rank fits) factors named in their order; graphs
    and coefficient tables take the names from it."""
    from dataclasses import replace

    for names, n, what in ((bases, fit.rank, "bases"), (factors, fit.c.shape[1], "factors")):
        if names is not None and len(names) != n:
            raise ValueError(f"{n} {what} need as many names")
    named = {k: list(v) for k, v in (("bases", bases), ("factors", factors)) if v is not None}
    return replace(fit, rows=[(rows or {}).get(r, r) for r in fit.rows], covariates=[(covariates or {}).get(r, r) for r in fit.covariates], extra=fit.extra | named)


def relabel_coefficients(table: DataFrame, bases: dict[str, str] | None = None, covariates: dict[str, str] | None = None) -> DataFrame:
    """A coefficient table (basis, covariate, ..) with names exchanged; others stay."""
    for column, names in (("basis", bases), ("covariate", covariates)):
        if names:
            known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
            table = table.withColumn(column, F.coalesce(F.try_element_at(known, F.col(column)), F.col(column)))
    return table


def members(x: DataFrame, threshold: float = 0.0, eps: float = 1e-16) -> DataFrame:
    """(row, col, value) of a network's nodes and communities: shares of the rows of X of at least threshold. Nodes without one
    are hidden: they have no edge. Shares compare across kinds of networks, X's own scale doesn't."""
    return membership(x, "row", eps).where(F.col("value") >= threshold)


def ordered_coefficients(table: DataFrame, by: str, order: list[str]) -> DataFrame:
    """A coefficient table (basis, covariate, ..) with position (from 1): by "basis" or "covariate" in the given order, then
    by the other's name; names that aren't in order come last, by name."""
    if by not in ("basis", "covariate"):
        raise ValueError("by is basis or covariate")
    other = "covariate" if by == "basis" else "basis"
    known = F.array_position(F.array(*map(F.lit, order)), F.col(by).cast("string")) if order else F.lit(0)
    place = F.row_number().over(Window.orderBy(F.when(known > 0, known).otherwise(len(order) + 1), by, other))  # a model's coefficients: one task
    return table.withColumn("position", place.cast("bigint"))


def shown_coefficients(table: DataFrame, most: int = 20, level: float = 0.05) -> DataFrame:
    """Of an ordered table of up to `most` rows all, else the rows with p_value below level, at most the first `most`."""
    if table.limit(most + 1).count() <= most:
        return table
    return table.where(F.col("p_value") < level).orderBy("position").limit(most)
