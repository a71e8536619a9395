"""Places in a global order without a task that holds all rows, or all rows of a group.

Rows are dealt out in ascending ranges and numbered within their range; what lies before a range is a sum over ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import freed, stored


def in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows in ranges of ascending order (nulls first), written down with _range and _row (a row's number in it, from 0).

    Equal rows are told apart by where they were read, so that no crowd of them fills one range. Ranges are drawn from a sample
    of the rows: what is costly to make should be written down before.
    """
    by = [F.col(c).asc_nulls_first() for c in (*order, "_read")]
    sorted_rows = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_read")
    place = F.col("_place")  # the range in the upper bits, the row's number in the lower 33
    placed = sorted_rows.withColumn("_place", F.monotonically_increasing_id())
    return stored(placed.withColumns({"_range": F.shiftright(place, 33), "_row": place.bitwiseAND((1 << 33) - 1)}).drop("_place"))


def group_facts(ranges: DataFrame, group: list[str]) -> DataFrame:
    """For each range and group in it: _first (row of it), _before (rows of the group in the ranges before), n (in all).

    The rows must lie in ranges of an order that begins with the group's columns; no columns: all rows are one group.
    """
    counts = ranges.groupBy("_range", *group).agg(F.count("*").alias("_rows"), F.min("_row").alias("_first"))
    within = Window.partitionBy(*group)  # as many rows as the group has ranges
    before = F.sum("_rows").over(within.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumns({"_before": F.coalesce(before, F.lit(0)), "n": F.sum("_rows").over(within)}).drop("_rows")


def numbered(ranges: DataFrame, facts: DataFrame, group: list[str]) -> DataFrame:
    """The rows of ranges with at (number in the group, from 0) and what facts has beside its own columns."""
    more = [c for c in facts.columns if c not in ("_range", "_first", "_before", *group)]
    facts = facts.withColumnsRenamed({"_range": "_in"} | {g: f"_of_{g}" for g in group})
    same: Column = reduce(lambda x, g: x & F.col(g).eqNullSafe(F.col(f"_of_{g}")), group, F.col("_range") == F.col("_in"))
    at = F.col("_before") + F.col("_row") - F.col("_first")
    return ranges.join(facts, same).withColumn("at", at).select(*[c for c in ranges.columns if c not in ("_range", "_row")], "at", *more)


def ranked(rows: DataFrame, order: list[str], group: list[str] = ()) -> DataFrame:
    """rows with at (from 0, by order, within the group) and n (rows of the group), written down."""
    group = list(group)
    ranges = in_ranges(rows, [*group, *order])
    out = stored(numbered(ranges, group_facts(ranges, group), group))
    freed(ranges)
    return out
