"""Exact order statistics of groups that are too large for one task.

Approximate quantiles of each group cut its values into cells of about equal size. Cells are sorted on their own; the sums of
the cells before give each value's place in its group. No task holds more than a cell, and cells are exact: values that are
equal never lie in two of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a group.
CELLS = 64


def _celled(df: DataFrame, by: Sequence[str], value: str, cells: int) -> DataFrame:
    """``df`` without null values, with ``_cell``."""
    known = df.filter(F.col(value).isNotNull())
    cuts = known.groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, [i / cells for i in range(1, cells)], 10 * cells)).alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    return known.join(cuts, list(by)).withColumn("_cell", below).drop("_cuts")


def cumulative(df: DataFrame, by: Sequence[str], value: str, counts: dict[str, Column], cells: int = CELLS) -> DataFrame:
    """(by..., value, and for each count c: c, c_own, c_total): its sum over all values up to this one, at this one, and over
    the group. A row for each distinct value."""
    each = _celled(df, by, value, cells).groupBy(*by, "_cell", value).agg(*(F.sum(e.cast("double")).alias(f"{c}_own") for c, e in counts.items()))
    run = Window.partitionBy(*by, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    each = each.select("*", *(F.sum(f"{c}_own").over(run).alias(c) for c in counts))
    tops = each.groupBy(*by, "_cell").agg(*(F.max(c).alias(c) for c in counts))  # a row for each cell
    group = Window.partitionBy(*by)
    before = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*by, "_cell", *(F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"{c}_before") for c in counts), *(F.sum(c).over(group).alias(f"{c}_total") for c in counts))
    out = each.join(tops, [*by, "_cell"])
    return out.select(*by, value, *((F.col(c) + F.col(f"{c}_before")).alias(c) for c in counts), *(f"{c}_{x}" for c in counts for x in ("own", "total")))


def quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float], cells: int = CELLS) -> DataFrame:
    """(by..., n, q: array of doubles): linearly interpolated quantiles."""
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probabilities)))
    places = cumulative(df, by, value, {"upto": F.lit(1)}, cells).withColumn("w", F.explode(wanted))
    at = F.col("w.p") * (F.col("upto_total") - 1)  # from 0; a value has the places upto - upto_own to upto - 1
    part = at - F.floor(at)

    def holds(place: Column) -> Column:
        return ((place < F.col("upto")) & (place >= F.col("upto") - F.col("upto_own"))).cast("double")

    share = holds(F.floor(at)) * (1 - part) + F.when(part > 0, holds(F.floor(at) + 1) * part).otherwise(0.0)
    sums = places.withColumn("share", share).filter("share > 0").groupBy(*by, F.col("w.i").alias("i")).agg(F.sum(F.col(value) * F.col("share")).alias("v"), F.max("upto_total").cast("long").alias("n"))
    return sums.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("q"))
