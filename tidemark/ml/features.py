"""Training tables: standardised factors of each date beside the forward return, as one row a name and date."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans import blocks, catalog


@dataclass(frozen=True)
class FeatureConfig:
    horizon: int = 5
    #: raw, or excess: less the mean of all names that date.
    label: str = "excess"
    winsor: tuple[float, float] = (0.01, 0.99)
    fill: float = 0.0
    #: Rows that factors need before they count; a panel that isn't longer keeps all.
    warm_up: int = blocks.WARM


def prediction_panel(spark: SparkSession, view: str, names: Sequence[str], config: FeatureConfig | None = None) -> DataFrame:
    """(date, ticker, t, <names>) of a dense panel's view: clipped to the date's quantiles, standardised, missing filled.

    Two windows over the date serve all factors, so the table is sorted by ticker once and by date once.
    """
    config = config or FeatureConfig()
    raw = catalog.evaluate(spark, f"SELECT * FROM ({blocks.factors(list(names))}) AS f WHERE t > {blocks.warm(config.warm_up)}", {"panel": view})
    day = Window.partitionBy("date")
    low, high = config.winsor
    bounds = {c: F.percentile(c, F.array(F.lit(low), F.lit(high))).over(day) for c in names}
    clipped = raw.select("date", "ticker", "t", *names, *(e.alias(f"_{c}") for c, e in bounds.items()))
    clipped = clipped.select("date", "ticker", "t", *(F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_{c}")[0]), F.col(f"_{c}")[1])).alias(c) for c in names))
    z = [F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(day), F.stddev_pop(c).over(day)), F.lit(config.fill)).alias(c) for c in names]
    return clipped.select("date", "ticker", "t", *z)


def labels(spark: SparkSession, view: str, config: FeatureConfig | None = None) -> DataFrame:
    """(date, ticker, raw, label), where the forward return is known."""
    config = config or FeatureConfig()
    label = "fwd - avg(fwd) OVER (PARTITION BY date)" if config.label == "excess" else "fwd"
    return catalog.evaluate(spark, f"SELECT date, ticker, fwd AS raw, {label} AS label FROM ({blocks.forward(config.horizon)}) AS f WHERE fwd IS NOT NULL", {"panel": view})


def training_panel(spark: SparkSession, view: str, names: Sequence[str], config: FeatureConfig | None = None) -> DataFrame:
    """(date, ticker, t, <names>, raw, label), rows with a label only."""
    return prediction_panel(spark, view, names, config).join(labels(spark, view, config), ["date", "ticker"])


def sequences(features: DataFrame, names: Sequence[str], lookback: int = 60) -> DataFrame:
    """(date, ticker, steps): each row's last ``lookback`` feature rows, oldest first, with zeros in front where there are fewer."""
    so_far = Window.partitionBy("ticker").orderBy("date").rowsBetween(1 - lookback, 0)
    row = F.array(*(F.col(c).cast("float") for c in names))
    none = F.array_repeat(F.lit(0.0).cast("float"), len(names))
    steps = F.collect_list("_row").over(so_far)
    padded = F.concat(F.array_repeat(none, F.lit(lookback) - F.size("_steps")), F.col("_steps"))
    return features.select("date", "ticker", row.alias("_row")).select("date", "ticker", steps.alias("_steps")).select("date", "ticker", padded.alias("steps"))


__all__ = ["FeatureConfig", "labels", "prediction_panel", "sequences", "training_panel"]
