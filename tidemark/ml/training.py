"""Purged walk-forward training: folds over dates, models, out-of-sample predictions and their ensembles."""

from __future__ import annotations

import importlib.util
import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans import blocks, catalog
from tidemark.storage import shared_root, stage


@dataclass(frozen=True)
class Fold:
    """Positions of dates: trained on the ranges ``train``, tested on [test[0], test[1])."""

    train: tuple[tuple[int, int], ...]
    test: tuple[int, int]
    n_purged: int = 0
    n_embargoed: int = 0

    def trained(self, t: Column) -> Column:
        out = F.lit(False)
        for a, z in self.train:
            out = out | ((t >= a) & (t < z))
        return out

    def tested(self, t: Column) -> Column:
        return (t >= self.test[0]) & (t < self.test[1])


@dataclass(frozen=True)
class PurgedWalkForwardCV:
    """Equal test blocks after the first ``min_train`` dates; ``purge`` dates before a block aren't trained on.

    ``walk_forward`` trains on the past alone; ``purged_kfold`` on everything but the block, the purge and an embargo behind.
    """

    n_splits: int = 6
    purge: int = 10
    embargo: int = 5
    min_train: int = 504
    mode: str = "walk_forward"
    #: Dates that each block must have.
    least: int = 40

    def __post_init__(self):
        if self.n_splits < 2:
            raise ValueError("at least two splits are needed")
        if self.mode not in ("walk_forward", "purged_kfold"):
            raise ValueError(f"unknown mode {self.mode}")

    def split(self, n: int) -> list[Fold]:
        """Folds over n dates; ValueError if there are too few."""
        rest = n - self.min_train
        if rest < self.n_splits * self.least:
            raise ValueError(f"{n} dates are too few for {self.n_splits} splits after {self.min_train}")
        size, out = rest // self.n_splits, []
        for k in range(self.n_splits):
            a = self.min_train + k * size
            z = a + size if k + 1 < self.n_splits else n
            before = max(a - self.purge, 0)
            after = min(z + self.embargo, n) if self.mode == "purged_kfold" else n
            train = ((0, before), (after, n)) if after < n else ((0, before),)
            out.append(Fold(train, (a, z), a - before, after - z if self.mode == "purged_kfold" else 0))
        return out


class AlphaModel(Protocol):
    """fit() on rows with the features and ``label``, ``valid`` marking the chronological tail; predict() adds ``prediction``."""

    name: str

    def fit(self, rows: DataFrame, features: Sequence[str]) -> AlphaModel: ...

    def predict(self, rows: DataFrame) -> DataFrame: ...

    def importance(self) -> dict[str, float] | None: ...


def _vectors(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows)


class _Fitted:
    """What the library's models share."""

    model = None
    features: list[str] = []

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.model.setPredictionCol("prediction").transform(_vectors(rows, self.features)).drop("_x")


class RidgeAlphaModel(_Fitted):
    """Least squares with a penalty of alpha on the coefficients, none on the intercept; importance: shares of their sizes."""

    def __init__(self, alpha: float = 10.0, name: str = "ridge"):
        self.alpha, self.name = alpha, name

    def fit(self, rows: DataFrame, features: Sequence[str]) -> RidgeAlphaModel:
        out = RidgeAlphaModel(self.alpha, self.name)
        out.features = list(features)
        rows = rows.filter("not valid")
        s = rows.agg(F.count("label").alias("n"), F.stddev_pop("label").alias("sd")).first()
        # The library divides by n and by the label's deviation.
        reg = self.alpha / max(1, s.n) * (s.sd or 1.0)
        out.model = LinearRegression(featuresCol="_x", labelCol="label", regParam=reg, elasticNetParam=0.0, standardization=False, solver="normal").fit(_vectors(rows, features))
        return out

    def importance(self) -> dict[str, float]:
        size = [abs(float(c)) for c in self.model.coefficients]
        return {f: s / (sum(size) or 1.0) for f, s in zip(self.features, size, strict=True)}


class BoostedTreesAlphaModel(_Fitted):
    """Gradient-boosted regression trees, stopped early on the validation tail."""

    def __init__(self, rounds: int = 50, depth: int = 4, rate: float = 0.05, least: int = 100, share: float = 0.8, seed: int = 42, name: str = "boosted_trees"):
        self.options = {"maxIter": rounds, "maxDepth": depth, "stepSize": rate, "minInstancesPerNode": least, "subsamplingRate": share, "featureSubsetStrategy": str(share), "seed": seed}
        self.name = name

    def fit(self, rows: DataFrame, features: Sequence[str]) -> BoostedTreesAlphaModel:
        out = BoostedTreesAlphaModel(name=self.name)
        out.options, out.features = self.options, list(features)
        trees = GBTRegressor(featuresCol="_x", labelCol="label", validationIndicatorCol="valid", validationTol=0.0, **self.options)
        out.model = trees.fit(_vectors(rows, features))
        return out

    def importance(self) -> dict[str, float]:
        return {f: float(v) for f, v in zip(self.features, self.model.featureImportances.toArray(), strict=True)}


def sequence_model_available() -> bool:
    return importlib.util.find_spec("torch") is not None


class SequenceAlphaModel:
    """A recurrent network over features.sequences(); needs torch, which is optional."""

    def __init__(self, lookback: int = 60, name: str = "sequence"):
        if not sequence_model_available():
            raise ImportError("sequence models need torch, which isn't installed; the other models don't")
        self.lookback, self.name = lookback, name


def ranked(predictions: DataFrame, models: Sequence[str]) -> DataFrame:
    """Each model's percentile rank within the date, over its own predictions."""
    day = Window.partitionBy("date")
    out = predictions
    for m in models:
        part = Window.partitionBy("date", F.col(m).isNull()).orderBy(m)
        ties = Window.partitionBy("date", m)
        rank = (F.rank().over(part) + (F.count(F.lit(1)).over(ties) - 1) / 2) / F.count(m).over(day)
        out = out.withColumn(f"_{m}", F.when(F.col(m).isNotNull(), rank))
    return out


def rank_ensemble(predictions: DataFrame, models: Sequence[str], out: str = "ensemble") -> DataFrame:
    """The mean of the models' ranks, over those that predict."""
    rows = ranked(predictions, models)
    total = sum((F.coalesce(f"_{m}", F.lit(0.0)) for m in models[1:]), F.coalesce(f"_{models[0]}", F.lit(0.0)))
    known = sum((F.col(m).isNotNull().cast("int") for m in models[1:]), F.col(models[0]).isNotNull().cast("int"))
    return rows.withColumn(out, F.try_divide(total, known)).drop(*(f"_{m}" for m in models))


def causal_ensemble(predictions: DataFrame, models: Sequence[str], out: str = "ensemble_causal") -> DataFrame:
    """Ranks weighted by each model's mean rank IC over earlier folds, none below zero; equal in the first fold and where no
    model has a positive one. ``predictions``: (date, ticker, fold, label, <models>). ValueError for fewer than two models."""
    models = list(models)
    if len(models) < 2:
        raise ValueError("a causal ensemble needs two models or more")
    both = ranked(ranked(predictions, models), ["label"]) if "label" not in models else ranked(predictions, models)
    pearson = [F.when(F.count(m) > 2, F.try_divide(F.covar_pop(f"_{m}", "_label"), F.stddev_pop(F.when(F.col("_label").isNotNull(), F.col(f"_{m}"))) * F.stddev_pop(F.when(F.col(f"_{m}").isNotNull(), F.col("_label"))))).alias(m) for m in models]
    by_date = both.groupBy("fold", "date").agg(*pearson)
    sums = by_date.groupBy("fold").agg(*(e for m in models for e in (F.sum(m).alias(f"s_{m}"), F.count(m).alias(f"n_{m}"))))  # a row a fold
    before = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    weights = sums.select("fold", *(F.try_divide(F.sum(f"s_{m}").over(before), F.sum(f"n_{m}").over(before)).alias(f"ic_{m}") for m in models))
    positive = {m: F.greatest(F.col(f"ic_{m}"), F.lit(0.0)) for m in models}
    total = sum((positive[m] for m in models[1:]), positive[models[0]])
    usable = F.coalesce(total > 0, F.lit(False))
    for m in models:
        usable = usable & F.col(f"ic_{m}").isNotNull()
    weights = weights.select("fold", *(F.when(usable, F.try_divide(positive[m], total)).otherwise(1 / len(models)).alias(f"w_{m}") for m in models))
    rows = ranked(predictions, models).join(F.broadcast(weights), "fold")
    blend = sum((F.coalesce(f"_{m}", F.lit(0.0)) * F.col(f"w_{m}") for m in models[1:]), F.coalesce(f"_{models[0]}", F.lit(0.0)) * F.col(f"w_{models[0]}"))
    return rows.withColumn(out, blend).drop(*(f"_{m}" for m in models), *(f"w_{m}" for m in models))


@dataclass
class TrainingResult:
    """predictions (date, ticker, fold, label, <models>, ensembles), importances and what it was made with."""

    predictions: DataFrame
    models: list[str]
    importances: dict[str, dict[str, float]] = field(default_factory=dict)
    config: dict = field(default_factory=dict)

    def ic_by_date(self) -> DataFrame:
        """(date, factor, t, n, ic): rank IC of every model against the label."""
        spark = self.predictions.sparkSession
        names = self.predictions.agg(F.count_distinct("ticker")).first()[0]
        least = max(3, min(10, names // 2 + 1))
        view = f"predictions_{id(self)}"
        self.predictions.withColumn("t", F.datediff("date", F.lit("1970-01-01"))).createOrReplaceTempView(view)
        values = f"SELECT ticker, date, t, factor, value FROM (SELECT ticker, date, t, {', '.join(self.models)} FROM {view}) AS w UNPIVOT (value FOR factor IN ({', '.join(self.models)}))"
        return catalog.evaluate(spark, blocks.rank_ic(values, f"SELECT ticker, date, label AS fwd FROM {view}", least, "date, factor"), {})

    def ic_summary(self) -> DataFrame:
        """(model, ic_mean, ic_std, ic_ir, ic_tstat, positive_rate, n_days), best absolute ratio first."""
        ic = stage(self.ic_by_date(), "ic-by-date")
        view = f"ic_{id(self)}"
        ic.filter("ic is not null").createOrReplaceTempView(view)
        dates = ic.select("date").distinct().count()
        newey = blocks.newey_west(f"SELECT * FROM {view}", "ic", "factor", blocks.newey_west_lags(dates))
        text = f"""SELECT s.factor AS model, s.m AS ic_mean, s.sd AS ic_std, s.m / nullif(s.sd, 0) AS ic_ir, w.tstat AS ic_tstat, s.up AS positive_rate, s.n AS n_days
          FROM (SELECT factor, avg(ic) AS m, stddev_samp(ic) AS sd, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS up, count(*) AS n FROM {view} GROUP BY factor) AS s
          JOIN ({newey}) AS w ON s.factor = w.factor ORDER BY abs(s.m / nullif(s.sd, 0)) DESC"""
        return catalog.evaluate(ic.sparkSession, text, {})

    def signal(self, model: str) -> DataFrame:
        """(date, ticker, value): a model's predictions, clipped to the date's 1 and 99 % quantiles and standardised."""
        day = Window.partitionBy("date")
        rows = self.predictions.select("date", "ticker", F.col(model).alias("value")).filter("value is not null")
        rows = rows.withColumn("q", F.percentile("value", F.array(F.lit(0.01), F.lit(0.99))).over(day)).withColumn("value", F.least(F.greatest("value", F.col("q")[0]), F.col("q")[1])).drop("q")
        return rows.select("date", "ticker", F.try_divide(F.col("value") - F.avg("value").over(day), F.stddev_pop("value").over(day)).alias("value"))

    def save(self, folder: str) -> None:
        spark = self.predictions.sparkSession
        self.predictions.write.mode("overwrite").parquet(f"{folder}/oos_predictions")
        self.ic_by_date().write.mode("overwrite").option("header", True).csv(f"{folder}/ic_by_date")
        self.ic_summary().coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/ic_summary")
        rows = [(m, f, v) for m, of in self.importances.items() for f, v in of.items()]
        spark.createDataFrame(rows, "model string, feature string, importance double").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/importances")
        spark.createDataFrame([(json.dumps(self.config),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/run_config")


class TrainingPipeline:
    """Fits every model on every fold. Each fold's predictions are written before the next one starts, so that a run that is
    broken off goes on where it stopped when it is given the same ``folder``."""

    def __init__(self, models: Sequence[AlphaModel], cv: PurgedWalkForwardCV | None = None, folder: str | None = None, valid_share: float = 0.15, valid_least: int = 20):
        self.models, self.cv, self.folder = list(models), cv or PurgedWalkForwardCV(), folder
        self.valid_share, self.valid_least = valid_share, valid_least

    def run(self, panel: DataFrame, features: Sequence[str]) -> TrainingResult:
        """``panel``: (date, ticker, <features>, label)."""
        spark = panel.sparkSession
        dates = panel.select("date").distinct().withColumn("_t", F.row_number().over(Window.orderBy("date")) - 1)  # dates only
        rows = stage(panel.join(F.broadcast(dates), "date"), "training-panel")
        n = rows.agg(F.max("_t")).first()[0]
        folds = self.cv.split(0 if n is None else n + 1)
        folder = self.folder or f"{shared_root(spark)}/training-{id(self)}"
        importances: dict[str, list[dict[str, float]]] = {m.name: [] for m in self.models}
        parts = []
        for k, fold in enumerate(folds):
            path = f"{folder}/fold={k}"
            if not self._done(spark, path):
                days = sum(z - a for a, z in fold.train)
                tail = max(int(days * self.valid_share), self.valid_least)
                last = fold.train[-1][1] if fold.train[-1][1] > fold.train[-1][0] else fold.train[0][1]
                train = rows.filter(fold.trained(F.col("_t"))).withColumn("valid", F.col("_t") >= last - tail)
                out = rows.filter(fold.tested(F.col("_t"))).withColumn("fold", F.lit(k))
                for m in self.models:
                    fitted = m.fit(train, features)
                    out = fitted.predict(out).withColumnRenamed("prediction", m.name)
                    importances[m.name].append(fitted.importance() or {})
                out.select("date", "ticker", "fold", "label", *(m.name for m in self.models)).write.mode("overwrite").parquet(path)
            parts.append(spark.read.parquet(path))
        predictions = parts[0]
        for p in parts[1:]:
            predictions = predictions.unionByName(p)
        names = [m.name for m in self.models]
        if len(names) > 1:
            predictions = stage(rank_ensemble(causal_ensemble(predictions, names), names), "predictions")
        shown = [*names, *(["ensemble", "ensemble_causal"] if len(names) > 1 else [])]
        mean = {m: {f: sum(i.get(f, 0.0) for i in of) / len(of) for f in features} for m, of in importances.items() if of}
        config = {"n_splits": self.cv.n_splits, "mode": self.cv.mode, "purge": self.cv.purge, "embargo": self.cv.embargo, "models": names, "folds": [list(f.test) for f in folds]}
        return TrainingResult(predictions, shown, mean, config)

    @staticmethod
    def _done(spark, path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


FEATURES = ("mom_21", "rev_5", "vol_21", "bb_pos", "sma_ratio_50", "atr_21")


def _trained(spark, sf_dir: str, models: Sequence[AlphaModel]) -> TrainingResult:
    from tidemark.ml import features

    panel = features.training_panel(spark, catalog.panel_view(spark, sf_dir, "brand_week"), FEATURES, features.FeatureConfig(warm_up=50))
    return TrainingPipeline(models, PurgedWalkForwardCV(n_splits=3, min_train=150)).run(panel, FEATURES)


def ridge_query(spark, sf_dir: str) -> DataFrame:
    """Out-of-sample ridge predictions."""
    got = _trained(spark, sf_dir, [RidgeAlphaModel()]).predictions
    return got.select("date", "ticker", "fold", F.round("ridge", 7).alias("ridge"))


def ensemble_query(spark, sf_dir: str) -> DataFrame:
    """Information coefficients of two models and of their ensembles."""
    got = _trained(spark, sf_dir, [RidgeAlphaModel(), BoostedTreesAlphaModel(rounds=10, depth=3)])
    return got.ic_summary()


QUERIES = {"ml_ridge_oos": ridge_query, "ml_training": ensemble_query}
