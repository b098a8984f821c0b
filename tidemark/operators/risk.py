"""Five-style risk model: returns of the styles by weighted least squares of each date, and specific risk.

A date's regression needs only its weighted cross-moments, which are partial aggregates; what is solved in Python is one
small system a date.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import stage

STYLES = ("beta", "size", "momentum", "reversal", "volatility")
NAMES = ("market", *STYLES)


def _x(name: str):
    return F.lit(1.0) if name == "market" else F.col(f"z_{name}")


def factor_returns(rows: DataFrame, least: int = 30) -> DataFrame:
    """(date, n, market, five styles) from (date, ret, w, z_<style>); a row with a missing value takes no part.

    Dates with fewer than ``least`` rows or a singular system have NULL returns.
    """
    valid = F.col("w") > 0
    for c in ("ret", *(f"z_{s}" for s in STYLES)):
        valid &= F.col(c).isNotNull() & ~F.isnan(c)
    k = len(NAMES)
    square = {f"a_{i}_{j}": F.col("w") * _x(NAMES[i]) * _x(NAMES[j]) for i in range(k) for j in range(i, k)}
    right = {f"b_{i}": F.col("w") * _x(s) * F.col("ret") for i, s in enumerate(NAMES)}
    moments = rows.groupBy("date").agg(F.count_if(valid).alias("n"), *(F.sum(F.when(valid, e)).alias(c) for c, e in (square | right).items()))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = [(i, j) for i in range(k) for j in range(i, k)]
        for part in batches:
            out = np.full((len(part), k), np.nan)
            some = np.nonzero(part["n"].to_numpy() >= least)[0]
            a = np.empty((len(some), k, k))
            for i, j in upper:
                a[:, i, j] = a[:, j, i] = part[f"a_{i}_{j}"].to_numpy(float)[some]
            right = part[[f"b_{i}" for i in range(k)]].to_numpy(float)[some]
            full = np.linalg.matrix_rank(a) == k if len(some) else np.zeros(0, bool)
            out[some[full]] = np.linalg.solve(a[full], right[full][:, :, None])[:, :, 0]
            got = pd.DataFrame({"date": part["date"], "n": part["n"]})
            for i, name in enumerate(NAMES):
                got[name] = pd.Series(out[:, i]).astype(object).where(~np.isnan(out[:, i]), None)
            yield got

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors needn't have this package
    return moments.mapInPandas(solve, "date date, n long, " + ", ".join(f"{s} double" for s in NAMES))


def specific_risk(rows: DataFrame, returns: DataFrame, halflife: float = 63, least: int = 21) -> DataFrame:
    """(ticker, date, risk): annualised deviation of what the styles leave of a return, exponentially weighted by grid rows.

    NULL before ``least`` residuals. Weights grow with t and their scale cancels; doubles hold 60,000 rows at halflife 63.
    """
    f = returns.select("date", *(F.col(s).alias(f"f_{s}") for s in NAMES))
    fitted = sum((_x(s) * F.col(f"f_{s}") for s in STYLES), F.col("f_market"))
    left = rows.join(f, "date", "left").select("ticker", "date", "t", (F.col("ret") - fitted).alias("e"))
    so_far = Window.partitionBy("ticker").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    w = F.when(F.col("e").isNotNull(), F.pow(F.lit(2.0), F.col("t") / halflife))
    sums = {"n": F.count("e"), "s0": F.sum(w), "s1": F.sum(w * F.col("e")), "s2": F.sum(w * F.col("e") * F.col("e")), "q": F.sum(w * w)}
    s = left.select("ticker", "date", "t", *(v.over(so_far).alias(c) for c, v in sums.items()))
    mean = F.try_divide("s1", "s0")
    variance = (F.try_divide("s2", "s0") - mean * mean) * F.try_divide(F.col("s0") * F.col("s0"), F.col("s0") * F.col("s0") - F.col("q"))
    risk = F.when(F.col("n") >= least, F.sqrt(F.greatest(F.lit(0.0), variance) * 252))
    return s.select("ticker", "date", risk.alias("risk"))


def factor_covariance(returns: DataFrame, dates: DataFrame, window: int = 504) -> DataFrame:
    """(date, cov: array of k x k doubles) for each row (date) of ``dates``: Ledoit-Wolf over the last ``window`` complete
    rows through it; no row for fewer than two. ``returns`` has a row a date, so a group is ``window`` rows."""
    from tidemark.operators.optimize import ledoit_wolf

    whole = returns.dropna(subset=list(NAMES)).select("date", *NAMES)
    numbered = whole.withColumn("no", F.row_number().over(Window.orderBy("date")))  # dates only
    upto = numbered.join(F.broadcast(dates.select(F.col("date").alias("on"))), F.col("date") <= F.col("on")).groupBy("on").agg(F.max("no").alias("last"))
    rows = numbered.join(F.broadcast(upto), (F.col("no") <= F.col("last")) & (F.col("no") > F.col("last") - window)).select("on", *NAMES)

    def shrink(part: pd.DataFrame) -> pd.DataFrame:
        x = part[list(NAMES)].to_numpy(float)
        out = [ledoit_wolf(x).ravel()] if len(x) > 1 else []
        return pd.DataFrame({"date": [part["on"].iloc[0]] * len(out), "cov": out})

    _by_value()
    return rows.groupBy("on").applyInPandas(shrink, "date date, cov array<double>")


def _by_value() -> None:
    """Executors needn't have this package."""
    from tidemark.operators import optimize

    for module in (sys.modules[__name__], optimize):
        cloudpickle.register_pickle_by_value(module)


def decompose(weights: DataFrame, exposures: DataFrame, covariances: DataFrame, specific: DataFrame) -> DataFrame:
    """(date, total_variance, factor_variance, specific_variance, ann_vol, <style contributions>) of books (date, ticker, weight).

    Names without a weight or a whole row of exposures take no part; a missing specific risk counts as 0. The
    contributions v * Cv of the book's exposures v sum to the factor variance.
    """
    k = len(NAMES)
    whole = exposures.dropna(subset=[f"z_{s}" for s in STYLES])
    held = weights.filter("weight <> 0").join(whole, ["date", "ticker"]).join(specific, ["date", "ticker"], "left")
    v = [F.sum(F.col("weight") * _x(s)).alias(f"v_{i}") for i, s in enumerate(NAMES)]
    risk = F.coalesce("risk", F.lit(0.0))
    sums = held.groupBy("date").agg(*v, F.sum(F.col("weight") * F.col("weight") * risk * risk).alias("specific_variance")).join(covariances, "date")
    parts = []
    for i, s in enumerate(NAMES):
        row = sum((F.col("cov")[i * k + j] * 252 * F.col(f"v_{j}") for j in range(1, k)), F.col("cov")[i * k] * 252 * F.col("v_0"))
        parts.append((F.col(f"v_{i}") * row).alias(s))
    out = sums.select("date", "specific_variance", *parts)
    out = out.withColumn("factor_variance", sum((F.col(s) for s in NAMES[1:]), F.col(NAMES[0])))
    out = out.withColumn("total_variance", F.col("factor_variance") + F.col("specific_variance"))
    return out.select("date", "total_variance", "factor_variance", "specific_variance", F.sqrt("total_variance").alias("ann_vol"), *NAMES)


def summary(returns: DataFrame) -> DataFrame:
    """(factor, n_days, ann_vol, ann_return, sharpe, <correlations>) over complete rows of factor returns."""
    whole = returns.dropna(subset=list(NAMES))
    one = whole.agg(
        F.count(F.lit(1)).alias("n_days"),
        *(f(s).alias(f"{n}_{s}") for s in NAMES for n, f in (("m", F.avg), ("sd", F.stddev_samp), ("sp", F.stddev_pop))),
        *(F.covar_pop(a, b).alias(f"c_{a}_{b}") for a in NAMES for b in NAMES),
    )
    rows = []
    for a in NAMES:
        vol = F.col(f"sd_{a}") * F.sqrt(F.lit(252.0))
        corr = [F.try_divide(F.col(f"c_{a}_{b}"), F.col(f"sp_{a}") * F.col(f"sp_{b}")).alias(b) for b in NAMES]
        rows.append(F.struct(F.lit(a).alias("factor"), F.col("n_days"), vol.alias("ann_vol"), (F.col(f"m_{a}") * 252).alias("ann_return"), F.try_divide(F.col(f"m_{a}") * 252, vol).alias("sharpe"), *corr))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@dataclass(frozen=True)
class Attribution:
    alpha_ann: float
    betas: dict[str, float]
    r2: float
    factor_pnl: dict[str, float]
    residual_pnl: float
    n_days: int


def attribute_returns(returns: DataFrame, factors: DataFrame, names: list[str] | None = None) -> Attribution:
    """Time-series regression of (date, ret) on the columns ``names`` of (date, ...); ValueError for fewer than K + 5 dates.

    All that leaves the executors is the matrix of cross-moments.
    """
    names = names or [c for c in factors.columns if c != "date"]
    rows = returns.select("date", "ret").join(factors.select("date", *names), "date").dropna()
    columns = ["one", *names]
    rows = rows.withColumn("one", F.lit(1.0))
    k = len(columns)
    got = rows.agg(
        *(F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"a_{i}_{j}") for i in range(k) for j in range(i, k)),
        *(F.sum(F.col(c) * F.col("ret")).alias(f"b_{i}") for i, c in enumerate(columns)), F.sum(F.col("ret") * F.col("ret")).alias("yy"), F.count(F.lit(1)).alias("n"),
    ).first()
    n = got["n"]
    if n < len(names) + 5:
        raise ValueError(f"attribution to {len(names)} factors needs {len(names) + 5} dates or more, not {n}")
    a = np.array([[got[f"a_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    b = np.array([got[f"b_{i}"] for i in range(k)])
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    left = got["yy"] - 2 * beta @ b + beta @ a @ beta
    spread = got["yy"] - b[0] ** 2 / n
    pnl = {c: float(beta[i] * a[0, i]) for i, c in enumerate(names, 1)}
    total = float(b[0])
    return Attribution(float(beta[0] * 252), {c: float(beta[i]) for i, c in enumerate(names, 1)}, float(1 - left / spread) if spread > 0 else 0.0, pnl, total - sum(pnl.values()) - float(beta[0]) * n, int(n))


def weighted_rows(spark, sf_dir: str, kind: str = "supp_week") -> DataFrame:
    """Standardised exposures with returns and regression weights, the roots of 21-row mean dollar volumes."""
    from tidemark.functions.dialect import SPARK
    from tidemark.plans import catalog

    rows = catalog.evaluate(spark, f"SELECT ticker, date, t, ret, sqrt(adv) AS w, {', '.join(f'z_{s}' for s in STYLES)} FROM ({catalog.standardized(SPARK)}) AS s", {"panel": catalog.panel_view(spark, sf_dir, kind)})
    return stage(rows, "weighted-rows")


def returns_query(spark, sf_dir: str) -> DataFrame:
    return factor_returns(weighted_rows(spark, sf_dir))


def specific_query(spark, sf_dir: str) -> DataFrame:
    rows = weighted_rows(spark, sf_dir)
    return specific_risk(rows, stage(factor_returns(rows), "factor-returns"))


class Model:
    """The whole model of a panel kind, each table computed once: rows, returns, specific, covariances at quarter ends."""

    def __init__(self, spark, sf_dir: str, kind: str = "supp_week", window: int = 504):
        self.rows = weighted_rows(spark, sf_dir, kind)
        self.returns = stage(factor_returns(self.rows), "factor-returns")
        self.specific = stage(specific_risk(self.rows, self.returns), "specific-risk")
        ends = self.rows.groupBy(F.date_trunc("quarter", "date").alias("q")).agg(F.max("date").alias("date")).select("date")
        self.covariances = stage(factor_covariance(self.returns, ends, window), "factor-covariance")

    def names(self) -> DataFrame:
        """What books are made of: (date, ticker, value, sector, <styles>, specific, styles_cov) at quarter ends; the signal is momentum."""
        rows = self.rows.join(F.broadcast(self.covariances), "date").join(self.specific, ["date", "ticker"], "left")
        sector = F.concat(F.lit("S"), (F.xxhash64("ticker") % 5 + 5) % 5)
        return rows.select("date", "ticker", F.col("z_momentum").alias("value"), sector.alias("sector"), F.lit(1.0).alias("market"), *(F.col(f"z_{s}").alias(s) for s in STYLES), F.col("risk").alias("specific"), F.col("cov").alias("styles_cov"))


def covariance_query(spark, sf_dir: str) -> DataFrame:
    return Model(spark, sf_dir).covariances


def summary_query(spark, sf_dir: str) -> DataFrame:
    return summary(Model(spark, sf_dir).returns)


def erc_query(spark, sf_dir: str) -> DataFrame:
    """Equal-risk books at quarter ends."""
    from tidemark.operators import optimize

    return optimize.erc_book(Model(spark, sf_dir).names(), list(NAMES), max_weight=0.2)


def mean_variance_query(spark, sf_dir: str) -> DataFrame:
    """Mean-variance books at quarter ends, with sector caps."""
    from tidemark.operators import optimize

    return optimize.mean_variance_book(Model(spark, sf_dir).names(), list(NAMES), max_weight=0.2)


def decompose_query(spark, sf_dir: str) -> DataFrame:
    """Risk of an equal-weight book of all names at quarter ends."""
    model = Model(spark, sf_dir)
    book = model.rows.join(F.broadcast(model.covariances.select("date")), "date").select("date", "ticker", F.lit(0.01).alias("weight"))
    return decompose(book, model.rows, model.covariances, model.specific)


def attribution_query(spark, sf_dir: str) -> DataFrame:
    """The benchmark-less equal-weight market's returns, attributed to the styles' returns."""
    model = Model(spark, sf_dir)
    a = attribute_returns(model.rows.groupBy("date").agg(F.avg("ret").alias("ret")), model.returns.select("date", *NAMES[1:]))
    rows = [(s, a.betas[s], a.factor_pnl[s], a.alpha_ann, a.r2, a.residual_pnl, a.n_days) for s in a.betas]
    return spark.createDataFrame(rows, "factor string, beta double, factor_pnl double, alpha_ann double, r2 double, residual_pnl double, n_days long")


QUERIES = {
    "rm_factor_returns": returns_query, "rm_specific_risk": specific_query, "rm_covariance": covariance_query, "rm_summary": summary_query,
    "rm_decompose": decompose_query, "rm_attribution_multi": attribution_query, "opt_erc": erc_query, "opt_mv": mean_variance_query,
}
