"""The engine for a user's own tables: panels, factor libraries, evaluation, neutralising, universes, quality and metrics.

Everything takes and gives DataFrames. Plans are the same texts that the registered queries run (tidemark.plans.blocks).
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.dialect import SPARK, lag, lead, roll, safe_div, trailing
from tidemark.operators.factors import REGISTRY, get_factor
from tidemark.plans import blocks, catalog
from tidemark.sources import panels
from tidemark.storage import stage


def over(text: catalog.Text, **tables: DataFrame) -> DataFrame:
    """Run a plan's text over tables by name."""
    views = {}
    for name, df in tables.items():
        views[name] = f"{name}_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(views[name])
    return catalog.evaluate(next(iter(tables.values())).sparkSession, text, views)


class PricePanel:
    """A dense panel (date, ticker, t, open, high, low, close, volume, ff, ret, dv)."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def from_long(cls, bars: DataFrame, staged: bool = True) -> PricePanel:
        """ValueError for a missing column or a repeated (date, ticker)."""
        panel = panels.from_long(bars)
        return cls(stage(panel, "panel") if staged else panel)

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str) -> PricePanel:
        return cls.from_long(spark.read.parquet(path))

    def to_long(self) -> DataFrame:
        """All rows of the grid, those without a price too."""
        return self.df.select("date", "ticker", "open", "high", "low", "close", "volume")

    def to_parquet(self, path: str) -> None:
        panels.to_parquet(self.to_long(), path)

    def field(self, name: str) -> DataFrame:
        if name not in ("open", "high", "low", "close", "volume"):
            raise ValueError(f"unknown field {name}")
        return self.df.select("date", "ticker", F.col(name).alias("value"))

    def tickers(self) -> DataFrame:
        return self.df.select("ticker").distinct()

    def dates(self) -> DataFrame:
        return self.df.select("date").distinct()

    def shape(self) -> tuple[int, int]:
        s = self.df.agg(F.max("t"), F.count_distinct("ticker")).first()
        return s[0] or 0, s[1]

    def __len__(self) -> int:
        return self.shape()[0]

    def returns(self) -> DataFrame:
        return self.df.select("date", "ticker", F.col("ret").alias("value"))

    def log_returns(self) -> DataFrame:
        return over(f"SELECT date, ticker, ln(close / nullif({lag('close', 1)}, 0)) AS value FROM panel", panel=self.df)

    def dollar_volume(self) -> DataFrame:
        return self.df.select("date", "ticker", F.col("dv").alias("value"))

    def slice_dates(self, start: datetime.date | str | None = None, end: datetime.date | str | None = None) -> PricePanel:
        """Both ends included; what was computed on the whole grid stays, but rows are numbered anew."""
        df = self.df
        if start is not None:
            df = df.filter(F.col("date") >= F.lit(start).cast("date"))
        if end is not None:
            df = df.filter(F.col("date") <= F.lit(end).cast("date"))
        first = df.agg(F.min("t").alias("_t"))
        return PricePanel(df.crossJoin(F.broadcast(first)).withColumn("t", F.col("t") - F.col("_t") + 1).drop("_t"))

    def restrict_tickers(self, tickers: Sequence[str]) -> PricePanel:
        return PricePanel(self.df.filter(F.col("ticker").isin(list(tickers))))

    def coverage(self) -> DataFrame:
        """(ticker, n_days, first_date, last_date, pct_available, avg_close, avg_dollar_volume, ..._musd), best covered first."""
        known = F.col("close").isNotNull()
        out = self.df.groupBy("ticker").agg(
            F.count("close").alias("n_days"), F.min(F.when(known, F.col("date"))).alias("first_date"), F.max(F.when(known, F.col("date"))).alias("last_date"),
            (F.count("close") / F.count(F.lit(1))).alias("pct_available"), F.avg("close").alias("avg_close"), F.avg("dv").alias("avg_dollar_volume"),
        )
        return out.withColumn("avg_dollar_volume_musd", F.col("avg_dollar_volume") / 1e6).orderBy(F.desc("pct_available"), F.desc("avg_dollar_volume"), "ticker")


class FactorLibrary:
    """Factors of a panel, less the first ``min_history`` rows if the panel is longer; each table is computed once."""

    def __init__(self, panel: PricePanel, min_history: int = blocks.WARM, fundamentals: DataFrame | None = None):
        self.panel, self.min_history, self.fundamentals = panel, min_history, fundamentals
        self._kept: dict[tuple[str, ...], DataFrame] = {}

    def available(self) -> list[str]:
        return sorted(REGISTRY)

    def _source(self) -> DataFrame:
        items = ("shares", "revenue_ttm", "net_income_ttm", "book_equity")
        if self.fundamentals is None:
            return self.panel.df.select("*", *(F.lit(None).cast("double").alias(c) for c in items))
        have = [F.col(c).cast("double").alias(c) if c in self.fundamentals.columns else F.lit(None).cast("double").alias(c) for c in items]
        return self.panel.df.join(self.fundamentals.select("ticker", *have), "ticker", "left")

    def compute_all(self, names: Sequence[str] | None = None) -> DataFrame:
        """(ticker, date, t, <names>), all in one plan; without a snapshot of fundamentals their factors are NULL."""
        key = tuple(names or self.available())
        for n in key:
            get_factor(n)
        if key not in self._kept:
            text = f"SELECT * FROM ({blocks.layered('panel', list(key))}) AS f WHERE t > {blocks.warm(self.min_history)}"
            self._kept[key] = stage(over(text, panel=self._source()), "factors")
        return self._kept[key]

    def compute(self, name: str) -> DataFrame:
        return self.compute_all([name]).select("date", "ticker", "t", F.col(name).alias("value"))

    def long(self, names: Sequence[str] | None = None) -> DataFrame:
        """(ticker, date, t, factor, value), values that are there."""
        names = list(names or self.available())
        return self.compute_all(names).unpivot(["ticker", "date", "t"], names, "factor", "value").filter("value is not null")

    def composite(self, names: Sequence[str], weights: dict[str, float] | None = None, direction: dict[str, int] | None = None) -> DataFrame:
        """(ticker, date, t, value): mean of standardised factors, or weighted by ``weights`` over those that are there."""
        if not names:
            raise ValueError("a composite needs factors")
        day = Window.partitionBy("date", "factor")
        rows = self.long(names).withColumn("q", F.percentile("value", F.array(F.lit(0.01), F.lit(0.99))).over(day))
        rows = rows.withColumn("w", F.least(F.greatest("value", F.col("q")[0]), F.col("q")[1]))
        sign = F.coalesce(F.create_map(*(F.lit(x) for n in names for x in (n, float((direction or {}).get(n, 1)))))[F.col("factor")], F.lit(1.0))
        z = F.try_divide(F.col("w") - F.avg("w").over(day), F.stddev_pop("w").over(day)) * sign
        weight = F.lit(1.0) if weights is None else F.create_map(*(F.lit(x) for n in names for x in (n, float(weights.get(n, 0.0)))))[F.col("factor")]
        rows = rows.select("ticker", "date", "t", z.alias("z"), weight.alias("wt")).filter("z is not null")
        return rows.groupBy("ticker", "date", "t").agg(F.try_divide(F.sum(F.col("z") * F.col("wt")), F.sum("wt")).alias("value"))


class FactorEvaluator:
    """Rank information coefficients, quantile books and turnover of factors against a panel."""

    def __init__(self, panel: PricePanel, horizon: int = 5, quantiles: int = 5, cost_bps: float = 10.0):
        self.panel, self.horizon, self.quantiles, self.cost_bps = panel, horizon, quantiles, cost_bps

    def forward_returns(self) -> DataFrame:
        return over(blocks.forward(self.horizon), panel=self.panel.df)

    def ic_series(self, factor: DataFrame, least: int = 10) -> DataFrame:
        return over(blocks.rank_ic("SELECT * FROM factor_rows", blocks.forward(self.horizon), least), panel=self.panel.df, factor_rows=factor)

    def quantile_returns(self, factor: DataFrame) -> DataFrame:
        """(date, one column a bucket)."""
        rows = over(blocks.quantile_returns("SELECT * FROM factor_rows", self.quantiles), panel=self.panel.df, factor_rows=factor)
        return rows.groupBy("date").pivot("bucket", list(range(1, self.quantiles + 1))).agg(F.first("mean_return"))

    def turnover(self, factor: DataFrame, rebalance: str = "W-FRI") -> float | None:
        row = over(blocks.leg_turnover(SPARK, "SELECT *, 'one' AS factor FROM factor_rows", rebalance), factor_rows=factor.select("ticker", "date", "t", "value")).first()
        return row.turnover if row and row.periods > 1 else None

    def evaluate_all(self, factors: DataFrame) -> DataFrame:
        """One row a factor of (ticker, date, t, factor, value), best absolute information ratio first, in one job."""
        first, days = factors.agg(F.min("t"), F.count_distinct("t")).first()
        dates = f"SELECT t FROM panel WHERE t >= {first or 1}"
        lets, text = blocks.evaluation(SPARK, "SELECT * FROM factor_rows", dates, self.horizon, self.quantiles, self.cost_bps, blocks.newey_west_lags(days))
        return over((lets, f"SELECT * FROM ({text}) AS e ORDER BY abs(ic_ir) DESC NULLS LAST, factor"), panel=self.panel.df, factor_rows=factors)

    def evaluate(self, factor: DataFrame, name: str = "factor") -> DataFrame:
        return self.evaluate_all(factor.select("ticker", "date", "t", F.lit(name).alias("factor"), "value"))

    def ic_decay(self, factor: DataFrame, horizons: tuple[int, ...] = (1, 3, 5, 10, 15, 21, 42, 63)) -> DataFrame:
        return over(blocks.ic_decay("SELECT * FROM factor_rows", horizons), panel=self.panel.df, factor_rows=factor)


@dataclass
class Neutralizer:
    """Removes what a signal owes to sectors, the market or risk; steps run in the order winsorize, vol, sector, beta."""

    sectors: DataFrame | None = None
    panel: PricePanel | None = None
    sector: bool = True
    beta: bool = False
    vol: bool = False
    winsorize: bool = True
    beta_window: int = 126
    vol_window: int = 63
    benchmark: str | None = None

    def __post_init__(self):
        if self.sector and self.sectors is None:
            raise ValueError("neutralising sectors needs (ticker, sector)")
        if (self.beta or self.vol) and self.panel is None:
            raise ValueError("neutralising beta or risk needs a panel")
        self.steps_applied: list[str] = []

    def transform(self, signal: DataFrame) -> DataFrame:
        """(ticker, date, t, value) of the same."""
        tables = {"signal_rows": signal}
        text, steps = "SELECT ticker, date, t, value FROM signal_rows", []
        market = "avg(ret) OVER (PARTITION BY date)"
        if self.panel is not None:
            tables["panel"] = self.panel.df
            if self.benchmark and self.panel.df.filter(F.col("ticker") == self.benchmark).count():
                market = f"max(CASE WHEN ticker = {blocks.text(self.benchmark)} THEN ret END) OVER (PARTITION BY date)"
        if self.winsorize:
            text, steps = blocks.robust(SPARK, text), [*steps, "winsorize"]
        if self.vol:
            iv = f"SELECT ticker, date, {roll('stddev_samp', 'x', self.vol_window, self.vol_window // 2)} AS iv FROM (SELECT *, ret - {market} AS x FROM panel) AS v0"
            text = f"SELECT s.ticker, s.date, s.t, s.value / CASE WHEN v.iv IS NOT NULL THEN greatest(v.iv, 0.005) END AS value FROM ({text}) AS s JOIN ({iv}) AS v ON s.ticker = v.ticker AND s.date = v.date"
            text, steps = blocks.robust(SPARK, text), [*steps, "vol"]
        if self.sector:
            tables["sector_rows"] = self.sectors.select("ticker", "sector")
            text, steps = blocks.sector_demeaned(text, sectors="SELECT * FROM sector_rows"), [*steps, "sector"]
        if self.beta:
            betas = blocks.trailing_beta(self.beta_window, max(2, self.beta_window // 2), market)
            if self.benchmark:
                betas = f"SELECT * FROM ({betas}) AS b9 WHERE ticker <> {blocks.text(self.benchmark)}"
            text, steps = blocks.beta_residual(text, betas), [*steps, "beta"]
        self.steps_applied = steps
        return over(text, **tables)

    def describe(self) -> dict:
        return {k: getattr(self, k) for k in ("sector", "beta", "vol", "winsorize", "beta_window", "vol_window", "benchmark")}


class PointInTimeUniverse:
    """(date, ticker, t, is_member), and per name when it came and why."""

    def __init__(self, members: DataFrame, names: DataFrame | None = None):
        self.members, self.names = members, names

    @classmethod
    def from_snapshot(cls, panel: PricePanel, added: DataFrame | None = None, exclude: Sequence[str] = ("SPY",), min_history: int = 0) -> PointInTimeUniverse:
        """Members from the later of the addition (ticker, date_added) and the first trade, seasoned by ``min_history`` rows,
        through the last trade; gaps between trades count as traded. Without either date a name is a member from the start."""
        rows = panel.df.filter(~F.col("ticker").isin(list(exclude)))
        known = F.col("close").isNotNull()
        ends = rows.groupBy("ticker").agg(
            F.min(F.when(known, F.col("date"))).alias("first_trade"), F.max(F.when(known, F.col("date"))).alias("last_trade"), F.min(F.when(known, F.col("t"))).alias("first_t"),
            F.min("date").alias("panel_start"), F.max("date").alias("panel_end"),
        )
        added = added.select("ticker", F.col("date_added").cast("date").alias("added")) if added is not None else ends.select("ticker", F.lit(None).cast("date").alias("added"))
        names = ends.join(added.dropDuplicates(["ticker"]), "ticker", "left").withColumn("start", F.greatest("added", "first_trade"))
        names = stage(names.withColumn("unknown", F.col("start").isNull()).withColumn("start", F.coalesce("start", "panel_start")), "pit-names")
        inside = (F.col("date") >= F.col("start")) & F.col("date").between(F.col("first_trade"), F.col("last_trade")) & (F.col("t") >= F.col("first_t") + min_history)
        members = rows.select("date", "ticker", "t").join(F.broadcast(names), "ticker").select("date", "ticker", "t", F.coalesce(inside, F.lit(False)).alias("is_member"))
        return cls(members, names)

    def n_members(self) -> DataFrame:
        return self.members.groupBy("date").agg(F.count_if("is_member").alias("members"))

    def additions_by_year(self) -> DataFrame:
        """Dates on which a name comes in, the first row aside; who comes back counts again."""
        before = F.lag("is_member").over(Window.partitionBy("ticker").orderBy("date"))
        return self.members.withColumn("before", before).filter("is_member and not before").groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("additions"))

    def coverage_at(self, date: datetime.date | str) -> DataFrame:
        """(ticker) of the members on the last date up to ``date``; KeyError before the first."""
        last = self.members.filter(F.col("date") <= F.lit(date).cast("date")).agg(F.max("date")).first()[0]
        if last is None:
            raise KeyError(f"no date up to {date}")
        return self.members.filter((F.col("date") == F.lit(last)) & F.col("is_member")).select("ticker")

    def restrict_tickers(self, tickers: Sequence[str]) -> PointInTimeUniverse:
        names = self.names.filter(F.col("ticker").isin(list(tickers))) if self.names is not None else None
        return PointInTimeUniverse(self.members.filter(F.col("ticker").isin(list(tickers))), names)

    def restrict_dates(self, start: datetime.date | str, end: datetime.date | str) -> PointInTimeUniverse:
        """What is known of names as a whole is dropped, so stats() counts 0 there."""
        return PointInTimeUniverse(self.members.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))))

    def stats(self) -> DataFrame:
        """One row."""
        daily = self.n_members()
        counts = daily.agg(
            F.count(F.lit(1)).alias("n_dates"), F.min_by("members", "date").alias("members_first"), F.max_by("members", "date").alias("members_last"),
            F.min("members").alias("members_min"), F.max("members").alias("members_max"), F.round(F.avg("members"), 1).alias("members_mean"),
        )
        ever = self.members.filter("is_member").agg(F.count_distinct("ticker").alias("n_tickers_ever"))
        if self.names is None:
            about = ever.select(*(F.lit(0).cast("long").alias(c) for c in ("additions_after_start", "names_with_unknown_addition", "data_terminated")))
        else:
            gone = F.col("last_trade") < F.date_sub("panel_end", 5)
            about = self.names.agg(F.count_if(F.col("start") > F.col("panel_start")).alias("additions_after_start"), F.count_if("unknown").alias("names_with_unknown_addition"), F.count_if(gone).alias("data_terminated"))
        return counts.crossJoin(ever).crossJoin(about)  # one row each


CHECKS = (("duplicates", "error"), ("non_positive_prices", "error"), ("ohlc_consistency", "error"), ("stale_prices", "warning"), ("extreme_returns", "info"), ("coverage_gaps", "warning"), ("zero_volume", "info"))


@dataclass(frozen=True)
class QualityReport:
    """rows: (no, name, severity, passed, n_flagged, message)."""

    rows: DataFrame
    details: dict[str, DataFrame]

    def passed(self) -> bool:
        """Whether all checks of severity error passed."""
        return self.rows.filter("severity = 'error' and not passed").isEmpty()

    def summary(self) -> DataFrame:
        return self.rows.orderBy("no").select("name", "severity", "passed", "n_flagged", "message")

    def to_dict(self) -> dict:
        return {"passed": self.passed(), "checks": [r.asDict() for r in self.summary().collect()]}  # seven rows


class DataQualityChecker:
    """Seven checks of raw long bars; data are never changed."""

    def __init__(self, extreme: float = 0.30, stale_run: int = 10, gap_share: float = 0.05, tolerance: float = 5e-4):
        self.extreme, self.stale_run, self.gap_share, self.tolerance = extreme, stale_run, gap_share, tolerance

    def run(self, bars: DataFrame) -> QualityReport:
        """Duplicates are looked for in the bars as they come; the other checks take one row of each (date, ticker)."""
        groups = bars.groupBy("date", "ticker").count().filter("count > 1")
        have = [c for c in ("open", "high", "low", "close", "volume") if c in bars.columns]
        one = bars.groupBy("date", "ticker").agg(*(F.first(c).alias(c) for c in have))
        panel = PricePanel.from_long(one).df
        prices = ("open", "high", "low", "close")
        tol = self.tolerance
        bad_low = F.col("high") < F.col("low") * (1 - tol)
        bad_close = (F.col("close") > F.col("high") * (1 + tol)) | (F.col("close") < F.col("low") * (1 - tol))
        w = Window.partitionBy("ticker").orderBy("t")
        runs = panel.filter("close is not null").withColumn("new", (~F.col("close").eqNullSafe(F.lag("close").over(w))).cast("int"))
        runs = runs.withColumn("grp", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("ticker", "grp").agg(F.count(F.lit(1)).alias("run"))
        found = {
            "duplicates": groups,
            "non_positive_prices": panel.select("date", "ticker", F.explode(F.array(*(F.col(c) for c in prices))).alias("price")).filter("price <= 0"),
            "ohlc_consistency": panel.select("date", "ticker", F.explode(F.array(F.coalesce(bad_low, F.lit(False)), F.coalesce(bad_close, F.lit(False)))).alias("bad")).filter("bad"),
            "stale_prices": runs.filter(F.col("run") >= self.stale_run).groupBy("ticker").agg(F.max("run").alias("run")),
            "extreme_returns": panel.filter(F.abs("ret") > self.extreme).select("date", "ticker", "ret"),
            "coverage_gaps": panel.groupBy("ticker").agg((1 - F.count("close") / F.count(F.lit(1))).alias("missing")).filter(F.col("missing") > self.gap_share),
            "zero_volume": panel.filter("close is not null and coalesce(volume, 0) = 0").select("date", "ticker"),
        }
        words = {"duplicates": "duplicated (date, ticker) rows", "non_positive_prices": "prices at or below 0", "ohlc_consistency": "bars that contradict themselves", "stale_prices": "tickers with unchanged closes", "extreme_returns": "extreme returns", "coverage_gaps": "tickers with gaps", "zero_volume": "bars without volume"}
        rows = None
        for no, (name, severity) in enumerate(CHECKS):
            n = F.coalesce(F.sum("count"), F.lit(0)) if name == "duplicates" else F.count(F.lit(1))
            part = found[name].agg(n.cast("long").alias("n_flagged")).select(F.lit(no).alias("no"), F.lit(name).alias("name"), F.lit(severity).alias("severity"), (F.col("n_flagged") == 0).alias("passed"), "n_flagged", F.concat(F.col("n_flagged").cast("string"), F.lit(f" {words[name]}")).alias("message"))
            rows = part if rows is None else rows.unionByName(part)
        return QualityReport(stage(rows, "quality"), found)


def _series(returns: DataFrame) -> DataFrame:
    """(date, t, net) of (date, ret), rows numbered by date."""
    return returns.select("date", F.row_number().over(Window.orderBy("date")).alias("t"), F.col("ret").alias("net"))


def performance_summary(returns: DataFrame, benchmark: DataFrame | None = None, rf: float = 0.0) -> DataFrame:
    """One row of statistics of (date, ret), and against a benchmark's (date, ret)."""
    own = blocks.summary(SPARK, "SELECT * FROM series_rows", rf=rf)
    if benchmark is None:
        return over(own, series_rows=_series(returns))
    pairs = returns.join(benchmark.select("date", F.col("ret").alias("bench")), "date").filter("ret is not null and bench is not null")
    pairs = pairs.select("date", F.row_number().over(Window.orderBy("date")).alias("t"), F.col("ret").alias("net"), "bench")
    return over(f"SELECT * FROM ({own}) AS s CROSS JOIN ({blocks.against(SPARK, 'SELECT * FROM pair_rows')}) AS a", series_rows=_series(returns), pair_rows=pairs)


def max_drawdown(returns: DataFrame) -> DataFrame:
    """(depth, peak_date, trough_date, recovery_days): the deepest fall; recovery NULL if there is none."""
    curve = stage(over(blocks.drawdowns("SELECT * FROM series_rows"), series_rows=_series(returns)), "curve")
    worst = curve.agg(F.min_by(F.struct("date", "t", "peak", "dd"), F.struct("dd", "t")).alias("w")).select("w.*").withColumnsRenamed({"date": "trough_date", "t": "trough", "peak": "top", "dd": "depth"})
    joined = curve.crossJoin(F.broadcast(worst))  # one row
    peak = F.min(F.when((F.col("t") <= F.col("trough")) & (F.col("equity") == F.col("top")), F.col("date")))
    back = F.min(F.when((F.col("t") >= F.col("trough")) & (F.col("equity") >= F.col("top")), F.col("date")))
    return joined.groupBy("depth", "trough_date").agg(peak.alias("peak_date"), back.alias("back")).select("depth", "peak_date", "trough_date", F.date_diff("back", "trough_date").alias("recovery_days"))


def value_at_risk(returns: DataFrame, level: float = 0.95) -> DataFrame:
    """(historical, conditional, cornish_fisher) losses at a level, as positive figures."""
    text = f"""SELECT -max(q) AS historical, -avg(CASE WHEN net <= q THEN net END) AS conditional, {blocks.cornish_fisher(level, 'max(mu)', 'stddev_samp(net)', 'max(skew)', 'max(excess_kurtosis)')} AS cornish_fisher FROM (
      SELECT r.net, m.mu, m.skew, m.excess_kurtosis, percentile(r.net, {1 - level}) OVER (PARTITION BY 1) AS q FROM series_rows AS r
      CROSS JOIN (SELECT max(mu) AS mu, {blocks.moments('net')} FROM (SELECT net, avg(net) OVER (PARTITION BY 1) AS mu FROM series_rows WHERE net IS NOT NULL) AS m0) AS m WHERE r.net IS NOT NULL) AS v"""
    return over(text, series_rows=_series(returns))


def monthly_returns(returns: DataFrame) -> DataFrame:
    """(year, Jan ... Dec): compounded returns of each month."""
    names = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
    months = over(f"SELECT year(date) AS year, month(date) AS month, {blocks.compounded('net')} - 1 AS ret FROM series_rows WHERE net IS NOT NULL GROUP BY year(date), month(date)", series_rows=_series(returns))
    named = months.withColumn("month", F.element_at(F.array(*map(F.lit, names)), F.col("month")))
    return named.groupBy("year").pivot("month", names).agg(F.first("ret"))


def rolling_risk(returns: DataFrame, benchmark: DataFrame | None = None, window: int = 126) -> DataFrame:
    """(date, vol, ret, sharpe, var_95, [beta]) over the last ``window`` rows."""
    w = trailing(window, by="")
    full = f"count(net) OVER ({w}) = {window}"
    text = f"""date, CASE WHEN {full} THEN stddev_samp(net) OVER ({w}) * sqrt(252) END AS vol, CASE WHEN {full} THEN avg(net) OVER ({w}) * 252 END AS ret,
      CASE WHEN {full} THEN avg(net) OVER ({w}) / nullif(stddev_samp(net) OVER ({w}), 0) * sqrt(252) END AS sharpe, CASE WHEN {full} THEN -percentile(net, 0.05) OVER ({w}) END AS var_95"""
    rows = _series(returns)
    if benchmark is not None:
        rows = rows.join(benchmark.select("date", F.col("ret").alias("bench")), "date", "left")
        text += f", CASE WHEN count(net + bench) OVER ({w}) = {window} THEN covar_samp(net, bench) OVER ({w}) / nullif(var_samp(bench) OVER ({w}), 0) END AS beta"
    return over(f"SELECT {text} FROM series_rows", series_rows=rows)


def factor_exposure(returns: DataFrame, factors: DataFrame, window: int = 252) -> DataFrame:
    """(date, factor, beta): rolling beta to each column of ``factors``; no row where the series is too short."""
    names = [c for c in factors.columns if c != "date"]
    rows = _series(returns).join(factors, "date").unpivot(["date", "t", "net"], names, "factor", "x").filter("net is not null and x is not null")
    w = "PARTITION BY factor ORDER BY t ROWS BETWEEN " + f"{window - 1} PRECEDING AND CURRENT ROW"
    text = f"SELECT date, factor, covar_samp(net, x) OVER ({w}) / nullif(var_samp(x) OVER ({w}), 0) AS beta, count(x) OVER ({w}) AS n FROM series_rows"
    return over(f"SELECT date, factor, beta FROM ({text}) AS e WHERE n = {window}", series_rows=rows)


#: Market stress windows, both ends included.
STRESS_WINDOWS = {
    "COVID crash (2020-02..03)": ("2020-02-19", "2020-03-23"),
    "2018 Q4 selloff": ("2018-09-20", "2018-12-24"),
    "2022 rate shock": ("2022-01-03", "2022-10-12"),
    "2015-16 mini-correction": ("2015-11-03", "2016-02-11"),
    "2024 Aug yen-carry unwind": ("2024-07-16", "2024-08-05"),
}


def stress_test(returns: DataFrame, windows: dict[str, tuple[str, str]] | None = None, least: int = 5) -> DataFrame:
    """(name, n_days, ret, ann_vol, worst) of windows with ``least`` returns or more; empty without any."""
    rows = SPARK.rows("name, a, b", [(n, *ab) for n, ab in (STRESS_WINDOWS if windows is None else windows).items()])
    text = f"""SELECT w.name, count(m.net) AS n_days, {blocks.compounded('m.net')} - 1 AS ret, stddev_samp(m.net) * sqrt(252) AS ann_vol, min(m.net) AS worst
      FROM {rows} AS w JOIN series_rows AS m ON m.date BETWEEN CAST(w.a AS DATE) AND CAST(w.b AS DATE) WHERE m.net IS NOT NULL GROUP BY w.name HAVING count(m.net) >= {least}"""
    return over(text, series_rows=_series(returns))


def drawdown_episodes(returns: DataFrame, top: int = 5, min_depth: float = 0.05) -> DataFrame:
    """(peak_date, trough_date, recovery_date, depth, length_days, recovery_days), deepest first."""
    lets, text = blocks.episodes(SPARK, "SELECT * FROM series_rows", top, min_depth)
    return over((lets, text), series_rows=_series(returns))


def risk_summary(returns: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """One row: tail losses, moments, worst day and week, deepest fall, and the benchmark's."""
    own = performance_summary(returns).select("var_95", "var_99", "var_cf", "cvar_95", "skew", "excess_kurtosis", F.col("worst").alias("worst_day"), "max_drawdown")
    w = trailing(5, by="")
    weeks = over(f"SELECT min(CASE WHEN n = 5 THEN g - 1 END) AS worst_week FROM (SELECT count(net) OVER ({w}) AS n, {blocks.compounded('net', w)} AS g FROM series_rows) AS x", series_rows=_series(returns))
    out = own.crossJoin(weeks)  # one row each
    if benchmark is not None:
        out = out.crossJoin(performance_summary(benchmark).select(F.col("max_drawdown").alias("benchmark_max_drawdown")))
    return out


__all__ = [n for n in dir() if n[0] != "_" and n not in ("annotations", "lead", "safe_div")]
