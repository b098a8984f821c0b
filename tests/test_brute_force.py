"""Operators against plain pandas and NumPy, written from their definitions, on a panel with gaps and late names."""

import datetime
import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import analytics
from tidemark.functions.quantiles import quantiles
from tidemark.ml import monitoring, training
from tidemark.operators import optimize
from tidemark.operators.backtest import BacktestConfig, LinearCost, SquareRootImpact, run_backtest

DAYS, NAMES = 330, 14


@pytest.fixture(scope="module")
def wide():
    """Closes and volumes, date by ticker: name 3 lists late, name 5 stops early, name 7 halts."""
    rng = np.random.default_rng(7)
    dates = pd.date_range("2019-01-01", periods=DAYS, freq="B")
    names = [f"N{i:02d}" for i in range(NAMES)]
    close = pd.DataFrame(50 * np.exp(np.cumsum(rng.normal(0.0004, 0.02, (DAYS, NAMES)), axis=0)), dates, names)
    close.iloc[:40, 3] = np.nan
    close.iloc[280:, 5] = np.nan
    close.iloc[100:110, 7] = np.nan
    volume = pd.DataFrame(rng.uniform(1e5, 1e6, (DAYS, NAMES)), dates, names).where(close.notna())
    return close, volume


@pytest.fixture(scope="module")
def panel(spark, wide):
    close, volume = wide
    rows = [(d.date(), n, float(close.at[d, n]), float(close.at[d, n]) * 1.01, float(close.at[d, n]) * 0.99, float(volume.at[d, n])) for d in close.index for n in close if close.at[d, n] == close.at[d, n]]
    return analytics.PricePanel.from_long(spark.createDataFrame(rows, "date date, ticker string, close double, high double, low double, volume double"))


@pytest.fixture(scope="module")
def signal(spark, wide, panel):
    rng = np.random.default_rng(8)
    close, _ = wide
    raw = pd.DataFrame(rng.normal(size=close.shape) + np.linspace(-1, 1, NAMES), close.index, close.columns).where(close.notna())
    rows = [(d.date(), n, float(raw.at[d, n])) for d in raw.index for n in raw if raw.at[d, n] == raw.at[d, n]]
    df = spark.createDataFrame(rows, "date date, ticker string, value double").join(panel.df.select("date", "ticker", "t"), ["date", "ticker"]).cache()
    return raw, df


def _wide(df, value="value"):
    out = df.toPandas().pivot(index="date", columns="ticker", values=value)
    out.index = pd.to_datetime(out.index)
    return out.astype(float).sort_index()


def test_evaluation(wide, panel, signal):
    close, _ = wide
    raw, df = signal
    got = analytics.FactorEvaluator(panel).evaluate(df, "noise").first()
    ahead = close.shift(-6) / close.shift(-1) - 1
    a, z = raw.rank(axis=1), ahead.rank(axis=1)
    both = a.notna() & z.notna()
    ic = pd.Series({d: np.corrcoef(a.loc[d][both.loc[d]], z.loc[d][both.loc[d]])[0, 1] if both.loc[d].sum() >= 10 else np.nan for d in raw.index})
    assert got.n_obs == DAYS and got.ic_mean == pytest.approx(ic.mean()) and got.ic_std == pytest.approx(ic.std())
    assert got.positive_rate == pytest.approx((ic > 1e-12).sum() / DAYS)
    e, n = (ic.dropna() - ic.mean()).to_numpy(), ic.notna().sum()
    lags = int(4 * (n / 100) ** (1 / 3))
    v = e @ e / n + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lags + 1))
    assert got.tstat == pytest.approx(ic.mean() / np.sqrt(v / n))
    nxt = close.ffill().pct_change(fill_method=None).shift(-1)
    bucket = np.ceil(raw.rank(axis=1, pct=True) * 5).clip(upper=5)
    spread = (nxt.where(bucket == 5).mean(axis=1) - nxt.where(bucket == 1).mean(axis=1)).dropna() - 10 / 1e4 / 5 * 2
    assert got.spread_ann == pytest.approx(spread.mean() * 252) and got.spread_sharpe == pytest.approx(spread.mean() / spread.std() * np.sqrt(252))
    ranks = raw.rank(axis=1, pct=True).groupby(raw.index.to_period("W-FRI")).last()
    top, low = ranks >= 0.75, ranks <= 0.25
    book = top.div(top.sum(axis=1), axis=0).fillna(0) - low.div(low.sum(axis=1), axis=0).fillna(0)
    assert got.turnover == pytest.approx(book.diff().abs().sum(axis=1).iloc[1:].mean())
    decay = {r.horizon: r.mean_ic for r in analytics.FactorEvaluator(panel).ic_decay(df).collect()}
    assert decay[5] == pytest.approx(ic.mean())


def test_neutralizer(spark, wide, panel, signal):
    close, _ = wide
    raw, df = signal
    sector = {n: f"S{i % 3}" for i, n in enumerate(raw)}
    sectors = spark.createDataFrame(list(sector.items()), "ticker string, sector string")
    tool = analytics.Neutralizer(sectors, panel, beta=True, vol=True)
    got = _wide(tool.transform(df))
    assert tool.steps_applied == ["winsorize", "vol", "sector", "beta"]

    def robust(x):
        z = x.sub(x.median(axis=1), axis=0)
        z = z.div(1.4826 * z.abs().median(axis=1).replace(0, np.nan), axis=0).clip(-3, 3)
        return z.sub(z.mean(axis=1), axis=0).div(z.std(axis=1), axis=0)

    ret = close.ffill().pct_change(fill_method=None)
    market = ret.mean(axis=1)
    iv = ret.sub(market, axis=0).rolling(63, min_periods=31).std().clip(lower=0.005)
    out = robust(robust(raw) / iv)
    for s in set(sector.values()):
        members = [n for n in raw if sector[n] == s]
        enough = out[members].notna().sum(axis=1) >= 3
        out.loc[enough, members] = out.loc[enough, members].sub(out.loc[enough, members].mean(axis=1), axis=0)
    xy, m2 = ret.mul(market, axis=0), market.rolling(126, min_periods=63)
    beta = (xy.rolling(126, min_periods=63).mean() - ret.rolling(126, min_periods=1).mean().mul(market.rolling(126, min_periods=1).mean(), axis=0)).div(m2.var(), axis=0)
    for d in out.index:
        ok = out.loc[d].notna() & beta.loc[d].notna()
        if ok.sum() >= 10:
            slope, start = np.polyfit(beta.loc[d][ok], out.loc[d][ok], 1)
            out.loc[d, ok] = out.loc[d][ok] - (slope * beta.loc[d][ok] + start)
    assert np.allclose(got.reindex_like(out).to_numpy(float), out.to_numpy(float), equal_nan=True, atol=1e-8)
    with pytest.raises(ValueError):
        analytics.Neutralizer()
    with pytest.raises(ValueError):
        analytics.Neutralizer(sector=False, beta=True)


def _simulate(close, volume, raw, cfg, members=None):
    """Day by day, with books of names."""
    ret = close.ffill().pct_change(fill_method=None)
    dv = close * volume
    ok = (close >= cfg.min_price) & (dv.rolling(21).mean() / 1e6 >= cfg.min_dollar_vol_musd)
    if members is not None:
        ok &= members
    sig = raw.where(ok)
    days = sig.index[sig.notna().any(axis=1)]
    picked = pd.Series(days, index=days).groupby(days.to_period("M")).last() if cfg.rebalance == "MS" else pd.Series(days, index=days).groupby(days.to_period("W-FRI")).last()
    at = {close.index.get_loc(d) + cfg.execution_lag: d for d in picked if close.index.get_loc(d) + cfg.execution_lag < len(close)}
    adv, vol = dv.rolling(21, min_periods=5).mean(), ret.rolling(21, min_periods=10).std()
    held, scaler, out, owed, turns = pd.Series(0.0, close.columns), 1.0, [], 0.0, []
    for i in range(len(close)):
        if out or held.any() or owed:
            day = ret.iloc[i].fillna(0)
            gross = float((held * day).sum())
            if started:
                out.append((close.index[i], gross, gross - owed))
                owed = 0.0
            held = held * (1 + day)
        if i in at:
            d = at[i]
            s = sig.loc[d].dropna().sort_index().sort_values(ascending=False, kind="stable")
            target = pd.Series(0.0, close.columns)
            if len(s) >= 2 * cfg.top_n:
                target[s.index[: cfg.top_n]] = 1 / cfg.top_n
                if cfg.side == "long_short":
                    target[s.index[-cfg.top_n :]] = -1 / cfg.top_n
            if cfg.vol_target and len(out) >= 21:
                realised = np.std([x[2] for x in out][-63:], ddof=1) * np.sqrt(252)
                scaler = float(np.clip(cfg.vol_target / realised, 0, cfg.max_leverage))
            target = target * scaler
            moved = (target - held).abs()
            if isinstance(cfg.cost, LinearCost):
                owed = moved.sum() * cfg.cost.bps_per_side / 1e4
            else:
                share = (moved * cfg.cost.book / adv.loc[d].clip(lower=1)).clip(upper=1)
                owed = float((moved * (cfg.cost.impact * vol.loc[d] * np.sqrt(share)).fillna(0)).sum() + cfg.cost.fixed_bps / 1e4 * moved.sum())
            turns.append(moved.sum())
            held, started = target, True
    return pd.DataFrame(out, columns=["date", "gross", "net"]).set_index("date"), turns


@pytest.mark.parametrize("options", [
    {}, {"side": "long_short", "rebalance": "W-FRI"}, {"vol_target": 0.10}, {"cost": SquareRootImpact(book=1e6)}, {"execution_lag": 2, "pit": True},
])
def test_backtest(spark, wide, panel, signal, options):
    close, volume = wide
    raw, df = signal
    options = dict(options)
    members = None
    pit = None
    if options.pop("pit", False):
        pit = analytics.PointInTimeUniverse.from_snapshot(panel, spark.createDataFrame([("N01", datetime.date(2019, 9, 2))], "ticker string, date_added date"), min_history=5)
        members = _wide(pit.members.withColumn("is_member", F.col("is_member").cast("double")), "is_member").reindex_like(close) == 1
    cfg = BacktestConfig(**({"rebalance": "MS", "top_n": 4, "side": "long", "max_weight": None, "min_dollar_vol_musd": 10.0, "benchmark": None, "exclude": ()} | options))
    got = run_backtest(panel.df, df, cfg, pit.members if pit else None)
    want, turns = _simulate(close, volume, raw, cfg, members)
    daily = got.daily.toPandas().set_index("date").sort_index()
    daily.index = pd.to_datetime(daily.index)
    want = want.loc[daily.index[0] :]
    assert len(daily) == len(want) and np.allclose(daily.gross.astype(float), want.gross, atol=1e-10) and np.allclose(daily.net.astype(float), want.net, atol=1e-10)
    found = [r.turnover for r in got.turnover.orderBy("k").collect()]
    assert np.allclose(found, turns[: len(found)], atol=1e-9)


def test_metrics(spark):
    rng = np.random.default_rng(3)
    dates = pd.date_range("2018-01-01", periods=900, freq="B")
    x, y = pd.Series(rng.normal(0.0003, 0.012, 900), dates), pd.Series(rng.normal(0.0002, 0.01, 900), dates)
    x = x + 0.6 * y
    frames = [spark.createDataFrame([(d.date(), float(v)) for d, v in s.items()], "date date, ret double") for s in (x, y)]
    s = analytics.performance_summary(*frames).first()
    cum = (1 + x).cumprod()
    assert s.total_return == pytest.approx(cum.iloc[-1] - 1) and s.sharpe == pytest.approx(x.mean() / x.std() * np.sqrt(252))
    assert s.max_drawdown == pytest.approx((cum / cum.cummax() - 1).min()) and s.skew == pytest.approx(x.skew()) and s.excess_kurtosis == pytest.approx(x.kurtosis())
    assert s.beta == pytest.approx(x.cov(y) / y.var()) and s.alpha_ann == pytest.approx((x.mean() - s.beta * y.mean()) * 252) and s.correlation == pytest.approx(x.corr(y))
    assert s.var_95 == pytest.approx(-x.quantile(0.05)) and s.cvar_95 == pytest.approx(-x[x <= x.quantile(0.05)].mean())
    z, k, g = -1.6449, x.kurtosis(), x.skew()
    cf = -(x.mean() + x.std() * (z + (z * z - 1) * g / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * g * g / 36))
    assert s.var_cf == pytest.approx(cf) and analytics.value_at_risk(frames[0], 0.95).first().cornish_fisher == pytest.approx(cf)
    dd = cum / cum.cummax() - 1
    deep, episodes = dd < -0.05, []
    for _, part in dd.groupby((deep != deep.shift()).cumsum()):
        if part.min() < -0.05:
            low = part.idxmin()
            top = cum.loc[:low].idxmax()
            back = cum.loc[low:][cum.loc[low:] >= cum.loc[top]]
            episodes.append((top.date(), low.date(), back.index[0].date() if len(back) else None, round(part.min(), 9)))
    got = [(r.peak_date, r.trough_date, r.recovery_date, round(r.depth, 9)) for r in analytics.drawdown_episodes(frames[0]).collect()]
    assert got == sorted(episodes, key=lambda e: e[3])[:5]
    worst = analytics.max_drawdown(frames[0]).first()
    assert worst.trough_date == dd.idxmin().date() and worst.peak_date == cum.loc[: dd.idxmin()].idxmax().date()
    r = analytics.risk_summary(*frames).first()
    assert r.worst_week == pytest.approx((1 + x).rolling(5).apply(np.prod, raw=True).min() - 1) and r.benchmark_max_drawdown == pytest.approx(((1 + y).cumprod() / (1 + y).cumprod().cummax() - 1).min())
    months = {row.year: row for row in analytics.monthly_returns(frames[0]).collect()}
    assert months[2018].Mar == pytest.approx((1 + x["2018-03"]).prod() - 1)
    assert analytics.stress_test(frames[0], {"a": ("2018-02-01", "2018-02-28"), "none": ("1990-01-01", "1990-02-01")}).collect()[0].ret == pytest.approx((1 + x["2018-02"]).prod() - 1)
    assert analytics.stress_test(frames[0], {"none": ("1990-01-01", "1990-02-01")}).collect() == []
    beta = analytics.factor_exposure(frames[0], frames[1].withColumnRenamed("ret", "f")).orderBy("date").collect()
    assert len(beta) == 900 - 251 and beta[0].beta == pytest.approx(x[:252].cov(y[:252]) / y[:252].var())


def test_point_in_time_figures(spark, wide, panel):
    close, _ = wide
    added = spark.createDataFrame([("N01", datetime.date(2019, 9, 2)), ("N02", datetime.date(2001, 1, 1))], "ticker string, date_added date")
    pit = analytics.PointInTimeUniverse.from_snapshot(panel, added, exclude=("N13",))
    s = pit.stats().first()
    assert (s.n_dates, s.n_tickers_ever, s.additions_after_start, s.names_with_unknown_addition, s.data_terminated) == (DAYS, 13, 2, 0, 1)
    assert s.members_first == 11 and s.members_last == 12
    assert {r.year: r.additions for r in pit.additions_by_year().collect()} == {2019: 2}
    assert "N05" not in {r.ticker for r in pit.coverage_at("2030-01-01").collect()}
    with pytest.raises(KeyError):
        pit.coverage_at("2000-01-01")
    assert pit.restrict_dates("2019-01-01", "2019-03-01").stats().first().additions_after_start == 0
    assert {r.ticker for r in pit.restrict_tickers(["N01"]).members.select("ticker").distinct().collect()} == {"N01"}


def test_quality(spark):
    day = datetime.date(2020, 1, 1)
    rows = [(day + datetime.timedelta(i), "A", 10.0, 10.0, 10.0, 10.0, 1.0) for i in range(12)] + [(day, "A", 10.0, 10.0, 10.0, 10.0, 1.0)]
    rows += [(day + datetime.timedelta(i), "B", 10.0 + i, 11.0 + i, 9.0 + i, 10.0 + i, 0.0) for i in range(4)] + [(day + datetime.timedelta(5), "B", 40.0, 8.0, 9.0, -1.0, 1.0)]
    bars = spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, volume double")
    report = analytics.DataQualityChecker().run(bars)
    found = {r.name: (r.passed, r.n_flagged) for r in report.summary().collect()}
    assert found["duplicates"] == (False, 2) and found["stale_prices"] == (False, 1) and found["ohlc_consistency"] == (False, 2) and found["non_positive_prices"] == (False, 1)
    assert found["zero_volume"] == (False, 4) and found["coverage_gaps"] == (False, 1) and not report.passed()
    assert report.to_dict()["checks"][0]["message"] == "2 duplicated (date, ticker) rows"


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(v)) for v in np.round(rng.normal(size=3000), 2)] + [("b", float(v)) for v in rng.integers(0, 4, 500)] + [("c", 1.5)]
    p = [0.0, 0.05, 0.333, 0.5, 0.9, 1.0]
    for r in quantiles(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], "x", p, cells=16).collect():
        mine = [v for g, v in rows if g == r.g]
        assert r.n == len(mine) and np.allclose(r.q, np.quantile(mine, p))


def _psi(e, a, bins=10):
    if len(e) < bins or len(a) < bins:
        return None
    edges = np.unique(np.quantile(e, np.linspace(0, 1, bins + 1)))
    if len(edges) < 3:
        return 0.0
    share = [np.maximum(np.histogram(v, edges)[0] / len(v), 1e-6) for v in (e, a)]
    return float(np.clip((share[1] - share[0]) * np.log(share[1] / share[0]), -25, 25).sum())


def test_drift(spark):
    rng = np.random.default_rng(2)
    samples = {"same": (rng.normal(size=900), rng.normal(size=700)), "moved": (rng.normal(size=900), rng.normal(1, 2, 700)), "ties": (rng.integers(0, 5, 900).astype(float), rng.integers(0, 7, 700).astype(float)), "constant": (np.ones(50), np.ones(60) * 2), "short": (rng.normal(size=5), rng.normal(size=90)), "top": (np.minimum(rng.normal(size=500), 0.0), rng.normal(size=500))}
    rows = [(f, float(v), bool(later)) for f, pair in samples.items() for later, x in enumerate(pair) for v in x] + [("same", None, False)]
    df = spark.createDataFrame(rows, "factor string, value double, later boolean")
    got = {r.factor: r for r in monitoring.feature_drift_table(df).collect()}
    for f, (e, a) in samples.items():
        want = _psi(e, a)
        assert got[f].psi == (None if want is None else pytest.approx(want)), f
        grid = np.union1d(e, a)
        gap = np.abs(np.searchsorted(np.sort(e), grid, "right") / len(e) - np.searchsorted(np.sort(a), grid, "right") / len(a)).max()
        assert got[f].ks == pytest.approx(gap)
    assert got["short"].status == "unknown" and got["constant"].psi == 0.0 and got["moved"].status == "significant"


def test_monitoring(spark):
    rng = np.random.default_rng(5)
    dates = pd.date_range("2020-01-01", periods=200, freq="B")
    x = pd.Series(np.r_[rng.normal(0.05, 0.1, 120), rng.normal(-0.05, 0.1, 80)], dates)
    ic = spark.createDataFrame([(d.date(), float(v)) for d, v in x.items()], "date date, ic double")
    z = (x - x.mean()) / x.std()
    up = down = 0.0
    want = []
    for v in z:
        up, down = max(0.0, up + v - 0.25), max(0.0, down - v - 0.25)
        want.append((up, down))
    chart = monitoring.cusum(ic).orderBy("date").collect()
    assert np.allclose([(r.pos, r.neg) for r in chart], want)
    report = monitoring.monitoring_report(ic, "m").as_dict()
    alarm = [u > 2 or d > 2 for u, d in want]
    assert report["n_alerts"] == sum(a and not b for a, b in zip(alarm, [False, *alarm]))
    assert report["n_days"] == 200 and report["last_63d_ic"] == round(x.iloc[-63:].mean(), 4) and len(report["regimes"]) == 6
    band = monitoring.rolling_ic(ic).orderBy("date").collect()[-1]
    se = x.iloc[-63:].std() / np.sqrt(63)
    assert band.lower == pytest.approx(x.iloc[-63:].mean() - 1.96 * se)
    features = spark.createDataFrame([(d.date(), f"T{i}", "f", float(v)) for d in dates for i, v in enumerate(rng.normal(size=6))], "date date, ticker string, factor string, value double")
    rolled = monitoring.rolling_feature_psi(features, 60, 30).orderBy("date").collect()
    assert [r.date for r in rolled] == [dates[i].date() for i in (60, 90, 120)]
    with pytest.raises(ValueError):
        monitoring.monitoring_report(ic.limit(20))
    with pytest.raises(ValueError):
        monitoring.rolling_feature_psi(features, 150)


def test_equal_risk_contributions():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(40, 12))
    cov = a.T @ a / 40 * np.outer(*[rng.uniform(0.5, 3, 12)] * 2)
    w = optimize.erc_weights(cov)
    share = w * (cov @ w)
    assert w.sum() == pytest.approx(1) and np.allclose(share, share.mean(), rtol=1e-5)
    cov[3] = cov[:, 3] = 0
    assert optimize.erc_weights(cov)[3] == 0
    capped = optimize.erc_weights(a.T @ a, 0.1)
    assert capped.max() <= 0.1 + 1e-12 and capped.sum() == pytest.approx(1)
    assert optimize.erc_weights(a.T @ a, 0.05).tolist() == [0.05] * 12


def test_mean_variance_is_optimal():
    rng = np.random.default_rng(4)
    n = 20
    a = rng.normal(size=(60, n))
    cov, alpha, prev = a.T @ a / 60 * 0.04, rng.normal(size=n), np.full(n, 1 / n)
    groups = [(np.arange(5), 0.25), (np.arange(5, 12), 0.35)]
    for penalty in (0.0, 0.5):
        w = optimize.mean_variance(alpha, cov, 8.0, 0.2, 1.0, 0.0, groups, prev, penalty)
        value = lambda w: alpha @ w - 4.0 * w @ cov @ w - penalty * np.abs(w - prev).sum()
        assert abs(w.sum() - 1) < 1e-6 and w.min() >= 0 and w.max() <= 0.2 and w[:5].sum() <= 0.25 + 1e-6 and w[5:12].sum() <= 0.35 + 1e-6
        for _ in range(3000):  # no feasible exchange between two names is better
            i, j = rng.choice(n, 2, replace=False)
            step = rng.uniform(0, 0.02)
            v = w.copy()
            v[i] += step
            v[j] -= step
            if v.min() >= 0 and v.max() <= 0.2 and v[:5].sum() <= 0.25 and v[5:12].sum() <= 0.35:
                assert value(v) <= value(w) + 1e-6
    assert optimize.mean_variance(alpha, cov, 8.0, 0.01, 1.0, 0.0) is None
    x = rng.normal(size=(300, 5)) * [1, 2, 3, 1, 2]
    x0 = x - x.mean(axis=0)
    s = x0.T @ x0 / 300
    mu = np.trace(s) / 5
    d2 = ((s - mu * np.eye(5)) ** 2).sum() / 5
    b2 = min(d2, sum(((np.outer(r, r) - s) ** 2).sum() for r in x0) / 300**2 / 5)
    assert np.allclose(optimize.ledoit_wolf(x), b2 / d2 * mu * np.eye(5) + (1 - b2 / d2) * s)


def test_books_of_many_names():
    """Ten thousand names, whose covariance would take 800 MB: variances from 1e-8 to 400, names without a specific risk."""
    rng = np.random.default_rng(8)
    n, k = 10_000, 6
    x, styles = np.hstack([np.ones((n, 1)), rng.normal(size=(n, k - 1))]), np.diag(rng.uniform(1e-5, 1e-3, k))
    specific = np.where(rng.random(n) < 0.02, 0.0, rng.lognormal(0, 1.0, n))
    cov = optimize.structured(x, styles, specific)
    tracemalloc.start()
    began = time.process_time()
    w = optimize.erc_weights(cov)
    share = w * (cov @ w)
    assert w.sum() == pytest.approx(1) and np.allclose(share, share.mean(), rtol=1e-6)
    alpha, sectors = np.clip(rng.normal(size=n), -3, 3), rng.integers(0, 5, n)
    w = optimize.mean_variance(alpha, cov, 8.0, 0.2, 1.0, 0.0, [(np.nonzero(sectors == s)[0], 0.35) for s in range(5)])
    assert time.process_time() - began < 60 and tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    held = np.bincount(sectors, w, 5)
    assert abs(w.sum() - 1) < 1e-9 and w.min() >= 0 and w.max() <= 0.2 and held.max() <= 0.35 + 1e-9
    slope = alpha - 8.0 * (cov @ w)  # within each sector no name that could give is worse than one that could take
    for s in range(5):
        own = sectors == s
        assert slope[own & (w < 0.2 - 1e-7)].max() <= slope[own & (w > 1e-7)].min() + 1e-4
    small = rng.choice(n, 60, replace=False)
    part, dense = cov.part(small), x[small] @ (252 * styles) @ x[small].T + np.diag(specific[small] ** 2 + 1e-8)
    assert np.allclose(optimize.erc_weights(part), optimize.erc_weights(dense), rtol=1e-6)
    for low, total in ((0.0, 1.0), (-0.2, 0.0)):
        assert np.allclose(optimize.mean_variance(alpha[small], part, 8.0, 0.2, total, low), optimize.mean_variance(alpha[small], dense, 8.0, 0.2, total, low), atol=1e-6)


def test_books(spark):
    rng = np.random.default_rng(6)
    rows = []
    for d in (1, 2, 3):
        cov = np.diag([1e-4, 2e-4])
        for i in range(12):
            rows.append((datetime.date(2020, 1, d), f"T{i:02d}", float(rng.normal()), 1.0, float(rng.normal()), 0.2 + 0.01 * i, cov.ravel().tolist(), f"S{i % 3}"))
    df = spark.createDataFrame(rows, "date date, ticker string, value double, market double, beta double, specific double, styles_cov array<double>, sector string")
    for penalty in (0.0, 0.05):
        book = optimize.mean_variance_book(df, ["market", "beta"], max_weight=0.3, sector_cap=0.6, penalty=penalty).toPandas()
        assert np.allclose(book.groupby("date").weight.sum(), 1) and book.weight.max() <= 0.3 + 1e-6
    short = optimize.mean_variance_book(df, ["market", "beta"], max_weight=0.3, side="long_short").toPandas()
    assert np.allclose(short.groupby("date").weight.sum(), 0, atol=1e-6) and np.allclose(short.weight.abs().groupby(short.date).sum(), 2)
    few = optimize.mean_variance_book(df.filter("ticker < 'T05'"), ["market", "beta"], fallback_n=2).toPandas()
    assert sorted(few.groupby("date").weight.max()) == [0.5] * 3
    erc = optimize.erc_book(df, ["market", "beta"], None).toPandas()
    assert np.allclose(erc.groupby("date").weight.sum(), 1)


def test_folds():
    folds = training.PurgedWalkForwardCV(6, 10, min_train=504).split(1200)
    assert [f.test[0] for f in folds] == [504 + 116 * k for k in range(6)] and folds[-1].test[1] == 1200
    assert all(f.train == ((0, f.test[0] - 10),) and f.n_purged == 10 for f in folds)
    kfold = training.PurgedWalkForwardCV(3, 10, 5, 100, "purged_kfold").split(400)
    assert kfold[0].train == ((0, 90), (205, 400)) and kfold[-1].train == ((0, 290),)
    for bad in ({"n_splits": 1}, {"mode": "other"}):
        with pytest.raises(ValueError):
            training.PurgedWalkForwardCV(**bad)
    with pytest.raises(ValueError):
        training.PurgedWalkForwardCV().split(600)


def test_ridge_and_pipeline(spark, tmp_path):
    rng = np.random.default_rng(9)
    days, names = 220, 12
    x = rng.normal(size=(days, names, 3))
    y = x @ [0.02, -0.01, 0.0] + rng.normal(0, 0.03, (days, names))
    start = datetime.date(2020, 1, 1)
    rows = [(start + datetime.timedelta(d), f"T{i}", *map(float, x[d, i]), float(y[d, i])) for d in range(days) for i in range(names)]
    df = spark.createDataFrame(rows, "date date, ticker string, a double, b double, c double, label double")
    cv = training.PurgedWalkForwardCV(2, 10, min_train=120)
    models = [training.RidgeAlphaModel(), training.BoostedTreesAlphaModel(rounds=5, depth=2, least=10)]
    result = training.TrainingPipeline(models, cv, str(tmp_path / "run")).run(df, ["a", "b", "c"])
    got = result.predictions.toPandas()
    for k, fold in enumerate(cv.split(days)):
        n = fold.train[0][1]
        n -= max(int(n * 0.15), 20)
        xx, yy = x[:n].reshape(-1, 3), y[:n].ravel()
        xc, yc = xx - xx.mean(axis=0), yy - yy.mean()
        beta = np.linalg.solve(xc.T @ xc + 10 * np.eye(3), xc.T @ yc)
        mine = got[got.fold == k].sort_values(["date", "ticker"])
        want = [yy.mean() + (x[(r.date - start).days, int(r.ticker[1:])] - xx.mean(axis=0)) @ beta for r in mine.itertuples()]
        assert np.allclose(mine.ridge, want, atol=1e-9) and len(mine) == (fold.test[1] - fold.test[0]) * names
    summary = {r.model: r for r in result.ic_summary().collect()}
    assert summary["ridge"].ic_mean > 0.25 and set(summary) == {"ridge", "boosted_trees", "ensemble", "ensemble_causal"}
    ranks = got.groupby("date")[["ridge", "boosted_trees"]].rank(pct=True)
    assert np.allclose(got.ensemble, ranks.mean(axis=1))
    label = got.groupby("date").label.rank(pct=True)
    weight = {m: max(0.0, np.mean([np.corrcoef(ranks[m][g.index], label[g.index])[0, 1] for _, g in got[got.fold == 0].groupby("date")])) for m in ranks}
    late = got.fold == 1
    assert np.allclose(got.ensemble_causal[~late], ranks[~late].mean(axis=1)) and np.allclose(got.ensemble_causal[late], sum(ranks[m][late] * w for m, w in weight.items()) / sum(weight.values()))
    result.save(str(tmp_path / "saved"))
    again = training.TrainingPipeline(models, cv, str(tmp_path / "run")).run(df, ["a", "b", "c"])  # folds are there already
    assert again.predictions.count() == len(got) and again.importances == {}
    assert abs(sum(result.importances["ridge"].values()) - 1) < 1e-9
    if not training.sequence_model_available():
        with pytest.raises(ImportError):
            training.SequenceAlphaModel()
