"""Plans against DuckDB on the smallest tables, and mechanics on hand-made panels."""

import datetime
import math
import os

import duckdb
import numpy as np
import pytest

from tidemark.operators import factors
from tidemark.operators.backtest import BacktestConfig, run_backtest
from tidemark.plans import blocks, catalog
from tidemark.functions.dialect import SPARK, doubles
from tidemark.sources import panels

SF = "/root/testdata/sf0.001"
SOME = ["panel_dense", "factor_mom_21", "factor_rsi_14", "factor_idio_vol_21", "factor_ep", "xs_sector_demean", "quality_report", "bt_turnover", "bt_daily_returns", "perf_cornish_fisher", "mon_cusum", "inc_merge", "eval_turnover", "risk_episodes", "rm_exposures"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: "null" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = duck.execute(catalog.SQL[name])
    assert sorted(df.columns) == sorted(d[0] for d in got.description)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows([d[0] for d in got.description], got.fetchall())


def _bars(spark, days, tickers=("A", "B"), skip=()):
    start = datetime.date(2020, 1, 1)
    rows = []
    for i in range(days):
        for k, t in enumerate(tickers):
            if (i, t) not in skip:
                c = 100.0 * math.exp(0.01 * math.sin(i * (k + 1)) + 0.001 * i * (k + 1))
                rows.append((start + datetime.timedelta(i), t, c, c * 1.01, c * 0.99, 1e6 + 1e4 * (i % 7)))
    return spark.createDataFrame(rows, "date date, ticker string, close double, high double, low double, volume double")


def test_gap_gives_zero_return_and_duplicates_raise(spark):
    bars = _bars(spark, 6, skip={(3, "A")})
    panel = panels.from_long(bars)
    got = {r.t: r for r in panel.filter("ticker = 'A'").collect()}
    assert got[4].close is None and got[4].ret == 0.0 and got[1].ret is None
    assert got[5].ret == pytest.approx(got[5].close / got[3].close - 1)
    with pytest.raises(ValueError):
        panels.from_long(bars.unionByName(bars))


def test_truncation_leaves_earlier_factors_alone(spark):
    names = list(n for n in factors.REGISTRY if not factors.get_factor(n).needs_fundamentals)
    values = []
    for days in (320, 300):
        panels.from_long(_bars(spark, days)).createOrReplaceTempView("panel")
        rows = spark.sql(doubles(factors.layered("panel", names))).filter("t between 280 and 300").collect()
        values.append({(r.ticker, r.t): [r[n] for n in names] for r in rows})
    assert values[0].keys() == values[1].keys()
    for k, a in values[0].items():
        assert a == pytest.approx(values[1][k], rel=1e-9, nan_ok=True), k


def test_momentum_by_hand(spark):
    panels.from_long(_bars(spark, 30)).createOrReplaceTempView("panel")
    rows = {r.t: r for r in spark.sql("SELECT * FROM panel WHERE ticker = 'B'").collect()}
    got = {r.t: r.mom_21 for r in spark.sql(doubles(factors.layered("panel", ["mom_21"]))).filter("ticker = 'B'").collect()}
    assert got[21] is None and got[22] == pytest.approx(rows[22].close / rows[1].close - 1)


def test_trade_is_a_row_after_the_signal(spark):
    panel = panels.from_long(_bars(spark, 70, ("A", "B")))
    signal = panel.selectExpr("date", "ticker", "CASE WHEN ticker = 'A' THEN 1.0 ELSE 0.0 END AS value")

    def only_a(rows):
        return rows.filter("ticker = 'A'").selectExpr("date", "ticker", "1.0D AS weight")

    config = BacktestConfig(rebalance="MS", min_dollar_vol_musd=0.0, benchmark=None, exclude=())
    daily = run_backtest(panel, signal, config, constructor=only_a).daily.orderBy("t").collect()
    ret = {r.t: r.ret for r in panel.filter("ticker = 'A'").collect()}
    assert daily[0].t == 31 + 2 and daily[0].gross == pytest.approx(ret[33]) and daily[0].cost == pytest.approx(10 / 1e4)
    assert daily[1].net == pytest.approx(ret[34] * (1 + ret[33]))


def test_plans_read_the_panel_once_and_exchange_little(spark):
    df = catalog.QUERIES["bt_summary"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("CartesianProduct") == 0 and "lineitem" not in plan
    df = catalog.QUERIES["factor_library_all"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 6, plan.count("Exchange hashpartitioning")


def test_registry_errors():
    with pytest.raises(KeyError):
        factors.get_factor("none")
    with pytest.raises(ValueError):
        factors.register(factors.get_factor("mom_21"))
    with pytest.raises(ValueError):
        blocks.top_n("x", weighting="other")
    assert len(factors.list_factors()) == 27


def test_newey_west_of_many_dates(spark, monkeypatch):
    n = 3600
    x = np.convolve(np.random.default_rng(4).normal(0.05, 1, n + 19), np.ones(20) / 20, "valid")
    e, lag = x - x.mean(), int(4 * (n / 100) ** (1 / 3))
    v = e @ e / n + sum(2 * (1 - k / (lag + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lag + 1))
    spark.createDataFrame(list(enumerate(x.tolist())), "t long, x double").createOrReplaceTempView("long_series")
    got = spark.sql(blocks.newey_west("SELECT * FROM long_series", lags=blocks.newey_west_lags(n))).first()
    assert lag == 13 and got.n == n and abs(got.tstat - x.mean() / np.sqrt(v / n)) < 1e-6
    spark.createDataFrame([(i,) for i in range(1, n + 1)], "t long").createOrReplaceTempView("long_dates")
    monkeypatch.setattr(catalog, "panel_view", lambda *_: "long_dates")
    for name in catalog.LAGGED:
        texts = []
        monkeypatch.setitem(catalog.PLANS, name, (lambda d, lags=12, f=catalog.PLANS[name][0]: texts.append(f(d, lags)) or "SELECT 1 AS one", "brand_week"))
        catalog.run(spark, "/root/testdata/sf0.001", name)
        assert "lag(e, 13)" in str(texts[0])


def test_equal_ranks_have_no_correlation(spark):
    """A constant factor's ranks are equal however many partial deviations Spark merges."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(was, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        rows = "SELECT concat('T', n) AS ticker, date_add(DATE '2020-01-01', CAST(t AS INT)) AS date, t, {} AS {} FROM (SELECT id % 203 AS n, id div 203 AS t FROM range(12180)) AS r"
        flat = spark.sql(blocks.rank_ic(rows.format("0e0", "value"), rows.format("CAST(xxhash64(n, t) AS DOUBLE)", "fwd")))
        assert flat.count() == 60 and flat.filter("ic IS NOT NULL").isEmpty()
        turned = spark.sql(blocks.rank_ic(rows.format("CAST(xxhash64(n, t) AS DOUBLE)", "value"), rows.format("0e0", "fwd")))
        assert turned.count() == 60 and turned.filter("ic IS NOT NULL").isEmpty()
        same = spark.sql(blocks.rank_ic(rows.format("CAST(n AS DOUBLE)", "value"), rows.format("CAST(n AS DOUBLE)", "fwd")))
        assert [r.ic for r in same.collect()] == pytest.approx([1.0] * 60)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
