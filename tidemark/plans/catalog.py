"""Named plans over the derived panels: Spark queries and, in the other dialect, their oracles."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.dialect import DUCKDB, SPARK, Dialect, average_rank, doubles, lag, lead, roll, safe_div, trailing
from tidemark.operators.factors import REGISTRY
from tidemark.sources import panels
from tidemark.storage import stage

from . import blocks as b

#: A plan's text, or tables that it computes once (name, text) and the text over them.
Text = str | tuple[list[tuple[str, str]], str]
Plan = Callable[[Dialect], Text]
PLANS: dict[str, tuple[Plan, str]] = {}
#: Plans whose text depends on the panel's number of dates; their oracles hold for fewer than 3,433 dates.
LAGGED = ("eval_newey_west", "eval_summary", "scale_evaluation")
_PANELS: dict[tuple, str] = {}


def plan(name: str, kind: str = "brand_week"):
    def wrap(f: Plan) -> Plan:
        PLANS[name] = (f, kind)
        return f

    return wrap


def add(name: str, f: Plan, kind: str = "brand_week") -> None:
    PLANS[name] = (f, kind)


def panel_view(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """A view of the dense panel, which is computed and written once for each session; queries prune its columns."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _PANELS:
        panels.tables(spark, sf_dir)
        df = stage(spark.sql(f"WITH {panels.dense_ctes(SPARK, panels.bars_sql(kind))} SELECT * FROM panel"), f"panel-{kind}")
        _PANELS[key] = f"panel_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(_PANELS[key])
    return _PANELS[key]


def panel(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return spark.table(panel_view(spark, sf_dir, kind))


def _parts(text: Text) -> tuple[list[tuple[str, str]], str]:
    return ([], text) if isinstance(text, str) else text


def evaluate(spark: SparkSession, text: Text, views: dict[str, str]) -> DataFrame:
    """Run a plan's text over views; tables that it names are computed once and staged."""
    lets, text = _parts(text)
    views = dict(views)

    def named(x: str) -> str:
        return doubles(re.sub(r"\b(" + "|".join(views) + r")\b", lambda m: views[m[0]], x) if views else x)

    for name, x in lets:
        df = stage(spark.sql(named(x)), name.replace("_", "-"))
        view = f"{name}_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        views[name] = view
    return spark.sql(named(text))


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    f, kind = PLANS[name]
    panels.tables(spark, sf_dir)
    views = {"panel": panel_view(spark, sf_dir, kind)} if kind else {}
    if name in LAGGED:
        dates = spark.sql(f"SELECT max(t) FROM {views['panel']}").first()[0] or 0
        return evaluate(spark, f(SPARK, b.newey_west_lags(dates)), views)
    return evaluate(spark, f(SPARK), views)


def oracle(name: str) -> str:
    f, kind = PLANS[name]
    lets, text = _parts(f(DUCKDB))
    ctes = [panels.dense_ctes(DUCKDB, panels.bars_sql(kind))] if kind else []
    ctes += [f"{n} AS MATERIALIZED ({x})" for n, x in lets]
    return doubles(f"WITH {', '.join(ctes)} SELECT * FROM ({text}) AS result" if ctes else text)


def r(x: str, n: int = 6, name: str | None = None) -> str:
    """Rounded; adding 0 makes a negative zero a plain one."""
    return f"round({x}, {n}) + 0.0 AS {name or x}"


# --- panel ---------------------------------------------------------------------------------------------------------
add("panel_bars", lambda d: f"SELECT ticker, date, {r('high', 9)}, {r('low', 9)}, {r('close', 9)}, volume FROM panel WHERE close IS NOT NULL")
add("panel_dense", lambda d: f"SELECT ticker, date, t, {r('open', 9)}, {r('close', 9)}, {r('ff', 9)} FROM panel", "nation_day")
add("panel_returns", lambda d: f"SELECT ticker, date, {r('ret')} FROM panel", "nation_day")
add("panel_log_returns", lambda d: f"SELECT ticker, date, {r('ln(close / nullif(' + lag('close', 1) + ', 0))', 6, 'log_ret')} FROM panel", "nation_day")
add("panel_dollar_volume", lambda d: f"SELECT ticker, date, {r('dv', 2)} FROM panel")
add("panel_slice_dates", lambda d: f"SELECT ticker, date, {r('ret')} FROM panel WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
add("panel_restrict_tickers", lambda d: f"SELECT ticker, date, {r('ret')} FROM panel WHERE ticker IN ('Brand#2', 'Brand#3', 'None')")


@plan("panel_coverage", "nation_day")
def _(d):
    return f"""SELECT ticker, count(close) AS n_days, min(CASE WHEN close IS NOT NULL THEN date END) AS first_date, max(CASE WHEN close IS NOT NULL THEN date END) AS last_date,
      round(count(close) / CAST(count(*) AS DOUBLE), 6) AS pct_available, round(avg(close), 4) AS avg_close, round(avg(dv), 2) AS avg_dollar_volume FROM panel GROUP BY ticker"""


# --- factors -------------------------------------------------------------------------------------------------------
for _name in REGISTRY:
    add(f"factor_{_name}", lambda d, n=_name: f"SELECT ticker, date, {r(n, 6, 'value')} FROM ({b.factors([n])}) AS f")
add("factor_library_all", lambda d: f"SELECT ticker, date, {', '.join(r(n, 5) for n in REGISTRY)} FROM ({b.factors(list(REGISTRY))}) AS f WHERE t > {b.warm()}")
add("factor_composite_equal", lambda d: f"SELECT ticker, date, {r('value')} FROM ({b.composite(d)}) AS c")
add("factor_composite_weighted", lambda d: f"SELECT ticker, date, {r('value')} FROM ({b.composite(d, weights=dict(zip(b.SIGNAL, (0.4, 0.3, 0.1, 0.1, 0.1), strict=True)))}) AS c")
add("factor_composite_directed", lambda d: f"SELECT ticker, date, {r('value')} FROM ({b.composite(d, signs={'rev_5': -1, 'vol_21': -1})}) AS c")

# --- time series primitives ----------------------------------------------------------------------------------------
add("ts_shift", lambda d: f"SELECT ticker, date, {r(lag('close', 3), 6, 'back3')}, {r(lead('close', 2), 6, 'ahead2')} FROM panel")
add("ts_rolling_basic", lambda d: f"SELECT ticker, date, {r(roll('avg', 'ret', 10), 6, 'mean10')}, {r(roll('max', 'close', 10, 5), 9, 'max10')}, {r(roll('sum', 'volume', 10), 2, 'sum10')} FROM panel", "nation_day")
add("ts_rolling_quantile", lambda d: f"SELECT ticker, date, round({roll(d.percentile('{x}', 0.05), 'ret', 63)}, 6) AS q05 FROM panel")
add("ts_rolling_product", lambda d: f"SELECT ticker, date, round(CASE WHEN count(ret) OVER ({trailing(5)}) = 5 THEN {b.compounded('ret', trailing(5))} - 1 END, 6) AS ret5 FROM panel")
add("ts_tstat", lambda d: f"SELECT ticker, date, {r('mom_slope', 5, 'tstat')} FROM ({b.factors(['mom_slope'])}) AS f")
add("ts_skew_nested", lambda d: f"SELECT ticker, date, {r('skew_63', 6, 'skew')} FROM ({b.factors(['skew_63'])}) AS f")
add("ts_ewm_wilder", lambda d: f"SELECT ticker, date, {r('rsi_14', 5, 'rsi')} FROM ({b.factors(['rsi_14'])}) AS f", "nation_day")
add("ts_trailing_beta", lambda d: f"SELECT ticker, date, {r('beta')} FROM ({b.trailing_beta()}) AS f")
add("ts_idio_vol", lambda d: f"SELECT ticker, date, round({roll('stddev_samp', 'x', 63, 31)}, 6) AS iv FROM (SELECT *, ret - avg(ret) OVER (PARTITION BY date) AS x FROM panel) AS f")


@plan("ts_ewm_var")
def _(d):
    run = "PARTITION BY ticker ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    s = {k: f"sum({e}) OVER ({run})" for k, e in {"sw": "w", "sw2": "w * w", "sx": "w * ret", "sxx": "w * ret * ret"}.items()}
    return f"""SELECT ticker, date, round(CASE WHEN n >= 21 THEN (sxx / sw - power(sx / sw, 2)) * sw * sw / nullif(sw * sw - sw2, 0) END, 5) AS var FROM (
      SELECT ticker, date, count(ret) OVER ({run}) AS n, {', '.join(f'{e} AS {k}' for k, e in s.items())}
      FROM (SELECT *, CASE WHEN ret IS NOT NULL THEN power(0.5, -t / 63.0) END AS w FROM panel) AS x) AS y"""


# --- cross-section primitives --------------------------------------------------------------------------------------
_ONE = "SELECT ticker, date, t, mom_21 AS value FROM ({}) AS o"


def one(name: str = "mom_21") -> str:
    return f"SELECT ticker, date, t, {name} AS value FROM ({b.factors([name])}) AS o"


add("xs_winsorize", lambda d: f"SELECT ticker, date, {r('w', 6, 'value')} FROM ({b.winsorize(d, one())}) AS x")
add("xs_zscore", lambda d: f"SELECT ticker, date, round({b.zscore('value')}, 6) AS z FROM ({one()}) AS x")
add("xs_rank_pct", lambda d: f"SELECT ticker, date, round({average_rank('value', 'date')} / count(*) OVER (PARTITION BY date), 6) AS pct FROM ({one()}) AS x WHERE value IS NOT NULL")
add("xs_quantiles", lambda d: f"SELECT ticker, date, CAST(least(ceil({average_rank('value', 'date')} * 5 / count(*) OVER (PARTITION BY date)), 5) AS INTEGER) AS bucket FROM ({one()}) AS x WHERE value IS NOT NULL")
add("xs_winsorize_robust", lambda d: f"SELECT ticker, date, {r('value', 6, 'z')} FROM ({b.robust(d, one())}) AS x")
add("xs_sector_demean", lambda d: f"SELECT ticker, date, {r('value')} FROM ({b.sector_demeaned(one())}) AS x")
add("xs_beta_residual", lambda d: f"SELECT ticker, date, {r('value')} FROM ({b.beta_residual(one(), b.trailing_beta())}) AS x")


def vol_scaled(source: str) -> str:
    iv = f"SELECT ticker, date, {roll('stddev_samp', 'x', 63, 31)} AS iv FROM (SELECT *, ret - avg(ret) OVER (PARTITION BY date) AS x FROM panel) AS v0"
    return f"SELECT s.ticker, s.date, s.t, s.value / CASE WHEN v.iv IS NOT NULL THEN greatest(v.iv, 0.005) END AS value FROM ({source}) AS s JOIN ({iv}) AS v ON s.ticker = v.ticker AND s.date = v.date"


add("xs_vol_scale", lambda d: f"SELECT ticker, date, {r('value')} FROM ({vol_scaled(one())}) AS x")
add("neutralizer_full", lambda d: f"SELECT ticker, date, {r('value', 5)} FROM ({b.beta_residual(b.sector_demeaned(b.robust(d, vol_scaled(b.robust(d, one())))), b.trailing_beta())}) AS x")

# --- evaluation ----------------------------------------------------------------------------------------------------
EVAL = ("mom_21", "mom_63", "rev_5", "vol_21", "bb_pos", "sma_ratio_50", "atr_21", "vol_trend")
add("eval_forward_returns", lambda d: f"SELECT ticker, date, {r('fwd')} FROM ({b.forward(5)}) AS x")
add("eval_ic_series", lambda d: f"SELECT date, n, {r('ic')} FROM ({b.rank_ic(one(), b.forward(5), d=d)}) AS x")


def ics(d, names=b.ALL, h=5):
    return b.rank_ic(b.long_factors(names), b.forward(h), by="date, factor", d=d)


@plan("eval_newey_west")
def _(d, lags=12):
    return [("ic_table", ics(d))], f"SELECT factor, n, {r('mean', 6)}, {r('tstat', 5)} FROM ({b.newey_west('SELECT * FROM ic_table', 'ic', 'factor', lags)}) AS x"


@plan("eval_top5")
def _(d):
    return f"""SELECT factor, CAST(sign(m) AS INTEGER) AS direction, round(abs(m / s), 5) AS strength FROM (
      SELECT factor, avg(ic) AS m, stddev_samp(ic) AS s FROM ({ics(d)}) AS a GROUP BY factor) AS g ORDER BY abs(m / s) DESC, factor LIMIT 5"""


@plan("eval_quantile_returns")
def _(d):
    return f"SELECT date, bucket, {r('mean_return')}, n FROM ({b.quantile_returns(one())}) AS x"


@plan("eval_turnover")
def _(d):
    return f"SELECT round(turnover, 6) AS turnover, periods FROM ({b.leg_turnover(d, _NAMED)}) AS x"


_NAMED = "SELECT ticker, date, t, 'mom_21' AS factor, value FROM (" + one() + ") AS n0"


@plan("eval_summary")
def _(d, lags=12):
    """Every statistic of every factor after the warm-up, best absolute information ratio first."""
    names = "ic_mean ic_std ic_ir tstat positive_rate turnover spread_ann spread_sharpe monotonicity".split()
    lets, text = b.evaluation(d, b.after_warm_up(b.ALL), f"SELECT t FROM panel WHERE t > {b.warm()}", lags=lags)
    return lets, f"SELECT factor, n_obs, {', '.join(r(n, 5) for n in names)} FROM ({text}) AS e ORDER BY abs(e.ic_ir) DESC, factor"


@plan("eval_ic_decay")
def _(d):
    return f"SELECT horizon, {r('mean_ic')}, n FROM ({b.ic_decay(one(), (1, 3, 5, 10, 15, 21, 42, 63), d=d)}) AS x"


# --- universe and quality ------------------------------------------------------------------------------------------
def pit(d: Dialect, season: int = 0) -> str:
    start = "date_add(DATE '1995-01-30', 14 * no)" if d.spark else "CAST(DATE '1995-01-30' + CAST(14 * no AS INTEGER) AS DATE)"
    added = f"""SELECT ticker, CASE WHEN no % 10 = 0 THEN NULL WHEN no % 2 = 1 THEN DATE '1990-01-01' ELSE {start} END AS added
      FROM (SELECT DISTINCT p_brand AS ticker, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS no FROM part) AS n"""
    return f"""SELECT p.ticker, p.date, p.t, CASE WHEN p.ticker <> '{b.BENCHMARK}' AND p.date >= coalesce(greatest(coalesce(x.added, s.first_date), s.first_date), DATE '1900-01-01')
        AND p.date BETWEEN s.first_date AND s.last_date AND p.t >= s.first_t + {season} THEN TRUE ELSE FALSE END AS is_member
      FROM panel AS p LEFT JOIN ({added}) AS x ON p.ticker = x.ticker
      JOIN (SELECT ticker, min(CASE WHEN close IS NOT NULL THEN date END) AS first_date, max(CASE WHEN close IS NOT NULL THEN date END) AS last_date,
            min(CASE WHEN close IS NOT NULL THEN t END) AS first_t FROM panel GROUP BY ticker) AS s ON p.ticker = s.ticker"""


add("pit_members", lambda d: f"SELECT ticker, date, is_member FROM ({pit(d)}) AS m")
add("pit_members_seasoned", lambda d: f"SELECT ticker, date, is_member FROM ({pit(d, 26)}) AS m")
add("pit_counts", lambda d: f"SELECT date, count(CASE WHEN is_member THEN 1 END) AS members FROM ({pit(d)}) AS m GROUP BY date")
add("pit_coverage_at", lambda d: f"SELECT ticker FROM ({pit(d)}) AS m WHERE is_member AND t = (SELECT max(t) FROM panel WHERE date <= DATE '1997-03-05')")


@plan("pit_additions_by_year")
def _(d):
    return f"""SELECT CAST(extract(year FROM date) AS INTEGER) AS year, count(*) AS additions FROM (
      SELECT *, lag(is_member, 1) OVER (PARTITION BY ticker ORDER BY t) AS before FROM ({pit(d)}) AS m) AS x WHERE is_member AND NOT before GROUP BY CAST(extract(year FROM date) AS INTEGER)"""


@plan("pit_summary")
def _(d):
    return f"""SELECT {d.min_by('n', 't')} AS first_members, {d.max_by('n', 't')} AS last_members, min(n) AS min_members, max(n) AS max_members, round(avg(n), 1) AS mean_members
      FROM (SELECT t, count(CASE WHEN is_member THEN 1 END) AS n FROM ({pit(d)}) AS m GROUP BY t) AS x"""


add("universe_sector_counts", lambda d: f"SELECT sector, count(*) AS n FROM ({b.SECTORS}) AS s GROUP BY sector", "")
add("universe_dummies", lambda d: "SELECT ticker, " + ", ".join(f"CASE WHEN sector = 'S{i}' THEN 1.0 ELSE 0.0 END AS s{i}" for i in range(5)).replace("1.0", "CAST(1 AS DOUBLE)").replace("0.0", "CAST(0 AS DOUBLE)") + f" FROM ({b.SECTORS}) AS s", "")


def check(name: str, severity: str, n: str, bad: str = "> 0") -> str:
    return f"SELECT '{name}' AS name, '{severity}' AS severity, CAST(coalesce(({n}), 0) AS BIGINT) AS n_flagged, coalesce(({n}), 0) = 0 AS passed"


def _stale() -> str:
    return f"""SELECT count(*) FROM (SELECT ticker FROM (SELECT ticker, grp, count(*) AS run FROM (
      SELECT ticker, sum(CASE WHEN close = before THEN 0 ELSE 1 END) OVER ({trailing(None)}) AS grp FROM (SELECT *, {lag('close', 1)} AS before FROM panel) AS a WHERE close IS NOT NULL) AS c
      GROUP BY ticker, grp) AS e GROUP BY ticker HAVING max(run) >= 10) AS f"""


CHECKS = {
    "duplicates": ("error", f"SELECT sum(n) FROM (SELECT count(*) AS n FROM ({panels.FEED}) AS feed GROUP BY ticker, date HAVING count(*) > 1) AS x"),
    "non_positive": ("error", "SELECT sum(CASE WHEN open <= 0 THEN 1 ELSE 0 END + CASE WHEN high <= 0 THEN 1 ELSE 0 END + CASE WHEN low <= 0 THEN 1 ELSE 0 END + CASE WHEN close <= 0 THEN 1 ELSE 0 END) FROM panel"),
    "ohlc_consistency": ("error", "SELECT sum(CASE WHEN high < low * (1 - 5e-4) THEN 1 ELSE 0 END + CASE WHEN close > high * (1 + 5e-4) OR close < low * (1 - 5e-4) THEN 1 ELSE 0 END) FROM panel"),
    "stale_prices": ("warning", _stale()),
    "extreme_returns": ("info", "SELECT count(*) FROM panel WHERE abs(ret) > 0.30"),
    "coverage_gaps": ("warning", "SELECT count(*) FROM (SELECT ticker FROM panel GROUP BY ticker HAVING count(close) < 0.95 * count(*)) AS x"),
    "zero_volume": ("info", "SELECT count(*) FROM panel WHERE close IS NOT NULL AND coalesce(volume, 0) = 0"),
}
for _name, (_severity, _sql) in CHECKS.items():
    add(f"quality_{_name}", lambda d, n=_name, s=_severity, q=_sql: check(n, s, q), "nation_day")
add("quality_report", lambda d: " UNION ALL ".join(check(n, s, q) for n, (s, q) in CHECKS.items()), "nation_day")
add("quality_extreme_detail", lambda d: f"SELECT ticker, date, {r('ret')} FROM panel WHERE abs(ret) > 0.30", "nation_day")

# --- portfolio engine ----------------------------------------------------------------------------------------------


def signal(d: Dialect) -> str:
    return b.masked_composite(d)


SIGNAL = "SELECT * FROM signal_table"
add("bt_tradable", lambda d: f"SELECT ticker, date, ok FROM ({b.tradable()}) AS m")
for _every in ("MS", "W-FRI", "W-MON", "D"):
    add(f"bt_rebalance_dates_{_every.replace('-', '_').lower()}", lambda d, e=_every: f"SELECT k, signal_date, trade_t FROM ({b.rebalances(d, one(), e)}) AS m")
for _w in ("equal", "rank", "zscore"):
    add(f"bt_weights_topn_{_w}", lambda d, w=_w: f"SELECT ticker, date, round(weight, 6) AS weight FROM ({b.top_n(signal(d), 5, 'long_short', w)}) AS m WHERE abs(weight) > 1e-9")
add("bt_weights_quantile", lambda d: f"SELECT ticker, date, round(weight, 6) AS weight FROM ({b.quantile_book(signal(d))}) AS m")
add("bt_weights_zblend", lambda d: f"SELECT ticker, date, round(weight, 6) AS weight FROM ({b.zscore_book(signal(d))}) AS m")


def sim(d: Dialect, text: str, cost: str = "linear", side: str = "long", source: str = "") -> Text:
    """The composite's signal, its rebalances and target books, each computed once; ``text`` reads turn and daily."""
    lets = [("signal_table", source or signal(d)), ("reb_table", b.rebalances(d, SIGNAL)), ("target_table", b.targets(b.top_n(SIGNAL, 5, side), "reb_table"))]
    return lets, f"WITH {b.simulated(cost=cost)} {text}"


add("bt_daily_returns", lambda d: sim(d, "SELECT date, k, round(gross, 6) AS gross, round(cost, 6) AS cost, round(net, 6) AS net FROM daily"))
add("bt_daily_returns_long_short", lambda d: sim(d, "SELECT date, k, round(gross, 6) AS gross, round(net, 6) AS net FROM daily", side="long_short"))
add("bt_turnover", lambda d: sim(d, "SELECT k, signal_date, round(turnover, 6) AS turnover FROM turn"))
add("bt_costs_linear", lambda d: sim(d, "SELECT k, round(cost, 8) AS cost FROM turn"))
add("bt_costs_sqrt", lambda d: sim(d, "SELECT k, round(cost, 6) AS cost FROM turn", cost="sqrt"))
add("bt_holdings", lambda d: sim(d, "SELECT k, ticker, round(weight, 6) AS weight FROM target_table WHERE k = (SELECT max(k) FROM target_table WHERE trade_t <= 250)"))
add("bt_benchmark", lambda d: f"SELECT date, round({safe_div('close', lag('close', 1))} - 1, 6) AS ret FROM panel WHERE ticker = '{b.BENCHMARK}'")
add("bt_equity", lambda d: sim(d, f"SELECT date, round(equity, 6) AS equity, round(dd, 6) AS dd FROM ({b.drawdowns('SELECT date, t, net FROM daily')}) AS e"))


@plan("bt_summary")
def bt_summary(d):
    names = "total_return cagr ann_vol sharpe sortino max_drawdown calmar var_95 var_99 hit_rate best worst".split()
    return sim(d, f"SELECT n_days, {', '.join(r(n, 5) for n in names)} FROM ({b.summary(d, 'SELECT date, t, net FROM daily')}) AS e")


# The same over the panel of suppliers, whose names grow with the tables: what is timed against the reference's figures.
PRICED = tuple(n for n in b.ALL if not REGISTRY[n].needs_fundamentals)
add("scale_factors", lambda d: f"SELECT ticker, date, {', '.join(r(n, 5) for n in PRICED)} FROM ({b.factors(PRICED)}) AS f WHERE t > {b.warm()}", "supp_week")
add("scale_evaluation", lambda d, lags=12: (lambda lets, text: (lets, f"SELECT factor, n_obs, {', '.join(r(n, 5) for n in 'ic_mean ic_ir tstat positive_rate turnover spread_ann monotonicity'.split())} FROM ({text}) AS e"))(*b.evaluation(d, b.after_warm_up(PRICED), f"SELECT t FROM panel WHERE t > {b.warm()}", lags=lags)), "supp_week")
add("scale_backtest", lambda d: sim(d, "SELECT date, k, round(gross, 6) AS gross, round(cost, 6) AS cost, round(net, 6) AS net FROM daily", side="long_short", source=b.composite(d)), "supp_week")


# --- performance and risk ------------------------------------------------------------------------------------------
MARKET = "SELECT date, max(t) AS t, avg(ret) AS net FROM panel GROUP BY date"
BENCH = f"SELECT date, t, ret AS net FROM panel WHERE ticker = '{b.BENCHMARK}'"
PAIR = f"SELECT m.date, m.t, m.net AS x, q.net AS y FROM ({MARKET}) AS m JOIN ({BENCH}) AS q ON m.date = q.date WHERE m.net IS NOT NULL AND q.net IS NOT NULL"


def rolled(f: str, x: str, n: int, least: int | None = None) -> str:
    w = trailing(n, by="")
    call = f.format(x=x) if "{x}" in f else f"{f}({x})"
    return f"CASE WHEN count({x}) OVER ({w}) >= {least or n} THEN {call} OVER ({w}) END"


add("perf_monthly", lambda d: f"SELECT CAST(extract(year FROM date) AS INTEGER) AS year, CAST(extract(month FROM date) AS INTEGER) AS month, round({b.compounded('net')} - 1, 6) AS ret FROM ({MARKET}) AS m WHERE net IS NOT NULL GROUP BY CAST(extract(year FROM date) AS INTEGER), CAST(extract(month FROM date) AS INTEGER)")
add("perf_rolling_sharpe", lambda d: f"SELECT date, round({rolled('avg', 'net', 126)} / nullif({rolled('stddev_samp', 'net', 126)}, 0) * sqrt(252), 5) AS sharpe FROM ({MARKET}) AS m")
add("perf_drawdown", lambda d: f"SELECT date, round(dd, 6) AS dd FROM ({b.drawdowns(MARKET)}) AS m")
add("perf_var_cvar", lambda d: f"SELECT round(-q, 6) AS var_95, round(-avg(CASE WHEN net <= q THEN net END), 6) AS cvar_95 FROM (SELECT net, {d.percentile('net', 0.05)} OVER (PARTITION BY one) AS q FROM (SELECT *, 1 AS one FROM ({MARKET}) AS m) AS m1) AS m2 GROUP BY q")
add("perf_var_series", lambda d: f"SELECT date, round(-({rolled(d.percentile('{x}', 0.05), 'net', 252)}), 6) AS var_95 FROM ({MARKET}) AS m")


@plan("perf_cornish_fisher")
def _(d):
    z = "-1.6449"
    return f"""SELECT round(-(mu + sd * (z + (z * z - 1) * s / 6 + (z * z * z - 3 * z) * k / 24 - (2 * z * z * z - 5 * z) * s * s / 36)), 6) AS var_cf FROM (
      SELECT *, {z} AS z, m3 / power(m2, 1.5) * sqrt(n * (n - 1.0)) / (n - 2) AS s, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6) AS k FROM (
        SELECT count(net) AS n, max(mu) AS mu, stddev_samp(net) AS sd, avg(power(net - mu, 2)) AS m2, avg(power(net - mu, 3)) AS m3, avg(power(net - mu, 4)) AS m4
        FROM (SELECT net, avg(net) OVER (PARTITION BY one) AS mu FROM (SELECT *, 1 AS one FROM ({MARKET}) AS m WHERE net IS NOT NULL) AS m1) AS m2) AS m3) AS m4"""


add("perf_alpha_beta", lambda d: f"SELECT round(regr_intercept(x, y) * 252, 6) AS alpha_ann, round(regr_slope(x, y), 6) AS beta, count(*) AS n FROM ({PAIR}) AS p")
add("perf_capture", lambda d: f"SELECT round(avg(CASE WHEN y > 0 THEN x END) / nullif(avg(CASE WHEN y > 0 THEN y END), 0), 6) AS up, round(avg(CASE WHEN y < 0 THEN x END) / nullif(avg(CASE WHEN y < 0 THEN y END), 0), 6) AS down FROM ({PAIR}) AS p")
add("perf_active", lambda d: f"SELECT round(stddev_samp(x - y) * sqrt(252), 6) AS tracking_error, round(avg(x - y) / nullif(stddev_samp(x - y), 0) * sqrt(252), 6) AS information_ratio FROM ({PAIR}) AS p")


@plan("risk_episodes")
def _(d):
    lets, text = b.episodes(d, MARKET)
    return lets, f"SELECT peak_date, trough_date, recovery_date, {r('depth')}, length_days, recovery_days FROM ({text}) AS x"


WINDOWS = [("first", "1995-06-01", "1995-12-31"), ("second", "1998-01-01", "1998-06-30"), ("third", "2000-01-01", "2000-12-31"), ("none", "2020-01-01", "2020-12-31")]


@plan("risk_stress")
def _(d):
    return f"""SELECT w.name, count(m.net) AS n_days, round({b.compounded('m.net')} - 1, 6) AS ret, round(stddev_samp(m.net) * sqrt(252), 6) AS ann_vol, round(min(m.net), 6) AS worst
      FROM {d.rows('name, a, b', WINDOWS)} AS w JOIN ({MARKET}) AS m ON m.date BETWEEN CAST(w.a AS DATE) AND CAST(w.b AS DATE) WHERE m.net IS NOT NULL GROUP BY w.name HAVING count(m.net) >= 5"""


add("risk_rolling", lambda d: f"SELECT date, round({rolled('stddev_samp', 'net', 126)} * sqrt(252), 6) AS vol, round({rolled('avg', 'net', 126)} * 252, 6) AS ret, round(-({rolled(d.percentile('{x}', 0.05), 'net', 126)}), 6) AS var_95 FROM ({MARKET}) AS m")
add("risk_factor_exposure", lambda d: f"SELECT date, round(CASE WHEN count(x) OVER ({trailing(252, by='')}) = 252 THEN regr_slope(x, y) OVER ({trailing(252, by='')}) END, 6) AS beta FROM ({PAIR}) AS p")

# --- risk model ----------------------------------------------------------------------------------------------------


def exposures(d: Dialect) -> str:
    """Beta is sample covariance over sample variance, 252 rows, 126 at least."""
    w = trailing(252)
    return f"""SELECT ticker, date, t, ret, adv, CASE WHEN pairs >= 126 AND seen >= 126 THEN cov / nullif(var, 0) END AS beta, size, momentum, reversal, volatility FROM (
      SELECT ticker, date, t, ret, {roll('avg', 'dv', 21, 5)} AS adv, count(ret * mkt) OVER ({w}) AS pairs, count(mkt) OVER ({w}) AS seen, covar_samp(ret, mkt) OVER ({w}) AS cov, var_samp(mkt) OVER ({w}) AS var,
        -ln(CASE WHEN {roll('avg', 'dv', 21, 10)} IS NOT NULL THEN greatest({roll('avg', 'dv', 21, 10)}, 1) END) AS size,
        ff / nullif({lag('ff', 63)}, 0) - 1 AS momentum, -(ff / nullif({lag('ff', 5)}, 0) - 1) AS reversal, {roll('stddev_samp', 'ret', 21, 15)} AS volatility
      FROM (SELECT *, avg(ret) OVER (PARTITION BY date) AS mkt FROM panel) AS m0) AS m1"""


STYLES = ("beta", "size", "momentum", "reversal", "volatility")
add("rm_exposures", lambda d: f"SELECT ticker, date, {', '.join(r(s, 5) for s in STYLES)} FROM ({exposures(d)}) AS x")


def standardized(d: Dialect) -> str:
    clip = ", ".join(f"CASE WHEN {s} IS NOT NULL THEN least(greatest({s}, {d.percentile(s, 0.025)} OVER (PARTITION BY date)), {d.percentile(s, 0.975)} OVER (PARTITION BY date)) END AS {s}_c" for s in STYLES)
    z = ", ".join(f"({s}_c - avg({s}) OVER (PARTITION BY date)) / CASE WHEN stddev_pop({s}) OVER (PARTITION BY date) > 0 THEN stddev_pop({s}) OVER (PARTITION BY date) ELSE 1.0 END AS z_{s}" for s in STYLES)
    return f"SELECT ticker, date, t, ret, adv, {z} FROM (SELECT *, {clip} FROM ({exposures(d)}) AS x0) AS x1"


add("rm_std_exposures", lambda d: f"SELECT ticker, date, {', '.join(f'round(z_{s}, 5) + 0.0 AS {s}' for s in STYLES)} FROM ({standardized(d)}) AS x")


@plan("rm_factor_returns_one_style")
def _(d):
    """Weighted least squares of same-day returns on an intercept and one style, by weighted moments."""
    return f"""SELECT date, n, round((sw * sxy - sx * sy) / nullif(sw * sxx - sx * sx, 0), 6) AS momentum, round((sy * sxx - sx * sxy) / nullif(sw * sxx - sx * sx, 0), 6) AS market FROM (
      SELECT date, count(*) AS n, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM (
        SELECT date, z_momentum AS x, ret AS y, sqrt(adv) AS w FROM ({standardized(d)}) AS s) AS a
      WHERE x IS NOT NULL AND y IS NOT NULL AND w > 0 GROUP BY date HAVING count(*) >= 10) AS c"""


add("rm_attribution", lambda d: f"SELECT round(regr_intercept(y, x) * 252, 6) AS alpha_ann, round(regr_slope(y, x), 6) AS beta, round(regr_r2(y, x), 6) AS r2, round(regr_slope(y, x) * sum(x), 5) AS factor_pnl FROM ({PAIR}) AS p")

# --- machine learning and monitoring -------------------------------------------------------------------------------
add("ml_features", lambda d: f"SELECT ticker, date, factor, round(coalesce({b.zscore('w', 'date, factor')}, 0), 5) AS value FROM ({b.winsorize(d, b.long_factors(EVAL), 'date, factor')}) AS x")
add("ml_labels", lambda d: f"SELECT ticker, date, round(fwd - avg(fwd) OVER (PARTITION BY date), 6) AS label FROM ({b.forward(5)}) AS x WHERE fwd IS NOT NULL")


@plan("ml_folds")
def _(d):
    """Purged walk-forward folds over the grid: 4 blocks after 157 rows, purge 10."""
    return """SELECT fold, min(t) AS test_start, max(t) AS test_end, min(t) - 10 AS train_end, count(*) AS n FROM (
      SELECT t, least(CAST(floor((t - 158) / 50.0) AS INTEGER), 3) AS fold FROM (SELECT DISTINCT t FROM panel) AS a WHERE t > 157) AS c GROUP BY fold"""


def blend(d: Dialect, names=("mom_21", "bb_pos", "vol_21")) -> str:
    return f"SELECT ticker, date, t, factor, value, {average_rank('value', 'date, factor')} / count(*) OVER (PARTITION BY date, factor) AS pr FROM ({b.long_factors(names)}) AS x WHERE value IS NOT NULL"


add("ml_ensemble_rank", lambda d: f"SELECT ticker, date, round(avg(pr), 6) AS score FROM ({blend(d)}) AS x GROUP BY ticker, date")


@plan("ml_ensemble_causal")
def _(d):
    names = ("mom_21", "bb_pos", "vol_21")
    ic = f"SELECT factor, ic, least(CAST(floor((t - 158) / 50.0) AS INTEGER), 3) AS fold FROM ({ics(d, names)}) AS i WHERE ic IS NOT NULL"
    return f"""SELECT x.ticker, x.date, round(sum(x.pr * w.w) / nullif(sum(w.w), 0), 5) AS score FROM (SELECT *, least(CAST(floor((t - 158) / 50.0) AS INTEGER), 3) AS fold FROM ({blend(d, names)}) AS y WHERE t > 157) AS x
      JOIN (SELECT f.fold, i.factor, CASE WHEN f.fold = 0 OR sum(greatest(avg(i.ic), 0)) OVER (PARTITION BY f.fold) <= 0 THEN 1.0 ELSE greatest(avg(i.ic), 0) END AS w
            FROM {d.rows('fold', [(0,), (1,), (2,), (3,)])} AS f JOIN ({ic}) AS i ON i.fold < f.fold OR f.fold = 0 GROUP BY f.fold, i.factor) AS w ON x.fold = w.fold AND x.factor = w.factor
      GROUP BY x.ticker, x.date"""


def known_ics(d: Dialect) -> str:
    return f"SELECT date, t, ic FROM ({b.rank_ic(one(), b.forward(5), d=d)}) AS i0 WHERE ic IS NOT NULL"


add("mon_rolling_ic", lambda d: f"SELECT date, round({rolled('avg', 'ic', 63, 31)}, 6) AS mean, round({rolled('stddev_samp', 'ic', 63, 31)} / sqrt(63), 6) AS se FROM ({known_ics(d)}) AS x")


@plan("mon_cusum")
def _(d):
    run = trailing(None, by="")
    z = f"SELECT date, t, (ic - avg(ic) OVER (PARTITION BY one)) / nullif(stddev_samp(ic) OVER (PARTITION BY one), 0) AS z FROM (SELECT *, 1 AS one FROM ({known_ics(d)}) AS i1) AS i2"
    return f"""SELECT date, round(up - least(0, min(up) OVER ({run})), 6) AS pos, round(down - least(0, min(down) OVER ({run})), 6) AS neg FROM (
      SELECT date, t, sum(z - 0.25) OVER ({run}) AS up, sum(-z - 0.25) OVER ({run}) AS down FROM ({z}) AS z0) AS z1"""


add("mon_regimes", lambda d: f"SELECT regime, count(*) AS n, round(avg(ic), 6) AS mean, round(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(*)), 5) AS t_stat, round(avg(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM (SELECT ic, ntile(6) OVER (ORDER BY t) AS regime FROM ({known_ics(d)}) AS i1) AS i2 GROUP BY regime")


# --- ingestion -----------------------------------------------------------------------------------------------------
STORED = "SELECT ticker, date, close, volume FROM panel WHERE close IS NOT NULL AND date <= DATE '1996-06-03' AND ticker <> 'Brand#7'"
FRESH = "SELECT ticker, date, CASE WHEN ticker = 'Brand#5' AND date = DATE '1996-05-27' THEN close * 1.01 ELSE close END AS close, volume FROM panel WHERE close IS NOT NULL AND (date >= DATE '1996-05-24' OR ticker = 'Brand#7')"
add("inc_new_rows", lambda d: f"SELECT f.ticker, f.date, round(f.close, 6) AS close FROM ({FRESH}) AS f LEFT ANTI JOIN ({STORED}) AS s ON f.ticker = s.ticker AND f.date = s.date" if d.spark else f"SELECT f.ticker, f.date, round(f.close, 6) AS close FROM ({FRESH}) AS f WHERE NOT EXISTS (SELECT 1 FROM ({STORED}) AS s WHERE f.ticker = s.ticker AND f.date = s.date)")
add("inc_revisions", lambda d: f"SELECT f.ticker, f.date, round(s.close, 6) AS old_close, round(f.close, 6) AS new_close FROM ({FRESH}) AS f JOIN ({STORED}) AS s ON f.ticker = s.ticker AND f.date = s.date WHERE abs(f.close - s.close) > 1e-6 * abs(s.close)")
add("inc_merge", lambda d: f"SELECT ticker, date, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY source DESC) AS no FROM (SELECT ticker, date, close, 0 AS source FROM ({STORED}) AS s UNION ALL SELECT ticker, date, close, 1 AS source FROM ({FRESH}) AS f) AS u) AS w WHERE no = 1")
add("events_daily_bars", lambda d: "SELECT CAST(user_id % 20 AS BIGINT) AS ticker, CAST(ts AS DATE) AS date, count(*) AS n, round(max(value), 6) AS high, round(min(value), 6) AS low, round(sum(value), 4) AS volume FROM events GROUP BY CAST(user_id % 20 AS BIGINT), CAST(ts AS DATE)", "")

QUERIES = {name: (lambda spark, sf_dir, n=name: run(spark, sf_dir, n)) for name in PLANS}
SQL = {name: oracle(name) for name in PLANS}
