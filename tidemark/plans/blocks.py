"""Building blocks of plans: SQL text over the tables ``panel`` and ``signal``."""

from __future__ import annotations

from tidemark.functions.dialect import SPARK, Dialect, average_rank, lag, lead, roll, safe_div, trailing
from tidemark.operators.factors import REGISTRY, get_factor, layered

FUND = """SELECT p_brand AS ticker, CAST(sum(p_size) AS DOUBLE) AS shares, sum(p_retailprice * p_size) AS revenue_ttm,
  sum(p_retailprice) * 0.1 AS net_income_ttm, sum(p_retailprice) AS book_equity FROM part GROUP BY p_brand"""
SECTORS = "SELECT DISTINCT p_brand AS ticker, concat('S', CAST(CAST(replace(p_brand, 'Brand#', '') AS INTEGER) % 5 AS VARCHAR(9))) AS sector FROM part"
BENCHMARK = "Brand#1"
SIGNAL = ("mom_21", "rev_5", "vol_21", "bb_pos", "sma_ratio_50")
ALL = tuple(REGISTRY)
#: Rows that factors need before they count; a panel that isn't longer keeps all.
WARM = 260


def warm(rows: int = WARM) -> str:
    return f"(SELECT CASE WHEN max(t) > {rows} THEN {rows} ELSE 0 END FROM panel)"


def factors(names, extra: str = "") -> str:
    """(ticker, date, t, extra..., names...); ``extra``: further expressions over the panel, with their names."""
    source = "panel"
    if any(get_factor(n).needs_fundamentals for n in names):
        source = f"(SELECT p.*, f.shares, f.revenue_ttm, f.net_income_ttm, f.book_equity FROM panel AS p LEFT JOIN ({FUND}) AS f ON p.ticker = f.ticker) AS pf"
    return layered(source, list(names), "ticker, date, t" + (f", {extra}" if extra else ""))


def long_factors(names, extra: str = "", shown: str = "") -> str:
    return f"SELECT ticker, date, t, {shown + ', ' if shown else ''}factor, value FROM ({factors(names, extra)}) AS w UNPIVOT (value FOR factor IN ({', '.join(names)}))"


def winsorize(d: Dialect, source: str, by: str = "date", p: float = 0.01) -> str:
    return f"""SELECT *, CASE WHEN value IS NOT NULL THEN least(greatest(value, lo), hi) END AS w FROM (
      SELECT *, {d.percentile('value', p)} OVER (PARTITION BY {by}) AS lo, {d.percentile('value', 1 - p)} OVER (PARTITION BY {by}) AS hi FROM ({source}) AS a0) AS a1"""


def zscore(x: str, by: str = "date") -> str:
    return f"(({x}) - avg({x}) OVER (PARTITION BY {by})) / nullif(stddev_pop({x}) OVER (PARTITION BY {by}), 0)"


def composite(d: Dialect, names=SIGNAL, weights: dict[str, float] | None = None, signs: dict[str, int] | None = None, extra: str = "", shown: str = "") -> str:
    """(ticker, date, t, [shown,] value): weighted mean of winsorised z-scores over the factors that are there."""
    if not names:
        raise ValueError("a composite needs factors")
    case = lambda of, default: "CASE factor " + " ".join(f"WHEN '{n}' THEN {of.get(n, default)}" for n in names) + " END"
    weight = case(weights, 0.0) if weights else "1.0"
    sign = case(signs, 1) if signs else "1"
    also = f", {shown}" if shown else ""
    z = f"SELECT ticker, date, t{also}, factor, {zscore('w', 'date, factor')} * {sign} AS z FROM ({winsorize(d, long_factors(names, extra, shown), 'date, factor')}) AS z0"
    return f"""SELECT ticker, date, t{also}, sum(z * wt) / nullif(sum(CASE WHEN z IS NOT NULL THEN wt END), 0) AS value
      FROM (SELECT *, {weight} AS wt FROM ({z}) AS z1) AS z2 GROUP BY ticker, date, t{also}"""


def masked_composite(d: Dialect, min_price: float = 5.0, min_dollar: float = 0.0, **options) -> str:
    """A composite that is NULL where a name can't be traded; the panel is read once."""
    ok = f"{tradable_flag(roll('avg', 'dv', 21), min_price, min_dollar)} AS ok"
    return f"SELECT ticker, date, t, CASE WHEN ok THEN value END AS value FROM ({composite(d, extra=ok, shown='ok', **options)}) AS s0"


def forward(h: int) -> str:
    return f"SELECT ticker, date, t, {safe_div(lead('close', h + 1), lead('close', 1))} - 1 AS fwd FROM panel"


def _both_vary(d: Dialect) -> str:
    """Spark merges partial deviations of equal values to tiny ones instead of 0, so whether ranks differ is asked of them."""
    return " AND min(rx) < max(rx) AND min(ry) < max(ry)" if d.spark else ""


def rank_ic(values: str, target: str, least: int = 10, by: str = "date", d: Dialect = SPARK) -> str:
    """(by..., t, n, ic): correlation of ranks, each taken over its own values, on rows that have both.

    values: (ticker, date, t, [factor,] value); target: (ticker, date, fwd), which is ranked once for all factors.
    """
    extra = ", factor" if "factor" in by else ""
    return f"""SELECT {by}, max(t) AS t, count(*) AS n, CASE WHEN count(*) >= {least}{_both_vary(d)} THEN
        covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) END AS ic
      FROM (SELECT v.date, v.t{extra}, v.rx, f.ry FROM (SELECT ticker, date, t{extra}, {average_rank('value', by)} AS rx FROM ({values}) AS r0 WHERE value IS NOT NULL) AS v
            JOIN (SELECT ticker, date, {average_rank('fwd', 'date')} AS ry FROM ({target}) AS r1 WHERE fwd IS NOT NULL) AS f ON v.ticker = f.ticker AND v.date = f.date) AS r2
      GROUP BY {by}"""


def newey_west_lags(n: int) -> int:
    """Autocovariances that newey_west() must write out for up to n dates; those beyond the rule's number count nothing."""
    return max(12, int(4 * (n / 100) ** (1 / 3) + 1e-9))


def newey_west(series: str, x: str = "x", by: str = "", lags: int = 12) -> str:
    """([by,] n, mean, tstat) of a table (t, x): Bartlett weights, lags floor(4 (n/100)^(1/3)) but at most n - 2.

    ``lags``: at least newey_west_lags() of the most dates.
    """
    head = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    shifted = ", ".join(f"lag(e, {k}) OVER ({part}ORDER BY t) AS e{k}" for k in range(1, lags + 1))
    terms = " + ".join(f"CASE WHEN {k} <= l THEN 2 * (1 - {k} / (l + 1.0)) * coalesce(c{k}, 0) / n ELSE 0 END" for k in range(1, lags + 1))
    sums = ", ".join(f"sum(e * e{k}) AS c{k}" for k in range(1, lags + 1))
    return f"""SELECT {head}n, mean, CASE WHEN n >= 5 AND v > 0 THEN mean / sqrt(v / n) END AS tstat FROM (
      SELECT *, c0 / n + {terms} AS v FROM (
        SELECT {head}count(*) AS n, max(m) AS mean, least(floor(4 * power(count(*) / 100.0, 1.0 / 3.0)), count(*) - 2) AS l, sum(e * e) AS c0, {sums}
        FROM (SELECT *, {shifted} FROM (SELECT {head}t, avg({x}) OVER ({part.strip()}) AS m, {x} - avg({x}) OVER ({part.strip()}) AS e FROM ({series}) AS s0 WHERE {x} IS NOT NULL) AS s1) AS s2
        {group}) AS s3) AS s4"""


def rebalances(d: Dialect, signal: str, every: str = "MS", lag_rows: int = 1) -> str:
    """(k, signal_date, t, trade_t, next_t): the last date with a valid signal in each bucket, and its trade row."""
    return f"""SELECT CAST(row_number() OVER (ORDER BY t) - 1 AS BIGINT) AS k, date AS signal_date, t, t + {lag_rows} AS trade_t,
        lead(t, 1) OVER (ORDER BY t) + {lag_rows} AS next_t
      FROM (SELECT max(date) AS date, max(t) AS t FROM ({signal}) AS g0 WHERE value IS NOT NULL GROUP BY {d.bucket(every)}) AS g1
      WHERE t + {lag_rows} <= (SELECT max(t) FROM panel)"""


def text(x: str) -> str:
    """A string literal."""
    return "'" + x.replace("'", "''") + "'"


def tradable_flag(adv: str, min_price: float = 5.0, min_dollar: float = 0.0, excluded: tuple[str, ...] = (BENCHMARK,)) -> str:
    named = f"ticker NOT IN ({', '.join(map(text, excluded))}) AND " if excluded else ""
    return f"CASE WHEN {named}close >= {min_price} AND {adv} / 1e6 >= {min_dollar} THEN TRUE ELSE FALSE END"


def tradable(min_price: float = 5.0, min_dollar: float = 0.0, excluded: tuple[str, ...] = (BENCHMARK,)) -> str:
    return f"SELECT ticker, date, t, ret, {tradable_flag('adv', min_price, min_dollar, excluded)} AS ok FROM (SELECT *, {roll('avg', 'dv', 21)} AS adv FROM panel) AS m0"


def masked(signal: str) -> str:
    return f"SELECT s.ticker, s.date, s.t, CASE WHEN m.ok THEN s.value END AS value FROM ({signal}) AS s JOIN ({tradable()}) AS m ON s.ticker = m.ticker AND s.date = m.date"


def _legs(source: str, weighting: str, cap: float | None) -> str:
    """(ticker, date, t, weight) of rows with a leg of 1 or -1: weighted within the leg, capped, and scaled to 1 again."""
    raw = {
        "equal": "1.0",
        "rank": average_rank("value", "date, leg"),
        "zscore": f"coalesce(abs({zscore('value', 'date, leg')}), 0)",
    }
    if weighting not in raw:
        raise ValueError(f"unknown weighting {weighting}")
    share = "r / nullif(sum(r) OVER (PARTITION BY date, leg), 0)"
    return f"""SELECT ticker, date, t, leg * c / nullif(sum(c) OVER (PARTITION BY date, leg), 0) AS weight FROM (
      SELECT *, {share if cap is None else f'least({share}, {cap})'} AS c FROM (
        SELECT *, CAST({raw[weighting]} AS DOUBLE) AS r FROM ({source}) AS n2 WHERE leg IS NOT NULL) AS n3) AS n4"""


def _sides(long: str, short: str, side: str) -> str:
    if side not in ("long", "short", "long_short"):
        raise ValueError(f"unknown side {side}")
    return "CASE" + (f" WHEN {long} THEN 1" if side != "short" else "") + (f" WHEN {short} THEN -1" if side != "long" else "") + " END AS leg"


def top_n(signal: str, n: int = 5, side: str = "long", weighting: str = "equal", cap: float | None = 0.10) -> str:
    """(ticker, date, t, weight): the best n, for short or long_short the worst n; at least 2n names, else nothing."""
    return _legs(f"""SELECT *, {_sides(f'up <= {n}', f'down <= {n}', side)} FROM (
            SELECT *, row_number() OVER (PARTITION BY date ORDER BY value DESC, ticker) AS up, row_number() OVER (PARTITION BY date ORDER BY value, ticker) AS down,
                   count(*) OVER (PARTITION BY date) AS names
            FROM ({signal}) AS n0 WHERE value IS NOT NULL) AS n1 WHERE names >= {2 * n}""", weighting, cap)


def quantile_book(signal: str, q: float = 0.2, side: str = "long_short", weighting: str = "equal", cap: float | None = None) -> str:
    """The top and bottom share q by percentile rank; at least five names."""
    if not 0 < q <= 0.5:
        raise ValueError("q must lie in (0, 0.5]")
    rank = f"{average_rank('value', 'date')} / count(*) OVER (PARTITION BY date)"
    return _legs(f"""SELECT *, {_sides(f'pr >= {1 - q}', f'pr <= {q}', side)} FROM (
        SELECT *, {rank} AS pr, count(*) OVER (PARTITION BY date) AS names FROM ({signal}) AS q0 WHERE value IS NOT NULL) AS q1 WHERE names >= 5""", weighting, cap)


def zscore_book(signal: str, cap: float = 0.10, side: str = "long_short") -> str:
    """Half the z-score, clipped to the cap and scaled to the gross exposure; ``side`` changes nothing but that."""
    gross = 2.0 if side == "long_short" else 1.0
    return f"""SELECT ticker, date, t, {gross} * c / nullif(sum(abs(c)) OVER (PARTITION BY date), 0) AS weight FROM (
      SELECT *, least(greatest({zscore('value')} / 2, -{cap}), {cap}) AS c, count(*) OVER (PARTITION BY date) AS names
      FROM ({signal}) AS b0 WHERE value IS NOT NULL) AS b1 WHERE names >= 3"""


def targets(weights: str, reb: str) -> str:
    """(k, t, trade_t, next_t, ticker, weight, base): each rebalance's book and the prices that it is bought at."""
    return f"""SELECT r.k, r.signal_date, r.t, r.trade_t, r.next_t, w.ticker, w.weight, p.ff AS base FROM {reb} AS r JOIN ({weights}) AS w ON w.date = r.signal_date
           JOIN panel AS p ON p.ticker = w.ticker AND p.t = r.trade_t"""


def simulated(reb: str = "reb_table", target: str = "target_table", cost: str = "linear", bps: float = 10.0, book: float = 5e7, min_trade: float = 0.0, impact: float = 1.0, fixed: float = 5.0) -> str:
    """CTE list: held, gross, turn, daily. Drifting weights telescope to price ratios, so there is no loop.

    A book's prices at its trade row, and at the next one's, are all that turnover needs of the panel.
    """
    if cost == "linear":
        charge = f"CASE WHEN sum(abs(dw)) <= {min_trade} THEN 0.0 ELSE sum(abs(dw)) * {bps} / 1e4 END"
        liquid, join = "", ""
    else:
        charge = f"sum(abs(dw) * coalesce({impact} * vol * sqrt(least(abs(dw) * {book} / greatest(adv, 1.0), 1.0)), 0)) + {fixed} / 1e4 * sum(abs(dw))"
        liquid = f"liquid AS (SELECT ticker, t, {roll('avg', 'dv', 21, 5)} AS adv, {roll('stddev_samp', 'ret', 21, 10)} AS vol FROM panel),\n"
        join = "LEFT JOIN liquid AS l ON l.ticker = m.ticker AND l.t = r.t "
    return f"""held AS (SELECT p.date, p.t, g.k, g.ticker, g.weight * (p.ff / (1 + p.ret)) / g.base AS w, p.ret FROM {target} AS g JOIN panel AS p
         ON p.ticker = g.ticker AND p.t > g.trade_t AND p.t <= coalesce(g.next_t, 1000000000)),
gross AS (SELECT date, t, max(k) AS k, sum(w * ret) AS gross FROM held GROUP BY date, t),
left_over AS (SELECT g.k + 1 AS k, g.ticker, -g.weight * p.ff / g.base AS dw FROM {target} AS g JOIN panel AS p ON p.ticker = g.ticker AND p.t = g.next_t),
moves AS (SELECT k, ticker, sum(dw) AS dw FROM (SELECT k, ticker, weight AS dw FROM {target} UNION ALL SELECT k, ticker, dw FROM left_over) AS m0 GROUP BY k, ticker),
{liquid}turn AS (SELECT r.k, r.signal_date, r.trade_t, sum(abs(dw)) AS turnover, {charge} AS cost FROM moves AS m JOIN {reb} AS r ON r.k = m.k
         {join}GROUP BY r.k, r.signal_date, r.trade_t),
daily AS (SELECT g.date, g.t, g.k, g.gross, coalesce(u.cost, 0) AS cost, g.gross - coalesce(u.cost, 0) AS net
          FROM gross AS g LEFT JOIN turn AS u ON g.k = u.k AND g.t = u.trade_t + 1)"""


def compounded(x: str, over: str = "") -> str:
    """Product of 1 + x, NULL as 0, of either sign; an aggregate, or over a window."""
    w = f" OVER ({over})" if over else ""
    f = f"(1 + coalesce({x}, 0))"
    zeros = f"sum(CASE WHEN {f} = 0 THEN 1 ELSE 0 END){w}"
    sign = f"(1 - 2 * (sum(CASE WHEN {f} < 0 THEN 1 ELSE 0 END){w} % 2))"
    return f"(CASE WHEN {zeros} > 0 THEN 0.0 ELSE {sign} * exp(coalesce(sum(ln(abs(nullif({f}, 0)))){w}, 0)) END)"


def drawdowns(series: str, x: str = "net") -> str:
    """(date, t, x, equity, peak, dd)"""
    run = trailing(None, by="")
    return f"""SELECT *, equity / peak - 1 AS dd FROM (SELECT *, max(equity) OVER ({run}) AS peak FROM (
      SELECT *, {compounded(x, run)} AS equity FROM ({series}) AS e0) AS e1) AS e2"""


Z = {0.90: -1.2816, 0.95: -1.6449, 0.99: -2.3263}  # fixed values: normal quantiles


def moments(x: str) -> str:
    """Bias-corrected skewness and excess kurtosis of an aggregate over rows with n_all, the mean mu and x."""
    n, m = f"count({x})", [f"avg(power({x} - mu, {k}))" for k in (2, 3, 4)]
    skew = f"{m[1]} / nullif(power({m[0]}, 1.5), 0) * sqrt({n} * ({n} - 1.0)) / nullif({n} - 2, 0)"
    kurt = f"({n} - 1.0) / nullif(({n} - 2.0) * ({n} - 3.0), 0) * (({n} + 1) * ({m[3 - 1]} / nullif({m[0]} * {m[0]}, 0) - 3) + 6)"
    return f"{skew} AS skew, {kurt} AS excess_kurtosis"


def cornish_fisher(level: float, mu: str = "mu", sd: str = "sd", s: str = "skew", k: str = "excess_kurtosis") -> str:
    z = Z.get(level, -1.6449)
    return f"CASE WHEN {sd} = 0 THEN 0.0 ELSE -({mu} + {sd} * ({z} + ({z * z - 1}) * {s} / 6 + ({z**3 - 3 * z}) * {k} / 24 - ({2 * z**3 - 5 * z}) * {s} * {s} / 36)) END"


def summary(d: Dialect, series: str, x: str = "net", rf: float = 0.0) -> str:
    """One row of statistics of a return series (date, t, x)."""
    growth = compounded(x)
    cagr = f"power(CASE WHEN {growth} > 0 THEN {growth} END, 252.0 / count({x})) - 1"
    return f"""SELECT *, cagr / nullif(abs(max_drawdown), 0) AS calmar, {cornish_fisher(0.95)} AS var_cf FROM (SELECT count({x}) AS n_days, {growth} - 1 AS total_return, {cagr} AS cagr, stddev_samp({x}) * sqrt(252) AS ann_vol,
      (avg({x}) - {rf} / 252) / nullif(stddev_samp({x}), 0) * sqrt(252) AS sharpe,
      CASE WHEN sum(CASE WHEN {x} < 0 THEN 1 ELSE 0 END) >= 2 THEN (avg({x}) - {rf} / 252) * 252 / nullif(sqrt(sum(CASE WHEN {x} < 0 THEN {x} * {x} ELSE 0 END) / count({x})) * sqrt(252), 0) END AS sortino,
      min(dd) AS max_drawdown, -max(q05) AS var_95, -max(q01) AS var_99, -avg(CASE WHEN {x} <= q05 THEN {x} END) AS cvar_95,
      max(mu) AS mu, stddev_samp({x}) AS sd, {moments(x)},
      avg(CASE WHEN {x} > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, max({x}) AS best, min({x}) AS worst
    FROM (SELECT *, avg({x}) OVER (PARTITION BY one) AS mu, {d.percentile(x, 0.05)} OVER (PARTITION BY one) AS q05, {d.percentile(x, 0.01)} OVER (PARTITION BY one) AS q01
          FROM (SELECT *, 1 AS one FROM ({drawdowns(f'SELECT date, t, {x} FROM ({series}) AS p0 WHERE {x} IS NOT NULL', x)}) AS t0) AS t1) AS t2) AS t3"""


def against(d: Dialect, pairs: str, x: str = "net", y: str = "bench") -> str:
    """One row of statistics of a return series against a benchmark's, on dates that have both: (date, t, x, y)."""
    stats = "total_return cagr sharpe".split()
    own = f"SELECT cagr FROM ({summary(d, f'SELECT date, t, {x} AS r FROM ({pairs}) AS a0', 'r')}) AS a1"
    return f"""SELECT {', '.join(f'b.{c} AS benchmark_{c}' for c in stats)}, o.cagr - b.cagr AS excess_cagr, p.*
    FROM ({summary(d, f'SELECT date, t, {y} AS r FROM ({pairs}) AS a2', 'r')}) AS b CROSS JOIN ({own}) AS o CROSS JOIN (
      SELECT stddev_samp({x} - {y}) * sqrt(252) AS tracking_error, avg({x} - {y}) / nullif(stddev_samp({x} - {y}), 0) * sqrt(252) AS information_ratio,
        CASE WHEN count(*) >= 10 THEN (avg({x}) - covar_samp({x}, {y}) / nullif(var_samp({y}), 0) * avg({y})) * 252 END AS alpha_ann,
        CASE WHEN count(*) >= 10 THEN covar_samp({x}, {y}) / nullif(var_samp({y}), 0) END AS beta,
        avg(CASE WHEN {y} > 0 THEN {x} END) / nullif(avg(CASE WHEN {y} > 0 THEN {y} END), 0) AS up_capture,
        avg(CASE WHEN {y} < 0 THEN {x} END) / nullif(avg(CASE WHEN {y} < 0 THEN {y} END), 0) AS down_capture,
        covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) AS correlation
      FROM ({pairs}) AS a3 WHERE {x} IS NOT NULL AND {y} IS NOT NULL) AS p"""


def episodes(d: Dialect, series: str, top: int = 5, min_depth: float = 0.05) -> tuple[list[tuple[str, str]], str]:
    """Falls below -min_depth, from the first peak before the trough to the first date that is as high again."""
    return [("curve_table", drawdowns(series))], f"""SELECT peak_date, trough_date, recovery_date, depth, {d.days('trough_date', 'peak_date')} AS length_days, {d.days('recovery_date', 'peak_date')} AS recovery_days FROM (
      SELECT e.trough_date, e.depth, min(CASE WHEN c.t <= e.trough AND c.equity = e.peak THEN c.date END) AS peak_date,
             min(CASE WHEN c.t >= e.trough AND c.equity >= e.peak THEN c.date END) AS recovery_date
      FROM (SELECT grp, date AS trough_date, t AS trough, dd AS depth, peak FROM (
              SELECT *, row_number() OVER (PARTITION BY grp ORDER BY dd, t) AS no FROM (
                SELECT *, sum(CASE WHEN dd < -{min_depth} THEN 0 ELSE 1 END) OVER ({trailing(None, by='')}) AS grp FROM curve_table) AS g0 WHERE dd < -{min_depth}) AS g1 WHERE no = 1) AS e
      JOIN curve_table AS c ON c.equity >= e.peak GROUP BY e.grp, e.trough_date, e.depth) AS f ORDER BY f.depth, f.trough_date LIMIT {top}"""


def trailing_beta(window: int = 126, least: int = 63, market: str = "avg(ret) OVER (PARTITION BY date)") -> str:
    w = trailing(window)
    return f"""SELECT ticker, date, t, ret, mkt, CASE WHEN count(xy) OVER ({w}) >= {least} THEN
        (avg(xy) OVER ({w}) - avg(ret) OVER ({w}) * avg(mkt) OVER ({w})) / nullif(var_samp(mkt) OVER ({w}), 0) END AS beta
      FROM (SELECT *, ret * mkt AS xy FROM (SELECT *, {market} AS mkt FROM panel) AS y0) AS y1"""


def robust(d: Dialect, source: str) -> str:
    """Median and MAD z-score, clipped to 3, standardised again with the sample deviation."""
    return f"""SELECT ticker, date, t, (c - avg(c) OVER (PARTITION BY date)) / nullif(stddev_samp(c) OVER (PARTITION BY date), 0) AS value FROM (
      SELECT *, CASE WHEN value IS NOT NULL AND mad > 0 THEN least(greatest((value - med) / (1.4826 * mad), -3), 3) END AS c FROM (
        SELECT *, {d.percentile('abs(value - med)', 0.5)} OVER (PARTITION BY date) AS mad FROM (
          SELECT *, {d.percentile('value', 0.5)} OVER (PARTITION BY date) AS med FROM ({source}) AS u0) AS u1) AS u2) AS u3"""


def sector_demeaned(source: str, least: int = 3, sectors: str = SECTORS) -> str:
    """Less the sector's mean where the sector has ``least`` names that date; a date with fewer than two names stays."""
    return f"""SELECT ticker, date, t, CASE WHEN sector IS NOT NULL AND members >= {least} AND names >= 2 THEN value - mean ELSE value END AS value FROM (
      SELECT s.*, x.sector, count(value) OVER (PARTITION BY date, sector) AS members, avg(value) OVER (PARTITION BY date, sector) AS mean, count(value) OVER (PARTITION BY date) AS names
      FROM ({source}) AS s LEFT JOIN ({sectors}) AS x ON s.ticker = x.ticker) AS h0"""


def beta_residual(source: str, betas: str, least: int = 10) -> str:
    """What a date's regression on betas leaves of a signal; its sums are windows over the date, so the source is read once."""
    w = "PARTITION BY date"
    sums = ", ".join(f"{e} OVER ({w}) AS {c}" for c, e in {"n": "count(xy)", "mx": "avg(x)", "my": "avg(y)", "sd": "stddev_pop(x)", "cxy": "covar_pop(x, y)", "vx": "var_pop(x)"}.items())
    return f"""SELECT ticker, date, t, CASE WHEN n >= {least} AND sd > 1e-12 AND beta IS NOT NULL THEN value - (my + cxy / nullif(vx, 0) * (beta - mx)) ELSE value END AS value FROM (
      SELECT ticker, date, t, value, beta, {sums} FROM (
        SELECT s.ticker, s.date, s.t, s.value, b.beta, s.value * b.beta AS xy, CASE WHEN s.value IS NOT NULL THEN b.beta END AS x, CASE WHEN b.beta IS NOT NULL THEN s.value END AS y
        FROM ({source}) AS s LEFT JOIN ({betas}) AS b ON s.ticker = b.ticker AND s.date = b.date) AS q0) AS q1"""


def bucketed(values: str, q: int = 5, by: str = "date") -> str:
    extra = ", factor" if "factor" in by else ""
    return f"""SELECT ticker, date, t{extra}, CAST(least(ceil({average_rank('value', by)} * {q} / count(*) OVER (PARTITION BY {by})), {q}) AS INTEGER) AS bucket,
        count(*) OVER (PARTITION BY {by}) AS names FROM ({values}) AS b0 WHERE value IS NOT NULL"""


def quantile_returns(values: str, q: int = 5, by: str = "date") -> str:
    """(by..., bucket, mean_return, n): next row's mean return of each bucket on dates with ``q`` bucketed names or more."""
    return f"""SELECT {', '.join('x.' + c for c in by.split(', '))}, x.bucket, avg(p.nxt) AS mean_return, count(*) AS n FROM ({bucketed(values, q, by)}) AS x
      JOIN (SELECT ticker, date, {lead('ret', 1)} AS nxt FROM panel) AS p ON x.ticker = p.ticker AND x.date = p.date
      WHERE x.names >= {q} AND p.nxt IS NOT NULL GROUP BY {', '.join('x.' + c for c in by.split(', '))}, x.bucket"""


def leg_turnover(d: Dialect, values: str, every: str = "W-FRI") -> str:
    """(factor, turnover, periods): mean absolute change of a top against bottom quarter book, over periods with a rank.

    A period's book takes each name's last rank in it. A weight counts once where it comes and, negated, in the next
    period; what is left of the two is the change, also of names that come or go.
    """
    week = d.bucket(every)
    ranks = f"SELECT ticker, date, t, factor, {average_rank('value', 'date, factor')} / count(*) OVER (PARTITION BY date, factor) AS pr FROM ({values}) AS a WHERE value IS NOT NULL"
    last = f"SELECT factor, ticker, {week} AS bucket, {d.max_by('pr', 't')} AS pr FROM ({ranks}) AS c GROUP BY factor, ticker, {week}"
    return f"""SELECT factor, sum(abs(moved)) / nullif(max(periods) - 1, 0) AS turnover, max(periods) AS periods FROM (
      SELECT factor, no, ticker, sum(w) AS moved, max(periods) AS periods FROM (
        SELECT factor, ticker, no + step AS no, periods, CASE WHEN step = 0 THEN w ELSE -w END AS w FROM (
          SELECT l.factor, l.ticker, n.no, n.periods, l.leg * 1.0 / nullif(count(l.leg) OVER (PARTITION BY l.factor, l.bucket, l.leg), 0) AS w
          FROM (SELECT *, CASE WHEN pr >= 0.75 THEN 1 WHEN pr <= 0.25 THEN -1 END AS leg FROM ({last}) AS e) AS l
          JOIN (SELECT factor, bucket, row_number() OVER (PARTITION BY factor ORDER BY bucket) AS no, count(*) OVER (PARTITION BY factor) AS periods
                FROM (SELECT DISTINCT factor, bucket FROM ({last}) AS e1) AS e2) AS n ON l.factor = n.factor AND l.bucket = n.bucket) AS f
        CROSS JOIN (SELECT 0 AS step UNION ALL SELECT 1 AS step) AS steps WHERE w IS NOT NULL OR step = 0) AS g WHERE no > 1 AND no <= periods GROUP BY factor, no, ticker) AS h GROUP BY factor"""


def after_warm_up(names, rows: int = WARM) -> str:
    return f"SELECT * FROM ({long_factors(names)}) AS l0 WHERE t > {warm(rows)}"


def evaluation(d: Dialect, values: str, dates: str, h: int = 5, q: int = 5, cost_bps: float = 10.0, lags: int = 12) -> tuple[list[tuple[str, str]], str]:
    """All statistics of factors (ticker, date, t, factor, value), one row each; every one of ``dates`` (t) counts as an
    observation of the IC."""
    lets = [
        ("long_table", values),
        ("ic_table", rank_ic("SELECT * FROM long_table", forward(h), by="date, factor", d=d)),
        ("bucket_table", quantile_returns("SELECT * FROM long_table", q, "date, factor")),
    ]
    spread = f"""SELECT factor, avg(net) * 252 AS spread_ann, avg(net) / nullif(stddev_samp(net), 0) * sqrt(252) AS spread_sharpe FROM (
      SELECT factor, date, max(CASE WHEN bucket = {q} THEN mean_return END) - max(CASE WHEN bucket = 1 THEN mean_return END) - {cost_bps} / 1e4 / {h} * 2 AS net
      FROM bucket_table GROUP BY factor, date) AS s0 GROUP BY factor"""
    mono = f"""SELECT factor, covar_pop(rk, bucket) / nullif(stddev_pop(rk) * stddev_pop(bucket), 0) AS monotonicity FROM (
      SELECT factor, bucket, {average_rank('m', 'factor')} AS rk FROM (SELECT factor, bucket, avg(mean_return) AS m FROM bucket_table GROUP BY factor, bucket) AS m0) AS m1 GROUP BY factor"""
    return lets, f"""SELECT s.factor, g.n AS n_obs, s.m AS ic_mean, s.sd AS ic_std, s.m / nullif(s.sd, 0) AS ic_ir, w.tstat, s.up / g.n AS positive_rate,
        v.turnover, p.spread_ann, p.spread_sharpe, o.monotonicity
      FROM (SELECT factor, avg(ic) AS m, stddev_samp(ic) AS sd, sum(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0.0 END) AS up FROM ic_table GROUP BY factor) AS s
      JOIN ({newey_west('SELECT * FROM ic_table', 'ic', 'factor', lags)}) AS w ON s.factor = w.factor
      LEFT JOIN ({leg_turnover(d, 'SELECT * FROM long_table')}) AS v ON s.factor = v.factor
      LEFT JOIN ({spread}) AS p ON s.factor = p.factor LEFT JOIN ({mono}) AS o ON s.factor = o.factor
      CROSS JOIN (SELECT count(DISTINCT t) AS n FROM ({dates}) AS g0) AS g"""


def ic_decay(values: str, horizons: tuple[int, ...], least: int = 10, d: Dialect = SPARK) -> str:
    """(horizon, mean_ic, n): the factor is ranked once; the horizons' returns come from one pass over the panel."""
    ahead = ", ".join(f"{safe_div(lead('close', h + 1), lead('close', 1))} - 1 AS h{h}" for h in horizons)
    number = "CASE horizon " + " ".join(f"WHEN 'h{h}' THEN {h}" for h in horizons) + " END"
    return f"""SELECT {number} AS horizon, avg(ic) AS mean_ic, count(ic) AS n FROM (
      SELECT date, horizon, CASE WHEN count(*) >= {least}{_both_vary(d)} THEN covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) END AS ic FROM (
        SELECT f.date, f.horizon, v.rx, {average_rank('f.fwd', 'f.date, f.horizon')} AS ry FROM
          (SELECT ticker, date, horizon, fwd FROM (SELECT ticker, date, {ahead} FROM panel) AS a0 UNPIVOT (fwd FOR horizon IN ({', '.join(f'h{h}' for h in horizons)}))) AS f
          LEFT JOIN (SELECT ticker, date, {average_rank('value', 'date')} AS rx FROM ({values}) AS v0 WHERE value IS NOT NULL) AS v ON v.ticker = f.ticker AND v.date = f.date) AS i0
      WHERE rx IS NOT NULL GROUP BY date, horizon) AS i1 GROUP BY {number}"""


__all__ = [n for n in dir() if not n.startswith("_")] + ["lag"]
