"""The factor registry: each factor is a few layers of SQL expressions over a dense panel.

A panel has ticker, date, t (row of the grid), open, high, low, close, volume, ff (close, filled forward), ret, dv. A
factor's layers are computed one after the other; all factors share one partitioning and one sort by ticker.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from tidemark.functions.dialect import lag, roll, safe_div, trailing

ANNUAL = "sqrt(252)"


@dataclass(frozen=True)
class Factor:
    name: str
    category: str
    description: str
    value: str
    #: (column, expression) of earlier layers; a layer may use those before it.
    layers: tuple[tuple[tuple[str, str], ...], ...] = field(default=())
    needs_fundamentals: bool = False


REGISTRY: dict[str, Factor] = {}


def register(factor: Factor) -> Factor:
    if not factor.name:
        raise ValueError("a factor needs a name")
    if factor.name in REGISTRY:
        raise ValueError(f"factor {factor.name} is registered already")
    REGISTRY[factor.name] = factor
    return factor


def function_factor(name: str, category: str = "custom", description: str = "") -> Callable:
    """Decorator: the function returns the factor's SQL expression."""

    def wrap(f: Callable[[], str]) -> Factor:
        return register(Factor(name, category, description or (f.__doc__ or "").strip(), f()))

    return wrap


def get_factor(name: str) -> Factor:
    if name not in REGISTRY:
        raise KeyError(f"unknown factor {name}")
    return REGISTRY[name]


def list_factors() -> list[Factor]:
    return sorted(REGISTRY.values(), key=lambda f: (f.category, f.name))


def _f(name, category, description, value, *layers, fundamentals=False):
    register(Factor(name, category, description, value, tuple(tuple(x.items()) for x in layers), fundamentals))


def _change(new: int, old: int) -> str:
    a = "close" if not new else lag("close", new)
    return f"{safe_div(a, lag('close', old))} - 1"


for _n in (21, 63, 126):
    _f(f"mom_{_n}", "momentum", f"price change over {_n} rows", _change(0, _n))
_f("mom_252", "momentum", "price change over 252 rows, but the last 21", _change(21, 252))
_w = trailing(126)
_f(
    "mom_slope", "momentum", "t statistic of log price on time over 126 rows",
    "CASE WHEN n = 126 THEN sign(slope) * sqrt(greatest(r2, 0) * 124 / nullif(1 - r2, 0)) END",
    {"lc": "CASE WHEN close > 0 THEN ln(close) END"},
    {"n": f"count(lc) OVER ({_w})", "slope": f"regr_slope(lc, t) OVER ({_w})", "r2": f"regr_r2(lc, t) OVER ({_w})"},
)
_f("rev_5", "reversal", "change over 5 rows, a row ago", _change(1, 6))
_f("rev_1", "reversal", "change over a row, a row ago", _change(1, 2))
_f("rev_gap", "reversal", "mean overnight gap of 5 rows, a row ago", roll("avg", "gap", 5, skip=1), {"gap": f"{safe_div('open', lag('close', 1))} - 1"})
for _n in (21, 63):
    _f(f"vol_{_n}", "volatility", f"annual deviation over {_n} rows", f"{roll('stddev_samp', 'ret', _n)} * {ANNUAL}")
_f("vol_ratio", "volatility", "short over long deviation", safe_div("s21", "s126"), {"s21": roll("stddev_samp", "ret", 21), "s126": roll("stddev_samp", "ret", 126)})
_f(
    "idio_vol_21", "volatility", "annual deviation of returns beyond the market's",
    f"{roll('stddev_samp', 'resid', 21)} * {ANNUAL}",
    {"mkt": "avg(ret) OVER (PARTITION BY date)"},
    {"beta": f"CASE WHEN count(ret + mkt) OVER ({_w}) = 126 THEN covar_samp(ret, mkt) OVER ({_w}) / nullif(var_samp(mkt) OVER ({_w}), 0) END"},
    {"resid": "ret - beta * mkt"},
)
_f("dol_vol_21", "liquidity", "log of mean dollar volume", "CASE WHEN m > 0 THEN ln(m) END", {"m": roll("avg", "dv", 21)})
_f("vol_trend", "liquidity", "short over long mean volume", f"{safe_div('v5', 'v63')} - 1", {"v5": roll("avg", "volume", 5), "v63": roll("avg", "volume", 63)})
_f("amihud", "liquidity", "mean absolute return for a million of volume", roll("avg", "impact", 21), {"impact": "CASE WHEN dv > 0 THEN abs(ret) / dv * 1e6 END"})
_f("vol_spike", "liquidity", "volume over its mean", safe_div("volume", "v21"), {"v21": roll("avg", "volume", 21)})
_run = "PARTITION BY ticker ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
# Wilder averages in closed form: an observation g rows after the last one has weight a / ((1-a)^g + a).
_f(
    "rsi_14", "technical", "relative strength index",
    "CASE WHEN t0 IS NULL OR NOT (up + down > 0) THEN 50.0 WHEN down > 0 THEN 100 - 100 / (1 + up / down) END",
    {"chg": f"close - {lag('close', 1)}"},
    {"obs": "CASE WHEN chg IS NOT NULL THEN t END"},
    {"t0": f"max(obs) OVER ({_run})", "tb": "max(obs) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"},
    {"k": "CASE WHEN chg IS NOT NULL AND tb IS NOT NULL THEN power(13.0 / 14.0, t - tb) END"},
    {"p": f"coalesce(sum(CASE WHEN k IS NOT NULL THEN ln(k / (k + 1.0 / 14.0)) END) OVER ({_run}), 0.0)", "wn": "CASE WHEN chg IS NULL THEN NULL WHEN k IS NULL THEN 1.0 ELSE (1.0 / 14.0) / (k + 1.0 / 14.0) END"},
    {"up": f"exp(p) * sum(wn * CASE WHEN chg > 0 THEN chg ELSE 0.0 END * exp(-p)) OVER ({_run})", "down": f"exp(p) * sum(wn * CASE WHEN chg < 0 THEN -chg ELSE 0.0 END * exp(-p)) OVER ({_run})"},
)
_f("bb_pos", "technical", "distance from the mean of 20 in two deviations", safe_div("close - m", "2 * s"), {"m": roll("avg", "close", 20), "s": roll("stddev_samp", "close", 20)})
_f("dist_52w_high", "technical", "distance from the highest close of 252", f"{safe_div('close', 'top')} - 1", {"top": roll("max", "close", 252, 126)})
_f("sma_ratio_50", "technical", "close over its mean of 50", f"{safe_div('close', 'm')} - 1", {"m": roll("avg", "close", 50)})
_f(
    "atr_21", "technical", "mean true range over close", safe_div("m", "close"),
    {"pc": lag("close", 1)},
    {"tr": "CASE WHEN high IS NOT NULL AND low IS NOT NULL AND pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END"},
    {"m": roll("avg", "tr", 21)},
)
_f("sharpe_63", "higher_moments", "annual Sharpe ratio of 63 rows", safe_div("m * 252", f"s * {ANNUAL}"), {"m": roll("avg", "ret", 63), "s": roll("stddev_samp", "ret", 63)})
_f(
    "skew_63", "higher_moments", "skewness about each row's own mean",
    f"{safe_div('m3', 'power(s, 3)')} * sqrt(63.0 * 62.0) / 61.0",
    {"m": roll("avg", "ret", 63), "s": roll("stddev_samp", "ret", 63)},
    {"d3": "power(ret - m, 3)"},
    {"m3": roll("avg", "d3", 63)},
)
_f("max_dd_126", "higher_moments", "distance from the highest close of 126", f"{safe_div('close', 'top')} - 1", {"top": roll("max", "close", 126)})
for _name, _column, _what in (("ep", "net_income_ttm", "earnings"), ("sp", "revenue_ttm", "sales"), ("bp", "book_equity", "book equity")):
    _f(_name, "value", f"{_what} over market value", safe_div(_column, "close * shares"), fundamentals=True)


def layered(panel: str, factors: list[str], keep: str = "ticker, date, t") -> str:
    """SQL that computes factors, as columns of their names, over ``panel`` (with fundamentals, where needed, joined)."""
    chosen = [get_factor(n) for n in factors]
    depth = max(len(f.layers) for f in chosen)
    inner, source = f"SELECT * FROM {panel}", "p0"
    out = [f"p0 AS ({inner})"]
    for i in range(depth):
        new = []
        for f in chosen:
            if i < len(f.layers):
                new += [f"{_own(f, e, i)} AS {f.name}__{c}" for c, e in f.layers[i]]
        out.append(f"p{i + 1} AS (SELECT *, {', '.join(new)} FROM {source})")
        source = f"p{i + 1}"
    values = ", ".join(f"{_own(f, f.value, len(f.layers))} AS {f.name}" for f in chosen)
    return f"WITH {', '.join(out)} SELECT {keep}, {values} FROM {source}"


def _own(f: Factor, expression: str, upto: int) -> str:
    """Columns of the factor's earlier layers get its name in front."""
    import re

    names = {c for layer in f.layers[:upto] for c, _ in layer}
    return re.sub(r"\b[a-z]\w*\b(?!\()", lambda m: f"{f.name}__{m[0]}" if m[0] in names else m[0], expression) if names else expression
