"""Tearsheets: figures of a backtest as JSON and Markdown, and the tables that charts are drawn from."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import analytics
from tidemark.operators.backtest import BacktestResult, LinearCost


def clean(x):
    """For JSON: dates as text, numbers rounded, what isn't finite as null."""
    if isinstance(x, dict):
        return {str(k): clean(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [clean(v) for v in x]
    if isinstance(x, float):
        return round(x, 6) if math.isfinite(x) else None
    if x is None or isinstance(x, (str, int, bool)):
        return x
    return clean(x.asDict()) if hasattr(x, "asDict") else str(x)


def records(df: DataFrame, most: int = 5_000) -> list[dict]:
    """A small table for JSON; ValueError for more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    return [clean(r.asDict()) for r in rows]


def _returns(result: BacktestResult, column: str = "net") -> DataFrame:
    return result.daily.select("date", F.col(column).alias("ret"))


def metrics_block(result: BacktestResult) -> dict:
    """Performance, risk, the three deepest falls, turnover and what costs took a year."""
    cost = result.config.cost
    years = result.daily.agg((F.count("net") / 252).alias("y"), F.sum("cost").alias("c")).first()
    return {
        "config": result.config.describe(),
        "performance": records(result.summary())[0],
        "risk": records(analytics.risk_summary(_returns(result), _returns(result, "bench")))[0],
        "drawdowns": records(analytics.drawdown_episodes(_returns(result), 3)),
        "mean_turnover": clean(result.turnover.agg(F.avg("turnover")).first()[0]),
        "cost_drag_ann": clean(years.c / years.y if years.y else None),
        "cost_bps": cost.bps_per_side if isinstance(cost, LinearCost) else None,
    }


def tearsheet(result: BacktestResult, folder: str, name: str = "backtest") -> dict:
    """Write ``name``_metrics.json and ``name``_summary.md into a local folder and return the figures."""
    block = metrics_block(result)
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / f"{name}_metrics.json").write_text(json.dumps(clean(block), indent=2))
    p = block["performance"]

    def shown(x, form: str) -> str:
        return "n/a" if x is None else format(x, form)

    lines = [f"# {name}", "", "| figure | value |", "|-|-|"]
    for label, key, form in (("CAGR", "cagr", "+.2%"), ("Sharpe", "sharpe", ".3f"), ("deepest fall", "max_drawdown", ".2%"), ("information ratio", "information_ratio", "+.3f"), ("beta", "beta", ".2f"), ("days", "n_days", "d")):
        lines.append(f"| {label} | {shown(p.get(key), form)} |")
    lines += [f"| mean turnover | {shown(block['mean_turnover'], '.2f')} |", f"| cost a year | {shown(block['cost_drag_ann'], '.4f')} |", ""]
    (out / f"{name}_summary.md").write_text("\n".join(lines))
    return block


def equity_curves(result: BacktestResult) -> DataFrame:
    """(date, strategy, benchmark)."""
    return result.equity().select("date", F.col("equity").alias("strategy")).join(result.benchmark_equity().withColumnRenamed("equity", "benchmark"), "date").orderBy("date")


def rolling_sharpe(result: BacktestResult, window: int = 126) -> DataFrame:
    return analytics.rolling_risk(_returns(result), window=window).select("date", "sharpe")


def monthly_heatmap(result: BacktestResult) -> DataFrame:
    """Months of each year, their mean, and the year compounded."""
    months = analytics.monthly_returns(_returns(result))
    names = [c for c in months.columns if c != "year"]
    known = sum((F.col(c).isNotNull().cast("int") for c in names[1:]), F.col(names[0]).isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in names[1:]), F.coalesce(names[0], F.lit(0.0)))
    whole = F.lit(1.0)
    for c in names:
        whole = whole * (1 + F.coalesce(c, F.lit(0.0)))
    return months.select("*", F.try_divide(total, known).alias("mean_month"), (whole - 1).alias("year_compounded")).orderBy("year")


def ic_curve(ic: DataFrame, window: int = 63) -> DataFrame:
    """(date, ic, mean, cumulative) of (date, ic)."""
    w = Window.orderBy("date")
    return ic.select("date", "ic", F.avg("ic").over(w.rowsBetween(1 - window, 0)).alias("mean"), F.sum(F.coalesce("ic", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))


def ic_heatmap(ics: DataFrame) -> DataFrame:
    """(factor, year, month, ic): monthly means of (date, factor, ic)."""
    return ics.groupBy("factor", F.year("date").alias("year"), F.month("date").alias("month")).agg(F.avg("ic").alias("ic"))


def quantile_curves(buckets: DataFrame) -> DataFrame:
    """(date, bucket, growth): compounded returns of (date, bucket, mean_return)."""
    run = Window.partitionBy("bucket").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return buckets.select("date", "bucket", F.exp(F.sum(F.log1p("mean_return")).over(run)).alias("growth"))


def top_importances(importance: dict[str, float], n: int = 15) -> list[tuple[str, float]]:
    return sorted(importance.items(), key=lambda x: (-x[1], x[0]))[:n]


def correlation_matrix(wide: DataFrame, names: list[str]) -> DataFrame:
    """(factor, <names>): correlations of columns over rows that have both; NULL for constants."""
    pairs = [(a, b) for a in names for b in names]
    both = {(a, b): F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs}
    one = wide.agg(*(F.try_divide(F.covar_pop(F.when(both[p], F.col(p[0])), F.when(both[p], F.col(p[1]))), F.stddev_pop(F.when(both[p], F.col(p[0]))) * F.stddev_pop(F.when(both[p], F.col(p[1])))).alias(f"c{i}") for i, p in enumerate(pairs)))
    k = len(names)
    rows = [F.struct(F.lit(a).alias("factor"), *(F.col(f"c{i * k + j}").alias(b) for j, b in enumerate(names))) for i, a in enumerate(names)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
