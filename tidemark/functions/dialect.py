"""Expressions that Spark SQL and DuckDB spell differently, and windows over a panel.

Plans are written once as SQL text; Spark runs them on its tables, and the same text in the other dialect is the oracle.
"""

from __future__ import annotations

import re


class Dialect:
    def __init__(self, name: str):
        self.spark = name == "spark"

    def percentile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})" if self.spark else f"quantile_cont({x}, {p})"

    def last_known(self, x: str, over: str) -> str:
        return f"last_value({x}) IGNORE NULLS OVER ({over})" if self.spark else f"last_value({x} IGNORE NULLS) OVER ({over})"

    def days(self, a: str, b: str) -> str:
        """a - b in days."""
        return f"CAST(datediff({a}, {b}) AS BIGINT)" if self.spark else f"CAST(date_diff('day', {b}, {a}) AS BIGINT)"

    def plus_days(self, d: str, n: int) -> str:
        return f"date_add({d}, {n})" if self.spark else f"CAST({d} + INTERVAL '{n}' DAY AS DATE)"

    def bucket(self, kind: str, d: str = "date") -> str:
        """The calendar bucket that a date is in: D, W-FRI, W-MON, MS, ME."""
        if kind == "D":
            return d
        if kind in ("MS", "ME"):
            return f"CAST(date_trunc('month', {d}) AS DATE)"
        shift = {"W-FRI": 2, "W-MON": -1}[kind]
        return f"CAST(date_trunc('week', {self.plus_days(d, shift)}) AS DATE)"

    def min_by(self, x: str, by: str) -> str:
        return f"min_by({x}, {by})" if self.spark else f"arg_min({x}, {by})"

    def max_by(self, x: str, by: str) -> str:
        return f"max_by({x}, {by})" if self.spark else f"arg_max({x}, {by})"

    def rows(self, names: str, values: list[tuple]) -> str:
        """An inline table."""
        text = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in values)
        return f"(SELECT * FROM (VALUES {text}) AS inline_rows({names}))"


SPARK, DUCKDB = Dialect("spark"), Dialect("duckdb")


def trailing(n: int | None, skip: int = 0, by: str = "ticker", order: str = "t") -> str:
    """The last n rows up to the current one (all rows for None), less the last ``skip``."""
    start = "UNBOUNDED PRECEDING" if n is None else f"{n - 1 + skip} PRECEDING"
    part = f"PARTITION BY {by} " if by else ""
    return f"{part}ORDER BY {order} ROWS BETWEEN {start} AND {f'{skip} PRECEDING' if skip else 'CURRENT ROW'}"


def roll(f: str, x: str, n: int, least: int | None = None, skip: int = 0, by: str = "ticker") -> str:
    """f over a trailing window, NULL unless ``least`` (all, by default) of its values are there."""
    w = trailing(n, skip, by)
    call = f.format(x=x) if "{x}" in f else f"{f}({x})"
    return f"CASE WHEN count({x}) OVER ({w}) >= {n if least is None else least} THEN {call} OVER ({w}) END"


def lag(x: str, n: int, by: str = "ticker") -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY {by} ORDER BY t)"


def lead(x: str, n: int, by: str = "ticker") -> str:
    return f"lead({x}, {n}) OVER (PARTITION BY {by} ORDER BY t)"


def safe_div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def average_rank(x: str, by: str) -> str:
    """Rank with ties at their mean; meaningful where x is not NULL."""
    return f"(rank() OVER (PARTITION BY {by}, ({x}) IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)"


def doubles(sql: str) -> str:
    """Number literals with a point are doubles: Spark would read them as decimals."""
    return re.sub(r"(?<![\w.#'])(\d+\.\d+)(?![\w.'])", r"\1e0", sql)
