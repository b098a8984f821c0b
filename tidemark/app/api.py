"""What a dashboard asks for, as functions that return JSON values, and a small HTTP server over them.

Tables are computed when first asked for and kept; one lock guards that.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import analytics
from tidemark.app.report import clean, records
from tidemark.operators.backtest import BacktestConfig, LinearCost, run_backtest
from tidemark.operators.factors import list_factors
from tidemark.storage import stage


class ApiError(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


class DashboardState:
    """A panel, its universe and what follows from them."""

    def __init__(self, panel: analytics.PricePanel, factors: list[str], added: DataFrame | None = None, sectors: DataFrame | None = None, config: BacktestConfig | None = None, min_history: int = 260):
        self.panel, self.factors, self.added, self.sectors = panel, factors, added, sectors
        self.config = config or BacktestConfig()
        self.library = analytics.FactorLibrary(panel, min_history)
        self._lock, self._kept = threading.RLock(), {}

    def keep(self, key: str, make: Callable):
        with self._lock:
            if key not in self._kept:
                self._kept[key] = make()
            return self._kept[key]

    def universe(self) -> analytics.PointInTimeUniverse:
        return self.keep("pit", lambda: analytics.PointInTimeUniverse.from_snapshot(self.panel, self.added, self.config.exclude))

    def stats(self, horizon: int = 5) -> list[dict]:
        return self.keep(f"stats {horizon}", lambda: records(analytics.FactorEvaluator(self.panel, horizon).evaluate_all(self.library.long(self.factors))))

    def flagship(self):
        """Backtest of the five best factors by absolute information ratio, each in its direction, within the universe."""

        def make():
            best = [r for r in self.stats() if r["ic_ir"] is not None][:5]
            signal = self.library.composite([r["factor"] for r in best], direction={r["factor"]: 1 if r["ic_mean"] >= 0 else -1 for r in best})
            return run_backtest(self.panel.df, stage(signal, "flagship"), self.config, self.universe().members)

        return self.keep("flagship", make)


def health(state: DashboardState) -> dict:
    return {"status": "ok", "factors": len(state.factors)}


def overview(state: DashboardState) -> dict:
    dates, names = state.panel.shape()
    quality = state.keep("quality", lambda: analytics.DataQualityChecker().run(state.panel.to_long().filter("close is not null")).to_dict())
    return clean({"dates": dates, "tickers": names, "quality": quality, "flagship": records(state.flagship().summary())[0], "universe": records(state.universe().stats())[0]})


def factors(state: DashboardState, horizon: int = 5) -> dict:
    _between("horizon", horizon, 1, 63)
    about = {f.name: f for f in list_factors()}
    rows = [r | {"category": about[r["factor"]].category, "description": about[r["factor"]].description} for r in state.stats(horizon)]
    return {"horizon": horizon, "factors": rows}


def factor_decay(state: DashboardState, name: str) -> dict:
    _known(state, name)
    rows = state.keep(f"decay {name}", lambda: records(analytics.FactorEvaluator(state.panel).ic_decay(state.library.compute(name))))
    return {"factor": name, "decay": sorted(rows, key=lambda r: r["horizon"])}


def backtest(state: DashboardState, request: dict) -> dict:
    """Of one factor or of several with weights; ``direction`` is said, not guessed."""
    allowed = {"factor", "factors", "weights", "direction", "rebalance", "side", "top_n", "cost_bps", "point_in_time"}
    if extra := request.keys() - allowed:
        raise ApiError(422, f"unknown fields {sorted(extra)}")
    names = request.get("factors") or [request.get("factor")]
    for n in names:
        _known(state, n)
    rebalance, side = request.get("rebalance", "MS"), request.get("side", "long")
    if rebalance not in ("D", "W-FRI", "W-MON", "MS", "ME"):
        raise ApiError(422, f"unknown rebalance {rebalance}")
    if side not in ("long", "short", "long_short"):
        raise ApiError(422, f"unknown side {side}")
    top_n, bps = request.get("top_n", state.config.top_n), request.get("cost_bps", 10.0)
    _between("top_n", top_n, 1, 100)
    _between("cost_bps", bps, 0, 50)
    direction = request.get("direction", 1)
    if len(names) == 1:
        signal = state.library.compute(names[0]).withColumn("value", F.col("value") * direction)
    else:
        signal = state.library.composite(names, request.get("weights"), {n: direction for n in names})
    options = {k: getattr(state.config, k) for k in ("min_price", "min_dollar_vol_musd", "benchmark", "exclude", "max_weight")}
    config = BacktestConfig(rebalance=rebalance, side=side, top_n=top_n, cost=LinearCost(bps), **options)
    try:
        result = run_backtest(state.panel.df, stage(signal, "signal"), config, state.universe().members if request.get("point_in_time") else None)
    except ValueError as e:
        raise ApiError(422, str(e)) from e
    return _bundle(result)


def _bundle(result) -> dict:
    daily = records(result.daily.select("date", "net", "bench").orderBy("date"))
    curve = {r["date"]: r["equity"] for r in records(result.equity())}
    return clean({
        "summary": records(result.summary())[0], "dates": [r["date"] for r in daily], "net": [r["net"] for r in daily], "benchmark": [r["bench"] for r in daily],
        "equity": [curve.get(r["date"]) for r in daily], "mean_turnover": result.turnover.agg(F.avg("turnover")).first()[0], "holdings": records(result.holdings().orderBy(F.desc("weight"), "ticker")),
    })


def risk(state: DashboardState) -> dict:
    result = state.flagship()
    returns, bench = (result.daily.select("date", F.col(c).alias("ret")) for c in ("net", "bench"))
    return clean({
        "summary": records(analytics.risk_summary(returns, bench))[0], "episodes": records(analytics.drawdown_episodes(returns)),
        "stress": records(analytics.stress_test(returns)), "rolling": records(analytics.rolling_risk(returns, bench).orderBy("date")),
    })


def universe(state: DashboardState) -> dict:
    if state.sectors is None:
        raise ApiError(404, "no sectors are known")
    return {"sectors": records(state.sectors.groupBy("sector").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "sector"))}


def universe_pit(state: DashboardState) -> dict:
    """Figures, additions a year, and the number of members at each week's last date."""
    pit = state.universe()
    weeks = pit.n_members().groupBy(F.date_trunc("week", "date").alias("week")).agg(F.max("date").alias("date"), F.max_by("members", "date").alias("members"))
    return {"stats": records(pit.stats())[0], "additions": records(pit.additions_by_year().orderBy("year")), "members": records(weeks.select("date", "members").orderBy("date"))}


def ml(state: DashboardState, folder: str | None = None) -> dict:
    """A saved training run's summary; 404 without one."""
    if folder is None:
        raise ApiError(404, "no training run is saved")
    spark = state.panel.df.sparkSession
    return {"ic_summary": records(spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/ic_summary"))}


def _between(name: str, x, low, high) -> None:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not low <= x <= high:
        raise ApiError(422, f"{name} must lie between {low} and {high}")


def _known(state: DashboardState, name) -> None:
    if name not in state.factors:
        raise ApiError(404, f"unknown factor {name}")


def dispatch(state: DashboardState, method: str, path: str, query: dict[str, str] | None = None, body: dict | None = None) -> tuple[int, dict]:
    """(status, JSON value) of a request."""
    query = query or {}
    parts = [p for p in path.split("/") if p]
    try:
        if parts[:1] != ["api"]:
            raise ApiError(404, "not found")
        match (method, *parts[1:]):
            case ("GET", "factors", name, "decay"):
                return 200, factor_decay(state, name)
            case ("GET", "factors"):
                return 200, factors(state, int(query.get("horizon", "5")))
            case ("POST", "backtest"):
                return 200, backtest(state, body or {})
            case ("GET", "universe", "pit"):
                return 200, universe_pit(state)
            case ("GET", "ml"):
                return 200, ml(state, query.get("folder"))
            case ("GET", ("health" | "overview" | "risk" | "universe") as name):
                return 200, {"health": health, "overview": overview, "risk": risk, "universe": universe}[name](state)
        raise ApiError(404, "not found")
    except ApiError as e:
        return e.status, {"detail": str(e)}
    except ValueError as e:
        return 422, {"detail": str(e)}


def serve(state: DashboardState, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is ready to run; the caller calls serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            url = urlparse(self.path)
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                body = json.loads(raw) if raw else None
            except ValueError:
                status, value = 422, {"detail": "the body isn't JSON"}
            else:
                status, value = dispatch(state, method, url.path, {k: v[-1] for k, v in parse_qs(url.query).items()}, body)
            out = json.dumps(value).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def do_GET(self) -> None:
            self._answer("GET")

        def do_POST(self) -> None:
            self._answer("POST")

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
