"""Repository, incremental updates, runner, API and command line."""

import datetime
import json
import threading
import urllib.request

import pandas as pd
import pytest

from tidemark import analytics
from tidemark.app import api, cli
from tidemark.app.runner import PipelineRunner, Stage
from tidemark.operators.backtest import BacktestConfig
from tidemark.sources.repository import DataRepository, FundamentalsRepository, Manifest, PriceDownloader, Universe, flatten, fundamentals, settings
from tidemark.streaming.incremental import IncrementalUpdater

START = datetime.date(2020, 1, 1)


def _bars(days, tickers=("A", "B"), first=0):
    return pd.DataFrame([(START + datetime.timedelta(i), t, 100.0 + i, 101.0 + i, 99.0 + i, 100.0 + i, 1e6) for i in range(first, days) for t in tickers], columns=["date", "ticker", "open", "high", "low", "close", "volume"])


def test_repository(spark, tmp_path):
    repo = DataRepository(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        repo.load_panel("prices")
    made = repo.save_panel("prices", spark.createDataFrame(_bars(5)), universe="two", source="test")
    assert (made.n_rows, made.n_tickers, made.start, made.end) == (10, 2, "2020-01-01", "2020-01-05")
    assert repo.load_manifest("prices") == made and repo.load_panel("prices").count() == 10
    repo.save_panel("prices", spark.createDataFrame(_bars(6)))
    assert repo.load_long("prices").count() == 12 and repo.vacuum("prices") == 1 and repo.load_long("prices").count() == 12
    assert Manifest.from_dict({"universe": "x", "other": 1}).universe == "x"


def test_settings(monkeypatch, tmp_path):
    monkeypatch.setenv("TIDEMARK_DATA", "/d")
    assert settings().cache_dir == "/d/cache"
    monkeypatch.delenv("TIDEMARK_DATA")
    (tmp_path / "data").mkdir()
    monkeypatch.chdir(tmp_path)
    assert settings().data_dir == str(tmp_path / "data")


def test_download(spark):
    rows = _bars(3)

    def fetch(names, start, end):
        if "BAD" in names:
            raise OSError("no")
        return rows[rows.ticker.isin(names)]

    bars, report = PriceDownloader(spark, fetch, batch=1, retries=2, pause=0.0).download(["A", "BAD", "B", "A"], "2020-01-01")
    assert report.requested == 3 and report.failed_tickers == ["BAD"] and bars.count() == 6 == report.rows
    with pytest.raises(RuntimeError):
        PriceDownloader(spark, fetch, retries=1).download(["BAD"], "2020-01-01")
    wide = spark.createDataFrame([("2020-01-01", 1.0, None, 5.0)], "date string, `Close|X.Y` double, `Close|Z` double, `Volume|X.Y` double")
    assert [(r.ticker, r.close, r.volume) for r in flatten(wide).collect()] == [("X.Y", 1.0, 5.0)]


def test_universe_and_fundamentals(spark, tmp_path):
    (tmp_path / "u.csv").write_text("ticker,sector,date_added\n BRK.B ,Fin,2010-02-16\nAA,Mat,\nAA,Other,\n,Fin,\nBB,,\n")
    u = Universe.bundled(spark, [str(tmp_path / "none"), str(tmp_path)], "u")
    assert {(r.ticker, r.sector, r.date_added) for r in u.members.collect()} == {("BRK-B", "Fin", datetime.date(2010, 2, 16)), ("AA", "Mat", None)}
    assert len(u) == 2 and u.contains("AA") and not u.contains("BB") and len(u.restrict(["AA"])) == 1
    assert {r.ticker: (r.Fin, r.Mat) for r in u.sector_dummies().collect()} == {"BRK-B": (1.0, 0.0), "AA": (0.0, 1.0)}
    with pytest.raises(FileNotFoundError):
        Universe.bundled(spark, [str(tmp_path)], "other")
    quarters = spark.createDataFrame([("A", q, float(q), 10.0) for q in range(6)] + [("B", 1, 2.0, None)], "ticker string, quarter int, net_income double, revenue double")
    equity = spark.createDataFrame([("A", 5.0, None, 7.0), ("B", 1.0, 3.0, 4.0), ("C", None, 1.0, 1.0)], "ticker string, shares double, e1 double, e2 double")
    got = {r.ticker: r[1:] for r in fundamentals(quarters, equity).collect()}
    assert got == {"A": (14.0, 40.0, 7.0, 5.0), "B": (2.0, None, 3.0, 1.0)}
    store = FundamentalsRepository(spark, str(tmp_path / "f"))
    with pytest.raises(FileNotFoundError):
        store.load()
    assert store.refresh(lambda: fundamentals(quarters, equity)).count() == 2 and store.snapshot_date() is not None


def test_incremental_update(spark, tmp_path):
    repo = DataRepository(spark, str(tmp_path))
    repo.save_panel("prices", spark.createDataFrame(_bars(40)), universe="u")
    fresh = pd.concat([_bars(43, ("A", "B", "C"))])
    fresh.loc[(fresh.ticker == "A") & (fresh.date == START + datetime.timedelta(35)), "close"] = 1.0
    fresh.loc[(fresh.ticker == "B") & (fresh.date == START + datetime.timedelta(36)), ["close"]] = float("nan")
    fresh.loc[(fresh.ticker == "B") & (fresh.date == START + datetime.timedelta(37)), ["volume"]] = float("nan")

    def fetch(names, start, end):
        return fresh[fresh.ticker.isin(names) & (fresh.date >= datetime.date.fromisoformat(start))]

    report = IncrementalUpdater(repo, fetch, pause=0.0).update("prices", ["A", "B", "C", "D"])
    assert (report.new_rows, report.revised_rows, report.new_tickers, report.up_to_date) == (6, 1, ["C"], False)
    rows = {(r.ticker, (r.date - START).days): r for r in repo.load_long("prices").collect()}
    assert len(rows) == 43 * 3 == report.n_rows_after and rows["A", 35].close == 1.0 and rows["B", 36].close == 136.0 and rows["B", 37].volume == 1e6
    assert repo.load_manifest("prices").universe == "u"
    assert IncrementalUpdater(repo, fetch, pause=0.0).update("prices").up_to_date

    def explodes(names, start, end):
        raise OSError("down")

    before = repo.load_manifest("prices")
    with pytest.raises(RuntimeError):
        IncrementalUpdater(repo, explodes, pause=0.0).update("prices")
    assert repo.load_manifest("prices") == before and repo.load_long("prices").count() == len(rows)
    with pytest.raises(FileNotFoundError):
        IncrementalUpdater(repo, fetch).update("other")


def test_runner(tmp_path):
    ran = []

    def make(name):
        def run(params, given):
            if params.get("fail"):
                raise OSError("broken")
            ran.append(name)
            path = tmp_path / f"{name}.txt"
            path.write_text(json.dumps(params))
            return [str(path)]

        return run

    stages = {"c": Stage(make("c"), ("a", "b")), "a": Stage(make("a")), "b": Stage(make("b"), ("a",))}
    runner = PipelineRunner(stages, str(tmp_path / "run"))
    assert runner.order() == ["a", "b", "c"] and [r.status for r in runner.run()] == ["done"] * 3
    assert [r.status for r in runner.run()] == ["skipped"] * 3 and len(ran) == 3
    assert [r.status for r in runner.run({"b": {"x": 1}})] == ["skipped", "done", "done"]
    (tmp_path / "c.txt").unlink()
    assert [r.status for r in runner.run({"b": {"x": 1}})] == ["skipped", "skipped", "done"]
    assert [r.status for r in runner.run({"c": False})][2] == "disabled"
    with pytest.raises(OSError):
        runner.run({"b": {"fail": True}})
    assert {r["name"]: r["status"] for r in json.loads((tmp_path / "run/manifest.json").read_text())["stages"]}["b"] == "failed"
    with pytest.raises(ValueError):
        PipelineRunner({"a": Stage(make("a"), ("a",))}, str(tmp_path)).order()


@pytest.fixture(scope="module")
def bars(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = []
    for k in range(12):
        c = 50 * np.exp(np.cumsum(rng.normal(0.0005, 0.015, 150)))
        rows += [((pd.Timestamp("2020-01-01") + pd.offsets.BDay(i)).date(), f"T{k:02d}", c[i], c[i] * 1.01, c[i] * 0.99, c[i], 1e6) for i in range(150)]
    return spark.createDataFrame([tuple(float(x) if isinstance(x, np.floating) else x for x in r) for r in rows], "date date, ticker string, open double, high double, low double, close double, volume double")


def test_api(spark, bars):
    panel = analytics.PricePanel.from_long(bars)
    sectors = spark.createDataFrame([(f"T{k:02d}", f"S{k % 2}") for k in range(12)], "ticker string, sector string")
    config = BacktestConfig(rebalance="MS", top_n=3, side="long", min_dollar_vol_musd=0.0, benchmark=None, exclude=())
    state = api.DashboardState(panel, ["mom_21", "rev_5"], sectors=sectors, config=config, min_history=30)
    get = lambda path, **q: api.dispatch(state, "GET", f"/api/{path}", q)
    assert get("health") == (200, {"status": "ok", "factors": 2})
    status, value = get("overview")
    assert status == 200 and value["tickers"] == 12 and json.dumps(value, allow_nan=False)
    assert get("factors")[1]["factors"][0]["category"] and get("factors", horizon="99")[0] == 422
    assert len(get("factors/mom_21/decay")[1]["decay"]) == 8 and get("factors/none/decay")[0] == 404
    post = lambda **b: api.dispatch(state, "POST", "/api/backtest", {}, b)
    status, value = post(factor="rev_5", direction=-1, top_n=3)
    assert status == 200 and len(value["dates"]) == len(value["equity"]) and json.dumps(value, allow_nan=False)
    assert [post(factor="none")[0], post(factor="mom_21", side="up")[0], post(factor="mom_21", rebalance="X")[0], post(factor="mom_21", top_n=0)[0], post(factor="mom_21", other=1)[0]] == [404, 422, 422, 422, 422]
    assert get("risk")[0] == 200 and get("universe")[1]["sectors"][0]["n"] == 6 and get("universe/pit")[1]["stats"]["n_tickers_ever"] == 12
    assert get("ml")[0] == 404 and get("none")[0] == 404
    server = api.serve(state, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/api/health") as answer:
            assert json.load(answer)["status"] == "ok"
    finally:
        server.shutdown()


def test_command_line(spark, bars, tmp_path, capsys):
    bars.write.parquet(str(tmp_path / "bars"))
    data = ["--data", str(tmp_path / "data")]
    run = lambda *a: (cli.main([*data, *a], spark), json.loads(capsys.readouterr().out.strip().splitlines()[-1]))[1]
    assert run("download", "--bars", str(tmp_path / "bars"))["n_tickers"] == 12
    assert len(run("factors", "--factors", "mom_21,rev_5", "--min-history", "30")) == 2
    common = ["--factors", "mom_21,rev_5", "--min-history", "30", "--out", str(tmp_path / "out")]
    got = run("backtest", *common, "--top-n", "3", "--min-dollar-vol", "0", "--benchmark", "T00")
    assert got["n_days"] > 50 and (tmp_path / "out/backtest_summary.md").exists()
    assert run("fundamentals") == {"snapshot_date": None, "tickers": 0}
