"""Command line: python -m tidemark COMMAND. Prices come from stored datasets or from long Parquet files."""

from __future__ import annotations

import argparse
import json

from tidemark.sources.repository import DataRepository, Universe, settings


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--data", default=None, help="folder of datasets")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("download", help="store long bars as a dataset")
    c.add_argument("--name", default="prices")
    c.add_argument("--bars", required=True, help="Parquet of (date, ticker, close, ...)")
    c = sub.add_parser("universe", help="sectors of a universe file")
    c.add_argument("csv")
    c = sub.add_parser("fundamentals", help="the date and size of the stored snapshot")
    c.add_argument("--path", default=None)
    for name in ("factors", "backtest", "train", "dashboard", "pipeline"):
        c = sub.add_parser(name)
        c.add_argument("--name", default="prices")
        c.add_argument("--factors", default="mom_21,rev_5,vol_21,bb_pos,sma_ratio_50")
        c.add_argument("--min-history", type=int, default=260)
        if name == "factors":
            c.add_argument("--horizon", type=int, default=5)
        if name in ("backtest", "dashboard", "pipeline"):
            c.add_argument("--top-n", type=int, default=15)
            c.add_argument("--side", default="long", choices=["long", "short", "long_short"])
            c.add_argument("--rebalance", default="MS")
            c.add_argument("--benchmark", default="SPY")
            c.add_argument("--min-dollar-vol", type=float, default=20.0)
            c.add_argument("--vol-target", type=float, default=None)
        if name in ("backtest", "train", "pipeline"):
            c.add_argument("--out", default="results")
        if name in ("train", "pipeline"):
            c.add_argument("--splits", type=int, default=6)
            c.add_argument("--min-train", type=int, default=504)
        if name == "dashboard":
            c.add_argument("--port", type=int, default=8000)
    return p


def _config(args):
    from tidemark.operators.backtest import BacktestConfig

    return BacktestConfig(rebalance=args.rebalance, side=args.side, top_n=args.top_n, benchmark=args.benchmark, exclude=(args.benchmark,), min_dollar_vol_musd=args.min_dollar_vol, vol_target=args.vol_target)


def _backtest(panel, args, folder: str) -> dict:
    from tidemark import analytics
    from tidemark.app.report import tearsheet
    from tidemark.operators.backtest import run_backtest
    from tidemark.storage import stage

    names = args.factors.split(",")
    library = analytics.FactorLibrary(panel, args.min_history)
    stats = {r.factor: r for r in analytics.FactorEvaluator(panel).evaluate_all(library.long(names)).collect()}  # a row a factor
    best = sorted((n for n in names if n in stats and stats[n].ic_ir is not None), key=lambda n: -abs(stats[n].ic_ir))[:5]
    signal = library.composite(best, direction={n: 1 if stats[n].ic_mean >= 0 else -1 for n in best})
    return tearsheet(run_backtest(panel.df, stage(signal, "signal"), _config(args)), folder)


def _train(spark, panel, args, folder: str):
    from tidemark.ml.features import FeatureConfig, training_panel
    from tidemark.ml.training import BoostedTreesAlphaModel, PurgedWalkForwardCV, RidgeAlphaModel, TrainingPipeline

    names = args.factors.split(",")
    panel.df.createOrReplaceTempView("training_source")
    rows = training_panel(spark, "training_source", names, FeatureConfig(warm_up=args.min_history))
    got = TrainingPipeline([RidgeAlphaModel(), BoostedTreesAlphaModel()], PurgedWalkForwardCV(args.splits, min_train=args.min_train)).run(rows, names)
    got.save(folder)
    return got


def main(argv: list[str] | None = None, spark=None) -> int:
    args = _parser().parse_args(argv)
    if spark is None:
        from tidemark.session import session

        spark = session()
    from tidemark import analytics
    from tidemark.app.report import clean, records

    folder = args.data or settings().cache_dir
    repository = DataRepository(spark, folder)
    if args.command == "download":
        print(json.dumps(repository.save_panel(args.name, spark.read.parquet(args.bars), source=args.bars).to_dict()))
        return 0
    if args.command == "universe":
        print(json.dumps(records(Universe.from_csv(spark, args.csv).sector_counts().orderBy("sector"))))
        return 0
    if args.command == "fundamentals":
        from tidemark.sources.repository import FundamentalsRepository

        stored = FundamentalsRepository(spark, args.path or f"{folder}/fundamentals")
        day = stored.snapshot_date()
        print(json.dumps({"snapshot_date": str(day) if day else None, "tickers": stored.load().count() if day else 0}))
        return 0
    panel = analytics.PricePanel.from_long(repository.load_long(args.name).filter("close is not null"))
    if args.command == "factors":
        library = analytics.FactorLibrary(panel, args.min_history)
        print(json.dumps(records(analytics.FactorEvaluator(panel, args.horizon).evaluate_all(library.long(args.factors.split(","))))))
    elif args.command == "backtest":
        print(json.dumps(clean(_backtest(panel, args, args.out)["performance"])))
    elif args.command == "train":
        print(json.dumps(records(_train(spark, panel, args, f"{args.out}/train").ic_summary())))
    elif args.command == "dashboard":
        from tidemark.app.api import DashboardState, serve

        serve(DashboardState(panel, args.factors.split(","), config=_config(args), min_history=args.min_history), port=args.port).serve_forever()
    else:
        print(json.dumps([r.as_dict() for r in stages(spark, panel, args).run()]))
    return 0


def stages(spark, panel, args):
    """The runner of the standing pipeline: quality, factors, backtest, train, monitoring."""
    from pathlib import Path

    from tidemark import analytics
    from tidemark.app.report import records
    from tidemark.app.runner import PipelineRunner, Stage
    from tidemark.ml.monitoring import monitoring_report

    out = Path(args.out)
    out.mkdir(parents=True, exist_ok=True)

    def written(name: str, value) -> list[str]:
        (out / name).write_text(json.dumps(value, default=str, indent=2))
        return [str(out / name)]

    def monitoring(params, given):
        ic = spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/train/ic_by_date")
        names = [r.factor for r in ic.select("factor").distinct().collect()]  # a row a model
        return written("monitoring.json", {n: monitoring_report(ic.filter(ic.factor == n), n).as_dict() for n in sorted(names)})

    def factors(params, given):
        library = analytics.FactorLibrary(panel, args.min_history)
        return written("factors.json", records(analytics.FactorEvaluator(panel).evaluate_all(library.long(args.factors.split(",")))))

    def train(params, given):
        _train(spark, panel, args, f"{out}/train")
        return [f"{out}/train"]

    def backtest(params, given):
        _backtest(panel, args, str(out))
        return [str(out / "backtest_metrics.json")]

    return PipelineRunner(
        {
            "quality": Stage(lambda params, given: written("quality.json", analytics.DataQualityChecker().run(panel.to_long().filter("close is not null")).to_dict())),
            "factors": Stage(factors, ("quality",)),
            "backtest": Stage(backtest, ("factors",)),
            "train": Stage(train, ("quality",)),
            "monitoring": Stage(monitoring, ("train",)),
        },
        str(out),
    )
