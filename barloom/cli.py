"""Command line: one rule or book examined, races of all, and the list of rules, over bars in Parquet, CSV or a cache."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.cross_sectional import list_xs_strategies
from .operators.engine import Costs
from .operators.panel import make_panel
from .operators.strategies import list_strategies
from .plans import agentic, lab
from .ship import ship
from .sources.bars import load_data, read_cache, read_config, read_csv
from .sources.scratch import exists, scratch
from .streaming import bars as live
from .streaming import poll


PORTFOLIO = ("portfolio", "portfolio-arena")
COMMANDS = {"lab": (250, 5), "arena": (120, 5), "portfolio": (150, 4), "portfolio-arena": (80, 4)}  # permutations and folds


def params(pairs: list[str]) -> dict[str, float]:
    """['fast=10'] -> {'fast': 10.0}"""
    out = dict(p.split("=", 1) if "=" in p else _refuse(p) for p in pairs)
    return {k.strip(): float(v) for k, v in out.items()}


def _refuse(pair: str):
    raise ValueError(f"{pair!r} is not name=value")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("barloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, (permutations, folds) in COMMANDS.items():
        c, book = sub.add_parser(name), name in PORTFOLIO
        c.add_argument("bars", help="Parquet of symbol, ts, ohlcv; a cache's folder with --source cache")
        c.add_argument("--source", choices=["table", "cache", "csv"], default="table")
        c.add_argument("--interval", default="1d", help="of a cache")
        c.add_argument("--symbol", action="append", default=[])
        c.add_argument("--start")
        c.add_argument("--end")
        c.add_argument("--permutations", type=int, default=permutations)
        c.add_argument("--commission", type=float, default=1.0)
        c.add_argument("--slippage", type=float, default=2.0)
        c.add_argument("--borrow", type=float, default=50.0)
        c.add_argument("--lag", type=int, default=1)
        c.add_argument("--leverage", type=float, default=1.0)
        c.add_argument("--long-only", action="store_true")
        c.add_argument("--capital", type=float, default=1_000_000.0 if book else 100_000.0)
        c.add_argument("--seed", type=int, default=1)
        c.add_argument("--json", action="store_true")
        if book:
            c.add_argument("--rebalance", default="M", help="D, W, M, Q or a number of bars")
            c.add_argument("--max-weight", type=float, default=0.25)
        else:
            c.add_argument("--block", type=int, help="permute blocks of so many bars, not single ones")
        if not name.endswith("arena"):
            c.add_argument("--strategy", default="xs_momentum" if book else "sma_cross")
            c.add_argument("--param", action="append", default=[])
            c.add_argument("--folds", type=int, default=folds)
    sub.add_parser("strategies")
    c = sub.add_parser("run", help="the one-rule signal, as a config says")
    c.add_argument("--mode", choices=["standard", "backtest", "live"], default="standard")
    c.add_argument("--config", default="config.yaml")
    c.add_argument("--start-date", default="2024-01-01")
    c.add_argument("--end-date", default="2024-12-31")
    c.add_argument("--duration", type=float, default=60, help="minutes of live trading")
    c.add_argument("--json", action="store_true")
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The latest bar's fill of each symbol; a backtest's summary between two dates; or the fills of a live run.

    config: data_source (type csv with path, or polls with the folder of polls as path), trading (symbol,
    capital), risk (max_position), live (output folder, checkpoint folder, seconds between batches).
    """
    cfg = read_config(a.config)
    trading, source = cfg.get("trading", {}), cfg.get("data_source", {})
    how = {"capital": float(trading.get("capital", 100_000.0)), "max_position": int(cfg.get("risk", {}).get("max_position", 100))}
    if a.mode == "live":
        live_cfg = cfg.get("live", {})
        out = live_cfg.get("output") or scratch(spark)
        poll.register(spark)
        stream = spark.readStream.format("bar_poll").option("path", source["path"]).option("interval", live_cfg.get("seconds", 60)).load().drop("poll")
        query = live.trade_live(stream, live.batch_sink(out), live_cfg.get("checkpoint") or scratch(spark), every=f"{live_cfg.get('seconds', 60)} seconds", **how)
        try:
            query.awaitTermination(int(a.duration * 60))
        finally:
            query.stop()
        return spark.read.parquet(out) if exists(spark, out) else spark.createDataFrame([], "symbol string")
    bars = load_data(spark, cfg, vendors={"polls": lambda c: _polled(spark, c)})
    bars = bars.withColumn("symbol", F.coalesce("symbol", F.lit(trading.get("symbol", "UNKNOWN"))))
    if a.mode == "standard":
        return agentic.run_once(bars, ["symbol"], **how)
    inside = bars.filter(F.col("ts").between(F.lit(a.start_date).cast("timestamp_ntz"), F.lit(a.end_date).cast("timestamp_ntz")))
    return agentic.signal_backtest_summary(agentic.signal_backtest(inside, ["symbol"], **how), ["symbol"], how["capital"])


def _polled(spark: SparkSession, cfg: dict) -> DataFrame:
    poll.register(spark)
    return spark.read.format("bar_poll").option("path", cfg["data_source"]["path"]).load().drop("poll").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def config(a: argparse.Namespace) -> lab.LabConfig:
    """What the flags say; a command has those flags only that it heeds."""
    given = {"costs": Costs(a.commission, a.slippage, a.borrow), "n_permutations": a.permutations, "seed": a.seed, "lag": a.lag, "max_leverage": a.leverage, "allow_short": not a.long_only, "capital": a.capital}
    if "strategy" in a:
        given |= {"strategy": a.strategy, "params": params(a.param), "n_folds": a.folds}
    if a.command in PORTFOLIO:
        return lab.PortfolioConfig(**given, rebalance=a.rebalance, max_weight=a.max_weight)
    return lab.LabConfig(**given, block=a.block)


def load(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    wanted = [s.strip() for x in a.symbol for s in x.split(",") if s.strip()]
    if a.source == "cache":
        bars = read_cache(spark, a.bars, a.interval, wanted)
    else:
        bars = read_csv(spark, a.bars) if a.source == "csv" else spark.read.parquet(a.bars)
        bars = bars.filter(F.upper("symbol").isin([s.upper() for s in wanted])) if wanted else bars
    bars = bars.filter(F.col("ts") >= F.lit(a.start).cast("timestamp_ntz")) if a.start else bars
    return bars.filter(F.col("ts") <= F.lit(a.end).cast("timestamp_ntz")) if a.end else bars


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
        if a.command == "strategies":
            for s in [*list_strategies(), *list_xs_strategies()]:
                print(s.key, json.dumps(s.clean()), len(s.grid()))
            return 0
        spark = SparkSession.builder.getOrCreate()
        ship(spark)
        bars, cfg = (None, None) if a.command == "run" else (load(spark, a), config(a))
        if a.command == "run":
            rows = run(spark, a)
        elif a.command == "arena":
            rows = lab.run_arena(bars, a.permutations, cfg)
        elif a.command == "portfolio-arena":
            rows = lab.run_portfolio_arena(make_panel(bars), a.permutations, cfg)
        else:
            rows = (lab.run_lab(bars, cfg) if a.command == "lab" else lab.run_portfolio_lab(make_panel(bars), cfg)).score
        for r in lab.to_json(rows).collect():  # a row per report or rule
            print(r["json"] if a.json else " ".join(f"{k}={v}" for k, v in json.loads(r["json"]).items()))
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
