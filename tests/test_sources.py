import datetime as dt
import json

import pandas as pd
import pytest
from conftest import as_bars, wander
from pyspark.sql import functions as F

from barloom import cli
from barloom.plans import agentic
from barloom.sources import bars as src
from barloom.sources import generators as gen
from barloom.streaming import bars as live
from barloom.streaming import poll

ROW = "symbol string, Date timestamp_ntz, Open double, `Adj Close` double, seq int"
D = dt.datetime


def test_normalise(spark):
    raw = spark.createDataFrame([("a", D(2024, 1, 1), 1.0, 2.0, 0), ("a", D(2024, 1, 1), 1.0, 3.0, 1), ("a", D(2024, 1, 2), 1.0, 0.0, 2), ("a", D(2024, 1, 3), 1.0, None, 3), ("a", D(2024, 1, 4), None, float("nan"), 4)], ROW)
    got = src.normalise(raw, "seq").collect()
    assert [(r.close, r.high, r.volume) for r in got] == [(3.0, 3.0, 0.0)]
    with pytest.raises(ValueError):
        src.normalise(raw.drop("Adj Close"), "seq")
    with pytest.raises(ValueError):
        src.normalise(raw, "seq", "first", drop_null=True)


def test_validate(spark):
    good = as_bars(spark, wander(10, 1))
    v = lambda df: src.validate(df).first()
    assert v(good)["valid"] and not v(good.limit(0))["valid"]
    assert not v(good.withColumn("low", F.lit(-1.0)))["valid"] and v(good.withColumn("volume", F.lit(-1.0)))["valid"]
    assert not v(good.withColumn("high", F.col("open") - 1))["valid"]
    one = v(good.withColumn("close", F.when(F.dayofmonth("ts") > 1, F.col("close"))))
    assert one["valid"] and one["n_missing"] == 1
    assert v(good.withColumn("volume", F.lit(0.0)))["volume_warning"]


def test_windows_of_vendors(spark):
    b = spark.createDataFrame([("a", D(2024, 1, k), c) for k, c in ((1, 1200.0), (2, 1208.0), (3, 120.5), (4, 121.0))], "symbol string, ts timestamp_ntz, close double")
    assert src.split_suspects(b, ["symbol"]).first()["suspects"] == 1
    now = F.lit(D(2024, 1, 4, 12)).cast("timestamp_ntz")
    assert src.drop_incomplete(b, "1d", now).count() == 3 and src.drop_incomplete(b, "odd", now).count() == 4
    assert src.clamp_window(b, F.lit(D(2020, 1, 1)).cast("timestamp_ntz"), now, now + F.expr("INTERVAL 5 DAYS"), "1m").count() == 2


def test_load_falls_back(spark):
    few, many, sim = (as_bars(spark, wander(n, 1)) for n in (10, 60, 70))
    assert src.load_bars("auto", many, few, sim)[1] == "bundled" and src.load_bars("auto", few, None, sim)[1] == "synthetic" and src.load_bars("yahoo", None, many, sim)[1] == "yfinance"
    with pytest.raises(RuntimeError):
        src.load_bars("live", many, few, sim)


def test_load_counts_rows_in_the_window_and_caches_live_bars(spark, tmp_path):
    live_bars, sim = as_bars(spark, wander(90, 2, "A")), as_bars(spark, wander(60, 3, "A"))
    got, origin = src.load_bars("auto", None, live_bars, sim, start=D(2021, 3, 1), end=D(2021, 6, 1), cache=str(tmp_path / "c"), interval="1d")
    assert origin == "yfinance" and got.count() == 67 and src.read_cache(spark, str(tmp_path / "c"), "1d", ["A"]).count() == 90
    assert src.load_bars("auto", None, live_bars, sim, start=D(2021, 6, 1))[1] == "synthetic"  # too few rows there


def test_panel_notes(spark):
    have, sim = as_bars(spark, pd.concat([wander(130, 1, "A"), wander(20, 2, "B")])), as_bars(spark, pd.concat([wander(140, 3, "A"), wander(150, 4, "C")]))
    got, notes = src.load_panel_bars(have, ["a", "B", "c ", "x", "A"], 120, sim)
    assert {r.symbol: (r.bars, r.note) for r in notes.collect()} == {"A": (130, "loaded"), "B": (20, "skipped"), "C": (150, "simulated"), "X": (0, "skipped")}
    assert {r.symbol: r["count"] for r in got.groupBy("symbol").count().collect()} == {"A": 130, "C": 150}


def test_dispatch_and_config(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"data_source": {"type": "synthetic", "path": "%s"}}' % (tmp_path / "made"))
    (tmp_path / "c.yaml").write_text("data_source: {type: vendor}\n")
    config = src.read_config(str(tmp_path / "c.json"))
    make = lambda n: lambda: gen.walk_bars(spark, "T", "2024-01-01", n)
    assert src.load_data(spark, config, make(60)).count() == 60 and src.load_data(spark, config, make(5)).count() == 60
    assert src.load_data(spark, src.read_config(str(tmp_path / "c.yaml")), vendors={"vendor": lambda c: make(7)()}).count() == 7
    assert src.load_data(spark, {"data_source": {"type": "odd"}}, strict=False) is None
    with pytest.raises(ValueError):
        src.load_data(spark, {"data_source": {"type": "odd"}})


def test_vendor_history(spark):
    raw = spark.createDataFrame([("a", D(2024, 6, k), c, k) for k, c in ((3, 1200.0), (4, 1208.0), (5, 120.5), (6, 121.0))], "symbol string, Date timestamp_ntz, `Adj Close` double, seq int")
    at = lambda *x: F.lit(D(*x)).cast("timestamp_ntz")
    got, suspects = src.vendor_history(raw, "seq", at(2024, 6, 1), at(2024, 6, 30), at(2024, 6, 6, 12), "1d")
    assert got.count() == 3 and suspects.first()["suspects"] == 1  # the bar of the 6th still forms


def test_nudged_bars(spark):
    one = live.nudged(as_bars(spark, wander(1, 5, "A")), 3).first()
    assert abs(one.close / one.open - 1) <= 0.01 and one.high == max(one.open, one.close) and one.low == min(one.open, one.close)


def test_generators(spark):
    one, two = (gen.simulate(spark, ["AAPL"], "2018-01-01", "2019-12-31").toPandas() for _ in range(2))
    assert one.equals(two) and abs(one.close.iloc[-1] - 190) < 1e-9 and (one.high >= one[["open", "close"]].max(axis=1)).all() and (one.low > 0).all()
    with pytest.raises(ValueError):
        gen.simulate(spark, ["AAPL"], "2018-01-01", "2018-01-10")
    w = gen.walk_bars(spark, "T", "2024-01-01", 100)
    assert w.count() == 100 and w.filter("high < low or high < close or low > open").count() == 0
    assert gen.walk_ticks(spark, "T", "2024-01-01", 10).count() == 600
    with pytest.raises(ValueError):
        gen.scenario(spark, "odd", "T", "2024-01-01", 10)


def test_high_water_over_restarts(spark, tmp_path):
    put = lambda days, k: spark.createDataFrame([("a", D(2024, 1, d), 1.0, 1.0, 1.0, float(d), 1.0) for d in days], live.BAR).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for k, days in enumerate(([1, 5], [3, 5, 9])):
        put(days, k)
        live.run_available(live.new_bars(live.read_bar_files(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "marks"))
    assert sorted(r.close for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1.0, 5.0, 9.0]
    live.run_available(live.recent_bars(live.read_bar_files(spark, str(tmp_path / "in"), 10)), str(tmp_path / "recent"), str(tmp_path / "marks2"))
    assert spark.read.parquet(str(tmp_path / "recent")).count() == 5
    assert live.next_delay(60, 10, uniform=lambda a, b: 1.0) == 900 and live.next_delay(60, 1, uniform=lambda a, b: 1.0) == 120


def test_cli(capsys):
    assert cli.main(["strategies"]) == 0 and "sma_cross" in capsys.readouterr().out
    assert cli.params(["fast=10"]) == {"fast": 10.0} and cli.main(["lab", "/nowhere", "--param", "fast"]) == 1


def shown(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_cli_runs_the_signal_in_its_three_modes(spark, capsys, tmp_path):
    bars = as_bars(spark, wander(120, 4))
    src.write_csv(bars, f"{tmp_path}/csv")
    config = {"data_source": {"type": "csv", "path": f"{tmp_path}/csv"}, "trading": {"symbol": "WAVE", "capital": 5000}, "risk": {"max_position": 7}}
    where = tmp_path / "config.json"
    go = lambda c, *more: (where.write_text(json.dumps(c)), cli.main(["run", "--config", str(where), "--json", *more]))[1]
    assert go(config) == 0
    one = shown(capsys)
    want = agentic.run_once(bars, ["symbol"], capital=5000.0, max_position=7).first()
    assert len(one) == 1 and one[0]["action"] == want.action and one[0]["quantity"] == want.quantity <= 7
    assert go(config, "--mode", "backtest", "--start-date", "2021-03-10", "--end-date", "2021-07-30") == 0
    got = shown(capsys)[0]
    some = bars.filter((F.col("ts") >= "2021-03-10") & (F.col("ts") <= "2021-07-30"))
    summary = agentic.signal_backtest_summary(agentic.signal_backtest(some, ["symbol"], 5000.0, 7), ["symbol"], 5000.0).first()
    assert got["total_return"] == pytest.approx(summary.total_return) and got["trades"] == summary.trades
    for k in range(2):
        poll.record(spark, bars.filter(F.col("ts") < "2021-05-01") if k == 0 else bars.filter(F.col("ts") >= "2021-05-01"), f"{tmp_path}/polls", k)
    polled = config | {"data_source": {"type": "polls", "path": f"{tmp_path}/polls"}, "live": {"output": f"{tmp_path}/fills", "checkpoint": f"{tmp_path}/ck", "seconds": 1}}
    assert go(polled, "--mode", "live", "--duration", "0.5") == 0
    fills = shown(capsys)
    assert len(fills) == 1 and fills[0]["quantity"] == want.quantity and fills[0]["price"] == pytest.approx(want.price)
    assert go(polled) == 0 and shown(capsys)[0]["quantity"] == want.quantity  # the same polls as a table


def test_cli_flags_are_heeded(spark, tmp_path):
    p = cli.parser()
    a = p.parse_args(["portfolio-arena", "x", "--lag", "2", "--leverage", "0.5", "--long-only", "--seed", "9", "--rebalance", "W", "--capital", "5", "--max-weight", "0.2", "--borrow", "7"])
    cfg = cli.config(a)
    assert (cfg.lag, cfg.max_leverage, cfg.allow_short, cfg.seed, cfg.rebalance, cfg.capital, cfg.max_weight, cfg.costs.borrow, a.permutations) == (2, 0.5, False, 9, "W", 5.0, 0.2, 7.0, 80)
    b = cli.config(p.parse_args(["arena", "x", "--block", "5"]))
    assert b.block == 5 and p.parse_args(["arena", "x"]).permutations == 120 and p.parse_args(["portfolio", "x"]).permutations == 150 and p.parse_args(["lab", "x"]).folds == 5
    for flag in (["lab", "x", "--rebalance", "W"], ["arena", "x", "--strategy", "momentum"]):  # refused, not ignored
        with pytest.raises(SystemExit):
            p.parse_args(flag)
    src.write_cache(as_bars(spark, wander(60, 1, "A")), f"{tmp_path}/cache", "1d")
    got = cli.load(spark, p.parse_args(["lab", f"{tmp_path}/cache", "--source", "cache", "--symbol", "A,B", "--start", "2021-03-08", "--end", "2021-03-20"]))
    assert got.count() == 10
