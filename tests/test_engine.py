import numpy as np
import pandas as pd
import pytest
from conftest import as_bars, wander
from pyspark.sql import functions as F

from barloom.functions.columns import numbered
from barloom.functions.indicators import with_indicators
from barloom.operators import metrics
from barloom.operators.cross_sectional import with_weights
from barloom.operators.engine import Costs, run_backtest
from barloom.operators.panel import make_panel, select_symbols, survivorship
from barloom.operators.portfolio import carried, contributions, normalise_weights, portfolio_returns, run_portfolio
from barloom.operators.strategies import REGISTRY, get_strategy, with_targets

BY = ["symbol"]


def test_indicators_match_pandas(spark, bars):
    wanted = [("sma", 10), ("ema", 12), ("rsi", 14), ("atr", 14), ("macd", 12, 26, 9), ("boll", 20, 2.0), ("donchian", 20), ("rv", 20)]
    got = with_indicators(bars, BY, wanted).orderBy("ts").toPandas()
    frame = wander(400, 21)
    c = frame.close
    d = c.diff()
    gain, loss = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean(), (-d).clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    e = lambda x, k: x.ewm(span=k, adjust=False, min_periods=k).mean()
    line = e(c, 12) - e(c, 26)
    want = {"sma_10": c.rolling(10).mean(), "ema_12": e(c, 12), "rsi_14": 100 - 100 / (1 + gain / loss), "macd_12_26_9_hist": line - e(line, 9), "boll_20_2p0_high": c.rolling(20).mean() + 2 * c.rolling(20).std(ddof=0)}
    want |= {"donchian_20_high": frame.high.rolling(20).max().shift(1), "rv_20": c.pct_change().rolling(20).std(ddof=0) * np.sqrt(252)}
    for k, v in want.items():
        np.testing.assert_allclose(got[k].astype(float), v, rtol=1e-9, err_msg=k)


def test_targets_are_causal(spark):
    pdf = wander(300, 3)
    rules = [(s, s.clean({"lookback": 40, "slow": 60})) for s in REGISTRY.values()]
    run = lambda n: with_targets(numbered(as_bars(spark, pdf.iloc[:n]), BY), BY, rules).filter("bar_idx < 200").orderBy("trial_id", "bar_idx").select("target").toPandas()
    pd.testing.assert_frame_equal(run(300), run(200))


def test_costs_and_lag(spark, bars):
    held = with_targets(numbered(bars, BY), BY, [(get_strategy("buy_and_hold"), {})])
    out = run_backtest(held, BY).orderBy("ts").toPandas()
    assert out.position.iloc[0] == 0 and out.position.iloc[1] == 1
    assert (out.traded.abs() > 1e-12).sum() == 1  # buy and hold pays once
    free = run_backtest(held, BY, Costs(0, 0, 0)).toPandas()
    np.testing.assert_allclose(free.net, free.gross)
    with pytest.raises(ValueError):
        run_backtest(held, BY, lag=0)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("x", i, r, e, 0.0) for i, (r, e) in enumerate([(0.0, 100.0), (0.2, 120.0), (-0.5, 60.0), (0.5, 90.0)])], "symbol string, ts int, net double, equity double, position double")
    m = metrics.compute_metrics(df, BY).first()
    assert m["max_drawdown"] == -0.5 and m["time_under_water_yrs"] == 2 / 252 and m["total_return"] == pytest.approx(-0.1)
    flat = spark.createDataFrame([("x", i, 0.001, 1.0) for i in range(100)], "symbol string, ts int, net double, equity double")
    assert metrics.sharpes(flat, BY).first()["sharpe"] == 0
    r = wander(400, 21).close.pct_change().dropna()
    df = spark.createDataFrame([("x", i, float(v), 1.0, 0.0) for i, v in enumerate(r)], df.schema)
    m = metrics.compute_metrics(df, BY).first()
    assert m["skew"] == pytest.approx(r.skew()) and m["kurtosis"] == pytest.approx(r.kurtosis()) and m["var_95"] == pytest.approx(np.percentile(r, 5))


def test_one_name_portfolio_is_the_engine(spark, bars):
    single = run_backtest(with_targets(numbered(bars, BY), BY, [(get_strategy("momentum"), {})]), BY).orderBy("ts").toPandas()
    p = make_panel(bars).join(with_targets(numbered(bars, BY), BY, [(get_strategy("momentum"), {})]).select("symbol", "ts", F.col("target").alias("weight")), ["symbol", "ts"])
    book = portfolio_returns(run_portfolio(p)).orderBy("ts").toPandas()
    np.testing.assert_allclose(book.net, single.net, atol=1e-12)


def test_panel_and_book(spark, book_bars):
    p = make_panel(book_bars)
    assert p.count() == 6 * 450
    assert p.filter("symbol = 'N1' and bar_idx between 150 and 179").filter("close is not null or tradable").count() == 0
    s = survivorship(p).first()
    assert s["n_delisted"] == 1 and s["delisted"] == ["N4"] and s["late"] == ["N5"] and not s["biased"]
    with pytest.raises(ValueError):
        make_panel(book_bars.drop("volume"))
    with pytest.raises(ValueError):
        select_symbols(p, ["NONE"])
    book = run_portfolio(with_weights(p, "xs_reversal"))
    assert book.filter("not tradable and held <> 0").count() == 0
    total = contributions(book).agg(F.sum("contribution")).first()[0]
    assert total == pytest.approx(portfolio_returns(book).agg(F.sum("gross")).first()[0])
    over = normalise_weights(p.withColumn("weight", F.lit(1.0)), []).groupBy("ts").agg(F.sum(F.abs("target")).alias("g")).agg(F.max("g")).first()[0]
    assert over == pytest.approx(1.0)


def test_drift_matches_a_loop(spark, book_bars):
    p = run_portfolio(with_weights(make_panel(book_bars), "xs_reversal"))
    got = carried(p.drop("traded", "bench"), [], "21").orderBy("bar_idx", "symbol").toPandas()
    shape = (450, 6)
    target, r, ok = p.orderBy("bar_idx", "symbol").toPandas()[["held", "asset_ret", "tradable"]].to_numpy().T
    target, r, ok = target.astype(float).reshape(shape), r.astype(float).reshape(shape), ok.astype(bool).reshape(shape)
    now, want = np.zeros(6), []
    for t in range(450):
        now = np.where(ok[t], target[t] if t % 21 == 0 else now, 0)
        want.append(now)
        now = now * (1 + r[t]) / (1 + now @ r[t])
    np.testing.assert_allclose(got.held.to_numpy().reshape(shape), np.array(want), atol=1e-12)
