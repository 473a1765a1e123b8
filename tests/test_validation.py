import inspect
import math

import numpy as np
import pandas as pd
import pytest
from conftest import as_bars, wander
from pyspark.sql import functions as F

from barloom.functions.columns import norm_cdf, norm_cdf_column, norm_ppf, norm_ppf_column, numbered
from barloom.operators.cross_sectional import get_xs_strategy, with_weights
from barloom.operators.engine import Costs
from barloom.operators.panel import make_panel, slice_bars
from barloom.operators.strategies import get_strategy
from barloom.plans import agentic, lab
from barloom.plans import validation as v

BY = ["symbol"]


def trials(spark, x):
    t, n = x.shape
    return spark.createDataFrame(pd.DataFrame({"trial_id": np.tile(np.arange(n), t), "bar_idx": np.repeat(np.arange(t), n), "net": x.ravel()}))


def test_pbo_by_hand(spark):
    """Four chunks of two bars, six ways to choose half of them."""
    up, down = [2.0, 4.0], [-2.0, -4.0]
    turns = v.pbo(trials(spark, np.array([up * 2 + down * 2, down * 2 + up * 2]).T), 4).first()
    # {1,2} and {3,4} choose what then fails; the other four see a tie, take the first and it is as good as the other
    assert turns["n_combinations"] == 6 and turns["pbo"] == pytest.approx(2 / 6) and turns["selection_stability"] == pytest.approx(5 / 6) and turns["prob_oos_loss"] == pytest.approx(1.0)
    worse = [x - 0.5 for x in up + down + up + down]
    steady = v.pbo(trials(spark, np.array([worse, up + down + up + down, [x - 1 for x in worse]]).T), 4).first()
    assert steady["pbo"] == 0 and steady["most_selected"] == 1 and steady["selection_stability"] == 1
    one = v.pbo(trials(spark, np.array([up * 4]).T), 4).first()
    assert one["pbo"] is None and one["n_combinations"] == 0
    assert v.pbo(trials(spark, np.array([up * 2 + down * 2, down * 2 + up * 2]).T), 3).first()["n_combinations"] == 6  # an odd number of chunks is made even


def test_pbo_combinations_match_numpy(spark):
    x = np.random.default_rng(14).normal(0, 0.01, (997, 6))
    got = v.pbo_combinations(trials(spark, x), 6).orderBy("combo").toPandas()
    import itertools

    chunks = np.array_split(np.arange(997), 6)
    for row, combo in zip(got.itertuples(), itertools.combinations(range(6), 3), strict=True):
        sr = [x[np.concatenate([chunks[c] for c in range(6) if (c in combo) == side])] for side in (True, False)]
        i, o = (s.mean(0) / s.std(0) for s in sr)
        assert row.best == i.argmax() and row.oos_sharpe == pytest.approx(o[row.best]) and row.omega == pytest.approx((o <= o[row.best]).sum() / 7)


def test_permutations_keep_what_they_should(spark, bars, book_bars):
    m = v.permute_bars(bars, BY, 2)
    ends = m.filter("bar_idx = 399").toPandas().close
    np.testing.assert_allclose(ends, wander(400, 21).close.iloc[-1])  # the same moves in another order
    p = with_weights(make_panel(book_bars), "xs_reversal")
    perm = v.permute_within_dates(p, 1)
    multiset = lambda df: df.filter("listed").groupBy("ts").agg(F.sort_array(F.collect_list(F.round("weight", 9))).alias("w"))
    assert multiset(p).exceptAll(multiset(perm)).count() == 0


def test_permutation_p_values(spark):
    real = as_bars(spark, wander(800, 5, echo=0.4))
    s = get_strategy("momentum")
    from barloom.operators.engine import Costs, run_backtest
    from barloom.operators.metrics import sharpes
    from barloom.operators.strategies import with_targets

    free = Costs(0, 0, 0)
    obs = sharpes(run_backtest(with_targets(numbered(real, BY), BY, [(s, {"lookback": 2})]), BY, free), BY).first()["sharpe"]
    p = v.p_value(v.permutation_null(real, s, {"lookback": 2}, BY, 19, free), obs).first()
    assert p["n"] == 19 and p["p_value"] == pytest.approx(0.05)


def test_deflated_sharpe():
    m = {"n": 1000, "mean": 0.001, "sd": 0.01, "skew": 0.0, "kurt": 3.0}
    few, many = (v.deflated_sharpe(m, None, n)["dsr"] for n in (2, 500))
    assert few > many and v.probabilistic_sharpe(0.1, 2, 0, 3) == 0.5
    assert v.min_track_record(-0.1, 0, 3) == math.inf and v.expected_max_sharpe(1, 1.0) == 0


def test_walk_forward(spark):
    folds, stitched = v.walk_forward(numbered(as_bars(spark, wander(600, 8)), BY), get_strategy("momentum"), n_folds=3)
    assert folds.count() == 3 and stitched.groupBy("ts").count().filter("count > 1").count() == 0
    assert 0 <= v.walk_forward_summary(folds).first()["oos_win_rate"] <= 1
    assert v.fold_bounds(200) == [] and len(v.fold_bounds(2000)) == 5


def test_walk_forward_panel_matches_slices(spark, book_bars):
    """Every fold against runs of its own slices, one variant at a time."""
    p, rule = make_panel(book_bars), get_xs_strategy("xs_reversal")
    bounds = v.fold_bounds(450, 2)
    got = {r.fold: r for r in v.walk_forward_panel(p, rule, n_folds=2, grid_limit=3).collect()}
    assert len(got) == len(bounds) == 2
    grid = rule.grid(3)
    sharpe = lambda df: lab.portfolio_metrics(lab.portfolio_returns(lab.run_portfolio(df))).first()
    for fold, start, test, stop in bounds:
        seen = [sharpe(with_weights(slice_bars(p, start, test), rule.key, g))["sharpe"] for g in grid]
        best = int(np.argmax(seen))
        warm = with_weights(slice_bars(p, start, stop), rule.key, grid[best]).select("symbol", "ts", "weight")
        out = sharpe(slice_bars(p, test, stop).join(warm, ["symbol", "ts"]))
        assert got[fold].trial_id == best and got[fold].is_sharpe == pytest.approx(seen[best])
        assert got[fold].oos_sharpe == pytest.approx(out["sharpe"]) and got[fold].oos_max_dd == pytest.approx(out["max_drawdown"])


def test_normal_distribution(spark):
    x = [*np.linspace(-9, 9, 181), -40.0, 40.0]
    p = [1e-300, 1e-12, *np.linspace(0.001, 0.999, 200), 1 - 1e-12]
    got = spark.createDataFrame([(float(a),) for a in x], "x double").select("x", norm_cdf_column(F.col("x")).alias("y")).collect()
    assert all(r.y == pytest.approx(norm_cdf(r.x), rel=1e-9, abs=1e-14) for r in got)
    got = spark.createDataFrame([(float(a),) for a in p], "p double").select("p", norm_ppf_column(F.col("p")).alias("y")).collect()
    assert all(r.y == pytest.approx(norm_ppf(r.p), rel=1e-9, abs=1e-12) for r in got)
    odd = spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double").select(norm_ppf_column(F.col("p")).alias("y")).collect()
    assert all(r.y is None for r in odd)


def test_attribution_matches_numpy(spark, book_bars):
    """Least squares with robust errors, from the definition."""
    p = make_panel(book_bars)
    dates, styles = lab.portfolio_returns(lab.run_portfolio(with_weights(p, "xs_reversal"))), lab.style_factors(p)
    got = lab.factor_attribution(dates, styles)
    wide = styles.toPandas().pivot(index="bar_idx", columns="factor", values="net").merge(dates.select("bar_idx", "net").toPandas(), on="bar_idx").dropna()
    names = [f for f in ("market", "momentum", "low_vol", "reversal", "liquidity") if wide[f].std() > 1e-12]
    x, y = np.column_stack([np.ones(len(wide)), wide[names]]), wide["net"].to_numpy()
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e, inverse = y - x @ beta, np.linalg.inv(x.T @ x)
    errors = np.sqrt(np.diag(inverse @ (x.T * e**2) @ x @ inverse))
    assert got["n_obs"] == len(wide) and got["alpha_annual"] == pytest.approx(beta[0] * 252) and got["alpha_t_stat"] == pytest.approx(beta[0] / errors[0])
    assert got["betas"] == pytest.approx(dict(zip(names, beta[1:], strict=True))) and got["beta_t_stats"] == pytest.approx(dict(zip(names, beta[1:] / errors[1:], strict=True)))
    assert got["r_squared"] == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
    assert not lab.factor_attribution(dates.limit(20), styles)["available"]


def test_portfolio_lab(spark, book_bars):
    p = make_panel(book_bars)
    cfg = lab.PortfolioConfig("xs_reversal", n_permutations=9, n_folds=2, n_splits=4, grid_limit=3, rebalance=None, max_weight=None)
    r = lab.run_portfolio_lab(p, cfg)
    row, dates = r.score.first(), lab.portfolio_returns(lab.run_portfolio(with_weights(p, "xs_reversal")))
    m = lab.portfolio_metrics(dates).first()
    assert row.sharpe == pytest.approx(m["sharpe"]) and row.max_drawdown == pytest.approx(m["max_drawdown"]) and row.turnover_ann == pytest.approx(m["turnover_ann"])
    assert r.extra["permutation"]["n"] == 9 and row.p_value in [pytest.approx(k / 10) for k in range(1, 11)]
    assert r.trials.select("trial_id").distinct().count() == 3 and r.extra["dsr"]["n_trials"] == 3
    assert row.biased is False and r.extra["survivorship"]["n_delisted"] == 1 and r.extra["attribution"]["available"]
    assert 0 <= row.score <= 100 and row.grade in "ABCDF" and row.cost_ratio is not None and (row.alpha_significant or row.score <= lab.CAPS["no_alpha"])
    late = lab.run_portfolio_lab(p, lab.PortfolioConfig("equal_weight", n_permutations=1, n_folds=2, n_splits=4, grid_limit=2, allow_short=False, max_leverage=0.5, rebalance=None, max_weight=None)).runs
    assert late.groupBy("ts").agg(F.sum(F.abs("held")).alias("g")).agg(F.max("g")).first()[0] == pytest.approx(0.5)


def test_score_caps(spark):
    row = dict.fromkeys(lab.INPUTS) | {"total_return": -0.1, "sharpe": 1.0, "max_drawdown": -0.6, "n_trades": 5.0, "turnover_ann": 1.0, "benchmark_sharpe": 2.0, "p_value": 0.001, "dsr": 1.0, "pbo": 0.0, "wf_efficiency": 1.0, "wf_win_rate": 1.0, "cost_ratio": 1.0}
    got = lab.reality_score(lab._input_row(spark, row)).first()
    assert got["score"] == 50 and got["grade"] == "D" and {"lost_money", "deep_drawdown", "few_trades", "benchmark_wins"} <= set(got["flags"])
    none = lab.reality_score(lab._input_row(spark, row | {"total_return": 1.0, "max_drawdown": -0.1, "n_trades": 50.0} | dict.fromkeys(("p_value", "dsr", "pbo", "wf_efficiency", "cost_ratio")))).first()
    assert none["score"] == 50


def test_environment_and_signals(spark, bars):
    acts = numbered(bars, BY).withColumn("action", F.when(F.col("bar_idx") == 0, 2).when(F.col("bar_idx") == 10, 0).otherwise(1))
    steps = agentic.simulate_environment(acts, BY, max_position=100).orderBy("ts").toPandas()
    assert steps.balance.iloc[0] < 100_000 and steps.position.iloc[9] == 100 and steps.position.iloc[10] == 0 and len(steps) == 399
    s = agentic.signals(bars, BY)
    assert s.filter("action = 'hold' and quantity <> 0").count() == 0 and s.filter("action <> 'hold' and quantity < 1").count() == 0
    rate = agentic.fills(s.filter("action <> 'hold'"), BY, 0.5).agg(F.avg(F.col("success").cast("double"))).first()[0]
    assert 0.35 < rate < 0.65


def test_arenas_deflate_by_each_rules_own_grid(spark, book_bars):
    bars = as_bars(spark, wander(200, 3))
    got = {r.strategy: r for r in lab.run_arena(bars, 2).collect()}
    for key in ("buy_and_hold", "sma_cross"):
        s = get_strategy(key)
        runs = lab.run_backtest(lab.with_targets(numbered(bars, BY), BY, [(s, s.clean())]), BY)
        assert got[key].dsr == pytest.approx(v.deflated_sharpe(v.moments_of(runs), None, len(s.grid(40)))["dsr"])
        assert got[key].max_drawdown == pytest.approx(lab.compute_metrics(runs, BY).first()["max_drawdown"])
    p = make_panel(book_bars)
    races = {r.strategy: r for r in lab.run_portfolio_arena(p, 2, lab.PortfolioConfig(max_weight=0.15)).collect()}
    key = "xs_reversal"
    dates = lab.portfolio_returns(lab.run_portfolio(with_weights(p, key), rebalance="M", max_weight=0.15))
    assert races[key].dsr == pytest.approx(v.deflated_sharpe(v.moments_of(dates), None, len(lab.get_xs_strategy(key).grid(24)))["dsr"])
    assert races[key].turnover_ann == pytest.approx(lab.portfolio_metrics(dates).first()["turnover_ann"])
    assert races[key].alpha_t_stat == pytest.approx(lab.factor_attribution(dates, lab.style_factors(p)).get("alpha_t_stat"))


def test_attribution_of_many_keys_in_one_plan(spark, book_bars):
    p = make_panel(book_bars)
    styles, parts = lab.style_factors(p), []
    for k in ("xs_reversal", "low_volatility"):
        parts.append(lab.portfolio_returns(lab.run_portfolio(with_weights(p, k))).select("bar_idx", "net").withColumn("rule", F.lit(k)))
    parts.append(parts[0].limit(30).withColumn("rule", F.lit(None).cast("string")))
    got = {r.rule: r.asDict() for r in lab.attributed(parts[0].unionByName(parts[1]).unionByName(parts[2]), styles, ["rule"]).collect()}
    assert set(got) == {"xs_reversal", "low_volatility", None} and not got[None]["available"] and got[None]["n_obs"] <= 30 and got[None]["alpha_annual"] is None
    for k, part in zip(("xs_reversal", "low_volatility"), parts[:2], strict=True):
        one = lab.factor_attribution(part, styles)
        for name, value in one.items():
            assert got[k][name] == (pytest.approx(value, rel=1e-6) if isinstance(value, (float, dict)) else value), name


def hourly(frame, hours=7):
    """The same bars, an hour apart, on days of seven."""
    days = pd.bdate_range("2021-03-01", periods=len(frame) // hours + 1)
    return frame.assign(ts=[days[k // hours] + pd.Timedelta(hours=9 + k % hours) for k in range(len(frame))])


def test_labs_infer_the_step_of_the_bars(spark, book_bars):
    frame = wander(260, 8)
    small = lab.LabConfig("momentum", {"lookback": 5}, n_permutations=2, n_folds=2, n_splits=4, grid_limit=2)
    daily, hours = (lab.run_lab(as_bars(spark, f), small).metrics.first() for f in (frame, hourly(frame)))
    ppy = round(6.5 * 3600 / 3600 * 252)
    assert daily.years == pytest.approx(260 / 252) and hours.years == pytest.approx(260 / ppy)
    assert hours.total_return != 0 and hours.sharpe == pytest.approx(daily.sharpe * (ppy / 252) ** 0.5, rel=0.02)  # but for a year's cost of shorts
    assert lab.step_of(as_bars(spark, hourly(frame))) == ppy and lab.step_of(as_bars(spark, frame), 12) == 12
    weekly = frame.assign(ts=pd.date_range("2021-01-04", periods=260, freq="7D"))
    assert lab.step_of(as_bars(spark, weekly)) == 50
    races = {r.strategy: r for r in lab.run_arena(as_bars(spark, hourly(frame)), 1, lab.LabConfig(costs=Costs(0, 0, 0), allow_short=False, lag=2, max_leverage=0.5)).collect()}
    s = get_strategy("sma_cross")
    runs = lab.run_backtest(lab.with_targets(numbered(as_bars(spark, hourly(frame)), BY), BY, [(s, s.clean())]), BY, Costs(0, 0, 0), lag=2, max_leverage=0.5, allow_short=False, ppy=ppy)
    assert races["sma_cross"].sharpe == pytest.approx(lab.compute_metrics(runs, BY, ppy).first()["sharpe"])


def test_largest_share_of_a_name(spark, book_bars):
    """Five names at 0.1 each cannot hold more than a half; a panel of less than 250 dates is refused."""
    p = make_panel(book_bars.filter("symbol <> 'N4'"))
    r = lab.run_portfolio_lab(p, lab.PortfolioConfig("equal_weight", n_permutations=1, n_folds=2, n_splits=4, grid_limit=2, max_weight=0.1, rebalance="D"))
    top = r.runs.agg(F.max(F.abs("held"))).first()[0]
    gross = r.runs.groupBy("ts").agg(F.sum(F.abs("held")).alias("g")).agg(F.max("g")).first()[0]
    assert top == pytest.approx(0.1) and gross == pytest.approx(0.5) and r.extra["ppy"] == 252
    with pytest.raises(ValueError, match="250"):
        lab.run_portfolio_lab(p.filter("bar_idx < 249"))


@pytest.mark.parametrize(("name", "least"), [("z1_reality_score", 250), ("z2_arena", 120), ("z3_portfolio_arena", 80), ("t4_p_value", 300), ("t7_cross_permutation_null", 200)])
def test_queries_draw_as_many_permutations_as_the_reference(monkeypatch, name, least):
    from barloom import catalogue

    class Drawn(Exception):
        pass

    def stop(n):
        raise Drawn(n)

    for where, f in ((v, "permutation_null"), (v, "cross_permutation_null"), (lab, "run_lab"), (lab, "run_arena"), (lab, "run_portfolio_arena")):
        monkeypatch.setattr(where, f, (lambda f: lambda *a, **k: stop((b := inspect.signature(f).bind(*a, **k), b.apply_defaults())[0].arguments))(getattr(where, f)))
    monkeypatch.setattr(catalogue.src, "bars_market", lambda *a: None)
    monkeypatch.setattr(catalogue, "the_panel", lambda *a: None)
    monkeypatch.setattr(catalogue, "with_weights", lambda *a: None)
    with pytest.raises(Drawn) as e:
        catalogue.QUERIES[name](None, None)
    found = e.value.args[0]
    n = found["cfg"].n_permutations if "cfg" in found else found.get("n_permutations", found.get("n_perm"))
    assert n == least
