"""Whole analyses: one rule on one series, one book on a panel, and races of all rules; each ends in a score."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numbered, ramp
from ..operators.attribution import attributed, factor_attribution, style_factors
from ..operators.cross_sectional import get_xs_strategy, list_xs_strategies, trial_weights, with_weights
from ..operators.engine import Costs, run_backtest
from ..operators.metrics import compute_metrics, periods_per_year, sharpes
from ..operators.panel import survivorship
from ..operators.portfolio import portfolio_metrics, portfolio_returns, run_portfolio
from ..operators.strategies import get_strategy, list_strategies, with_targets
from ..sources.scratch import cut
from . import validation as v

# Weights of the score's parts, grades by least score, and the caps of weak cases.
WEIGHTS = {"significance": 0.30, "selection": 0.25, "walk_forward": 0.20, "overfitting": 0.15, "robustness": 0.10}
GRADES = ((85, "A"), (70, "B"), (55, "C"), (40, "D"), (0, "F"))
CAPS = {"lost_money": 50.0, "deep_drawdown": 60.0, "few_trades": 55.0, "no_alpha": 65.0, "survivorship": 60.0}

INPUTS = (
    "total_return", "sharpe", "max_drawdown", "n_trades", "turnover_ann", "benchmark_sharpe", "p_value", "dsr", "pbo", "wf_efficiency", "wf_win_rate", "cost_ratio",
    "benchmark_correlation", "alpha_significant", "r_squared", "biased",
)


def reality_score(rows: DataFrame) -> DataFrame:
    """Adds the parts, score, grade and flags to rows that hold INPUTS; null where a test was not run."""
    c = {n: F.col(n) for n in INPUTS}
    zero = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * 100
    wf = ramp(c["wf_efficiency"], 0.8, -0.2)
    parts: dict[str, Column] = {
        "significance": ramp(c["p_value"], 0.01, 0.50), "selection": F.when(c["dsr"].isNotNull(), zero(c["dsr"])).otherwise(50.0),
        "walk_forward": F.when(c["wf_efficiency"].isNull(), 50.0).when(c["wf_win_rate"].isNotNull(), 0.7 * wf + 0.3 * zero(c["wf_win_rate"])).otherwise(wf),
        "overfitting": ramp(c["pbo"], 0.05, 0.50), "robustness": ramp(c["cost_ratio"], 0.8, 0.0),
    }
    cases = {
        "lost_money": c["total_return"] <= 0, "compounding_loss": (c["total_return"] <= 0) & (c["sharpe"] > 0), "deep_drawdown": c["max_drawdown"] < -0.5, "few_trades": c["n_trades"] < 20,
        "not_significant": c["p_value"] > 0.10, "selection_bias": c["dsr"] < 0.5, "overfit": c["pbo"] > 0.3, "does_not_carry_forward": c["wf_efficiency"] < 0.3, "cost_fragile": c["cost_ratio"] < 0.5,
        "repackaged_benchmark": c["benchmark_correlation"] > 0.95, "benchmark_wins": c["sharpe"] < c["benchmark_sharpe"], "high_turnover": c["turnover_ann"] > 100,
        "no_alpha": ~c["alpha_significant"], "repackaged_index": c["r_squared"] > 0.9, "survivorship": c["biased"],
    }
    raw = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    capped = F.least(raw, *[F.when(cases[k], F.lit(cap)) for k, cap in CAPS.items()], F.lit(100.0))
    df = rows.withColumns(parts).withColumn("_score", F.greatest(F.lit(0.0), capped))
    grade = F.lit(None).cast("string")
    for least, g in reversed(GRADES):
        grade = F.when(F.col("_score") >= least, g).otherwise(grade)
    flags = F.filter(F.array(*[F.when(x, F.lit(k)) for k, x in cases.items()]), lambda x: x.isNotNull())
    return df.withColumns({"score": F.bround("_score", 1), "grade": grade, "flags": flags} | {k: F.bround(k, 1) for k in WEIGHTS}).drop("_score")


@dataclass
class LabConfig:
    strategy: str = "sma_cross"
    params: dict = field(default_factory=dict)
    costs: Costs = Costs()
    n_permutations: int = 250
    n_folds: int = 5
    n_splits: int = 8
    grid_limit: int = 40
    seed: int = 1
    ppy: int | None = None  # told by the bars' own step
    block: int | None = None
    lag: int = 1
    max_leverage: float = 1.0
    allow_short: bool = True
    capital: float = 100_000.0

    def how(self) -> dict:
        """Options of the engine."""
        return {"lag": self.lag, "max_leverage": self.max_leverage, "allow_short": self.allow_short, "capital": self.capital}


@dataclass
class PortfolioConfig(LabConfig):
    """A book's: dates to trade on (see rebalance_rows), and the largest share of a name."""

    strategy: str = "xs_momentum"
    n_permutations: int = 150
    n_folds: int = 4
    grid_limit: int = 24
    capital: float = 1_000_000.0
    rebalance: str | None = "M"
    max_weight: float | None = 0.25

    def how(self, capped: bool = True) -> dict:
        """Options of the portfolio; walk-forward folds are not capped by name."""
        return {"lag": self.lag, "gross_leverage": self.max_leverage, "allow_short": self.allow_short, "rebalance": self.rebalance} | ({"max_weight": self.max_weight} if capped else {})


#: Bars that a series, and dates that a panel, must have to be analysed.
LEAST_BARS, LEAST_DATES = 120, 250


def step_of(bars: DataFrame, given: int | None = None) -> int:
    """Periods in a year, from the median step between the times of bars or of a panel."""
    if given is not None:
        return given
    return _one_row(periods_per_year(bars.select("ts").distinct().withColumn("_k", F.lit(0)), ["_k"]))["ppy"]


@dataclass
class Report:
    """DataFrames of a run; `score` is one row."""

    runs: DataFrame
    metrics: DataFrame
    trials: DataFrame
    score: DataFrame
    extra: dict


def trial_returns(bars: DataFrame, key: str, costs: Costs = Costs(), limit: int | None = 40, ppy: int = 252, **how) -> DataFrame:
    """trial_id, bar_idx, net of every variant of a rule's grid over one series."""
    s = get_strategy(key)
    each = with_targets(bars, ["symbol"], [(s, g) for g in s.grid(limit)])
    return run_backtest(each, ["symbol", "trial_id"], costs, ppy=ppy, **how).select("trial_id", "bar_idx", "net")


def _trial_sharpes(trials: DataFrame, ppy: int) -> list[float]:
    """Per period; as many numbers as the grid has variants."""
    return [r["sharpe"] / ppy**0.5 for r in sharpes(trials, ["trial_id"], ppy).collect()]


def _one_row(df: DataFrame) -> dict:
    return df.first().asDict()


def run_lab(bars: DataFrame, cfg: LabConfig = LabConfig()) -> Report:
    """bars: one symbol's."""
    if len(bars.select("ts").take(LEAST_BARS)) < LEAST_BARS:
        raise ValueError(f"at least {LEAST_BARS} bars are needed")
    spark, ppy = bars.sparkSession, step_of(bars, cfg.ppy)
    bars = cut(numbered(bars, ["symbol"]))
    s = get_strategy(cfg.strategy)
    p = s.clean(cfg.params)
    stress = with_targets(bars, ["symbol"], [(s, p)]).withColumn("cost_mult", F.explode(F.array(F.lit(1), F.lit(3))))
    both = cut(run_backtest(stress, ["symbol", "cost_mult"], cfg.costs, ppy=ppy, cost_times="cost_mult", **cfg.how()))
    runs = both.filter("cost_mult = 1")
    metrics = compute_metrics(runs, ["symbol"], ppy)
    bench = compute_metrics(runs, ["symbol"], ppy, ret="ret", equity="benchmark", position=None)
    trials = cut(trial_returns(bars, cfg.strategy, cfg.costs, cfg.grid_limit, ppy, **cfg.how()))
    m, ratio = _one_row(metrics), _one_row(v.cost_stress(both, [], ppy))
    dsr = v.deflated_sharpe(v.moments_of(runs), _trial_sharpes(trials, ppy), len(s.grid(cfg.grid_limit)))
    over = _one_row(v.pbo(trials, cfg.n_splits))
    null = v.permutation_null(bars, s, p, ["symbol"], cfg.n_permutations, cfg.costs, cfg.seed, cfg.block, ppy, **cfg.how())
    test = _one_row(v.p_value(null, m["sharpe"]))
    wf = v.walk_forward(bars, s, cfg.n_folds, costs=cfg.costs, ppy=ppy, grid_limit=min(cfg.grid_limit, 24), **cfg.how())
    forward = _one_row(v.walk_forward_summary(wf[0])) if wf else {}
    row = {k: float(m[k]) for k in ("total_return", "sharpe", "max_drawdown", "n_trades", "turnover_ann")} | {
        "benchmark_sharpe": _one_row(bench)["sharpe"], "p_value": test["p_value"], "dsr": dsr["dsr"], "pbo": over["pbo"], "wf_efficiency": forward.get("efficiency"), "wf_win_rate": forward.get("oos_win_rate"),
        "cost_ratio": ratio["ratio"], "benchmark_correlation": _one_row(v.benchmark_correlation(runs, ["symbol"]))["correlation"], "alpha_significant": None, "r_squared": None, "biased": None,
    }
    return Report(runs, metrics, trials, reality_score(_input_row(spark, row)), {"dsr": dsr, "pbo": over, "permutation": test, "walk_forward": forward, "null": null})


def _input_row(spark, row: dict) -> DataFrame:
    kinds = ", ".join(f"{n} {'boolean' if n in ('alpha_significant', 'biased') else 'double'}" for n in INPUTS)
    return spark.createDataFrame([tuple(row[n] for n in INPUTS)], kinds)


def run_portfolio_lab(panel: DataFrame, cfg: PortfolioConfig = PortfolioConfig()) -> Report:
    """panel: make_panel's. Permutations deal weights anew within dates, free of cost on both sides."""
    if (panel.agg(F.max("bar_idx") + 1).first()[0] or 0) < LEAST_DATES:
        raise ValueError(f"at least {LEAST_DATES} dates are needed")
    panel = cut(panel)  # each part reads it anew
    spark, ppy, how = panel.sparkSession, step_of(panel, cfg.ppy), cfg.how()
    s = get_xs_strategy(cfg.strategy)
    weighted = cut(with_weights(panel, cfg.strategy, cfg.params))
    held = cut(run_portfolio(weighted, [], cfg.costs, ppy=ppy, **how))
    dates = cut(portfolio_returns(held, [], cfg.costs, ppy, cfg.capital))
    metrics = portfolio_metrics(dates, [], ppy)
    grid = s.grid(cfg.grid_limit)
    trials = cut(portfolio_returns(run_portfolio(trial_weights(panel, cfg.strategy, grid), ["trial_id"], cfg.costs, ppy=ppy, **how), ["trial_id"], cfg.costs, ppy).select("trial_id", "ts", "bar_idx", "net"))
    stressed = portfolio_returns(held, [], Costs(cfg.costs.commission, cfg.costs.slippage, cfg.costs.borrow, 3 * cfg.costs.times), ppy)
    both = dates.withColumn("cost_mult", F.lit(1)).unionByName(stressed.withColumn("cost_mult", F.lit(3)))
    free = Costs(0, 0, 0)
    observed = _one_row(sharpes(portfolio_returns(held, [], free, ppy).withColumn("_k", F.lit(0)), ["_k"], ppy))["sharpe"]
    null = v.cross_permutation_null(weighted, cfg.n_permutations, cfg.seed, ppy, free, **how)
    test = _one_row(v.p_value(null, observed))
    dsr = v.deflated_sharpe(v.moments_of(dates), _trial_sharpes(trials, ppy), len(grid))
    over = _one_row(v.pbo(trials, cfg.n_splits))
    folds = v.walk_forward_panel(panel, s, cfg.n_folds, costs=cfg.costs, grid_limit=min(cfg.grid_limit, 12), ppy=ppy, **cfg.how(capped=False))
    forward = _one_row(v.walk_forward_summary(folds)) if folds is not None else {}
    style = factor_attribution(dates, style_factors(panel, ppy), ppy)
    life = _one_row(survivorship(panel))
    m = _one_row(metrics)
    bench = _one_row(sharpes(dates.withColumn("_k", F.lit(0)), ["_k"], ppy, "bench"))["sharpe"]
    row = {k: float(m[k]) for k in ("total_return", "sharpe", "max_drawdown", "n_trades", "turnover_ann")} | {
        "benchmark_sharpe": bench, "p_value": test["p_value"], "dsr": dsr["dsr"], "pbo": over["pbo"], "wf_efficiency": forward.get("efficiency"), "wf_win_rate": forward.get("oos_win_rate"),
        "cost_ratio": _one_row(v.cost_stress(both, [], ppy))["ratio"], "benchmark_correlation": _one_row(dates.agg(v.correlation("net", "bench").alias("c")))["c"],
        "alpha_significant": style.get("alpha_significant"), "r_squared": style.get("r_squared"), "biased": life["biased"],
    }
    return Report(held, metrics, trials, reality_score(_input_row(spark, row)), {"dsr": dsr, "pbo": over, "permutation": test, "walk_forward": forward, "attribution": style, "survivorship": life, "null": null, "ppy": ppy})


def rule_moments(runs: DataFrame, ppy: int = 252) -> DataFrame:
    """trial_id, n, mean, sd, skew, kurt, growth and sharpe of each run."""
    s = F.col("net")
    obs = runs.groupBy("trial_id").agg(F.count(s).alias("n"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("sd"), F.skewness(s).alias("skew"), (F.kurtosis(s) + 3).alias("kurt"), F.product(1 + s).alias("growth"))
    return obs.join(sharpes(runs, ["trial_id"], ppy), "trial_id")


def arena_runs(bars: DataFrame, costs: Costs = Costs(), ppy: int = 252, **how) -> DataFrame:
    """Every rule at its defaults over one numbered series, told apart by trial_id, in one plan."""
    return run_backtest(with_targets(bars, ["symbol"], [(s, s.clean()) for s in list_strategies()]), ["symbol", "trial_id"], costs, ppy=ppy, **how)


def deflated_rules(bars: DataFrame, costs: Costs = Costs(), ppy: int = 252, grid_limit: int = 40) -> DataFrame:
    """strategy, n_trials (the rule's own grid), sharpe and hurdle per period, psr, dsr."""
    rules, out = list_strategies(), []
    for r in rule_moments(arena_runs(numbered(bars, ["symbol"]), costs, ppy), ppy).collect():  # a row per rule
        d = v.deflated_sharpe(r.asDict(), None, len(rules[r["trial_id"]].grid(grid_limit)))
        out.append((rules[r["trial_id"]].key, int(d["n_trials"]), d["sharpe"], d["hurdle"], d["psr"], d["dsr"]))
    return bars.sparkSession.createDataFrame(out, "strategy string, n_trials int, sharpe double, hurdle double, psr double, dsr double")


def run_arena(bars: DataFrame, n_permutations: int = 120, config: LabConfig = LabConfig()) -> DataFrame:
    """Every rule at its defaults: metrics, p_value, dsr over the rule's own grid and evidence = (1 - p) * dsr, best first. One backtest plan for all.

    config: costs, options of the engine, seed and kind of the permutations.
    """
    ppy, grid_limit = step_of(bars, config.ppy), config.grid_limit
    bars = cut(numbered(bars, ["symbol"]))
    rules = [(s, s.clean()) for s in list_strategies()]
    runs = cut(arena_runs(bars, config.costs, ppy, **config.how()))
    # every average reads the markets anew: they are written once
    markets = cut(v.permute_bars(bars, ["symbol"], n_permutations, config.seed, config.block))
    keys = ["perm_id", "symbol"]
    null = sharpes(run_backtest(with_targets(markets, keys, rules, "bar_idx"), [*keys, "trial_id"], config.costs, ppy=ppy, order="bar_idx", **config.how()), [*keys, "trial_id"], ppy).withColumnRenamed("sharpe", "_null")
    obs = rule_moments(runs, ppy)
    tested = obs.join(null, "trial_id").groupBy(*obs.columns).agg(((1 + F.count(F.when(F.col("_null") >= F.col("sharpe"), 1))) / (F.count("*") + 1)).alias("p_value"))
    rows = tested.collect()  # a row per rule
    more = {r["trial_id"]: r for r in compute_metrics(runs, ["trial_id"], ppy).select("trial_id", "cagr", "max_drawdown", "n_trades").collect()}
    out = []
    for r in rows:
        s, m = rules[r["trial_id"]][0], more[r["trial_id"]]
        dsr = v.deflated_sharpe(r.asDict(), None, len(s.grid(grid_limit)))["dsr"]
        out.append((s.key, r["sharpe"], r["growth"] - 1, m["cagr"], m["max_drawdown"], float(m["n_trades"]), r["p_value"], dsr, (1 - r["p_value"]) * dsr))
    return _ranked(bars.sparkSession, out, "cagr double, max_drawdown double, n_trades double")


def run_portfolio_arena(panel: DataFrame, n_permutations: int = 80, config: PortfolioConfig = PortfolioConfig()) -> DataFrame:
    """Every cross-sectional rule at its defaults, on one schedule: as run_arena, with turnover and the t statistic of alpha over the style factors."""
    panel = cut(panel)  # each rule reads it anew
    ppy, how = step_of(panel, config.ppy), config.how()
    rules = [s.key for s in list_xs_strategies()]
    weighted = None
    for i, k in enumerate(rules):
        part = with_weights(panel, k).withColumn("trial_id", F.lit(i))
        weighted = part if weighted is None else weighted.unionByName(part)
    weighted = cut(weighted)
    by, free = ["trial_id"], Costs(0, 0, 0)
    held = cut(run_portfolio(weighted, by, config.costs, ppy=ppy, **how))
    dates = cut(portfolio_returns(held, by, config.costs, ppy, config.capital))
    shown = sharpes(portfolio_returns(held, by, free, ppy), by, ppy).withColumnRenamed("sharpe", "_shown")
    null = v.cross_permutation_null(weighted, n_permutations, config.seed, ppy, by=("trial_id",), **how)
    tested = null.join(shown, by).groupBy(*by).agg(((1 + F.count(F.when(F.col("sharpe") >= F.col("_shown"), 1))) / (F.count("*") + 1)).alias("p_value"))
    more = portfolio_metrics(dates, by, ppy).select(*by, "cagr", "max_drawdown", "n_trades", "turnover_ann")
    alpha = attributed(dates, style_factors(panel, ppy), by, ppy).select(*by, "alpha_t_stat")
    rows = rule_moments(dates, ppy).join(tested, by).join(more, by).join(alpha, by, "left").collect()  # a row per rule
    out = []
    for r in rows:
        k = rules[r["trial_id"]]
        dsr = v.deflated_sharpe(r.asDict(), None, len(get_xs_strategy(k).grid(config.grid_limit)))
        out.append((k, dsr["sharpe"] * ppy**0.5, r["growth"] - 1, r["cagr"], r["max_drawdown"], float(r["n_trades"]), r["turnover_ann"], r["alpha_t_stat"], r["p_value"], dsr["dsr"], (1 - r["p_value"]) * dsr["dsr"]))
    return _ranked(panel.sparkSession, out, "cagr double, max_drawdown double, n_trades double, turnover_ann double, alpha_t_stat double")


def _ranked(spark, rows: list[tuple], more: str) -> DataFrame:
    rows = [(k + 1, *r) for k, r in enumerate(sorted(rows, key=lambda r: -r[-1]))]
    return spark.createDataFrame(rows, f"place int, strategy string, sharpe double, total_return double, {more}, p_value double, dsr double, evidence double")


def to_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))
