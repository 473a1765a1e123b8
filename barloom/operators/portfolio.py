"""Portfolio backtest over a panel with weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import over, ratio, so_far, truncated
from .engine import Costs
from .metrics import compute_metrics


def normalise_weights(df: DataFrame, by: list[str], gross_leverage: float = 1.0, max_weight: float | None = None, allow_short: bool = True) -> DataFrame:
    """weight -> target: 0 where unlisted, capped per name, a date's gross scaled down (never up) to the leverage."""
    w = F.when(F.col("listed"), F.coalesce("weight", F.lit(0.0))).otherwise(0.0)
    if not allow_short:
        w = F.greatest(w, F.lit(0.0))
    if max_weight is not None:
        w = F.greatest(F.lit(-abs(max_weight)), F.least(F.lit(abs(max_weight)), w))
    df = df.withColumn("_w", w)
    gross = F.sum(F.abs("_w")).over(W.partitionBy(*by, "ts"))
    return df.withColumn("target", F.col("_w") * F.coalesce(F.least(F.lit(1.0), ratio(F.lit(float(gross_leverage)), gross)), F.lit(1.0))).drop("_w")


def rebalance_rows(frequency: str, by: list[str]) -> Column:
    """Whether a date is one to trade on: all, every k rows, or the first row of each week, month or quarter."""
    f = str(frequency).upper().strip()
    if f in ("D", "1", "B", ""):
        return F.lit(True)
    if f.isdigit():
        return F.col("bar_idx") % max(1, int(f)) == 0
    if f not in ("W", "M", "Q"):
        raise ValueError(f"unknown rebalance frequency {frequency!r}")
    now = truncated(F.col("ts"), f)
    return ~now.eqNullSafe(F.lag(now).over(over([*by, "symbol"], "bar_idx")))


def carried(df: DataFrame, by: list[str], frequency: str) -> DataFrame:
    """held between rebalance rows: weights drift with prices, in closed form.

    In a segment that starts at s, a name that is tradable without a break since s has grown by G; its
    weight is w(s) * G / (1 + sum of w(s) * (G - 1) over all names). Names that stop being tradable keep
    the growth they had, in cash.
    """
    df = df.withColumn("_on", rebalance_rows(frequency, by)).withColumn("_seg", F.sum(F.col("_on").cast("int")).over(so_far([*by, "symbol"], "bar_idx")))
    seg = W.partitionBy(*by, "symbol", "_seg").orderBy("bar_idx")
    upto = seg.rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumns({"_w": F.first("held").over(upto), "_alive": F.min(F.col("tradable").cast("int")).over(upto)})
    df = df.withColumn("_g", F.when(F.col("_alive") == 1, 1 + F.coalesce("ret", F.lit(0.0))).otherwise(1.0))
    df = df.withColumn("_grown", F.coalesce(F.product("_g").over(seg.rowsBetween(W.unboundedPreceding, -1)), F.lit(1.0)))
    value = 1 + F.sum(F.col("_w") * (F.col("_grown") - 1)).over(W.partitionBy(*by, "ts"))
    held = F.when((F.col("_seg") > 0) & (F.col("_alive") == 1), F.coalesce(ratio(F.col("_w") * F.col("_grown"), value), F.col("_w"))).otherwise(0.0)
    return df.withColumn("held", held).drop("_on", "_seg", "_w", "_alive", "_g", "_grown")


def run_portfolio(df: DataFrame, by: list[str] = [], costs: Costs = Costs(), lag: int = 1, gross_leverage: float = 1.0, max_weight: float | None = None, allow_short: bool = True, rebalance: str | None = None, ppy: int = 252) -> DataFrame:  # noqa: B006
    """Panel rows with target, held, asset_ret and traded added; `portfolio_returns` sums them per date."""
    if lag < 1:
        raise ValueError("lag must be 1 at least")
    w = over([*by, "symbol"], "bar_idx")
    df = normalise_weights(df, by, gross_leverage, max_weight, allow_short).withColumn("asset_ret", F.coalesce("ret", F.lit(0.0)))
    df = df.withColumn("held", F.when(F.col("tradable"), F.coalesce(F.lag("target", lag).over(w), F.lit(0.0))).otherwise(0.0))
    if rebalance is not None:
        df = carried(df, by, rebalance)
    df = df.withColumn("_gross", F.sum(F.col("held") * F.col("asset_ret")).over(W.partitionBy(*by, "ts")))
    df = df.withColumn("_drifted", F.coalesce(ratio(F.col("held") * (1 + F.col("asset_ret")), 1 + F.col("_gross")), F.lit(0.0)))
    n = F.sum(F.col("tradable").cast("double")).over(W.partitionBy(*by, "ts"))
    df = df.withColumns({"traded": F.abs(F.col("held") - F.coalesce(F.lag("_drifted").over(w), F.lit(0.0))), "_equal": F.coalesce(ratio(F.col("tradable").cast("double"), n), F.lit(0.0))})
    return df.withColumn("bench", F.coalesce(F.lag("_equal", lag).over(w), F.lit(0.0)) * F.col("asset_ret")).drop("_gross", "_drifted", "_equal")


def portfolio_returns(held: DataFrame, by: list[str] = [], costs: Costs = Costs(), ppy: int = 252, capital: float = 100_000.0) -> DataFrame:  # noqa: B006
    """by, ts, bar_idx: gross, traded, cost, net, equity, benchmark, exposure and counts of each date."""
    h = F.col("held")
    d = held.groupBy(*by, "ts", "bar_idx").agg(
        F.sum(h * F.col("asset_ret")).alias("gross"), F.sum("traded").alias("traded"), F.sum(F.abs(F.least(h, F.lit(0.0)))).alias("_short"), F.sum("bench").alias("bench"),
        F.sum(F.abs(h)).alias("exposure"), F.sum(h).alias("net_exposure"), F.count(F.when(F.abs(h) > 1e-9, 1)).alias("positions"), F.sum(h * h).alias("_sq"),
    )
    d = d.withColumn("cost", F.col("traded") * costs.one_way + F.col("_short") * (costs.carry / ppy)).withColumn("net", F.col("gross") - F.col("cost"))
    d = d.withColumn("hhi", ratio(F.col("_sq"), F.col("exposure") * F.col("exposure")))
    key = by or ["_all"]
    d = d if by else d.withColumn("_all", F.lit(0))
    grown = lambda c: capital * F.product(1 + F.col(c)).over(so_far(key, "bar_idx"))
    return d.withColumns({"equity": grown("net"), "benchmark_equity": grown("bench")}).drop("_short", "_sq", "_all")


def portfolio_metrics(dates: DataFrame, by: list[str] = [], ppy: int = 252) -> DataFrame:  # noqa: B006
    key = by or ["_all"]
    d = dates if by else dates.withColumn("_all", F.lit(0))
    m = compute_metrics(d, key, ppy, order="bar_idx", position="exposure").drop("turnover_ann", "n_trades")
    b = d.groupBy(*key).agg(
        F.avg("exposure").alias("gross_exposure"), F.avg("net_exposure").alias("net_exposure"), F.max("exposure").alias("max_gross_exposure"), F.avg("positions").alias("avg_positions"),
        F.max("positions").cast("double").alias("max_positions"), F.avg("hhi").alias("concentration_hhi"), (F.sum("traded") / (F.count("*") / ppy)).alias("turnover_ann"), F.count(F.when(F.col("traded") > 1e-9, 1)).cast("double").alias("n_trades"),
    )
    out = m.join(b, key)
    return out if by else out.drop("_all")


def contributions(held: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    return held.groupBy(*by, "symbol").agg(F.sum(F.col("held") * F.col("asset_ret")).alias("contribution"))
