"""Lagged backtest with costs, one sort per run key and no recursion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, over, ratio, returns, so_far
from ..functions.scans import scanned


@dataclass(frozen=True)
class Costs:
    """In basis points; borrowing is a yearly rate on short exposure. times scales all three."""

    commission: float = 1.0
    slippage: float = 2.0
    borrow: float = 50.0
    times: float = 1.0

    @property
    def one_way(self) -> float:
        return (self.commission + self.slippage) * self.times / 1e4

    @property
    def carry(self) -> float:
        return self.borrow * self.times / 1e4


def run_backtest(df: DataFrame, by: list[str], costs: Costs = Costs(), lag: int = 1, max_leverage: float = 1.0, allow_short: bool = True, capital: float = 100_000.0, ppy: int = 252, order: str = "ts", cost_times: str | None = None, block=None) -> DataFrame:
    """Adds ret, position, gross, traded, cost, net, equity and benchmark to rows with close and target.

    cost_times: a column that multiplies all costs, so that stressed runs are rows of the same plan.
    block: for keys too long for one task, what scans.block_of takes ("month", or an expression that
    never falls along the order): every block of a key is then a task of its own.
    """
    if lag < 1:
        raise ValueError("lag must be 1 at least: a bar's own close is not known when it is traded")
    times = F.col(cost_times) if cost_times else F.lit(1.0)
    w = over(by, order)
    target = F.coalesce(clip(F.col("target"), -max_leverage if allow_short else 0.0, max_leverage), F.lit(0.0))
    # the position after the bar's move, as a share of the new value
    drifted = lambda position, ret: ratio(position * (1 + ret), 1 + position * ret)
    if block is None:
        df = df.withColumns({"ret": returns(by, order=order), "_t": target})
        df = df.withColumn("position", F.coalesce(F.lag("_t", lag).over(w), F.lit(0.0)))
        df = df.withColumn("_drifted", F.coalesce(F.lag(drifted(F.col("position"), F.col("ret"))).over(w), F.lit(0.0))).drop("_t")
    else:
        # the bar before's position and return follow from what lies one bar further back
        back = {"_c1": ("lag", "close", 1), "_c2": ("lag", "close", 2), "_t1": ("lag", target, lag), "_t2": ("lag", target, lag + 1)}
        df = scanned(df, by, back, order, block)
        df = df.withColumns({"ret": F.coalesce(ratio("close", "_c1") - 1, F.lit(0.0)), "position": F.coalesce("_t1", F.lit(0.0))})
        df = df.withColumn("_drifted", F.coalesce(drifted(F.coalesce("_t2", F.lit(0.0)), F.coalesce(ratio("_c1", "_c2") - 1, F.lit(0.0))), F.lit(0.0))).drop(*back)
    df = df.withColumns({"gross": F.col("position") * F.col("ret"), "traded": F.col("position") - F.col("_drifted")})
    cost = (F.abs("traded") * costs.one_way + F.abs(F.least("position", F.lit(0.0))) * (costs.carry / ppy)) * times
    df = df.withColumn("cost", cost).withColumn("net", F.col("gross") - F.col("cost")).drop("_drifted")
    growth = {"equity": 1 + F.col("net"), "benchmark": 1 + F.col("ret")}
    if block is None:
        return df.withColumns({k: capital * F.product(v).over(so_far(by, order)) for k, v in growth.items()})
    return scanned(df, by, {k: ("product", v) for k, v in growth.items()}, order, block).withColumns({k: capital * F.col(k) for k in growth})
