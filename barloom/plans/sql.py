"""The engine from SQL: views of bars, panels and rules' targets, and table functions over partitions.

    register(spark, bars)
    SELECT * FROM backtest(TABLE(SELECT symbol, ts, close, target FROM target_sma_cross) PARTITION BY symbol ORDER BY ts)

Views are the DataFrame plans, so indicators and targets stay expressions. The functions hold a few
numbers for a partition and read it once, in its order: a row of Python a bar, for use from SQL; the
DataFrame engine is the fast way for many bars.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.columns import numbered
from ..operators.cross_sectional import XS_REGISTRY, with_weights
from ..operators.engine import Costs
from ..operators.metrics import DEGENERATE
from ..operators.panel import make_panel
from ..operators.strategies import REGISTRY, with_targets


@udtf(returnType="symbol string, ts timestamp_ntz, ret double, position double, gross double, traded double, cost double, net double, equity double, benchmark double")
class Backtest:
    """Rows (symbol, ts, close, target) of a partition in order; then, as constants: lag, leverage, shorts, capital, commission, slippage, borrow (basis points), periods a year."""

    def __init__(self):
        self.close = self.position = self.ret = None
        self.waiting: list[float] = []
        self.equity = self.benchmark = 1.0

    def eval(self, row, lag: int = 1, leverage: float = 1.0, shorts: bool = True, capital: float = 100_000.0, commission: float = 1.0, slippage: float = 2.0, borrow: float = 50.0, ppy: int = 252):
        if lag < 1:
            raise ValueError("lag must be 1 at least")
        costs, close = Costs(commission, slippage, borrow), row["close"]
        ret = close / self.close - 1 if close is not None and self.close else 0.0
        drifted = 0.0
        if self.position is not None and 1 + self.position * self.ret != 0:
            drifted = self.position * (1 + self.ret) / (1 + self.position * self.ret)
        position = self.waiting.pop(0) if len(self.waiting) == lag else 0.0
        target = row["target"]
        self.waiting.append(0.0 if target is None or math.isnan(target) else max(-leverage if shorts else 0.0, min(leverage, target)))
        gross, traded = position * ret, position - drifted
        cost = abs(traded) * costs.one_way + abs(min(position, 0.0)) * (costs.carry / ppy)
        net = gross - cost
        self.equity *= 1 + net
        self.benchmark *= 1 + ret
        self.close, self.position, self.ret = close, position, ret
        yield row["symbol"], row["ts"], ret, position, gross, traded, cost, net, capital * self.equity, capital * self.benchmark


@udtf(returnType="symbol string, n_bars bigint, total_return double, sharpe double, max_drawdown double, hit_rate double")
class Metrics:
    """Rows (symbol, net, equity) of a partition in order; then, as a constant, periods a year. One row."""

    def __init__(self):
        self.n, self.mean, self.squares, self.wins = 0, 0.0, 0.0, 0
        self.symbol = self.first = self.last = None
        self.peak, self.drawdown = -math.inf, 0.0

    def eval(self, row, ppy: int = 252):
        self.symbol, self.ppy, x, equity = row["symbol"], ppy, row["net"], row["equity"]
        if equity is not None:
            self.first = equity if self.first is None else self.first
            self.last, self.peak = equity, max(self.peak, equity)
            if self.peak:
                self.drawdown = min(self.drawdown, equity / self.peak - 1)
        if x is not None and math.isfinite(x):
            self.n += 1
            away = x - self.mean
            self.mean += away / self.n
            self.squares += away * (x - self.mean)
            self.wins += x > 0

    def terminate(self):
        if self.first is None and not self.n:
            return
        sd = math.sqrt(self.squares / (self.n - 1)) if self.n > 1 else 0.0
        sharpe = 0.0 if sd < DEGENERATE else self.mean / sd * math.sqrt(self.ppy)
        yield self.symbol, self.n, self.last / self.first - 1 if self.first else None, sharpe, self.drawdown, self.wins / self.n if self.n else None


def register(spark: SparkSession, bars: DataFrame, prefix: str = "") -> list[str]:
    """Names of what SQL can use from now on: bars, panel, target_<rule>, weight_<rule>, and the functions backtest and metrics."""
    views = {"bars": bars, "panel": (panel := make_panel(bars))}
    ready = numbered(bars, ["symbol"])
    views |= {f"target_{k}": with_targets(ready, ["symbol"], [(s, s.clean())]).drop("trial_id") for k, s in REGISTRY.items()}
    views |= {f"weight_{k}": with_weights(panel, k).select("symbol", "ts", "bar_idx", F.col("weight")) for k in XS_REGISTRY}
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    for name, f in (("backtest", Backtest), ("metrics", Metrics)):
        spark.udtf.register(prefix + name, f)
    return [prefix + n for n in [*views, "backtest", "metrics"]]
