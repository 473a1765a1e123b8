"""The one-rule signal, order simulation, its backtest, and the trading environment as plans over bars."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import draw, numbered, so_far
from ..functions.indicators import model_features, signal_set

ACTIONS = ("buy", "sell", "hold")
FEE = 0.001


def position_size(price: Column, capital: float = 100_000.0, max_position: int = 100) -> Column:
    """A tenth of the starting capital, 1 to max_position shares."""
    return F.greatest(F.lit(1), F.least(F.floor(capital * 0.1 / price).cast("int"), F.lit(max_position)))


def signals(bars: DataFrame, by: list[str], capital: float = 100_000.0, max_position: int = 100, order: str = "ts") -> DataFrame:
    """action, quantity, price, confidence and the indicators of every bar, from the bars up to it."""
    df = signal_set(numbered(bars, by, order), by, order)
    price, fast, rsi = F.col("close"), F.col("sma_20"), F.col("rsi")
    buy = (price > fast) & (rsi < 70)
    sell = (price < fast) | (rsi > 80)
    pick = lambda a, b, c: F.when(buy, a).when(sell, b).otherwise(c)
    size = position_size(price, capital, max_position)
    shown = F.struct("sma_20", "sma_50", "rsi", F.coalesce("bb_upper", price * 1.02).alias("bb_upper"), F.coalesce("bb_lower", price * 0.98).alias("bb_lower"))
    return df.select(*by, order, "bar_idx", pick(F.lit("buy"), F.lit("sell"), F.lit("hold")).alias("action"), pick(size, size, F.lit(0)).alias("quantity"), price.alias("price"), pick(F.lit(0.7), F.lit(0.6), F.lit(0.5)).alias("confidence"), shown.alias("indicators"))


def valid_signal(symbol: str = "symbol") -> Column:
    known = F.col("action").isin(*ACTIONS) & F.col(symbol).isNotNull() & (F.length(symbol) > 0) & F.col("price").isNotNull() & F.col("quantity").isNotNull()
    return F.coalesce(known & ((F.col("action") == "hold") | (F.col("quantity") > 0)), F.lit(False))


def commission(action: Column, quantity: Column) -> Column:
    return F.when(action == "hold", 0.0).otherwise(F.bround(1 + 0.01 * quantity, 2))


def fills(orders: DataFrame, by: list[str], success_rate: float = 1.0, seed: int = 1) -> DataFrame:
    """Simulated execution: invalid signals fail, holds succeed, others by chance. total_value is without commission."""
    ok = valid_signal() & ((F.col("action") == "hold") | (draw(F.lit(seed), *by, "bar_idx") < success_rate))
    cols = {"success": ok, "status": F.when(ok, "executed").otherwise("failed"), "commission": F.when(ok, commission(F.col("action"), F.col("quantity"))).otherwise(0.0)}
    cols |= {"total_value": F.when(ok, F.bround(F.col("price") * F.col("quantity"), 2)).otherwise(0.0), "error": F.when(ok, F.lit(None).cast("string")).when(valid_signal(), "execution failed").otherwise("invalid signal")}
    return orders.withColumns(cols).withColumn("order_id", F.concat_ws("-", F.lit("order"), *[F.col(c).cast("string") for c in by], F.col("bar_idx").cast("string")))


def signal_backtest(bars: DataFrame, by: list[str], capital: float = 100_000.0, max_position: int = 100, first: int = 50, mark_shorts: bool = False, success_rate: float = 1.0, order: str = "ts") -> DataFrame:
    """Every bar from the first-th on: fill at its close, cash and position as running sums, and value.

    mark_shorts=False leaves the liability of a net short out of the value.
    """
    done = fills(signals(bars, by, capital, max_position, order).filter(F.col("bar_idx") >= first - 1), by, success_rate)
    sign = F.when(~F.col("success"), 0).when(F.col("action") == "buy", 1).when(F.col("action") == "sell", -1).otherwise(0)
    w = so_far(by, order)
    df = done.withColumns({"position": F.sum(sign * F.col("quantity")).over(w), "cash": capital - F.sum(sign * F.col("total_value")).over(w), "trades": F.sum((F.col("action") != "hold").cast("int")).over(w)})
    held = F.col("position") if mark_shorts else F.greatest(F.col("position"), F.lit(0))
    return df.withColumn("value", F.col("cash") + held * F.col("price"))


def signal_backtest_summary(steps: DataFrame, by: list[str], capital: float = 100_000.0, order: str = "ts") -> DataFrame:
    last = lambda c: F.max_by(c, order).alias(c)
    return steps.groupBy(*by).agg(last("value"), last("position"), last("trades")).withColumn("total_return", (F.col("value") - capital) / capital)


def run_once(bars: DataFrame, by: list[str], **how) -> DataFrame:
    """The fill of the latest bar's signal."""
    s = signals(bars, by, **how)
    newest = s.groupBy(*by).agg(F.max("bar_idx").alias("bar_idx"))
    return fills(s.join(newest, [*by, "bar_idx"], "left_semi"), by)


def environment_features(bars: DataFrame, by: list[str]) -> DataFrame:
    """bars with an 11-number features array per bar; the environment adds its own four."""
    df = model_features(bars, by)
    return df.select(*bars.columns, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("open", "high", "low", "close", "volume", "sma_20", "sma_50", "rsi", "bb_upper", "bb_lower", "macd")]).alias("features"))


def simulate_environment(bars: DataFrame, by: list[str], policy: Callable | None = None, balance: float = 100_000.0, max_position: int = 100, fee: float = FEE, order: str = "ts") -> DataFrame:
    """Folds actions (0 sell, 1 hold, 2 buy) over each key's bars: balance and position are a true recursion, so a grouped map.

    bars: close and either an action column or a policy(features array and state) -> action. The reward
    values the new holdings at the next bar's price against the value before the action.
    """
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema if f.name in by)
    kind = bars.schema[order].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        price = pdf["close"].to_numpy(float)
        cash, held, value, rows = balance, 0, balance, []
        for t in range(max(len(price) - 1, 0)):
            p = price[t]
            state = [cash, held, value, (value - balance) / balance]
            action = int(pdf["action"].iloc[t]) if policy is None else int(policy([*pdf["features"].iloc[t], *state]))
            if action == 0 and held > 0:
                n = min(held, max_position)
                cash, held = cash + n * p * (1 - fee), held - n
            elif action == 2 and cash > 0 and (n := min(int(cash / p), max_position - held)) > 0:
                cash, held = cash - n * p * (1 + fee), held + n
            before, value = value, cash + held * p
            reward = (cash + held * price[t + 1] - before) / before if before > 0 else 0.0
            rows.append((pdf[order].iloc[t], action, float(cash), int(held), float(value), float(reward)))
        out = pd.DataFrame(rows, columns=[order, "action", "balance", "position", "portfolio_value", "reward"])
        for c in reversed(by):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    return bars.groupBy(*by).applyInPandas(run, f"{keys}, `{order}` {kind}, action int, balance double, position bigint, portfolio_value double, reward double")


def episode_summary(steps: DataFrame, by: list[str], balance: float = 100_000.0, order: str = "ts") -> DataFrame:
    """total_return, max_drawdown and trades of each episode."""
    peak = F.greatest(F.max("portfolio_value").over(so_far(by, order)), F.lit(balance))
    df = steps.withColumn("_dd", 1 - F.col("portfolio_value") / peak)
    return df.groupBy(*by).agg(((F.max_by("portfolio_value", order) - balance) / balance).alias("total_return"), F.max("_dd").alias("max_drawdown"), F.count(F.when(F.col("action") != 1, 1)).alias("trades"))


def model_signal(total_return: Column) -> Column:
    """BUY or SELL beyond 2%, with a confidence."""
    action = F.when(total_return > 0.02, "BUY").when(total_return < -0.02, "SELL").otherwise("HOLD")
    return F.struct(action.alias("action"), F.least(F.lit(0.9), 0.5 + F.abs(total_return)).alias("confidence"))
