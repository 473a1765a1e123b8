"""Technical indicators as columns over bars, one sort per key.

Exponential averages are scans over blocks of a key; everything else is a window expression.
Indicators are named by tuples such as ("sma", 20) and become columns such as sma_20.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import change, last_rows, over, ratio, rolling
from .scans import averaged

Ema = tuple  # (name, source column, alpha, adjust, least values)


def name_of(ind: tuple) -> str:
    return "_".join(str(x).replace(".", "p") for x in ind)


def with_emas(df: DataFrame, by: list[str], emas: list[Ema], order: str = "ts") -> DataFrame:
    """Adds exponential averages. A source is a column, or a pair of columns or averages whose difference is averaged."""
    plain, pairs = [e for e in emas if not isinstance(e[1], tuple)], [e for e in emas if isinstance(e[1], tuple)]
    if plain:
        df = averaged(df, by, plain, order)
    if pairs:
        apart = {f"_apart_{e[0]}": F.col(e[1][0]) - F.col(e[1][1]) for e in pairs}
        df = averaged(df.withColumns(apart), by, [(e[0], f"_apart_{e[0]}", *e[2:]) for e in pairs], order).drop(*apart)
    return df


def true_range(by: list[str], order: str = "ts") -> Column:
    before = F.lag("close").over(over(by, order))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def _rsi(gain: Column, loss: Column, flat: float | None = 50.0) -> Column:
    ladder = F.when(loss > 0, 100 - 100 / (1 + ratio(gain, loss))).when(gain > 0, 100.0)
    return ladder if flat is None else ladder.when(gain.isNotNull() & loss.isNotNull(), flat)


def bands(c: str, k: int, m: float, by: list[str], sample: bool = False, order: str = "ts") -> tuple[Column, Column, Column]:
    mid = rolling(F.avg, c, k, by, order)
    width = m * rolling(F.stddev_samp if sample else F.stddev_pop, c, k, by, order)
    return mid - width, mid, mid + width


def with_indicators(df: DataFrame, by: list[str], wanted: Iterable[tuple], order: str = "ts") -> DataFrame:
    """Adds the wanted indicators of close, high and low; causal, null until warm."""
    wanted, given = sorted(set(wanted), key=str), set(df.columns)
    emas: dict[str, Ema] = {}
    before: dict[str, Column] = {}
    after: dict[str, Column] = {}
    for ind in wanted:
        kind, *a = ind
        n = name_of(ind)
        if kind == "ema":
            emas[n] = (n, "close", 2 / (a[0] + 1), False, a[0])
        elif kind == "rsi":
            move = F.col("close") - F.lag("close").over(over(by, order))
            before |= {"_gain": F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))), "_loss": F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0)))}
            emas[f"_gain_{a[0]}"] = (f"_gain_{a[0]}", "_gain", 1 / a[0], False, a[0])
            emas[f"_loss_{a[0]}"] = (f"_loss_{a[0]}", "_loss", 1 / a[0], False, a[0])
            after[n] = _rsi(F.col(f"_gain_{a[0]}"), F.col(f"_loss_{a[0]}"))
        elif kind == "macd":
            f, s, g = a
            for k in (f, s):
                emas[f"_ema_{k}"] = (f"_ema_{k}", "close", 2 / (k + 1), False, k)
            emas[f"{n}_signal"] = (f"{n}_signal", (f"_ema_{f}", f"_ema_{s}"), 2 / (g + 1), False, g)
            after[f"{n}_line"] = F.col(f"_ema_{f}") - F.col(f"_ema_{s}")
            after[f"{n}_hist"] = F.col(f"_ema_{f}") - F.col(f"_ema_{s}") - F.col(f"{n}_signal")
        elif kind == "atr":
            before["_range"] = true_range(by, order)
            emas[n] = (n, "_range", 1 / a[0], False, a[0])
    if before:
        df = df.withColumns(before)
    # averages of averages come after what they average
    df = with_emas(df, by, sorted(emas.values(), key=lambda e: isinstance(e[1], tuple)), order)
    plain: dict[str, Column] = {}
    for ind in wanted:
        kind, *a = ind
        n = name_of(ind)
        if kind == "sma":
            plain[n] = rolling(F.avg, "close", a[0], by, order)
        elif kind == "boll":
            plain[f"{n}_low"], plain[f"{n}_mid"], plain[f"{n}_high"] = bands("close", a[0], a[1], by, order=order)
        elif kind == "donchian":
            frame = over(by, order).rowsBetween(-a[0], -1)
            plain[f"{n}_low"] = F.when(F.count("low").over(frame) == a[0], F.min("low").over(frame))
            plain[f"{n}_high"] = F.when(F.count("high").over(frame) == a[0], F.max("high").over(frame))
        elif kind == "zscore":
            plain[n] = ratio(F.col("close") - rolling(F.avg, "close", a[0], by, order), rolling(F.stddev_pop, "close", a[0], by, order))
        elif kind == "roc":
            plain[n] = change(a[0], by, order=order)
        elif kind == "rv":
            df = df if "_change" in df.columns else df.withColumn("_change", change(1, by, order=order))
            plain[n] = rolling(F.stddev_pop, "_change", a[0], by, order) * F.sqrt(F.lit(252.0))
    if plain:
        df = df.withColumns(plain)
    if after:
        df = df.withColumns(after)
    return df.drop(*[c for c in df.columns if c.startswith("_") and c not in given])


def feature_set(df: DataFrame, by: list[str], order: str = "ts") -> DataFrame:
    """The ingest-time feature set: other maths than the indicators above (weights normalised, sample deviations, simple means)."""
    w = over(by, order)
    df = df.withColumn("_move", F.coalesce(F.col("close") - F.lag("close").over(w), F.lit(0.0)))
    gap = lambda c: F.abs(F.col(c) - F.lag("close").over(w))
    # a missing previous close makes the range missing here
    df = df.withColumn("_range", F.when(F.lag("close").over(w).isNotNull(), F.greatest(F.col("high") - F.col("low"), gap("high"), gap("low"))))
    df = with_emas(df, by, [("ema_12", "close", 2 / 13, True, 0), ("ema_26", "close", 2 / 27, True, 0), ("macd_signal", ("ema_12", "ema_26"), 2 / 10, True, 0)], order)
    low, mid, high = bands("close", 20, 2.0, by, sample=True, order=order)
    gain = rolling(F.avg, F.greatest(F.col("_move"), F.lit(0.0)), 14, by, order)
    loss = rolling(F.avg, F.greatest(-F.col("_move"), F.lit(0.0)), 14, by, order)
    cols = {f"sma_{k}": rolling(F.avg, "close", k, by, order) for k in (20, 50, 200)}
    cols |= {"macd": F.col("ema_12") - F.col("ema_26"), "macd_hist": F.col("ema_12") - F.col("ema_26") - F.col("macd_signal"), "rsi": _rsi(gain, loss, None)}
    cols |= {"bb_lower": low, "bb_middle": mid, "bb_upper": high, "atr": rolling(F.avg, "_range", 14, by, order)}
    cols |= {"volume_sma": rolling(F.avg, "volume", 20, by, order)}
    cols |= {"price_change": change(1, by, order=order), "price_change_5": change(5, by, order=order), "price_change_20": change(20, by, order=order)}
    return df.withColumns(cols).withColumn("volume_ratio", ratio("volume", "volume_sma")).drop("_move", "_range")


def signal_set(df: DataFrame, by: list[str], order: str = "ts") -> DataFrame:
    """sma_20, sma_50, simple RSI and bands of the signal rule; short histories fall back to the price and 50."""
    w = over(by, order)
    df = df.withColumn("_move", F.col("close") - F.lag("close").over(w))
    frame = last_rows(by, 14, order)
    gain, loss = F.avg(F.greatest(F.col("_move"), F.lit(0.0))).over(frame), F.avg(F.greatest(-F.col("_move"), F.lit(0.0))).over(frame)
    rsi = F.when(F.count("_move").over(frame) == 14, 100 - 100 / (1 + gain / (loss + 1e-10))).otherwise(50.0)
    low, _, high = bands("close", 20, 2.0, by, order=order)
    cols = {f"sma_{k}": F.coalesce(rolling(F.avg, "close", k, by, order), F.col("close")) for k in (20, 50)}
    return df.withColumns(cols | {"rsi": rsi, "bb_lower": low, "bb_upper": high}).drop("_move")


def signal_averages(df: DataFrame, by: list[str], order: str = "ts") -> DataFrame:
    """macd and macd_signal of the signal rule: averages from the first bar on, missing until `slow` bars and then nine more values are there."""
    df = with_emas(df, by, [("_fast", "close", 2 / 13, False, 12), ("_slow", "close", 2 / 27, False, 26), ("macd_signal", ("_fast", "_slow"), 2 / 10, False, 9)], order)
    return df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")


def model_features(df: DataFrame, by: list[str], order: str = "ts") -> DataFrame:
    """Feature table of the trading environment: gaps filled from the future, then with 0. Not for signals."""
    from .columns import backfill

    names = ["sma_20", "sma_50", "rsi", "bb_lower", "bb_upper", "macd"]
    full = feature_set(df, by, order)
    return full.select(*df.columns, *[F.coalesce(backfill(n, by, order), F.lit(0.0)).alias(n) for n in names])
