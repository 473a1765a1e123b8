"""Panels: a dense grid of calendar and symbols in long form. What is missing stays null and is never filled forward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import over, ratio
from ..sources.bars import OHLCV


def make_panel(bars: DataFrame, min_bars: int = 2) -> DataFrame:
    """ts, bar_idx, symbol, ohlcv, listed, tradable, ret over the union of all calendars.

    The grid is the result's own size by definition; the calendar, one row per time, is numbered once.
    """
    missing = {"symbol", "ts", *OHLCV} - set(bars.columns)
    if missing:
        raise ValueError(f"bars without {sorted(missing)}")
    kept = bars.withColumn("_n", F.count("*").over(W.partitionBy("symbol"))).filter(F.col("_n") >= min_bars).select("symbol", "ts", *OHLCV)
    calendar = kept.select("ts").distinct().withColumn("bar_idx", F.row_number().over(over([])) - 1)
    grid = kept.select("symbol").distinct().join(calendar, how="cross")
    dense = grid.join(kept.select("symbol", "ts", *OHLCV), ["symbol", "ts"], "left")
    return with_state(dense)


def with_state(dense: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """listed: a price is there. tradable: one was there on the calendar's previous row too; ret only then."""
    w = over([*by, "symbol"], "bar_idx")
    df = dense.withColumn("listed", F.col("close").isNotNull())
    df = df.withColumn("tradable", F.col("listed") & F.lag("listed", 1, False).over(w))
    return df.withColumn("ret", F.when(F.col("tradable"), ratio(F.col("close"), F.lag("close").over(w)) - 1))


def select_symbols(panel: DataFrame, symbols: list[str]) -> DataFrame:
    """Rows of the symbols that the panel has; an error if it has none of them."""
    found = panel.filter(F.col("symbol").isin(symbols))
    if found.isEmpty():
        raise ValueError(f"none of {', '.join(symbols)} is in the panel")
    return found


def slice_bars(panel: DataFrame, first: int, stop: int) -> DataFrame:
    """Rows first..stop-1, positions from 0 again and state as if the slice were all there is."""
    part = panel.filter((F.col("bar_idx") >= first) & (F.col("bar_idx") < stop)).withColumn("bar_idx", F.col("bar_idx") - first)
    return with_state(part.drop("listed", "tradable", "ret"))


def survivorship(panel: DataFrame, grace: int = 5, most: int = 25) -> DataFrame:
    """One row: symbols, those that stop or start within the panel, survival rate, and whether the panel looks biased."""
    ends = panel.agg(F.max("bar_idx").alias("last")).first()[0]
    each = panel.groupBy("symbol").agg(F.min(F.when(F.col("listed"), F.col("bar_idx"))).alias("first"), F.max(F.when(F.col("listed"), F.col("bar_idx"))).alias("last"))
    gone, late = F.col("last") < (ends or 0) - grace, F.col("first") > grace
    names = lambda c: F.slice(F.sort_array(F.collect_list(F.when(c, F.col("symbol")))), 1, most)
    found = each.agg(F.count("*").alias("n_symbols"), F.count(F.when(gone, 1)).alias("n_delisted"), F.count(F.when(late, 1)).alias("n_late"), names(gone).alias("delisted"), names(late).alias("late"))
    rate = 1 - ratio(F.col("n_delisted"), F.col("n_symbols"))
    years = ((ends if ends is not None else -1) + 1) / 252
    return found.withColumn("survival_rate", rate).withColumn("biased", (rate >= 1) & F.lit(years >= 3) & (F.col("n_symbols") >= 5))
