"""Synthetic bars and ticks. Walks are products, so they are windows over drawn shocks, not loops."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import draw, so_far

# Last price, yearly drift and volatility of named symbols; others get the default.
PROFILES = {"AAPL": (190.0, 0.18, 0.28), "MSFT": (410.0, 0.17, 0.26), "SPY": (520.0, 0.10, 0.18), "BTC-USD": (65000.0, 0.45, 0.65)}
DEFAULT = (100.0, 0.08, 0.25)
# Chances to enter and leave the stressed state, and its and the calm one's volatility factors.
ENTER, LEAVE, STRESS, CALM, MEMORY = 0.01, 0.06, 2.4, 0.9, 0.92
# What a scenario multiplies volatility and trend by, and the trend it sets.
SCENARIOS = {"normal": (1, 1, None), "volatile": (3, 1, None), "trending": (1, 5, None), "crash": (5, 1, -0.01)}


def simulate(spark: SparkSession, symbols: list[str], start: str, end: str, frequency: str = "B") -> DataFrame:
    """Bars with fat tails and clustered volatility; the same for a symbol always. Two recursions per symbol, so a grouped map."""
    n = len(pd.date_range(start, end, freq=frequency))
    if n < 50:
        raise ValueError("fewer than 50 bars")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        symbol = pdf["symbol"].iloc[0]
        index = pd.date_range(start, end, freq=frequency)
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(symbol.upper().encode()).digest()[:4], "big"))
        price, drift, vol = PROFILES.get(symbol.upper(), DEFAULT)
        mu, sigma = drift / 252, vol / np.sqrt(252)
        shock, turn = rng.standard_t(4, n) / np.sqrt(2), rng.random(n)
        state, level, close, stress = 0, 1.0, np.empty(n), np.empty(n, bool)
        x = 0.0
        for t in range(n):
            state = int(turn[t] < ENTER) if not state else int(turn[t] >= LEAVE)
            level = MEMORY * level + (1 - MEMORY) * (STRESS if state else CALM)
            s = sigma * level
            x += (mu - 3 * s * s if state else mu) + s * shock[t]
            close[t], stress[t] = x, state
        close = np.exp(close - close[-1]) * price
        opens = np.concatenate([close[:1], close[:-1]]) * np.exp(rng.normal(0, sigma / 4, n))
        high = np.maximum(opens, close) * np.exp(np.abs(rng.normal(0, sigma / 2, n)))
        low = np.minimum(opens, close) * np.exp(-np.abs(rng.normal(0, sigma / 2, n)))
        volume = rng.lognormal(14, 0.4, n) * np.where(stress, 4, 1)
        return pd.DataFrame({"symbol": symbol, "ts": index, "open": opens, "high": high, "low": low, "close": close, "volume": volume})

    return spark.createDataFrame([(s,) for s in symbols], "symbol string").groupBy("symbol").applyInPandas(run, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def normal(*key) -> Column:
    """A standard normal number from its key (two draws)."""
    u, v = draw(*key, F.lit("u")), draw(*key, F.lit("v"))
    return F.sqrt(-2 * F.log(u + 1e-12)) * F.cos(v * 2 * np.pi)


def walk_bars(spark: SparkSession, symbol: str, start: str, n: int, seconds: int = 60, price: float = 100.0, vol: float = 0.02, noise: float = 0.005, seed: int = 0, trend: float = 0.0) -> DataFrame:
    """Bars of a multiplicative walk, prices to the cent. trend: mean change of a bar from open to close."""
    ids = spark.range(n).withColumn("symbol", F.lit(symbol)).withColumn("ts", (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * seconds)))
    z = lambda k: normal(F.lit(seed), F.lit(symbol), "id", F.lit(k))
    steps = ids.withColumns({"gap": 1 + noise * z("gap"), "body": 1 + trend + vol * z("body"), "wide": 1.5 + 1.5 * draw(F.lit(seed), "id", F.lit("wide")), "volume": (1000 + 9000 * draw(F.lit(seed), "id", F.lit("volume"))).cast("int")})
    w = so_far(["symbol"], "id")
    walked = steps.withColumn("close", price * F.exp(F.sum(F.log(F.greatest(F.col("gap") * F.col("body"), F.lit(1e-6)))).over(w)))
    walked = walked.withColumn("open", F.col("close") / F.greatest(F.col("body"), F.lit(1e-6)))
    reach = F.abs(F.col("close") - F.col("open")) * F.col("wide") * draw(F.lit(seed), "id", F.lit("reach")) / 2
    return walked.select("symbol", "ts", F.round("open", 2).alias("open"), F.round(F.greatest("open", "close") + reach, 2).alias("high"), F.round(F.greatest(F.lit(0.0), F.least("open", "close") - reach), 2).alias("low"), F.round("close", 2).alias("close"), F.col("volume").cast("double").alias("volume"))


def scenario(spark: SparkSession, name: str, symbol: str, start: str, n: int, vol: float = 0.02, trend: float = 0.0001, **how) -> DataFrame:
    """A walk whose volatility and trend are multiplied, or whose trend is set, by the scenario."""
    if name not in SCENARIOS:
        raise ValueError(f"unknown scenario {name}; there are {', '.join(SCENARIOS)}")
    wilder, steeper, fixed = SCENARIOS[name]
    return walk_bars(spark, symbol, start, n, vol=vol * wilder, trend=trend * steeper if fixed is None else fixed, **how).withColumn("scenario", F.lit(name))


def walk_ticks(spark: SparkSession, symbol: str, start: str, minutes: int, interval_ms: int = 1000, price: float = 100.0, noise: float = 0.005, seed: int = 0) -> DataFrame:
    ids = spark.range(minutes * 60_000 // interval_ms).withColumn("symbol", F.lit(symbol))
    ts = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * interval_ms / 1000)
    path = price * F.exp(F.sum(0.0005 * normal(F.lit(seed), "id", F.lit("step"))).over(so_far(["symbol"], "id")))
    return ids.select(ts.alias("ts"), "symbol", F.round(path * (1 + noise / 2 * normal(F.lit(seed), "id", F.lit("noise"))), 4).alias("price"), (1 + 99 * draw(F.lit(seed), "id", F.lit("volume"))).cast("int").alias("volume"))


def walk_series(spark: SparkSession, n: int, price: float, mu: float, sigma: float, seed: int = 0) -> DataFrame:
    """Geometric Brownian motion on [0, 1]."""
    ids = spark.range(n).withColumn("series", F.lit(seed))
    t = F.col("id") / F.lit(max(n - 1, 1))
    path = (mu - sigma * sigma / 2) * t + sigma * F.sum(normal(F.lit(seed), "id") * np.sqrt(1 / n)).over(so_far(["series"], "id"))
    return ids.select("id", (price * F.exp(path)).alias("price"))
