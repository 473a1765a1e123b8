"""Bars: views over the tables, scans and sinks, normalisation, validation."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import over
from .scratch import exists, remove

OHLCV = ["open", "high", "low", "close", "volume"]
SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"

# Names an interval may have, its length in seconds, and how many days of history a vendor keeps.
INTERVALS = {
    "1m": "1m", "1min": "1m", "1Min": "1m", "2m": "2m", "5m": "5m", "5Min": "5m", "15m": "15m", "15Min": "15m", "30m": "30m",
    "60m": "60m", "1h": "1h", "1Hour": "1h", "1d": "1d", "1D": "1d", "1Day": "1d", "1wk": "1wk", "1mo": "1mo",
}
SECONDS = {"1m": 60, "2m": 120, "5m": 300, "15m": 900, "30m": 1800, "60m": 3600, "1h": 3600, "1d": 86400, "1wk": 604800}
LOOKBACK_DAYS = {"1m": 7, "2m": 59, "5m": 59, "15m": 59, "30m": 59, "60m": 729, "1h": 729}
SPLIT_MOVE = 0.35


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades_to_bars(trades: DataFrame, order: list[str]) -> DataFrame:
    """trades: symbol, ts, price, quantity and the columns that order trades of one time. One bar per symbol and ts."""
    first, last = F.struct(*order, "price"), F.struct(*order, "price")
    return trades.groupBy("symbol", "ts").agg(
        F.min_by("price", first).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", last).alias("close"), F.sum("quantity").alias("volume")
    )


def _line_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_partkey", F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"), "l_orderkey", "l_linenumber", "l_suppkey",
    )


ORDER = ["l_orderkey", "l_linenumber", "l_suppkey"]


def bars_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_to_bars(_line_trades(spark, sf_dir).withColumn("symbol", F.lit("MARKET")), ORDER)


def bars_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    return trades_to_bars(_line_trades(spark, sf_dir).join(part, "l_partkey"), ORDER)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("symbol"), (F.col("value") + 1).alias("price"))


def tick_bars(t: DataFrame, width: str = "1 hour") -> DataFrame:
    """Ticks gathered into bars of a fixed width."""
    return t.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", "event_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "event_id").alias("close"), F.count("*").cast("double").alias("volume")
    ).select("symbol", F.col("w.start").alias("ts"), *OHLCV)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and a timestamp or date column; the six columns of a bar are required."""
    raw = spark.read.option("header", True).csv(path)
    if "timestamp" not in raw.columns and "date" in raw.columns:
        raw = raw.withColumnRenamed("date", "timestamp")
    missing = {"timestamp", *OHLCV} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    symbol = F.col("symbol") if "symbol" in raw.columns else F.lit(None).cast("string")
    return raw.select(symbol.alias("symbol"), F.to_timestamp_ntz("timestamp").alias("ts"), *[F.expr(f"try_cast({c} as double)").alias(c) for c in OHLCV])


def write_csv(bars: DataFrame, path: str) -> None:
    bars.withColumnRenamed("ts", "timestamp").write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(path)


#: A cache's folders, outermost first. A correction rewrites a symbol's year.
CACHE = ("interval", "symbol", "year")


def _escaped(name: str) -> str:
    """A value as Spark writes it into a folder's name."""
    return re.sub(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", name)


def _placed(bars: DataFrame, interval: str) -> DataFrame:
    return bars.select(F.regexp_replace("symbol", "/", "_").alias("symbol"), "ts", *OHLCV, F.lit(interval).alias("interval"), F.year("ts").alias("year"))


def write_cache(bars: DataFrame, path: str, interval: str) -> None:
    """Bars of whole symbols in place of what the cache has of them; other symbols and intervals stay."""
    spark = bars.sparkSession
    new = _placed(bars, interval)
    if exists(spark, path):
        # years that a symbol no longer has go too: empty them, then write
        symbols = new.select("symbol").distinct()
        old = _cached(spark, path).filter(F.col("interval") == interval)
        gone = old.join(symbols, "symbol", "left_semi").select("symbol", "year").distinct().join(new.select("symbol", "year").distinct(), ["symbol", "year"], "left_anti")
        stale = [f"{path}/interval={interval}/symbol={_escaped(r['symbol'])}/year={r['year']}" for r in gone.toLocalIterator()]
    else:
        stale = []
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*CACHE).parquet(path)
    for folder in stale:
        remove(spark, folder)


def _cached(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"symbol string, {SCHEMA.split(', ', 1)[1]}, interval string, year int").parquet(path)


def upsert_cache(bars: DataFrame, path: str, interval: str, scratch: str | None = None) -> None:
    """Late and corrected bars into a cache by (symbol, ts): only the years they fall into are written anew.

    Of bars that repeat a symbol and time, any one wins: give one of each. The merged years are
    written to `scratch` first, so that no file is read while it is replaced, and a run that dies can
    be run again.
    """
    spark = bars.sparkSession
    new = _placed(bars, interval)
    if exists(spark, path):
        years = new.select("interval", "symbol", "year").distinct()
        # the folders' columns alone decide what is read of the cache
        old = _cached(spark, path).join(F.broadcast(years) if years.count() <= 100_000 else years, list(CACHE), "left_semi")
        new = old.join(new.select("symbol", "ts"), ["symbol", "ts"], "left_anti").unionByName(new)
    new = new.dropDuplicates(["symbol", "ts"])
    if scratch is not None:
        new.write.mode("overwrite").parquet(scratch)
        new = spark.read.schema(new.schema).parquet(scratch)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*CACHE).parquet(path)


def read_cache(spark: SparkSession, path: str, interval: str, symbols: list[str]) -> DataFrame:
    found = _cached(spark, path).filter((F.col("interval") == interval) & F.col("symbol").isin([s.replace("/", "_") for s in symbols]))
    return found.select("symbol", "ts", *OHLCV)


def load_bars(source: str, cached: DataFrame | None, live: DataFrame | None, simulated: DataFrame, least: int = 50, start=None, end=None, cache: str | None = None, interval: str = "1d") -> tuple[DataFrame, str]:
    """Bars from start to end and where they come from: a live frame or a cached one is taken if it has more than `least` rows there, else the simulator's.

    source: synthetic, yahoo or live (fail without a live frame), auto, or anything else for the cache.
    cache: a folder that a live frame is written to, whole.
    """

    def window(df: DataFrame) -> DataFrame:
        df = df if start is None else df.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
        return df if end is None else df.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))

    enough = lambda df: df is not None and len(window(df).select(F.lit(1)).take(least + 1)) > least
    if source != "synthetic" and source in ("yahoo", "live", "auto") and enough(live):
        if cache is not None:
            write_cache(live, cache, interval)
        return window(live), "yfinance"
    if source in ("yahoo", "live"):
        raise RuntimeError("no live bars")
    if source != "synthetic" and enough(cached):
        return window(cached), "bundled"
    return window(simulated), "synthetic"


def load_panel_bars(bars: DataFrame, symbols: list[str] | None = None, min_bars: int = 120, simulated: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(bars of symbols with min_bars rows or more, a row per symbol asked for: symbol, bars, note).

    Symbols that are missing are taken from `simulated` where it has them; what is too short is skipped and noted.
    """
    wanted = list(dict.fromkeys(s.strip().upper() for s in symbols)) if symbols else None
    named = bars if wanted is None else bars.filter(F.upper("symbol").isin(wanted))
    named = named.withColumn("simulated", F.lit(False))
    if simulated is not None:
        there = named.select("symbol").distinct()
        more = simulated if wanted is None else simulated.filter(F.upper("symbol").isin(wanted))
        named = named.unionByName(more.join(there, "symbol", "left_anti").select(*bars.columns, F.lit(True).alias("simulated")))
    counts = named.groupBy("symbol").agg(F.count("*").alias("bars"), F.max("simulated").alias("simulated"))
    if wanted is not None:
        asked = bars.sparkSession.createDataFrame([(s,) for s in wanted], "asked string")
        counts = asked.join(counts, F.upper("symbol") == F.col("asked"), "left").select(F.coalesce("symbol", "asked").alias("symbol"), F.coalesce("bars", F.lit(0)).alias("bars"), "simulated")
    note = F.when(F.col("bars") < min_bars, "skipped").when(F.col("simulated"), "simulated").otherwise("loaded")
    notes = counts.select("symbol", "bars", note.alias("note"))
    return named.drop("simulated").join(notes.filter("note <> 'skipped'").select("symbol"), "symbol", "left_semi"), notes


def vendor_history(raw: DataFrame, seq: str, start: Column, end: Column, now: Column, interval: str) -> tuple[DataFrame, DataFrame]:
    """(bars, suspected splits by symbol) of a vendor's raw rows: within the window the vendor keeps, clean, without the bar that still forms."""
    bars = drop_incomplete(clamp_window(normalise(raw, seq), start, end, now, interval), interval, now)
    return bars, split_suspects(bars, ["symbol"])


def synthetic_scan(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The bars in `path`; made and saved there first if there are none."""
    if not exists(spark, path):
        write_csv(make(), path)
    return read_csv(spark, path)


def read_config(path: str) -> dict:
    """A JSON or, where PyYAML is installed, YAML file as a dict."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f)


def load_data(spark: SparkSession, config: dict, make: Callable[[], DataFrame] | None = None, vendors: dict[str, Callable[[dict], DataFrame]] | None = None, strict: bool = True) -> DataFrame | None:
    """Bars from the source a config names: csv, synthetic, or a vendor that the caller brings.

    config: {"data_source": {"type": ..., "path": ...}}. Without `strict` a source that fails is None.
    """
    try:
        source = config["data_source"]
        kind = source["type"]
        if kind == "csv":
            return read_csv(spark, source["path"])
        if kind == "synthetic" and make is not None:
            return synthetic_scan(spark, source["path"], make)
        if kind in (vendors or {}):
            return vendors[kind](config)
        raise ValueError(f"no data source {kind!r}")
    except Exception:
        if strict:
            raise
        return None


def normalise(raw: DataFrame, seq: str, keep: str = "last", by: str = "symbol", drop_null: bool = False) -> DataFrame:
    """Clean bars: names lowered and joined, missing parts filled, one row per symbol and time, closes above 0.

    keep="last" fills open, high and low from close and volume with 0 and keeps the last of repeated
    times in the order of `seq`; keep="first" with drop_null drops rows with any missing value instead.
    """
    df = raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])
    names = set(df.columns)
    ts = next((c for c in ("ts", "timestamp", "datetime", "date") if c in names), None)
    if ts is None:
        raise ValueError("no time column")
    if "close" not in names:
        if "adj_close" not in names:
            raise ValueError("no close column")
        df = df.withColumnRenamed("adj_close", "close")
    close = F.expr("try_cast(close as double)")
    fill = {"volume": F.lit(0.0)} | dict.fromkeys(("open", "high", "low"), close)
    part = lambda c: close if c == "close" else F.expr(f"try_cast({c} as double)") if c in names else fill[c]
    if drop_null and (gone := {*OHLCV} - {*df.columns}):
        raise ValueError(f"missing columns: {sorted(gone)}")
    clean = lambda c: F.when(~F.isnan(c), c)
    df = df.select(by, F.col(ts).cast("timestamp_ntz").alias("ts"), seq, *[clean(part(c)).alias(c) for c in OHLCV])
    if drop_null:
        df = df.dropna(subset=["ts", *OHLCV])
    order = F.col(seq).desc() if keep == "last" else F.col(seq).asc()
    df = df.withColumn("_k", F.row_number().over(W.partitionBy(by, "ts").orderBy(order))).filter("_k = 1").drop("_k", seq)
    return df if drop_null else df.filter("close > 0")


def interval_of(alias: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in INTERVALS.items() for x in kv])[alias], F.lit("1d"))


def clamp_start(start: Column, now: Column, interval: str) -> Column:
    days = LOOKBACK_DAYS.get(interval)
    return start if days is None else F.greatest(start, now - F.expr(f"INTERVAL {days} DAYS"))


def clamp_window(bars: DataFrame, start: Column, end: Column, now: Column, interval: str) -> DataFrame:
    low = clamp_start(start, now, interval)
    high = F.when(end < low, low + F.expr("INTERVAL 1 DAY")).otherwise(end)
    return bars.filter((F.col("ts") >= low) & (F.col("ts") <= high))


def drop_incomplete(bars: DataFrame, interval: str, now: Column) -> DataFrame:
    """Bars that had ended by `now`; intervals of unknown length keep all."""
    seconds = SECONDS.get(interval)
    return bars if seconds is None else bars.filter(F.col("ts") + F.expr(f"INTERVAL {seconds} SECONDS") <= now)


def split_suspects(bars: DataFrame, by: list[str], move: float = SPLIT_MOVE) -> DataFrame:
    before = F.lag("close").over(over(by))
    return bars.withColumn("_m", F.abs(F.try_divide(F.col("close"), before) - 1)).groupBy(*by).agg(F.count(F.when(F.col("_m") > move, 1)).alias("suspects"))


def validate(bars: DataFrame) -> DataFrame:
    """One row: rows, rows dropped for missing values, counts of each violation, and whether the bars are valid."""
    whole = F.lit(True)
    for c in ("ts", *OHLCV):
        whole = whole & F.col(c).isNotNull()
    count = lambda c: F.count(F.when(whole & c, 1))
    negative = F.least("open", "high", "low", "close") < 0
    odd = (F.col("high") < F.col("low")) | (F.col("open") > F.col("high")) | (F.col("close") > F.col("high")) | (F.col("open") < F.col("low")) | (F.col("close") < F.col("low"))
    found = bars.agg(
        F.count("*").alias("n_rows"), F.count(F.when(~whole, 1)).alias("n_missing"), count(negative).alias("n_negative"),
        count(F.col("volume") == 0).alias("n_zero_volume"), count(odd).alias("n_inconsistent"),
    )
    left = F.col("n_rows") - F.col("n_missing")
    return found.withColumns({"volume_warning": F.col("n_zero_volume") * 2 > left, "valid": (F.col("n_rows") > 0) & (F.col("n_negative") == 0) & (F.col("n_inconsistent") == 0)})


def latest(bars: DataFrame, by: list[str], n: int = 100) -> DataFrame:
    """The last n bars of each key."""
    newest = W.partitionBy(*by).orderBy(F.col("ts").desc())
    return bars.withColumn("_k", F.row_number().over(newest)).filter(F.col("_k") <= n).drop("_k")
