"""Incremental bars: a high-water mark per symbol, buffers of recent bars, and bars from ticks."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.bars import OHLCV, SCHEMA, drop_incomplete, upsert_cache

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BAR = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def next_delay(interval: float, failures: int, most: float = 900.0, uniform: Callable[[float, float], float] = random.uniform) -> float:
    """Seconds to the next poll: doubled by each failure up to a limit, spread by a fifth, 1 at least."""
    return max(1.0, min(interval * 2**failures, most) * uniform(0.8, 1.2))


class HighWater(StatefulProcessor):
    """Passes a symbol's bars that are newer than any it has passed; late and repeated ones are dropped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        mark = pd.Timestamp(self.mark.get()[0]) if self.mark.exists() else None
        top, passed = mark, pd.Index([], dtype="datetime64[ns]")
        # frame by frame: of a batch only the times that have passed are kept
        for pdf in rows:
            pdf = pdf if mark is None else pdf[pdf["ts"] > mark]
            pdf = pdf[~pdf["ts"].isin(passed)].sort_values("ts", kind="stable").drop_duplicates("ts", keep="first")
            if len(pdf):
                passed = passed.append(pd.Index(pdf["ts"].astype("datetime64[ns]")))
                top = pdf["ts"].max() if top is None else max(top, pdf["ts"].max())
                yield pdf[["symbol", "ts", *OHLCV]]
        if top is not None and (mark is None or top > mark):
            self.mark.update((top.to_pydatetime(),))

    def close(self) -> None:
        pass


class Recent(StatefulProcessor):
    """Keeps a symbol's last n bars and passes them all after each batch: the buffer as a table."""

    n = 100

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getListState("bars", "ts timestamp, open double, high double, low double, close double, volume double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        cols = ["ts", *OHLCV]
        old = pd.DataFrame(list(self.bars.get()), columns=cols)
        new = pd.concat(list(rows))[cols]
        pdf = (pd.concat([old, new]) if len(old) else new).sort_values("ts", kind="stable").tail(self.n)
        self.bars.put([tuple([r[0].to_pydatetime(), *map(float, r[1:])]) for r in pdf.itertuples(index=False)])
        pdf.insert(0, "symbol", key[0])
        yield pdf

    def close(self) -> None:
        pass


def complete_bars(stream: DataFrame, interval: str, now: str) -> DataFrame:
    """Bars held back while they form: filtered before the mark moves, so their final form is not lost."""
    return drop_incomplete(stream, interval, F.lit(now).cast("timestamp"))


def live_bars(stream: DataFrame, interval: str, now: str, callbacks: list[Callable[[DataFrame, int], None]], checkpoint: str, every: str | None = None, **how):
    """Polled bars to every callback: those that still form are held back, then each symbol's mark passes what is newer. how: see fan_out."""
    return fan_out(new_bars(complete_bars(stream, interval, now)), callbacks, checkpoint, every, **how)


def trade_live(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, **how):
    """The signal rule on each symbol's recent bars after every batch; `act` gets the fills."""
    from ..plans.agentic import run_once

    return fan_out(recent_bars(stream), [lambda batch, k: act(run_once(batch.dropDuplicates(["symbol", "ts"]), ["symbol"], **how), k)], checkpoint, every)


def _keyed(stream: DataFrame):
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)  # the one that keeps typed state
    return stream.groupBy("symbol")


def new_bars(stream: DataFrame) -> DataFrame:
    return _keyed(stream).transformWithStateInPandas(HighWater(), BAR, "Append", "None")


def recent_bars(stream: DataFrame) -> DataFrame:
    return _keyed(stream).transformWithStateInPandas(Recent(), BAR, "Append", "None")


def late_bars(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Every (symbol, ts) once, bars that come late too: as old as `late` behind the newest, a repeated one is known and dropped."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "ts"])


def tick_sessions(ticks: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Ticks (ts, symbol, price) as a bar a session: a session ends where `gap` passes without a tick.

    Of a stream, with `late`, sessions come once the watermark has passed them; of a table, all.
    """
    t = ticks if late is None else ticks.withWatermark("ts", late)
    return (
        t.groupBy("symbol", F.session_window("ts", gap).alias("w"))
        .agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count("*").cast("double").alias("volume"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .select("symbol", "first_ts", "last_ts", *OHLCV)
    )


def tick_windows(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Ticks (ts, symbol, price) as bars of tumbling windows, closed once the watermark passes. An extension."""
    return (
        ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count("*").cast("double").alias("volume"))
        .select("symbol", F.col("w.start").alias("ts"), *OHLCV)
    )


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Everything there is, as Parquet; state and progress stay in `checkpoint`."""
    q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A callback that writes each batch into a folder of its own, named by its number: a batch that runs again replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def upsert_sink(path: str, interval: str, scratch: Callable[[], str]) -> Callable[[DataFrame, int], None]:
    """A callback that merges each batch's bars into a cache by (symbol, ts): the latest correction stays, and a batch that runs again changes nothing."""
    return lambda batch, number: upsert_cache(batch.withColumn("ts", F.col("ts").cast("timestamp_ntz")), path, interval, scratch())


def fan_out(stream: DataFrame, callbacks: list[Callable[[DataFrame, int], None]], checkpoint: str, every: str | None = None, failures: str | None = None, strict: bool = False):
    """Starts a query that hands every batch to each callback; one that fails does not stop the others.

    failures: a folder for a row of each failed call (batch, callback, error), kept by batch number.
    strict: after all callbacks have run, the first error ends the query, so that its batch runs again.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        failed: list[tuple[int, Exception]] = []
        try:
            for k, call in enumerate(callbacks):
                try:
                    call(batch, number)
                except Exception as e:  # noqa: BLE001
                    failed.append((k, e))
        finally:
            batch.unpersist()
        if failures is not None and failed:
            batch_sink(failures)(spark.createDataFrame([(k, str(e)) for k, e in failed], "callback int, error string"), number)
        elif failed and not strict:
            print(*[f"callback {k} failed on batch {number}: {e}" for k, e in failed], sep="\n")
        if strict and failed:
            raise failed[0][1]

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_bar_files(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA.replace("timestamp_ntz", "timestamp")).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def nudged(latest: DataFrame, seed: int, seconds: int = 60) -> DataFrame:
    """A test source: each symbol's next bar, within 1% of its latest close."""
    from ..functions.columns import draw

    close = F.col("close") * (1 + (draw(F.lit(seed), "symbol", F.unix_micros(F.col("ts").cast("timestamp"))) - 0.5) * 0.02)
    return latest.select("symbol", (F.col("ts") + F.expr(f"INTERVAL {seconds} SECONDS")).alias("ts"), F.col("close").alias("open"), F.greatest("close", close).alias("high"), F.least("close", close).alias("low"), close.alias("_c"), "volume").withColumnRenamed("_c", "close")
