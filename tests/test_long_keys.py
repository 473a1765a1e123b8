"""Blocked scans, joins along time, quantiles by counting, caches and sinks that can be run again."""

import numpy as np
import pandas as pd
import pytest
from conftest import as_bars, wander
from pyspark.sql import functions as F

from barloom import catalogue
from barloom.functions import scans
from barloom.functions.columns import numbered
from barloom.functions.quantiles import exact_quantiles
from barloom.operators import joins, metrics
from barloom.operators.engine import run_backtest
from barloom.operators.strategies import get_strategy, with_targets
from barloom.sources import bars as src
from barloom.streaming import bars as live

BY = ["symbol"]
EMAS = [("e1", "close", 2 / 13, False, 12), ("e2", "close", 2 / 27, True, 0), ("e3", "close", 1.0, False, 1), ("e4", "close", 0.9, False, 3), ("e5", "close", 1 / 14, False, 14), ("e6", "close", 0.5, True, 5)]


@pytest.fixture(scope="module")
def gappy(spark):
    """Series with missing values: many, nearly all, none, a long run, a single row, and a symbol that is null."""
    g = np.random.default_rng(1)
    frames = []
    for name, n in (("a", 700), ("b", 60), (None, 300), ("c", 1), ("d", 400)):
        x = 100 + np.cumsum(g.normal(size=n))
        x[g.random(n) < {"a": 0.3, "d": 0.9}.get(name, 0)] = np.nan
        if name == "a":
            x[200:420] = np.nan
        if name == "b":
            x[:] = 7.7
        frames.append(pd.DataFrame({"symbol": name, "ts": pd.date_range("2020-01-01", periods=n, freq="D"), "close": x, "i": np.arange(n)}))
    f = pd.concat(frames).sort_values(["symbol", "ts"], na_position="last").reset_index(drop=True)
    rows = [(s if isinstance(s, str) else None, t.to_pydatetime(), None if c != c else float(c), int(i)) for s, t, c, i in f.itertuples(index=False)]
    return f, spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, i int").repartition(5).cache()


def in_order(df):
    return df.toPandas().sort_values(["symbol", "ts"], na_position="last").reset_index(drop=True)


@pytest.mark.parametrize("order,block", [("ts", None), ("i", 37), ("i", 5)])
def test_averages_by_blocks_are_pandas(gappy, order, block):
    f, df = gappy
    got = in_order(scans.averaged(df, BY, EMAS, order, None if block is None else F.floor(F.col("i") / block)))
    for name, c, alpha, adjust, least in EMAS:
        want = f.groupby("symbol", dropna=False, group_keys=False)[c].apply(lambda x: x.ewm(alpha=alpha, adjust=adjust, min_periods=least).mean())  # noqa: B023
        np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-11, err_msg=name)
    flat = got[(got.symbol == "b") & got.e1.notna()]
    assert (flat.e1 == 7.7).all() and (flat.e5.dropna() == 7.7).all()  # equal values average to themselves


def test_scans_by_blocks(gappy):
    f, df = gappy
    wanted = {"s": ("sum", "close"), "m": ("max", "close"), "low": ("min", "close"), "held": ("last", "close"), "n": ("count", "close"), "g1": ("lag", "close", 1), "g3": ("lag", "close", 3), "p": ("product", 1 + F.col("close") / 1e4)}
    g = f.groupby("symbol", dropna=False).close
    fill = lambda x: x.groupby(f.symbol, dropna=False).ffill()
    want = {"s": fill(g.cumsum()), "m": fill(g.cummax()), "low": fill(g.cummin()), "held": g.ffill(), "n": f.close.notna().groupby(f.symbol, dropna=False).cumsum(), "g1": g.shift(1), "g3": g.shift(3), "p": fill((1 + f.close / 1e4).groupby(f.symbol, dropna=False).cumprod())}
    for block in (2, 50, 10_000):
        got = in_order(scans.scanned(df, BY, wanted, "i", F.floor(F.col("i") / block)))
        for k, v in want.items():
            np.testing.assert_allclose(got[k].astype(float), v.astype(float), rtol=1e-9, err_msg=f"{k} by {block}")
    assert scans.scanned(df.limit(0), BY, wanted, "i").count() == 0 == scans.averaged(df.limit(0), BY, EMAS).count()


def test_scans_order_rows_of_one_time(spark, tmp_path):
    """The query over events that share their times, later ids first in the table: ids order them, over the ends of blocks too."""
    g = np.random.default_rng(3)
    n = 400
    f = pd.DataFrame({"event_id": np.arange(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) // 8 * 5, unit="h"), "event_type": np.where(g.random(n) < 0.5, "a", "b"), "value": g.integers(0, 5000, n) / 100})
    rows = [(int(i), t.to_pydatetime(), e, float(v)) for i, t, e, v in f[::-1].itertuples(index=False)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = catalogue.QUERIES["w_blocked_scans"](spark, str(tmp_path)).toPandas().sort_values("event_id").reset_index(drop=True)
    f["price"], f["part"] = f.value + 1, f.value.where(f.event_id % 3 > 0)
    by = f.groupby("event_type")
    want = {"summed": by.price.cumsum(), "n_parts": f.part.notna().groupby(f.event_type).cumsum(), "held": by.part.ffill(), "before": by.price.shift(1), "before_7": by.price.shift(7)}
    for k, v in want.items():
        np.testing.assert_allclose(got[k].astype(float), v.astype(float), atol=2e-6, err_msg=k)


def test_a_long_key_is_many_tasks(spark):
    """One symbol's running product and averages: no task has more than a block of its rows."""
    one = spark.range(0, 60_000, 1, 8).select(F.lit("x").alias("symbol"), F.col("id").alias("i"), (100 + F.sin("id")).alias("close"))
    block = F.floor(F.col("i") / 2000)
    part = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    off = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as if the rows were many
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        assert max(part(scans.scanned(one, BY, {"p": ("product", F.col("close") / 100)}, "i", block))) < 40_000
        assert max(part(scans.averaged(one, BY, [("e", "close", 0.1, False, 1)], "i", block))) < 40_000
    finally:
        for k in off:
            spark.conf.unset(k)


def test_engine_by_blocks(spark, book_bars):
    held = with_targets(numbered(book_bars, BY), BY, [(get_strategy("sma_cross"), {"fast": 5, "slow": 50}), (get_strategy("momentum"), {"lookback": 20})])
    keys = [*BY, "trial_id"]
    for lag in (1, 3):
        one, many = (run_backtest(held, keys, lag=lag, max_leverage=0.8, block=b).orderBy(*keys, "ts") for b in (None, "month"))
        assert one.columns == many.columns or set(one.columns) == set(many.columns)
        pd.testing.assert_frame_equal(one.toPandas(), many.select(one.columns).toPandas(), rtol=1e-11)
    down = [metrics.under_water(metrics.with_drawdown(one, keys, block=b), keys, block=b).orderBy(*keys).toPandas() for b in (None, "quarter")]
    pd.testing.assert_frame_equal(*down)
    a, b = (numbered(book_bars, BY, block=x).orderBy("symbol", "ts").select("symbol", "ts", "bar_idx").toPandas() for x in (None, "year"))
    pd.testing.assert_frame_equal(a, b)


def test_asof_join(spark):
    g = np.random.default_rng(4)
    day = pd.Timestamp("2024-01-01")
    rows = lambda n, step: [(["a", "b", None][g.integers(0, 3)], (day + pd.Timedelta(minutes=int(g.integers(0, 40) * step))).to_pydatetime(), int(k)) for k in range(n)]
    left, right = rows(150, 30), rows(60, 60)
    left.append(("a", None, 999))
    ls, rs = spark.createDataFrame(left, "symbol string, ts timestamp_ntz, n int"), spark.createDataFrame([*right, ("a", None, 7)], "symbol string, ts timestamp_ntz, n int")
    for within in (None, "90 minutes"):
        want = []
        for s, t, n in left:
            ok = [(u, m) for k, u, m in right if k == s and t is not None and u <= t and (within is None or t - u <= pd.Timedelta(within))]
            want.append((s, t, n, *(max(ok) if ok else (None, None))))
        for block in ("month", "hour"):
            got = joins.asof_join(ls, rs, BY, ties="n", within=within, block=block)
            assert got.columns == ["symbol", "ts", "n", "ts_right", "n_right"]
            assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert joins.asof_join(ls.limit(0), rs, BY).count() == 0 and joins.asof_join(ls, rs.limit(0), BY).filter("n_right is not null").count() == 0


def test_interval_join(spark):
    g = np.random.default_rng(9)
    points = [(int(g.integers(0, 3)), int(g.integers(-50, 5000)), k) for k in range(300)] + [(None, 5, 1000), (1, None, 1001)]
    spans = [(int(g.integers(0, 3)), int(s := g.integers(-100, 5000)), int(s + g.choice([-1, 0, 1, 2, 8, 9, 63, 700, 40_000])), k) for k in range(200)] + [(None, 0, 10, 900), (1, None, 5, 901)]
    got = joins.interval_join(spark.createDataFrame(points, "k int, at long, n int"), spark.createDataFrame(spans, "k int, s long, e long, n int"), ["k"], "at", "s", "e")
    assert got.columns == ["k", "at", "n", "s", "e", "n_right"]
    want = sorted((k, a, n, s, e, m) for k, a, n in points for j, s, e, m in spans if k is not None and k == j and None not in (a, s) and s <= a < e)
    assert sorted(map(tuple, got.collect())) == want


def test_quantiles_by_counting(spark):
    g = np.random.default_rng(2)
    series = {"n": g.normal(size=5000), "ties": g.integers(0, 3, 3000).astype(float), "heavy": g.standard_cauchy(4000) ** 3, "one": np.array([4.0]), "two": np.array([1.0, 2.0]), None: g.exponential(size=777)}
    rows = [(k, float(v)) for k, x in series.items() for v in x] + [("n", float("nan")), ("n", None), ("none", None), ("n", float("inf"))]
    df = spark.createDataFrame(rows, "symbol string, x double").repartition(6)
    qs = [0.0, 0.05, 0.5, 0.999, 1.0]
    for share in (1 / 2000, 1e-9, 1.0):  # a fair bracket, one that must widen again and again, and none
        got = {(r.symbol, r.q): (r.value, r.n) for r in exact_quantiles(df, BY, "x", qs, share).collect()}
        assert set(got) == {(k, q) for k in series for q in qs}
        for (k, q), (v, n) in got.items():
            np.testing.assert_allclose(v, np.quantile(series[k], q), rtol=1e-12)
            assert n == len(series[k])


def test_cache_keeps_other_symbols_and_takes_corrections(spark, tmp_path):
    path = f"{tmp_path}/cache"
    a, b = as_bars(spark, wander(300, 1, "BF/B")), as_bars(spark, wander(300, 2, "B#B"))
    src.write_cache(a, path, "1d")
    src.write_cache(b, path, "1d")
    src.write_cache(a.limit(7), path, "1wk")
    read = lambda *s, i="1d": src.read_cache(spark, path, i, list(s))
    assert read("BF/B").count() == read("B#B").count() == 300 and read("BF/B", i="1wk").count() == 7
    day = b.orderBy("ts").first().ts
    stamp = lambda: {r.f: r.t for r in spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("t")).distinct().collect()}
    before = stamp()
    fix = b.filter(F.col("ts") == F.lit(day)).withColumn("close", F.lit(1.25))
    late = fix.withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 DAY"))
    for _ in range(2):  # again changes nothing
        src.upsert_cache(fix.unionByName(late), path, "1d", f"{tmp_path}/merged")
        got = read("B#B")
        assert got.count() == 301 and got.filter("close = 1.25").count() == 2 and read("BF/B").count() == 300
    changed = set(stamp()) ^ set(before)
    assert changed and all("symbol=B%2523B/year=2021" in f or "symbol=B%23B/year=2021" in f for f in changed)
    # a symbol written anew loses years it no longer has
    src.write_cache(b.filter(F.year("ts") == 2022), path, "1d")
    assert {r.y for r in read("B#B").select(F.year("ts").alias("y")).distinct().collect()} == {2022} and read("BF/B").count() == 300


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    sink = live.batch_sink(f"{tmp_path}/sink")
    df = spark.range(10).toDF("x")
    for n, batch in ((0, df), (1, df.filter("x < 3")), (1, df.filter("x < 3")), (0, df), (2, df), (2, df.limit(0))):
        sink(batch, n)
    assert {r.batch: r["count"] for r in spark.read.parquet(f"{tmp_path}/sink").groupBy("batch").count().collect()} == {0: 10, 1: 3}


def stream_of(spark, tmp_path, frames):
    for k, f in enumerate(frames):
        f.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in-{k}")
    import glob
    import os
    import shutil

    os.makedirs(f"{tmp_path}/in")
    for k in range(len(frames)):
        for f in glob.glob(f"{tmp_path}/in-{k}/part-*.parquet"):
            shutil.copy(f, f"{tmp_path}/in/{k:03d}.parquet")
            os.utime(f"{tmp_path}/in/{k:03d}.parquet", (1000 + k, 1000 + k))
    return live.read_bar_files(spark, f"{tmp_path}/in")


def test_failed_batches_run_again_and_failures_are_kept(spark, tmp_path):
    data = as_bars(spark, wander(30, 3))
    calls = []

    def flaky(batch, number):
        calls.append(number)
        if len(calls) == 1:
            raise RuntimeError("first try")

    go = lambda **how: live.fan_out(stream_of(spark, tmp_path, [data]) if not calls else live.read_bar_files(spark, f"{tmp_path}/in"), [live.batch_sink(f"{tmp_path}/out"), flaky], f"{tmp_path}/ck", **how)
    with pytest.raises(Exception, match="first try"):
        go(strict=True).awaitTermination()
    go(strict=True).awaitTermination()
    assert calls == [0, 0] and spark.read.parquet(f"{tmp_path}/out").count() == 30

    def always(batch, number):
        raise ValueError("no")

    live.fan_out(live.read_bar_files(spark, f"{tmp_path}/in"), [always, live.batch_sink(f"{tmp_path}/out2")], f"{tmp_path}/ck2", failures=f"{tmp_path}/failed").awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/failed").collect()] == [(0, "no", 0)] and spark.read.parquet(f"{tmp_path}/out2").count() == 30


def test_late_and_corrected_bars_of_a_stream(spark, tmp_path):
    data = as_bars(spark, wander(40, 5))
    t = [r.ts for r in data.orderBy("ts").collect()]
    first, late = data.filter(~F.col("ts").isin(t[30])), data.filter(F.col("ts").isin(t[30], t[31]))
    out = live.late_bars(stream_of(spark, tmp_path, [first, late]), "60 days")
    live.run_available(out, f"{tmp_path}/sink", f"{tmp_path}/ck")
    assert spark.read.parquet(f"{tmp_path}/sink").count() == 40  # the late one passes, the repeated one does not
    n = [0]

    def scratch():
        n[0] += 1
        return f"{tmp_path}/merge-{n[0]}"

    live.fan_out(live.read_bar_files(spark, f"{tmp_path}/in"), [live.upsert_sink(f"{tmp_path}/cache", "1d", scratch)], f"{tmp_path}/ck2").awaitTermination()
    assert src.read_cache(spark, f"{tmp_path}/cache", "1d", ["WAVE"]).count() == 40


def test_sessions_of_a_stream(spark, tmp_path):
    at = [0, 5, 12, 60, 61, 200, 500]
    rows = [("a", (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)).to_pydatetime(), float(m)) for m in at]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, price double")
    whole = live.tick_sessions(ticks).orderBy("first_ts").collect()
    assert [(r.open, r.close, r.volume) for r in whole] == [(0.0, 12.0, 3.0), (60.0, 61.0, 2.0), (200.0, 200.0, 1.0), (500.0, 500.0, 1.0)]
    ticks.coalesce(1).write.parquet(f"{tmp_path}/ticks")
    stream = spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/ticks")
    live.run_available(live.tick_sessions(stream, late="10 minutes"), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3  # the last one is still open
