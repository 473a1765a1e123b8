"""Every operator as a query over the tables, with its SQL where SQL can express it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as o
from . import oracle_stats as stats
from .functions import columns as c
from .functions import indicators as ind
from .functions.quantiles import exact_quantiles
from .functions.scans import averaged, scanned
from .operators import attribution, joins, metrics, panel, portfolio
from .operators.cross_sectional import XS_REGISTRY, rebalance_hold, with_weights
from .operators.engine import run_backtest
from .operators.strategies import REGISTRY, get_strategy, with_targets
from .plans import agentic, lab, sql, validation
from .sources import bars as src
from .sources import generators as gen
from .sources.scratch import scratch
from .streaming import bars as live
from .streaming import poll

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BY = ["symbol"]
OHLCV = src.OHLCV


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[(F.round(f.name, n) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def cols(df: DataFrame, *names: str, n: int = 6) -> DataFrame:
    return rounded(df.select(*names), n)


def market(spark, d):
    return c.numbered(src.bars_market(spark, d), BY)


def brand(spark, d):
    return c.numbered(src.bars_brand(spark, d), BY)


def the_panel(spark, d):
    return panel.make_panel(src.bars_brand(spark, d))


def market_target(spark, d, key="sma_cross", **params):
    return with_targets(market(spark, d), BY, [(get_strategy(key), params)])


def market_run(spark, d, key="sma_cross"):
    return run_backtest(market_target(spark, d, key), BY)


def slog(x) -> Column:
    """sign(x) * ln(1 + |x|): keeps the sign, tames the size."""
    x = F.col(x) if isinstance(x, str) else x
    return F.signum(x) * F.log1p(F.abs(x))


def rr(*names: str, n: int = 6) -> str:
    return ", ".join(o.r(x, x, n) for x in names)


BAR_SQL = f"symbol, ts, {', '.join(OHLCV)}"

# --- scans, sinks, normalisation, validation
query("bars_market", o.query(o.MARKET, BAR_SQL, "bars"))(lambda s, d: (src.bars_market(s, d)).select(*BY, "ts", *OHLCV))
query("bars_brand", o.query(o.BRAND, BAR_SQL, "bars"))(lambda s, d: (src.bars_brand(s, d)).select(*BY, "ts", *OHLCV))
query("ticks_to_hourly_bars", o.query(o.HOURS, BAR_SQL, "bars"))(lambda s, d: (src.tick_bars(src.ticks(s, d))).select(*BY, "ts", *OHLCV))


@query("s1_s13_csv_scan_and_sink", o.query(o.MARKET, BAR_SQL, "bars"))
def _(s, d):
    path = scratch(s)
    src.write_csv(src.bars_market(s, d), path)
    return (src.read_csv(s, path)).select(*BY, "ts", *OHLCV)


@query("s2_s3_cache_scan_and_sink", o.query(o.BRAND, BAR_SQL, "bars", "WHERE symbol IN ('Brand#11', 'Brand#23')"))
def _(s, d):
    path = scratch(s)
    src.write_cache(src.bars_brand(s, d), path, "1d")
    return (src.read_cache(s, path, "1d", ["Brand#11", "Brand#23"])).select(*BY, "ts", *OHLCV)


@query("s5_load_ohlcv", o.query(o.MARKET, BAR_SQL + ", 'bundled' AS source", "bars"))
def _(s, d):
    found, source = src.load_bars("auto", src.bars_market(s, d), None, gen.simulate(s, ["MARKET"], "2020-01-01", "2021-01-01"))
    return (found).select(*BY, "ts", *OHLCV).withColumn("source", F.lit(source))


query("s10_panel_load", o.query(o.BRAND + ", n AS (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 120)", BAR_SQL, "bars", "WHERE symbol IN (SELECT symbol FROM n)"))(
    lambda s, d: src.load_panel_bars(src.bars_brand(s, d))[0].select(*BY, "ts", *OHLCV)
)
query("s10_panel_notes", o.query(o.BRAND + ", w AS (SELECT unnest(['BRAND#11', 'BRAND#12', 'NONE']) AS asked)", "coalesce(symbol, asked) AS symbol, count(symbol) AS bars, CASE WHEN count(symbol) < 1400 THEN 'skipped' ELSE 'loaded' END AS note", "w LEFT JOIN bars ON upper(symbol) = asked", "GROUP BY ALL"))(
    lambda s, d: src.load_panel_bars(src.bars_brand(s, d), ["brand#11", "Brand#12 ", "none", "Brand#11"], 1400)[1]
)


@query("s6_dispatch", o.query(o.MARKET, BAR_SQL, "bars"))
def _(s, d):
    path = scratch(s)
    src.write_csv(src.bars_market(s, d), path)
    return src.load_data(s, {"data_source": {"type": "csv", "path": path}}).select(*BY, "ts", *OHLCV)


@query("s9_synthetic_scan", stats.walk_bars("TEST", "2024-01-01", 200))
def _(s, d):
    config = {"data_source": {"type": "synthetic", "path": scratch(s)}}
    src.load_data(s, config, lambda: gen.walk_bars(s, "TEST", "2024-01-01", 200))
    return src.load_data(s, config, lambda: gen.walk_bars(s, "OTHER", "2024-01-01", 5)).select(*BY, "ts", *OHLCV)  # the file is there: it wins


query("s12_json_sink", o.query(o.MARKET, f"strftime(ts, '%Y-%m-%d') AS day, {rr(*OHLCV)}", "bars"))(
    lambda s, d: rounded(lab.to_json(src.bars_market(s, d)).select(F.substring(F.get_json_object("json", "$.ts"), 1, 10).alias("day"), *[F.get_json_object("json", f"$.{x}").cast("double").alias(x) for x in OHLCV]))
)
RAW = "SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, event_id, value, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS part FROM events"


def raw_events(s, d):
    e = src.table(s, d, "events")
    return e.select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("Timestamp"), "event_id", F.col("value").alias("Adj Close"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("part"))


query("n1_normalise_keep_last", f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY event_id DESC) AS k FROM ({RAW})) SELECT symbol, ts, value AS open, value AS high, value AS low, value AS close, 0.0 AS volume FROM k WHERE k = 1 AND value > 0")(
    lambda s, d: (src.normalise(raw_events(s, d).drop("part"), "event_id")).select(*BY, "ts", *OHLCV)
)
query("n2_normalise_keep_first", f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY event_id) AS k FROM ({RAW}) WHERE part IS NOT NULL) SELECT symbol, ts, value AS open, value AS high, value AS low, part AS close, 1.0 AS volume FROM k WHERE k = 1")(
    lambda s, d: cols(
        src.normalise(raw_events(s, d).select("symbol", "Timestamp", "event_id", F.col("Adj Close").alias("open"), F.col("Adj Close").alias("high"), F.col("Adj Close").alias("low"), F.col("part").alias("close"), F.lit(1.0).alias("volume")), "event_id", "first", drop_null=True),
        *BY, "ts", *OHLCV,
    )
)
NOW = "2024-01-20 10:30:00"
ntz = lambda t: F.lit(t).cast("timestamp_ntz")
query("n3_clamp_window", o.query(o.HOURS, BAR_SQL, "bars", f"WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-18'"))(
    lambda s, d: (src.clamp_window(src.tick_bars(src.ticks(s, d)), ntz("2024-01-02"), ntz("2024-01-18"), ntz(NOW), "1m")).select(*BY, "ts", *OHLCV)
)
query("n4_drop_incomplete", o.query(o.HOURS, BAR_SQL, "bars", f"WHERE ts + INTERVAL 1 HOUR <= TIMESTAMP '{NOW}'"))(lambda s, d: (src.drop_incomplete(src.tick_bars(src.ticks(s, d)), "1h", ntz(NOW))).select(*BY, "ts", *OHLCV))
query("n5_split_suspects", o.query(o.BRAND + f", m AS (SELECT symbol, abs({o.change()}) AS m FROM bars)", "symbol, count(CASE WHEN m > 0.35 THEN 1 END) AS suspects", "m", "GROUP BY symbol"))(lambda s, d: src.split_suspects(src.bars_brand(s, d), BY))
query("s8_vendor_history", f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY event_id DESC) AS k FROM ({RAW})) SELECT symbol, ts, value AS open, value AS high, value AS low, value AS close, 0.0 AS volume FROM k WHERE k = 1 AND value > 0 AND ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-25' AND ts + INTERVAL 1 HOUR <= TIMESTAMP '{NOW}'")(
    lambda s, d: src.vendor_history(raw_events(s, d).drop("part"), "event_id", ntz("2024-01-02"), ntz("2024-01-25"), ntz(NOW), "1h")[0].select(*BY, "ts", *OHLCV)
)
_ALIASES = ["1min", "5Min", "1Hour", "1D", "fortnight"]
query("n6_interval_map", "SELECT CASE o_orderkey % 5 WHEN 0 THEN '1m' WHEN 1 THEN '5m' WHEN 2 THEN '1h' ELSE '1d' END AS interval, count(*) AS n FROM orders GROUP BY 1")(
    lambda s, d: src.table(s, d, "orders").select(src.interval_of(F.array(*map(F.lit, _ALIASES))[(F.col("o_orderkey") % 5).cast("int")]).alias("interval")).groupBy("interval").agg(F.count("*").alias("n"))
)
PLANTED = {"close": ("bar_idx % 50 = 0", "NULL", "close"), "low": ("bar_idx % 70 = 1", "-1.0", "low"), "high": ("bar_idx % 90 = 3", "low - 1", "high"), "volume": ("bar_idx % 30 = 2", "0.0", "volume")}
_bad = {k: f"CASE WHEN {x} THEN {y} ELSE {z} END" for k, (x, y, z) in PLANTED.items()}
query(
    "v1_validate",
    o.query(
        f"{o.BRAND}, x AS (SELECT open, {', '.join(f'{v} AS {k}' for k, v in _bad.items())} FROM bars), w AS (SELECT * FROM x WHERE close IS NOT NULL)",
        "(SELECT count(*) FROM x) AS n_rows, (SELECT count(*) FROM x WHERE close IS NULL) AS n_missing, count(CASE WHEN least(open, high, low, close) < 0 THEN 1 END) AS n_negative, count(CASE WHEN volume = 0 THEN 1 END) AS n_zero_volume, "
        "count(CASE WHEN high < low OR open > high OR close > high OR open < low OR close < low THEN 1 END) AS n_inconsistent, count(CASE WHEN volume = 0 THEN 1 END) * 2 > count(*) AS volume_warning, FALSE AS valid",
        "w",
    ),
)(lambda s, d: src.validate(brand(s, d).withColumns({k: F.expr(v) for k, v in _bad.items()})))
query("v2_latest_n", o.query(o.BRAND + ", k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars)", BAR_SQL, "k", "WHERE k <= 100"))(lambda s, d: (src.latest(src.bars_brand(s, d), BY)).select(*BY, "ts", *OHLCV))

# --- generators: draws are the md5 of a key, in SQL too; the simulator's are numpy's
query("g1_simulate_ohlcv")(lambda s, d: gen.simulate(s, ["AAPL", "MSFT", "SPY"], "2018-01-01", "2022-12-31"))
query("g2_walk_bars", stats.walk_bars("TEST", "2024-01-01", 1440))(lambda s, d: gen.walk_bars(s, "TEST", "2024-01-01", 1440))
_tick = stats.normal("'0'", "CAST(id AS VARCHAR)", "'step'"), stats.normal("'0'", "CAST(id AS VARCHAR)", "'noise'"), o.draw("'0', CAST(id AS VARCHAR), 'volume'")
query("g3_ticks", f"WITH p AS (SELECT id, 100 * exp(sum(0.0005 * {_tick[0]}) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS path FROM range(600) x(id)) SELECT TIMESTAMP '2024-01-01' + to_seconds(id) AS ts, 'TEST' AS symbol, round(path * (1 + 0.0025 * {_tick[1]}), 4) AS price, CAST(floor(1 + 99 * {_tick[2]}) AS INT) AS volume FROM p")(
    lambda s, d: gen.walk_ticks(s, "TEST", "2024-01-01", 10)
)
query("g4_series", f"SELECT id, round(100 * exp(0.03 * id / 999.0 + 0.2 * sum({stats.normal(chr(39) + '0' + chr(39), 'CAST(id AS VARCHAR)')} * sqrt(1 / 1000.0)) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) + 0.0 AS price FROM range(1000) x(id)")(
    lambda s, d: rounded(gen.walk_series(s, 1000, 100.0, 0.05, 0.2))
)
_SCENES = {"crash": (0.1, -0.01), "volatile": (0.06, 0.0001), "trending": (0.02, 0.0005), "normal": (0.02, 0.0001)}
query("g5_scenarios", " UNION ALL ".join(f"SELECT *, '{k}' AS scenario FROM ({stats.walk_bars('TEST', '2024-01-01', 500, v, t)})" for k, (v, t) in _SCENES.items()))(
    lambda s, d: functools.reduce(DataFrame.unionByName, [gen.scenario(s, k, "TEST", "2024-01-01", 500) for k in _SCENES])
)

# --- scalar functions
query(
    "f_scalars",
    o.query(
        o.MARKET,
        f"ts, {o.r(f'coalesce({o.change()}, 0)', 'ret')}, {o.r(o.change(20), 'roc_20')}, {o.r(f'CASE WHEN ({o.change()}) IS NOT NULL THEN greatest(-0.01, least(0.01, {o.change()})) END', 'clipped')}, {o.r(o.sign(o.change()), 'direction')}, "
        f"{o.r('open / nullif(close - open, 0)', 'guarded')}, {o.r('ln(high / low)', 'log_range')}, close * volume AS dollar_volume, date_trunc('week', ts) AS week, {o.r('greatest(0, least(1, (close - 500) / (1500 - 500.0))) * 100', 'ramped', 4)}, "
        "CAST(concat('0x', substr(sha256(upper(symbol)), 1, 8)) AS BIGINT) AS seed, strftime(ts, '%Y-%m-%d') AS day",
        "bars",
    ),
)(
    lambda s, d: rounded(
        (b := market(s, d)).select(
            "ts", c.returns(BY).alias("ret"), c.change(20, BY).alias("roc_20"), c.clip(c.change(1, BY), -0.01, 0.01).alias("clipped"), F.signum(c.change(1, BY)).alias("direction"), c.ratio(F.col("open"), F.col("close") - F.col("open")).alias("guarded"),
            F.log(F.col("high") / F.col("low")).alias("log_range"), c.truncated(F.col("ts"), "W").cast("timestamp_ntz").alias("week"), F.round(c.ramp(F.col("close"), 1500, 500), 4).alias("ramped"), c.symbol_seed(F.col("symbol")).alias("seed"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("close") * F.col("volume")).alias("dollar_volume"),
        )
    ).drop("dollar_volume").join(market(s, d).select("ts", (F.col("close") * F.col("volume")).alias("dollar_volume")), "ts")
)
query("f9_f10_slices", o.query(o.BRAND, BAR_SQL, "bars", "WHERE symbol IN ('Brand#12', 'Brand#13') AND ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'"))(
    lambda s, d: (panel.select_symbols(src.bars_brand(s, d), ["Brand#12", "Brand#13"]).filter(F.col("ts").between(ntz("1996-01-01"), ntz("1996-12-31")))).select(*BY, "ts", *OHLCV)
)
_p = "least(0.999, greatest(0.001, low / (high + 1)))"
query("f13_normal", o.query(f"{o.MARKET}, x AS (SELECT ts, coalesce({o.change()}, 0) AS ret, {_p} AS p FROM bars), {stats.norm_ppf_steps('x', 'p', 'z')}", f"ts, {o.r(stats.norm_cdf('ret'), 'cdf')}, {o.r('ppf', 'ppf')}", "z"))(
    lambda s, d: rounded(market(s, d).select("ts", c.norm_cdf_column(c.returns(BY)).alias("cdf"), c.norm_ppf_column(F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("low") / (F.col("high") + 1)))).alias("ppf")))
)
query("f17_params", "SELECT count(*) AS n, round(sum(10.0) + sum(o_custkey), 2) AS total FROM orders")(
    lambda s, d: src.table(s, d, "orders").select(c.parse_params(F.concat(F.lit("fast=10,slow="), F.col("o_custkey"))).alias("p")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("p")["fast"]) + F.sum(F.col("p")["slow"]), 2).alias("total"))
)

# --- indicators
def indicator(name, wanted, sql_steps, shown: dict[str, str], table=brand, ctes=o.BRAND):
    names = list(shown)
    query(name, o.query(ctes + (", " + sql_steps if sql_steps else ""), "symbol, ts, " + ", ".join(o.r(x, n) for n, x in shown.items()), "ind" if sql_steps else "bars"))(
        lambda s, d: cols(ind.with_indicators(table(s, d), BY, wanted), *BY, "ts", *names)
    )


indicator("i1_sma", [("sma", 20), ("sma", 50)], "", {"sma_20": o.roll("avg", "close", 20), "sma_50": o.roll("avg", "close", 50)})
indicator("i2_ema", [("ema", 12), ("ema", 26)], "", {"ema_12": o.ema("close", 2 / 13, 12), "ema_26": o.ema("close", 2 / 27, 26)}, market, o.MARKET)
indicator("i3_rsi", [("rsi", 14)], o.rsi_steps(14), {"rsi_14": "r"}, market, o.MARKET)
_macd = f"m0 AS (SELECT *, {o.ema('close', 2 / 13, 12)} - {o.ema('close', 2 / 27, 26)} AS line FROM bars), ind AS (SELECT *, {o.ema('line', 0.2, 9)} AS sig FROM m0)"
indicator("i4_macd", [("macd", 12, 26, 9)], _macd, {"macd_12_26_9_line": "line", "macd_12_26_9_signal": "sig", "macd_12_26_9_hist": "line - sig"}, market, o.MARKET)
_mid, _sd = o.roll("avg", "close", 20), o.roll("stddev_pop", "close", 20)
indicator("i5_bollinger", [("boll", 20, 2.0)], "", {"boll_20_2p0_low": f"({_mid}) - 2 * ({_sd})", "boll_20_2p0_mid": _mid, "boll_20_2p0_high": f"({_mid}) + 2 * ({_sd})"})
indicator("i6_atr", [("atr", 14)], f"{o.RANGE_STEP}, ind AS (SELECT *, {o.ema('tr', 1 / 14, 14)} AS a FROM ranges)", {"atr_14": "a"}, market, o.MARKET)
_fr = o.over(frame="ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING")
indicator("i7_donchian", [("donchian", 20)], "", {"donchian_20_low": f"CASE WHEN count(low) {_fr} = 20 THEN min(low) {_fr} END", "donchian_20_high": f"CASE WHEN count(high) {_fr} = 20 THEN max(high) {_fr} END"})
indicator("i8_zscore", [("zscore", 20)], "", {"zscore_20": f"(close - ({_mid})) / nullif(({_sd}), 0)"})
indicator("i9_roc", [("roc", 20)], "", {"roc_20": o.change(20)})
indicator("i10_realised_vol", [("rv", 20)], f"ch AS (SELECT *, {o.change()} AS ch FROM bars), ind AS (SELECT *, {o.roll('stddev_pop', 'ch', 20)} * sqrt(252.0) AS v FROM ch)", {"rv_20": "v"})
_prev = o.lag("close")
FEATURES = (
    f"f0 AS (SELECT *, coalesce(close - {_prev}, 0) AS mv, CASE WHEN {_prev} IS NOT NULL THEN greatest(high - low, abs(high - {_prev}), abs(low - {_prev})) END AS rg FROM bars), "
    f"f1 AS (SELECT *, {o.roll('avg', 'greatest(mv, 0)', 14)} AS g, {o.roll('avg', 'greatest(-mv, 0)', 14)} AS l, {o.ema_adjusted('close', 2 / 13)} AS ema_12, {o.ema_adjusted('close', 2 / 27)} AS ema_26 FROM f0), f2 AS (SELECT *, ema_12 - ema_26 AS macd FROM f1), "
    f"ft AS (SELECT *, {o.ema_adjusted('macd', 0.2)} AS macd_signal, CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100.0 END AS rsi, {o.roll('avg', 'rg', 14)} AS atr, {o.roll('avg', 'volume', 20)} AS volume_sma, "
    f"{o.roll('avg', 'close', 20)} AS sma_20, {o.roll('avg', 'close', 50)} AS sma_50, {o.roll('avg', 'close', 200)} AS sma_200, {o.roll('stddev_samp', 'close', 20)} AS sd, {o.change()} AS price_change, {o.change(5)} AS price_change_5, {o.change(20)} AS price_change_20 FROM f2)"
)
query("i11_v1_feature_set", o.query(f"{o.MARKET}, {FEATURES}", f"ts, {rr('sma_20', 'sma_50', 'sma_200', 'ema_12', 'ema_26', 'macd', 'macd_signal')}, {o.r('macd - macd_signal', 'macd_hist')}, {rr('rsi')}, {o.r('sma_20 - 2 * sd', 'bb_lower')}, {o.r('sma_20 + 2 * sd', 'bb_upper')}, {rr('atr', 'volume_sma')}, {o.r('volume / volume_sma', 'volume_ratio')}, {rr('price_change', 'price_change_5', 'price_change_20')}", "ft"))(
    lambda s, d: cols(ind.feature_set(market(s, d), BY), "ts", "sma_20", "sma_50", "sma_200", "ema_12", "ema_26", "macd", "macd_signal", "macd_hist", "rsi", "bb_lower", "bb_upper", "atr", "volume_sma", "volume_ratio", "price_change", "price_change_5", "price_change_20")
)
SIGNALS = (
    f"s0 AS (SELECT *, close - {o.lag('close')} AS mv FROM bars), s1 AS (SELECT *, avg(CASE WHEN mv IS NOT NULL THEN greatest(mv, 0) END) {o.last(14)} AS g, avg(CASE WHEN mv IS NOT NULL THEN greatest(-mv, 0) END) {o.last(14)} AS l, count(mv) {o.last(14)} AS n FROM s0), "
    f"ind AS (SELECT *, coalesce({o.roll('avg', 'close', 20)}, close) AS sma_20, coalesce({o.roll('avg', 'close', 50)}, close) AS sma_50, CASE WHEN n = 14 THEN 100 - 100 / (1 + g / (l + 1e-10)) ELSE 50.0 END AS rsi FROM s1), "
    "sg AS (SELECT *, CASE WHEN close > sma_20 AND rsi < 70 THEN 'buy' WHEN close < sma_20 OR rsi > 80 THEN 'sell' ELSE 'hold' END AS action FROM ind), "
    "od AS (SELECT *, CASE WHEN action = 'hold' THEN 0 ELSE greatest(1, least(CAST(floor(10000 / close) AS INT), 100)) END AS quantity FROM sg)"
)
query("i12_signal_set", o.query(f"{o.MARKET}, {SIGNALS}", f"ts, {rr('sma_20', 'sma_50', 'rsi')}", "ind"))(lambda s, d: cols(ind.signal_set(market(s, d), BY), "ts", "sma_20", "sma_50", "rsi"))
query("i12_signal_bands_and_averages", o.query(f"{o.MARKET}, m0 AS (SELECT *, {o.ema('close', 2 / 13, 12)} - {o.ema('close', 2 / 27, 26)} AS macd FROM bars)", f"ts, {o.r(f'({_mid}) - 2 * ({_sd})', 'bb_lower')}, {o.r(f'({_mid}) + 2 * ({_sd})', 'bb_upper')}, {o.r('macd', 'macd')}, {o.r(o.ema('macd', 0.2, 9), 'macd_signal')}", "m0"))(
    lambda s, d: cols(ind.signal_averages(ind.signal_set(market(s, d), BY), BY), "ts", "bb_lower", "bb_upper", "macd", "macd_signal")
)
_bf = lambda x: f"coalesce(first_value({x} IGNORE NULLS) {o.over(frame='ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING')}, 0)"
query("i13_i14_model_features", o.query(f"{o.MARKET}, {FEATURES}", f"ts, {o.r(_bf('sma_20'), 'sma_20')}, {o.r(_bf('sma_50'), 'sma_50')}, {o.r(_bf('rsi'), 'rsi')}, {o.r(_bf('sma_20 - 2 * sd'), 'bb_lower')}, {o.r(_bf('sma_20 + 2 * sd'), 'bb_upper')}, {o.r(_bf('macd'), 'macd')}", "ft"))(
    lambda s, d: cols(ind.model_features(market(s, d), BY), "ts", "sma_20", "sma_50", "rsi", "bb_lower", "bb_upper", "macd")
)

# --- windows
query("w1_w4_w5_w7_windows", o.query(o.MARKET + f", x AS (SELECT *, coalesce({o.change()}, 0) AS ret FROM bars)", f"ts, {o.r('coalesce(lag(ret, 2) OVER (ORDER BY ts), 0)', 'lagged')}, {o.r('sum(ret) ' + o.far(), 'summed')}, {o.r('max(close) ' + o.far(), 'peak')}, {o.r('close / max(close) ' + o.far() + ' - 1', 'drawdown')}", "x"))(
    lambda s, d: rounded((b := market(s, d).withColumn("ret", c.returns(BY))).select("ts", F.lag("ret", 2, 0.0).over(c.over(BY)).alias("lagged"), F.sum("ret").over(c.so_far(BY)).alias("summed"), F.max("close").over(c.so_far(BY)).alias("peak"), (c.ratio(F.col("close"), F.max("close").over(c.so_far(BY))) - 1).alias("drawdown")))
)
query("w2_w10_fills", o.query(o.PANEL, f"symbol, ts, {o.hold('close', 'symbol', 'bar_idx')} AS held, first_value(close IGNORE NULLS) {o.over('symbol', 'bar_idx', 'ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING')} AS next_close", "panel"))(
    lambda s, d: the_panel(s, d).select("symbol", "ts", c.hold(F.col("close"), BY, "bar_idx").alias("held"), c.backfill("close", BY, "bar_idx").alias("next_close"))
)
query("w3_rebalance_hold", o.query(o.PANEL + f", x AS (SELECT *, coalesce(last_value(CASE WHEN bar_idx % 5 = 0 THEN CASE WHEN listed THEN 1.0 ELSE 0.0 END END IGNORE NULLS) {o.far('symbol', 'bar_idx')}, 0.0) AS weight FROM panel)", "symbol, ts, weight", "x"))(
    lambda s, d: rebalance_hold(the_panel(s, d).withColumn("weight", F.col("listed").cast("double")), [], 5).select("symbol", "ts", "weight")
)
UNDER = f"dd AS (SELECT *, equity / max(equity) {o.far()} - 1 AS dd FROM bt), isl AS (SELECT *, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) {o.far()} AS isl FROM dd), runs AS (SELECT symbol, isl, count(CASE WHEN dd < 0 THEN 1 END) AS n FROM isl GROUP BY symbol, isl)"
TG = o.targets()
SMA_BT = f"{o.MARKET}, {TG['sma_cross']}, {o.engine()}"
query("w6_longest_under_water", o.query(f"{SMA_BT}, {UNDER}", "symbol, max(n) AS under_water", "runs", "GROUP BY symbol"))(lambda s, d: metrics.under_water(metrics.with_drawdown(market_run(s, d), BY), BY))
query("w8_rank_pct", o.query(o.PANEL, f"symbol, ts, {o.r(o.rank_pct('round(close, -2)'), 'pct')}", "panel"))(lambda s, d: rounded(the_panel(s, d).withColumn("x", F.round("close", -2)).select("symbol", "ts", c.rank_pct("x", ["ts"]).alias("pct"))))
query("w9_first_last_valid", o.query(o.PANEL, "symbol, min(CASE WHEN listed THEN ts END) AS first_valid, max(CASE WHEN listed THEN ts END) AS last_valid", "panel", "GROUP BY symbol"))(
    lambda s, d: the_panel(s, d).groupBy("symbol").agg(F.min(F.when(F.col("listed"), F.col("ts"))).alias("first_valid"), F.max(F.when(F.col("listed"), F.col("ts"))).alias("last_valid"))
)

# --- rules, grids, engine, metrics
for _k in REGISTRY:
    query(f"strategy_{_k}", o.query(f"{o.MARKET}, {TG[_k]}", f"ts, {o.r('target', 'target')}", "tg"))(lambda s, d, k=_k: cols(market_target(s, d, k), "ts", "target"))
_SIZES = {k: len(x.grid()) for k, x in REGISTRY.items()}
query("p1_p2_grids", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {n})" for k, n in {"buy_and_hold": 1, "sma_cross": 19, "ema_cross": 24, "macd_trend": 36, "rsi_reversion": 48, "bollinger_reversion": 16, "donchian_breakout": 5, "momentum": 6, "vol_target_momentum": 36, "channel_trend": 48, "coin_flip": 16}.items()) + ") t(strategy, n)")(
    lambda s, d: s.createDataFrame(list(_SIZES.items()), "strategy string, n int")
)
ENGINE = ("ret", "position", "gross", "traded", "cost", "net")
query("b1_b6_backtest", o.query(SMA_BT, f"ts, {rr(*ENGINE)}, {o.r(stats.slog('equity'), 'equity')}, {o.r(stats.slog('benchmark'), 'benchmark')}", "bt"))(lambda s, d: rounded(market_run(s, d).select("ts", *ENGINE, slog("equity").alias("equity"), slog("benchmark").alias("benchmark"))))
query("b7_cost_drag", o.query(SMA_BT, f"symbol, {o.r('sum(cost) / (count(*) / 252.0)', 'cost_drag_ann')}, {o.r('avg(gross) / stddev_samp(gross) * sqrt(252.0)', 'gross_sharpe')}", "bt", "GROUP BY symbol"))(
    lambda s, d: rounded(metrics.cost_drag(r := market_run(s, d), BY).join(metrics.sharpes(r, BY, c="gross").withColumnRenamed("sharpe", "gross_sharpe"), BY))
)
METRICS = (
    f"{UNDER}, tn AS (SELECT *, abs(position - coalesce(lag(position) OVER (PARTITION BY symbol ORDER BY ts), 0)) AS turn FROM dd), st AS (SELECT symbol, count(net) AS n, avg(net) AS m, stddev_samp(net) AS sd, first(equity ORDER BY ts) AS e0, last(equity ORDER BY ts) AS e1, sqrt(avg(CASE WHEN net < 0 THEN net * net END)) AS dn, min(dd) AS mdd, "
    "avg(CAST(net > 0 AS DOUBLE)) AS hit, skewness(net) AS sk, kurtosis(net) AS ku, quantile_cont(net, 0.05) AS v5, max(net) AS best, min(net) AS worst, avg(abs(position)) AS ex, avg(CAST(position > 0 AS DOUBLE)) AS ls, avg(CAST(position < 0 AS DOUBLE)) AS ss, sum(turn) AS tt, count(CASE WHEN turn > 1e-9 THEN 1 END) AS nt FROM tn GROUP BY symbol), "
    "cv AS (SELECT bt.symbol, avg(net) AS cv FROM bt JOIN st ON bt.symbol = st.symbol WHERE net <= v5 GROUP BY bt.symbol), uw AS (SELECT symbol, max(n) AS uw FROM runs GROUP BY symbol), y AS (SELECT st.*, cv.cv, uw.uw, n / 252.0 AS years FROM st JOIN cv USING (symbol) JOIN uw USING (symbol))"
)
query(
    "m_metrics",
    o.query(
        f"{SMA_BT}, {METRICS}",
        f"symbol, {o.r(stats.slog('(e1 / e0 - 1)'), 'total_return')}, {o.r(stats.slog('(pow(e1 / e0, 1 / years) - 1)'), 'cagr')}, {o.r('sd * sqrt(252.0)', 'ann_vol')}, {o.r('m / sd * sqrt(252.0)', 'sharpe')}, {o.r('m / dn * sqrt(252.0)', 'sortino')}, {o.r('mdd', 'max_drawdown')}, {o.r(stats.slog('((pow(e1 / e0, 1 / years) - 1) / abs(mdd))'), 'calmar')}, "
        f"{o.r('uw / 252.0', 'time_under_water_yrs')}, {o.r('hit', 'hit_rate')}, {o.r('sk', 'skew')}, {o.r('ku', 'kurtosis')}, {o.r('v5', 'var_95')}, {o.r('cv', 'cvar_95')}, {o.r('best', 'best_bar')}, {o.r('worst', 'worst_bar')}, {o.r('CAST(n AS DOUBLE)', 'n_bars')}, {o.r('years', 'years')}, {o.r('ex', 'exposure')}, {o.r('ls', 'long_share')}, {o.r('ss', 'short_share')}, {o.r('tt / years', 'turnover_ann')}, {o.r('CAST(nt AS DOUBLE)', 'n_trades')}",
        "y",
    ),
)(lambda s, d: rounded(metrics.compute_metrics(market_run(s, d), BY).withColumns({k: slog(k) for k in ("total_return", "cagr", "calmar")})))
query("m0_periods_per_year", o.query(o.BRAND + f", x AS (SELECT symbol, epoch(ts) - epoch({o.lag('ts')}) AS st FROM bars)", "symbol, CAST(greatest(1, round_even(252 / greatest(median(st) / 86400 / 1.4, 1.0), 0)) AS INT) AS ppy", "x", "GROUP BY symbol"))(lambda s, d: metrics.periods_per_year(src.bars_brand(s, d), BY))



# --- from SQL
@query("sql_backtest", SQL["b1_b6_backtest"])
def _(s, d):
    sql.register(s, src.bars_market(s, d), "market_")
    run = s.sql("SELECT * FROM market_backtest(TABLE(SELECT symbol, ts, close, target FROM market_target_sma_cross) PARTITION BY symbol ORDER BY ts)")
    return rounded(run.select("ts", *ENGINE, slog("equity").alias("equity"), slog("benchmark").alias("benchmark")))


@query("sql_metrics", o.query(f"{SMA_BT}, {METRICS}", f"symbol, CAST(n AS BIGINT) AS n_bars, {o.r(stats.slog('(e1 / e0 - 1)'), 'total_return')}, {o.r('m / sd * sqrt(252.0)', 'sharpe')}, {o.r('mdd', 'max_drawdown')}, {o.r('hit', 'hit_rate')}", "y"))
def _(s, d):
    sql.register(s, src.bars_market(s, d), "market_")
    run = "SELECT symbol, ts, net, equity FROM market_backtest(TABLE(SELECT symbol, ts, close, target FROM market_target_sma_cross) PARTITION BY symbol ORDER BY ts)"
    return rounded(s.sql(f"SELECT * FROM market_metrics(TABLE({run}) PARTITION BY symbol ORDER BY ts)").withColumn("total_return", slog("total_return")))


# --- keys too long for one task, joins along time
query("b6_blocked_backtest", o.query(SMA_BT, f"ts, {rr(*ENGINE)}, {o.r(stats.slog('equity'), 'equity')}, {o.r(stats.slog('benchmark'), 'benchmark')}", "bt"))(
    lambda s, d: rounded(run_backtest(market_target(s, d), BY, block="year").select("ts", *ENGINE, slog("equity").alias("equity"), slog("benchmark").alias("benchmark")))
)
query("w_blocked_scans", o.query(
    "t AS (SELECT event_type AS symbol, event_id, ts, value + 1 AS price, CASE WHEN event_id % 3 > 0 THEN value END AS part FROM events)",
    f"symbol, event_id, {o.r('sum(price) ' + o.far(), 'summed')}, {o.r('sum(ln(price)) ' + o.far(), 'log_product')}, {o.r('max(price) ' + o.far(), 'top')}, {o.r('min(price) ' + o.far(), 'low')}, count(part) {o.far()} AS n_parts, "
    f"{o.r('last_value(part IGNORE NULLS) ' + o.far(), 'held')}, {o.r(o.lag('price'), 'before')}, {o.r(o.lag('price', 7), 'before_7')}", "t",
))(
    lambda s, d: cols(scanned(
        src.ticks(s, d).join(src.table(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("part")), "event_id"), BY,
        {"summed": ("sum", "price"), "log_product": ("sum", F.log("price")), "top": ("max", "price"), "low": ("min", "price"), "n_parts": ("count", "part"), "held": ("last", "part"), "before": ("lag", "price", 1), "before_7": ("lag", "price", 7)}, block="day", ties="event_id",
    ), "symbol", "event_id", "summed", "log_product", "top", "low", "n_parts", "held", "before", "before_7")
)
query("i2_ema_of_ticks", o.query("t AS (SELECT event_type AS symbol, event_id, ts, CASE WHEN event_id % 5 > 0 THEN value + 1 END AS price FROM events WHERE event_id % 5 > 0)", f"symbol, event_id, {o.r(o.ema('price', 2 / 13, 12), 'ema_12')}, {o.r(o.ema('price', 2 / 201, 200), 'ema_200')}", "t"))(
    lambda s, d: cols(averaged(src.ticks(s, d).filter("event_id % 5 > 0"), BY, [("ema_12", "price", 2 / 13, False, 12), ("ema_200", "price", 2 / 201, False, 200)], block="day"), "symbol", "event_id", "ema_12", "ema_200")
)
query("m_exact_quantiles", o.query(f"{o.BRAND}, x AS (SELECT symbol, {o.change()} AS ch FROM bars), q AS (SELECT unnest([0.0, 0.05, 0.5, 0.95]) AS q)", "symbol, q, round(CASE q WHEN 0.0 THEN min(ch) WHEN 0.05 THEN quantile_cont(ch, 0.05) WHEN 0.5 THEN quantile_cont(ch, 0.5) ELSE quantile_cont(ch, 0.95) END, 6) + 0.0 AS value, count(ch) AS n", "x, q", "GROUP BY symbol, q"))(
    lambda s, d: cols(exact_quantiles(src.bars_brand(s, d).withColumn("ch", c.change(1, BY)), BY, "ch", [0.0, 0.05, 0.5, 0.95]), "symbol", "q", "value", "n")
)
query("m_blocked_metrics", SQL["m_metrics"])(lambda s, d: rounded(metrics.compute_metrics(market_run(s, d), BY, block="year").withColumns({k: slog(k) for k in ("total_return", "cagr", "calmar")})))
query("asof_last_tick", o.query(o.HOURS, f"b.symbol, b.ts, {o.r('b.close', 'close')}, q.ts AS tick_ts, {o.r('q.price', 'price')}", "bars b ASOF LEFT JOIN (SELECT event_type AS symbol, ts, value + 1 AS price FROM events) q ON b.symbol = q.symbol AND b.ts >= q.ts"))(
    lambda s, d: cols(joins.asof_join(src.tick_bars(src.ticks(s, d)).select("symbol", "ts", "close"), src.ticks(s, d), BY, ties="event_id", block="day").withColumnRenamed("ts_right", "tick_ts"), "symbol", "ts", "close", "tick_ts", "price")
)
query("interval_open_orders", "WITH n AS (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1), iv AS (SELECT o_custkey, o_orderkey, o_orderdate, shipped FROM orders JOIN n ON l_orderkey = o_orderkey) SELECT p.o_orderkey AS placed, iv.o_orderkey AS still_open FROM orders p JOIN iv ON p.o_custkey = iv.o_custkey AND iv.o_orderdate <= p.o_orderdate AND p.o_orderdate < iv.shipped WHERE p.o_orderkey <> iv.o_orderkey")(
    lambda s, d: joins.interval_join(
        src.table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("placed"), "o_orderdate"),
        src.table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("still_open"), F.col("o_orderdate").alias("opened")).join(src.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("still_open")).agg(F.max("l_shipdate").alias("shipped")), "still_open"),
        ["o_custkey"], "o_orderdate", "opened", "shipped",
    ).filter("placed <> still_open").select("placed", "still_open")
)
_FIXED = "CASE WHEN symbol = 'Brand#11' AND bar_idx % 50 = 0 THEN close * 2 ELSE close END"


@query("s3_cache_corrections", o.query(o.BRAND, f"symbol, ts, {o.r(_FIXED, 'close')}", "bars", "WHERE symbol IN ('Brand#11', 'Brand#12')"))
def _(s, d):
    """Two symbols cached one after the other, some bars held back; they come late, with corrections."""
    path, b = scratch(s), brand(s, d)
    late = F.col("bar_idx") % 40 == 7
    for x in ("Brand#11", "Brand#12"):
        src.write_cache(b.filter((F.col("symbol") == x) & ~late), path, "1d")
    fixes = b.filter((F.col("symbol") == "Brand#11") & (F.col("bar_idx") % 50 == 0)).withColumn("close", F.col("close") * 2)
    rest = b.filter(F.col("symbol").isin("Brand#11", "Brand#12") & late).join(fixes.select("symbol", "ts"), ["symbol", "ts"], "left_anti")
    src.upsert_cache(fixes.unionByName(rest), path, "1d", scratch(s))
    return cols(src.read_cache(s, path, "1d", ["Brand#11", "Brand#12"]), "symbol", "ts", "close")

# --- panels, cross-sections, portfolios
query("a1_a2_panel", o.query(o.PANEL, f"symbol, ts, bar_idx, {', '.join(OHLCV)}", "panel"))(lambda s, d: the_panel(s, d).withColumn("bar_idx", F.col("bar_idx").cast("bigint")).select("symbol", "ts", "bar_idx", *OHLCV))
query("a3_a4_tradable_returns", o.query(o.PANEL, f"symbol, ts, listed, tradable, {rr('ret')}, CASE WHEN listed THEN close * volume END AS dollar_volume", "panel"))(
    lambda s, d: the_panel(s, d).select("symbol", "ts", "listed", "tradable", (F.round("ret", 6) + 0.0).alias("ret"), (F.col("close") * F.col("volume")).alias("dollar_volume"))
)
_GONE, _LATE = "l < last - 5", "f > 5"
query(
    "a5_survivorship",
    o.query(
        o.PANEL + ", e AS (SELECT max(bar_idx) AS last FROM panel), x AS (SELECT symbol, min(CASE WHEN listed THEN bar_idx END) AS f, max(CASE WHEN listed THEN bar_idx END) AS l FROM panel GROUP BY symbol)",
        f"count(*) AS n_symbols, count(CASE WHEN {_GONE} THEN 1 END) AS n_delisted, count(CASE WHEN {_LATE} THEN 1 END) AS n_late, {o.r(f'1 - count(CASE WHEN {_GONE} THEN 1 END) / CAST(count(*) AS DOUBLE)', 'survival_rate')}, "
        f"coalesce(string_agg(CASE WHEN {_GONE} THEN symbol END, ',' ORDER BY symbol), '') AS delisted, coalesce(string_agg(CASE WHEN {_LATE} THEN symbol END, ',' ORDER BY symbol), '') AS late, "
        f"count(CASE WHEN {_GONE} THEN 1 END) = 0 AND (last + 1) / 252.0 >= 3 AND count(*) >= 5 AS biased",
        "x, e", "GROUP BY last",
    ),
)(lambda s, d: rounded(panel.survivorship(the_panel(s, d)).withColumns({k: F.concat_ws(",", k) for k in ("delisted", "late")})))
query("a6_panel_slice", o.query(o.PANEL, f"symbol, ts, bar_idx - 100 AS bar_idx, {rr('close')}", "panel", "WHERE bar_idx >= 100 AND bar_idx < 200"))(lambda s, d: cols(panel.slice_bars(the_panel(s, d), 100, 200).withColumn("bar_idx", F.col("bar_idx").cast("bigint")), "symbol", "ts", "bar_idx", "close"))
XS = o.xs_weights()
for _k in XS_REGISTRY:
    query(f"x1_{_k}", o.query(f"{o.PANEL}, {XS[_k]}", f"symbol, ts, {rr('weight')}", "wt"))(lambda s, d, k=_k: cols(with_weights(the_panel(s, d), k), "symbol", "ts", "weight"))
query("x2_grids", "SELECT * FROM (VALUES ('equal_weight', 3), ('xs_momentum', 81), ('xs_reversal', 45), ('low_volatility', 27), ('xs_value_proxy', 27), ('xs_random', 12)) t(strategy, n)")(lambda s, d: s.createDataFrame([(k, len(x.grid())) for k, x in XS_REGISTRY.items()], "strategy string, n int"))


def book(s, d, rebalance=None, key="xs_reversal"):
    return portfolio.run_portfolio(with_weights(the_panel(s, d), key), rebalance=rebalance)


BOOK = f"{o.PANEL}, {XS['xs_reversal']}, {o.portfolio()}"
MONTH = "date_trunc('month', ts) IS DISTINCT FROM lag(date_trunc('month', ts)) OVER (PARTITION BY symbol ORDER BY bar_idx)"
MONTHLY = f"{o.PANEL}, {XS['xs_reversal']}, {o.portfolio(MONTH)}"
query("q1_normalise_weights", o.query(BOOK, f"symbol, ts, {rr('target')}", "n2"))(lambda s, d: cols(portfolio.normalise_weights(with_weights(the_panel(s, d), "xs_reversal"), []), "symbol", "ts", "target"))
query("q2_held", o.query(BOOK, f"symbol, ts, {rr('held', 'traded')}", "p2"))(lambda s, d: cols(book(s, d), "symbol", "ts", "held", "traded"))
query("q3_rebalance_carry", o.query(MONTHLY, f"symbol, ts, {rr('held')}", "k5"))(lambda s, d: cols(book(s, d, "M"), "symbol", "ts", "held"))
DATES = ("gross", "traded", "cost", "bench", "exposure", "net_exposure", "net")
query("q4_q6_portfolio_returns", o.query(BOOK, f"ts, {rr(*DATES)}, positions, {o.r(stats.slog('equity'), 'equity')}", "pd"))(lambda s, d: cols(portfolio.portfolio_returns(book(s, d)).withColumn("equity", slog("equity")), "ts", *DATES, "positions", "equity"))
query("q7_rebalance_schedule", o.query(o.PANEL, f"symbol, ts, {MONTH} AS monthly, date_trunc('week', ts) IS DISTINCT FROM lag(date_trunc('week', ts)) OVER (PARTITION BY symbol ORDER BY bar_idx) AS weekly, bar_idx % 5 = 0 AS fifth", "panel"))(
    lambda s, d: the_panel(s, d).select("symbol", "ts", portfolio.rebalance_rows("M", []).alias("monthly"), portfolio.rebalance_rows("W", []).alias("weekly"), portfolio.rebalance_rows("5", []).alias("fifth"))
)
query("q8_portfolio_metrics", o.query(BOOK, f"{o.r('avg(exposure)', 'gross_exposure')}, {o.r('avg(net_exposure)', 'net_exposure')}, {o.r('max(exposure)', 'max_gross_exposure')}, {o.r('avg(positions)', 'avg_positions')}, {o.r('CAST(max(positions) AS DOUBLE)', 'max_positions')}, {o.r('avg(hhi)', 'concentration_hhi')}, {o.r('sum(traded) / (count(*) / 252.0)', 'turnover_ann')}, {o.r('CAST(count(CASE WHEN traded > 1e-9 THEN 1 END) AS DOUBLE)', 'n_trades')}, {o.r('avg(net) / stddev_samp(net) * sqrt(252.0)', 'sharpe')}", "pd"))(
    lambda s, d: cols(portfolio.portfolio_metrics(portfolio.portfolio_returns(book(s, d))), "gross_exposure", "net_exposure", "max_gross_exposure", "avg_positions", "max_positions", "concentration_hhi", "turnover_ann", "n_trades", "sharpe")
)
query("q9_contributions", o.query(BOOK, f"symbol, {o.r('sum(held * ar)', 'contribution')}", "p2", "GROUP BY symbol"))(lambda s, d: rounded(portfolio.contributions(book(s, d))))

# --- attribution
query("r1_style_factors", o.query(f"{o.PANEL}, {stats.style_books()}", f"factor, ts, bar_idx, {rr('net')}", "fx"))(lambda s, d: cols(attribution.style_factors(the_panel(s, d)).withColumn("bar_idx", F.col("bar_idx").cast("bigint")), "factor", "ts", "bar_idx", "net"))
_AT = o.query(f"{o.PANEL}, {stats.style_books()}, {XS['xs_reversal']}, {o.portfolio()}, {stats.attribution('pd')}", f"name, {rr('value')}", "fitted")


@query("r2_factor_attribution", _AT)
def _(s, d):
    found = attribution.factor_attribution(portfolio.portfolio_returns(book(s, d)), attribution.style_factors(the_panel(s, d)))
    rows = [(k, float(found[k])) for k in ("alpha_annual", "alpha_t_stat", "r_squared", "n_obs")]
    rows += [(f"beta_{k}", v) for k, v in found["betas"].items()] + [(f"t_{k}", v) for k, v in found["beta_t_stats"].items()]
    return rounded(s.createDataFrame(rows, "name string, value double"))


_RULES = " UNION ALL ".join(f"SELECT * FROM ({o.query(f'{o.PANEL}, {stats.style_books()}, {XS[k]}, {o.portfolio()}, {stats.attribution(chr(112) + chr(100))}', f'{chr(39)}{k}{chr(39)} AS strategy, name, ' + rr('value'), 'fitted')})" for k in ("xs_momentum", "xs_reversal", "low_volatility"))


@query("r2_attribution_by_rule", _RULES)
def _(s, d):
    """Three rules' books regressed in one plan."""
    p = the_panel(s, d)
    books = functools.reduce(DataFrame.unionByName, [with_weights(p, k).withColumn("strategy", F.lit(k)) for k in ("xs_momentum", "xs_reversal", "low_volatility")])
    found = attribution.attributed(portfolio.portfolio_returns(portfolio.run_portfolio(books, ["strategy"]), ["strategy"]), attribution.style_factors(p), ["strategy"])
    plain = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("double").alias("value")) for k in ("alpha_annual", "alpha_t_stat", "r_squared", "n_obs")])
    named = lambda c, sign: F.transform(F.map_entries(c), lambda e: F.struct(F.concat(F.lit(sign), e["key"]).alias("name"), e["value"].alias("value")))
    rows = found.select("strategy", F.explode(F.concat(plain, named("betas", "beta_"), named("beta_t_stats", "t_"))).alias("x"))
    return rounded(rows.select("strategy", "x.*"))


# --- validation
PARTS = f"pt AS (SELECT symbol, bar_idx, ln(open / {o.lag('close')}) AS gap, ln(greatest(high, open) / open) AS hi, ln(least(low, open) / open) AS lo, ln(close / open) AS body, volume FROM bars), parts AS (SELECT * FROM pt WHERE bar_idx > 0)"
query("t1_decompose", o.query(f"{o.MARKET}, {PARTS}", f"bar_idx, {rr('gap', 'hi', 'lo', 'body', 'volume')}", "parts"))(lambda s, d: cols(validation.decompose(src.bars_market(s, d), BY).withColumn("bar_idx", F.col("bar_idx").cast("bigint")), "bar_idx", "gap", "hi", "lo", "body", "volume"))


def permuted(n: int, block: int | None = None) -> str:
    if block is None:
        u = o.draw("'1', CAST(perm_id AS VARCHAR), CAST(bar_idx AS VARCHAR)")
        dealt = f"pu AS (SELECT parts.*, CAST(perm_id AS INT) AS perm_id, {u} AS u FROM parts, range({n}) x(perm_id)), dealt AS (SELECT * EXCLUDE (bar_idx, u), row_number() OVER (PARTITION BY perm_id, symbol ORDER BY u, bar_idx) AS bar_idx FROM pu)"
    else:
        u = o.draw(f"'1', CAST(perm_id AS VARCHAR), CAST((bar_idx - 1) // {block} AS VARCHAR)")
        dealt = (
            f"mm AS (SELECT symbol, count(*) AS m FROM parts GROUP BY symbol), sl AS (SELECT CAST(perm_id AS INT) AS perm_id, symbol, m, bar_idx FROM mm, range({n}) x(perm_id), LATERAL (SELECT unnest(range(1, m + 1)) AS bar_idx)), "
            f"tk AS (SELECT perm_id, symbol, bar_idx, CAST((CAST(floor({u} * m) AS BIGINT) + (bar_idx - 1) % {block}) % m + 1 AS BIGINT) AS src FROM sl), dealt AS (SELECT p.* EXCLUDE (bar_idx), tk.perm_id, tk.bar_idx FROM tk JOIN parts p ON p.symbol = tk.symbol AND p.bar_idx = tk.src)"
        )
    w = "PARTITION BY perm_id, symbol ORDER BY bar_idx"
    return (
        f"{PARTS}, b1 AS (SELECT * FROM bars WHERE bar_idx = 0), {dealt}, c1 AS (SELECT d.*, b1.close AS anchor, b1.close * exp(sum(gap + body) OVER (PARTITION BY perm_id, d.symbol ORDER BY d.bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS close FROM dealt d JOIN b1 USING (symbol)), "
        f"c2 AS (SELECT *, coalesce(lag(close) OVER ({w}), anchor) * exp(gap) AS open FROM c1), c3 AS (SELECT perm_id, symbol, bar_idx, open, close, open * exp(hi) AS high, open * exp(lo) AS low, volume FROM c2 UNION ALL SELECT perm_id, symbol, 0, open, close, high, low, volume FROM b1, (SELECT DISTINCT perm_id FROM dealt)), "
        "pm AS (SELECT * REPLACE (greatest(open, high, close) AS high, least(open, low, close) AS low) FROM c3)"
    )


def log_bars(df):
    return rounded(df.select("perm_id", F.col("bar_idx").cast("bigint").alias("bar_idx"), *[F.log(x).alias(f"log_{x}") for x in OHLCV[:4]], "volume"))


_LOGS = "perm_id, bar_idx, volume + 0.0 AS volume, " + ", ".join(o.r(f"ln({x})", f"log_{x}") for x in OHLCV[:4])
query("t2_t3_permuted_bars", o.query(f"{o.MARKET}, {permuted(5)}", _LOGS, "pm"))(lambda s, d: log_bars(validation.permute_bars(src.bars_market(s, d), BY, 5)))
query("t2_block_permuted_bars", o.query(f"{o.MARKET}, {permuted(5, 20)}", _LOGS, "pm"))(lambda s, d: log_bars(validation.permute_bars(src.bars_market(s, d), BY, 5, block=20)))
_PERM_TG = "ind AS (SELECT *, close / lag(close, 60) OVER (PARTITION BY perm_id ORDER BY bar_idx) - 1 AS m FROM pm), tg AS (SELECT *, coalesce(" + o.sign("round(m, 12)") + ", 0.0) AS target FROM ind)"
query("t4_permutation_null", o.query(f"{o.MARKET}, {permuted(20)}, {_PERM_TG}, {o.engine('perm_id', '1.0', 'bar_idx')}, sh AS ({o.sharpe('perm_id')})", f"perm_id, {rr('sharpe')}", "sh"))(
    lambda s, d: cols(validation.permutation_null(src.bars_market(s, d), get_strategy("momentum"), {"lookback": 60}, BY, 20), "perm_id", "sharpe")
)
_MEAN = lambda k: f"CASE WHEN bar_idx >= {k - 1} THEN avg(close) OVER (PARTITION BY perm_id ORDER BY bar_idx ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) END"
_SMA_NULL = f"pi AS (SELECT *, {_MEAN(20)} AS f, {_MEAN(100)} AS s FROM pm), tg AS (SELECT *, CASE WHEN s IS NULL THEN 0.0 WHEN f > s THEN 1.0 ELSE -1.0 END AS target FROM pi), {o.engine('perm_id', '1.0', 'bar_idx')}, nl AS ({o.sharpe('perm_id')})"
_SMA_OBS = f"ob AS (SELECT * FROM ({o.query(SMA_BT, 'net', 'bt')})), os AS (SELECT avg(net) / stddev_samp(net) * sqrt(252.0) AS observed FROM ob)"
query("t4_p_value", o.query(f"{o.MARKET}, {permuted(300)}, {_SMA_NULL}, {_SMA_OBS}", f"{o.r('any_value(observed)', 'observed')}, count(*) AS n, {o.r('avg(sharpe)', 'null_mean', 4)}, {o.r('(1 + count(CASE WHEN sharpe >= observed THEN 1 END)) / (count(*) + 1.0)', 'p_value')}, {o.r('avg(CAST(sharpe < observed AS DOUBLE)) * 100', 'percentile')}", "nl, os"))(
    lambda s, d: rounded(validation.p_value(validation.permutation_null(src.bars_market(s, d), get_strategy("sma_cross"), {}, BY, 300), metrics.sharpes(market_run(s, d), BY).first()["sharpe"])).withColumn("null_mean", F.round("null_mean", 4) + 0.0)
)
query("t5_bootstrap_paths", o.query(f"{SMA_BT}, n AS (SELECT count(*) AS n FROM bt), sl AS (SELECT CAST(p AS INT) AS path_id, CAST(b AS INT) AS bar_idx, n FROM n, range(3) x(p), LATERAL (SELECT unnest(range(n)) AS b)), dr AS (SELECT path_id, bar_idx, CAST(floor({o.draw(chr(39) + '1' + chr(39) + ', CAST(path_id AS VARCHAR), CAST(bar_idx AS VARCHAR)')} * n) AS BIGINT) AS pick FROM sl)", "path_id, dr.bar_idx, round(" + stats.slog("(product(1 + net) OVER (PARTITION BY path_id ORDER BY dr.bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))") + ", 6) + 0.0 AS wealth", "dr JOIN bt ON bt.bar_idx = pick"))(
    lambda s, d: rounded(validation.bootstrap_paths(market_run(s, d).select("bar_idx", "net"), 3).select("path_id", "bar_idx", slog("wealth").alias("wealth")))
)
query("t6_permute_within_dates", o.query(f"{o.PANEL}, {XS['xs_reversal']}, {stats.dealt_weights(2)}", f"perm_id, symbol, ts, {rr('weight')}", "px"))(lambda s, d: cols(validation.permute_within_dates(with_weights(the_panel(s, d), "xs_reversal"), 2), "perm_id", "symbol", "ts", "weight"))
query("t7_cross_permutation_null", o.query(f"{o.PANEL}, {XS['xs_reversal']}, {stats.dealt_weights(200)}, {o.portfolio(by='perm_id', source='px', free=True)}, sh AS ({o.sharpe('perm_id', 'net', 'pd')})", f"perm_id, {rr('sharpe')}", "sh"))(
    lambda s, d: cols(validation.cross_permutation_null(with_weights(the_panel(s, d), "xs_reversal"), 200), "perm_id", "sharpe")
)
query("t8_t11_deflated_sharpe", o.query(f"{SMA_BT}, {stats.deflated('bt', 19)}", f"{rr('sharpe', 'hurdle', 'psr', 'dsr', 'min_track_record')}, CAST(n_trials AS DOUBLE) AS n_trials", "ds"))(
    lambda s, d: rounded(s.createDataFrame([tuple(float(v) for v in validation.deflated_sharpe(validation.moments_of(market_run(s, d)), None, 19).values())], "sharpe double, n_trials double, hurdle double, psr double, dsr double, min_track_record double"))
)
MOMENTUM_TRIALS = "gr AS (SELECT * FROM (VALUES (0, 5), (1, 10), (2, 20), (3, 60), (4, 120), (5, 250)) t(trial_id, k)), ind AS (SELECT bars.*, trial_id, close / " + "CASE k " + " ".join(f"WHEN {k} THEN lag(close, {k}) OVER (PARTITION BY trial_id ORDER BY ts)" for k in (5, 10, 20, 60, 120, 250)) + " END - 1 AS m FROM bars, gr), tg AS (SELECT *, coalesce(" + o.sign("m") + ", 0.0) AS target FROM ind)"
query("t16_trial_matrix", o.query(f"{o.MARKET}, {MOMENTUM_TRIALS}, {o.engine('trial_id')}", f"trial_id, bar_idx, {rr('net', n=9)}", "bt"))(lambda s, d: cols(lab.trial_returns(market(s, d), "momentum").withColumn("bar_idx", F.col("bar_idx").cast("bigint")), "trial_id", "bar_idx", "net", n=9))
_PBO = f"{o.MARKET}, {MOMENTUM_TRIALS}, {o.engine('trial_id')}, {stats.combinations('bt')}"
query("t12_pbo_combinations", o.query(_PBO, f"combo, best, {rr('is_sharpe', 'oos_sharpe', 'omega', 'logit')}", "cb"))(lambda s, d: cols(validation.pbo_combinations(lab.trial_returns(market(s, d), "momentum")), "combo", "best", "is_sharpe", "oos_sharpe", "omega", "logit"))
query("t12_pbo", o.query(f"{_PBO}, mo AS (SELECT best, count(*) AS k FROM cb GROUP BY best ORDER BY k DESC, best LIMIT 1)", f"{o.r('avg(CAST(logit <= 0 AS DOUBLE))', 'pbo')}, {o.r('avg(CAST(oos_sharpe <= 0 AS DOUBLE))', 'prob_oos_loss')}, {o.r('CASE WHEN stddev_pop(is_sharpe) > 1e-12 THEN regr_slope(oos_sharpe, is_sharpe) END', 'degradation')}, count(*) AS n_combinations, any_value(mo.best) AS most_selected, {o.r('any_value(k) / CAST(count(*) AS DOUBLE)', 'selection_stability')}", "cb, mo"))(
    lambda s, d: rounded(validation.pbo(lab.trial_returns(market(s, d), "momentum")))
)
_WF = ("oos_return", "oos_max_dd")
query("t13_walk_forward", o.query(stats.walk_forward(), f"fold, trial_id, {rr('is_sharpe', 'oos_sharpe', 'oos_max_dd')}, {o.r(stats.slog('oos_return'), 'oos_return')}, start, test, stop", "wf"))(
    lambda s, d: cols(validation.walk_forward(market(s, d), get_strategy("momentum"))[0].withColumn("oos_return", slog("oos_return")), "fold", "trial_id", "is_sharpe", "oos_sharpe", "oos_max_dd", "oos_return", "start", "test", "stop")
)


query("t14_walk_forward_panel")(lambda s, d: validation.walk_forward_panel(the_panel(s, d), XS_REGISTRY["xs_momentum"]))
STRESS = f"{o.MARKET}, {TG['sma_cross'].replace('tg AS', 'tg0 AS')}, tg AS (SELECT tg0.*, m FROM tg0, (VALUES (1), (3)) x(m)), {o.engine('m', 'm')}, sh AS ({o.sharpe('m')})"
query("t15_cost_stress", o.query(STRESS, f"{o.r('max(CASE WHEN m = 1 THEN sharpe END)', 'sharpe_1x')}, {o.r('max(CASE WHEN m = 3 THEN sharpe END)', 'sharpe_3x')}, round(CASE WHEN max(CASE WHEN m = 1 THEN sharpe END) > 1e-9 THEN max(CASE WHEN m = 3 THEN sharpe END) / max(CASE WHEN m = 1 THEN sharpe END) ELSE 0.0 END, 6) + 0.0 AS ratio", "sh"))(
    lambda s, d: rounded(validation.cost_stress(run_backtest(market_target(s, d).withColumn("cost_mult", F.explode(F.array(F.lit(1), F.lit(3)))), [*BY, "cost_mult"], cost_times="cost_mult"), []))
)
query("t17_benchmark_correlation", o.query(SMA_BT, f"symbol, {o.r('corr(net, ret)', 'correlation')}", "bt", "GROUP BY symbol"))(lambda s, d: rounded(validation.benchmark_correlation(market_run(s, d), BY)))

# --- scores and races
query("z1_reality_score")(lambda s, d: lab.run_lab(src.bars_market(s, d), lab.LabConfig("momentum")).score)
_ARENA = " UNION ALL ".join(f"SELECT '{k}' AS strategy, net FROM ({o.query(f'{o.MARKET}, {t}, {o.engine()}', 'net', 'bt')})" for k, t in TG.items())
_GRIDS = "CASE mo.strategy " + " ".join(f"WHEN '{k}' THEN {min(n, 40)}" for k, n in {"buy_and_hold": 1, "sma_cross": 19, "ema_cross": 24, "macd_trend": 36, "rsi_reversion": 48, "bollinger_reversion": 16, "donchian_breakout": 5, "momentum": 6, "vol_target_momentum": 36, "channel_trend": 48, "coin_flip": 16}.items()) + " END"
query("z2_deflated_rules", o.query(f"ar AS ({_ARENA}), {stats.deflated('ar', _GRIDS.replace('mo.', ''), 'strategy')}", f"strategy, CAST(n_trials AS INT) AS n_trials, {rr('sharpe', 'hurdle', 'psr', 'dsr')}", "ds"))(lambda s, d: rounded(lab.deflated_rules(src.bars_market(s, d))))
query("z2_arena")(lambda s, d: lab.run_arena(src.bars_market(s, d)))
_AS_BARS = "bars AS (SELECT CAST(perm_id AS VARCHAR) AS symbol, bar_idx AS ts, bar_idx, open, high, low, close, volume FROM pm)"
_FEW = 3
_NULLS = " UNION ALL ".join(f"SELECT '{k}' AS strategy, sharpe FROM (WITH {_AS_BARS}, {t}, {o.engine()}, sh AS ({o.sharpe('symbol')}) SELECT sharpe FROM sh)" for k, t in TG.items())
_TESTED = "pv AS (SELECT strategy, (1 + count(CASE WHEN nl.sharpe >= shown THEN 1 END)) / (count(*) + 1.0) AS p_value FROM nl JOIN sw USING (strategy) GROUP BY strategy)"
_RACE = f"strategy, {o.r('ds.sharpe * sqrt(252.0)', 'sharpe')}, {o.r('p_value', 'p_value')}, {o.r('dsr', 'dsr')}, {o.r('(1 - p_value) * dsr', 'evidence')}"
# a permuted market's bars have the returns they had: holding on is a tie but for rounding, and left out
query("z2_arena_few", o.query(f"{o.MARKET}, {permuted(_FEW)}, nl AS ({_NULLS}), ar AS ({_ARENA}), {stats.deflated('ar', _GRIDS.replace('mo.', ''), 'strategy')}, sw AS (SELECT strategy, sharpe * sqrt(252.0) AS shown FROM ds), {_TESTED}", _RACE, "ds JOIN pv USING (strategy)", "WHERE strategy <> 'buy_and_hold'"))(
    lambda s, d: cols(lab.run_arena(src.bars_market(s, d), _FEW).filter("strategy <> 'buy_and_hold'"), "strategy", "sharpe", "p_value", "dsr", "evidence")
)
_XS_GRIDS = "CASE strategy " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in {"equal_weight": 3, "xs_momentum": 24, "xs_reversal": 24, "low_volatility": 24, "xs_value_proxy": 24, "xs_random": 12}.items()) + " END"
_PERM_MONTH = MONTH.replace("PARTITION BY symbol", "PARTITION BY perm_id, symbol")
_XS_NULLS = " UNION ALL ".join(f"SELECT '{k}' AS strategy, sharpe FROM (WITH {XS[k]}, {stats.dealt_weights(_FEW)}, {o.portfolio(_PERM_MONTH, 'perm_id', 'px', True, 0.25)}, sh AS ({o.sharpe('perm_id', 'net', 'pd')}) SELECT sharpe FROM sh)" for k in XS)
_XS_SHOWN = " UNION ALL ".join(f"SELECT '{k}' AS strategy, sharpe AS shown FROM (WITH {XS[k]}, {o.portfolio(MONTH, free=True, cap=0.25)}, sh AS ({o.sharpe('bar_idx >= 0', 'net', 'pd')}) SELECT sharpe FROM sh)" for k in XS)
_XS_RUNS = " UNION ALL ".join(f"SELECT '{k}' AS strategy, net FROM (WITH {XS[k]}, {o.portfolio(MONTH, cap=0.25)} SELECT net FROM pd)" for k in XS)
# dealing equal weights anew changes nothing, and two rules that need unbroken histories hold nothing on these tables: left out
query("z3_portfolio_arena_few", o.query(f"{o.PANEL}, nl AS ({_XS_NULLS}), sw AS ({_XS_SHOWN}), ar AS ({_XS_RUNS}), {stats.deflated('ar', _XS_GRIDS, 'strategy')}, {_TESTED}", _RACE, "ds JOIN pv USING (strategy)", "WHERE strategy IN ('xs_momentum', 'xs_reversal', 'xs_random')"))(
    lambda s, d: cols(lab.run_portfolio_arena(the_panel(s, d), _FEW).filter("strategy IN ('xs_momentum', 'xs_reversal', 'xs_random')"), "strategy", "sharpe", "p_value", "dsr", "evidence")
)
query("z4_portfolio_lab")(lambda s, d: lab.run_portfolio_lab(the_panel(s, d), lab.PortfolioConfig("xs_reversal")).score)
query("z3_portfolio_arena")(lambda s, d: lab.run_portfolio_arena(the_panel(s, d)))

# --- the signal rule, its fills, the environment
ORDERS = f"{o.MARKET}, {SIGNALS}"
query("e1_e2_signals", o.query(ORDERS, f"ts, action, quantity, {o.r('close', 'price')}, CASE action WHEN 'buy' THEN 0.7 WHEN 'sell' THEN 0.6 ELSE 0.5 END AS confidence", "od"))(lambda s, d: cols(agentic.signals(src.bars_market(s, d), BY), "ts", "action", "quantity", "price", "confidence"))
_OK = f"({o.draw(chr(39) + '1' + chr(39) + ', symbol, CAST(bar_idx AS VARCHAR)')} < 0.9 OR action = 'hold')"
query(
    "e3_e5_fills",
    o.query(
        f"{ORDERS}, fx AS (SELECT *, {_OK} AS success FROM od)",
        f"ts, action, success, CASE WHEN success THEN 'executed' ELSE 'failed' END AS status, CASE WHEN success AND action <> 'hold' THEN round_even(1 + 0.01 * quantity, 2) ELSE 0.0 END + 0.0::DOUBLE AS commission, "
        f"CASE WHEN success THEN {stats.cents('close * quantity')} ELSE 0.0 END + 0.0 AS total_value, CASE WHEN NOT success THEN 'execution failed' END AS error, concat('order-', symbol, '-', bar_idx) AS order_id",
        "fx",
    ),
)(lambda s, d: agentic.fills(agentic.signals(src.bars_market(s, d), BY), BY, 0.9).select("ts", "action", "success", "status", "commission", (F.col("total_value") + 0.0).alias("total_value"), "error", "order_id"))
query("e6_signal_backtest", o.query(f"{ORDERS}, fl AS (SELECT *, CASE action WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 ELSE 0 END AS sg FROM od WHERE bar_idx >= 49), rn AS (SELECT *, sum(sg * quantity) {o.far()} AS position, 100000 - sum(sg * {stats.cents('close * quantity')}) {o.far()} AS cash FROM fl)", "ts, CAST(position AS BIGINT) AS position, round(cash + greatest(position, 0) * close, 2) + 0.0 AS value", "rn"))(
    lambda s, d: agentic.signal_backtest(src.bars_market(s, d), BY).select("ts", F.col("position").cast("bigint").alias("position"), (F.round("value", 2) + 0.0).alias("value"))
)
query("e7_run_once", o.query(ORDERS, "ts, action, quantity", "od", "ORDER BY ts DESC LIMIT 1"))(lambda s, d: agentic.run_once(src.bars_market(s, d), BY).select("ts", "action", "quantity"))
_EN = ("balance", "portfolio_value", "reward")
query("e10_e12_environment", "WITH RECURSIVE " + o.query(stats.environment(), f"symbol, ts, action, CAST(position AS BIGINT) AS position, {rr(*_EN)}", "en").removeprefix("WITH "))(
    lambda s, d: rounded(agentic.simulate_environment(agentic.environment_features(src.bars_market(s, d), BY).withColumn("action", F.pmod(F.dayofyear("ts"), F.lit(3)).cast("int")), BY))
)
_EP = f"pk AS (SELECT *, greatest(max(portfolio_value) {o.far()}, 100000.0) AS peak FROM en), ep AS (SELECT symbol, (last(portfolio_value ORDER BY ts) - 100000) / 100000 AS total_return, max(1 - portfolio_value / peak) AS max_drawdown, count(CASE WHEN action <> 1 THEN 1 END) AS trades FROM pk GROUP BY symbol)"
query("e14_e15_episode", "WITH RECURSIVE " + o.query(f"{stats.environment()}, {_EP}", f"symbol, {rr('total_return', 'max_drawdown')}, trades, CASE WHEN total_return > 0.02 THEN 'BUY' WHEN total_return < -0.02 THEN 'SELL' ELSE 'HOLD' END AS action, {o.r('least(0.9, 0.5 + abs(total_return))', 'confidence')}", "ep").removeprefix("WITH "))(
    lambda s, d: rounded(agentic.episode_summary(agentic.simulate_environment(agentic.environment_features(src.bars_market(s, d), BY).withColumn("action", F.pmod(F.dayofyear("ts"), F.lit(3)).cast("int")), BY), BY).withColumn("x", agentic.model_signal(F.col("total_return"))).select("symbol", "total_return", "max_drawdown", "trades", "x.action", "x.confidence"))
)

# --- presentation transforms
query("c1_c2_equity_views", o.query(f"{SMA_BT}, {UNDER}", f"ts, {o.r(stats.slog('(equity / first_value(equity) ' + o.far() + ' * 100)'), 'rebased')}, {o.r('dd * 100', 'underwater')}", "dd"))(lambda s, d: rounded(metrics.with_drawdown(market_run(s, d), BY).select("ts", slog(F.col("equity") / F.first("equity").over(c.so_far(BY)) * 100).alias("rebased"), (F.col("drawdown") * 100).alias("underwater"))))
query("c3_histogram", o.query(f"{SMA_BT}, e AS (SELECT min(gross) AS lo, max(gross) AS hi FROM bt)", "CAST(least(43, floor((gross - lo) / ((hi - lo) / 44))) AS INT) AS bin, count(*) AS n", "bt, e", "GROUP BY 1"))(lambda s, d: metrics.histogram(market_run(s, d), "gross", 44))
query("c4_gross_net_per_date", o.query(BOOK, f"ts, {rr('exposure', 'net_exposure')}", "pd"))(lambda s, d: cols(portfolio.portfolio_returns(book(s, d)), "ts", "exposure", "net_exposure"))
query("c5_position_value", o.query(ORDERS, f"ts, close * quantity AS value, {o.r('close * quantity / 100000', 'allocation', 3)}", "od"))(lambda s, d: agentic.signals(src.bars_market(s, d), BY).select("ts", (F.col("price") * F.col("quantity")).alias("value"), (F.round(F.col("price") * F.col("quantity") / 100000, 3) + 0.0).alias("allocation")))


# --- streams, run over everything there is
FIRST, LAST = "1999-01-01", "2001-06-01"


def in_files(s, d, *parts: Column) -> DataFrame:
    """A stream of the market's bars in files that come one after the other, the n-th with the rows of parts[n]."""
    s.conf.set("spark.sql.streaming.stateStore.providerClass", live.STATE_STORE)
    path = scratch(s)
    bars = market(s, d).withColumn("ts", F.col("ts").cast("timestamp")).persist()
    for rows in parts:
        bars.filter(rows).drop("bar_idx").coalesce(1).write.mode("append").parquet(path)
    bars.unpersist()
    return live.read_bar_files(s, path)


def fails(batch, k):
    raise RuntimeError("a callback that fails stops no other")


_MARK = f"m AS (SELECT max(ts) AS mark FROM bars WHERE ts < TIMESTAMP '{FIRST}' AND bar_idx % 10 <> 3)"


@query("st1_st6_live_bars", o.query(f"{o.MARKET}, {_MARK}", f"symbol, ts, {rr('close')}", "bars, m", f"WHERE (ts < TIMESTAMP '{FIRST}' AND bar_idx % 10 <> 3) OR (ts > mark AND ts + INTERVAL 1 DAY <= TIMESTAMP '{LAST}')"))
def _(s, d):
    sink, old = scratch(s), F.col("ts") < F.lit(FIRST).cast("timestamp")
    # the second file brings late bars, repeated ones and new ones, some of which still form
    stream = in_files(s, d, old & (F.col("bar_idx") % 10 != 3), ~old | (F.col("bar_idx") % 10 == 3) | (F.col("bar_idx") % 7 == 0))
    live.live_bars(stream, "1d", LAST, [fails, live.batch_sink(sink)], scratch(s)).awaitTermination()
    return cols(s.read.parquet(sink).withColumn("ts", F.col("ts").cast("timestamp_ntz")), "symbol", "ts", "close")


_ENDS = ("1997-06-01", "1999-06-01")
_LAST_OF = " UNION ALL ".join(f"SELECT max(ts) AS ts FROM od{w}" for w in [*[f" WHERE ts < TIMESTAMP '{e}'" for e in _ENDS], ""])


@query("e8_live_loop", o.query(f"{ORDERS}, l AS ({_LAST_OF})", f"ts, action, quantity, {o.r('close', 'price')}", "od JOIN l USING (ts)"))
def _(s, d):
    sink, t = scratch(s), [F.lit(e).cast("timestamp") for e in _ENDS]
    stream = in_files(s, d, F.col("ts") < t[0], (F.col("ts") >= t[0]) & (F.col("ts") < t[1]), F.col("ts") >= t[1])
    live.trade_live(stream, live.batch_sink(sink), scratch(s)).awaitTermination()
    return cols(s.read.parquet(sink).withColumn("ts", F.col("ts").cast("timestamp_ntz")), "ts", "action", "quantity", "price")


@query("st1_st4_new_bars", o.query(f"{o.MARKET}, {_MARK}", f"symbol, ts, {rr('close')}", "bars, m", f"WHERE (ts < TIMESTAMP '{FIRST}' AND bar_idx % 10 <> 3) OR ts > mark"))
def _(s, d):
    sink, marks, old = scratch(s), scratch(s), F.col("ts") < F.lit(FIRST).cast("timestamp")
    first = old & (F.col("bar_idx") % 10 != 3)
    live.run_available(live.new_bars(in_files(s, d, first, ~first)), sink, marks)  # late bars and new ones
    return cols(s.read.parquet(sink).withColumn("ts", F.col("ts").cast("timestamp_ntz")), "symbol", "ts", "close")


@query("st2_polled_bars", o.query(o.MARKET, f"symbol, ts, {rr('close')}", "bars", "WHERE year(ts) % 3 > 0"))
def _(s, d):
    """A year's bars a poll; every third poll failed. The stream is stopped after three years and goes on."""
    path, sink, marks, b = scratch(s), scratch(s), scratch(s), market(s, d)
    poll.register(s)
    years = [r["y"] for r in b.select(F.year("ts").alias("y")).distinct().orderBy("y").collect()]  # a row a year
    for some in (years[:3], years[3:]):
        for y in some:
            if y % 3:
                poll.record(s, b.filter(F.year("ts") == y), path, y - years[0])
            else:
                poll.record_failure(s, path, y - years[0])
        stream = s.readStream.format("bar_poll").option("path", path).load().drop("poll")
        live.fan_out(live.new_bars(stream), [live.batch_sink(sink)], marks).awaitTermination()
    return cols(s.read.parquet(sink).withColumn("ts", F.col("ts").cast("timestamp_ntz")), "symbol", "ts", "close")


query(
    "st_tick_sessions",
    "WITH t AS (SELECT event_type AS symbol, ts, value + 1 AS price, ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS apart FROM events), i AS (SELECT *, sum(CASE WHEN apart IS NULL OR apart >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts) AS island FROM t) "
    "SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, round(arg_min(price, ts), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, ts), 6) AS close, CAST(count(*) AS DOUBLE) AS volume FROM i GROUP BY symbol, island",
)(lambda s, d: cols(live.tick_sessions(src.ticks(s, d)), "symbol", "first_ts", "last_ts", *OHLCV))


@query("st_tick_windows", "SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, count(*) AS n FROM events WHERE time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes' GROUP BY 1, 2")
def _(s, d):
    path, sink = scratch(s), scratch(s)
    src.ticks(s, d).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    stream = s.readStream.schema("event_id bigint, ts timestamp, symbol string, price double").parquet(path)
    live.run_available(live.tick_windows(stream), sink, scratch(s))
    return s.read.parquet(sink).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("volume").cast("bigint").alias("n"))
