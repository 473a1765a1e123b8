"""Statistics of return series, one row per run key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, over, ratio, so_far
from ..functions.quantiles import exact_quantiles
from ..functions.scans import scanned

DEGENERATE = 1e-12


def periods_per_year(bars: DataFrame, by: list[str], order: str = "ts") -> DataFrame:
    """by, ppy: from the median positive step; daily or slower steps by the trading-day convention."""
    step = (F.unix_micros(F.col(order).cast("timestamp")) - F.unix_micros(F.lag(order).over(over(by, order)).cast("timestamp"))) / 1e6
    s = bars.select(*by, order, step.alias("_s")).groupBy(*by).agg(F.count("*").alias("_n"), F.median(F.when(F.col("_s") > 0, F.col("_s"))).alias("_m"))
    m = F.col("_m")
    daily = F.bround(252 / F.greatest(m / 86400 / 1.4, F.lit(1.0)))
    ppy = F.when((F.col("_n") < 3) | m.isNull(), 252).when(m >= 72000, daily).otherwise(F.bround(ratio(F.lit(6.5 * 3600), m) * 252))
    return s.select(*by, F.greatest(F.lit(1), ppy).cast("int").alias("ppy"))


def sharpe_of(mean: Column, sd: Column, n: Column, ppy: float) -> Column:
    return F.when((n < 2) | sd.isNull() | (sd < DEGENERATE), 0.0).otherwise(ratio(mean, sd) * F.sqrt(F.lit(float(ppy))))


def sharpes(df: DataFrame, by: list[str], ppy: int = 252, c: str = "net") -> DataFrame:
    """by, sharpe: the one statistic that trials, permutations and folds need."""
    return df.filter(finite(c)).groupBy(*by).agg(sharpe_of(F.avg(c), F.stddev_samp(c), F.count(c), ppy).alias("sharpe"))


def with_drawdown(df: DataFrame, by: list[str], order: str = "ts", equity: str = "equity", block=None) -> DataFrame:
    """block: for long keys, see run_backtest."""
    if block is not None:
        df = scanned(df, by, {"_peak": ("max", equity)}, order, block)
        return df.withColumn("drawdown", ratio(equity, "_peak") - 1).drop("_peak")
    return df.withColumn("drawdown", ratio(F.col(equity), F.max(equity).over(so_far(by, order))) - 1)


def under_water(df: DataFrame, by: list[str], order: str = "ts", block=None) -> DataFrame:
    """by, under_water: the longest run of bars below an earlier peak. A run is the bars between two bars at a peak."""
    peak = (F.col("drawdown") >= 0).cast("int")
    df = df.withColumn("_island", F.sum(peak).over(so_far(by, order))) if block is None else scanned(df, by, {"_island": ("sum", peak)}, order, block)
    runs = df.groupBy(*by, "_island").agg(F.count(F.when(F.col("drawdown") < 0, 1)).alias("_n"))
    return runs.groupBy(*by).agg(F.max("_n").alias("under_water"))


def compute_metrics(df: DataFrame, by: list[str], ppy: int = 252, rf: float = 0.0, order: str = "ts", ret: str = "net", equity: str = "equity", position: str | None = "position", block=None) -> DataFrame:
    """One row per key with the full bundle, from `ret`, `equity` and, if given, `position`.

    block: for keys too long for one task, see run_backtest; quantiles then come from counting passes.
    """
    df = with_drawdown(df, by, order, equity, block).withColumn("_r", F.when(finite(ret), F.col(ret)))
    r, x = F.col("_r"), F.col("_r") - rf / ppy
    n = F.count(r)
    down = F.when(x < 0, x * x)
    pop3, pop4 = F.skewness(r), F.kurtosis(r)
    aggs = {
        "n_bars": n, "_mean": F.avg(r), "_sd": F.stddev_samp(r), "_first": F.min_by(equity, order), "_last": F.max_by(equity, order),
        "_down": F.sqrt(F.avg(down)), "max_drawdown": F.min("drawdown"), "hit_rate": F.avg((r > 0).cast("double")), "_g1": pop3, "_g2": pop4,
        **({"var_95": F.percentile(r, 0.05)} if block is None else {}), "best_bar": F.max(r), "worst_bar": F.min(r),
    }
    if position:
        df = df.withColumn("_before", F.lag(position).over(over(by, order))) if block is None else scanned(df, by, {"_before": ("lag", position, 1)}, order, block)
        df = df.withColumn("_turn", F.abs(F.col(position) - F.coalesce("_before", F.lit(0.0))))
        p = F.col(position)
        aggs |= {"exposure": F.avg(F.abs(p)), "long_share": F.avg((p > 0).cast("double")), "short_share": F.avg((p < 0).cast("double")), "_turned": F.sum("_turn"), "n_trades": F.count(F.when(F.col("_turn") > 1e-9, 1))}
    s = df.groupBy(*by).agg(*[c.alias(k) for k, c in aggs.items()])
    if block is not None:
        s = s.join(exact_quantiles(df, by, "_r", [0.05]).select(*by, F.col("value").alias("var_95")), by, "left")
    tail = df.join(s.select(*by, "var_95"), by).filter("_r <= var_95").groupBy(*by).agg(F.avg("_r").alias("_cvar"))
    s = s.join(tail, by, "left").join(under_water(df, by, order, block), by)
    k, m = F.col("n_bars").cast("double"), F.col("_mean") - rf / ppy
    years = k / ppy
    total = ratio("_last", "_first") - 1
    cagr = F.when(1 + total >= 0, F.pow(1 + total, 1 / years) - 1)  # no growth rate leads below nothing
    skew = F.when(k > 2, F.sqrt(k * (k - 1)) / (k - 2) * F.col("_g1")).otherwise(0.0)
    kurt = F.when(k > 3, (k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * F.col("_g2") + 6)).otherwise(0.0)
    sortino = F.when(k < 2, 0.0).when(F.col("_down").isNull(), F.when(m > 0, F.lit(float("inf"))).otherwise(0.0)).when(F.col("_down") < DEGENERATE, 0.0).otherwise(ratio(m, F.col("_down")) * F.sqrt(F.lit(float(ppy))))
    out = {
        "total_return": total, "cagr": cagr, "ann_vol": F.col("_sd") * F.sqrt(F.lit(float(ppy))), "sharpe": sharpe_of(m, F.col("_sd"), k, ppy), "sortino": sortino,
        "max_drawdown": F.col("max_drawdown"), "calmar": F.when(F.col("max_drawdown") < 0, cagr / F.abs("max_drawdown")).otherwise(0.0), "time_under_water_yrs": F.col("under_water") / ppy,
        "hit_rate": F.col("hit_rate"), "skew": F.coalesce(F.when(~F.isnan(skew), skew), F.lit(0.0)), "kurtosis": F.coalesce(F.when(~F.isnan(kurt), kurt), F.lit(0.0)), "var_95": F.col("var_95"),
        "cvar_95": F.when(k > 20, F.col("_cvar")).otherwise(0.0), "best_bar": F.col("best_bar"), "worst_bar": F.col("worst_bar"), "n_bars": k, "years": years,
    }
    if position:
        out |= {"exposure": F.col("exposure"), "long_share": F.col("long_share"), "short_share": F.col("short_share"), "turnover_ann": F.col("_turned") / years, "n_trades": F.col("n_trades").cast("double")}
    return s.select(*by, *[c.alias(k) for k, c in out.items()])


def cost_drag(df: DataFrame, by: list[str], ppy: int = 252) -> DataFrame:
    return df.groupBy(*by).agg((F.sum("cost") / (F.count("*") / ppy)).alias("cost_drag_ann"))


def histogram(df: DataFrame, c: str, bins: int) -> DataFrame:
    """bin, n: equal-width bins from the least to the largest value, the last one closed."""
    ends = df.agg(F.min(c).alias("low"), F.max(c).alias("high")).first()  # two numbers
    low, high = ends
    if low is None:
        return df.select(F.lit(0).alias("bin"), F.lit(0).cast("bigint").alias("n")).limit(0)
    width = (high - low) / bins or 1.0
    place = F.least(F.lit(bins - 1), F.floor((F.col(c) - low) / width)).cast("int")
    return df.filter(F.col(c).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
