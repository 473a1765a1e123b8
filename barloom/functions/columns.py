"""Column helpers: windows with explicit frames, guarded aggregates, null-safe arithmetic."""

from __future__ import annotations

import statistics
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def over(by: list[str], order: str = "ts"):
    return W.partitionBy(*by).orderBy(order)


def last_rows(by: list[str], k: int, order: str = "ts"):
    return over(by, order).rowsBetween(-(k - 1), 0)


def so_far(by: list[str], order: str = "ts"):
    return over(by, order).rowsBetween(W.unboundedPreceding, 0)


def rolling(agg, c: Column | str, k: int, by: list[str], order: str = "ts") -> Column:
    """agg over the last k rows, null until k values are there."""
    frame = last_rows(by, k, order)
    return F.when(F.count(c).over(frame) == k, agg(c).over(frame))


def ratio(a, b) -> Column:
    """a / b, null where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a, b)


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def returns(by: list[str], close: str = "close", order: str = "ts") -> Column:
    """Simple returns, 0 on the first bar."""
    return F.coalesce(change(1, by, close, order), F.lit(0.0))


def change(k: int, by: list[str], close: str = "close", order: str = "ts") -> Column:
    return ratio(F.col(close), F.lag(close, k).over(over(by, order))) - 1


def hold(raw: Column, by: list[str], order: str = "ts") -> Column:
    """The last value that was not null, 0 before any."""
    return F.coalesce(F.last(raw, ignorenulls=True).over(so_far(by, order)), F.lit(0.0))


def backfill(c: Column | str, by: list[str], order: str = "ts") -> Column:
    """The next value that is not null. It looks ahead: for feature tables, never for signals."""
    return F.first(c, ignorenulls=True).over(over(by, order).rowsBetween(0, W.unboundedFollowing))


def rank_pct(c: str, by: list[str]) -> Column:
    """Average-tie rank over the number of values, null for nulls."""
    n = F.count(c).over(W.partitionBy(*by))
    ties = F.count(c).over(W.partitionBy(*by, c))
    low = F.rank().over(W.partitionBy(*by).orderBy(F.col(c).asc_nulls_last()))
    return F.when(F.col(c).isNotNull(), ratio(low + (ties - 1) / 2, n))


def ramp(v: Column, good: float, bad: float) -> Column:
    """100 at good, 0 at bad, linear between, 50 where v is null or not finite."""
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - bad) / (good - bad))) * 100
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 50.0).otherwise(scaled)


def draw(*key: Column | str) -> Column:
    """A number in [0, 1) from the md5 of its key: the same on any cluster, in any order."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key])), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def symbol_seed(symbol: Column) -> Column:
    """First four bytes of the symbol's sha256 as a number."""
    return F.conv(F.substring(F.sha2(F.upper(symbol), 256), 1, 8), 16, 10).cast("bigint")


_normal = statistics.NormalDist()
norm_cdf, norm_ppf = _normal.cdf, _normal.inv_cdf

# Published rational approximations of the normal distribution function (Hart 5666) and of
# its inverse (Acklam), highest power first.
CDF_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
PPF_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
PPF_TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
PPF_TAIL = 0.02425


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once, however often f names it."""
    return F.transform(F.array(x), f)[0]


def polynomial(x: Column, powers: tuple[float, ...]) -> Column:
    out = F.lit(powers[0])
    for c in powers[1:]:
        out = out * x + c
    return out


def norm_cdf_column(x: Column) -> Column:
    """To about 1e-15."""

    def below(z: Column) -> Column:
        bell, far = F.exp(-z * z / 2), F.lit(0.65)
        for k in (4, 3, 2, 1):
            far = k / (z + far)
        return F.when(z < 7.07106781186547, bell * polynomial(z, CDF_TOP) / polynomial(z, CDF_BOTTOM)).otherwise(bell / (z + far) / 2.506628274631)

    return let(x, lambda v: let(let(F.least(F.abs(v), F.lit(38.0)), below), lambda b: F.when(v > 0, 1 - b).otherwise(b)))


def norm_ppf_column(p: Column) -> Column:
    """Null outside (0, 1). An approximation and one step of Halley's method."""

    def near(p: Column) -> Column:
        middle = let((p - 0.5) * (p - 0.5), lambda r: polynomial(r, PPF_TOP) / polynomial(r, PPF_BOTTOM)) * (p - 0.5)
        out = let(F.sqrt(-2 * F.log(p)), lambda t: polynomial(t, PPF_TAIL_TOP) / polynomial(t, PPF_TAIL_BOTTOM))
        return F.when(p < PPF_TAIL, out).otherwise(middle)

    step = lambda p, x: let((norm_cdf_column(x) - p) * 2.5066282746310002 * F.exp(x * x / 2), lambda u: x - u / (1 + x * u / 2))
    # the lower tail for both: beside 1 a distribution function has no digits left
    below = lambda p: let(p, lambda q: let(near(q), lambda x: step(q, x)))
    return let(p, lambda v: F.when((v > 0) & (v <= 0.5), below(v)).when((v > 0.5) & (v < 1), -below(1 - v)))


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def numbered(df: DataFrame, by: list[str], order: str = "ts", name: str = "bar_idx", block=None) -> DataFrame:
    """Rows of a key numbered from 0; block: for long keys, see scans.block_of."""
    if block is not None:
        from .scans import scanned

        return scanned(df, by, {name: ("count", F.lit(1))}, order, block).withColumn(name, F.col(name).cast("int") - 1)
    return df.withColumn(name, F.row_number().over(over(by, order)) - 1)


def truncated(ts: Column, frequency: str) -> Column:
    return F.date_trunc({"W": "WEEK", "M": "MONTH", "Q": "QUARTER"}[frequency], ts)


def parse_params(text: Column) -> Column:
    """'fast=10,slow=50' as a map of doubles."""
    return F.transform_values(F.str_to_map(text, F.lit(","), F.lit("=")), lambda _, v: v.cast("double"))
