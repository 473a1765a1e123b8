"""Single-asset rules: parameters, grids, and target exposure as columns.

A rule names the indicators it needs and gives a raw signal expression. A grid of variants is one
plan: every distinct indicator is computed once, each bar explodes into a row per variant, and a
rule that holds its position fills forward within (key, variant).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, draw, hold, ratio
from ..functions.indicators import name_of, with_indicators


@dataclass(frozen=True)
class Param:
    """A parameter: default, the values a grid tries, and its type."""

    name: str
    default: float
    grid: tuple
    kind: type = int


def merged(params: tuple[Param, ...], given: dict | None) -> dict:
    given = given or {}
    return {p.name: p.kind(given[p.name] if given.get(p.name) is not None else p.default) for p in params}


def thinned(combos: list, limit: int | None) -> list:
    if limit is None or len(combos) <= limit:
        return combos
    return [combos[int(i * len(combos) / limit)] for i in range(limit)]


def product_grid(params: tuple[Param, ...], valid: Callable[[dict], bool], limit: int | None) -> list[dict]:
    """All combinations, the last parameter moving fastest, without invalid ones, thinned evenly to the limit."""
    names = [p.name for p in params]
    return thinned([c for values in itertools.product(*[p.grid for p in params]) if valid(c := dict(zip(names, values, strict=True)))], limit)


@dataclass(frozen=True)
class Strategy:
    key: str
    needs: Callable[..., list[tuple]]
    raw: Callable[..., Column]
    params: tuple[Param, ...] = ()
    holds: bool = False
    warm: Callable[..., Column] | None = field(default=None)

    def clean(self, given: dict | None = None) -> dict:
        return merged(self.params, given)

    def grid(self, limit: int | None = None) -> list[dict]:
        ok = lambda c: not (("slow" in c and c["fast"] >= c["slow"]) or ("upper" in c and c["lower"] >= c["upper"]))
        return product_grid(self.params, ok, limit)


def _c(*ind) -> Column:
    return F.col(name_of(ind))


def _cross(kind: str):
    return lambda fast, slow: F.when(_c(kind, slow).isNotNull(), F.when(_c(kind, fast) > _c(kind, slow), 1.0).otherwise(-1.0))


def _band(name: str, part: str) -> Column:
    return F.col(f"{name}_{part}")


def _reversion(window, k):
    n = name_of(("boll", window, k))
    away = F.abs(F.col("close") - _band(n, "mid")) < 0.1 * (_band(n, "high") - _band(n, "mid"))
    return F.when(away, 0.0).when(F.col("close") > _band(n, "high"), -1.0).when(F.col("close") < _band(n, "low"), 1.0)


def _breakout(window):
    n = name_of(("donchian", window))
    return F.when(F.col("close") < _band(n, "low"), -1.0).when(F.col("close") > _band(n, "high"), 1.0)


def _rsi(window, lower, upper):
    r = _c("rsi", window)
    return F.when((r > 45) & (r < 55), 0.0).when(r > upper, -1.0).when(r < lower, 1.0)


def _channel(window, atr_window, mult):
    mid, band = _c("sma", window), _c("atr", atr_window) * mult
    return F.when(F.abs(F.col("close") - mid) < 0.25 * band, 0.0).when(F.col("close") < mid - band, -1.0).when(F.col("close") > mid + band, 1.0)


def _sized(lookback, vol_window, target_vol):
    scale = ratio(F.lit(target_vol / 100), _c("rv", vol_window))
    return F.when(scale.isNotNull(), F.signum(_c("roc", lookback)) * F.least(F.lit(1.0), scale))


def _coin(hold, seed):
    block = F.floor(F.col("bar_idx") / max(hold, 1))
    return F.when(draw(F.lit("coin"), F.lit(int(seed)), block) < 0.5, -1.0).otherwise(1.0)


REGISTRY: dict[str, Strategy] = {}


def register_strategy(s: Strategy) -> Strategy:
    REGISTRY[s.key] = s
    return s


# Defaults and grids of the rules.
for _s in (
    Strategy("buy_and_hold", lambda: [], lambda: F.lit(1.0)),
    Strategy("sma_cross", lambda fast, slow: [("sma", fast), ("sma", slow)], _cross("sma"), (Param("fast", 20, (5, 10, 20, 30, 50)), Param("slow", 100, (50, 100, 150, 200)))),
    Strategy("ema_cross", lambda fast, slow: [("ema", fast), ("ema", slow)], _cross("ema"), (Param("fast", 12, (5, 8, 12, 21, 34)), Param("slow", 50, (34, 50, 89, 144, 200)))),
    Strategy(
        "macd_trend", lambda fast, slow, signal: [("macd", fast, slow, signal)], lambda fast, slow, signal: F.signum(F.col(name_of(("macd", fast, slow, signal)) + "_hist")),
        (Param("fast", 12, (8, 12, 16)), Param("slow", 26, (21, 26, 34, 50)), Param("signal", 9, (5, 9, 13))),
    ),
    Strategy(
        "rsi_reversion", lambda window, lower, upper: [("rsi", window)], _rsi, (Param("window", 14, (7, 14, 21)), Param("lower", 30, (20, 25, 30, 35)), Param("upper", 70, (65, 70, 75, 80))),
        True, lambda window, lower, upper: _c("rsi", window),
    ),
    Strategy(
        "bollinger_reversion", lambda window, k: [("boll", window, k)], _reversion, (Param("window", 20, (10, 20, 30, 50)), Param("k", 2.0, (1.5, 2.0, 2.5, 3.0), float)),
        True, lambda window, k: _band(name_of(("boll", window, k)), "mid"),
    ),
    Strategy("donchian_breakout", lambda window: [("donchian", window)], _breakout, (Param("window", 20, (10, 20, 40, 55, 100)),), True, lambda window: _band(name_of(("donchian", window)), "high")),
    Strategy("momentum", lambda lookback: [("roc", lookback)], lambda lookback: F.signum(_c("roc", lookback)), (Param("lookback", 60, (5, 10, 20, 60, 120, 250)),)),
    Strategy(
        "vol_target_momentum", lambda lookback, vol_window, target_vol: [("roc", lookback), ("rv", vol_window)], _sized,
        (Param("lookback", 60, (20, 60, 120, 250)), Param("vol_window", 20, (10, 20, 60)), Param("target_vol", 15.0, (10, 15, 20), float)),
    ),
    Strategy(
        "channel_trend", lambda window, atr_window, mult: [("sma", window), ("atr", atr_window)], _channel,
        (Param("window", 50, (20, 50, 100, 200)), Param("atr_window", 14, (7, 14, 28)), Param("mult", 1.0, (0.5, 1.0, 1.5, 2.0), float)),
        True, lambda window, atr_window, mult: _c("sma", window) + _c("atr", atr_window),
    ),
    Strategy("coin_flip", lambda hold, seed: [], _coin, (Param("hold", 5, (1, 5, 10, 20)), Param("seed", 7, (1, 7, 42, 123)))),
):
    register_strategy(_s)


def get_strategy(key: str) -> Strategy:
    if key not in REGISTRY:
        raise KeyError(f"no strategy {key!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[key]


def list_strategies(exclude: tuple[str, ...] = ()) -> list[Strategy]:
    return [s for k, s in REGISTRY.items() if k not in exclude]


def with_targets(bars: DataFrame, by: list[str], variants: list[tuple[Strategy, dict]], order: str = "ts") -> DataFrame:
    """bars (with bar_idx) times variants: adds trial_id, the place in `variants`, and target in [-1, 1], 0 until warm."""
    clean = [(s, s.clean(p)) for s, p in variants]
    needs = {i for s, p in clean for i in s.needs(**p)}
    ready = with_indicators(bars, by, needs, order)
    warm = lambda s, p: (s.warm(**p) if s.warm else F.lit(1.0)).isNotNull()
    rows = [F.struct(F.lit(i).alias("trial_id"), s.raw(**p).cast("double").alias("raw"), F.lit(s.holds).alias("holds"), warm(s, p).alias("warm")) for i, (s, p) in enumerate(clean)]
    each = ready.select(*bars.columns, F.explode(F.array(*rows)).alias("v")).select(*bars.columns, "v.*")
    keys = [*by, "trial_id"]
    held = F.when(F.col("holds"), F.when(F.col("warm"), hold(F.col("raw"), keys, order))).otherwise(F.col("raw")) if any(s.holds for s, _ in clean) else F.col("raw")
    return each.withColumn("target", F.coalesce(clip(held, -1, 1), F.lit(0.0))).drop("raw", "holds", "warm")
