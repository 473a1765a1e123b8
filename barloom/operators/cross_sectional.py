"""Cross-sectional rules: scores within a date become weights of a long and a short leg."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import clip, draw, over, rank_pct, ratio, rolling, so_far
from .strategies import Param, merged, product_grid

MIN_NAMES = 4
SYMBOL = ["symbol"]


def legs_of(df: DataFrame, by: list[str] = [], long_frac: float | Column = 0.3, short_frac: float | Column = 0.3, long_only: bool = False, min_names: int = MIN_NAMES) -> DataFrame:  # noqa: B006
    """score -> weight: the names of highest and of lowest score share a leg each; an empty leg leaves its date without weights.

    The shares of names in the legs may be columns, so that variants are rows of one plan.
    """
    at = W.partitionBy(*by, "ts")
    df = df.withColumn("_rank", rank_pct("score", [*by, "ts"]))
    top, bottom = (F.coalesce(c, F.lit(False)).cast("double") for c in (F.col("_rank") > 1 - long_frac, F.col("_rank") <= short_frac))
    share = lambda chosen: ratio(chosen, F.sum(chosen).over(at))
    weight = share(top) if long_only else share(top) * 0.5 - share(bottom) * 0.5
    return df.withColumn("weight", F.coalesce(F.when(F.count("score").over(at) >= min_names, weight), F.lit(0.0))).drop("_rank")


def rebalance_hold(df: DataFrame, by: list[str], every: int | Column) -> DataFrame:
    """weight as of the last bar whose position is a multiple of `every`."""
    if isinstance(every, int) and every <= 1:
        return df
    kept = F.last(F.when(F.col("bar_idx") % every == 0, F.col("weight")), ignorenulls=True).over(so_far([*by, "symbol"], "bar_idx"))
    return df.withColumn("weight", F.coalesce(kept, F.lit(0.0)))


@dataclass(frozen=True)
class CrossSectional:
    key: str
    score: Callable[..., Column] | None
    params: tuple[Param, ...]

    def clean(self, given: dict | None = None) -> dict:
        return merged(self.params, given)

    def grid(self, limit: int | None = None) -> list[dict]:
        return product_grid(self.params, lambda c: not ("skip" in c and c["skip"] >= c["lookback"]), limit)


def _lag(c: str, k: int, by: list[str]) -> Column:
    return F.lag(c, k).over(over([*by, "symbol"], "bar_idx"))


def _momentum(by, lookback, skip, **_):
    return ratio(_lag("close", skip, by), _lag("close", lookback, by)) - 1


def _reversal(by, lookback, **_):
    return -(ratio(F.col("close"), _lag("close", lookback, by)) - 1)


def _calm(by, window, **_):
    return -rolling(F.stddev_samp, "ret", window, [*by, "symbol"], "bar_idx")


def _below_mean(by, window, **_):
    return -(ratio(F.col("close"), rolling(F.avg, "close", window, [*by, "symbol"], "bar_idx")) - 1)


def _random(by, seed, **_):
    return F.when(F.col("listed"), draw(F.lit("xs"), F.lit(int(seed)), "bar_idx", "symbol"))


_every = lambda d, g=(5, 21, 63): Param("rebalance", d, g)
_leg = Param("long_frac", 0.3, (0.1, 0.2, 0.3), float)
# Defaults and grids of the rules.
XS_REGISTRY = {
    s.key: s
    for s in (
        CrossSectional("equal_weight", None, (_every(21),)),
        CrossSectional("xs_momentum", _momentum, (Param("lookback", 250, (60, 120, 250)), Param("skip", 20, (0, 5, 20)), _every(21), _leg)),
        CrossSectional("xs_reversal", _reversal, (Param("lookback", 5, (1, 3, 5, 10, 21)), _every(5, (1, 5, 21)), _leg)),
        CrossSectional("low_volatility", _calm, (Param("window", 60, (20, 60, 120)), _every(21), _leg)),
        CrossSectional("xs_value_proxy", _below_mean, (Param("window", 250, (120, 250, 500)), _every(21), _leg)),
        CrossSectional("xs_random", _random, (_every(21), Param("seed", 7, (1, 7, 42, 123)))),
    )
}


def get_xs_strategy(key: str) -> CrossSectional:
    if key not in XS_REGISTRY:
        raise KeyError(f"no cross-sectional strategy {key!r}; there are {', '.join(sorted(XS_REGISTRY))}")
    return XS_REGISTRY[key]


def list_xs_strategies(exclude: tuple[str, ...] = ()) -> list[CrossSectional]:
    return [s for k, s in XS_REGISTRY.items() if k not in exclude]


def trial_weights(panel: DataFrame, key: str, grid: list[dict], by: list[str] = [], only: str | None = None) -> DataFrame:  # noqa: B006
    """The panel once per variant of a rule, told apart by trial_id, with weight in [-1, 1].

    Scores of all variants come from one sort per symbol; then variants are rows, ranked by trial and
    date. only: a column with the one trial_id that its row is wanted for; no other is ranked or held.
    """
    s = get_xs_strategy(key)
    grid = [s.clean(g) for g in grid]
    keys = [*by, "trial_id"]
    if s.score is None:
        n = F.sum(F.col("listed").cast("double")).over(W.partitionBy(*by, "ts"))
        panel = panel.withColumn("weight", F.coalesce(ratio(F.col("listed").cast("double"), n), F.lit(0.0)))
    score = lambda g: F.lit(None).cast("double") if s.score is None else s.score(by, **g)
    variants = F.array(*[F.struct(F.lit(k).alias("trial_id"), score(g).alias("score"), F.lit(float(g.get("long_frac", 0.3))).alias("_frac"), F.lit(int(g["rebalance"])).alias("_every")) for k, g in enumerate(grid)])
    df = panel.withColumn("_all", variants).select(*[c for c in panel.columns if c not in ("trial_id", "score")], F.explode("_all" if only is None else F.filter("_all", lambda v: v["trial_id"] == F.col(only))).alias("_v")).select("*", "_v.*").drop("_v")
    if s.score is not None:
        df = legs_of(df, keys, F.col("_frac"), F.col("_frac"))
    return rebalance_hold(df, keys, F.col("_every")).withColumn("weight", F.coalesce(clip(F.col("weight"), -1, 1), F.lit(0.0))).drop("score", "_frac", "_every")


def with_weights(panel: DataFrame, key: str, params: dict | None = None, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds weight in [-1, 1] by the rule."""
    return trial_weights(panel, key, [params or {}], by).drop("trial_id")
