"""Style factors and a regression of returns on them, with heteroskedasticity-robust errors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cross_sectional import _calm, _momentum, _reversal, legs_of, rebalance_hold, with_weights
from .engine import Costs
from .portfolio import portfolio_returns, run_portfolio

FACTORS = ("market", "momentum", "low_vol", "reversal", "liquidity")


def style_factors(panel: DataFrame, ppy: int = 252) -> DataFrame:
    """factor, ts, bar_idx, net: five cost-free books keyed by factor in one portfolio plan."""
    scores = {
        "momentum": _momentum([], 250, 20), "low_vol": _calm([], 60), "reversal": _reversal([], 5),
        "liquidity": -F.log(F.when(F.col("close") * F.col("volume") > 0, F.col("close") * F.col("volume"))),
    }
    market = with_weights(panel, "equal_weight", {"rebalance": 1}).withColumn("factor", F.lit("market"))
    # the other four are rows of one plan, scored by one sort per symbol
    each = F.array(*[F.struct(F.lit(name).alias("factor"), score.alias("score")) for name, score in scores.items()])
    styles = panel.withColumn("_all", each).select(*panel.columns, F.explode("_all").alias("_v")).select("*", "_v.*").drop("_v")
    books = market.unionByName(rebalance_hold(legs_of(styles, ["factor"]).drop("score"), ["factor"], 21))
    free = Costs(0, 0, 0)
    return portfolio_returns(run_portfolio(books, ["factor"], free, ppy=ppy), ["factor"], free, ppy).select("factor", "ts", "bar_idx", "net")


def attributed(returns: DataFrame, factors: DataFrame, by: list[str], ppy: int = 252, threshold: float = 2.0, least: int = 60) -> DataFrame:
    """by, and a regression of each key's returns (bar_idx, net) on the style factors, with robust errors.

    All keys are one plan: sums of products of a key are a row, solved where it lies (a few numbers a
    row); a second pass over the returns sums the squared errors, joined by key. Factors that do not
    move while a key trades are left out of its regression.
    """
    k = len(FACTORS)
    wide = factors.groupBy("bar_idx").pivot("factor", list(FACTORS)).agg(F.first("net"))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    rows = returns.select(F.struct(*keys, F.lit(0).alias("_")).alias("_at"), "bar_idx", F.col("net").alias("_y")).join(wide, "bar_idx").dropna(subset=["_y", *FACTORS])
    x = [F.lit(1.0), *map(F.col, FACTORS)]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    sums = rows.groupBy("_at").agg(
        F.count("*").alias("n_obs"), F.var_pop("_y").alias("v"), F.array(*[F.stddev_samp(f) for f in FACTORS]).alias("sd"),
        F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("xx"), F.array(*[F.sum(a * F.col("_y")) for a in x]).alias("xy"),
    )

    def square(values) -> np.ndarray:
        out = np.zeros((k + 1, k + 1))
        for (i, j), value in zip(pairs, values, strict=True):
            out[i, j] = out[j, i] = value
        return out

    def solve(batches):
        for b in batches:
            beta, inverse, used = [], [], []
            for xx, xy, sd in zip(b.column("xx").to_pylist(), b.column("xy").to_pylist(), b.column("sd").to_pylist(), strict=True):
                use = np.array([True, *[(s or 0) > 1e-12 for s in sd]])
                inv = np.zeros((k + 1, k + 1))
                inv[np.ix_(use, use)] = np.linalg.pinv(square(xx)[np.ix_(use, use)])
                inverse.append(inv.ravel().tolist())
                beta.append((inv @ np.array(xy)).tolist())
                used.append(use.tolist())
            doubles = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("_at"), b.column("n_obs"), b.column("v"), pa.array(beta, doubles), pa.array(inverse, doubles), pa.array(used, pa.list_(pa.bool_()))], names=["_at", "n_obs", "v", "beta", "inverse", "used"])

    at = rows.schema["_at"].dataType.simpleString()
    fits = sums.mapInArrow(solve, f"_at {at}, n_obs bigint, v double, beta array<double>, inverse array<double>, used array<boolean>")
    e = F.col("_y") - sum((F.col("beta")[i] * a for i, a in enumerate(x)), F.lit(0.0))
    errors = rows.join(fits.select("_at", "beta"), "_at").withColumn("_e", e).groupBy("_at").agg(F.sum(F.col("_e") * F.col("_e")).alias("sse"), F.array(*[F.sum(F.col("_e") * F.col("_e") * x[i] * x[j]) for i, j in pairs]).alias("meat"))

    def report(batches):
        for b in batches:
            t = []
            for inv, meat, beta in zip(b.column("inverse").to_pylist(), b.column("meat").to_pylist(), b.column("beta").to_pylist(), strict=True):
                inv, beta = np.array(inv).reshape(k + 1, k + 1), np.array(beta)
                error = np.sqrt(np.maximum(np.diag(inv @ square(meat) @ inv), 0))
                t.append(np.divide(beta, error, out=np.zeros_like(beta), where=error > 0).tolist())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("_at", "n_obs", "v", "beta", "used", "sse")], pa.array(t, pa.list_(pa.float64()))], names=["_at", "n_obs", "v", "beta", "used", "sse", "t"])

    done = fits.join(errors, "_at").mapInArrow(report, f"_at {at}, n_obs bigint, v double, beta array<double>, used array<boolean>, sse double, t array<double>")
    ok = F.col("n_obs") >= least
    named = lambda c: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f).alias("k"), F.when(F.col("used")[i + 1], F.col(c)[i + 1]).alias("v")) for i, f in enumerate(FACTORS)]), lambda s: s["v"].isNotNull()))
    largest = F.array_max(F.array(*[F.when(F.col("used")[i + 1], F.struct(F.abs(F.col("beta")[i + 1]).alias("size"), F.lit(-i).alias("place"), F.lit(f).alias("name"))) for i, f in enumerate(FACTORS)]))["name"]
    total = F.col("v") * F.col("n_obs")
    out = {
        "alpha_annual": F.col("beta")[0] * ppy, "alpha_t_stat": F.col("t")[0], "alpha_significant": (F.abs(F.col("t")[0]) >= threshold) & (F.col("beta")[0] > 0), "betas": named("beta"), "beta_t_stats": named("t"),
        "r_squared": F.when(total > 0, 1 - F.col("sse") / total).otherwise(0.0), "dominant_factor": largest,
    }
    return done.select(*[F.col(f"_at._k{i}").alias(c) for i, c in enumerate(by)], ok.alias("available"), *[F.when(ok, c).alias(n) for n, c in out.items()], "n_obs")


def factor_attribution(returns: DataFrame, factors: DataFrame, ppy: int = 252, threshold: float = 2.0, least: int = 60) -> dict:
    """The regression of one series."""
    found = attributed(returns, factors, [], ppy, threshold, least).first()
    if found is None or not found["available"]:
        return {"available": False, "n_obs": found["n_obs"] if found else 0}
    return found.asDict()
