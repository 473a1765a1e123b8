"""Exact quantiles of large keys, by passes that count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .columns import finite

#: Ranks that the first bracket is wide, as a share of a key's rows; each further pass widens it this many times.
SHARE, WIDER = 1 / 2000, 32


def exact_quantiles(df: DataFrame, by: list[str], c: str, qs: list[float], share: float = SHARE) -> DataFrame:
    """by, q, value, n: quantiles with linear interpolation of the finite values of `c`, as F.percentile has them.

    F.percentile holds all distinct values of a key in one task. Here a mergeable sketch proposes a
    bracket of values around each wanted rank; one pass counts what lies below and inside it, and
    only the distinct values inside, a `share` of the key's rows, are ordered. A key whose bracket
    misses the rank, which the counts show, is bracketed anew, wider, until none is left: the result
    never rests on the sketch's error. Keys without finite values have no row.
    """
    if not all(0 <= q <= 1 for q in qs):
        raise ValueError("quantiles lie between 0 and 1")
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    rows = df.filter(finite(c)).select(F.struct(*keys, F.lit(0).alias("_")).alias("_at"), F.col(c).cast("double").alias("_v"))
    found, left, wide = None, None, share
    while wide < 1:
        ends = [min(max(q + d * wide / 2, 0.0), 1.0) for q in qs for d in (-1, 1)]
        some = rows if left is None else rows.join(left.select("_at").distinct(), "_at", "left_semi")
        sketch = some.groupBy("_at").agg(F.count("*").alias("_n"), F.percentile_approx("_v", ends, F.lit(min(1_000_000, max(1000, int(8 / wide))))).alias("_e"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        brackets = sketch.select("_at", "_n", F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.when(F.lit(ends[2 * k] <= 0), F.col("_low")).otherwise(F.col("_e")[2 * k]).alias("a"), F.when(F.lit(ends[2 * k + 1] >= 1), F.col("_high")).otherwise(F.col("_e")[2 * k + 1]).alias("b")) for k, q in enumerate(qs)])).alias("x")).select("_at", "_n", "x.*")
        brackets = brackets if left is None else brackets.join(left, ["_at", "q"], "left_semi")
        per_key = brackets.groupBy("_at").agg(F.max("_n").alias("_n"), F.collect_list(F.struct("q", "a", "b")).alias("_w"))
        # of each wanted rank: values below its bracket in one sum, those inside by value
        met = some.join(per_key, "_at").select("_at", "_n", "_v", F.explode("_w").alias("w")).filter(F.col("_v") <= F.col("w.b"))
        inside = F.col("_v") >= F.col("w.a")
        counted = met.groupBy("_at", "_n", "w", F.when(inside, F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
        order = W.partitionBy("_at", "w").orderBy(F.col("_v").asc_nulls_first())
        placed = counted.withColumn("_to", F.sum("_c").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("_from", F.col("_to") - F.col("_c"))
        rank = (F.col("_n") - 1) * F.col("w.q")
        low, high = F.floor(rank), F.ceil(rank)
        holds = lambda r: F.max(F.when(F.col("_v").isNotNull() & (F.col("_from") <= r) & (r < F.col("_to")), F.col("_v")))
        ends_at = placed.groupBy("_at", "_n", F.col("w.q").alias("q")).agg(holds(low).alias("_a"), holds(high).alias("_b"))
        rank = (F.col("_n") - 1) * F.col("q")
        value = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((F.ceil(rank) - rank) * F.col("_a") + (rank - F.floor(rank)) * F.col("_b"))
        ends_at = cut(ends_at.withColumn("value", value))  # a row for a key and quantile
        good = ends_at.filter(F.col("value").isNotNull()).select("_at", "q", "value", F.col("_n").alias("n"))
        found = good if found is None else found.unionByName(good)
        left = ends_at.filter(F.col("value").isNull()).select("_at", "q")
        if left.isEmpty():
            break
        wide *= WIDER
    else:
        rest = rows.join(left, "_at") if left is not None else rows.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
        order = W.partitionBy("_at", "q").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
        values = rest.groupBy("_at", "q", "_v").agg(F.count("*").alias("_c")).withColumn("_to", F.sum("_c").over(order))
        total = values.withColumn("_n", F.sum("_c").over(W.partitionBy("_at", "q")))
        rank = (F.col("_n") - 1) * F.col("q")
        pick = lambda r: F.max(F.when((F.col("_to") - F.col("_c") <= r) & (r < F.col("_to")), F.col("_v")))
        last = total.groupBy("_at", "q", "_n").agg(pick(F.floor(rank)).alias("_a"), pick(F.ceil(rank)).alias("_b"))
        last = last.select("_at", "q", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((F.ceil(rank) - rank) * F.col("_a") + (rank - F.floor(rank)) * F.col("_b")).alias("value"), F.col("_n").alias("n"))
        found = last if found is None else found.unionByName(last)
    return found.select(*[F.col(f"_at.{n}").alias(k) for n, k in zip(names, by, strict=True)], "q", "value", "n")
