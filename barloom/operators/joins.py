"""Joins along time: the last row at or before a time, and the intervals that hold it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scans import block_of, scanned


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str = "ts", ties: str | None = None, within: str | None = None, block: Column | str | None = None) -> DataFrame:
    """Rows of `left` with the columns of the last row of `right` at or before their time; null where there is none.

    Both sides are one stream of rows in time, cut into blocks: a row takes the last row of `right`
    in its block, or what the blocks before carry over, so the rows of one busy key are many tasks and
    no side is broadcast. ties: a column that orders rows of `right` of one time, the largest wins.
    within: an interval such as "1 hour" that a match may be old, at most. Null times match nothing;
    keys match as SQL's IS NOT DISTINCT FROM. Columns of `right` that `left` has too, other than keys,
    come with the suffix _right.
    """
    values = [c for c in right.columns if c not in by]
    named = {c: f"{c}_right" if c in left.columns else c for c in values}
    time = right.schema[on].dataType
    key = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    own = left.select(*key, F.col(on).cast(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_own"), F.lit(None).cast(right.select(F.struct(*values).alias("x")).schema["x"].dataType).alias("_found"))
    found = right.filter(F.col(on).isNotNull()).select(*key, F.col(on).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(own.schema["_own"].dataType).alias("_own"), F.struct(*values).alias("_found"))
    if ties is not None:
        own, found = own.withColumn("_tie", F.lit(None).cast(right.schema[ties].dataType)), found.withColumn("_tie", F.col(f"_found.{ties}"))
    both = own.unionByName(found)
    # at one time, rows of `right` come first
    both = both.withColumn("_order", F.struct("_t", "_side", *(["_tie"] if ties is not None else [])))
    names = [f"_k{i}" for i in range(len(by))]
    cut = block_of(both, "_t", block)
    seen = scanned(both, names, {"_last": ("last", F.col("_found"))}, "_order", cut).filter("_side = 1")
    fresh = F.col("_t").isNotNull()
    if within is not None:
        fresh = fresh & (F.col(f"_last.{on}") >= F.col("_t") - F.expr(f"INTERVAL {within}"))
    return seen.select(*[F.col(f"_own.`{c}`").alias(c) for c in left.columns], *[F.when(fresh, F.col(f"_last.`{c}`")).alias(named[c]) for c in values])


#: Lengths of bins are powers of this; an interval is in bins of the least length that is at least its own.
STEP = 8


def interval_join(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str) -> DataFrame:
    """Pairs of a point and an interval [start, end) of the same key that holds it.

    Intervals are cut by bins as long as they are, or up to STEP times longer, so that each is in two
    bins at most, whatever lengths are mixed; a point meets one bin of every length that occurs. Keys
    and bin are an equi-join, shuffled, which AQE splits where a bin is hot; a pair is met once. Rows
    with a null among key, point, start or end match nothing, nor do intervals that end where they
    start or before. Times are whole microseconds or whole numbers. Clashing names but for keys come
    with the suffix _right.
    """
    whole = lambda df, c: F.unix_micros(F.col(c).cast("timestamp")) if df.schema[c].dataType.typeName().startswith(("timestamp", "date")) else F.col(c).cast("bigint")
    named = {c: f"{c}_right" if c in points.columns else c for c in intervals.columns if c not in by}
    iv = intervals.select(*by, *[F.col(c).alias(n) for c, n in named.items()], whole(intervals, start).alias("_from"), whole(intervals, end).alias("_to")).filter("_from < _to")
    # the least power of STEP that is no shorter than the interval
    level = F.lit(0)
    for k in range(1, 21):
        level = F.when(F.col("_to") - F.col("_from") > STEP ** (k - 1), k).otherwise(level)
    iv = iv.withColumn("_level", level)
    bins = lambda x: F.floor(x / F.element_at(F.array(*[F.lit(STEP**k).cast("decimal(20,0)") for k in range(21)]), F.col("_level") + 1)).cast("bigint")
    cut = iv.withColumn("_bin", F.explode(F.sequence(bins(F.col("_from")), bins(F.col("_to") - 1))))
    levels = [r["_level"] for r in iv.select("_level").distinct().orderBy("_level").collect()]  # 21 at most
    seen = points.withColumn("_at", whole(points, at)).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    seen = seen.withColumn("_bin", bins(F.col("_at")))
    met = seen.join(cut, [*by, "_level", "_bin"]).filter("_at >= _from AND _at < _to")
    return met.select(*points.columns, *named.values())
