"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Each document gets a rate exp(lambda * size / mean) of its source, capped at the most copies
allowed: the distribution nearest to one copy of everything (in relative entropy) whose words sum
to the source's target. lambda solves the convex dual; its derivative sums over all documents, so
each Newton step is one grouped aggregate, and the state of every source is a row of a small
table. Rates become whole copies by systematic rounding along a descending order of sizes (the
error of a run of documents is below its largest document) and repairs: copies of as many documents
at once as fit into what a source lacks or has too many, then single ones, until none brings it
nearer to its target. Repairs are chosen on the counts of sizes; documents are read once more, to
carry them out.

Defined results: null text has size 0; null source is a source of its own, last; documents
without words take 0; a source without words has target 0; an empty table returns an empty frame;
repeated rows are documents of their own. Other columns, whatever their names, are ignored by `mix`
and kept by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, drop_path, free_names, join_by_size, new_path, small, text_col

WEIGHTS = (5, 2, 1)
POOL = 1.5
MOST = 2
#: Rows that one ordered run of the rounding holds, about.
RUN = 5000


def key_of(source: str) -> Column:
    """A source as text that sorts by code point, null after all others and unlike any of them."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("t"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, key, size, same (hash of the text), row (a number of the row's own)."""
    return docs.select(
        "doc_id", "source", key_of("source").alias("key"), F.regexp_count(text_col(), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text_col()).alias("same"), F.monotonically_increasing_id().alias("row"),
    )


def ordered(df: DataFrame, order: list, **sums) -> DataFrame:
    """df with `place`, the rank of a row, and the named sums up to it, by ranges of the order; only a row per range is in one task."""
    df = cut(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranges")
    sums = {"place": F.lit(1)} | sums
    each = df.groupBy("range_").agg(*[F.sum(x).alias(f"{k}_before") for k, x in sums.items()])
    earlier = W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    before = each.select("range_", *[F.coalesce(F.sum(f"{k}_before").over(earlier), F.lit(0)).alias(f"{k}_before") for k in sums])
    upto = W.partitionBy("range_").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    added = [(F.col(f"{k}_before") + F.sum(x).over(upto)).alias(k) for k, x in sums.items()]
    return df.join(before, "range_").select(*[c for c in df.columns if c != "range_"], *added)


def source_targets(rows: DataFrame, weights=WEIGHTS, pool: float = POOL, most: float = MOST) -> DataFrame:
    """key, source_size, n, target: the pool shared by weight, no source above `most` times its size.

    The level t at which sum(min(most * size, weight * t)) meets the pool is found from prefix sums
    over the order in which sources reach their limit, which is where resharing the excess again and
    again ends.
    """
    s = ordered(rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("n")), [F.col("key")])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.select("key", "source_size", "n", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap"))
    s = cut(s.withColumn("reached", F.col("cap") / F.col("weight")), "sources")
    total, all_weights = s.agg(F.sum("source_size"), F.sum("weight")).first()
    o = ordered(s, [F.col("reached"), F.col("key")], caps=F.col("cap"), weights=F.col("weight"))
    t = (F.lit(float(pool) * (total or 0)) - (F.col("caps") - F.col("cap"))) / (F.lit(all_weights or 0.0) - (F.col("weights") - F.col("weight")))
    level = o.withColumn("t", t).filter(F.col("cap") >= F.col("weight") * F.col("t")).agg(F.min_by("t", "place")).first()[0]
    share = F.col("cap") if level is None else F.least(F.col("cap"), F.col("weight") * F.lit(float(level)))
    return s.select("key", "source_size", "n", share.alias("target"))


def tilts(hist: DataFrame, sources: DataFrame, most: float = MOST, steps: int = 60, within: float = 1e-9) -> DataFrame:
    """Adds mean and lam to `sources`. hist: key, size, c (documents of that size). Newton steps, bracketed by bisection."""
    spark = hist.sparkSession
    mean = F.col("source_size") / F.col("n")
    grows, full = F.col("target") >= F.col("source_size"), F.col("target") >= F.col("source_size") * (float(most) * (1 - 1e-12))
    state = sources.filter("target > 0 and source_size > 0").select(
        "*", mean.alias("mean"),
        F.when(grows, F.lit(0.0)).otherwise(mean * F.log(F.col("target") / F.col("source_size"))).alias("lo"),
        F.when(grows, mean * F.log(F.lit(float(most)))).otherwise(F.lit(0.0)).alias("hi"),
        # a source at its limit takes all it has `most` times: there is nothing to solve
        F.when(full, mean * F.log(F.lit(float(most)))).otherwise(F.lit(0.0)).alias("lam"), full.alias("done"),
    )
    path = new_path(spark, "tilt")
    state = cut(state, "tilt", path)
    names = [c for c in state.columns if c not in ("lo", "hi", "lam", "done")]
    for _ in range(steps):
        x = F.col("lam") * F.col("size") / F.col("mean")
        free = x < F.log(F.lit(float(most)))
        rate = F.when(free, F.exp(x)).otherwise(F.lit(float(most)))
        words = F.col("c") * F.col("size")
        sums = hist.join(state.filter(~F.col("done")).select("key", "lam", "mean"), "key").groupBy("key").agg(
            F.sum(words * rate).alias("got"), F.sum(F.when(free, words * F.col("size") / F.col("mean") * F.exp(x)).otherwise(F.lit(0.0))).alias("slope")
        )
        over = F.col("got") - F.col("target")
        lo, hi = F.when(over < 0, F.col("lam")).otherwise(F.col("lo")), F.when(over > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - F.try_divide(over, F.col("slope"))
        step = F.when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        settled = F.col("done") | (F.abs(over) <= F.col("target") * within)
        moved = state.join(sums, "key", "left").select(
            *names, F.when(F.col("done"), F.col("lo")).otherwise(lo).alias("lo"), F.when(F.col("done"), F.col("hi")).otherwise(hi).alias("hi"),
            F.when(settled, F.col("lam")).otherwise(step).alias("lam"), settled.alias("done"),
        )
        after = new_path(spark, "tilt")
        state = cut(moved, "tilt", after)
        drop_path(spark, path)
        path = after
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.select(*names, "lam")


def repairs(cells: DataFrame, most: int) -> DataFrame:
    """key, size, n, total: the sizes of documents whose copies, `total` of all n documents together, have to change.

    cells: key, size, n, total, target (of the source). A source that lacks words (or has too many)
    takes copies along falling sizes, of each size as many at once as are there and fit into what
    is still lacking; what remains is below half of it, so a few rounds end with no size that
    fits. Then the one copy that brings the source nearest is taken, and the search goes on until
    none brings it nearer.
    """
    spark = cells.sparkSession
    path = new_path(spark, "cells")
    now = cut(cells.withColumn("was", F.col("total")), "cells", path)
    while True:
        gaps = now.groupBy("key").agg((F.first("target") - F.sum(F.col("total") * F.col("size"))).alias("gap"))
        x = now.join(small(cut(gaps, "gaps")), "key")
        room = F.when(F.col("gap") > 0, most * F.col("n") - F.col("total")).otherwise(F.col("total"))
        x = x.withColumns({"off": F.abs("gap"), "room": room})
        fits = F.col("size") <= F.col("off")
        before = F.coalesce(F.sum(F.when(fits, F.col("room") * F.col("size"))).over(W.partitionBy("key").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        bulk = F.when(fits, F.greatest(F.lit(0), F.least(F.col("room"), F.floor((F.col("off") - before) / F.col("size"))))).otherwise(0)
        x = x.withColumn("bulk", bulk)
        left = F.abs(F.col("off") - F.col("size"))
        one = F.when((F.col("room") > 0) & (left < F.col("off")), F.struct(left.alias("left"), F.col("size").alias("size")))
        best = x.groupBy("key").agg(F.max("bulk").alias("any"), F.min(one).alias("one"))
        x = x.join(small(cut(best, "best")), "key")
        step = F.when(F.col("any") > 0, F.col("bulk")).when(F.col("size") == F.col("one.size"), 1).otherwise(0)
        moved = x.select("key", "size", "n", "target", "was", (F.col("total") + F.signum("gap").cast("int") * step).cast("bigint").alias("total"), (step > 0).alias("moved"))
        after = new_path(spark, "cells")
        now = cut(moved, "cells", after)
        drop_path(spark, path)
        path = after
        if now.filter("moved").isEmpty():
            return now.filter("total <> was").select("key", "size", "n", "total")
        now = now.drop("moved")


def _mix(docs: DataFrame, weights=WEIGHTS, pool: float = POOL, most: int = MOST) -> DataFrame:
    """doc_id, source, same, size, source_size, target, rate, copies for each row of `docs`."""
    rows = cut(sizes(docs), "sizes")
    total = rows.count()
    targets = cut(source_targets(rows, weights, pool, most), "targets")
    hist = cut(rows.filter("size > 0").groupBy("key", "size").agg(F.count("*").alias("c")), "hist")
    tilted = tilts(hist, targets, most)
    sources = cut(targets.join(tilted.select("key", "mean", "lam"), "key", "left"), "tilted")

    rate = F.coalesce(F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.log(F.lit(float(most)))))), F.lit(0.0))
    # runs: size classes of a factor 2 ** (1/4), dealt into as many parts as their rows need
    step = F.floor(F.log2("size") * 4).cast("int")
    parts = hist.withColumn("step", step).groupBy("key", "step").agg(F.sum("c").alias("of_step"), F.ceil(F.sum("c") / RUN).alias("parts"))
    parts = cut(parts.join(sources.select("key", "source_size", "target", "mean", "lam"), "key"), "parts")
    # rows without an id differ by their own number
    draw = lambda seed: F.xxhash64("doc_id", "same", F.when(F.col("doc_id").isNull(), F.col("row")), F.lit(seed))
    placed = join_by_size(rows.filter("size > 0").withColumn("step", step), parts, ["key", "step"], "of_step", total)
    placed = cut(placed.withColumns({"rate": rate, "h": draw(1), "part": F.pmod(draw(2), F.col("parts"))}).drop("mean", "lam", "parts", "of_step"), "placed")
    totals = placed.groupBy("key", "step", "part").agg(F.sum("rate").alias("r"))
    runs = totals.withColumn("before", F.coalesce(F.sum("r").over(W.partitionBy("key").orderBy(F.desc("step"), "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).drop("r")
    order = W.partitionBy("key", "step", "part").orderBy(F.desc("size"), "h", "row")
    upto = F.col("before") + F.sum("rate").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    copies = F.least(F.lit(most), F.greatest(F.lit(0), (F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - F.col("rate") + 0.5)).cast("int")))
    done = cut(placed.join(runs, ["key", "step", "part"]).withColumn("upto", upto).withColumn("copies", copies).drop("before", "upto", "step", "part"), "copies")
    fixes = small(repairs(done.groupBy("key", "size").agg(F.count("*").alias("n"), F.sum("copies").alias("total"), F.first("target").alias("target")), most))
    # documents of one size have one rate: their copies are dealt evenly, the odd ones to the first of them
    chosen = ordered(done.join(fixes, ["key", "size"]).select("key", "size", "h", "row", "n", "total"), ["key", "size", "h", "row"])
    firsts = small(cut(chosen.groupBy("key", "size").agg(F.min("place").alias("first")), "firsts"))
    nth = F.col("place") - F.col("first")
    chosen = chosen.join(firsts, ["key", "size"]).select("row", (F.floor(F.col("total") / F.col("n")) + (nth < F.pmod("total", "n")).cast("int")).cast("int").alias("dealt"))
    done = done.join(small(cut(chosen, "chosen")), "row", "left").withColumn("copies", F.coalesce("dealt", "copies")).drop("dealt")
    cols = ["doc_id", "source", "same", "size", "source_size", "target", "rate", "copies"]
    none = rows.filter("size = 0").groupBy("key").agg(F.count("*").alias("none")).join(sources, "key")
    empty = join_by_size(rows.filter("size = 0"), none, "key", "none", total).withColumns({"rate": F.lit(0.0), "copies": F.lit(0)})
    return done.select(cols).unionByName(empty.select(cols))


def mix(docs: DataFrame, weights=WEIGHTS, pool: float = POOL, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for each row of `docs` (doc_id, source, text)."""
    return _mix(docs, weights, pool, most).drop("same").withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, all columns, each as many times as the mix takes it."""
    own = free_names(docs.columns, "of", "from", "like", "rank", "copies", "copy")
    of, origin, like, rank, copies, copy = own
    keys = lambda df, same: df.withColumns({of: F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), origin: key_of("source"), like: same})
    # rows that repeat id, source and text are told apart by their rank; any of them may have any one's copies
    at = W.partitionBy(of, origin, like)
    ranked = keys(docs, F.xxhash64(text_col())).withColumn(rank, F.row_number().over(at.orderBy(like)))
    taken = keys(_mix(docs, **how).filter("copies > 0").select("doc_id", "source", "same", F.col("copies").alias(copies)), F.col("same"))
    taken = taken.withColumn(rank, F.row_number().over(at.orderBy(F.desc(copies)))).select(of, origin, like, rank, copies)
    return ranked.join(taken, [of, origin, like, rank]).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
