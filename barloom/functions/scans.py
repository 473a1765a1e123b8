"""Prefix scans of long keys in many tasks.

A key's rows are cut into blocks along their order. Each block is scanned for itself, in a task of
its own; what goes before a block is worked out from one row a block and joined back to its rows.
Keys and block make one struct, which all steps share: rows are dealt once, by it, and null keys are
keys like any other. The largest thing in one task is a block, or the row a block of one key.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whole numbers of an order that make a block.
BLOCK = 1 << 16
#: Decimal digits that weights may lose inside a run of rows that is scanned in closed form, and the rows of one at most.
DIGITS, RUN = 150, 256


def block_of(df: DataFrame, order: str, block: Column | str | None = None) -> Column:
    """The block of a row: an expression that never falls along the order, or a unit of time; a month or BLOCK whole numbers if none is given."""
    if isinstance(block, Column):
        return block
    kind = df.schema[order].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.date_trunc(block or "month", order)
    if isinstance(kind, T.IntegralType):
        return F.floor(F.col(order) / BLOCK)
    raise ValueError(f"give blocks along {order}: it is neither a time nor a whole number")


def _at(df: DataFrame, by: list[str], order: str, block: Column | str | None) -> DataFrame:
    return df.withColumn("_at", F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], block_of(df, order, block).alias("block")))


def _keys(by: list[str]) -> list[Column]:
    return [F.col(f"_at.k{i}") for i in range(len(by))] or [F.lit(0)]


def _either(f):
    return lambda before, own: F.when(before.isNull(), own).when(own.isNull(), before).otherwise(f(before, own))


#: kind -> (aggregate of a block, of the blocks before, running value inside a block, what joins the two)
KINDS = {
    "sum": (F.sum, F.sum, F.sum, _either(lambda a, b: a + b)),
    "product": (F.product, F.product, F.product, _either(lambda a, b: a * b)),
    "count": (F.count, F.sum, F.count, lambda before, own: F.coalesce(before, F.lit(0)) + own),
    "max": (F.max, F.max, F.max, F.greatest),
    "min": (F.min, F.min, F.min, F.least),
    "last": (None, lambda c: F.last(c, ignorenulls=True), lambda c: F.last(c, ignorenulls=True), lambda before, own: F.coalesce(own, before)),
}


def scanned(df: DataFrame, by: list[str], scans: dict[str, tuple], order: str = "ts", block: Column | str | None = None, ties: str | None = None) -> DataFrame:
    """df with a column for each scan of the rows of its key so far.

    scans: name -> (kind, column); kinds are sum, product, count, max, min, last (the last value that
    is not null) and, with a number of rows as a third part, lag. Nulls are passed over, but for lag.
    ties: a column that orders rows of one time; without it, each step may meet them in another order.
    """
    at = [order] if ties is None else [order, ties]
    lags = {n: s for n, s in scans.items() if s[0] == "lag"}
    plain = {n: s for n, s in scans.items() if s[0] != "lag"}
    x = _at(df.withColumns({f"_v_{n}": F.col(s[1]) if isinstance(s[1], str) else s[1] for n, s in scans.items()}), by, order, block)
    aggs = {n: (F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*at))) if s[0] == "last" else KINDS[s[0]][0](f"_v_{n}")) for n, s in plain.items()}
    blocks = x.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"), *[v.alias(f"_t_{n}") for n, v in aggs.items()])
    earlier = W.partitionBy(*_keys(by)).orderBy("_at.block")
    before = [KINDS[s[0]][1](f"_t_{n}").over(earlier.rowsBetween(W.unboundedPreceding, -1)).alias(f"_b_{n}") for n, s in plain.items()]
    if lags:
        # the last rows of every block; as many blocks back as rows are wanted hold them
        k = max(s[2] for s in lags.values())
        tail = x.withColumn("_back", F.row_number().over(W.partitionBy("_at").orderBy(*[F.col(c).desc() for c in at]))).filter(F.col("_back") <= k)
        tail = tail.groupBy("_at").agg(F.collect_list(F.struct(F.col("_back"), *[F.col(f"_v_{n}") for n in lags])).alias("_rows"))
        blocks = blocks.join(tail.withColumn("_rows", F.reverse(F.array_sort("_rows"))), "_at")
        before.append(F.slice(F.reverse(F.flatten(F.collect_list("_rows").over(earlier.rowsBetween(-k, -1)))), 1, k).alias("_before"))
    table = blocks.select("_at", *before)
    inside = W.partitionBy("_at").orderBy(*at)
    so_far = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    own = {f"_o_{n}": KINDS[s[0]][2](f"_v_{n}").over(so_far) for n, s in plain.items()}
    own |= {f"_o_{n}": F.lag(f"_v_{n}", s[2]).over(inside) for n, s in lags.items()} | ({"_row": F.row_number().over(inside)} if lags else {})
    both = x.withColumns(own).join(table, "_at")
    out = {n: KINDS[s[0]][3](F.col(f"_b_{n}"), F.col(f"_o_{n}")) for n, s in plain.items()}
    out |= {n: F.when(F.col("_row") > s[2], F.col(f"_o_{n}")).otherwise(F.get("_before", F.lit(s[2]) - F.col("_row"))[f"_v_{n}"]) for n, s in lags.items()}
    return both.select(*[c for c in df.columns if c not in out], *[v.alias(n) for n, v in out.items()])


def averaged(df: DataFrame, by: list[str], emas: Iterable[tuple], order: str = "ts", block: Column | str | None = None) -> DataFrame:
    """df with exponential averages: (name, column, alpha, adjust, least values) each, as pandas' ewm has them.

    A row is an affine map of the average before it: a known value pulls it towards itself, a
    missing one only lets the old value's weight decay. The maps of a run of rows compose in closed
    form (a running product and a running sum), runs compose to a block and blocks to a key by
    folding one small array each. With `adjust` two sums, of values and of weights, are such scans.
    """
    emas = [e for e in emas]
    x = _at(df, by, order, block)
    inside = W.partitionBy("_at").orderBy(order)
    sources = list(dict.fromkeys(e[1] for e in emas))
    num = {s: k for k, s in enumerate(sources)}
    x = x.withColumns({"_row": F.row_number().over(inside)} | {f"_x{num[s]}": (v := F.col(s).cast("double")) * F.when(~F.isnan(v), 1.0) for s in sources})
    known = {s: F.col(f"_x{num[s]}").isNotNull() for s in sources}
    till, past = inside.rowsBetween(W.unboundedPreceding, W.currentRow), inside.rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumns({f"_n{num[s]}": F.count(f"_x{num[s]}").over(till) for s in sources} | {f"_p{num[s]}": F.last(F.when(known[s], F.col("_row")), ignorenulls=True).over(past) for s in sources})
    slow = [1 - e[2] for e in emas if e[2] < 1]
    run = min([RUN, *[max(1, int(DIGITS / -math.log10(q))) for q in slow]])
    x = x.withColumn("_run", F.floor((F.col("_row") - 1) / run))
    # one affine map a row and scan; scans: (number of the average, suffix, column of a, of b)
    scans: list[str] = []
    maps: dict[str, Column] = {}
    for i, (_, s, alpha, adjust, _) in enumerate(emas):
        v, q = F.col(f"_x{num[s]}"), max(1 - alpha, 0.0)
        if alpha >= 1:
            continue
        if adjust:
            maps |= {f"_a{i}v": F.lit(q), f"_b{i}v": F.coalesce(v, F.lit(0.0)), f"_a{i}w": F.lit(q), f"_b{i}w": known[s].cast("double")}
            scans += [f"{i}v", f"{i}w"]
        else:
            decayed = F.greatest(F.pow(F.lit(q), F.col("_row") - F.col(f"_p{num[s]}")), F.lit(1e-100))
            live = known[s] & F.col(f"_p{num[s]}").isNotNull()
            # the block's first value is where its map begins
            maps |= {f"_a{i}v": F.when(live, decayed / (decayed + alpha)).otherwise(1.0), f"_b{i}v": F.when(live, alpha * v / (decayed + alpha)).otherwise(0.0)}
            scans.append(f"{i}v")
    x = x.withColumns(maps)
    runs = W.partitionBy("_at", "_run").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    x = x.withColumns({f"_A{k}": F.product(f"_a{k}").over(runs) for k in scans})
    x = x.withColumns({f"_S{k}": F.sum(F.col(f"_b{k}") / F.col(f"_A{k}")).over(runs) for k in scans})
    lasts = {f"_l{num[s]}": F.last(f"_x{num[s]}", ignorenulls=True).over(till) for s in {e[1] for e in emas if e[2] >= 1}}
    x = x.withColumns(lasts) if lasts else x

    ends = x.groupBy("_at", "_run").agg(
        F.max("_row").alias("row"), *[F.max_by(F.struct(F.col(f"_A{k}").alias("a"), (F.col(f"_A{k}") * F.col(f"_S{k}")).alias("b")), "_row").alias(f"m{k}") for k in scans],
        *[F.min(F.when(known[s], F.struct(F.col("_row").alias("row"), F.col(f"_x{num[s]}").alias("x")))).alias(f"first{num[s]}") for s in sources],
        *[F.max(F.when(known[s], F.struct(F.col("_row").alias("row"), F.col(f"_x{num[s]}").alias("x")))).alias(f"last{num[s]}") for s in sources],
        *[F.count(f"_x{num[s]}").alias(f"n{num[s]}") for s in sources],
    )
    # the map in front of every run, and the block's own
    folded = lambda k: F.expr(
        f"aggregate(transform(array_sort(runs), r -> r.m{k}), named_struct('a', 1D, 'b', 0D, 'out', CAST(array() AS array<struct<a:double,b:double>>)), "
        "(acc, m) -> named_struct('a', m.a * acc.a, 'b', m.a * acc.b + m.b, 'out', concat(acc.out, array(named_struct('a', acc.a, 'b', acc.b)))))"
    )
    per = ends.groupBy("_at").agg(
        F.max("row").alias("rows"), F.collect_list(F.struct("_run", *[f"m{k}" for k in scans])).alias("runs"), *[F.min(f"first{num[s]}").alias(f"first{num[s]}") for s in sources],
        *[F.max(f"last{num[s]}").alias(f"last{num[s]}") for s in sources], *[F.sum(f"n{num[s]}").alias(f"n{num[s]}") for s in sources],
    )
    per = per.withColumns({f"f{k}": folded(k) for k in scans}).drop("runs")

    # blocks of a key in order: the value that each begins with, and the one at its first known row
    kind = x.schema["_at"].dataType["block"].dataType.simpleString()
    fields = [f"{c}{i}:double" for i in range(len(emas)) for c in "uv"] + [f"n{num[s]}:bigint" for s in sources]
    after, shown = {}, {}
    for i, (_, s, alpha, adjust, _) in enumerate(emas):
        k, y, w = num[s], f"acc.y{i}", "0D"
        shown[f"u{i}"], shown[f"v{i}"] = y, "CAST(NULL AS DOUBLE)"
        if alpha >= 1:
            y = f"coalesce(b.last{k}.x, {y})"
        elif adjust:
            shown[f"u{i}"], shown[f"v{i}"] = f"coalesce({y}, 0D)", f"acc.w{i}"
            y, w = f"b.f{i}v.a * coalesce({y}, 0D) + b.f{i}v.b", f"b.f{i}w.a * acc.w{i} + b.f{i}w.b"
        else:
            q = f"greatest(pow({1 - alpha!r}D, acc.gap{k} + b.first{k}.row), 1e-100D)"
            begin = f"CASE WHEN {y} IS NULL THEN b.first{k}.x ELSE ({q} * {y} + {alpha!r}D * b.first{k}.x) / ({q} + {alpha!r}D) END"
            shown[f"v{i}"] = begin
            y = f"CASE WHEN b.first{k} IS NULL THEN {y} ELSE b.f{i}v.a * ({begin}) + b.f{i}v.b END"
        after[f"y{i}"], after[f"w{i}"] = y, w
    for s in sources:
        k = num[s]
        shown[f"n{k}"] = f"acc.n{k}"
        after[f"gap{k}"] = f"CAST(CASE WHEN b.last{k} IS NULL THEN acc.gap{k} + b.rows ELSE b.rows - b.last{k}.row END AS BIGINT)"
        after[f"n{k}"] = f"CAST(acc.n{k} + b.n{k} AS BIGINT)"
    zero = {c: "CAST(NULL AS DOUBLE)" if c[0] == "y" else "0D" if c[0] == "w" else "0L" for c in after} | {"out": f"CAST(array() AS array<struct<at:{kind},{','.join(fields)}>>)"}
    record = lambda d: "named_struct(" + ", ".join(f"'{c}', {v}" for c, v in d.items()) + ")"
    put = f"concat(acc.out, array({record({'at': 'b.at'} | {f.split(':')[0]: shown[f.split(':')[0]] for f in fields})}))"
    walked = F.expr(f"aggregate(blocks, {record(zero)}, (acc, b) -> {record(after | {'out': put})}).out")

    of_key = per.select("_at", F.col("_at.block").alias("at"), "rows", *[F.struct(F.col(f"f{k}.a").alias("a"), F.col(f"f{k}.b").alias("b")).alias(f"f{k}") for k in scans], *[c for s in sources for c in (f"first{num[s]}", f"last{num[s]}", f"n{num[s]}")])
    keys = [c.alias(f"_k{i}") for i, c in enumerate(_keys(by))]
    folded_keys = of_key.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[c for c in of_key.columns if c != "_at"]))).alias("blocks"))
    opened = folded_keys.select(*[f"_k{i}" for i in range(len(keys))], F.explode(walked).alias("_o"))
    opened = opened.select(F.struct(*[F.col(f"_k{i}").alias(f"k{i}") for i in range(len(by))], F.col("_o.at").alias("block")).alias("_at"), "_o")
    table = opened.join(per.select("_at", *[F.col(f"f{k}.out").alias(f"_f{k}") for k in scans]), "_at")
    both = x.join(table, "_at")
    out = {}
    for i, (name, s, alpha, adjust, least) in enumerate(emas):
        k, v = num[s], F.col(f"_x{num[s]}")
        at = lambda c: F.get(f"_f{c}", F.col("_run").cast("int"))
        value = lambda c, begin: F.col(f"_A{c}") * (at(c)["a"] * begin + at(c)["b"] + F.col(f"_S{c}"))
        if alpha >= 1:
            y = F.coalesce(F.col(f"_l{k}"), F.col(f"_o.u{i}"))
        elif adjust:
            y = value(f"{i}v", F.col(f"_o.u{i}")) / value(f"{i}w", F.col(f"_o.v{i}"))
        else:
            y = F.when(F.col(f"_n{k}") > 0, value(f"{i}v", F.col(f"_o.v{i}"))).otherwise(F.col(f"_o.u{i}"))
        # an average of equal values is that value
        y = F.when(F.abs(y - v) <= F.abs(v) * 4e-14, v).otherwise(y)
        out[name] = F.when(F.col(f"_n{k}") + F.col(f"_o.n{k}") >= max(least, 1), y)
    return both.select(*[c for c in df.columns if c not in out], *[v.alias(n) for n, v in out.items()])

