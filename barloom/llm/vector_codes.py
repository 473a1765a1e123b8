"""Compression of vectors into codes of their parts, by codebooks that Lloyd's rounds fit on all vectors.

Components become integers, so every distance and every mean is exact and no order of summing
matters. A vector's row holds, for each of its parts, the entry it is assigned to and the exact
distance to it. In a later round a part whose entry has not moved knows that no other resting entry
is nearer (or as near with a lower index): it meets the moved entries alone. The other parts are
held against their whole codebook. Tasks add up the parts of each entry and give one row an entry;
only codebooks, entries x components, reach the driver and go to the tasks.

Defined results: vectors that are null, hold null or non-finite components, or components too large
for 64-bit distances (about 2**22 / sqrt(length) and more), are dropped; each length has codebooks of
its own, and one that parts do not divide is filled up with zeros; null vec_ids come last in the
order of starting entries, rows that repeat a vec_id are ordered by their vectors; fewer vectors than
entries make a smaller codebook; null labels are one label; sums beyond a long are null; an empty
table gives an empty frame; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_path, join_by_size, new_path

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are handled at once.
STEP = 4096


def usable(e: Column, scale: int) -> Column:
    """Every component is there, finite, and small enough for sums of squared differences in 64 bits."""
    most = F.lit(float(1 << 30) / scale) / F.sqrt(F.greatest(F.size(e), F.lit(1)))
    return e.isNotNull() & F.coalesce(F.forall(e, lambda x: x.isNotNull() & (F.abs(x) <= most)), F.lit(False))


def part_size(dims: int, parts: int) -> int:
    return -(-dims // parts)


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer entries: in doubles where these hold them whole."""
    if not x.shape[1] or not len(x):
        return np.zeros((len(x), len(book)), np.int64)
    top = max(int(np.abs(x).max()), int(np.abs(book).max()))
    if 4 * x.shape[1] * top * top < 1 << 53:
        x, book = x.astype(np.float64), book.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)[None, :]).astype(np.int64)
    away = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        away += (x[:, k, None] - book[None, :, k]) ** 2
    return away


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, distance) of each row; ties go to the lower index."""
    d = squares(x, book)
    code = d.argmin(axis=1)
    return code, d[np.arange(len(x)), code]


def reassigned(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, distance) after some entries have moved, from the assignment before."""
    code, dist = code.copy(), dist.copy()
    rest = ~moved[code]
    again = np.flatnonzero(~rest)
    code[again], dist[again] = nearest(x[again], book)
    active, still = np.flatnonzero(moved), np.flatnonzero(rest)
    if len(active) and len(still):
        near, d = nearest(x[still], book[active])
        near = active[near]
        better = (d < dist[still]) | ((d == dist[still]) & (near < code[still]))
        code[still[better]], dist[still[better]] = near[better], d[better]
    return code, dist


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of integers that `narrow` has packed."""
    out = np.empty((len(column), dims), np.int64)
    raw = column.to_pylist()
    width = np.array([len(r) for r in raw])
    for w in (2, 4, 8):
        some = np.flatnonzero(width == w * dims)
        if len(some) and dims:
            out[some] = np.frombuffer(b"".join([raw[k] for k in some]), f"<i{w}").reshape(-1, dims)
    return out


def narrow(row: np.ndarray) -> bytes:
    top = int(np.abs(row).max()) if len(row) else 0
    return row.astype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8").tobytes()


def whole_numbers(embeddings: DataFrame, parts: int, scale: int, label: str) -> DataFrame:
    """vec_id, label, dims, ints of the usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(2)
            n = np.diff(column.offsets.to_numpy())
            values = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(n)
            out = []
            for e, k in zip(ends.tolist(), n.tolist(), strict=True):
                row = np.zeros(part_size(k, parts) * parts, np.int64)
                row[:k] = np.floor(scale * values[e - k : e])
                out.append(narrow(row))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([part_size(k, parts) * parts for k in n.tolist()], pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "label", "dims", "ints"])

    e = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(label).alias("label"), e.alias("e")).filter(usable(F.col("e"), scale))
    return rows.mapInArrow(run, f"vec_id bigint, label {rows.schema['label'].dataType.simpleString()}, dims int, ints binary")


def by_length(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = b.column("dims").to_numpy()
    for d in np.unique(dims).tolist():
        own = b if (dims == d).all() else b.take(pa.array(np.flatnonzero(dims == d)))
        for at in range(0, own.num_rows, STEP):
            yield d, own.slice(at, STEP)


Books = dict  # dims -> entries x components of all parts


def assigned(rows: DataFrame, books: Books, parts: int, moved: Books | None = None) -> DataFrame:
    """`rows` with the entries (a byte each) and distances of their parts; `moved` tells which entries of each part have moved since."""
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, part in by_length(b):
                x, book, size = matrix(part.column("ints"), d), books[d], d // parts
                code, dist = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
                if moved is not None:
                    code[:] = np.frombuffer(b"".join(part.column("codes").to_pylist()), "<u2").reshape(-1, parts)
                    dist[:] = np.frombuffer(b"".join(part.column("dists").to_pylist()), "<i8").reshape(-1, parts)
                for p in range(parts):
                    own, entries = x[:, p * size : (p + 1) * size], book[:, p * size : (p + 1) * size]
                    code[:, p], dist[:, p] = nearest(own, entries) if moved is None else reassigned(own, entries, moved[d][p], code[:, p], dist[:, p])
                packed = [pa.array([r.tobytes() for r in code.astype("<u2")], pa.binary()), pa.array([r.tobytes() for r in dist.astype("<i8")], pa.binary())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("vec_id", "label", "dims", "ints")], *packed], names=["vec_id", "label", "dims", "ints", "codes", "dists"])

    return rows.mapInArrow(run, f"vec_id bigint, label {label}, dims int, ints binary, codes binary, dists binary")


def means(rows: DataFrame, books: Books, parts: int) -> Books:
    """Codebooks whose entries are the floored means of what is assigned to them; unused ones stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for b in batches:
            for d, part in by_length(b):
                k, size = len(books[d]), d // parts
                total, n = sums.setdefault(d, np.zeros((k, d), np.int64)), counts.setdefault(d, np.zeros((k, parts), np.int64))
                x = matrix(part.column("ints"), d)
                code = np.frombuffer(b"".join(part.column("codes").to_pylist()), "<u2").reshape(-1, parts)
                for p in range(parts):
                    order = np.argsort(code[:, p], kind="stable")
                    here = code[order, p]
                    begin = np.flatnonzero(np.diff(here.astype(np.int64), prepend=-1))
                    n[:, p] += np.bincount(here, minlength=k)
                    if size:
                        total[here[begin], p * size : (p + 1) * size] += np.add.reduceat(x[order, p * size : (p + 1) * size], begin, axis=0)
        for d, total in sums.items():
            k = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, d, np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(list(counts[d]), pa.list_(pa.int64())), pa.array(list(total), pa.list_(pa.int64()))], names=["dims", "entry", "n", "total"]
            )

    made = rows.select("dims", "ints", "codes").mapInArrow(run, "dims int, entry int, n array<bigint>, total array<bigint>")
    each = made.select("dims", "entry", F.posexplode(F.transform("total", lambda v, i: F.struct(v.alias("v"), F.get("n", F.floor(i / (F.col("dims") / parts)).cast("int")).alias("n")))).alias("at", "x"))
    found = each.groupBy("dims", "entry", "at").agg(F.sum(F.col("x.v").cast("decimal(38,0)")).alias("v"), F.sum("x.n").alias("n")).filter("n > 0").collect()  # a row for a component of a codebook
    out = {d: book.copy() for d, book in books.items()}
    for r in found:
        out[r["dims"]][r["entry"], r["at"]] = int(r["v"]) // int(r["n"])
    return out


def starting(rows: DataFrame, entries: int) -> Books:
    """The first vectors of each length by vec_id."""
    out = {}
    for r in rows.groupBy("dims").count().orderBy("dims").collect():  # a job for a length
        d = r["dims"]
        first = rows.filter(F.col("dims") == d).orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").toArrow()
        out[d] = matrix(first.column("ints").combine_chunks(), d)
    return out


def digest(book: np.ndarray, parts: int) -> str:
    """SHA-256 of all components in decimal by part, entry and place."""
    size = book.shape[1] // parts
    return hashlib.sha256(",".join(str(v) for p in range(parts) for v in book[:, p * size : (p + 1) * size].ravel().tolist()).encode()).hexdigest()


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, label: str = "label") -> tuple[DataFrame, Books]:
    """(vec_id, label, dims, codes, dists of each part, of all usable vectors; the codebooks) after `rounds` rounds."""
    if not 0 < entries <= 1 << 16:
        raise ValueError("a codebook has 1 to 65,536 entries")
    spark = embeddings.sparkSession
    source = new_path(spark, "vector-ints")
    rows = cut(whole_numbers(embeddings, parts, scale, label), "vector-ints", source)
    books = starting(rows, entries)
    path = new_path(spark, "vector-codes")
    state = cut(assigned(rows, books, parts), "vector-codes", path)
    drop_path(spark, source)
    for _ in range(rounds):
        after = means(state, books, parts)
        moved = {d: (after[d] != books[d]).reshape(len(after[d]), parts, -1).any(axis=2).T for d in after}
        books = after
        if not any(m.any() for m in moved.values()):
            break  # at rest: no assignment can change
        new = new_path(spark, "vector-codes")
        state = cut(assigned(state, books, parts, moved), "vector-codes", new)
        drop_path(spark, path)
        path = new
    return state, books


def code_table(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of all usable vectors."""
    state, books = compressed(embeddings, parts, entries, rounds, scale, label)
    digests = {d: digest(book, parts) for d, book in books.items()}
    digits = 2 if entries <= 256 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = np.frombuffer(b"".join(b.column("codes").to_pylist()), "<u2").reshape(-1, parts)
            names = [(r.astype(np.uint8) if digits == 2 else r.astype(">u2")).tobytes().hex() for r in code]
            error = np.frombuffer(b"".join(b.column("dists").to_pylist()), "<i8").reshape(-1, parts).sum(axis=1)
            of = [digests[d] for d in b.column("dims").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(names, pa.string()), pa.array(error), pa.array(of, pa.string())], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    kind = state.schema["label"].dataType.simpleString()
    rows = state.select("vec_id", "label", "dims", "codes", "dists").mapInArrow(run, f"vec_id bigint, label {kind}, code string, error bigint, codebooks_sha256 string")
    rows = cut(rows.withColumn("of", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))).drop("label"), "vector-errors")
    sums = rows.groupBy("of").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("size"))
    sums = cut(sums.select("of", "size", F.expr("try_cast(sum AS bigint)").alias("label_error")), "label-errors")
    return join_by_size(rows, sums, "of", "size", rows.count()).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_table(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
size AS (SELECT max(len(v)) // 16 AS n FROM v),
x AS (SELECT vec_id, label, p, v[p * n + 1 : (p + 1) * n] AS x FROM v, size, range(16) AS r(p)),
c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM x WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
a0 AS (SELECT vec_id, label, x.p, any_value(x) AS x, min(64 * CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) + e) AS m FROM x JOIN c0 ON x.p = c0.p GROUP BY vec_id, label, x.p),
s0 AS (SELECT p, m % 64 AS e, i, CAST(floor(sum(x[i + 1]) / count(*)) AS BIGINT) AS y FROM a0, size, range(64) AS r(i) WHERE i < n GROUP BY p, e, i),
c1 AS (SELECT c0.p, c0.e, coalesce(any_value(t.c), any_value(c0.c)) AS c FROM c0 LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS c FROM s0 GROUP BY p, e) t ON c0.p = t.p AND c0.e = t.e GROUP BY c0.p, c0.e),
a1 AS (SELECT vec_id, label, x.p, any_value(x) AS x, min(64 * CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) + e) AS m FROM x JOIN c1 ON x.p = c1.p GROUP BY vec_id, label, x.p),
s1 AS (SELECT p, m % 64 AS e, i, CAST(floor(sum(x[i + 1]) / count(*)) AS BIGINT) AS y FROM a1, size, range(64) AS r(i) WHERE i < n GROUP BY p, e, i),
c2 AS (SELECT c1.p, c1.e, coalesce(any_value(t.c), any_value(c1.c)) AS c FROM c1 LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS c FROM s1 GROUP BY p, e) t ON c1.p = t.p AND c1.e = t.e GROUP BY c1.p, c1.e),
a2 AS (SELECT vec_id, label, x.p, min(64 * CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) + e) AS m FROM x JOIN c2 ON x.p = c2.p GROUP BY vec_id, label, x.p),
sha AS (SELECT sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2),
r AS (SELECT vec_id, label, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, sha
"""
