"""Near-duplicate vectors by an inverted multi-index.

Each half of the unit vectors has a codebook of its own, fitted on a bounded sample; pairs of codes
form a grid of cells, and every vector is in one. A vector visits the cells nearest to it, in the
order of its summed distances to both codes (the multi-sequence order), and is compared with all
vectors of each cell it visits, by cosine in double precision. How many cells are visited is fitted
to a target recall on pairs made at the threshold itself, so that it holds where links are rare, and
on the links of sample queries to all other vectors; the larger number counts. Vectors of each length
have an index of their own, whose codes follow their number.

Copies of a vector are one class throughout. A pair is met in the cell of either vector that the
other one visits and counted once for each; large cells are dealt into blocks, each pair of blocks
a group of its own. Only counts and stars leave a group, never pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no
links and are components of their own; vectors of different lengths have none with each other; null
vec_ids keep their rows and are a component's id only where no other is; repeated rows are copies of
each other; an empty table gives an empty frame; other columns, labels too, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_by_size, with_components
from .jaccard_join import _changes, by_group, least_labels

COSINE = 0.95
#: Vectors of a length that the codebooks, and pairs of each kind made at the threshold that the number of visits, are fitted on, at most.
SAMPLE, PAIRS = 16384, 8192
#: Queries held against all vectors; more of them where the first have fewer than LINKS links.
QUERIES, LINKS = (256, 2048), 1000
RECALL = 0.999
#: Vectors of an average cell, and most codes of a half: a quarter of the sample. Cells of still more vectors are dealt into blocks.
CELL, CODES = 32, SAMPLE // 4
BLOCK = 1500


def unit_rows(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    centers = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = distances(x, centers).argmin(axis=1)
        n = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)[None, :], 0)


class MultiIndex:
    """Codebooks of both halves; cell = code of the first half * codes + code of the second."""

    def __init__(self, sample: np.ndarray, codes: int):
        half = sample.shape[1] // 2
        self.half = half
        self.books = [k_means(sample[:, :half], codes), k_means(sample[:, half:], codes)]
        self.codes = len(self.books[0])

    def both(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.books[0]), distances(x[:, self.half :], self.books[1])

    def own(self, x: np.ndarray) -> np.ndarray:
        d1, d2 = self.both(x)
        return d1.argmin(axis=1) * self.codes + d2.argmin(axis=1)

    def visits(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each vector, nearest first.

        The cell of the i-th and j-th nearest codes comes after (i + 1) * (j + 1) - 1 others, so the n
        first are among those where that product is n at most.
        """
        d1, d2 = self.both(x)
        o1, o2 = d1.argsort(axis=1, kind="stable"), d2.argsort(axis=1, kind="stable")
        n = min(n, self.codes**2)
        i, j = (np.array(v) for v in zip(*[(a, b) for a in range(min(n, self.codes)) for b in range(min(n // (a + 1), self.codes))], strict=True))
        rows = np.arange(len(x))[:, None]
        c1, c2 = o1[:, i], o2[:, j]
        order = (d1[rows, c1] + d2[rows, c2]).argsort(axis=1, kind="stable")[:, :n]
        return (c1 * self.codes + c2)[rows, order]

    def rank(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells come before the given one, for each vector."""
        d1, d2 = self.both(x)
        out = np.zeros(len(x), np.int64)
        for k, c in enumerate(cells):
            away = d1[k, c // self.codes] + d2[k, c % self.codes]
            out[k] = np.searchsorted(np.sort(d2[k]), away - d1[k], "left").sum()
        return out

    def met(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many cells come before the one that each pair is met in, from the nearer side."""
        return np.minimum(self.rank(x, self.own(y)), self.rank(y, self.own(x)))


def codes_for(n):
    """Codes of a half so that the grid has a cell for CELL of n vectors; n: a column."""
    return F.floor(F.sqrt(n / CELL))


def packed(v) -> bytes | None:
    """Bytes of a usable vector, in single precision where that holds it whole; None of others."""
    if not v.is_valid or not len(v.values) or v.values.null_count:
        return None
    x = v.values.to_numpy(zero_copy_only=False) + 0.0  # -0 is 0
    if not np.isfinite(x).all() or not x.any():
        return None
    with np.errstate(over="ignore", under="ignore"):
        y = x.astype(np.float32)
    return y.tobytes() if (y == x).all() else x.tobytes()


def read_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, node (digest, null where unusable), dims, vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [packed(x) for x in b.column(1)]
            nodes = [None if x is None else xxhash.xxh3_128_digest(x) for x in v]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.binary()), pc.list_value_length(b.column(1)).cast(pa.int32()), pa.array(v, pa.binary())], names=["vec_id", "node", "dims", "vec"])

    return embeddings.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id bigint, node binary, dims int, vec binary")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors of one length."""
    raw = column.to_pylist()
    out = np.empty((len(raw), dims))
    double = np.array([len(x) == 8 * dims for x in raw], bool)
    for kind, some in ((np.float64, double), (np.float32, ~double)):
        if some.any():
            out[some] = np.frombuffer(b"".join([raw[k] for k in np.flatnonzero(some)]), kind).reshape(-1, dims)
    return unit_rows(out) if len(raw) else out


def turned(x: np.ndarray, towards: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors at exactly this cosine to x, in the direction of `towards`, and for which of x there is one."""
    u = towards - (towards * x).sum(axis=1, keepdims=True) * x
    size = np.sqrt((u * u).sum(axis=1, keepdims=True))
    ok = size[:, 0] > 1e-9
    return cosine * x[ok] + np.sqrt(1 - cosine * cosine) * u[ok] / size[ok], ok


def visits_at(index: MultiIndex, points: np.ndarray, cosine: float, recall: float, seed: int = 7) -> int:
    """Cells to visit so that `recall` of pairs at the threshold are met, turned any way and turned towards other vectors."""
    rng = np.random.default_rng(seed)
    n = 2
    for towards in (rng.normal(size=points.shape), points[rng.permutation(len(points))]):
        y, ok = turned(points, towards, cosine)
        if len(y):
            ranks = np.sort(index.met(points[ok], y))
            n = max(n, int(ranks[int(np.ceil(recall * len(ranks))) - 1]) + 2)
    return n


def visits_for(classes: DataFrame, index, nodes: list[bytes], queries: np.ndarray, cosine: float, recall: float) -> tuple[int, int]:
    """Cells to visit so that `recall` of the links of the queries to all other vectors are met, and how many links there are."""
    shared = classes.sparkSession.sparkContext.broadcast((queries, {x: k for k, x in enumerate(nodes)}))
    dims = queries.shape[1]

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, place = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                x = matrix(part.column(1), dims)
                own = np.array([place.get(y, -1) for y in part.column(0).to_pylist()])
                i, j = np.nonzero((x @ q.T >= cosine) & (own[:, None] != np.arange(len(q))[None, :]))
                for k in range(0, len(i), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(index.value.met(x[i[k : k + 20_000]], q[j[k : k + 20_000]]))], names=["rank"])

    seen = classes.filter(F.col("dims") == dims).select("node", "vec").mapInArrow(ranks, "rank bigint").groupBy("rank").count().orderBy("rank").collect()  # a row per rank
    total, upto = sum(r["count"] for r in seen), 0
    for r in seen:
        upto += r["count"]
        if upto >= recall * total:
            return int(r["rank"]) + 2, total
    return 2, total


def fitted(classes: DataFrame, dims: int, n: int, cosine: float, recall: float) -> tuple[MultiIndex, int]:
    """Index of the n vectors of a length and the number of cells to visit."""
    drawn = classes.filter(F.col("dims") == dims).orderBy(F.xxhash64("node")).limit(SAMPLE + PAIRS).select("node", "vec").toArrow().combine_chunks()
    points, nodes = matrix(drawn.column("vec").combine_chunks(), dims), drawn.column("node").to_pylist()
    sample = points[:SAMPLE]
    index = MultiIndex(sample, int(np.clip(np.sqrt(n / CELL), 1, min(CODES, max(1, len(sample) // 4)))))  # codes_for(n), as far as the sample goes
    visits = visits_at(index, points[-PAIRS:], cosine, recall)
    shared = classes.sparkSession.sparkContext.broadcast(index)
    for queries in QUERIES:
        real, links = visits_for(classes, shared, nodes[-queries:], points[-queries:], cosine, recall)
        if links >= LINKS or queries >= len(nodes):
            break
    return index, max(visits, real)


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of `embeddings` (vec_id, embedding)."""
    spark = embeddings.sparkSession
    rows = cut(read_vectors(embeddings), "vectors")
    classes = cut(rows.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.max("dims").alias("dims"), F.max("vec").alias("vec")), "vector-classes")
    # an index for each length; where it has one code a half, its grid is one cell and there is nothing to fit
    lengths = classes.groupBy("dims").count().filter(codes_for(F.col("count")) > 1).orderBy("dims").collect()
    made = spark.sparkContext.broadcast({r["dims"]: fitted(classes, r["dims"], r["count"], cosine, recall) for r in lengths})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                own = b.take(pa.array(np.flatnonzero(dims == d)))
                index, n = made.value.get(d, (None, 1))
                # the order of a vector's nearest cells takes about n ln n numbers
                step = own.num_rows if index is None else max(1, min(2000, 8_000_000 // int(n * np.log(n + 2) + 1)))
                for at in range(0, own.num_rows, step):
                    part = own.slice(at, step)
                    cells = np.zeros((part.num_rows, 1), np.int32) if index is None else index.visits(matrix(part.column("vec"), d), n).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(cells), pa.list_(pa.int32()))], names=["node", "size", "dims", "vec", "cells"])

    placed = cut(classes.select("node", "size", "dims", "vec").mapInArrow(place, "node binary, size bigint, dims int, vec binary, cells array<int>").withColumn("own", F.col("cells")[0]), "placed-vectors")
    cell = ["dims", "cell"]
    seekers = placed.select("node", "size", "dims", "vec", "own", F.explode("cells").alias("cell"))
    sought = placed.select("dims", F.explode("cells").alias("cell")).groupBy(*cell).agg(F.count("*").alias("n_seek"))
    population = placed.groupBy("dims", F.col("own").alias("cell")).agg(F.count("*").alias("n_own")).join(sought, cell)
    blocks = cut(population.select("*", F.ceil(F.col("n_own") / BLOCK).cast("int").alias("own_blocks"), F.ceil(F.col("n_seek") / BLOCK).cast("int").alias("seek_blocks")), "cell-blocks")
    total, all_seekers = (int(x or 0) for x in blocks.agg(F.sum("n_own"), F.sum("n_seek")).first())
    h = F.xxhash64("node")
    to = lambda a, other, x, y: [F.pmod(h, F.col(a)).cast("int").alias(x), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(y)]
    names = ["dims", "cell", "bi", "bj", "base", "node", "size", "vec", "own", "cells"]
    members = join_by_size(placed.withColumn("cell", F.col("own")), blocks, cell, "n_own", total).select("*", *to("own_blocks", "seek_blocks", "bi", "bj")).withColumn("base", F.lit(True)).select(names)
    visitors = join_by_size(seekers, blocks, cell, "n_seek", all_seekers).select("*", *to("seek_blocks", "own_blocks", "bj", "bi")).withColumns({"base": F.lit(False), "cells": F.lit(None).cast("array<int>")}).select(names)
    keys = ["dims", "cell", "bi", "bj"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, keys, 4000):
            first = _changes(t, keys)
            for s, e in zip(first, np.append(first[1:], t.num_rows), strict=True):
                g = t.slice(s, e - s)
                base = g.column("base").to_numpy()
                i, j = np.flatnonzero(~base), np.flatnonzero(base)
                if not i.size or not j.size:
                    continue
                node = g.column("node").to_pylist()
                size, own = g.column("size").to_numpy(), g.column("own").to_numpy()
                x = matrix(g.column("vec").combine_chunks(), g.column("dims")[0].as_py())
                a, b = np.nonzero(x[i] @ x[j].T >= cosine)
                a, b = i[a], j[b]
                place = {y: k for k, y in enumerate(dict.fromkeys(node))}
                who = np.array([place[y] for y in node])
                other = who[a] != who[b]
                a, b = a[other], b[other]
                links = np.bincount(who[a], size[b], len(place))
                # the vector of the cell counts a visitor itself where it does not visit the visitor's cell
                cells = g.column("cells").combine_chunks()
                parents, values = pc.list_parent_indices(cells).to_numpy().astype(np.int64), cells.flatten().to_numpy().astype(np.int64)
                unseen = ~np.isin(b * (1 << 32) + own[a], parents * (1 << 32) + values)
                links += np.bincount(who[b[unseen]], size[a[unseen]], len(place))
                label = least_labels(len(place), who[a], who[b])
                known = list(place)
                some = np.flatnonzero(links > 0)
                yield pa.RecordBatch.from_arrays([pa.array([known[k] for k in some], pa.binary()), pa.array(links[some].astype(np.int64)), pa.array([known[k] for k in label[some]], pa.binary())], names=["node", "links", "root"])

    links = cut(members.unionByName(visitors).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "node binary, links bigint, root binary"), "vector-links")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = links.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    linked = cut(with_components(counts.select(F.col("node").alias("id")), joined), "vector-components").withColumnRenamed("id", "node")
    heads = linked.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("of"))
    found = join_by_size(linked, heads, "component", "of", linked.count()).join(counts, "node").select("node", "component_id", "links")
    n_links = F.coalesce("links", F.lit(0)) + F.col("size") - 1
    table = cut(classes.select("node", "rep", "size").join(found, "node", "left").select("node", "size", n_links.cast("bigint").alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "vector-table")
    together = join_by_size(rows.filter("node is not null").select("vec_id", "node"), table, "node", "size", rows.count())
    alone = rows.filter("node is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return together.select("vec_id", "n_links", "component_id").unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
