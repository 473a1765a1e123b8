"""Helpers that the corpus operators share: the shared folder, cut points, Arrow tasks, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator here: ASCII space and \x09-\x0D. A word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session that is one process may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and a lost executor costs only its tasks."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tidy(run: Callable) -> Callable:
    """An Arrow task that gives the memory it has freed back to the system: its worker may wait beside other stages for the next one."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied


def text_col(name: str = "text") -> Column:
    """Whole text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Names for columns of our own that clash with none of `columns`."""
    taken = {c.lower() for c in columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


#: Rows of a table that is broadcast, at most; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def small(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has few enough rows. Give a table that is cheap to count, such as one just cut."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


#: Rows of one key that a task of a join meets, about: fewer on small tables, more only where so many keys are hot that their table could not be broadcast.
HOT_ROWS, PARTS = 50_000, 256


def join_by_size(rows: DataFrame, table: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """rows with the columns of `table`, one row of which has, under `size`, how many rows a key has.

    The sizes sum to `total` at most, so no more than total / n keys have n rows or more: those
    are broadcast, BROADCAST_ROWS of them at most, and the rows of a hot key never meet in one task.
    """
    is_hot = F.col(size) >= F.lit(max(1, min(total // PARTS, HOT_ROWS), total // BROADCAST_ROWS))
    hot, rest = F.broadcast(table.filter(is_hot)), table.filter(~is_hot)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def with_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest reachable id of each vertex.

    vertices: id. edges: a, b (either direction, repeats allowed). Returns id, component.
    Alternating large-star and small-star contractions over edge tables: every round is two grouped
    minima, pre-aggregated before their shuffles, and two joins that spread the edges of a vertex with
    many; nothing is gathered. Rounds go on until no edge changes, which takes about the square of
    the logarithm of the number of vertices at most.
    """
    spark = edges.sparkSession
    path = new_path(spark, "edges")
    # u > v throughout
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges", path)
    before = None
    while (now := tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())) != before:
        before, n = now, int(now[0])
        # large star: what hangs on v goes to v's own least neighbour
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        heads = e.groupBy("v").agg(F.count("*").alias("n")).join(least.withColumnRenamed("u", "v"), "v", "left").select("v", "n", F.coalesce("m", "v").alias("m"))
        large_path, small_path = new_path(spark, "edges"), new_path(spark, "edges")
        large = cut(join_by_size(e, heads, "v", "n", n).select("u", F.col("m").alias("v")).distinct(), "edges", large_path)
        # small star: what u hangs on goes to the least of it, u too
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        both = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        e = cut(join_by_size(large, low, "u", "n", n).select(both.alias("x")).select("x.*").filter("u <> v").distinct(), "edges", small_path)
        drop_path(spark, path)
        drop_path(spark, large_path)
        path = small_path
    # a star forest: one edge for each vertex that is not a head
    return vertices.join(e.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
