"""Exact dedup by a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the text. A batch is
reduced to one row per digest (with map-side combining, so a group of copies of any size is
one row per task), deduplicated against the index by a sort-merge anti-join that reads the
index without shuffling it, and its new digests are appended. The number of buckets doubles as
the index grows, so that a bucket stays a task's worth of digests; the index is then written anew
beside itself and renamed, as it is when appends have left many files; a rewrite that dies at any step
leaves the version before or after it, whole. One writer at a time.

Defined results: a null text equals the empty text; a null doc_id never beats another id, and in
a group that has only null ids all are kept (`keep_first` leaves one); rows that repeat both doc_id and
text are one document and carry the same flags; an empty batch returns an empty frame; further
columns of the input, whatever their names, are ignored here and kept by `keep_first`.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_path, free_names, join_by_size, new_path, text_col

#: Digests of a bucket (about 50 bytes each), and files that appends leave in it, before the index is written anew.
BUCKET_ROWS, BUCKET_FILES = 2_000_000, 16


class DigestIndex:
    """Digests seen so far, with the id that stays, in `path`; reopened by giving the same path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, bucket_rows: int = BUCKET_ROWS, bucket_files: int = BUCKET_FILES):
        self.spark, self.path, self.bucket_rows, self.bucket_files = spark, path.rstrip("/"), bucket_rows, bucket_files
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        found = sorted((int(m[1]), int(m[2])) for x in names if (m := re.fullmatch(r"v(\d+)-(\d+)", x)))
        self._open(*(found[-1] if found else (0, buckets)))
        for name in names:  # older versions, and rewrites that died
            if (m := re.fullmatch(r"v(\d+)-(\d+)(\.new)?", name)) and (m[3] or (int(m[1]), int(m[2])) != found[-1]):
                self._clear(f"{self.path}/{name}")

    def _open(self, version: int, buckets: int) -> None:
        self.version, self.buckets = version, buckets
        self.table = self._create(f"{self.path}/v{version}-{buckets}", buckets)

    @staticmethod
    def _name(folder: str) -> str:
        return "digest_index_" + hashlib.md5(folder.encode()).hexdigest()[:16]

    def _create(self, folder: str, buckets: int) -> str:
        table = self._name(folder)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}'"
        )
        return table

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def _insert(self, rows: DataFrame, table: str, buckets: int) -> None:
        # dealt as the table is: a bucket comes from one task, as one sorted file
        rows.repartition(buckets, "digest").write.insertInto(table)
        self.spark.catalog.refreshTable(table)

    def make_room(self, more: int) -> None:
        """Deals the index into more buckets if `more` digests would overfill them, and merges the files of many appends."""
        there, buckets = self.rows(), self.buckets
        n = there.count() + more
        while n > buckets * self.bucket_rows:
            buckets *= 2
        if buckets == self.buckets and len(there.inputFiles()) <= self.buckets * self.bucket_files:
            return
        old, to = f"{self.path}/v{self.version}-{self.buckets}", f"{self.path}/v{self.version + 1}-{buckets}"
        # what a rewrite that died has left is no part of the index: only a whole one gets its name
        self._clear(to + ".new")
        made = self._create(to + ".new", buckets)
        self._insert(there, made, buckets)
        self.spark.sql(f"DROP TABLE {made}")
        self.spark.sql(f"DROP TABLE {self.table}")
        self._rename(to + ".new", to)
        self._open(self.version + 1, buckets)
        drop_path(self.spark, old)

    def _clear(self, folder: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(folder)}")
        drop_path(self.spark, folder)

    def _rename(self, old: str, new: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        path(new).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).rename(path(old), path(new))

    def append_new(self, groups: DataFrame) -> None:
        """groups: digest, keep_id (one row per digest). Appends those whose digest is not there yet."""
        self.make_room(groups.count())
        self._insert(groups.select("digest", "keep_id").hint("merge").join(self.rows().select("digest"), "digest", "left_anti"), self.table, self.buckets)


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def exact_dedup(docs: DataFrame, index: DigestIndex, normalise=None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of `docs` (doc_id, text).

    normalise: optional Column -> Column applied to the text before hashing. In the first batch of
    an index the largest doc_id of equal texts stays; texts that an earlier batch brought keep the
    id they had then. group_size counts the rows of this batch.
    """
    text = text_col() if normalise is None else normalise(text_col())
    rows = cut(docs.select("doc_id", digest_of(text).alias("digest")), "digests")
    groups = cut(rows.groupBy("digest").agg(F.max("doc_id").alias("own_id"), F.count("*").alias("group_size")), "groups")
    index.append_new(groups.withColumnRenamed("own_id", "keep_id"))
    known = cut(groups.select("digest", "group_size").hint("merge").join(index.rows(), "digest"), "known-groups")
    joined = join_by_size(rows, known, "digest", "group_size", rows.count())
    return joined.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of `docs`, all columns, that stay; one row where a kept row is repeated.

    Texts that an earlier batch brought stay only under the id they had then: with an index that
    already holds this batch's texts from other documents, none of them stays.
    """
    own, kept_id, same = free_names(docs.columns, "digest", "kept_id", "same")
    kept = exact_dedup(docs.select("doc_id", "text"), index).filter("kept").select(F.col("doc_id").alias(kept_id), F.unhex("text_sha256").alias(same)).distinct()
    marked = docs.withColumn(own, digest_of(text_col()))
    # only one row per group is left before the rows meet, so no group of copies lands in one task
    match = F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(same))
    return marked.join(kept, match, "left_semi").dropDuplicates(["doc_id", own]).select(docs.columns)


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), DigestIndex(spark, new_path(spark, "index")))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
