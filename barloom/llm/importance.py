"""Target-distribution importance resampling on hashed n-grams.

Texts become words and words become n-grams inside Arrow: lower case, a split, one flat list, and
its dictionary. An n-gram is a pair of dictionary indices, of the n-gram before it and of the next
word, from the flat list shifted; each distinct pair's CRC goes on from the shorter n-gram's, so a
CRC is worked out once for each distinct n-gram of a chunk. Counts of buckets leave a task as one
row a bucket. The gains of all buckets, a table whose size is a parameter, go back to the tasks,
which take them by bucket and reduce them by document. Ranks come from ranges of the scores' order.

Defined results: null text has no words; null doc_ids draw by `<seed>:` alone and come last among
ties; rows that repeat id and score are ranked by weight, then features; texts without words have
weight 0 and are not drawn; an empty table gives an empty frame, and empty target texts count 0;
other columns are ignored. A text of any length is handled by chunks of words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, text_col
from .mixing import ordered
from .shingles import pieces

#: What is between words, after A-Z has become a-z: ASCII but for digits and small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORDER, BUCKETS = 3, 10_000
PERCENT, LEAST, SEED = 5, 20, 42
#: Words whose n-grams are formed at once.
CHUNK = 400_000


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, one after the other, and the text that each is of."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=BETWEEN)
    flat, row = pc.list_flatten(parts), pc.list_parent_indices(parts)
    some = pc.not_equal(pc.binary_length(flat), 0)
    return flat.filter(some), row.filter(some).to_numpy(zero_copy_only=False).astype(np.int64)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values and each one's place among them."""
    d = pa.array(values).dictionary_encode()
    return d.dictionary.to_numpy(zero_copy_only=False), d.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def grams(words: pa.Array, row: np.ndarray, order: int, starts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length up to `order`: rows of the n-grams that begin at the first `starts` words, their codes, and the CRC of each code."""
    d = words.dictionary_encode()
    word = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    spelled = d.dictionary.cast(pa.binary()).to_pylist()
    spaced = np.array([b" " + w for w in spelled], object)
    code, crc = word, np.fromiter(map(zlib.crc32, spelled), np.int64, len(spelled))
    yield row[:starts], code[:starts], crc
    for k in range(1, order):
        at = np.flatnonzero(row[: len(row) - k] == row[k:])
        # the n-gram so far, and the word that comes k places later
        pairs, places = distinct(code[at] * len(spelled) + word[at + k])
        crc = np.fromiter(map(zlib.crc32, spaced[pairs % len(spelled)], crc[pairs // len(spelled)].tolist()), np.int64, len(pairs))
        code = np.full(len(row), -1)
        code[at] = places
        at = at[at < starts]
        yield row[at], code[at], crc


def chunks(words: pa.Array, row: np.ndarray, order: int, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for s in range(0, len(row), chunk):
        stop = min(s + chunk + order - 1, len(row))
        yield from grams(words[s:stop], row[s:stop], order, min(chunk, len(row) - s))


def bucket_counts(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """bucket, n: how many features of all rows of `texts` (text) fall into each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for first, stop in pieces(b.column(0)):
                for _, code, crc in chunks(*words_of(b.column(0).slice(first, stop - first)), order, chunk):
                    total += np.bincount((crc % buckets).take(code), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["bucket", "n"])

    return texts.select(text_col().alias("text")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(target rate / own rate)) of each bucket, one added to every count."""
    s, t, n = int(own.sum()), int(target.sum()), len(own)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, order: int = ORDER, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_features, weight for each row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in batches:
            for first, stop in pieces(b.column(1)):
                words, row = words_of(b.column(1).slice(first, stop - first))
                n = stop - first
                features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for rows, code, crc in chunks(words, row, order, chunk):
                    if not len(rows):
                        continue
                    worth = gain.take(crc % len(gain)).take(code)
                    begin = np.flatnonzero(np.diff(rows, prepend=-1))  # rows ascend: a segment each
                    weight[rows[begin]] += np.add.reduceat(worth, begin)
                    features[rows[begin]] += np.diff(np.append(begin, len(rows)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), pa.array(np.bincount(row, minlength=n)), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("bigint"), text_col().alias("text")).mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def resampled(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of `docs` (doc_id, text): like the texts of `target` (text).

    `percent` of the documents with at least `least` words have a rank: those of the largest scores,
    which are weights with Gumbel noise, so that the draw is without replacement.
    """

    def counted(texts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for r in bucket_counts(texts, order, buckets).collect():  # a row for a bucket
            out[r["bucket"]] = r["n"]
        return out

    gains = gains_of(counted(docs), counted(target))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")
    rows = cut(weights(docs, gains, order).withColumn("score", F.col("weight") + noise), "scores")
    able = F.col("n_words") >= least
    most = percent * rows.filter(able).count() // 100
    names = ["doc_id", "n_features", "weight", "score"]
    placed = ordered(rows.filter(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()])
    ranked = placed.select(*names, F.when(F.col("place") <= most, F.col("place")).cast("bigint").alias("rank"))
    return ranked.unionByName(rows.filter(~able).select(*names, F.lit(None).cast("bigint").alias("rank")))


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _fold(first: str, rest: str) -> str:
    """SQL: the CRC register after the bytes `rest`, from the register `first`."""
    return f"list_reduce(list_prepend({first}, {rest}), lambda c, z: xor(c >> 8, t[xor(c & 255, z) + 1]))"


OP11_SQL = rf"""
WITH tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
x AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS MATERIALIZED (SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
u AS (SELECT side, r, unnest(w) AS a, generate_subscripts(w, 1) AS p FROM w),
n AS MATERIALIZED (SELECT side, r, a, lead(a) OVER q AS a2, lead(a, 2) OVER q AS a3 FROM u WINDOW q AS (PARTITION BY side, r ORDER BY p)),
b AS MATERIALIZED (SELECT a, list_transform(range(octet_length(encode(a))), lambda i: CAST('0x' || substr(hex(encode(a)), 2 * i + 1, 2) AS BIGINT)) AS b FROM (SELECT DISTINCT a FROM n)),
c1 AS MATERIALIZED (SELECT a, {_fold("4294967295", "b")} AS c FROM b, tab),
c2 AS MATERIALIZED (SELECT g.a, g.a2, {_fold("c1.c", "list_prepend(32, b.b)")} AS c FROM (SELECT DISTINCT a, a2 FROM n WHERE a2 IS NOT NULL) g JOIN c1 ON c1.a = g.a JOIN b ON b.a = g.a2, tab),
c3 AS MATERIALIZED (SELECT g.a, g.a2, g.a3, {_fold("c2.c", "list_prepend(32, b.b)")} AS c FROM (SELECT DISTINCT a, a2, a3 FROM n WHERE a3 IS NOT NULL) g JOIN c2 ON c2.a = g.a AND c2.a2 = g.a2 JOIN b ON b.a = g.a3, tab),
f AS MATERIALIZED (SELECT side, r, xor(c, 4294967295) % 10000 AS k FROM (
  SELECT side, r, c FROM n JOIN c1 USING (a) UNION ALL SELECT side, r, c FROM n JOIN c2 USING (a, a2) UNION ALL SELECT side, r, c FROM n JOIN c3 USING (a, a2, a3))),
k AS (SELECT k, count(CASE WHEN side = 0 THEN 1 END) AS s, count(CASE WHEN side = 1 THEN 1 END) AS t FROM (SELECT side, k FROM f UNION ALL SELECT 2, range FROM range(10000)) GROUP BY k),
gain AS MATERIALIZED (SELECT k, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS g FROM k),
v AS (SELECT r, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS weight FROM f JOIN gain USING (k) WHERE side = 0 GROUP BY r),
d AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN v ON v.r = w.r WHERE side = 0),
o AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score, n_words >= 20 AS able FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS able_n FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * able_n // 100 THEN place END AS rank FROM p
"""
