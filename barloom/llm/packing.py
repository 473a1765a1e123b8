"""Best-two-fit packing of token sequences.

Lengths are integers up to the capacity, so however many pieces there are, the packing depends on
at most `capacity` counts. The driver packs that histogram: it fills a bin greedily with the
largest length that fits, then replaces the bin's smallest document by two unpacked ones that fit
the widened gap more tightly, and repeats the finished pattern as often as the counts allow.
Pieces find their place by their rank among pieces of their length; ranks are taken in runs of
bounded size, so a very common length is spread over tasks.

Defined results: null or empty text is the end id alone; null and repeated doc_ids keep their rows;
an empty table gives an empty frame; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, text_col, tidy
from .tokenizing import encoder as worker_encoder
from .tokenizing import pack, vocabulary

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END = 0
RUN = 5000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """[(lengths of a bin, how many such bins)] using up `counts` (length -> pieces of it)."""
    left = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    bins = []
    while (there := np.flatnonzero(left)).size:
        free = left.copy()
        held = [int(there[-1])]
        free[held[0]] -= 1
        gap = capacity - held[0]
        while gap and (fit := np.flatnonzero(free[: gap + 1])).size:
            held.append(int(fit[-1]))
            free[held[-1]] -= 1
            gap -= held[-1]
        while gap and len(held) > 1:
            low = min(held)
            room = gap + low
            v = np.flatnonzero(free[: room + 1])
            if not v.size:
                break
            j = np.searchsorted(v, room - v, "right") - 1
            j = np.where((j >= 0) & (v[j] == v) & (free[v] < 2), j - 1, j)
            both = np.where(j >= 0, v + v[j], 0)
            best = int(both.argmax())
            if both[best] <= low:
                break
            held.remove(low)
            pair = [int(v[best]), int(v[j[best]])]
            held += pair
            free[pair[0]] -= 1
            free[pair[1]] -= 1
            free[low] += 1
            gap = capacity - sum(held)
        used = np.bincount(held, minlength=capacity + 1)
        times = int((left[used > 0] // used[used > 0]).min())
        left -= used * times
        bins.append((sorted(held, reverse=True), times))
    return bins


def slots(bins: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of a length go, by rank: arrays sorted by length and first rank."""
    rows, taken, sequence = [], {}, 0
    for held, times in bins:
        offset = 0
        for x in held:
            rank = taken.get(x, 0)
            rows.append((x, rank, sequence, offset))
            taken[x] = rank + times
            offset += x
        sequence += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": (a[:, 0] << 48) + a[:, 1], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def pieces(docs: DataFrame, path: str, capacity: int, end: int) -> DataFrame:
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = worker_encoder(path), pack([end])
        for b in batches:
            rows, names = [], b.column(0).to_pylist()
            for first, stop, all_ids, offsets in encoder.encode(b.column(1)):
                data, at_of = pack(all_ids), (4 * offsets).tolist()
                for i, s, e in zip(names[first:stop], at_of, at_of[1:], strict=False):
                    ids = data[s:e] + last
                    for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[at * 4 : (at + capacity) * 4]
                        rows.append((i, k, at, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=NAMES)

    return docs.select(F.col("doc_id").cast("bigint"), text_col().alias("text")).mapInArrow(tidy(cut_up), PIECES)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    made = cut(pieces(docs, path or vocabulary(VOCABULARY), capacity, end), "pieces")
    counts = made.groupBy("length").count()
    # at most `capacity` rows
    where = spark.sparkContext.broadcast(slots(best_two_fit({int(r[0]): int(r[1]) for r in counts.collect()}, capacity)))
    dealt = (
        made.join(F.broadcast(counts.select("length", F.ceil(F.col("count") / RUN).alias("parts"))), "length")
        .withColumn("h", F.xxhash64("doc_id", "piece", "ids_crc32")).withColumn("part", F.pmod("h", "parts")).drop("parts")
    )
    runs = dealt.groupBy("length", "part").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(W.partitionBy("length", "part").orderBy("h", "doc_id", "piece")) - 1
    ranked = dealt.join(runs.select("length", "part", before.alias("before")), ["length", "part"]).select(*NAMES, (F.col("before") + place).alias("rank"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = where.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(s["key"], (length << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s["sequence"][at] + rank - s["rank"][at]), pa.array(s["offset"][at])], names=[*NAMES, "sequence_id", "offset"])

    return ranked.mapInArrow(tidy(assign), PIECES + ", sequence_id bigint, offset bigint")


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
