"""Token-id files compressed by Re-Pair grammars.

Documents are dealt by ranges of doc_id and written in ascending order as shards. In a shard,
frequent pairs of ids become nonterminals, round after round: first inside the distinct segments of
the shard, whose pair counts are weighted by how often a segment occurs, then along whole documents,
until no pair occurs LEAST times. A round replaces a pair where it is more frequent than the pairs
that overlap it (every other one from the left where they are alike). Counts are kept up
incrementally: a pair that was too rare can only become rarer, so a round counts the pairs that were
frequent and those beside a symbol that the last round made. No rule spans two documents. A shard
stores its rules by round, the expansion length of every rule, the symbols and where each document's
symbols begin, so any range of ids of any document decodes by itself.

The file format is a row per shard: part, shard, n_docs, n_ids and a payload (`write_shard`).

Defined results: null text is empty and is the end id alone; null doc_ids come first, repeated ones
next to each other; an empty table writes no shard and reads back empty; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_path, text_col
from .shingles import utf8
from .tokenizing import encoder as worker_encoder
from .tokenizing import ROOM, flat, pack, vocabulary

VOCABULARY = "byte_bpe_50k.json"
END = 0
MAGIC = b"RPG1"
#: Bytes of text in a shard, about; texts are added some megabytes at a time.
SHARD = 12_000_000
#: A pair that occurs less often stays as it is.
LEAST = 4
#: Shards whose places are broadcast, at most: 24 bytes each. Beyond, they are joined by a shuffle.
FEW_SHARDS = 1_000_000
FILES = "part int, shard int, n_docs bigint, n_ids bigint, payload binary"


class Grammar:
    """Rules over ids below `base`; symbol base + k is rule k, whose parts are lower symbols."""

    def __init__(self, base: int):
        self.base, self.rounds = base, []
        self.left, self.right, self.lengths = (np.zeros(0, np.int64) for _ in range(3))

    def reduce(self, s: np.ndarray, starts: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Replaces frequent pairs of the sequences that begin at `starts` in s until there are none; the new symbols and starts."""
        s = s.astype(np.int64)
        last = np.zeros(len(s) + 1, bool)  # of a sequence
        last[np.append(starts[1:], len(s)) - 1] = True  # an empty sequence marks the end before it once more
        live = ~last[: len(s)]
        while len(s):
            where, rule = self._round(s, live, weights)
            if not len(where):
                break
            s[where] = rule
            last[where] = last[where + 1]
            live[where] = True
            live[where[where > 0] - 1] = True
            keep = np.ones(len(s), bool)
            keep[where + 1] = False
            moved = np.concatenate([[0], np.cumsum(keep)])
            s, last, live, starts = s[keep], last[:-1][keep], live[keep], moved[starts]
            last = np.append(last, False)
            live &= ~last[:-1]
            weights = None if weights is None else weights[keep]
        return s, starts

    def _round(self, s: np.ndarray, live: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs to replace, and the symbols of their rules; `live` marks the places whose pair may be frequent."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        p = np.flatnonzero(live)
        keys = (s[p] << 32) | s[p + 1]
        # no pair is more frequent than all that share its short hash
        bits = int(np.clip(len(p).bit_length() + 1, 10, 22))
        short = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
        bound = np.bincount(short, None if weights is None else weights[p])
        may = bound[short] >= LEAST
        live[p[~may]] = False
        p, keys = p[may], keys[may]
        order = np.argsort(keys)
        sorted_ = keys[order]
        fresh = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])[: len(p)]
        pair = np.empty(len(p), np.int64)
        pair[order] = np.cumsum(fresh) - 1
        pairs = sorted_[fresh]
        n = np.bincount(pair, None if weights is None else weights[p], len(pairs))
        often = n[pair] >= LEAST
        live[p[~often]] = False
        p, pair = p[often], pair[often]
        if not len(p):
            return none
        level = (2 * np.log2(n[pair])).astype(np.int8)
        around = np.full(len(s) + 2, -1, np.int8)
        around[p + 1] = level
        begins = np.concatenate([[True], (np.diff(p) != 1) | (np.diff(level) != 0)])
        first = np.flatnonzero(begins)
        end = np.append(first[1:], len(p)) - 1
        run = np.cumsum(begins) - 1
        peak = (around[p[first]] < level[first]) & (around[p[end] + 2] < level[first])
        taken = peak[run] & ((np.arange(len(p)) - first[run]) % 2 == 0)
        p, pair = p[taken], pair[taken]
        used = np.bincount(pair, None if weights is None else weights[p], len(pairs))
        good = used >= 2 if (used >= 2).any() else used > 0
        rule = self.base + len(self.left) + np.cumsum(good) - 1
        chosen = pairs[good]
        self.rounds.append(len(chosen))
        self.left, self.right = np.concatenate([self.left, chosen >> 32]), np.concatenate([self.right, chosen & 0xFFFFFFFF])
        size = lambda x: np.where(x < self.base, 1, self.lengths[np.maximum(x - self.base, 0)] if len(self.lengths) else 1)
        self.lengths = np.concatenate([self.lengths, size(chosen >> 32) + size(chosen & 0xFFFFFFFF)])
        p, pair = p[good[pair]], pair[good[pair]]
        return p, rule[pair]


def write_shard(doc_ids: list, chunks: list[bytes], docs: list[np.ndarray], base: int) -> tuple[int, bytes]:
    """(ids held, payload). chunks: ids of each distinct chunk; docs: chunk numbers of each document, its end id included."""
    g = Grammar(base)
    size = np.array([len(c) // 4 for c in chunks], np.int64)
    order = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    n_ids = int(size[order].sum())
    seen = np.bincount(order, minlength=len(chunks))
    s, starts = g.reduce(np.frombuffer(b"".join(chunks), "<u4"), np.cumsum(size) - size, np.repeat(seen, size))
    reach = np.diff(np.append(starts, len(s)))[order]
    at = np.concatenate([[0], np.cumsum(reach)])
    s = s[flat(starts[order], reach)]
    s, starts = g.reduce(s, at[np.concatenate([[0], np.cumsum([len(d) for d in docs])[:-1]]).astype(np.int64)] if docs else at[:0], None)
    wide = "<u2" if base + len(g.left) <= 1 << 16 else "<u4"
    nulls = bytes(i is None for i in doc_ids)
    parts = [
        MAGIC, struct.pack("<IIIQQQB", base, len(g.left), len(g.rounds), len(s), len(doc_ids), n_ids, int(wide[-1])),
        np.array(g.rounds, "<u4").tobytes(), g.left.astype("<u4").tobytes(), g.right.astype("<u4").tobytes(), g.lengths.astype("<u4").tobytes(),
        np.array([i or 0 for i in doc_ids], "<i8").tobytes(), nulls, np.append(starts, len(s)).astype("<u8").tobytes(), s.astype(wide).tobytes(),
    ]
    return n_ids, b"".join(parts)


class Shard:
    """A payload opened for reading."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a shard")
        self.base, rules, rounds, symbols, docs, self.n_ids, wide = struct.unpack_from("<IIIQQQB", payload, 4)
        at = 4 + struct.calcsize("<IIIQQQB")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(payload, kind, n, at)
            at += x.nbytes
            return x

        self.rounds = take("<u4", rounds)
        self.left, self.right, self.lengths = take("<u4", rules), take("<u4", rules), take("<u4", rules)
        ids, nulls = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, nulls, strict=True)]
        self.starts, self.symbols = take("<u8", docs + 1).astype(np.int64), take(f"<u{wide}", symbols)

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, where each one's begin): rules are expanded a round at a time, from the parts that earlier rounds made."""
        size = np.concatenate([np.ones(self.base, np.int64), self.lengths.astype(np.int64)])
        at = np.cumsum(size) - size
        made = np.zeros(int(size.sum()), np.uint32)
        made[: self.base] = np.arange(self.base)
        done = 0
        for n in self.rounds.tolist():
            both = np.column_stack([self.left[done : done + n], self.right[done : done + n]]).ravel()
            some = made[flat(at[both], size[both])]
            first = at[self.base + done] if n else 0
            made[first : first + len(some)] = some
            done += n
        n = size[self.symbols]
        ends = np.concatenate([[0], np.cumsum(n)])
        return made[flat(at[self.symbols], n)], ends[self.starts]

    def ids(self, k: int, start: int, stop: int) -> np.ndarray:
        """ids[start:stop] of document k, expanding only the symbols that cover them."""
        s = self.symbols[self.starts[k] : self.starts[k + 1]].astype(np.int64)
        n = np.where(s < self.base, 1, self.lengths[np.maximum(s - self.base, 0)] if len(self.lengths) else 1).astype(np.int64)
        ends = np.cumsum(n)
        low, high = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        out: list[int] = []
        todo = s[low:high][::-1].tolist()
        while todo:
            x = todo.pop()
            if x < self.base:
                out.append(x)
            else:
                todo += [int(self.right[x - self.base]), int(self.left[x - self.base])]
        skip = int(ends[low] - n[low]) if low < len(n) else 0
        return np.array(out[start - skip : stop - skip], np.uint32)


def write_token_files(docs: DataFrame, to: str, path: str | None = None, end: int = END) -> None:
    """Writes the ids of each row of `docs` (doc_id, text), each followed by `end`, to the folder `to`."""
    path = path or vocabulary(VOCABULARY)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = worker_encoder(path), TaskContext.get().partitionId(), 0
        base = encoder.library.get_vocab_size(with_added_tokens=True)
        ids, splits, place, chunks, held, last = [], [], {}, [], 0, pack([end])

        def flush() -> pa.RecordBatch:
            nonlocal ids, splits, place, chunks, held, shard
            n_ids, payload = write_shard(ids, chunks, splits, base)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([n_ids], pa.int64()), pa.array([payload], pa.binary())], names=["part", "shard", "n_docs", "n_ids", "payload"])
            ids, splits, place, chunks, held, shard = [], [], {}, [], 0, shard + 1
            return row

        for b in batches:
            names = b.column(0).to_pylist()
            _, offsets = utf8(b.column(1))
            for first, stop, row, code, unit_ids, sizes in encoder.units(b.column(1), min(ROOM, SHARD)):
                here = int(offsets[stop] - offsets[first])
                if ids and held + here > SHARD:
                    yield flush()
                if not chunks:
                    place[last] = 0
                    chunks.append(last)
                data, ends = pack(unit_ids), (4 * np.cumsum(sizes)).tolist()
                own = [data[s:e] for s, e in zip([0, *ends], ends, strict=False)]
                new = [x for x in dict.fromkeys(own) if x not in place]
                place.update(zip(new, range(len(chunks), len(chunks) + len(new)), strict=True))
                chunks += new
                number = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
                own, cuts = number[code], np.searchsorted(row, np.arange(stop - first + 1)).tolist()
                ids += names[first:stop]
                splits += [np.append(own[s:e], 0) for s, e in zip(cuts, cuts[1:], strict=False)]
                held += here
        if ids:
            yield flush()

    # rows that share an id, or have none, may be dealt to several parts
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_col().alias("text")).withColumn("salt", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt").select("doc_id", "text")
    rows.mapInArrow(shards, FILES).write.parquet(to)


def read_token_files(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the folder `at`."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload, start in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                s = Shard(payload.as_py())
                ids, at = s.documents()
                data, ends = pack(ids), (4 * at).tolist()
                crc = [zlib.crc32(data[x:y]) for x, y in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(start + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.schema(FILES).parquet(at)
    # ids before a part, and before a shard in its part: a row per part and shard only
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    shards = files.select("part", "shard", F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    starts = shards.join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("before")).alias("start"))
    if files.count() <= FEW_SHARDS:
        starts = F.broadcast(starts)  # payloads stay where they are read
    return files.join(starts, ["part", "shard"]).select("payload", "start").mapInArrow(documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = new_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), to)
    return read_token_files(spark, to)
