"""Token counts without token ids.

Texts are read once, in blocks. A block lists its distinct pre-tokens and, per document, their
frequencies. The block vocabularies are dealt by the hash of the pre-token, so that all blocks'
occurrences of one meet in a bucket, where the library's merges count it once; the counts go back
to the blocks, and the frequencies of every document are weighted and summed. A common pre-token
is one entry per block, not per document, and a bucket is a share of the vocabulary: no hot key.

Defined results: null text is empty and has 0 tokens; null and repeated doc_ids keep a row each;
strings of added tokens are one token, as the library has it by default; an empty table gives an
empty frame; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, text_col
from .shingles import utf8
from .tokenizing import Encoder, load, vocabulary
from .tokenizing import encoder as worker_encoder

VOCABULARY = "word_bpe_49k.json"
#: Bytes of text in a block, about; texts are added some megabytes at a time.
BLOCK = 8_000_000
#: Buckets of the vocabulary: as many as there are blocks, within these bounds.
BUCKETS = (64, 4096)
BLOCKS = "block bigint, doc_ids array<bigint>, n_bytes array<bigint>, lengths array<int>, packed binary, vocab array<string>"


def squeeze(x: np.ndarray) -> bytes:
    """Small integers, byte plane by byte plane, deflated."""
    return zlib.compress(x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unsqueeze(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def pre_tokens(encoder: Encoder, text: str) -> list[str]:
    """Pre-tokens of a text that the chunks don't cover; added tokens stand for themselves."""
    t = encoder.library
    parts = re.split("(" + "|".join(map(re.escape, encoder.added)) + ")", text) if encoder.added else [text]
    found: list[str] = []
    for p in parts:
        if p in encoder.added:
            found.append("\0" + p)
        elif p:
            p = t.normalizer.normalize_str(p) if t.normalizer else p
            found += [x for x, _ in t.pre_tokenizer.pre_tokenize_str(p)]
    return found


class Block:
    """Pre-token frequencies of some documents; segments are split into pre-tokens once per block."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.ids, self.sizes, self.docs = encoder, [], [], []
        self.units: dict[tuple[bytes | str, bool], int] = {}

    def add(self, ids: list, sizes: list[int], rows: np.ndarray, codes: np.ndarray, units: list[tuple[bytes | str, bool]]) -> None:
        """Documents with these ids and sizes in bytes; rows, codes, units: see Encoder.segments."""
        place = self.units
        number = np.fromiter((place.setdefault(u, len(place)) for u in units), np.int64, len(units))
        ends = np.searchsorted(rows, np.arange(len(ids) + 1))
        codes = number[codes]
        self.docs += [codes[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]
        self.ids += ids
        self.sizes += sizes

    def row(self, block: int) -> dict:
        vocab: dict[str, int] = {}
        parts: list[list[int]] = []
        for u, plain in self.units:
            pieces = pre_tokens(self.encoder, u) if isinstance(u, str) else self.encoder.pieces(u, plain)
            parts.append([vocab.setdefault(x, len(vocab)) for x in pieces])
        n = np.array([len(p) for p in parts] or [0])
        flat = np.array([x for p in parts for x in p], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(n)])
        lengths, idx, freq = [], [], []
        for d in self.docs:
            u, c = np.unique(d, return_counts=True)
            reach = n[u] if len(u) else np.zeros(0, np.int64)
            at = np.repeat(starts[u] - np.concatenate([[0], np.cumsum(reach)[:-1]]), reach) + np.arange(reach.sum()) if len(u) else np.zeros(0, np.int64)
            w, back = np.unique(flat[at], return_inverse=True)
            idx.append(w.astype(np.int32))
            freq.append(np.bincount(back, weights=np.repeat(c, reach), minlength=len(w)).astype(np.int32))
            lengths.append(len(w))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int32)
        # a document's places ascend: their differences are small
        packed = squeeze(np.concatenate([np.diff(join(idx), prepend=np.int32(0)), join(freq)]))
        return {"block": block, "doc_ids": self.ids, "n_bytes": self.sizes, "lengths": lengths, "packed": packed, "vocab": list(vocab)}


def _batch(row: dict) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "doc_ids": pa.list_(pa.int64()), "n_bytes": pa.list_(pa.int64()), "lengths": pa.list_(pa.int32()), "packed": pa.binary(), "vocab": pa.list_(pa.string())}

    def column(k, kind):
        if not pa.types.is_list(kind):
            return pa.array([row[k]], kind)
        values = pa.array(row[k], kind.value_type)
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    return pa.RecordBatch.from_arrays([column(k, kind) for k, kind in kinds.items()], names=list(kinds))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of `docs` (doc_id, text); path: a vocabulary of the tokenizers library."""
    path = path or vocabulary(VOCABULARY)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block = worker_encoder(path), TaskContext.get().partitionId() << 32
        now, size = Block(encoder), 0
        for b in batches:
            names, (_, offsets) = b.column(0).to_pylist(), utf8(b.column(1))
            sizes = np.diff(offsets).tolist()
            for first, stop, *found in encoder.segments(b.column(1)):
                here = int(offsets[stop] - offsets[first])
                if now.ids and size + here > BLOCK:
                    yield _batch(now.row(block))
                    now, size, block = Block(encoder), 0, block + 1
                now.add(names[first:stop], sizes[first:stop], *found)
                size += here
        if now.ids:
            yield _batch(now.row(block))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bucket = np.array([zlib.crc32(w.encode()) for w in words], np.int64) % n_buckets
                order = np.argsort(bucket, kind="stable")
                names, first = np.unique(bucket[order], return_index=True)
                groups = np.split(order, first[1:]) if len(order) else []
                # byte-level pre-tokens hold no line feed
                packed = [zlib.compress("\n".join([words[k] for k in g]).encode(), 1) for g in groups]
                places = [squeeze(np.diff(g, prepend=0)) for g in groups]
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(np.full(len(names), block, np.int64)), pa.array(packed, pa.binary()), pa.array(places, pa.binary())], names=["bucket", "block", "words", "places"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, now, known = load(path).model, None, {}
        for b in batches:
            out = []
            for bucket, data in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if bucket != now:
                    now, known = bucket, {}
                words = zlib.decompress(data.as_py()).decode().split("\n")
                for w in set(words).difference(known):
                    known[w] = 1 if w[:1] == "\0" else len(model.tokenize(w))
                out.append(squeeze(np.array([known[w] for w in words])))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(3), pa.array(out, pa.binary())], names=["block", "places", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                parts = b.column("counted")[k].as_py() or []
                places = [np.cumsum(unsqueeze(x["places"])) for x in parts]
                n = np.zeros(sum(map(len, places)), np.int64)
                for at, x in zip(places, parts, strict=True):
                    n[at] = unsqueeze(x["counts"])
                idx, freq = np.split(unsqueeze(b.column("packed")[k].as_py()), 2)
                sums = np.concatenate([[0], np.cumsum(n[np.cumsum(idx)] * freq.astype(np.int64))])
                ends = np.cumsum(b.column("lengths")[k].values.to_numpy().astype(np.int64))
                tokens = sums[ends] - sums[np.concatenate([[0], ends[:-1]]).astype(np.int64)]
                ids = b.column("doc_ids")[k].values
                yield pa.RecordBatch.from_arrays([ids, b.column("n_bytes")[k].values, pa.array(tokens, pa.int64()), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    made = cut(docs.select(F.col("doc_id").cast("bigint"), text_col().alias("text")).mapInArrow(blocks, BLOCKS), "blocks")
    n_buckets = min(max(made.count(), BUCKETS[0]), BUCKETS[1])
    dealt = made.select("block", "vocab").mapInArrow(deal, "bucket int, block bigint, words binary, places binary")
    counted = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "block bigint, places binary, counts binary")
    per_block = counted.groupBy("block").agg(F.collect_list(F.struct("places", "counts")).alias("counted"))  # bounded by the block's text
    return made.drop("vocab").join(per_block, "block", "left").mapInArrow(total, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
