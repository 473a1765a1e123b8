"""BPE encoding and decoding of whole texts.

A pre-token is a list of symbols, doubly linked. The merges of its neighbours wait in a priority
queue by rank, then place; the least is carried out, and its new neighbours join the queue. An entry
whose symbols have changed meanwhile is stale and skipped, so a pre-token of n symbols takes
n log n steps, however long it is. Segments of text and the ids of those that a worker has met are
kept as in `tokenizing`; normalising and cutting into pre-tokens is the vocabulary file's, by the
library. Decoding joins the vocabulary's strings, many documents at once.

Defined results: null text is empty and has no ids; strings of added tokens are one token, as the
library has it by default; ids that the vocabulary does not hold decode to nothing; bytes that are
no UTF-8 decode to U+FFFD; null and repeated doc_ids keep a row each; an empty table gives an empty
frame; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_col
from .token_counts import VOCABULARY, pre_tokens
from .tokenizing import Encoder, byte_letters, flat, load, pack, vocabulary

#: Characters of pre-tokens, from texts that the library cuts, whose ids a worker keeps at most.
KEPT = 8_000_000


class Merges:
    """Symbols and ranked merges of a BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        if model["type"] != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback")):
            raise ValueError("only plain BPE vocabularies, without dropout, unknown tokens, prefixes or byte fallback")
        self.vocab, self.end, self.direct = model["vocab"], model.get("end_of_word_suffix") or "", bool(model.get("ignore_merges"))
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in made["added_tokens"]}

    def ids(self, piece: str) -> list[int]:
        """Ids of a pre-token."""
        if not piece:
            return []
        if self.direct and piece in self.vocab:
            return [self.vocab[piece]]
        symbols = [self.vocab.get(c) for c in [*piece[:-1], piece[-1] + self.end]]
        return self.merged([s for s in symbols if s is not None])

    def merged(self, at: list[int]) -> list[int]:
        """The symbols `at` after all merges."""
        n, rank = len(at), self.rank
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(rank[pair][0], k) for k, pair in enumerate(zip(at, at[1:])) if pair in rank]
        heapify(queue)
        while queue:
            r, k = heappop(queue)
            right = after[k]
            if at[k] < 0 or right < 0:
                continue
            found = rank.get((at[k], at[right]))
            if found is None or found[0] != r:
                continue
            at[k], at[right] = found[1], -1
            after[k] = after[right]
            if after[k] >= 0:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] >= 0 and (new := rank.get((at[left], at[after[left]]))):
                    heappush(queue, (new[0], left))
        return [x for x in at if x >= 0]


class BpeEncoder(Encoder):
    """Segments as they are, ids by the merges here instead of the library's."""

    def __init__(self, path: str):
        super().__init__(path)
        self.merges, self.known, self.room = Merges(path), {}, KEPT

    def tokens(self, piece: str) -> list[int]:
        return self.merges.ids(piece)

    def whole(self, text: str) -> np.ndarray:
        out: list[int] = []
        for p in pre_tokens(self, text):
            found = self.known.get(p)
            if found is None:
                found = [self.merges.added[p[1:]]] if p[0] == "\0" else self.merges.ids(p)
                self.room -= len(p) + 40
                if self.room < 0:
                    self.known, self.room = {}, KEPT
                self.known[p] = found
            out += found
        return np.array(out, np.uint32)


@lru_cache(maxsize=1)
def bpe_encoder(path: str) -> BpeEncoder:
    return BpeEncoder(path)


class Decoder:
    """Strings of a vocabulary file, as bytes one after the other."""

    def __init__(self, path: str):
        library = load(path)
        with open(path, encoding="utf-8") as f:
            kind = (json.load(f).get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"no decoder {kind!r}")
        # without a decoder, strings are set apart by a space
        self.spaced = kind is None
        letters = {c: b for b, c in byte_letters().items()}
        names = library.get_vocab(with_added_tokens=True)
        strings = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            strings[i] = name.encode() + b" " if self.spaced else bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        self.n = np.array([len(s) for s in strings] + [0])
        self.at, self.data = np.cumsum(self.n) - self.n, np.frombuffer(b"".join(strings), np.uint8)

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of ids[offsets[k] : offsets[k + 1]] for each k."""
        which = np.minimum(ids.astype(np.int64), len(self.n) - 1)
        n = self.n[which]
        ends = np.concatenate([[0], np.cumsum(n)])[offsets].tolist()
        data = self.data[flat(self.at[which], n)].tobytes()
        cut = 1 if self.spaced else 0
        return [data[s : max(s, e - cut)].decode("utf-8", "replace") for s, e in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) for each row of `docs` (doc_id, text)."""
    path = path or vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, stop, ids, offsets in bpe_encoder(path).encode(b.column(1)):
                each = [pack(ids[s:e]) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, stop - first), pa.array(np.diff(offsets)), pa.array(each, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), text_col().alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


def decoded(rows: DataFrame, path: str | None = None, most: int = 1 << 20) -> DataFrame:
    """`rows` with `text`, what its `ids` stand for (null: empty); about `most` ids are handled at once."""
    path = path or vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [x or b"" for x in b.column("ids").to_pylist()]
            ends = np.cumsum([len(x) // 4 for x in ids])
            at = 0
            while at < b.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids[at:stop]])])
                texts = decoder(path).texts(np.frombuffer(b"".join(ids[at:stop]), "<u4"), offsets)
                yield pa.RecordBatch.from_arrays([*b.slice(at, stop - at).columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])
                at = stop

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, text string")


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of `docs`: encoded and decoded in one task each."""
    path = path or vocabulary(VOCABULARY)
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, stop, ids, offsets in bpe_encoder(path).encode(b.column(1)):
                names = [sha(pack(ids[s:e])) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
                texts = [sha(t.encode()) for t in decoder(path).texts(ids, offsets)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, stop - first), pa.array(np.diff(offsets)), pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("bigint"), text_col().alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
