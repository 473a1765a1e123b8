"""Exact substring dedup: bytes covered by a string of `length` bytes that starts anywhere else too.

A sorted suffix array is kept only at content-defined positions. Every string of `length` bytes
holds an anchor: the gram of smallest hash in it, the rightmost of equals. Equal strings have equal
anchors at equal places, so each string belongs to one anchor and is looked for among the
occurrences of that anchor alone:
1. Anchors are found in one pass over the bytes; those that occur once are dropped by a grouped
   count, with map-side combining.
2. Occurrences whose whole surroundings are equal (in two 64-bit hashes, of the anchor and of all
   bytes around it) are classes: what they cover is repeated. One of each class goes on, so copies of
   any number are one row.
3. The suffixes that start at the occurrences of an anchor are sorted, and the bytes that precede
   them are the Burrows-Wheeler columns. Intervals of the sorted suffixes are extended backwards
   one byte at a time, breadth first over all anchors of a task at once; the common prefixes of
   neighbours and the bytes prepended so far add up to the common length of a level, and intervals
   that can no longer reach `length` stop.
A group with more classes than a task should hold is split by where in a string its anchor lies: strings
with between x and y bytes before it share the bytes from x before it to length - y behind its start, so
each half of the places gives groups of its own by those bytes, and so on. Where one place is left, the
shared bytes are the whole string, and all of a group repeat it.

Defined results: null text is empty; nothing shorter than `length` is removed; documents with null or
repeated doc_ids keep a row each; rows that repeat both id and text are copies of each other; an
empty table gives an empty frame; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_by_size, small, text_col
from .jaccard_join import _changes, by_group
from .shingles import BASE, BYTE, U, _powers, mix, utf8

LENGTH, GRAM = 200, 32
#: Bytes handled at once; longer texts are read in parts that overlap by length - 1.
PART = 1 << 20
#: Classes of a group that one task sorts, at most; larger groups are split.
GROUP = 20_000
ANCHORS = "h bigint, c bigint, i bigint, k bigint, a bigint, lo smallint, hi smallint"
#: A row's identity: its id, or the least number where there is none, and a hash of id and text.
KEY = ["i", "k"]


def doc_key(docs: DataFrame):
    """doc_id, text and KEY; rows with the same key have the same id and text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_col().alias("text"))
    return rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("i"), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text").alias("k"))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place; GRAM is a power of two."""
    h, n, factor = BYTE[data], 1, BASE
    while n < GRAM:
        h = h[:-n] * factor + h[n:]
        factor = factor * factor * U(3) + U(2)
        n *= 2
    return mix(h)


def anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, hash, surroundings, anchor, lo, hi) of each anchor of texts data[begin:end].

    lo and hi: the anchor lies so many bytes into the first and last string that it stands for.
    """
    none = np.zeros(0, np.int64)
    texts = np.flatnonzero(end - begin >= length)
    if not texts.size:
        return none, none, none, none, none, none
    with np.errstate(over="ignore"):
        g = gram_hashes(data)
    bits = U(max(1, int(len(g)).bit_length()))
    key = ((g >> bits) << bits) | (U(len(g)) - np.arange(len(g), dtype=np.uint64))
    window, m, n = length - GRAM + 1, key, 1
    while 2 * n <= window:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    if window > n:
        m = np.minimum(m[: len(m) - (window - n)], m[window - n :])
    where = len(g) - (m & ((U(1) << bits) - U(1))).astype(np.int64)
    count = end[texts] - begin[texts] - length + 1
    offset = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(begin[texts] - offset[:-1], count) + np.arange(offset[-1])
    at = where[start]
    fresh = np.concatenate([[True], at[1:] != at[:-1]])
    fresh[offset[1:-1]] = True
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1
    a, low, high = at[first], start[first], start[last] + length
    up, down = _powers(max(12, int(len(data)).bit_length()))
    h = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * up[: len(data)], dtype=np.uint64)])
    lo, hi = a - low, a - start[last]
    c = mix((h[high] - h[low]) * down[low] + (lo * 512 + hi).astype(np.uint64) * BASE)
    text = texts[np.searchsorted(offset, first, "right") - 1]
    return text, g[a].view(np.int64), c.view(np.int64), a, lo, hi


def parts(column: pa.Array, length: int, part: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, begin, end, row, offset in the row's text) for about `part` bytes at a time; every string of `length` bytes starts in one."""
    data, offsets = utf8(column)
    held: list[tuple[int, int, int]] = []
    size = 0
    for row, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        at = s
        while e - at >= length or at == s:
            stop = min(e, at + part)
            held.append((row, at, stop))
            size += stop - at
            if size >= part:
                yield _joined(data, offsets, held)
                held, size = [], 0
            if stop == e:
                break
            at = stop - length + 1
    if held:
        yield _joined(data, offsets, held)


def _joined(data, offsets, held):
    row, s, e = (np.array(x, np.int64) for x in zip(*held, strict=True))
    end = np.cumsum(e - s)
    return np.concatenate([data[x:y] for x, y in zip(s, e, strict=True)]), end - (e - s), end, row, s - offsets[row]


def find_anchors(keyed: DataFrame, length: int, part: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, k = b.column(1).to_numpy(), b.column(2).to_numpy()
            for data, begin, end, row, offset in parts(b.column(0), length, part):
                text, h, c, a, lo, hi = anchors(data, begin, end, length)
                cols = [h, c, i[row[text]], k[row[text]], a - begin[text] + offset[text], lo.astype(np.int16), hi.astype(np.int16)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["h", "c", *KEY, "a", "lo", "hi"])

    return keyed.select("text", *KEY).mapInArrow(run, ANCHORS)


def least_between(values: np.ndarray):
    """A function of places (p, q), p < q, giving min(values[p + 1 : q + 1]), from a table of powers of two."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        n = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-n], table[-1][n:]))
    sizes = np.zeros(len(values) + 1, np.int64)
    sizes[2:] = np.floor(np.log2(np.arange(2, len(values) + 1))).astype(np.int64)

    def least(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        level = sizes[q - p]
        out = np.zeros(len(p), values.dtype)
        for n in np.unique(level):
            some = level == n
            out[some] = np.minimum(table[n][p[some] + 1], table[n][q[some] - (1 << n) + 1])
        return out

    return least


def repeated_offsets(group: np.ndarray, left: np.ndarray, right: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """marks[i, o]: the string that starts o bytes before anchor i occurs at another row of its group too.

    left[i, j]: the byte j + 1 places before the anchor; right[i]: the bytes from it on; both zero beyond lo and length - hi.
    """
    n = len(group)
    marks = np.zeros((n, length - GRAM + 1), bool)
    key = np.concatenate([group.astype(">u8").view(np.uint8).reshape(n, 8), right], axis=1)
    order = np.argsort(np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel(), kind="stable")
    # common prefixes of neighbouring suffixes
    a, b = order[:-1], order[1:]
    differ = right[a] != right[b]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    common = np.minimum(common, length - np.maximum(hi[a], hi[b]))
    common[group[a] != group[b]] = 0
    prefixes = np.concatenate([[0], common])
    least = least_between(prefixes)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    rows, interval, near = order, group[order], prefixes
    for o in range(marks.shape[1]):
        joined = np.concatenate([[False], interval[1:] == interval[:-1]])
        near = np.where(joined, near, 0)
        found = near >= length - o
        # a string needs o bytes in front and length - o behind
        marks[rows[found], o] = True
        marks[rows[np.flatnonzero(found) - 1], o] = True
        best = np.maximum(near, np.append(near[1:], 0))
        alive = (lo[rows] > o) & (best >= length - lo[rows])
        rows, interval = rows[alive], interval[alive]
        if len(rows) < 2:
            break
        # extend backwards: the byte before, stable within the interval, gives the next level's intervals
        byte = left[rows, o].astype(np.int64)
        number = np.cumsum(np.concatenate([[0], interval[1:] != interval[:-1]]))
        step = number * 256 + byte
        sort = np.argsort(step, kind="stable")
        rows, interval = rows[sort], step[sort]
        r = rank[rows]
        same = np.flatnonzero(interval[1:] == interval[:-1])
        near = np.zeros(len(rows), np.int64)
        near[same + 1] = least(r[same], r[same + 1])
    return marks


def spans_of(marks: np.ndarray, a: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs of marked strings."""
    padded = np.pad(marks, ((0, 0), (1, 1)))
    row, first = np.nonzero(padded[:, 1:] & ~padded[:, :-1])
    last = np.nonzero(padded[:, :-1] & ~padded[:, 1:])[1] - 1
    return row, a[row] - last, a[row] - first + length


def split_groups(around: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(rows with a group `g` of GROUP rows at most, rows of a string that repeats: KEY, start, end).

    x, y: the strings looked for in a group have between x and y bytes before the anchor; bytes: from
    lo before the anchor to length - hi behind it.
    """
    rows = around.withColumns({"g": F.xxhash64("h"), "x": F.lit(0), "y": F.lit(length - GRAM)})
    done, repeated = None, None
    while True:
        # one row for every GROUP rows at most
        giant = cut(rows.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).select("g"), "giant-groups")
        if giant.isEmpty():
            return rows if done is None else done.unionByName(rows), repeated
        ready, big = rows.join(small(giant), "g", "left_anti"), rows.join(small(giant), "g", "left_semi")
        done = ready if done is None else done.unionByName(ready)
        middle = F.floor((F.col("x") + F.col("y")) / 2).cast("int")
        halves = F.array(F.struct(F.col("x").alias("x"), middle.alias("y")), F.struct((middle + 1).alias("x"), F.col("y").alias("y")))
        split = big.withColumn("half", F.explode(halves)).withColumns({"x": F.col("half.x"), "y": F.col("half.y")}).drop("half").filter("hi <= y AND lo >= x AND x <= y")
        core = F.expr(f"substring(bytes, lo - x + 1, {length} - y + x)")
        split = cut(split.withColumn("core", F.when(F.col("x") == F.col("y"), core)).withColumn("g", F.xxhash64("h", "x", "y", core)), "split-groups")
        # one place left: the string itself, compared whole
        strings = split.filter("x = y")
        often = cut(strings.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1"), "repeated-strings")
        hits = join_by_size(strings, often, "core", "n", strings.count()).select(*KEY, (F.col("a") - F.col("x")).alias("start"), (F.col("a") - F.col("x") + length).alias("end"))
        repeated = hits if repeated is None else repeated.unionByName(hits)
        rows = split.filter("x < y").drop("core")


def repeated_spans(docs: DataFrame, length: int = LENGTH, part: int = PART) -> DataFrame:
    """KEY and spans (array of start and end in bytes, which may overlap) for the keys of `doc_key(docs)` that have any."""
    keyed = doc_key(docs)
    found = cut(find_anchors(keyed, length, part), "anchors")
    often = found.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("n > 1").select("h", (F.col("c0") != F.col("c1")).alias("mixed"))
    often = cut(often, "repeated")  # a table, so that Spark may split the rows of a very common anchor in the join
    rows = cut(found.join(often, "h"), "repeated-anchors")
    classes = cut(rows.groupBy("h", "c", "mixed").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "a", "lo", "hi")).alias("m")), "anchor-classes")
    whole = join_by_size(rows.drop("mixed"), classes.filter("n > 1").select("h", "c", "n"), ["h", "c"], "n", rows.count()).select(*KEY, (F.col("a") - F.col("lo")).alias("start"), (F.col("a") - F.col("hi") + length).alias("end"))

    mixed = classes.filter("mixed").select("h", (F.col("n") == 1).alias("single"), "m.*")
    wanted = mixed.groupBy(*KEY).agg(F.collect_list(F.struct("h", "a", "lo", "hi", "single")).alias("wanted"))  # bounded by the document's text

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "a", "lo", "hi", "single"]
        for b in batches:
            for r in range(b.num_rows):
                data, w = b.column("text")[r].as_buffer(), b.column("wanted")[r].values
                a, lo, hi = (w.field(x).to_numpy() for x in ("a", "lo", "hi"))
                bytes_ = [data[int(x - y) : int(x - z + length)].to_pybytes() for x, y, z in zip(a, lo, hi, strict=True)]
                own = [pa.array(np.full(len(a), b.column(x)[r].as_py())) for x in KEY]
                yield pa.RecordBatch.from_arrays([*own, *[w.field(x) for x in names], pa.array(bytes_, pa.binary())], names=[*KEY, *names, "bytes"])

    around = cut(keyed.join(wanted, KEY).select(*KEY, "text", "wanted").mapInArrow(surroundings, "i bigint, k bigint, h bigint, a bigint, lo smallint, hi smallint, single boolean, bytes binary"), "surroundings")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ["g"]):
            n = t.num_rows
            first = _changes(t, ["g"])
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, n))).astype(np.int64)
            a, lo, hi = (t.column(x).to_numpy().astype(np.int64) for x in ("a", "lo", "hi"))
            left, right = np.zeros((n, length - GRAM + 1), np.uint8), np.zeros((n, length), np.uint8)
            for r, x in enumerate(t.column("bytes").to_pylist()):
                v = np.frombuffer(x, np.uint8)
                left[r, : lo[r]] = v[: lo[r]][::-1]
                right[r, : len(v) - lo[r]] = v[lo[r] :]
            marks = repeated_offsets(group, left, right, lo, hi, length)
            marks[~t.column("single").to_numpy()] = False  # all of theirs is repeated anyway
            row, start, end = spans_of(marks, a, length)
            yield pa.RecordBatch.from_arrays([*[t.column(x).combine_chunks().take(pa.array(row)) for x in KEY], pa.array(start), pa.array(end)], names=[*KEY, "start", "end"])

    groups, strings = split_groups(around, length)
    spans = whole.unionByName(groups.repartition("g").sortWithinPartitions("g").select("g", *KEY, "a", "lo", "hi", "single", "bytes").mapInArrow(extend, "i bigint, k bigint, start bigint, end bigint"))
    spans = spans if strings is None else spans.unionByName(strings)
    return spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def without_repeats(docs: DataFrame, length: int = LENGTH, part: int = PART) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs, in bytes), kept (the remaining bytes) for each row of `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            size, out, kept = [], [], []
            for t, w in zip(b.column("text"), b.column("spans"), strict=True):
                data = t.as_buffer().to_pybytes()
                v = w.values
                spans = merged(list(zip(v.field("start").to_pylist(), v.field("end").to_pylist(), strict=True))) if w.is_valid else []
                at, rest = 0, []
                for s, e in spans:
                    rest.append(data[at:s])
                    at = e
                size.append(len(data))
                out.append([{"start": s, "end": e} for s, e in spans])
                kept.append(b"".join([*rest, data[at:]]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(out, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    spans = cut(repeated_spans(docs, length, part), "spans")
    return doc_key(docs).join(spans, KEY, "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
