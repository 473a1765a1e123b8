"""Join of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Documents with the same shingle set form a class; classes are compared, copies never are.
1. Each class gets a MinHash signature; classes that agree on a band of it meet in a bucket.
2. In a bucket, pairs are compared hash by hash, and dropped once the posterior probability that
   their similarity reaches the threshold, given the matches so far, is below a tolerance.
3. The pairs left connect classes into candidate groups, where exactly these pairs are verified on
   the shingle sets: a group's tasks find them again from the signatures, which costs less than to
   write out the pairs of a group of near copies.
Buckets and groups above a size are dealt into blocks, and every pair of blocks is a task of its
own: nothing is dropped or capped, and no task holds more than two blocks.

A pair of similarity 0.8 shares no band with probability (1 - 0.8**4) ** 20 = 3e-5.

Defined results: null, empty or wordless texts have no shingles and no links and are classes of
their own; texts of one to four words are one shingle; null doc_ids are kept, and are the class or
component id only where no other id is there; repeated rows are copies; an empty table gives an
empty frame; other columns, whatever their names, are ignored by `jaccard_join` and kept by
`keep_one`, which leaves one row of each component, the least doc_id's (of several with that id, or
without one, the least text's by hash), and every wordless row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, free_names, join_by_size, small, text_col, tidy, with_components
from .shingles import pieces, shingles, signatures

SIMILARITY = 0.8
BANDS, ROWS = 20, 4
TOLERANCE = 1e-6
STEP = 16
BUCKET_BLOCK, GROUP_BLOCK = 1000, 400
ROW_BYTES = 4 * ROWS


def needed_matches(n: int, similarity: float, tolerance: float, step: int = STEP) -> list[tuple[int, int]]:
    """[(hashes seen, least matches)]: with fewer, P(similarity >= threshold | matches) < tolerance under a flat prior.

    Low bytes of hashes are compared, which also agree by chance, once in 256.
    """
    s = (np.arange(20000) + 0.5) / 20000
    p = s + (1 - s) / 256
    out = []
    for k in range(step, n + 1, step):
        for m in range(k + 1):
            like = np.exp(m * np.log(p) + (k - m) * np.log1p(-p) - k * np.log(0.5))
            if like[s >= similarity].sum() >= tolerance * like.sum():
                out.append((k, m))
                break
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, same (hash of the text), node (digest of the shingle set, null without shingles), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, stop in pieces(b.column(2)):
                part = b.slice(at, stop - at)
                h, o = shingles(part.column(2))
                sig = signatures(h, o, BANDS * ROWS)
                nodes = [xxhash.xxh3_128_digest(np.unique(h[s:e]).tobytes()) if e > s else None for s, e in zip(o[:-1], o[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary())], names=["doc_id", "same", "node", "signature"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_col()).alias("same"), text_col().alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id bigint, same bigint, node binary, signature binary")


def blocked(rows: DataFrame, size: str, block: int) -> DataFrame:
    """Adds blk, bi, bj: rows of a group of `size` dealt into blocks, one copy of a row for each pair of blocks it is in."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"bi": F.least("blk", "other"), "bj": F.greatest("blk", "other")}).drop("blocks", "other", size)


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by `keys`; the last group of a table may go on, so it waits."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        change = _changes(t, keys)
        last = int(change[-1])
        if last:
            yield t.slice(0, last)
        t = t.slice(last)
        held, rows = t.to_batches(), 0 if last else t.num_rows
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _changes(t: pa.Table, keys: list[str]) -> np.ndarray:
    """First rows of the groups."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        v = t.column(k).combine_chunks()
        v = v.to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place that each of n places is joined to by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def surviving(low: np.ndarray, a: np.ndarray, b: np.ndarray, need: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) that are not dropped, comparing a step of hashes at a time. low: low bytes of each row's hashes."""
    matches, done = np.zeros(len(a), np.int32), 0
    for k, m in need:
        matches = matches + (low[a, done:k] == low[b, done:k]).sum(axis=1)
        ok = matches >= m
        a, b, matches, done = a[ok], b[ok], matches[ok], k
    return a, b


def low_bytes(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint32).astype(np.uint8).reshape(len(signatures), BANDS * ROWS)


def candidate_edges(classes: DataFrame, need: list[tuple[int, int]]) -> DataFrame:
    """a, b: pairs of classes that survive, as stars within each block of a bucket."""
    key = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda t: F.xxhash64(t, F.substring(F.col("signature"), t * ROW_BYTES + 1, F.lit(ROW_BYTES))))
    met = classes.select("node", F.explode(key).alias("key"))
    sizes = met.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    # signatures go only to the buckets where several classes meet
    shared = cut(met.join(sizes, "key"), "buckets")
    rows = blocked(shared.join(classes.select("node", "signature"), "node"), "size", BUCKET_BLOCK)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ["key", "bi", "bj"]):
            n = t.num_rows
            first = _changes(t, ["key", "bi", "bj"])
            size = np.diff(np.append(first, n))
            left = np.repeat(first + size, size) - np.arange(n)  # rows from here to the group's end
            low = low_bytes(t.column("signature").to_pylist())
            blk, cross = t.column("blk").to_numpy(), t.column("bi").to_numpy() != t.column("bj").to_numpy()
            some_a, some_b = [], []
            live = np.arange(n)
            for d in range(1, int(size.max())):
                live = live[left[live] > d]
                a, b = live, live + d
                ok = ~cross[a] | (blk[a] != blk[b])
                a, b = surviving(low, a[ok], b[ok], need)
                some_a.append(a)
                some_b.append(b)
            label = least_labels(n, np.concatenate(some_a or [live[:0]]), np.concatenate(some_b or [live[:0]]))
            joined = np.flatnonzero(label != np.arange(n))
            node = t.column("node").combine_chunks()
            yield pa.RecordBatch.from_arrays([node.take(pa.array(joined)), node.take(pa.array(label[joined]))], names=["a", "b"])

    keys = ["key", "bi", "bj"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "blk", "node", "signature").mapInArrow(tidy(compare), "a binary, b binary").distinct()


def band_pairs(sig: np.ndarray) -> np.ndarray:
    """which[i, j]: rows i and j agree on a band."""
    which = np.zeros((len(sig), len(sig)), bool)
    for t in range(BANDS):
        band = np.ascontiguousarray(sig[:, t * ROWS : (t + 1) * ROWS]).view(f"V{ROW_BYTES}").ravel()
        same = np.unique(band, return_inverse=True)[1]
        which |= same[:, None] == same[None, :]
    return which


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    flat = np.concatenate(sets)
    u, col, n = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = n > 1
    place = np.cumsum(often) - 1
    keep = often[col]
    row, col = row[keep], place[col[keep]]
    total = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, int(often.sum()), 8192):
        s, e = np.searchsorted(col, [at, at + 8192])
        x = np.zeros((len(sets), 8192), np.float32)
        x[row[s:e], col[s:e] - at] = 1
        total += x @ x.T
    return np.rint(total).astype(np.int64)


def verified_links(docs: DataFrame, members: DataFrame, similarity: float, need: list[tuple[int, int]]) -> DataFrame:
    """node, links, root for every candidate class: verified pairs in a pair of blocks, and the least class they join it to.

    members: node, component, rep and like (doc_id and hash of a text of the class), signature, size (classes of the component).
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, stop in pieces(b.column(0)):
                part = b.slice(at, stop - at)
                h, o = shingles(part.column(0))
                own = [np.unique(h[s:e]).tobytes() for s, e in zip(o[:-1], o[1:], strict=True)]
                same = [xxhash.xxh3_128_digest(x) == y.as_py() for x, y in zip(own, part.column(1), strict=True)]
                rows = pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(own, pa.binary())], names=["node", "component", "signature", "size", "shingles"])
                yield rows.filter(pa.array(same, pa.bool_()))

    # a member's text is fetched by its id and hash, as ids may be missing or repeated: only the members' texts move, unless there are very many
    m, d = members.withColumnsRenamed({"rep": "of", "like": "alike"}), docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(text_col()).alias("own"), text_col().alias("text"))
    ids = small(cut(m.select("of", "alike").distinct(), "members"))
    wanted = d.join(ids, d["id"].eqNullSafe(ids["of"]) & (d["own"] == ids["alike"]), "left_semi")
    found = wanted.join(m, wanted["id"].eqNullSafe(m["of"]) & (wanted["own"] == m["alike"])).select("text", "node", "component", "signature", "size")
    rows = blocked(found.mapInArrow(tidy(sets), "node binary, component binary, signature binary, size bigint, shingles binary"), "size", GROUP_BLOCK)
    least = similarity - 1e-12

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ["component", "bi", "bj"], 1000):
            first = _changes(t, ["component", "bi", "bj"])
            nodes, blks, bi, bj = t.column("node").to_pylist(), t.column("blk").to_numpy(), t.column("bi").to_numpy(), t.column("bj").to_numpy()
            data, signature = t.column("shingles"), t.column("signature")
            out_node, out_links, out_root = [], [], []
            for s, e in zip(first, np.append(first[1:], t.num_rows), strict=True):
                own: dict[bytes, int] = {}
                for k in range(s, e):  # repeated rows once
                    own.setdefault(nodes[k], k)
                at = np.array([own[x] for x in sorted(own)])
                sig = np.frombuffer(b"".join(signature[int(k)].as_py() for k in at), np.uint32).reshape(len(at), BANDS * ROWS)
                met = np.triu(band_pairs(sig), 1)
                if bi[s] != bj[s]:
                    met &= blks[at][:, None] != blks[at][None, :]
                a, b = surviving(sig.astype(np.uint8), *np.nonzero(met), need)
                linked = np.zeros(met.shape, bool)
                if len(a):
                    # exact sizes of what the surviving pairs share, one connected lot of them at a time
                    label = least_labels(len(at), a, b)
                    for lot in np.unique(label[a]):
                        who = np.flatnonzero(label == lot)
                        x = [np.frombuffer(data[int(k)].as_py(), np.uint64) for k in at[who]]
                        n, both = np.array([len(v) for v in x]), shared_counts(x)
                        linked[np.ix_(who, who)] = both >= least * (n[:, None] + n[None, :] - both)
                    kept = np.zeros(met.shape, bool)
                    kept[a, b] = True
                    linked &= kept | kept.T
                a, b = np.nonzero(linked)
                label = least_labels(len(at), a, b)
                out_node += [nodes[k] for k in at]
                out_links += linked.sum(axis=1).tolist()
                out_root += [nodes[at[k]] for k in label]
            yield pa.RecordBatch.from_arrays([pa.array(out_node, pa.binary()), pa.array(out_links, pa.int64()), pa.array(out_root, pa.binary())], names=["node", "links", "root"])

    keys = ["component", "bi", "bj"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "blk", "node", "signature", "shingles").mapInArrow(tidy(verify), "node binary, links bigint, root binary")


def _joined(docs: DataFrame, similarity: float, tolerance: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (doc_id, same, node), a table of classes (node, class_id, class_size, n_links, component, component_id), and rows without words."""
    rows = cut(sketch(docs), "sketches")
    need = needed_matches(BANDS * ROWS, similarity, tolerance)
    classes = cut(
        rows.filter("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same")).alias("x"), F.count("*").alias("class_size"), F.max("signature").alias("signature"))
        .select("node", F.col("x.doc_id").alias("rep"), F.col("x.same").alias("like"), "class_size", "signature"), "classes",
    )
    edges = cut(candidate_edges(classes, need), "candidates")
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    components = cut(with_components(ends, edges), "components")
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    members = join_by_size(components, sizes, "component", "size", components.count()).withColumnRenamed("id", "node").join(classes.select("node", "rep", "like", "signature"), "node")
    links = cut(verified_links(docs, members.select("node", "component", "rep", "like", "signature", "size"), similarity, need), "links")
    joined = links.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    counts = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    linked = cut(with_components(counts.select(F.col("node").alias("id")), joined), "linked").withColumnRenamed("id", "node")
    heads = linked.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("size"))
    found = join_by_size(linked, heads, "component", "size", linked.count()).join(counts, "node").select("node", "component", "component_id", "n_links")
    table = cut(
        classes.select("node", "rep", "class_size").join(found, "node", "left").select(
            "node", F.col("rep").alias("class_id"), "class_size", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "rep").alias("component_id"),
        ), "class-table",
    )
    return rows.filter("node is not null").select("doc_id", "same", "node"), table, rows.filter("node is null").select("doc_id")


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id, class_size, n_links, component_id, kept for each row of `docs` (doc_id, text).

    class_id: least doc_id with the same shingle set. n_links: other classes with at least this
    similarity to the document's. component_id: least doc_id reachable by links; that one is kept.
    """
    rows, table, wordless = _joined(docs, similarity, tolerance)
    own = {"class_id": F.col("doc_id"), "class_size": F.lit(1).cast("bigint"), "n_links": F.lit(0).cast("bigint"), "component_id": F.col("doc_id")}
    alone = wordless.select("doc_id", *[c.alias(k) for k, c in own.items()])
    together = join_by_size(rows, table, "node", "class_size", rows.count()).select("doc_id", *own)
    return together.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of `docs`, all columns, that are kept: one of each component, and all without words."""
    rows, table, _ = _joined(docs, similarity, tolerance)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same")
    heads = join_by_size(rows, table.select("node", "class_size", "component"), "node", "class_size", rows.count()).groupBy("component").agg(F.min(first).alias("x"))
    of, like, own = free_names(docs.columns, "of", "like", "own")
    kept = heads.select(F.col("x.doc_id").alias(of), F.col("x.same").alias(like))
    marked = docs.withColumn(own, F.xxhash64(text_col()))
    words = text_col().rlike(WORD)
    match = F.col("doc_id").cast("bigint").eqNullSafe(F.col(of)) & (F.col(own) == F.col(like))
    one = marked.filter(words).join(kept, match, "left_semi").dropDuplicates(["doc_id", own]).select(docs.columns)
    return one.unionByName(docs.filter(~words))


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
c AS (SELECT g, min(doc_id) AS class_id, count(*) AS class_size FROM s WHERE len(g) > 0 GROUP BY g),
u AS (SELECT class_id, len(g) AS n, unnest(g) AS x FROM c),
p AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.x = b.x AND a.class_id <> b.class_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE k * 5 >= 4 * (na + nb - k)),
r AS (SELECT class_id AS a, class_id AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
o AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT s.doc_id, coalesce(c.class_id, s.doc_id) AS class_id, CAST(coalesce(c.class_size, 1) AS BIGINT) AS class_size, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links,
       coalesce(o.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(o.component_id, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.g = s.g AND len(s.g) > 0 LEFT JOIN o ON o.a = c.class_id LEFT JOIN n ON n.a = c.class_id
"""
