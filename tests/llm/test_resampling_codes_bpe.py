"""Importance resampling, vector codes and BPE against brute force, the library and plain Lloyd rounds."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import DATA, docs, empty, rows  # noqa: F401

from barloom.llm import bpe, importance, vector_codes
from barloom.llm.tokenizing import load, vocabulary


# --- 11
def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def plain_resample(rows, target, least=20, percent=5, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    found = [(i, *features(t)) for i, t in rows]
    own, wanted = Counter(), Counter()
    for _, _, fs in found:
        own.update(map(bucket, fs))
    for t in target:
        wanted.update(map(bucket, features(t)[1]))
    s, t = sum(own.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for i, words, fs in found:
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted([r for r in out if r[1] >= least], key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], -r[2]))
    drawn = Counter()
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        drawn[(r[0], *r[2:], place)] += 1
    rest = Counter((r[0], *r[2:], None) for r in able[percent * len(able) // 100 :]) + Counter((r[0], *r[2:], None) for r in out if r[1] < least)
    return drawn + rest


def test_importance_resampling(spark, docs, rows, empty):  # noqa: F811
    target = spark.read.parquet(f"{DATA}/benchmark.parquet").select("text").unionByName(spark.createDataFrame([(None,), ("",), ("Same TEXT again",)], "text string"))
    got = importance.resampled(docs, target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert Counter(map(tuple, got.collect())) == plain_resample([r[:2] for r in rows], [r.text for r in target.collect()])
    assert importance.resampled(empty, target).count() == 0
    none = importance.resampled(docs, target.limit(0)).collect()
    assert Counter(map(tuple, none)) == plain_resample([r[:2] for r in rows], [])


def test_features_of_one_long_text_come_from_chunks(spark):
    """Chunks of any size give the same n-grams, and none crosses a text."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "B", "ç1", "x2y"]) for _ in range(n)) for n in (500, 1, 0, 2, 90)]
    words, row = importance.words_of(pa.array(texts))
    for order in (1, 2, 3, 4):
        count = lambda chunk: sum((Counter(zip(r.tolist(), crc[code].tolist(), strict=True)) for r, code, crc in importance.chunks(words, row, order, chunk)), Counter())  # noqa: B023, E731
        want = Counter()
        for k, t in enumerate(texts):
            w = features(t)[0]
            want.update((k, zlib.crc32(" ".join(w[s : s + n]).encode())) for n in range(1, order + 1) for s in range(len(w) - n + 1))
        assert count(7) == count(10_000) == want


# --- 12
def plain_lloyd(vectors, parts=16, entries=64, rounds=2):
    """vectors: (vec_id, label, numbers). Plain rounds in Python's own integers."""
    rows = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in vectors]
    rows = [(i, label, v + [0] * (-len(v) % parts)) for i, label, v in rows]
    size = len(rows[0][2]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))[:entries]
    books = [[cut(r[2], p) for r in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for r in rows:
                own[near(cut(r[2], p), books[p])[1]].append(cut(r[2], p))
            books[p] = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(own, books[p], strict=True)]
    found = [(i, label, [near(cut(v, p), books[p]) for p in range(parts)]) for i, label, v in rows]
    sums = Counter()
    for _, label, m in found:
        sums[label] += sum(d for d, _ in m)
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return Counter((i, "".join(f"{e:02x}" for _, e in m), sum(d for d, _ in m), sums[label], sha) for i, label, m in found)


def test_vector_codes(spark):
    r = np.random.default_rng(6)
    centers = r.normal(size=(40, 32))
    good = [(k, int(k % 5) if k % 7 else None, (centers[k % 40] + 0.05 * r.normal(size=32)).tolist()) for k in range(400)]
    good += [(400, 1, good[3][2]), (400, 1, good[3][2]), (None, None, good[9][2]), (401, 2, [0.0] * 32), (402, 2, [-1e-9] * 32), (403, 2, [1e4] * 32)]
    bad = [(500, 1, None), (501, 1, [1.0, None] * 16), (502, 1, [float("nan")] * 32), (503, 1, [float("-inf")] * 32), (504, 1, [1e300] * 32)]
    random.Random(1).shuffle(good)
    df = spark.createDataFrame(good + bad, "vec_id long, label int, embedding array<double>").repartition(7).withColumns({"code": F.lit("x"), "dims": F.lit(3), "of": F.lit(1.5)})
    got = vector_codes.code_table(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_lloyd(good)
    assert vector_codes.code_table(df.limit(0)).count() == 0
    more = [(i, lb, v) for i, lb, v in good if i != 403]
    for rounds, entries in ((0, 64), (5, 8)):
        again = vector_codes.code_table(spark.createDataFrame(more, "vec_id long, label int, embedding array<float>").withColumn("embedding", F.col("embedding").cast("array<double>")), entries=entries, rounds=rounds)
        want = plain_lloyd([(i, lb, np.float32(v).tolist()) for i, lb, v in more], entries=entries, rounds=rounds)
        assert Counter(map(tuple, again.collect())) == want


def test_vectors_of_other_lengths_have_codebooks_of_their_own(spark):
    r = np.random.default_rng(2)
    short, odd = [(k, "a", r.normal(size=16).tolist()) for k in range(30)], [(100 + k, "b", r.normal(size=21).tolist()) for k in range(70)]
    got = vector_codes.code_table(spark.createDataFrame([*short, *odd, (900, "c", [])], "vec_id long, label string, embedding array<double>")).collect()
    assert Counter(tuple(r) for r in got if r.vec_id < 100) == plain_lloyd(short)
    assert Counter(tuple(r) for r in got if 100 <= r.vec_id < 900) == plain_lloyd(odd)
    assert [tuple(r)[1:4] for r in got if r.vec_id == 900] == [("00" * 16, 0, 0)]


def test_active_entries_give_what_a_full_scan_gives():
    """Many ties: few values, entries that repeat, some moved and some at rest."""
    r = np.random.default_rng(3)
    for _ in range(60):
        x, book = r.integers(0, 3, (200, 2)), r.integers(0, 3, (16, 2))
        code, dist = vector_codes.nearest(x, book)
        after = book.copy()
        some = r.random(16) < r.random()
        after[some] = r.integers(0, 3, (int(some.sum()), 2))
        moved = (after != book).any(axis=1)
        got, d = vector_codes.reassigned(x, after, moved, code, dist)
        want, e = vector_codes.nearest(x, after)
        assert (got == want).all() and (d == e).all()
    big = r.integers(-(1 << 27), 1 << 27, (20, 4))
    assert (vector_codes.squares(big, big[:5]) == ((big[:, None, :] - big[None, :5, :]) ** 2).sum(axis=2)).all()


# --- 13
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_is_the_librarys(docs, rows, empty, name):  # noqa: F811
    path = vocabulary(name)
    t = load(path)
    want = Counter()
    for i, text, _ in rows:
        ids = t.encode(text, add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.bpe_digests(docs, path).collect())) == want
    assert bpe.bpe_digests(empty, path).count() == 0
    kept = bpe.decoded(bpe.encoded(docs, path).withColumnsRenamed({"n_tokens": "kept"}), path, most=50)
    assert kept.columns == ["doc_id", "kept", "ids", "text"] and kept.count() == len(rows)
    if name.startswith("byte"):  # byte-level vocabularies give every text back
        assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, x) for i, x, _ in rows)


def test_merge_queue_on_long_and_random_pieces():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        t, own = load(vocabulary(name)), bpe.Merges(vocabulary(name))
        rng = random.Random(12)
        for n in [1, 2, 3, 7, 40, 300] * 30 + [20_000]:
            piece = "".join(rng.choice("abcdeinorsth") for _ in range(n)) if n % 2 else rng.choice(["ab", "aa", "in", "e"]) * n
            assert own.ids(piece) == [x.id for x in t.model.tokenize(piece)]
        assert own.ids("") == []


def test_decoding_unknown_ids_and_broken_bytes():
    d = bpe.Decoder(vocabulary("byte_bpe_50k.json"))
    t = load(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(5)
    lists = [[], [50256], [70_000], *[[rng.randrange(256) for _ in range(40)] for _ in range(50)]]
    offsets = np.cumsum([0, *map(len, lists)])
    assert d.texts(np.array([x for v in lists for x in v], np.uint32), offsets) == [t.decode(v, skip_special_tokens=False) for v in lists]
