"""Every operator against a brute-force version, over awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from barloom.llm import embedding_dedup, exact_dedup, jaccard_join, mixing, packing, secrets, suffix_dedup, token_counts, token_files, tokenizing, toxicity
from barloom.llm.common import new_path, with_components
from barloom.llm.tokenizing import load, vocabulary

DATA = "/root/testdata/sf0.001"
ODD = [
    (None, "no id"), (None, None), (7001, None), (7002, ""), (7003, " \t\n"), (7004, "same text again"), (7005, "same text again"), (7005, "same text again"), (7006, "Hello <|endoftext|>World\x1d\x00 foo"),
    (7007, "İstanbul ǅ ﬁ Ως ΑΣ 日本語 😀"), (7008, "it's we'll !'s ''s 12³¼ x_y \x85a\xa0b  c\n\n d"), (7009, "aaaa bbbb " * 3000), (7010, "x" * 900), (7011, "é" * 150),
]


#: Names that operators use for columns of their own, and some in other letters.
CLASH = {"k": "clash", "i": 4, "key": 1, "h": 2.0, "node": "n", "size": 0, "digest": "d", "kept": True, "same": "x", "kept_id": 1, "of": 7, "FROM": 8, "like": "y", "rank": 3, "Copies": "z", "copy": 5, "own": 6, "rejected": 1, "copies_": 2}


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with clashing extra columns, odd rows, and planted passages."""
    base = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source")
    x = [r.text for r in base.collect() if r.text and len(r.text) > 500]
    rng = random.Random(4)
    planted = []
    for i in range(25):
        t, u = rng.choice(x), rng.choice(x)
        a, c = rng.randrange(len(t) - 300), rng.randrange(len(u))
        planted.append((8000 + i, u[:c] + t[a : a + rng.choice([150, 199, 200, 201, 260])] + u[c : c + 300], f"s{i % 3}"))
    more = spark.createDataFrame([(*r, None) for r in ODD] + planted, "doc_id long, text string, source string")
    both = base.unionByName(more)
    return both.withColumns({c: F.lit(v) for c, v in CLASH.items()}).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "", r.source) for r in docs.select("doc_id", "text", "source").collect()]


@pytest.fixture
def empty(docs):
    return docs.limit(0)


def key(v):
    return (v is not None, v or 0)


# --- 6
def test_exact_dedup(spark, docs, rows, empty):
    index = exact_dedup.DigestIndex(spark, new_path(spark, "t6"), 4)
    got = exact_dedup.exact_dedup(docs, index).collect()
    ids, n = {}, Counter(t for _, t, _ in rows)
    for i, t, _ in rows:
        ids[t] = max([ids.get(t), i], key=key) if t in ids else i
    want = Counter((i, ids[t], n[t], i == ids[t], hashlib.sha256(t.encode()).hexdigest()) for i, t, _ in rows)
    assert Counter(tuple(r) for r in got) == want
    # a second batch finds the first one's texts in the index, through the same path
    again = exact_dedup.DigestIndex(spark, index.path, 4)
    second = exact_dedup.exact_dedup(docs.filter("doc_id = 7004").withColumn("doc_id", F.lit(99999).cast("long")), again).first()
    assert second.keep_id == 7005 and not second.kept and again.rows().count() == len(n)
    kept = exact_dedup.keep_first(docs, exact_dedup.DigestIndex(spark, new_path(spark, "t6b"), 4))
    assert kept.columns == docs.columns and Counter(r.text or "" for r in kept.collect()) == Counter(dict.fromkeys(n, 1))
    values = lambda df: {(r.doc_id, r.text or "", *[r[c] for c in CLASH]) for r in df.collect()}
    assert values(kept) <= values(docs)  # other columns come back as they were
    none = exact_dedup.DigestIndex(spark, new_path(spark, "t6c"), 4)
    assert exact_dedup.exact_dedup(empty, none).count() == 0 and exact_dedup.keep_first(empty, none).count() == 0


def test_index_deals_itself_into_more_buckets(spark):
    """Ten batches into an index of small buckets: the same answers as one set, and buckets that follow its size."""
    index = exact_dedup.DigestIndex(spark, new_path(spark, "t6g"), 2, bucket_rows=60, bucket_files=3)
    seen: dict[str, int] = {}
    for k in range(5):
        batch = [(1000 * k + i, f"text {(37 * k + i) % 300}") for i in range(120)]
        got = exact_dedup.exact_dedup(spark.createDataFrame(batch, "doc_id long, text string"), index).collect()
        for i, t in batch:
            seen.setdefault(t, i)
        assert {(r.doc_id, r.keep_id) for r in got} == {(i, seen[t]) for i, t in batch}
    assert index.buckets >= 8 and index.version > 0 and index.rows().count() == len(seen)
    again = exact_dedup.DigestIndex(spark, index.path)
    assert (again.version, again.buckets, again.rows().count()) == (index.version, index.buckets, len(seen))


class Died(Exception):
    pass


@pytest.mark.parametrize("step", ["_insert", "_rename", "_open", "drop_path"])
@pytest.mark.parametrize("reopen", [True, False])
def test_index_survives_a_rewrite_that_dies(spark, monkeypatch, step, reopen):
    """Killed before a step of the rewrite (halfway through the insert): the next batch finds every digest once."""
    path = new_path(spark, "t6x")
    batch = lambda n, at: spark.createDataFrame([(at + i, f"text {i}") for i in range(n)], "doc_id long, text string")
    exact_dedup.exact_dedup(batch(50, 0), exact_dedup.DigestIndex(spark, path, 2, bucket_rows=40)).count()
    index = exact_dedup.DigestIndex(spark, path, 2, bucket_rows=40)

    def dies(self, *args, real=exact_dedup.DigestIndex._insert):
        if step == "_insert":
            real(self, args[0].limit(20), *args[1:])
        raise Died

    with monkeypatch.context() as m:
        m.setattr(*((exact_dedup, "drop_path", lambda spark, p, real=exact_dedup.drop_path: real(spark, p) if p.endswith(".new") else dies(index)) if step == "drop_path" else (exact_dedup.DigestIndex, step, dies)))
        with pytest.raises(Died):
            index.make_room(100)
    index = exact_dedup.DigestIndex(spark, path, 2, bucket_rows=40)
    if reopen:
        index = exact_dedup.DigestIndex(spark, path, 2, bucket_rows=40)
    got = exact_dedup.exact_dedup(batch(110, 1000), index).collect()
    assert {(r.doc_id, r.keep_id) for r in got} == {(1000 + i, i if i < 50 else 1000 + i) for i in range(110)} and len(got) == 110
    assert index.rows().count() == 110 and index.rows().select("digest").distinct().count() == 110


def test_keep_first_of_a_batch_that_the_index_holds(spark):
    index = exact_dedup.DigestIndex(spark, new_path(spark, "t6k"), 2)
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    assert {r.doc_id for r in exact_dedup.keep_first(docs, index).collect()} == {2, 3} == {r.doc_id for r in exact_dedup.keep_first(docs, index).collect()}
    assert exact_dedup.keep_first(docs.withColumn("doc_id", F.col("doc_id") + 10), index).count() == 0


def test_anti_join_reads_the_index_without_a_shuffle(spark, docs):
    index = exact_dedup.DigestIndex(spark, new_path(spark, "t6d"), 4)
    exact_dedup.exact_dedup(docs, index).count()
    plan = docs.select(F.unhex(F.sha2("text", 256)).alias("digest")).hint("merge").join(index.rows(), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


# --- 1
def waterfill(sizes, weights=(5, 2, 1), pool=1.5):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w, cap, out = {s: weights[i % 3] for i, s in enumerate(order)}, {s: 2.0 * sizes[s] for s in order}, {}
    left = pool * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in out]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = cap[s]
            left -= cap[s]


def test_mixing(spark, docs, rows, empty):
    got = mixing.mix(docs).collect()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
    target = waterfill(size)
    taken = defaultdict(int)
    for r in got:
        assert r.taken == r.copies * r.size <= 2 * r.size and r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    for s, t in target.items():  # rates against bisection on the dual's derivative, over documents
        x = np.array([r.size for r in got if r.source == s and r.size > 0], float)
        if not len(x) or not t:
            continue
        low, high, rates = -1e5, 1e5, None
        for _ in range(200):
            lam = (low + high) / 2
            rates = np.minimum(2, np.exp(np.minimum(lam * x / x.mean(), 1)))
            low, high = (lam, high) if (rates * x).sum() < t else (low, lam)
        mine = np.array([r.rate for r in got if r.source == s and r.size > 0])
        np.testing.assert_allclose(np.sort(mine), np.sort(rates), atol=1e-6)
    for s, t in target.items():  # copies are whole, so half of a source's largest document may be out of reach
        largest = max(r.size for r in got if r.source == s)
        assert abs(taken[s] - t) <= max(1, largest / 2 if len([r for r in got if r.source == s]) < 20 else 0), s
    assert Counter(map(tuple, mixing.mix(docs).collect())) == Counter(map(tuple, got))
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert all(r[c] == v for r in out.limit(5).collect() for c, v in CLASH.items())


def test_mixing_of_hot_and_odd_sources(spark, monkeypatch):
    """One source holds nearly all rows, another is named like the code of none, ids are missing or repeated."""
    monkeypatch.setattr(mixing, "RUN", 40)
    rng = random.Random(5)
    rows = [(None if k % 3 == 0 else k % 50, "w " * rng.randint(0, 30), "hot") for k in range(900)]
    rows += [(2000 + k, "v " * rng.randint(1, 9), s) for k, s in enumerate(["\U0010ffff", None, "t", "s", ""] * 8)] + [(3000, "lone", "one"), (3000, "lone", "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    size, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        size[s] += len(t.split())
    for r in got:
        taken[r.source] += r.taken
    target = waterfill(size)
    assert len(got) == len(rows) and all(r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] for r in got)
    assert all(abs(taken[s] - t) <= 1.01 or s in (None, "one", "", "s", "t", "\U0010ffff") and abs(taken[s] - t) <= 5 for s, t in target.items())
    assert Counter(map(tuple, mixing.mix(df).collect())) == Counter(map(tuple, got))
    assert mixing.mixed(df).count() == sum(r.copies for r in got)


def test_mixing_repairs_many_documents_at_once(spark):
    """A source of thousands of one-word documents and one of 3,000 words ends within a word of its target; so does its mirror, that lacks words."""
    rows = [(k, "w", "a") for k in range(10_000)] + [(20_000, "w " * 3000, "a")]
    for pool in (0.9, 1.37):
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), pool=pool)
        total, target, most = got.agg(F.sum("taken"), F.max("target"), F.max(F.col("taken") / F.col("size"))).first()
        assert abs(total - target) <= 1 and target == pytest.approx(13_000 * pool) and most <= 2
        each = {r.c for r in got.filter("size = 1").groupBy(F.col("copies").alias("c")).count().collect()}
        assert max(each) - min(each) <= 1


# --- 4, 5, 9
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_matches_the_library(name, monkeypatch):
    """Random texts of awkward characters, in small parts and with a table that forgets."""
    monkeypatch.setattr(tokenizing, "ROOM", 3000)
    monkeypatch.setattr(tokenizing, "CACHE", 500)
    rng = random.Random(1)
    bits = [*"aZéÿŸſßµªº×÷'\" \n\t.,!3²¼x_-sStT  \u0085\xa0İĿȺ日\x1c", "'s", "'ll", "'re", "  ", "\n\n", " the", "Word", "don't", "<|endoftext|>", "x" * 40, "%%%"]
    texts = ["".join(rng.choices(bits[:some], k=rng.randint(0, 60))) for some in (30, 36, len(bits)) for _ in range(1500)]
    texts += ["word don't  \n stop " * 900, "x" * 9000, "日本 " * 4000, ""]  # above a part: cut, or whole where there is no place to cut
    e, t, column = tokenizing.Encoder(vocabulary(name)), load(vocabulary(name)), pa.array(texts)
    got = [x.tolist() for _, _, ids, at in e.encode(column) for x in np.split(ids, at[1:-1])]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_token_counts(docs, rows, empty, monkeypatch):
    t = load(vocabulary("word_bpe_49k.json"))
    want = Counter((i, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 2048) for i, x, _ in rows)
    monkeypatch.setattr(token_counts, "BLOCK", 50_000)  # many blocks share a bucket
    assert Counter(map(tuple, token_counts.token_counts(docs).collect())) == want
    assert token_counts.token_counts(empty).count() == 0


def test_packing(docs, rows, empty):
    t = load(vocabulary("word_bpe_49k.json"))
    want = Counter()
    for i, x, _ in rows:
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(i, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    got = packing.pack_documents(docs).toPandas()
    assert Counter(zip([None if x != x else int(x) for x in got.doc_id], *[got[c] for c in ("piece", "start", "length", "ids_crc32")], strict=True)) == want
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert got.sequence_id.nunique() <= got.length.sum() / 2048 * 1.02 + 1
    assert packing.pack_documents(empty).count() == 0
    assert got.sequence_id.nunique() == plain_bins(list(got.length), 2048)


def plain_bins(lengths: list[int], capacity: int) -> int:
    """Best-two-fit, a document at a time."""
    left, bins = sorted(lengths, reverse=True), 0
    while left:
        held, gap = [], capacity
        for x in list(left):
            if x <= gap:
                held.append(x)
                left.remove(x)
                gap -= x
        while gap and len(held) > 1:
            low = min(held)
            room, free, best = gap + low, Counter(left), None
            for a in sorted(free):
                fits = [b for b in free if a + b <= room and (b != a or free[a] > 1)]
                if fits and (best is None or a + max(fits) > sum(best)):
                    best = (a, max(fits))
            if best is None or sum(best) <= low:
                break
            held.remove(low)
            left.append(low)
            for x in best:
                left.remove(x)
                held.append(x)
            left.sort(reverse=True)
            gap = capacity - sum(held)
        bins += 1
    return bins


def test_best_two_fit_matches_a_plain_run():
    rng = random.Random(11)
    for _ in range(25):
        lengths = [rng.choice([rng.randint(1, 40), 7, 13, 40]) for _ in range(rng.randint(1, 90))]
        assert sum(times for _, times in packing.best_two_fit(Counter(lengths), 40)) == plain_bins(lengths, 40)


def test_best_two_fit_swaps_the_smallest():
    # greedy fills 6 + 3; replacing 3 by 2 + 2 closes the gap
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == ([6, 2, 2], 1)
    bins = packing.best_two_fit({10: 3, 7: 4, 3: 4, 1: 5}, 10)
    used = Counter()
    for held, times in bins:
        assert sum(held) <= 10
        for x in held:
            used[x] += times
    assert used == {10: 3, 7: 4, 3: 4, 1: 5}


def test_token_files(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD", 40_000)
    t = load(vocabulary("byte_bpe_50k.json"))
    to = new_path(spark, "t9")
    token_files.write_token_files(docs, to)
    got = token_files.read_token_files(spark, to).collect()
    ids = lambda x: np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
    want = Counter((i, len(v := ids(x)), zlib.crc32(v.tobytes())) for i, x, _ in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [key(r.doc_id) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    files = spark.read.parquet(to).collect()
    assert len(files) > 3 and sum(len(f.payload) for f in files) < 4 * at
    s = token_files.Shard(max(files, key=lambda f: f.n_ids).payload)
    ids, at = s.documents()
    for k in (0, len(s.doc_ids) - 1):
        whole = ids[at[k] : at[k + 1]]
        for a, b in ((0, 1), (0, len(whole)), (len(whole) // 3, len(whole) // 2)):
            assert (s.ids(k, a, b) == whole[a:b]).all()
    none = new_path(spark, "t9e")
    token_files.write_token_files(empty, none)
    assert token_files.read_token_files(spark, none).count() == 0


def test_token_files_make_rules_of_whole_passages():
    chunks = [np.array([k], "<u4").tobytes() for k in range(1000)]
    passage = np.arange(100, 420)
    docs = [np.array([1 + k, *passage, 500 + k, 0]) for k in range(40)]
    s = token_files.Shard(token_files.write_shard(list(range(40)), chunks, docs, 1000)[1])
    ids, at = s.documents()
    assert all((ids[at[k] : at[k + 1]] == d).all() for k, d in enumerate(docs))
    assert len(s.symbols) <= 40 * 8
    pairs = Counter(p for a, b in zip(s.starts, s.starts[1:], strict=False) for p in zip(s.symbols[a:b].tolist(), s.symbols[a + 1 : b].tolist(), strict=False))
    assert max(pairs.values()) < token_files.LEAST


# --- 10
def test_secrets(spark, rows, empty):
    kinds = [
        ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    brute = lambda t: [(kinds[k][0], s, e) for s, k, e in sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in p.finditer(t) if ok(m))]
    rng = random.Random(2)
    bits = ["password", "PassWd", "secret", "token", "api_key", "apikey", "AKIA", "=", ":", " ", '"', "'", "a", "f", "0", "Z", "-", "é", "deadbeef", "token=token:", "secre", "0123456789ABCDEF", "abcdef0123456789abcdef0"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(3000)] + [t for _, t, _ in rows]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.find_secrets(df, secrets.BASE).collect():
        assert [tuple(x) for x in r.secrets] == brute(texts[r.doc_id]), texts[r.doc_id]
    assert secrets.find_secrets(empty).count() == 0


def test_secrets_of_further_rules(spark, docs):
    """All rules in one pass: the base spans stay as they are, the others match their regexes."""
    more = {
        "private_key": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0), "git_token": ("gh[oprsu]_[A-Za-z0-9]+", 40), "pay_key": ("[rs]k_live_[A-Za-z0-9]+", 24),
    }
    rng = random.Random(7)
    bits = ["-----BEGIN ", "RSA ", "PRIVATE KEY", "-----", "ghp_", "gho_", "a1B2c3D4e5F6", "sk_live_", "rk_live_", "é", " ", "password=", "AKIA", "0123456789abcdef", "_", "日"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 16))) for _ in range(1500)] + ["é ghp_" + "x" * 40 + " password=hunter22 " * 3000, None, ""]
    df = spark.createDataFrame([(None if k % 9 == 0 else k % 400, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit(v) for c, v in CLASH.items()})
    base = Counter((r.doc_id, tuple(map(tuple, r.secrets))) for r in secrets.find_secrets(df, secrets.BASE).collect())
    got = secrets.find_secrets(df).collect()
    kinds = [r.kind for r in secrets.BASE]
    assert Counter((r.doc_id, tuple(tuple(x) for x in r.secrets if x.kind in kinds)) for r in got) == base and len(got) == len(texts)
    order = {r.kind: k for k, r in enumerate(secrets.BASE + secrets.MORE)}
    want = lambda t: [(k, m.start(), m.end()) for k, (p, n) in more.items() for m in re.finditer(p, t) if len(m[0]) >= n]
    wanted = Counter((None if k % 9 == 0 else k % 400, tuple(sorted(want(t or ""), key=lambda x: (x[1], order[x[0]])))) for k, t in enumerate(texts))
    assert Counter((r.doc_id, tuple(tuple(x) for x in r.secrets if x.kind not in kinds)) for r in got) == wanted
    assert sum(len(x) for _, x in wanted) > 100


# --- 7
def test_toxicity(spark, docs, empty):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    made, labels = [], []
    for i in range(900):
        bad, junk = rng.random() < 0.2, rng.random() < 0.2
        w = [word() for _ in range(rng.randint(5, 60))] + (["nastyword"] * 2 if bad else []) + (["zzzz", "qqqq"] if junk else [])
        rng.shuffle(w)
        made.append((i, " ".join(w)))
        labels.append((i, None if i % 50 == 0 else int(not junk), int(bad)))
    d, lab = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(d, lab.filter("doc_id < 600 or doc_id is null"))
    got = {r.doc_id: r for r in toxicity.toxicity(d, chain).collect()}
    truth = {i: t for i, _, t in labels}
    assert sum(got[i].rejected == bool(truth[i]) for i in range(600, 900)) >= 297
    assert len(chain.models) == 2 and len(chain.models[1].w) == len(chain.names) + 2  # the second model reads the first one's probability
    assert toxicity.keep_clean(docs, chain).columns == docs.columns and toxicity.keep_clean(docs, chain).count() == docs.count()
    none = toxicity.fit_chain(d, lab.limit(0))
    assert none is None and toxicity.toxicity(docs, none).filter("rejected").count() == 0 and toxicity.toxicity(empty, chain).count() == 0


def test_chain_matches_a_plain_one(spark):
    """Dense matrices, features from whole texts, folds and steps written out again; and what odd rows get."""
    rng = np.random.default_rng(17)
    words = ["alpha", "betas", "gamma9", "delta", "crud", "Crudely", "vile", "villainy", "zeta,eta", "it's"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(150)] + ["", ""]
    y = np.column_stack([["crud" in t.lower() for t in texts], ["vil" in t for t in texts]]).astype(float)
    y[::11, 0] = np.nan
    flip = rng.random(len(texts)) < 0.1
    y[flip, 1] = 1 - y[flip, 1]
    chain = toxicity.Chain(["low", "bad"], signal=1.0).fit(texts, y)

    def own(t):
        found = re.findall(r"\w+", t.lower())
        return set(found) | {f"{w[:n]}-" for w in found for n in (4, 5, 6) if len(w) >= n}

    every = [own(t) for t in texts]
    assert all(sum(f in e for e in every) >= chain.least for f in chain.names)
    x = np.array([[f in e for f in chain.names] for e in every], float)

    def fit(x, y, steps=80, rate=0.2, decay=1e-5):
        z = np.column_stack([x, np.ones(len(x))])
        w, m, v = np.zeros(z.shape[1]), 0.0, 0.0
        mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        w[-1] = np.log(mean / (1 - mean))
        for t in range(1, steps + 1):
            g = z.T @ (1 / (1 + np.exp(-np.clip(z @ w, -30, 30))) - y) / len(y)
            g[:-1] += decay * w[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return lambda x: 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ w, -30, 30)))

    fold, held, models, earlier = np.arange(len(texts)) % 3, [], [], x
    for k in range(2):
        known = ~np.isnan(y[:, k])
        out = np.zeros(len(texts))
        for f in range(3):
            out[fold == f] = fit(earlier[known & (fold != f)], y[known & (fold != f), k])(earlier[fold == f])
        models.append(fit(earlier[known], y[known, k]))
        held.append(out)
        earlier = np.column_stack([earlier, out])
    np.testing.assert_allclose(chain.held_out, np.array(held).T, atol=1e-6)
    new = ["crud vile alpha", "", "VILLAINY delta", "nothing known"]
    z = np.array([[f in own(t) for f in chain.names] for t in new], float)
    first = models[0](z)
    want = np.column_stack([first, models[1](np.column_stack([z, first]))])
    np.testing.assert_allclose(chain.score(new, {}), want, atol=1e-6)
    rows = [(None, "crud vile alpha"), (1, None), (1, ""), (1, "VILLAINY delta"), (1, "VILLAINY delta")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(v) for c, v in CLASH.items()})
    got = Counter((r.doc_id, round(r.p_toxic, 6), r.rejected) for r in toxicity.toxicity(df, chain).collect())
    p = {"crud vile alpha": want[0, 1], "": want[1, 1], "VILLAINY delta": want[2, 1]}
    assert got == Counter((i, round(p[t or ""], 6), bool(p[t or ""] >= 0.5)) for i, t in rows)
    kept = toxicity.keep_clean(df, chain)
    assert kept.columns == df.columns and kept.count() == sum(p[t or ""] < 0.5 for _, t in rows)


def test_labels_of_repeated_and_missing_ids(spark):
    """A document labelled twice counts once, as 1 if any label says so; null ids and labels of no document are not learnt from."""
    docs = spark.createDataFrame([(k, f"word{k % 7} other text") for k in range(40)] + [(None, "word1")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 7 == 1)) for k in range(40)] + [(1, 0, 0), (None, 0, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs, labels)
    assert chain.held_out.shape == (40, 2)


# --- 3
@pytest.mark.parametrize(("group", "part"), [(20_000, 1 << 20), (2, 700)])
def test_suffix_dedup(docs, rows, empty, monkeypatch, group, part):
    """Also with groups split down to single strings and texts read in overlapping parts."""
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    data = [(i, t.encode()) for i, t, _ in rows]
    n = Counter(b[p : p + 200] for _, b in data for p in range(len(b) - 199))
    want = Counter()
    for i, b in data:
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 199):
            if n[b[p : p + 200]] > 1:
                cover[p] += 1
                cover[p + 200] -= 1
        out = np.cumsum(cover)[:-1] > 0
        want[(i, len(b), int((np.diff(out.astype(int), prepend=0) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~out]))] += 1
    got = suffix_dedup.without_repeats(docs, part=part).collect()
    assert Counter((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in got) == want
    assert suffix_dedup.without_repeats(empty).count() == 0


# --- 8
def test_jaccard_join(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", 5)
    w = [f"w{i}" for i in range(60)]
    near = [(9000 + i, " ".join([*w[: 50 + i // 2], "x", *w[51 + i // 2 :]])) for i in range(15)]  # neighbours are near, ends may not be
    mine = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    every = [(i, t) for i, t, _ in rows] + near

    def shingles(t):
        x = re.findall(r"[^\x20\x09-\x0D]+", t)
        return frozenset(tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))) if x else None

    classes = defaultdict(list)
    for i, t in every:
        classes[shingles(t)].append(i)
    alone = classes.pop(None)
    names = list(classes)
    links = [{b for b in range(len(names)) if b != a and len(names[a] & names[b]) * 5 >= 4 * len(names[a] | names[b])} for a in range(len(names))]
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    want = Counter((i, i, 1, 0, i, True) for i in alone)
    for a, s in enumerate(names):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        top = low([i for b in seen for i in classes[names[b]]])
        for i in classes[s]:
            want[(i, low(classes[s]), len(classes[s]), len(links[a]), top, i == top)] += 1
    assert Counter(map(tuple, jaccard_join.jaccard_join(mine).collect())) == want
    assert sum(map(len, links)) > 30
    assert jaccard_join.jaccard_join(empty).count() == 0
    assert jaccard_join.keep_one(empty).count() == 0
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    # one row of each component, the least id's, and every row without words
    sets = [shingles(t) for _, t, _ in rows]
    group = {s: {s} for s in set(sets) - {None}}
    for a in list(group):
        for b in list(group):
            if a is not b and len(a & b) * 5 >= 4 * len(a | b) and group[a] is not group[b]:
                both = group[a] | group[b]
                for x in both:
                    group[x] = both
    heads = {id(g): min((i for (i, t, _), x in zip(rows, sets, strict=True) if x in g and i is not None), default=None) for g in {id(g): g for g in group.values()}.values()}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(heads.values()) + Counter(i for (i, _, _), x in zip(rows, sets, strict=True) if x is None)


def test_keep_one_of_rows_without_ids(spark):
    w = [f"u{k}" for k in range(40)]
    near = [" ".join([*w[:k], "x", *w[k + 1 :]]) for k in (0, 1, 39)] + [" ".join(w)] * 2
    rows = [(None, t) for t in near] + [(None, "another text of several words here"), (None, ""), (None, None), (4, near[0]), (4, "a quite different text with that id too")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in jaccard_join.keep_one(df).collect())
    assert got == Counter([(4, near[0]), (None, "another text of several words here"), (None, ""), (None, None), (4, "a quite different text with that id too")])
    alone = spark.createDataFrame([(None, t) for t in near], "doc_id long, text string")
    assert jaccard_join.keep_one(alone).count() == 1


def test_pruning_keeps_similar_pairs():
    need = jaccard_join.needed_matches(80, 0.8, 1e-6)
    assert [k for k, _ in need] == [16, 32, 48, 64, 80] and all(0 < m < 0.8 * k for k, m in need)


# --- 2
@pytest.mark.parametrize("block", [1500, 7])
def test_embedding_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 16))
    for i in range(0, 300, 3):
        x[i + 1] = x[i] + rng.normal(size=16) * 0.15
        x[i + 2] = x[i + 1]
    x[400:440] = x[400] + rng.normal(size=(40, 16)) * 0.1
    x = x.astype(np.float32)
    odd = [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] + [1.0] * 15), (9005, [1.0] * 3), (None, [5.0] * 16)]
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<float>").withColumns({"label": F.lit(1), "node": F.lit("n"), "size": F.lit(2)})
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    found, true = sum(got[i].n_links for i in range(700)), near.sum()
    assert true > 300 and 0.9 * true <= found <= true
    wrong = sum(got[i].n_links != near[i].sum() for i in range(700))
    assert wrong <= 14
    asked = [i for i in range(700) if i % 20 == 0 and near[i].any()]  # a query set of its own, against all rows
    assert sum(got[i].n_links for i in asked) >= 0.9 * sum(near[i].sum() for i in asked) > 0
    for i in range(700):
        assert got[i].n_links <= near[i].sum() and got[i].kept == (got[i].component_id == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in (9000, 9001, 9002, 9003, 9004, 9005, None))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_dedup_of_any_length_and_size(spark, monkeypatch):
    """Lengths are indexed apart, a codebook or none; doubles keep their precision and range."""
    monkeypatch.setattr(embedding_dedup, "CELL", 4)
    rng = np.random.default_rng(8)
    long = rng.normal(size=(200, 6))
    long[100:150] = long[:50] * 1e-290  # the same directions, far smaller
    rows = [(i, v.tolist()) for i, v in enumerate(long)]
    rows += [(1000, [1e300, 1e300]), (1001, [1e300, 1e300]), (1002, [1e-310, 1e-310]), (1003, [1.0, -1.0]), (1004, [1.0, 1.0, 1.0]), (1005, [2.0, 2.0, 2.0]), (1006, [3.0]), (1007, [-3.0]), (1008, [float("inf"), 1.0])]
    rows += [(1009, [1.0, 1e-9]), (1010, [1.0, 2e-9])]  # alike in single precision at most
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    with np.errstate(over="ignore"):
        for i, v in rows:
            unit = lambda x: (y := np.array(x) / np.abs(x).max()) / np.linalg.norm(y)
            near = [j for j, w in rows if j != i and len(w) == len(v) and np.isfinite(v).all() and np.isfinite(w).all() and unit(v) @ unit(w) >= 0.95]
            assert got[i][0] == len(near), i
    assert got[1002] == (2, 1000) and got[1005] == (1, 1004) and got[1010] == (1, 1009)


def test_embedding_dedup_meets_rare_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 1)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.normal(size=(60, 64))
    u -= (u * x[:60]).sum(axis=1, keepdims=True) * x[:60]
    x[60:120] = 0.952 * x[:60] + np.sqrt(1 - 0.952**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = [r.n_links for r in embedding_dedup.near_duplicates(df).orderBy("vec_id").collect()]
    v = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (v @ v.T >= 0.95).sum(axis=1) - 1
    assert near.sum() == 120 and (np.array(got) <= near).all() and sum(got) >= 119


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(5, 5), (1, 0)], "a long, b long")
    got = with_components(spark.range(70), e).collect()
    assert all(r.component == (r.id // 20 * 20 if r.id < 60 else r.id) for r in got if r.id != 60) and len(got) == 70


def test_real_tables_have_labels_the_chain_learns(spark):
    d, lab = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    chain = toxicity.fit_chain(d, lab)
    joined = toxicity.toxicity(d, chain).join(lab.select("doc_id", "toxic"), "doc_id")
    assert joined.filter("rejected <> (toxic = 1)").count() <= 0.1 * joined.count()
    assert pq.read_table(f"{DATA}/labels.parquet").num_rows
