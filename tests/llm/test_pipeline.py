"""The pipeline against a plain version of each stage on its own input."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_corpus_operators import waterfill

from barloom.llm.common import cut
from barloom.llm.toxicity import Chain, fit_chain

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = cut(stage(spark, docs, DATA), f"test-{name}")
        out.append((docs, after))
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5 and all(a.columns == b.columns for a, b in stages[:-1])


def test_toxicity_stage(spark, stages):
    before, after = (texts(x) for x in stages[0])
    seen = {r.doc_id: [float(r.quality == 0), float(r.toxic == 1)] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.doc_id in before}
    own = [i for i in sorted(seen)]
    chain = Chain(["low_quality", "toxic"]).fit([before[i] for i in own], np.array([seen[i] for i in own]))
    assert set(after) == {i for i, t in before.items() if chain.score([t], {})[0, 1] < 0.5}


@pytest.mark.parametrize(("size", "least"), [("sf0.01", 0.7), ("sf0.1", 0.9)])
def test_toxicity_finds_documents_it_was_not_fitted_on(spark, size, least):
    """Out-of-fold probabilities of labelled documents: 51 toxic ones of 399, and 449 of 3,980."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id: r.toxic == 1 for r in labels.join(docs, "doc_id").collect()}
    toxic = np.array([toxic[i] for i in sorted(toxic)])
    gone = fit_chain(docs, labels).held_out[:, 1] >= 0.5
    assert len(gone) == len(toxic) and gone[toxic].mean() >= least and gone[~toxic].mean() <= 0.01


def test_exact_stage(stages):
    before, after = (texts(x) for x in stages[1])
    keep = {}
    for i, t in before.items():
        keep[t] = max(keep.get(t, i), i)
    assert set(after) == set(keep.values())


def test_near_stage(stages):
    before, after = (texts(x) for x in stages[2])

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset([(t,)])

    s = {i: shingles(t) for i, t in before.items()}
    group = {i: i for i in s}
    for a in sorted(s):
        for b in sorted(s):
            if a < b and len(s[a] & s[b]) * 5 >= 4 * len(s[a] | s[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    assert set(after) == set(group.values())


def test_mixing_stage(stages):
    before, after = stages[3]
    n = Counter(r.doc_id for r in after.select("doc_id").collect())
    assert max(n.values()) <= 2 and set(n) <= set(texts(before))
    words, taken, sizes = defaultdict(int), defaultdict(int), defaultdict(list)
    for df, out in ((before, words), (after, taken)):
        for r in df.select("source", "text").collect():
            size = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
            out[r.source] += size
            if out is words and size:
                sizes[r.source].append(size)
    for source, target in waterfill(words).items():  # no further copy brings a source nearer: half of a small document's size is left
        assert abs(taken[source] - target) <= max(1, sorted(sizes[source])[len(sizes[source]) // 2] / 2), source


def test_packing_stage(stages):
    before, after = stages[4]
    p = after.toPandas()
    assert p[p.piece == 0].doc_id.value_counts().to_dict() == Counter(r.doc_id for r in before.select("doc_id").collect())
    assert p.groupby("sequence_id").length.sum().max() <= 2048


def test_run(spark, stages):
    """The whole run gives what the stages give one by one."""
    assert corpus_pipeline.run(spark, DATA).exceptAll(stages[-1][1]).count() == 0


NAMES = {"of": 1, "like": "x", "own": 2, "digest": "d", "rank": 3, "copies": 4, "copy": 5, "from": 6, "same": "s", "kept_id": 7, "node": "n", "key": "k", "size": 8, "rejected": True}


def test_stages_of_odd_tables(spark):
    """Nulls, repeated rows, names that clash, a very long text, and no rows at all."""
    real = spark.read.parquet(f"{DATA}/documents.parquet")
    long = " ".join(f"w{k % 5000}" for k in range(120_000))
    odd = [(None, None, None, None, None), (None, "", "en", None, 0), (1, "a few words of a clean text", None, "web", 27), (1, "a few words of a clean text", None, "web", 27), (2, "a few words of a clean text", "en", "web", 27), (3, long, "en", "web", len(long)), (None, long + " end", "en", None, 1)]
    df = spark.createDataFrame(odd, real.schema).withColumns({k: F.lit(v) for k, v in NAMES.items()})
    for docs in (df, df.limit(0)):
        at = docs
        for name, stage in corpus_pipeline.STAGES:
            after = cut(stage(spark, at, DATA), f"odd-{name}")
            if name == "packing":
                assert after.select("doc_id", "piece").count() >= at.count()
                continue
            assert after.columns == docs.columns, name
            assert all(r[k] == v for r in after.collect() for k, v in NAMES.items()), name
            if name == "exact_dedup":
                assert Counter((r.doc_id, r.text or "") for r in after.collect()) == Counter([(None, ""), (2, odd[4][1]), (3, long), (None, long + " end")] if docs is df else [])
            if name == "ngram_jaccard_join":
                assert Counter((r.doc_id, r.text or "") for r in after.collect()) == Counter([(None, ""), (2, odd[4][1]), (3, long)] if docs is df else [])
            at = after
