"""Toxicity by a chain of linear classifiers.

The chain predicts its categories one after the other; each model reads the words of a text and
the probabilities of the categories before it. The models are fitted on a bounded sample of
labelled rows, where those probabilities come from fits that leave the row's fold out, so a later
model learns from earlier ones as they will be on rows they have not seen. Every document is then
scored whole in one pass.

Features are words and word beginnings that occur in at least `least` sampled documents and tell
some category apart by a chi-squared, corrected for continuity, of `signal` or more (10.8: one in
a thousand by chance), the `most` best of them.

Defined results: null or empty text has the probabilities of a text without features; documents
with null or repeated doc_ids keep a row each; a document labelled twice counts once per category,
as 1 if any label says so; null labels are not learnt from; without labels every probability is 0
and nothing is rejected; other columns are ignored by `toxicity` and kept by `keep_clean`.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_col, tidy

#: Labelled rows that the models are fitted on, at most.
SAMPLE = 6000
#: Category -> label expression, in the order of the chain.
CATEGORIES = {"low_quality": "cast(quality = 0 as int)", "toxic": "cast(toxic = 1 as int)"}
REJECT, AT = "toxic", 0.5
WORDS = re.compile(r"\w+")
STARTS = (4, 5, 6)
#: Words that a scoring task remembers, at most: about 25 MB.
CACHE = 100_000


def features(chunk: str) -> set[str]:
    found = set()
    for w in WORDS.findall(chunk):
        found.add(w)
        found.update(f"{w[:n]}-" for n in STARTS if len(w) >= n)
    return found


class Linear:
    """Logistic regression on sparse 0/1 rows and some dense columns, by full gradients with adaptive steps."""

    def __init__(self, steps: int = 80, rate: float = 0.2, decay: float = 1e-5):
        self.steps, self.rate, self.decay = steps, rate, decay

    def fit(self, idx: np.ndarray, n: np.ndarray, width: int, dense: np.ndarray, y: np.ndarray) -> Linear:
        w = np.zeros(width + dense.shape[1] + 1)
        m, v = np.zeros_like(w), np.zeros_like(w)
        prior = np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)
        w[-1] = np.log(prior / (1 - prior))
        self.w, self.width = w, width
        for t in range(1, self.steps + 1 if 0 < y.sum() < len(y) else 1):
            r = (self.predict(idx, n, dense) - y) / len(y)
            g = np.concatenate([np.bincount(idx, np.repeat(r, n), width), dense.T @ r, [r.sum()]])
            g[:-1] += self.decay * w[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return self

    def predict(self, idx: np.ndarray, n: np.ndarray, dense: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.w[idx])])
        ends = np.cumsum(n)
        z = sums[ends] - sums[ends - n] + dense @ self.w[self.width : -1] + self.w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Chain:
    def __init__(self, categories: list[str], least: int = 3, most: int = 4096, folds: int = 3, signal: float = 10.8):
        self.categories, self.least, self.most, self.folds, self.signal = categories, least, most, folds, signal

    def fit(self, texts: list[str], labels: np.ndarray) -> Chain:
        """labels: a column for each category, NaN where unknown."""
        seen: dict[str, set[str]] = {}
        rows = []
        for t in texts:
            own: set[str] = set()
            for c in set(t.lower().split()):
                if c not in seen:
                    seen[c] = features(c)
                own |= seen[c]
            rows.append(own)
        n = Counter(f for r in rows for f in r)
        names = sorted(f for f, k in n.items() if k >= self.least)
        place = {f: k for k, f in enumerate(names)}
        lists = [sorted(place[f] for f in r if f in place) for r in rows]
        width = np.array([len(x) for x in lists], np.int64)
        idx = np.array([k for x in lists for k in x], np.int64)
        best = np.zeros(len(names))
        for y in labels.T:
            known = ~np.isnan(y)
            one, both = np.nansum(y), known.sum()
            if not 0 < one < both:
                continue
            each = np.repeat(known, width)
            with_one = np.bincount(idx[each], np.repeat(np.nan_to_num(y), width)[each], len(names))
            with_any = np.bincount(idx[each], minlength=len(names))
            expected = with_any * one / both
            best = np.maximum(best, np.maximum(np.abs(with_one - expected) - 0.5, 0) ** 2 / np.maximum(expected * (1 - one / both), 1e-9))
        order = np.argsort(-best, kind="stable")[: self.most]
        chosen = np.sort(order[best[order] >= self.signal])
        self.names = {names[k]: j for j, k in enumerate(chosen.tolist())}
        lists = [np.array([self.names[f] for f in sorted(r) if f in self.names], np.int64) for r in rows]
        self.models = []
        earlier = np.zeros((len(texts), 0))
        fold = np.arange(len(texts)) % self.folds
        for y in labels.T:
            known = ~np.isnan(y)
            self.models.append(self._one(lists, earlier, y, known))
            out = np.zeros(len(texts))
            for k in range(self.folds):
                held = fold == k
                out[held] = self._predict(self._one(lists, earlier, y, known & ~held), lists, earlier, held)
            earlier = np.column_stack([earlier, out])
        self.held_out = earlier  # out-of-fold probabilities of the sample
        return self

    def _pick(self, lists, take):
        some = [lists[k] for k in np.flatnonzero(take)]
        return np.concatenate([np.zeros(0, np.int64), *some]), np.array([len(x) for x in some], np.int64)

    def _one(self, lists, earlier, y, take) -> Linear:
        return Linear().fit(*self._pick(lists, take), len(self.names), earlier[take], y[take])

    def _predict(self, model, lists, earlier, take):
        return model.predict(*self._pick(lists, take), earlier[take])

    def score(self, texts: list[str], cache: dict[str, list[int]]) -> np.ndarray:
        rows = []
        for t in texts:
            own: set[int] = set()
            for c in set(t.lower().split()):
                f = cache.get(c)
                if f is None:
                    if len(cache) > CACHE:
                        cache.clear()
                    f = cache[c] = [self.names[x] for x in features(c) if x in self.names]
                if f:
                    own.update(f)
            rows.append(np.fromiter(sorted(own), np.int64, len(own)))
        idx, n = np.concatenate([np.zeros(0, np.int64), *rows]), np.array([len(r) for r in rows], np.int64)
        out = np.zeros((len(texts), 0))
        for m in self.models:
            out = np.column_stack([out, m.predict(idx, n, out)])
        return out


def fit_chain(docs: DataFrame, labels: DataFrame, categories=None, sample: int = SAMPLE) -> Chain | None:
    """Chain fitted in one task on at most `sample` labelled documents, those whose hashed doc_ids are smallest."""
    categories = dict(CATEGORIES if categories is None else categories)
    names = list(categories)
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.expr(e)).alias(n) for n, e in categories.items()])
    # `sample` rows at most: the bound of the broadcast
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", text_col().alias("text")).join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), *[F.first(n).alias(n) for n in names])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["doc_id"])
        if rows:
            y = np.array([[np.nan if r[n] is None else r[n] for n in names] for r in rows], float)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Chain(names).fit([r["text"] for r in rows], y))], pa.binary())], names=["chain"])

    made = texts.coalesce(1).mapInArrow(tidy(fit), "chain binary").collect()
    return pickle.loads(made[0][0]) if made else None


def toxicity(docs: DataFrame, chain: Chain | None, reject: str = REJECT, at: float = AT, categories=None) -> DataFrame:
    """doc_id, a probability p_<category> for each category, and rejected, for each row of `docs` (doc_id, text)."""
    names = list(CATEGORIES if categories is None else categories)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, cache = shared.value, {}
        for b in batches:
            for at_row in range(0, b.num_rows, 500):
                part = b.slice(at_row, 500)
                texts = part.column(1).to_pylist()
                p = np.zeros((len(texts), len(names))) if chain is None else chain.score(texts, cache)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(np.ascontiguousarray(c)) for c in p.T], pa.array(p[:, names.index(reject)] >= at)], names=["doc_id", *[f"p_{n}" for n in names], "rejected"])

    schema = "doc_id bigint, " + ", ".join(f"p_{n} double" for n in names) + ", rejected boolean"
    return docs.select(F.col("doc_id").cast("bigint"), text_col().alias("text")).mapInArrow(tidy(score), schema)


def keep_clean(docs: DataFrame, chain: Chain | None, reject: str = REJECT, at: float = AT) -> DataFrame:
    """The rows of `docs`, all columns, that are not rejected. Scores and rows stay in the same task: nothing is shuffled."""
    shared, k = docs.sparkSession.sparkContext.broadcast(chain), list(CATEGORIES).index(reject)
    where = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, cache = shared.value, {}
        for b in batches:
            for at_row in range(0, b.num_rows, 500):
                part = b.slice(at_row, 500)
                if chain is not None:
                    texts = [t or "" for t in part.column(where).to_pylist()]
                    part = part.filter(pa.array(chain.score(texts, cache)[:, k] < at))
                yield part

    return docs.mapInArrow(tidy(keep), docs.schema)


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
