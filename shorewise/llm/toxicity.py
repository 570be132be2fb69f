"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

1. A bounded sample of the labelled training rows (at most about SAMPLE_ROWS of
   each label, by hash of the id) are the examples. Terms are words and their
   character 4-grams with the word's start marked, so that inflected and
   compounded words still match; the TERMS terms of highest chi-square against the
   label make the space. How many documents have each is counted over them all.
2. Examples fall into blocks of BLOCK. Each term's inverted list has the blocks
   it occurs in, the largest weight in each block, and the block's weights. A
   query adds up block bounds and opens, from the highest bounds down, the blocks
   whose bound reaches its k-th best cosine so far: exact in millionths. Queries go
   through the blocks together, so that a block's lists are read once for many.
3. Votes weigh 1/(distance + 0.05). A logistic curve, fitted to the examples' own
   leave-one-out votes, turns them into a probability; its constant is corrected
   for the shares of either label that were drawn. The nearest examples' ids are
   the evidence.

The index is bounded by both parameters and travels with the tasks; every
document is scored whole in one pass without a shuffle. Defined results: a null
or empty text has no neighbours and gets the curve's value for none; labels that
are null teach nothing, of conflicting labels of an id the highest holds; without
examples all scores are 0; repeated rows each come back; an empty table gives an
empty result; other columns pass unread.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shorewise.llm.common import id_remainder, table

SAMPLE_ROWS, TERMS, BLOCK, NEIGHBOURS, GRAM, THRESHOLD = 4000, 2000, 64, 20, 4, 0.3
_CACHE, QUERIES_A_TIME, _PLACE_BITS = 300_000, 64, 24
_LAST_PLACE = (1 << _PLACE_BITS) - 1
_WORD = re.compile(r"[^\W_]+")


def terms_of(word: str) -> list[str]:
    """Terms of a whitespace-delimited piece of lower-case text."""
    out = []
    for w in _WORD.findall(word):
        marked = "^" + w
        out.append(" " + w)
        out += [marked[i : i + GRAM] for i in range(max(1, len(marked) - GRAM + 1))]
    return out


class Featurizer:
    """Counts of known terms in a text; remembers the terms of recent words."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.cache = vocabulary, {}

    def _ids(self, word: str) -> tuple[int, ...]:
        ids = self.cache.get(word)
        if ids is None:
            if len(self.cache) >= _CACHE:
                self.cache.clear()
            ids = self.cache[word] = tuple(i for i in map(self.vocabulary.get, terms_of(word)) if i is not None)
        return ids

    def _listed(self, words: Iterable[str]) -> list[int]:
        """The known terms of words, each as often as it is there."""
        out, cached = [], self.cache.get
        for word in words:
            ids = cached(word)
            out.extend(self._ids(word) if ids is None else ids)
        return out

    def __call__(self, text: str | None) -> dict[int, int]:
        return Counter(self._listed((text or "").lower().split()))

    def known(self, text: str | None) -> set[int]:
        """The known terms that a text has."""
        return set(self._listed(set((text or "").lower().split())))


def chi_square(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    n, df = n_pos + n_neg, pos + neg
    expected = np.maximum(df * (n_pos / n) * (1 - df / n) * (1 - n_pos / n), 1e-9)
    return (pos - df * n_pos / n) ** 2 / expected


class BlockMaxIndex:
    """Inverted lists over blocks of unit vectors; search is exact, cosines being compared in millionths."""

    def __init__(self, vectors: list[dict[int, int]], idf: np.ndarray):
        self.idf, self.n = idf, len(vectors)
        blocks = -(-self.n // BLOCK)
        weights = np.zeros((blocks, len(idf), BLOCK), np.float32)
        for e, v in enumerate(vectors):
            ids, w = self.weigh(v)
            weights[e // BLOCK, ids, e % BLOCK] = w
        self.largest = np.ascontiguousarray(weights.max(axis=2).T) if blocks else np.zeros((len(idf), 0), np.float32)
        self.held = [np.flatnonzero(self.largest[:, b]) for b in range(blocks)]
        self.lists = [weights[b, t] for b, t in enumerate(self.held)]

    def weigh(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.fromiter(counts.keys(), np.int64, len(counts))
        w = (1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))) * self.idf[ids]
        return ids, w / max(np.sqrt((w * w).sum()), 1e-12)

    def nearest(self, queries: list[dict[int, int]], k: int, leave: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query: places and cosines of the k nearest with a cosine over 0, best first (ties by place). leave: the place that the first query doesn't see, the next one not the next, and so on."""
        out = []
        for a in range(0, len(queries), QUERIES_A_TIME):
            out += self._together(queries[a : a + QUERIES_A_TIME], k, None if leave is None else leave + a)
        return out

    def _together(self, queries: list[dict[int, int]], k: int, leave: int | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Blocks from the highest bounds down, each opened by the queries of which it may still hold one of the k nearest."""
        q = np.zeros((len(queries), len(self.idf)), np.float32)
        for i, counts in enumerate(queries):
            ids, w = self.weigh(counts)
            q[i, ids] = w
        bound = (q @ self.largest).astype(np.float64) * 1e6 + 10
        # a neighbour as one number: its cosine in millionths, then the smaller place first
        best = np.zeros((len(queries), k), np.int64)
        for b in np.argsort(-bound.sum(axis=0), kind="stable"):
            low = best.min(axis=1)
            need = np.flatnonzero((bound[:, b] >= low >> _PLACE_BITS) & (bound[:, b] > 10))
            if not len(need):
                continue
            place = b * BLOCK + np.arange(BLOCK)
            got = np.rint((q[need][:, self.held[b]] @ self.lists[b]).astype(np.float64) * 1e6).astype(np.int64)
            keys = np.where(got > 0, (got << _PLACE_BITS) | (_LAST_PLACE - place), 0)
            if leave is not None:
                keys[place[None, :] == (leave + need)[:, None]] = 0
            new = keys.max(axis=1) > low[need]
            rows = need[new]
            best[rows] = np.partition(np.hstack([best[rows], keys[new]]), BLOCK, axis=1)[:, BLOCK:]
        best = -np.sort(-best, axis=1)
        return [(_LAST_PLACE - (r[r > 0] & _LAST_PLACE), (r[r > 0] >> _PLACE_BITS) / 1e6) for r in best]


def vote(cosines: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """What calibration sees: 1, the weighted vote, the best cosine, their product."""
    if not len(cosines):
        return np.array([1.0, 0.0, 0.0, 0.0])
    w = 1 / (1 - np.minimum(cosines, 1) + 0.05)
    v = float((w * labels).sum() / w.sum())
    return np.array([1.0, v, float(cosines[0]), v * float(cosines[0])])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    beta, keep = np.zeros(x.shape[1]), ridge * np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(x.shape[1]), x.T @ (y - p) - keep @ beta)
        beta = beta + np.clip(step, -5, 5)
    return beta


class Model:
    def __init__(self, vocabulary: dict[str, int], idf: np.ndarray, examples: list[dict[int, int]], labels: np.ndarray, ids: list, odds: float = 1.0):
        """odds: by how much the odds of label 1 among all labelled rows are those among the examples."""
        self.vocabulary, self.labels, self.ids = vocabulary, labels.astype(np.float64), ids
        self.index = BlockMaxIndex(examples, idf)
        seen = np.array([vote(c, self.labels[p]) for p, c in self.index.nearest(examples, NEIGHBOURS, leave=0)])
        self.beta = fit_logistic(seen, self.labels) + np.array([np.log(odds), 0, 0, 0]) if len(examples) else None

    def scores(self, texts: list[dict[int, int]]) -> list[tuple[float, list]]:
        """Score and evidence of each text's counts."""
        if self.beta is None:
            return [(0.0, [])] * len(texts)
        found = self.index.nearest(texts, NEIGHBOURS)
        return [(float(1 / (1 + np.exp(-np.clip(vote(c, self.labels[p]) @ self.beta, -30, 30)))), [self.ids[i] for i in p[:3]]) for p, c in found]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out():
        terms = [t for t in {*found[0], *found[1]}]
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([found[1][t] for t in terms], pa.int64()), pa.array([found[0][t] for t in terms], pa.int64())], names=["term", "pos", "neg"])

    found = [Counter(), Counter()]
    for b in batches:
        for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            found[y].update({t for w in set((text or "").lower().split()) for t in terms_of(w)})
            if sum(map(len, found)) > 400_000:
                yield out()
                found = [Counter(), Counter()]
    yield out()


def _having(vocabulary: dict[str, int]):
    """How many texts have each term, and, under the number after the last, how many there are."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, n = Featurizer(vocabulary), np.zeros(len(vocabulary) + 1, np.int64)
        for b in batches:
            for text in b.column("text").to_pylist():
                n[[*features.known(text), len(vocabulary)]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], names=["id", "n"])

    return f


def _example_counts(vocabulary: dict[str, int]):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer(vocabulary)
        for b in batches:
            got = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array([list(g) for g in got], pa.list_(pa.int32())), pa.array([list(g.values()) for g in got], pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms", "counts"])

    return f


def is_drawn(doc_id: Column, share: Column) -> Column:
    """Whether a document is in a sample of that share, however small: two hashes make a number from 0 to 1 with a step of 5e-16."""
    first, second = F.pmod(F.xxhash64(F.lit("example"), doc_id), F.lit(1_000_000)), F.pmod(F.xxhash64(F.lit("rest"), doc_id), F.lit(2**31))
    return first + second / F.lit(2.0**31) < share * 1_000_000


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, sample_rows: int = SAMPLE_ROWS, terms: int = TERMS) -> Model:
    """learn: condition on doc_id. The driver gets the chosen terms and the examples' counts of them, no texts."""
    known = labels.where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    shares = {r.toxic: min(1.0, sample_rows / r["count"]) for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, shares.get(1, 1.0)).otherwise(shares.get(0, 1.0))
    drawn = known.where(is_drawn(F.col("doc_id"), share))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return Model({}, np.zeros(0), [], np.zeros(0), [])
    counted = rows.select("text", "toxic").mapInArrow(_term_counts, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg >= 3")
    n, df = float(pos + neg), F.col("pos") + F.col("neg")
    expected = df * (pos / n) * (1 - df / n) * (1 - pos / n)
    chi = (F.col("pos") - df * pos / n) ** 2 / F.greatest(expected, F.lit(1e-9))
    best = counted.withColumn("chi", chi).orderBy(F.desc("chi"), "term").limit(terms).collect()
    vocabulary = {r.term: i for i, r in enumerate(best)}
    having = docs.select("text").mapInArrow(_having(vocabulary), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    held = np.zeros(len(vocabulary) + 1)  # the last place counts the documents
    held[[r.id for r in having]] = [r.n for r in having]
    idf = np.log((1 + held[-1]) / (1 + held[:-1])) + 1
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, terms array<int>, counts array<int>"
    examples = sorted(rows.select("doc_id", "text", "toxic").mapInArrow(_example_counts(vocabulary), kind).collect(), key=lambda r: (-r.toxic, len(r.terms), r.terms, str(r.doc_id)))
    return Model(vocabulary, idf, [dict(zip(r.terms, r.counts, strict=True)) for r in examples], np.array([r.toxic for r in examples]), [r.doc_id for r in examples], shares[0] / shares[1])


def _scores(model: Model):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer(model.vocabulary)
        for b in batches:
            got = model.scores([features(t) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s for s, _ in got], pa.float64()), pa.array([",".join(map(str, e)) for _, e in got], pa.string())], names=["doc_id", "score", "evidence"])

    return f


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, **options) -> DataFrame:
    """Per document row: doc_id, score and evidence (ids of the three nearest examples, comma-joined)."""
    model = fit(docs, labels, learn, **options)
    return docs.select("doc_id", "text").mapInArrow(_scores(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, evidence string")


def op3_knn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = id_remainder(F.col("doc_id"), 4)
    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), rest != 2)
    return out.select("doc_id", (rest == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


QUERIES = {"op3_knn_toxicity": op3_knn_toxicity}
