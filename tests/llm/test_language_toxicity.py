import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shorewise.llm import language_id as L
from shorewise.llm import toxicity as X
from shorewise.llm.common import id_remainder


def profile(text, size):
    n = Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        marked = f"\0{w}\0"
        for c in w:
            n[(ord(c),)] += 1
        for k in (2, 3):
            for i in range(len(marked) - k + 1):
                n[tuple(map(ord, marked[i : i + k]))] += 1
    return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], len(x[0]), x[0]))][:size]


def test_ranking_against_plain_code():
    texts = ["The cat sat; the hat.", "", None, "123", "Été à Ñandú 学校 x1y", "a" * 5000 + " b"]
    for text, (own, keys) in zip(texts, L.ranked(texts, 50), strict=True):
        found = []
        for k in keys[own]:
            k = int(k)
            n = 3 if k >> 63 else 2 if k >> 42 else 1
            k &= (1 << 63) - 1 if n == 3 else (1 << 42) - 1
            found.append(tuple((k >> (21 * (n - 1 - i))) & 0x1FFFFF for i in range(n)))
        assert found == profile(text, 50)


def decoded(key):
    n = 3 if key >> 63 else 2 if key >> 42 else 1
    key &= (1 << 63) - 1 if n == 3 else (1 << 42) - 1
    return tuple((key >> (21 * (n - 1 - i))) & 0x1FFFFF for i in range(n))


def test_prediction_against_plain_code(spark, real):
    """Out-of-place distances, the nearest language with ties to the first, score and distance."""
    learned = L.learn(real, F.lit(True), profile=60)
    learned["aa"] = learned["en"]  # a tie
    places = {lang: {decoded(int(k)): i for i, k in enumerate(keys)} for lang, keys in learned.items()}
    rows = [(r.doc_id, r.text) for r in real.where("doc_id < 60").collect()] + [(-1, None), (-2, "12"), (-3, "zzz"), (-4, "ab " * 30_000)]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string"), learned, profile=60).collect()}
    for doc_id, text in rows:
        own = profile(text, 60)
        if not own:
            assert (got[doc_id].lang_pred, got[doc_id].score) == ("und", 0)
            continue
        d = {lang: sum(abs(at[g] - i) if g in at else 60 for i, g in enumerate(own)) for lang, at in places.items()}
        first, second = sorted(d, key=lambda lang: (d[lang], lang))[:2]
        assert got[doc_id].lang_pred == first
        assert got[doc_id].score == pytest.approx(d[second] / (d[first] + d[second]) if d[second] else 0.5)
        assert got[doc_id].far == pytest.approx(d[first] / (60 * len(own)))


def test_held_out_accuracy(real):
    rest = id_remainder(F.col("doc_id"), 5)
    found = L.identify(real, L.learn(real, rest != 0)).join(real.select("doc_id", "lang"), "doc_id").where(rest == 0).collect()
    assert len(found) > 20 and np.mean([r.lang == r.lang_pred for r in found]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_odd_rows(odd, real):
    profiles = L.learn(real, F.lit(True))
    rows = L.identify(odd, profiles).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3, 9))
    assert {r.lang_pred for r in L.identify(odd, {}).collect()} == {"und"}
    assert L.learn(odd.where("false"), F.lit(True)) == {}
    assert L.identify(odd.where("false"), profiles).count() == 0
    one = L.identify(odd.where("doc_id = 4"), {"xx": profiles["en"]}).first()
    assert one.lang_pred == "xx" and 0 <= one.score <= 1
    kept = L.keep_identified(odd, F.lit(True))
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {4, 5, None, 7, 8}


def test_block_max_is_exact():
    rng = np.random.default_rng(3)
    vectors = [dict(zip(rng.choice(40, 6, replace=False).tolist(), rng.integers(1, 5, 6).tolist(), strict=True)) for _ in range(500)]
    index = X.BlockMaxIndex(vectors, rng.uniform(1, 4, 40))
    dense = np.zeros((500, 40))
    for i, v in enumerate(vectors):
        ids, w = index.weigh(v)
        dense[i, ids] = w
    queries = [*vectors[:100], {}]
    for leave in (None, 0):
        found = index.nearest(queries, 7, leave=leave)
        assert len(found) == 101 and not len(found[-1][0])
        for at, (q, (places, cosines)) in enumerate(zip(queries[:-1], found, strict=False)):
            ids, w = index.weigh(q)
            plain = dense[:, ids] @ w
            if leave is not None:
                plain[at] = 0
                assert at not in places
            best = np.lexsort((np.arange(500), -plain.round(6)))[:7]
            np.testing.assert_allclose(cosines, plain[best], atol=1e-5)
            np.testing.assert_allclose(plain[places], cosines, atol=1e-5)
    assert [len(p) for p, _ in X.BlockMaxIndex([], np.ones(3)).nearest([{1: 2}], 7)] == [0]
    few = X.BlockMaxIndex([{0: 1}, {0: 1}, {1: 1}], np.ones(2))
    assert [p.tolist() for p, _ in few.nearest([{0: 3}, {1: 1}], 7)] == [[0, 1], [2]]


def test_toxicity(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdeimnrst"), 5))
    bad = ["vilewort", "foulness", "grimly"]
    rows = []
    for i in range(600):
        toxic = i % 10 == 0
        words = [word() for _ in range(30)] + (list(rng.choice(bad, 3)) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (None, "vilewort"), (5, "twice")], "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1)], "doc_id long, toxic int")
    rest = id_remainder(F.col("doc_id"), 4)
    out = X.score_toxicity(docs, labels, rest != 2).collect()
    assert len(out) == 604 and all(0 <= r.score <= 1 for r in out)
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r.doc_id in truth and r.doc_id != 5]
    assert np.mean([(r.score >= 0.3) == bool(truth[r.doc_id]) for r in held]) > 0.98
    assert all(r.score < 0.3 for r in out if r.doc_id in (1000, 1001))
    none = X.score_toxicity(docs, labels.where("false"), rest != 2).collect()
    assert {r.score for r in none} == {0.0}
    assert X.score_toxicity(docs.where("false"), labels, rest != 2).count() == 0


def test_model_against_plain_code(spark):
    """Terms by chi-square, weights, cosines, votes and evidence of a small corpus, with a very long text. Its examples are fewer than the neighbours asked for, so none is left out."""
    rng = np.random.default_rng(9)
    text = lambda bad: " ".join(rng.choice(["oak", "elm", "ash", "fir", *(["vile", "foul"] if bad else [])], 12))
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(16)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(100, "vile oak " * 20_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = X.fit(docs, labels, F.lit(True), terms=9)
    bags = {i: Counter(x for w in t.split() for x in X.terms_of(w)) for i, t, _ in rows} | {100: Counter({x: 20_000 for w in ("vile", "oak") for x in X.terms_of(w)})}
    label, chi = {i: y for i, _, y in rows}, {}
    for x in {x for i in label for x in bags[i]}:
        pos, neg = (sum(x in bags[i] for i in label if label[i] == y) for y in (1, 0))
        if pos + neg >= 3:
            expected = (pos + neg) * 4 / 16
            chi[x] = (pos - expected) ** 2 / max(expected * (1 - (pos + neg) / 16) * (1 - 4 / 16), 1e-9)
    limit = sorted(chi.values())[-9]
    assert len(model.vocabulary) == 9 and all(chi[x] >= limit - 1e-9 for x in model.vocabulary)

    def vector(bag):
        idf = {x: np.log((1 + 17) / (1 + sum(x in b for b in bags.values()))) + 1 for x in model.vocabulary}
        v = np.array([(1 + np.log(bag[x])) * idf[x] if bag[x] else 0.0 for x in model.vocabulary])
        return v / max(np.linalg.norm(v), 1e-12)

    got = {r.doc_id: r for r in X.score_toxicity(docs, labels, F.lit(True), terms=9).collect()}
    assert set(got) == {*label, 100}
    for i, r in got.items():
        near = [(float(vector(bags[i]) @ vector(bags[j])), j) for j in label]
        cosine, y = np.array([c for c, _ in near if c > 1e-9]), np.array([label[j] for c, j in near if c > 1e-9])
        w = 1 / (1 - np.minimum(cosine, 1) + 0.05)
        share, best = (w @ y / w.sum(), cosine.max()) if len(cosine) else (0.0, 0.0)
        z = np.array([1, share, best, share * best]) @ model.beta
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-3)
        evidence = [int(j) for j in r.evidence.split(",") if j]
        assert [dict((j, c) for c, j in near)[j] for j in evidence] == pytest.approx(sorted(cosine, reverse=True)[:3], abs=1e-4)


def test_draw_of_any_share(spark):
    """A share below a millionth draws its part, and a share of one draws all."""
    ids = spark.range(30_000_000).select("id")
    drawn = {s: ids.where(X.is_drawn(F.col("id"), F.lit(s))).count() for s in (1.0, 3.4e-6, 4e-7)}
    assert drawn[1.0] == 30_000_000 and 60 <= drawn[3.4e-6] <= 145 and 3 <= drawn[4e-7] <= 25
