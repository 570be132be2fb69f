import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from shorewise.llm import common, components, near_dedup
from shorewise.llm.shingles import shingle_sets


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[(i, t)] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def brute(rows):
    sets, parent = sets_of(rows), {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    keys = list(sets)
    for a in range(len(keys)):
        find(keys[a])
        for b in range(a):
            x, y = sets[keys[a]], sets[keys[b]]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                parent[find(keys[a])] = find(keys[b])
    groups = defaultdict(list)
    for k in keys:
        groups[find(k)].append(k[0])
    low = {g: min([i for i in ids if i is not None], default=None) for g, ids in groups.items()}
    return Counter((i, len(sets[(i, t)]), low[find((i, t))] if sets[(i, t)] else i, i == (low[find((i, t))] if sets[(i, t)] else i)) for i, t in rows)


def near_rows():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    rows, at = [], 100
    for size in (1, 2, 6, 40):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 3, 6))):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((at, " ".join(own)))
            at += rng.choice((1, 7))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile", [1000, 7])
def test_against_brute_force(spark, odd, tile):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS family")
    got = near_dedup.near_duplicates(docs, tile=tile).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows)


def test_one_of_each(spark, odd):
    kept = near_dedup.one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, None, 7, 8, 9])
    assert near_dedup.near_duplicates(odd.where("false")).count() == 0


def test_clashing_columns(odd):
    renamed = odd.withColumns({c: F.lit(i) for i, c in enumerate(("__id", "__hash", "row", "id", "hash", "label", "kept", "node"))})
    kept = near_dedup.one_of_each(renamed)
    assert kept.columns == renamed.columns and all(r.hash == 4 and r.kept == 6 for r in kept.collect())


def test_rows_of_one_large_family(spark, monkeypatch):
    """5,000 different near copies of one text: what the passes write stays in proportion to them."""
    rng, words, rows = random.Random(3), [f"w{i}" for i in range(200)], []
    for i in range(5000):
        own = list(words)
        for _ in range(1 + (i % 50 == 0)):
            own[rng.randrange(200)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(own)))
    written = []

    def counted(df, write=common.settled):
        out = write(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "settled", counted)
    monkeypatch.setattr(components, "settled", counted)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("component_id = 0").count() > 4900
    assert max(written) <= 4 * 5000 and sum(written) <= 25 * 5000


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1000).astype(np.uint64)
    limit = near_dedup.max_odd_bits()
    for share, inside in ((0.95, True), (0.86, True), (0.4, False)):
        n = int(1000 * 2 * share / (1 + share))
        other = np.concatenate([base[:n], rng.integers(0, 2**63, 1000 - n).astype(np.uint64)])
        s = near_dedup.odd_sketches(near_dedup.minhashes([np.unique(base), np.unique(other)])).view(np.uint64)
        assert (np.bitwise_count(s[0] ^ s[1]).sum() <= limit) is np.bool_(inside)


def test_confirmed_both_ways():
    texts = [t.encode().split() for _, t in near_rows()]
    sets = dict(enumerate(shingle_sets(texts, 5)))
    every = np.array([(i, j) for i in range(len(sets)) for j in range(i)])
    dense = {tuple(p) for p in near_dedup._confirmed(every, sets, 85).tolist()}
    few = {tuple(p) for i in range(0, len(every), 20) for p in near_dedup._confirmed(every[i : i + 20], sets, 85).tolist()}
    assert dense == few and dense


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 5), (50, 51), (7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 0, 50: 50, 51: 50}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stage_against_brute_force_at_80(spark, sf_dir):
    """Copies of similarity 0.80 to 0.85 are one document to the pipeline's stage."""
    base = [f"w{i}" for i in range(104)]  # 100 shingles; each changed word far from others is 5 of them

    def copy(changed):
        return " ".join(f"x{i}" if i in changed else w for i, w in enumerate(base))

    rows = [(10, " ".join(base)), (11, copy({20, 60})), (12, copy({20, 60, 90})), (13, " ".join(f"v{i}" for i in range(104))), (14, None)]
    sets, kept = sets_of(rows), []
    like = lambda x, y: len(sets[x] & sets[y]) / len(sets[x] | sets[y]) if sets[x] and sets[y] else 0
    assert 0.80 <= like(rows[0], rows[1]) < 0.85 and like(rows[0], rows[2]) < 0.80 and like(rows[1], rows[2]) > 0.85
    for r in rows:  # ids ascend and every link here leads to a smaller id
        if not any(like(r, x) >= 0.8 for x in rows[: rows.index(r)]):
            kept.append(r[0])
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()) == kept == [10, 13, 14]
    assert (1 - 0.8**near_dedup.ROWS) ** near_dedup.bands_of(80) < 1e-8 and near_dedup.bands_of(85) == 32
