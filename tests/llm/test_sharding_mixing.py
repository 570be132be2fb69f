import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shorewise.llm import common, mixing, sharding


def test_slots_are_gapless_and_few_rows_move(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") * 2).alias("slot"))
    rows = sharding.shard_records(df, "doc_id", [1.0] * 6, rows_per_group=50).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 6)
    assert len(rows) == 3000 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert 300 < sum(r.grown_shard == 6 for r in rows) < 560


def test_weights(spark):
    df = spark.range(8000).select(F.col("id").alias("doc_id"))
    n = Counter(r.shard for r in sharding.shard_records(df, "doc_id", [1, 2, 5], grow_by=None).collect())
    assert n[0] / 8000 == pytest.approx(1 / 8, abs=0.02) and n[2] / 8000 == pytest.approx(5 / 8, abs=0.02)


def test_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    rows = sharding.op6_rendezvous_sharding(spark, str(tmp_path)).collect()
    texts = [(r.doc_id, (r.text or "").encode()) for r in odd.collect()]
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len(t) + 8, zlib.crc32(t)) for i, t in texts)
    assert len({r.shard for r in rows if r.doc_id == 5}) == 1 and len({r.slot for r in rows if r.doc_id == 5}) == 2
    assert sharding.shard_records(odd.where("false"), "doc_id", [1.0]).count() == 0


def plain_targets(words, share=1.5, most=2.0):
    """Targets by source, filled up source by source until no excess is left."""
    names = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(words.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= most * words[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: most * words[s] for s in over}
        left, open_ = left - sum(target[s] for s in over), open_ - over
    return target


def test_water_fill(spark):
    for words in ({"a": 10, "b": 1000, "c": 100}, {"a": 0, "b": 4}, {None: 5, "x": 7, "é": 900, "z": 3, "Z": 40}, {"only": 9}, {"a": 0}):
        df = spark.createDataFrame(list(words.items()), "source string, words long")
        key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key")
        plan = common.ranked(df.select(key, "source", "words"), F.col("key") == "", F.col("key"))
        got = mixing.water_fill(plan.withColumn("weight", mixing.cyclic_weights(F.col("rank"))), 1.5, 2.0).collect()
        want = plain_targets(words)
        assert {r.source: pytest.approx(r.target) for r in got} == want


def test_ranked(spark):
    got = common.ranked(spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(5), F.col("x")).collect()
    assert all(r["rank"] == r.x for r in got) and len(got) == 1000


def test_splitting_tree():
    quotas = np.array([40, 0, 7, 1000])
    for shards in (1, 3, 8):
        sizes = mixing.even_sizes(1047, shards)
        dealt = mixing.splitting_tree(quotas, sizes, [3])
        assert dealt.shape == (shards, 4) and (dealt.sum(axis=0) == quotas).all() and (dealt >= 0).all()
        assert (dealt.sum(axis=1) == sizes).all() and sizes.max() - sizes.min() <= 1
    assert (mixing.splitting_tree(quotas, sizes, [3]) == mixing.splitting_tree(quotas, sizes, [3])).all()


def test_dealt_quotas(spark):
    quotas = {f"s{i}": i % 50 for i in range(3000)}
    got = mixing.dealt_quotas(spark.createDataFrame(list(quotas.items()), "key string, quota long"), 5, 7).collect()
    assert len(got) == 3000 and all(0 <= r.cuts[0] and sorted(r.cuts) == r.cuts and r.cuts[-1] <= quotas[r.key] for r in got)
    before = [sum(r.cuts[i] for r in got) for i in range(4)]
    assert before == mixing.even_sizes(sum(quotas.values()), 5).cumsum()[:-1].tolist()


@pytest.mark.parametrize("blocks_a_group", [4096, 3])
def test_mix(spark, real, blocks_a_group):
    mix = lambda: mixing.mix_sources(real, mixing.word_count(F.col("text")), block_rows=4, blocks_a_group=blocks_a_group)
    rows = mix().collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in real.collect())
    words = {r.doc_id: len((r.text or "").encode().split()) for r in real.collect()}
    taken, target, sizes, drawn, shards = Counter(), {}, Counter(), Counter(), Counter()
    for r in rows:
        assert r["size"] == words[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        assert r.taken == sum(d.words for d in r.draws) and r.out_shards == ",".join(str(d.out_shard) for d in r.draws)
        taken[r.source] += r.taken
        sizes[r.source] += r["size"]
        target[r.source] = r.target
        drawn[r.source] += 0 < r.taken % max(1, r["size"])
        shards.update(d.out_shard for d in r.draws)
    want = plain_targets(sizes)
    assert all(target[s] == pytest.approx(want[s]) and taken[s] == int(want[s] + 0.5) for s in want)
    assert all(n <= 1 for n in drawn.values())  # of a source, one document at most is drawn in part
    assert set(shards) == set(range(16))
    passes = {s: taken[s] // sizes[s] for s in sizes}
    assert all(len(r.draws) in (passes[r.source], passes[r.source] + 1) for r in rows if r["size"])
    assert {(r.doc_id, r.taken, r.out_shards) for r in mix().collect()} == {(r.doc_id, r.taken, r.out_shards) for r in rows}


CLASHING = ("__id", "__hash", "__source", "__offset", "__group", "__rank", "__spans", "row", "key", "group", "block", "offset", "rank", "order", "own", "id", "hash", "words", "shard", "target", "passes", "rest", "draws")


def clashing(docs):
    return docs.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})


def test_mix_of_odd_rows(odd):
    renamed = clashing(odd)
    rows = mixing.mix_sources(renamed, mixing.word_count(F.col("text"))).collect()
    assert len(rows) == odd.count() and sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r["size"] for r in rows), abs=2)
    assert all(r["passes"] == CLASHING.index("passes") and r.row == CLASHING.index("row") for r in rows)
    empty = mixing.mix_sources(renamed.where("false"), mixing.word_count(F.col("text")))
    assert empty.count() == 0 and set(empty.columns) == set(rows[0].asDict())
    out = mixing.mixed_corpus(renamed)
    assert out.columns == renamed.columns and out.count() >= 1 and mixing.mixed_corpus(odd.where("false")).count() == 0


def test_sharding_with_clashing_columns(odd):
    renamed = clashing(odd)
    out = sharding.shard_records(renamed, "doc_id", [1.0] * 3, tie=["n_chars"], rows_per_group=2)
    rows = out.collect()
    assert len(rows) == odd.count() and all(r.row == CLASHING.index("row") and r.rank == CLASHING.index("rank") for r in rows)
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in range(3))
