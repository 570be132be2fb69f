"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Word totals of each source give its target: shares by weight, no target
   above `max_repeat` times its source, the excess reshared (water filling).
2. A source's documents fall into hashed blocks of about BLOCK_ROWS rows, in a
   seeded order of blocks. Its quota is a number of block draws: whole passes over
   its blocks, then the first blocks of the order until the target is reached; the
   last of these draws gives only the words that are missing.
3. The splitting tree recursively partitions the exact quotas of all sources among
   the output shards, each node by one multivariate-hypergeometric draw. Sources
   are levels of it too: the driver splits the quotas of at most GROUPS groups of
   sources, and a task splits those of each group among its sources.
4. Each shard takes its number of a source's draws, disjoint ranges of the permuted
   blocks. What a document gives is the sum over the draws of its block. In a
   shard, draw_key shuffles.

Nothing of a source or of a block comes to the driver but sums over all; order
and running totals go by groups of blocks first, so that no source is in one
task. Documents move once, by (source, block).

Defined results: a null text has size 0 and nothing of it is taken; a null
source is a source; repeated rows are drawn one by one; an empty table gives an
empty result; other columns pass through, those named like results are replaced;
reruns give the same mix.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shorewise.llm.common import carried, ranked, settled, table

BLOCK_ROWS, BLOCKS_A_GROUP, GROUPS, BROADCAST_SOURCES, SHARDS, SEED = 1024, 4096, 1024, 200_000, 16, 7


def cyclic_weights(rank: Column, cycle: Sequence[float] = (3, 1, 2)) -> Column:
    """Weights by rank: sources by code point, null last, weigh the cycle's values in turn."""
    return F.get(F.array(*[F.lit(float(w)) for w in cycle]), F.pmod(rank, F.lit(len(cycle))).cast("int"))


def water_fill(sources: DataFrame, share: float, max_repeat: float) -> DataFrame:
    """sources (words, weight) with target: in sum share times all words, in proportion to the weights up to max_repeat times the words."""
    sources = sources.withColumn("cap", F.col("words") * F.lit(float(max_repeat)))
    sums = lambda df: df.agg(F.count(F.lit(1)), F.sum("cap"), F.sum("weight"), F.sum("words")).first()
    _, _, weight, words = sums(sources)
    level, full = 0.0, -1
    while words:
        n, caps, taken, _ = sums(sources.where(F.col("cap") <= F.col("weight") * level))
        if n == full or weight <= (taken or 0):
            break
        level, full = (share * words - (caps or 0)) / (weight - (taken or 0)), n
    # all at their caps, if the rest has no weight left
    return sources.withColumn("target", F.least("cap", F.col("weight") * level)).drop("cap")


def splitting_tree(quotas: np.ndarray, sizes: np.ndarray, seed: Sequence[int]) -> np.ndarray:
    """Draws of each source (columns) for each output shard (rows): columns sum to the quotas, rows to the sizes."""
    if len(sizes) == 1:
        return quotas[None, :]
    left = len(sizes) // 2
    rng = np.random.default_rng([*seed, len(sizes)])
    take = rng.multivariate_hypergeometric(quotas, int(sizes[:left].sum()), method="marginals") if quotas.sum() else quotas * 0
    return np.vstack([splitting_tree(take, sizes[:left], [*seed, 1]), splitting_tree(quotas - take, sizes[left:], [*seed, 2])])


def even_sizes(total: int, shards: int) -> np.ndarray:
    return np.diff(np.arange(shards + 1, dtype=np.int64) * total // shards)


def _split_group(seed: int):
    def f(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("key")
        dealt = splitting_tree(t["quota"].to_numpy(np.int64), np.array(t["sizes"].iloc[0], np.int64), [seed, int(t["group"].iloc[0])])
        return pd.DataFrame({"key": t["key"], "cuts": list(dealt.cumsum(axis=0)[:-1].T.tolist())})

    return f


def dealt_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(key, cuts) of (key, quota): how many draws of a source the shards before each one take."""
    spark = quotas.sparkSession
    quotas = quotas.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(GROUPS)).cast("int"))
    sums = sorted(quotas.groupBy("group").agg(F.sum("quota").alias("quota")).collect())  # GROUPS rows at most
    totals = np.array([r.quota for r in sums], np.int64)
    dealt = splitting_tree(totals, even_sizes(int(totals.sum()), shards), [seed])
    sizes = spark.createDataFrame([(r.group, dealt[:, i].tolist()) for i, r in enumerate(sums)], "group int, sizes array<long>")
    return quotas.join(F.broadcast(sizes), "group").groupBy("group").applyInPandas(_split_group(seed), "key string, cuts array<long>")


def _mark(seed: int, *cols: str) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def _fitting(rows: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(rows) if few else rows


def mix_sources(
    docs: DataFrame, size: Column, *, weights: Callable[[Column], Column] = cyclic_weights, share: float = 1.5, max_repeat: float = 2.0,
    shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS, blocks_a_group: int = BLOCKS_A_GROUP,
) -> DataFrame:
    """docs with size, source_size, target, taken, draws (of each: out_shard and words), out_shards (comma-joined) and draw_key."""
    added = ("size", "source_size", "target", "taken", "draws", "out_shards", "draw_key")
    own = [c for c in docs.columns if c not in added]
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = carried(docs, F.col("doc_id").alias("id"), key.alias("key"), size.cast("long").alias("size"))
    slim = settled(rows.select("id", "key", "size"))
    if slim.isEmpty():
        return docs.selectExpr(*[f"`{c}`" for c in own], "0L AS size", "0L AS source_size", "0D AS target", "0L AS taken", "array(struct(0 AS out_shard, 0L AS words)) AS draws", "'' AS out_shards", "0L AS draw_key")

    found = slim.groupBy("key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    plan = ranked(found, F.col("key") == "", F.col("key")).withColumn("weight", weights(F.col("rank")))
    plan = water_fill(settled(plan), share, max_repeat)
    quota = F.floor(F.col("target") + 0.5)
    passes = F.coalesce(F.expr("quota div nullif(words, 0)"), F.lit(0).cast("long"))
    plan = plan.withColumn("quota", quota).withColumn("passes", passes).withColumn("rest", F.col("quota") - F.col("passes") * F.col("words"))
    plan = settled(plan.select("key", "words", "target", "passes", "rest", F.ceil(F.col("rows") / block_rows).alias("blocks")))
    few = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    of_source = _fitting(plan, few)

    # blocks in their order, with the draws and words of the source before each
    block = F.pmod(_mark(seed, "id", "size"), F.col("blocks")).alias("block")
    blocks = slim.join(of_source.select("key", "blocks"), "key").select("key", block, "size").groupBy("key", "block").agg(F.sum("size").alias("words"))
    blocks = blocks.join(of_source.select("key", "passes", "rest", "blocks"), "key")
    groups = F.ceil(F.col("blocks") / blocks_a_group)
    blocks = settled(blocks.withColumn("group", F.pmod(_mark(seed + 1, "key", "block"), groups)).withColumn("place", _mark(seed + 3, "key", "block")))
    earlier = lambda *of: Window.partitionBy(*of).rowsBetween(Window.unboundedPreceding, -1)
    running = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    sums = blocks.groupBy("key", "group").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("n"))
    sums = sums.select("key", "group", running("words", earlier("key").orderBy("group")).alias("words_before"), running("n", earlier("key").orderBy("group")).alias("n_before"))
    inside = earlier("key", "group").orderBy("place", "block")
    blocks = blocks.withColumn("own_before", running("words", inside)).withColumn("own_n", running(F.lit(1), inside)).join(sums, ["key", "group"])
    blocks = blocks.withColumn("before", F.col("words_before") + F.col("own_before")).withColumn("turn", F.col("n_before") + F.col("own_n"))
    blocks = settled(blocks.select("key", "block", "words", "passes", "rest", "before", "turn", (F.col("before") < F.col("rest")).alias("again")))

    # the tree's cuts through each source's draws, in the order of pass and place; a draw's words are those of the block but for the last
    held = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("held"), (F.count(F.lit(1)) * F.first("passes") + F.count_if("again")).alias("quota"))
    held = settled(held)
    cuts = held.join(dealt_quotas(held.select("key", "quota"), shards, seed), "key").select("key", "held", "cuts")
    turns = F.col("passes") + F.col("again").cast("long")
    shard = lambda e: F.size(F.filter("cuts", lambda c: c <= e * F.col("held") + F.col("turn")))
    words = lambda e: F.when(e < F.col("passes"), F.col("words")).otherwise(F.col("rest") - F.col("before"))
    draws = F.transform(F.sequence(F.lit(1).cast("long"), turns), lambda e: F.struct(shard(e - 1).alias("out_shard"), words(e - 1).alias("words")))
    drawn = blocks.join(_fitting(cuts, few), "key").where(turns > 0).select("key", "block", draws.alias("draws"))

    rows = rows.join(of_source.select("key", F.col("words").alias("source_size"), "target", "blocks"), "key").withColumn("block", block).withColumn("draw_key", _mark(seed + 2, "id"))
    order = Window.partitionBy("key", "block").orderBy("draw_key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", running("size", order)).join(drawn, ["key", "block"], "left")
    # of a draw's words, in the block's order, those that are the document's
    given = lambda d: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), d["words"] - F.col("inside")))
    none = F.array().cast("array<struct<out_shard:int,words:long>>")
    own_draws = F.coalesce(F.filter(F.transform("draws", lambda d: F.struct(d["out_shard"].alias("out_shard"), given(d).alias("words"))), lambda d: d["words"] > 0), none)
    rows = rows.withColumn("draws", own_draws)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda n, d: n + d["words"])
    return rows.select(*[F.col("row")[c].alias(c) for c in own], "size", "source_size", "target", taken.alias("taken"), "draws", F.array_join(F.transform("draws", lambda d: d["out_shard"]), ",").alias("out_shards"), "draw_key")


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text, 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def mixed_corpus(docs: DataFrame, **options) -> DataFrame:
    """docs as the output shards draw them, the columns unchanged: a row for each draw that gives at least half of its document, sorted by shard and draw_key where they lie."""
    rows = carried(docs, F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("n"))
    mix = mix_sources(rows, F.col("n"), **options)
    drawn = mix.withColumn("draw", F.explode("draws")).where(F.col("draw.words") * 2 >= F.col("size"))
    return drawn.sortWithinPartitions("draw.out_shard", "draw_key").select("row.*")


def op9_hypergeometric_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("n"))
    return mix_sources(docs, F.col("n")).select("doc_id", "size", "source_size", "target", "taken", "source", "out_shards", "draw_key")


QUERIES = {"op9_hypergeometric_mixing": op9_hypergeometric_mixing}
