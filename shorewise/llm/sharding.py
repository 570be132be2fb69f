"""Sharding by weighted rendezvous hashing.

Every shard scores every record key; the highest score takes the record. A new
shard wins some records from all the others and nothing else moves. The score
is a function of key and shard alone, so no state, no shuffle and no UDF is
needed for the assignment. Numbers inside a shard come from per-group row
numbers plus group offsets, so that no task ever holds a whole shard.

Defined results: a null key counts as one value of its own, so such rows share
a shard; repeated rows get the same shard and different slots; an empty table
gives an empty result; a null text has size 8 and checksum 0; columns of the
input that aren't overwritten pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shorewise.llm.common import carried, table

SCORE_BITS = 52
ROWS_PER_GROUP = 20_000
SHARDS = 24


def _hash(key: Column, salt: str) -> Column:
    """The first 52 bits of an MD5, a whole number that a double holds exactly."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f"#{salt}")).cast("binary")), 1, SCORE_BITS // 4), 16, 10).cast("long")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Index of the shard that takes the key; a shard's share is in proportion to its weight."""
    key = F.coalesce(key.cast("string"), F.lit("\x00null"))
    bids = [
        F.struct((F.log((_hash(key, str(s)) + F.lit(0.5)) / F.lit(2.0**SCORE_BITS)) / F.lit(float(w))).alias("bid"), F.lit(-s).alias("shard"))
        for s, w in enumerate(weights)
    ]
    return -(F.greatest(*bids) if len(bids) > 1 else bids[0])["shard"]


def shard_records(df: DataFrame, key: str, weights: Sequence[float], *, grow_by: float | None = 1.0, tie: Sequence[str] = (), rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """df with shard, slot (gapless from 0 in each shard) and grown_shard (with one more shard of weight grow_by)."""
    own = [c for c in df.columns if c not in ("shard", "slot", "grown_shard")]
    grown = rendezvous(F.col(key), [*weights, grow_by]) if grow_by else F.lit(None).cast("int")
    groups = max(1, -(-df.count() // (rows_per_group * len(weights))))
    group = F.pmod(F.xxhash64(F.col(key), *tie), F.lit(groups)).cast("int")
    rows = carried(df, F.struct(key, *tie).alias("order"), rendezvous(F.col(key), weights).alias("shard"), grown.alias("grown_shard"), group.alias("group"))
    before = Window.partitionBy("shard").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "group").count().select("shard", "group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    numbered = rows.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "group").orderBy("order")))
    slot = (F.col("offset") + F.col("rank") - 1).alias("slot")
    return numbered.join(offsets, ["shard", "group"]).select(*[F.col("row")[c].alias(c) for c in own], "shard", "grown_shard", slot)


def op6_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard_records(docs, "doc_id", [1.0] * SHARDS, tie=["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op6_rendezvous_sharding": op6_rendezvous_sharding}

_BID = "ln((('0x' || substr(md5(k || '#' || s), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"
ORACLES = {
    "op6_rendezvous_sharding": f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 8 AS size,
         coalesce(doc_id::VARCHAR, chr(0) || 'null') AS k, row_number() OVER () AS rid
  FROM documents),
crc_step AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i::BIGINT], range(8)), lambda c, _ :
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
sums AS (
  SELECT rid, xor(list_reduce(list_concat([4294967295::BIGINT],
      list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h : ('0x' || h)::BIGINT)),
      lambda c, b : xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, crc_step),
won AS (
  SELECT rid, arg_max(s, b) FILTER (s < {SHARDS}) AS shard, arg_max(s, b) AS grown_shard
  FROM (SELECT rid, s, {_BID} AS b FROM d, range({SHARDS} + 1) r(s)) GROUP BY rid)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard
FROM d JOIN sums USING (rid) JOIN won USING (rid)"""
}
