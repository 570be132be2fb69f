"""Benchmark decontamination: a broadcast hash set of benchmark n-grams against every token window.

The words of every benchmark item give windows of WINDOW words (an item with
fewer words is one window). Their hashes are broadcast when there are at most
BROADCAST_WINDOWS of them, and joined by shuffle beyond that. Each document is
read once: its word hashes are combined per window inside generated code, looked
up, verified word by word, and only hits leave the stage. All of it is built-in
expressions; no Python runs on the executors.

Defined results: null or wordless text has no words and is never contaminated;
item ids that are null hit words but aren't listed; repeated items count once;
repeated document rows give repeated result rows; an empty benchmark flags
nothing; an empty table gives an empty result; other columns of `documents` pass
through `decontaminate` and are ignored by `scan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shorewise.llm.common import carried, lower_ascii, settled, table

WINDOW, BROADCAST_WINDOWS, BROADCAST_FOUND, SHARE = 13, 2_000_000, 100_000, 20
SEPARATORS, WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _combined(hashes: Column, start: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(hashes, start + j) for j in range(length)])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: __win (words), __len, __items (sorted ids as text)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    starts = items.withColumn("len", F.least("n", F.lit(window))).withColumn("i", F.explode(F.expr("sequence(0, n - len)")))
    found = starts.groupBy(F.expr("slice(words, i + 1, len)").alias("__win")).agg(F.sort_array(F.collect_set("item")).alias("__items"))
    return found.withColumn("__len", F.size("__win"))


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per document row: doc_id, text_hash, n_words, n_hit, n_items, items, spans (maximal hit word runs [i, e)), contaminated."""
    windows = benchmark_windows(benchmark, window)
    by_length = {r["__len"]: r["n"] for r in windows.groupBy("__len").agg(F.count(F.lit(1)).alias("n")).collect()}
    lengths = sorted(by_length) or [window]
    small = sum(by_length.values()) <= broadcast_windows

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), words_of(F.col("text")).alias("words"))
    rows = rows.withColumn("n_words", F.size("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("len", F.explode(F.array(*map(F.lit, lengths)))) if len(lengths) > 1 else rows.withColumn("len", F.lit(lengths[0]))
    # the start -1 stands for the document itself, so that documents without hits stay
    first = F.when(F.col("len") == lengths[0], F.lit(-1)).otherwise(F.lit(0))
    rows = rows.withColumn("i", F.explode(F.sequence(first, F.greatest(F.col("n_words") - F.col("len"), first))))
    rows = rows.where("i = -1 OR i + len <= n_words")
    key = F.xxhash64(F.col("doc_id"), F.col("text_hash"))
    for n in lengths:
        key = F.when((F.col("i") >= 0) & (F.col("len") == n), _combined(F.col("hashes"), F.col("i"), n)).otherwise(key)
    rows = rows.withColumn("key", key)
    windows = windows.withColumn("__key", _key_of_window(lengths)).withColumn("__any", F.lit(True))
    window_words = F.expr("slice(words, greatest(i, 0) + 1, len)")
    if not small:  # rows that move carry their own window, not the document
        rows, window_words = rows.select("doc_id", "text_hash", "n_words", "i", "len", "key", window_words.alias("own")), F.col("own")
    found = rows.join(
        F.broadcast(windows) if small else windows,
        (F.col("key") == F.col("__key")) & (F.col("i") >= 0) & (F.col("len") == F.col("__len")) & (window_words == F.col("__win")),
        "left",
    ).where("i = -1 OR __any")
    per = found.groupBy("doc_id", "text_hash", "n_words").agg(
        F.sum((F.col("i") == -1).cast("int")).alias("copies"),
        F.collect_set(F.when(F.col("__any"), F.struct("i", (F.col("i") + F.col("len")).alias("e")))).alias("hits"),
        F.collect_set("__items").alias("lists"),
    )
    per = per.withColumn("items", F.array_sort(F.array_distinct(F.flatten("lists")))).withColumn("spans", _merged(F.array_sort("hits")))
    per = per.withColumn("n_hit", F.aggregate("spans", F.lit(0), lambda n, s: n + s["e"] - s["i"]))
    per = per.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return per.select(
        "doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans",
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def _key_of_window(lengths: list[int]) -> Column:
    hashes, key = F.transform("__win", lambda w: F.xxhash64(w)), F.lit(None).cast("long")
    for n in lengths:
        key = F.when(F.col("__len") == n, _combined(hashes, F.lit(0), n)).otherwise(key)
    return key


def _merged(hits: Column) -> Column:
    """Overlapping or touching [i, e) of a sorted array, as maximal runs: a run begins where no earlier hit reaches, and ends before the next begins."""
    empty = F.array().cast("array<struct<i:int,e:int>>")
    one = lambda i, e: F.array(F.struct(i.alias("i"), e.alias("e")))
    start = F.struct(empty.alias("done"), F.lit(-1).alias("i"), F.lit(-1).alias("e"))
    step = lambda a, h: F.when(h["i"] <= a["e"], F.struct(a["done"].alias("done"), a["i"].alias("i"), F.greatest(a["e"], h["e"]).alias("e"))).otherwise(
        F.struct(F.when(a["e"] < 0, a["done"]).otherwise(F.concat(a["done"], one(a["i"], a["e"]))).alias("done"), h["i"].alias("i"), h["e"].alias("e"))
    )
    return F.aggregate(hits, start, step, lambda a: F.when(a["e"] < 0, a["done"]).otherwise(F.concat(a["done"], one(a["i"], a["e"]))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", **options) -> DataFrame:
    """docs without its contaminated documents, or (remove="spans") all of docs with the hit words of contaminated ones cut from the text."""
    found = scan(docs, benchmark, **options).where("contaminated").select("doc_id", "text_hash", "spans").distinct()
    found = settled(found.select(F.xxhash64("doc_id", "text_hash").alias("key"), F.struct("doc_id", "text_hash").alias("of"), "spans"))
    # the ids of contaminated documents travel to the texts unless there are too many
    found = F.broadcast(found) if found.limit(BROADCAST_FOUND + 1).count() <= BROADCAST_FOUND else found
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = carried(docs, F.struct("doc_id", text_hash.alias("text_hash")).alias("own"), F.xxhash64("doc_id", text_hash).alias("own_key"))
    same = (F.col("own_key") == F.col("key")) & F.col("own").eqNullSafe(F.col("of"))
    if remove == "documents":
        return rows.join(found, same, "left_anti").select("row.*")
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    # on the text as it is, where A-Z are still letters of words
    word, between = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    tokens = F.regexp_extract_all("row.text", F.lit(f"({word})({between})?"), F.lit(0))
    kept = F.filter(tokens, lambda t, i: ~F.exists("spans", lambda s: (i >= s["i"]) & (i < s["e"])))
    cut = F.concat(F.regexp_extract("row.text", f"^({between})", 1), F.array_join(kept, ""))
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(cut)
    return rows.join(found, same, "left").select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op2_benchmark_decontamination": op2_benchmark_decontamination}

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
ORACLES = {
    "op2_benchmark_decontamination": f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
bench AS (SELECT DISTINCT item_id::VARCHAR AS item, list_slice(w, i, i + least(len(w), {WINDOW}) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, (len(w) - least(len(w), {WINDOW}) + 2)::BIGINT)) AS i
        FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0)),
wins AS (SELECT rid, i, n, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT rid, w, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS i
        FROM docs, (SELECT DISTINCT len(win) AS n FROM bench))),
hits AS (SELECT rid, i, n, item FROM wins JOIN bench USING (win)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)"""
}
