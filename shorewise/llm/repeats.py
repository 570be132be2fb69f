"""Substring dedup of word passages by seed and extend.

Documents are dealt into blocks, and a block's task never sees another block's
text. What each of the passes below finds is written to the shared folder.

1. Seeds: winnowing picks the least SEED-word gram of every 13-word window, so
   equal windows pick equal seeds. They are listed with their blocks where the
   texts lie; those of two or more blocks go to their blocks.
2. Extension: a window is a seed extended both ways to 13 words. Each block lists
   the windows around its shared seeds with its own smallest document; the
   smallest over all blocks goes back where it is smaller than the block's.
3. Overlapping and adjoining windows of a document that begin in a smaller
   document too merge into maximal repeats, which are cut.

A passage that a third of all documents share is one row per block, not one per
document. Windows are compared by 64-bit hashes.

Defined results: null text has no words; a null id is larger than all others;
rows of the same id aren't copies of each other; texts of fewer than 13 words
keep all; an empty table gives an empty result; other columns aren't read. Ids of
any type that has an order will do: text ids compare by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shorewise.llm.common import named, numbered, settled, shared_by_blocks, table, with_blocks
from shorewise.llm.shingles import chunks, runs_of, word_hashes
from shorewise.llm.winnow import anchors, covered, inside

WINDOW, SEED, BLOCK_BYTES = 13, 5, 12_000_000
_LAST = np.iinfo(np.int64).max


def _texts(t: pa.Table) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in t.column("text").to_pylist()]


def _ids(t: pa.Table) -> np.ndarray:
    return np.array([_LAST if i is None else i for i in t.column("doc_id").to_pylist()], np.int64)


def windows_of(split: list[list[bytes]], window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window inside a text: its hash, its seed's hash, its place among all words."""
    hashes = word_hashes(split)
    lengths = np.array([len(w) for w in split], np.int64)
    grams = runs_of(hashes, seed)
    pick = anchors(grams, window - seed + 1)
    place = np.flatnonzero(inside(lengths, window, len(hashes))[: len(pick)])
    return runs_of(hashes, window)[place], grams[pick[place]], place


def _block_windows(texts: list[bytes], window: int, seed: int):
    """By chunk of texts: its range, their words, and what windows_of has of them."""
    for a, b in chunks([len(t) for t in texts]):
        split = [t.split() for t in texts[a:b]]
        yield a, b, split, *windows_of(split, window, seed)


def _seeds(window: int, seed: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            blocks = t.column("block").to_numpy()
            for a, b, split, _, s, place in _block_windows(_texts(t), window, seed):
                block = np.repeat(blocks[a:b], [len(w) for w in split])[place]
                order = np.lexsort((s, block))
                s, block = s[order], block[order]
                new = np.concatenate([[True], (s[1:] != s[:-1]) | (block[1:] != block[:-1])]) if len(s) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(block[new], pa.int32()), pa.array(s[new].astype(np.int64))], names=["block", "key"])

    return f


def _firsts(hashes: list[np.ndarray], owners: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and the smallest owner of each."""
    h, o = np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int64), *owners])
    order = np.argsort(h, kind="stable")
    h, o = h[order], o[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    return h[at], np.minimum.reduceat(o, at) if len(h) else o


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of values in the sorted array, -1 for others."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _extended(window: int, seed: int):
    def f(t: pa.Table, shared: pa.Table) -> pa.Table:
        known, ids = np.sort(shared.column("key").to_numpy().astype(np.uint64)), _ids(t)
        hashes, owners = [], []
        for a, b, split, h, s, place in _block_windows(_texts(t), window, seed) if len(t) and len(known) else ():
            owner = np.repeat(ids[a:b], [len(w) for w in split])[place]
            keep = _in(s, known) >= 0
            h, o = _firsts([h[keep]], [owner[keep]])
            hashes.append(h), owners.append(o)
        h, low = _firsts(hashes, owners)
        block = t.column("block")[0].as_py() if len(t) else 0
        return pa.table({"block": np.full(len(h), block, np.int32), "hash": h.astype(np.int64), "low": low})

    return f


def _cut(window: int, seed: int):
    def f(t: pa.Table, lower: pa.Table) -> pa.Table:
        ids, texts = _ids(t), _texts(t)
        hashes, owners = [], []
        for a, b, split, h, _, place in _block_windows(texts, window, seed):
            h, o = _firsts([h], [np.repeat(ids[a:b], [len(w) for w in split])[place]])
            hashes.append(h), owners.append(o)
        known, low = _firsts([*hashes, lower.column("hash").to_numpy().astype(np.uint64)], [*owners, lower.column("low").to_numpy()])
        del hashes, owners
        n_words, n_removed, spans, kept = [], [], [], []
        for a, b, split, h, _, place in _block_windows(texts, window, seed):
            lengths = np.array([len(w) for w in split], np.int64)
            n_words.append(lengths)
            owner = np.repeat(ids[a:b], lengths)
            gone = covered(place[low[_in(h, known)] < owner[place]], window, len(owner)) if len(h) else np.zeros(len(owner), bool)
            ends = np.cumsum(lengths)
            for w, z in zip(split, ends, strict=True):
                own = gone[z - len(w) : z]
                n_removed.append(int(own.sum()))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                spans.append([{"i": int(i), "e": int(e)} for i, e in edge.reshape(-1, 2)])
                kept.append((b" ".join(x for x, g in zip(w, own, strict=True) if not g) if n_removed[-1] else b" ".join(w)).decode("utf-8", "surrogatepass"))
        return pa.table({"doc_id": t.column("doc_id"), "n_words": np.concatenate(n_words), "n_removed": np.array(n_removed, np.int64), "spans": pa.array(spans, pa.list_(pa.struct([("i", pa.int32()), ("e", pa.int32())]))), "kept_text": pa.array(kept, pa.string())})

    return f


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, spans (cut word runs [i, e)) and kept_text (kept words, one space between)."""
    docs, names = numbered(docs)
    docs = with_blocks(docs, block_bytes)
    seeds = docs.select("text", "block").mapInArrow(_seeds(window, seed), "block int, key long")
    shared = settled(shared_by_blocks(seeds, "key")).withColumnRenamed("block", "__block")
    listed = docs.groupBy("block").cogroup(shared.groupBy("__block")).applyInArrow(_extended(window, seed), "block int, hash long, low long")
    least = listed.withColumn("least", F.min("low").over(Window.partitionBy("hash"))).where("least < low")
    lower = settled(least.select(F.col("block").alias("__block"), "hash", F.col("least").alias("low")))
    kind = "doc_id long, n_words long, n_removed long, spans array<struct<i:int,e:int>>, kept_text string"
    return named(docs.groupBy("block").cogroup(lower.groupBy("__block")).applyInArrow(_cut(window, seed), kind), names)


def op7_seed_and_extend_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op7_seed_and_extend_repeats": op7_seed_and_extend_repeats}

ORACLES = {
    "op7_seed_and_extend_repeats": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT rid, doc_id, i, list_slice(w, i, i + {WINDOW - 1}) AS win
  FROM (SELECT *, unnest(range(1, (len(w) - {WINDOW - 2})::BIGINT)) AS i FROM d WHERE len(w) >= {WINDOW})),
first AS (SELECT win, min(doc_id) AS low FROM starts GROUP BY win),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + {WINDOW})) AS p FROM starts JOIN first USING (win) WHERE coalesce(low < doc_id, low IS NOT NULL)),
lost AS (SELECT rid, count(*) AS n, list(p) AS ps FROM gone GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i : NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lost USING (rid)"""
}
