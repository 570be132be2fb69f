"""LM scoring by prediction by partial matching (PPM) over bytes, beside a unigram base.

The model is a trie of byte contexts up to ORDER, learned from the training
documents: each node (the last k bytes) has its count, the sum and number of its
successors, and the mass that exclusion takes from the next shorter context. A
text's code length goes from the longest seen context down: method-D escapes,
and symbols that a longer context has ruled out leave the shorter one's total.
Below order 0 all unseen bytes are alike. Byte 255, which UTF-8 never has, pads
the start and ends the text, so the probabilities of all texts sum to 1.

The trie isn't broadcast: it grows with the corpus. Documents are dealt into
blocks of about BLOCK_BYTES; a block lists its distinct longest nodes and words
with their training counts; shorter nodes are sums of these. Each distinct
longest node's log probability is worked out once, by joins with the trie, and
each block gets back those that it holds (a cogroup of documents and values). A
node that occurs everywhere comes once per block, not once per occurrence.
Words are keyed by 63-bit hashes; a block is told a word's count only if other
blocks add to its own.

Defined results: a null text is empty and has the end token alone; ids that are
null are held out (the remainder of an empty text is 0); repeated rows are
learned and scored one by one; an empty table gives an empty result; other
columns are ignored. Texts are scored whole, in lower-case A-Z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shorewise.llm.common import id_remainder, settled, table

ORDER, BLOCK_BYTES, CHUNK_BYTES, SYMBOLS = 5, 20_000_000, 2_000_000, 256
END_WORD = b" "  # no word has a space
_BYTE_8 = np.int64(-(2**63))


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_BYTES each; a longer text is alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _top_grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The order+1 last bytes at each byte of each text and its end, as integers; and where each text begins."""
    pad = b"\xff" * order
    buf = np.frombuffer(b"".join(pad + t + b"\xff" for t in texts), dtype=np.uint8)
    grams = np.zeros(len(buf) - order, dtype=np.uint64)
    for j in range(order + 1):
        grams <<= np.uint64(8)
        grams |= buf[j : len(buf) - order + j]
    size = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(size + order) - order  # in grams, after each text's own
    keep = np.ones(len(grams), dtype=bool)
    for j in range(order):
        keep[ends[:-1] + j] = False
    return grams[keep], np.concatenate([[0], np.cumsum(size)[:-1]])


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.argsort(keys, kind="stable")
    keys, n = keys[at], n[at]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=int)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def _encoded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = pa.array(values).dictionary_encode()
    return d.dictionary.to_numpy(), d.indices.to_numpy()


def _lowered(table_: pa.Table) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in table_.column("text").to_pylist()]


def block_nodes(texts: list[bytes], learn: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct longest trie nodes of the texts, with their counts in texts to learn from."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in _chunks(texts):
        grams, starts = _top_grams(texts[a:b], order)
        weight = np.repeat(learn[a:b].astype(np.float64), np.diff(np.append(starts, len(grams))))
        uniq, at = _encoded(grams)
        keys.append(uniq)
        counts.append(np.bincount(at, weights=weight, minlength=len(uniq)).astype(np.int64))
    return _summed(np.concatenate(keys), np.concatenate(counts))


def block_words(texts: list[bytes], learn: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, their keys (negative hashes) and their counts in texts to learn from; END_WORD is one of them."""
    words, seen = [pa.array([END_WORD], pa.binary())], [np.array([float(learn.sum())])]
    for a, b in _chunks(texts):
        split = [x.split() for x in texts[a:b]]
        d = pa.array([w for x in split for w in x], pa.binary()).dictionary_encode()
        weight = np.repeat(learn[a:b].astype(np.float64), [len(x) for x in split])
        words.append(d.dictionary)
        seen.append(np.bincount(d.indices.to_numpy(), weights=weight, minlength=len(d.dictionary)))
    d = pa.concat_arrays(words).dictionary_encode()
    n = np.bincount(d.indices.to_numpy(), weights=np.concatenate(seen), minlength=len(d.dictionary)).astype(np.int64)
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, d.dictionary.to_pylist()), np.uint64, len(d.dictionary)).astype(np.int64) | _BYTE_8
    return d.dictionary, keys, n


def log_probabilities(c: list[np.ndarray], n: list[np.ndarray], d: list[np.ndarray], e: list[np.ndarray]) -> np.ndarray:
    """log10 of symbols, by order from 0: c is the symbol's count, n, d and e the context's total, number of successors and the mass that they take from the next shorter context."""
    size = len(c[0])
    value, open_ = np.zeros(size), np.ones(size, dtype=bool)
    mass, kinds = np.zeros(size), np.zeros(size)
    for k in range(len(c) - 1, -1, -1):
        seen = open_ & (n[k] > 0)
        left, other = n[k] - mass, d[k] - kinds
        hit, alive = seen & (c[k] > 0), seen & (left > 0)
        safe = np.where(left > 0, 2 * left, 1)
        value += np.where(hit & alive, np.log10(np.maximum(2 * c[k] - 1, 1) / safe), 0)
        value += np.where(alive & ~hit, np.log10(np.maximum(other, 1) / safe), 0)
        open_ &= ~hit
        mass, kinds = np.where(seen & ~hit, e[k], mass), np.where(seen & ~hit, d[k], kinds)
    return value - np.where(open_, np.log10(np.maximum(SYMBOLS - kinds, 1)), 0)


def _lowered(table_: pa.Table) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in table_.column("text").to_pylist()]


def _learned(t: pa.Table) -> np.ndarray:
    return ~t.column("held_out").to_numpy().astype(bool)


def _listed(order: int):
    def f(t: pa.Table) -> pa.Table:
        texts = _lowered(t)
        node, n = block_nodes(texts, _learned(t), order)
        _, words, seen = block_words(texts, _learned(t))
        key = np.concatenate([node.astype(np.int64), words])
        return pa.table({"block": np.full(len(key), t.column("block")[0].as_py(), np.int32), "key": key, "n": np.concatenate([n, seen])})

    return f


def _valued(order: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda name: [b.column(f"{name}{k}").to_numpy(zero_copy_only=False).astype(np.float64) for k in range(order + 1)]
            value = log_probabilities(col("c"), col("n"), col("d"), col("e"))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(value)], names=["key", "value"])

    return f


def _scored(order: int, tokens: int, kinds: int):
    def f(t: pa.Table, lexicon: pa.Table) -> pa.Table:
        key, given = lexicon.column("key").to_numpy(), lexicon.column("value").to_numpy()
        texts = _lowered(t)
        names, words, own = block_words(texts, _learned(t))
        place = {w: i for i, w in enumerate(names.to_pylist())}
        at = np.flatnonzero(key < 0)
        at = at[np.argsort(key[at])]
        spot = np.minimum(np.searchsorted(key[at], words), max(len(at) - 1, 0))
        c = np.where(key[at][spot] == words, given[at][spot], own) if len(at) else own.astype(np.float64)
        rate = np.log10((c + 0.1) / (tokens + 0.1 * (kinds + 1)))
        end = place[END_WORD]
        at = np.flatnonzero(key >= 0)
        at = at[np.argsort(key[at])]
        top, value = key[at].astype(np.uint64), given[at]

        score, base = np.zeros(len(texts)), np.zeros(len(texts))
        n_tokens, n_known = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for a, b in _chunks(texts):
            grams, starts = _top_grams(texts[a:b], order)
            uniq, idx = _encoded(grams)
            score[a:b] = np.add.reduceat(value[np.searchsorted(top, uniq)][idx], starts)
            for i in range(a, b):
                w = np.fromiter(map(place.__getitem__, texts[i].split()), np.int64)
                n_tokens[i], n_known[i] = len(w) + 1, (c[w] > 0).sum() + (c[end] > 0)
                base[i] = rate[w].sum() + rate[end]
        return pa.table({"doc_id": t.column("doc_id"), "held_out": t.column("held_out"), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": np.full(len(texts), tokens, np.int64), "base_score": base, "score": score})

    return f


def _node(bits: Column, length: int) -> Column:
    """The last `length` bytes, with the length above them."""
    return bits.bitwiseAND(F.lit((1 << (8 * length)) - 1)).bitwiseOR(F.lit(length << 56))


def _node_values(grams: DataFrame, order: int) -> DataFrame:
    """(key, value): log10 of the last byte of each of (key, n) after the bytes before it."""
    key = F.col("key")
    lengths = F.explode(F.array(*[_node(key, k) for k in range(order + 2)]))
    nodes = grams.where("n > 0").select(lengths.alias("node"), "n").groupBy("node").agg(F.sum("n").alias("n"))
    bits, length = F.col("node").bitwiseAND(F.lit((1 << 56) - 1)), F.shiftright("node", 56)
    parent = F.shiftright(bits, 8).bitwiseOR(F.shiftleft(length - 1, 56))
    shorter = bits.bitwiseAND(F.expr("shiftleft(1L, cast(8 * (shiftright(node, 56) - 1) AS int)) - 1")).bitwiseOR(F.shiftleft(length - 1, 56))
    child = nodes.where(length > 0).select(parent.alias("node"), F.when(length > 1, shorter).alias("shorter"), "n")
    low = nodes.select(F.col("node").alias("shorter"), F.col("n").alias("low"))
    within = child.join(low, "shorter", "left").groupBy("node").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.coalesce(F.sum("low"), F.lit(0)).alias("excluded"))

    context = lambda k: _node(F.shiftright(key, 8), k)
    seen = grams.where("n > 0").withColumn("node", context(order)).join(within, "node").select("key", F.log10((2 * F.col("n") - 1) / (2 * F.col("total"))).alias("value"))
    asked = [F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), node.alias("node")) for k in range(order + 1) for kind, node in (("c", context(k)), ("s", _node(key, k + 1)))]
    rows = grams.where("n = 0").select("key", F.explode(F.array(*asked)).alias("ask")).select("key", "ask.*")
    known = nodes.join(within, "node", "full")
    found = rows.join(known, "node", "left")
    of = lambda k, kind, name: F.coalesce(F.max(F.when((F.col("k") == k) & (F.col("kind") == kind), F.col(name))), F.lit(0))
    parts = [of(k, kind, name).alias(f"{short}{k}") for k in range(order + 1) for kind, name, short in (("s", "n", "c"), ("c", "total", "n"), ("c", "kinds", "d"), ("c", "excluded", "e"))]
    return seen.union(found.groupBy("key").agg(*parts).mapInArrow(_valued(order), "key long, value double"))


def score_documents(docs: DataFrame, held_out: Column, *, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; learns where held_out is false."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(-(-size // block_bytes) or 1)).cast("int"))
    # one exchange by key adds up the counts of all blocks; distinct keys and each block's part are both read from what it leaves
    listed = docs.groupBy("block").applyInArrow(_listed(order), "block int, key long, n long")
    listed = settled(listed.withColumn("total", F.sum("n").over(Window.partitionBy("key"))))
    words, grams = listed.where("key < 0"), listed.where("key >= 0")
    known = words.groupBy("key").agg(F.max("total").alias("n"))
    tokens, kinds = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    values = _node_values(settled(grams.groupBy("key").agg(F.max("total").alias("n"))), order)
    lexicon = grams.select("block", "key").join(values, "key").select("block", "key", "value")
    lexicon = lexicon.union(words.where("total <> n").select("block", "key", F.col("total").cast("double"))).withColumnRenamed("block", "__block")
    kind = "doc_id {}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double".format(docs.schema["doc_id"].dataType.simpleString())
    return docs.groupBy("block").cogroup(lexicon.groupBy("__block")).applyInArrow(_scored(order, tokens, kinds), kind)


def op10_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 10) == 0)


QUERIES = {"op10_ppm_scores": op10_ppm_scores}
