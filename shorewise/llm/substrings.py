"""Suffix-array dedup of byte strings: external induced sorting of sampled suffixes.

A byte goes if a 400-byte string that covers it starts anywhere else too. Sorting
all suffixes of a corpus isn't needed for that, only of those that may repeat:

1. Sampling. Winnowing picks one ANCHOR-byte gram for every 400-byte window, the
   same one in all copies of the window, so windows meet only at equal anchors
   and equal offsets. The windows of one anchor occurrence are consecutive; the
   text that they cover is its span. Blocks of documents list (anchor, span)
   hashes with their counts. An anchor seen once ends here; a span seen twice
   repeats whole.
2. Recursion. Anchors are the names of the reduced string. Where more than GROUP
   different spans bear one name, the name is too short to sort by: each span goes
   on under longer names, its anchor with half of the window's other bytes to the
   right or to the left (every window has one of the two), and again, until names
   have few spans or are whole windows.
3. External sort. Spark's sort, in sorted runs on disk that are merged by a queue,
   deals the suffix tuples (name, bytes from the anchor on) of the spans.
4. Induction. A task reads the sorted suffixes as a stream, a name at a time, with
   the common-prefix values of neighbours. The order of the suffixes one byte to
   the left follows by a stable sort on that byte, and their common prefixes from
   range minima of the former ones, and so on to the left. A suffix with a
   neighbour of common prefix 400 is a repeated window.
5. Each block gets its repeated spans and windows back and cuts them.

No shard is held in memory and no group is larger than GROUP spans of at most 700
bytes. The same passes also find the windows of `report` bytes; they are counted
and not cut: passages of over 50 words that are below 400 bytes show there.

Defined results: null text is empty; strings are compared within and across
documents, also of repeated rows; texts below 400 bytes keep all; an empty table
gives an empty result; ids don't matter and other columns aren't read. Anchors,
names and equal spans are told apart by 64-bit hashes, different spans by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shorewise.llm.common import settled, table, with_blocks
from shorewise.llm.shingles import mixed
from shorewise.llm.winnow import anchors, anchors_of, covered, inside

LENGTH, ANCHOR, SEGMENT, GROUP, BATCH, BLOCK_BYTES = 400, 100, 2_000_000, 1000, 20_000, 16_000_000
#: 51 words of four letters, with a blank each.
REPORT = 255
_CODE = np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers; a process keeps as many as the longest segment needed."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(n, base % 2**64, np.uint64)
        out[:1] = 1
        _POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[base][:n]


class Hashed:
    """Hash of any substring of a buffer: prefix sums of a polynomial modulo 2**64."""

    def __init__(self, buf: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[buf] * _powers(_BASE, len(buf)), dtype=np.uint64)])
        self.inverse = _powers(pow(_BASE, -1, 2**64), len(buf) + 1)

    def runs(self, length: int) -> np.ndarray:
        n = max(0, len(self.sums) - length)
        return mixed((self.sums[length:] - self.sums[:n]) * self.inverse[:n])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def _bytes(t: pa.Table) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in t.column("text").to_pylist()]


def segments(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Groups of pieces of about SEGMENT bytes: texts, offsets, lengths, joined bytes. A long text's pieces overlap so that each window is in one."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), SEGMENT):
            piece = t[a : a + SEGMENT + length - 1]
            if size and size + len(piece) > SEGMENT:
                yield _joined(held)
                held, size = [], 0
            held.append((i, a, piece))
            size += len(piece)
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, int, bytes]]):
    return [h[0] for h in held], [h[1] for h in held], np.array([len(h[2]) for h in held], np.int64), np.frombuffer(b"".join(h[2] for h in held), np.uint8)


_NONE = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3


def occurrences(lengths: np.ndarray, hashed: Hashed, grams: np.ndarray, length: int, anchor: int, pick: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Anchor occurrences: key, span hash, anchor's place, first and last window start. `pick` is the windows' anchors, if they are known."""
    n = len(hashed.sums) - 1
    pick = anchors(grams, length - anchor + 1) if pick is None else pick
    start = np.flatnonzero(inside(lengths, length, n)[: min(len(pick), SEGMENT)])  # later ones are the next piece's
    if not len(start):
        return _NONE
    at = pick[start]
    cut = np.flatnonzero((at[1:] != at[:-1]) | (np.diff(start) != 1)) + 1
    first, last = start[np.concatenate([[0], cut])], start[np.concatenate([cut - 1, [len(start) - 1]])]
    at = at[np.concatenate([[0], cut])]
    key = mixed(grams[at] ^ np.uint64(length))
    shape = (at - first).astype(np.uint64) * np.uint64(1024) + (last - first).astype(np.uint64)
    return key, mixed(mixed(hashed.between(first, last + length) + shape) ^ key), at, first, last


def _by_size(texts: list[bytes], sizes: list[int], anchor: int):
    """By segment and window size: the segment, the size and its anchor occurrences."""
    for segment in segments(texts, max(sizes)):
        lengths, buf = segment[2:]
        hashed = Hashed(buf)
        grams = hashed.runs(anchor)
        for size, pick in zip(sizes, anchors_of(grams, [size - anchor + 1 for size in sizes]), strict=True):
            yield segment, size, occurrences(lengths, hashed, grams, size, anchor, pick)


def _listed(sizes: list[int], anchor: int):
    def f(t: pa.Table) -> pa.Table:
        parts = {size: ([], []) for size in sizes}
        for _, size, (key, span, *_) in _by_size(_bytes(t), sizes, anchor):
            parts[size][0].append(key), parts[size][1].append(span)
        out = []
        for size, (keys, spans) in parts.items():
            span, first, n = np.unique(np.concatenate([*spans, _NONE[0]]), return_index=True, return_counts=True)
            key = np.concatenate([*keys, _NONE[0]])[first]
            block = np.full(len(key), t.column("block")[0].as_py(), np.int32)
            out.append(pa.table({"block": block, "size": np.full(len(key), size, np.int32), "key": key.astype(np.int64), "span": span.astype(np.int64), "n": n.astype(np.int64)}))
        return pa.concat_tables(out)

    return f


#: A span, or a part of it, under its name: `at` windows of the span come before it, and [low, high) of the text is what the name stands for.
_CONTEXT = "block int, size int, key long, span long, alone boolean, at int, low int, high int, text binary"


def _contexts(sizes: list[int], anchor: int):
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    names = [c.split()[0] for c in _CONTEXT.split(", ")]

    def f(t: pa.Table, asked: pa.Table) -> pa.Table:
        rows: list[list] = [[] for _ in names]
        want = dict(zip(asked.column("span").to_pylist(), asked.column("alone").to_pylist(), strict=True))
        sought = np.sort(np.fromiter(want, np.int64, len(want)))
        for (_, _, _, buf), size, (key, span, at, first, last) in _by_size(_bytes(t), sizes, anchor) if len(want) and len(t) else ():
            for i in np.flatnonzero(np.isin(span.astype(np.int64), sought)):
                name = int(span[i].astype(np.int64))
                if (alone := want.pop(name, None)) is not None:
                    low = int(at[i] - first[i])
                    row = (t.column("block")[0].as_py(), size, int(key[i].astype(np.int64)), name, alone, 0, low, low + anchor, buf[first[i] : last[i] + size].tobytes())
                    for column, v in zip(rows, row, strict=True):
                        column.append(v)
        return pa.table({name: pa.array(column, kind) for name, column, kind in zip(names, rows, types, strict=True)})

    return f


def longer_names(rows: DataFrame) -> DataFrame:
    """rows (_CONTEXT) under names longer by half of the window's other bytes, to the right where a window has as many there, else to the left."""
    length, half = F.octet_length("text"), F.ceil((F.col("size") - F.col("high") + F.col("low")) / 2).cast("int")
    split = F.col("high") + half - F.col("size")  # windows that start from here have `half` bytes on the right
    last = F.least(length - F.col("size"), F.col("low"))
    piece = lambda a, b: F.substring("text", a + 1, b - a)
    own = ["block", "size", "span", "alone"]
    right_first = F.greatest(F.lit(0), split)
    right = rows.where(right_first <= last).select(
        *own, F.xxhash64("key", F.lit("right"), piece(F.col("high"), F.col("high") + half)).alias("key"), (F.col("at") + right_first).alias("at"),
        (F.col("low") - right_first).alias("low"), (F.col("high") + half - right_first).alias("high"), piece(right_first, last + F.col("size")).alias("text"),
    )
    left_last = F.least(last, split - 1)
    left = rows.where(left_last >= 0).select(
        *own, F.xxhash64("key", F.lit("left"), piece(F.col("low") - half, F.col("low"))).alias("key"), "at",
        (F.col("low") - half).alias("low"), "high", piece(F.lit(0), left_last + F.col("size")).alias("text"),
    )
    return right.unionByName(left)


def recursed(contexts: DataFrame, group: int) -> tuple[DataFrame, DataFrame]:
    """contexts under names of at most `group` different ones, and (block, size, span, starts) of those that were found equal to others on the way."""
    kept, equal = [], []
    while True:
        many = settled(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group).select("key"))
        if many.isEmpty():
            break
        kept.append(contexts.join(many, "key", "left_anti"))
        parts = longer_names(contexts.join(many, "key")).withColumn("same", F.xxhash64("text", "low"))
        parts = settled(parts)
        # equal texts under one name repeat whole; one of them stays for the others
        copies = parts.groupBy("key", "same").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("block", "span", "at")).alias("first"))
        parts = settled(parts.join(copies, ["key", "same"]))
        starts = F.sequence(F.col("at"), F.col("at") + F.octet_length("text") - F.col("size"))
        equal.append(parts.where("n > 1 AND alone").select("block", "size", "span", starts.alias("starts")))
        stays = parts.where(F.struct("block", "span", "at") == F.col("first")).withColumn("alone", F.col("alone") & (F.col("n") == 1))
        contexts = settled(stays.where(F.col("high") - F.col("low") < F.col("size")).select(*contexts.columns))
    out = contexts
    for k in kept:
        out = out.unionByName(k)
    found = contexts.sparkSession.createDataFrame([], "block int, size int, span long, starts array<int>")
    for e in equal:
        found = found.unionByName(e)
    return out, found


def _range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of values[first..last] for each pair, by sparse tables."""
    out, size, table_, level = np.empty(len(first), values.dtype), last - first + 1, values, 1
    while len(size) and level <= size.max():
        now = (size >= level) & (size < 2 * level)
        out[now] = np.minimum(table_[first[now]], table_[last[now] - level + 1])
        table_ = np.minimum(table_[:-level], table_[level:]) if len(table_) > level else table_[:0]
        level *= 2
    return out


def induced_repeats(keys: np.ndarray, before: np.ndarray, texts: list[bytes], length: np.ndarray) -> list[np.ndarray]:
    """For each text the offsets before its anchor at which a window begins that another text of the same key has too.

    Texts come in the order of key and bytes from the anchor on; length is that of the key's windows.
    """
    right = [t[b:] for t, b in zip(texts, before, strict=True)]
    n, wide, deep = len(keys), max(map(len, right)), int(before.max())
    order = np.arange(n)
    ahead, behind = np.zeros((n, wide), np.uint8), np.zeros((n, max(deep, 1)), np.uint8)
    for i, t in enumerate(texts):
        ahead[i, : len(right[i])] = np.frombuffer(right[i], np.uint8)
        behind[i, : before[i]] = np.frombuffer(t[: before[i]], np.uint8)[::-1]
    reach = np.fromiter(map(len, right), np.int64, n)
    common = np.zeros(n, np.int64)
    for a in range(1, n, 4096):
        x, y = order[a - 1 : min(a + 4095, n - 1)], order[a : min(a + 4096, n)]
        odd = ahead[x] != ahead[y]
        same = np.where(odd.any(axis=1), odd.argmax(axis=1), wide)
        common[a : a + len(x)] = np.where(keys[x] == keys[y], np.minimum(same, np.minimum(reach[x], reach[y])), 0)
    group = np.cumsum(np.concatenate([[0], keys[order][1:] != keys[order][:-1]]))
    hits: list[tuple[np.ndarray, int]] = []
    for back in range(deep + 1):
        if back:
            byte = behind[order, back - 1].astype(np.int64)
            sort_key = group * 256 + byte
            held = np.flatnonzero(before[order] >= back)
            moved = held[np.argsort(sort_key[held], kind="stable")]
            p, q = moved[:-1], moved[1:]
            same = sort_key[p] == sort_key[q]
            new = np.zeros(len(moved), np.int64)
            new[1:][same] = _range_minima(common, p[same] + 1, q[same]) + 1
            order, group, common = order[moved], group[moved], new
        if not len(order):
            break
        best = np.maximum(common, np.append(common[1:], 0))
        hits.append((order[best >= length[order]], back))
        # a pair's common prefix grows by one a step at most
        held = best + (deep - back) >= length[order]
        if not held.all():
            at = np.flatnonzero(held)
            new = np.zeros(len(at), np.int64)
            new[1:] = _range_minima(common, at[:-1] + 1, at[1:]) if len(at) > 1 else new[1:]
            order, group, common = order[at], group[at], new
    out: list[list[int]] = [[] for _ in range(n)]
    for rows, back in hits:
        for i in rows:
            out[i].append(back)
    return [np.array(o, np.int64) for o in out]


_STARTS = "block int, size int, span long, starts array<int>"


def _resolved(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(held)
    low, at = (t.column(c).to_numpy().astype(np.int64) for c in ("low", "at"))
    found = induced_repeats(t.column("key").to_numpy(), low, t.column("text").to_pylist(), t.column("size").to_numpy().astype(np.int64))
    alone = t.column("alone").to_pylist()
    keep = [i for i, o in enumerate(found) if len(o) and alone[i]]
    rows = [t.column(c).combine_chunks().take(pa.array(keep, pa.int64())) for c in ("block", "size", "span")]
    return pa.RecordBatch.from_arrays([*rows, pa.array([at[i] + low[i] - found[i] for i in keep], pa.list_(pa.int32()))], names=["block", "size", "span", "starts"])


def _by_whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_resolved of runs of whole keys, of about BATCH rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        key = b.column("key").to_numpy()
        # the last key of a batch may go on in the next
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if len(key) and key[0] != key[-1] else 0
        if held and len(key) and held[-1].column("key")[-1].as_py() != key[0] and sum(map(len, held)) >= BATCH:
            yield _resolved(held)
            held = []
        if cut and sum(map(len, held)) + cut >= BATCH:
            yield _resolved([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        elif len(key):
            held.append(b)
    if held:
        yield _resolved(held)


def _repeated(known: pa.Table, occurrence: tuple[np.ndarray, ...]) -> np.ndarray:
    """Starts of the windows that are known to repeat; known is sorted by span."""
    _, span, _, first, last = occurrence
    ids = known.column("span").to_numpy()
    i = np.minimum(np.searchsorted(ids, span.astype(np.int64)), len(ids) - 1)
    starts = [np.zeros(0, np.int64)]
    for k in np.flatnonzero(ids[i] == span.astype(np.int64)):
        own = known.column("starts")[int(i[k])].as_py()
        starts.append(np.arange(first[k], last[k] + 1) if own is None else first[k] + np.array(own, np.int64))
    return np.concatenate(starts)


def _cut(length: int, report: int, anchor: int):
    def f(t: pa.Table, known: pa.Table) -> pa.Table:
        texts, known = _bytes(t), known.sort_by("span").combine_chunks()
        marks = {size: [None] * len(texts) for size in (length, report)}
        for (who, where, lengths, buf), size, found in _by_size(texts, sorted(marks), anchor) if len(known) else ():
            starts = _repeated(known, found)
            if not len(starts):
                continue
            hit, end, gone = covered(starts, size, len(buf)), np.cumsum(lengths), marks[size]
            for d, offset, n, e in zip(who, where, lengths, end, strict=True):
                own = hit[e - n : e]
                if own.any():
                    gone[d] = np.zeros(len(texts[d]), bool) if gone[d] is None else gone[d]
                    gone[d][offset : offset + n] |= own
        n_removed, spans, kept = [], [], []
        for text, g in zip(texts, marks[length], strict=True):
            if g is None:
                n_removed.append(0), spans.append([]), kept.append(text)
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
            n_removed.append(int(g.sum())), spans.append([{"i": int(a), "e": int(b)} for a, b in edge.reshape(-1, 2)])
            kept.append(np.frombuffer(text, np.uint8)[~g].tobytes())
        count = np.array([0 if g is None else int(g.sum()) for g in marks[report]], np.int64)
        runs = pa.array(spans, pa.list_(pa.struct([("i", pa.int64()), ("e", pa.int64())])))
        return pa.table({"doc_id": t.column("doc_id"), "n_bytes": np.array([len(x) for x in texts], np.int64), "n_removed": np.array(n_removed, np.int64), "spans": runs, "kept": pa.array(kept, pa.binary()), "n_repeated": count})

    return f


def remove_substrings(docs: DataFrame, *, length: int = LENGTH, report: int = REPORT, anchor: int = ANCHOR, block_bytes: int = BLOCK_BYTES, group: int = GROUP) -> DataFrame:
    """Per document row: doc_id, n_bytes, n_removed, spans (removed byte runs [i, e)), kept (remaining bytes) and n_repeated (bytes, removed or not, that a string of `report` bytes covers which starts anywhere else)."""
    sizes, docs = sorted({length, report}), with_blocks(docs, block_bytes)
    listed = docs.groupBy("block").applyInArrow(_listed(sizes, anchor), "block int, size int, key long, span long, n long").repartition("key")
    of_span, of_key = Window.partitionBy("key", "span"), Window.partitionBy("key")
    marked = listed.select("*", F.sum("n").over(of_span).alias("n_span"), F.min("block").over(of_span).alias("first"))
    marked = marked.select("*", F.sum("n").over(of_key).alias("n_key"), F.sum((F.col("block") == F.col("first")).cast("long")).over(of_key).alias("spans"))
    marked = settled(marked.where("n_key > 1").select("block", "size", "span", "n_span", "spans", (F.col("block") == F.col("first")).alias("sends")))

    asked = marked.where("spans > 1 AND sends").select(F.col("block").alias("__block"), "span", (F.col("n_span") == 1).alias("alone"))
    contexts = settled(docs.groupBy("block").cogroup(asked.groupBy("__block")).applyInArrow(_contexts(sizes, anchor), _CONTEXT))
    contexts, equal = recursed(contexts, group)
    right = F.substring("text", F.col("low") + 1, F.octet_length("text"))
    found = contexts.repartition("key").sortWithinPartitions("key", right).mapInArrow(_by_whole_keys, _STARTS)
    found = found.union(equal).groupBy("block", "size", "span").agg(F.flatten(F.collect_list("starts")).alias("starts"))

    whole = marked.where("n_span > 1").select("block", "size", "span", F.lit(None).cast("array<int>").alias("starts"))
    known = whole.union(found).withColumnRenamed("block", "__block")
    result = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, spans array<struct<i:long,e:long>>, kept binary, n_repeated long"
    return docs.groupBy("block").cogroup(known.groupBy("__block")).applyInArrow(_cut(length, report, anchor), result)


def op5_suffix_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")


QUERIES = {"op5_suffix_substring_dedup": op5_suffix_substring_dedup}
