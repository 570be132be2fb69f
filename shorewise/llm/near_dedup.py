"""MinHash near-duplicate groups, candidates verified by odd sketches and then on full shingle sets.

1. One pass gives each text its set's hash, band hashes of ROWS MinHash values
   each, and an odd sketch: every MinHash value flips one of SKETCH_BITS
   parity bits, so the population count of two sketches' XOR tells how many
   values differ. Texts with equal sets are one class from here on.
2. Classes that share a band are joined in a star around the band's smallest
   class; what the stars connect is a family. Links at the threshold
   share a band but for a chance below MISSED: 32 bands at 0.85, 47 at 0.8.
3. Each class is compared on full sets with the one of its centers whose sketch
   is nearest. Centers of many classes are dealt to several tasks. A class's text
   moves once here, and most families are then one part.
4. Families of several parts are cut into tiles of TILE classes, and tile pairs
   meet in a task, at first with sketches only: pairs of different parts whose
   XOR has too many bits for the threshold (six standard deviations) drop out.
   Texts follow to the members of the other pairs, which full sets confirm, and a
   tile pair emits a spanning forest of its links. No family is ever whole in one
   task and no pairs of a family are emitted.
5. Components of all links, by contraction in the shared folder.

Defined results: null or wordless text has n_shingles 0 and is its own component;
rows with the same id and text are one member and each comes back; a null id
never names a component unless all its ids are null; an empty table gives an
empty result; other columns are ignored by `near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, log, log1p, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shorewise.llm.common import carried, settled, table
from shorewise.llm.components import components
from shorewise.llm.shingles import chunks, mixed, shingle_sets

WORDS, ROWS, SKETCH_BITS, TILE, DEAL_ROWS, BROADCAST_CLASSES, MISSED = 5, 5, 1024, 250, 1000, 200_000, 1e-8
PERCENT = 85
_SIG = "n_shingles long, node long, bands array<long>, sketch array<long>"


def bands_of(percent: int) -> int:
    """Bands of which two sets at the threshold share none with a chance below MISSED."""
    return 1 if percent >= 100 else ceil(log(MISSED) / log1p(-((percent / 100) ** ROWS)))


def _permutations(samples: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 2**32, samples, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, samples, dtype=np.uint32)


def max_odd_bits(percent: int = PERCENT) -> int:
    """XOR bits that sketches of two sets at the threshold exceed with a chance below 1e-8."""
    p, samples = 1 - percent / 100, bands_of(percent) * ROWS
    differ = samples * p + 6 * sqrt(samples * p * (1 - p))
    mean = SKETCH_BITS / 2 * (1 - exp(-4 * differ / SKETCH_BITS))
    return int(mean + 3 * sqrt(mean))


def minhashes(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """One row of MinHash values per set (not empty)."""
    a, b = _permutations(bands_of(percent) * ROWS)
    out = np.empty((len(sets), len(a)), np.uint32)
    for i, s in enumerate(sets):
        x = (s >> np.uint64(32)).astype(np.uint32)
        low = None
        for at in range(0, len(x), 4096):
            part = (x[at : at + 4096, None] * a + b).min(axis=0)
            low = part if low is None else np.minimum(low, part)
        out[i] = low
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps, packed, of rows of MinHash values."""
    place = mixed(samples.astype(np.uint64) | (np.arange(samples.shape[1], dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    flat = place.astype(np.int64) + np.arange(len(samples))[:, None] * SKETCH_BITS
    bits = np.bincount(flat.ravel(), minlength=len(samples) * SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8).reshape(len(samples), SKETCH_BITS), axis=1)


def _split(texts: list[str | None]) -> list[list[bytes]]:
    return [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]


def _signed(percent: int):
    n_bands = bands_of(percent)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()):
                sets = shingle_sets(_split(batch.column("text").slice(a, b - a).to_pylist()), WORDS)
                full = [i for i, s in enumerate(sets) if len(s)]
                samples = minhashes([sets[i] for i in full], percent)
                bands = samples.reshape(len(full), n_bands, ROWS).astype(np.uint64)
                key = np.arange(n_bands, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
                for r in range(ROWS):
                    key = mixed(key + bands[:, :, r])
                at = {i: k for k, i in enumerate(full)}
                sketch = odd_sketches(samples)
                node = [int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else None for s in sets]
                columns = [
                    batch.column(name).slice(a, b - a) for name in ("doc_id", "text_hash")
                ] + [
                    pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()),
                    pa.array([key[at[i]].astype(np.int64) if i in at else None for i in range(len(sets))], pa.list_(pa.int64())),
                    pa.array([sketch[at[i]].view(np.int64) if i in at else None for i in range(len(sets))], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "node", "bands", "sketch"])

    return f


def _forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """For each of n places its component's smallest place."""
    root = np.arange(n)
    while len(pairs):
        low = root.copy()
        np.minimum.at(low, pairs[:, 0], root[pairs[:, 1]])
        np.minimum.at(low, pairs[:, 1], root[pairs[:, 0]])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return root


def _candidates(sketches: np.ndarray, parts: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Pairs (left place, right place) of different parts whose sketches differ in at most `most` bits."""
    out = []
    for a in range(0, len(left), 64):
        rows = left[a : a + 64]
        odd = np.bitwise_count(sketches[rows][:, None, :] ^ sketches[right][None, :, :]).sum(axis=2)
        i, j = np.nonzero((odd <= most) & (parts[rows][:, None] != parts[right][None, :]))
        out.append(np.column_stack([rows[i], right[j]]))
    return np.concatenate(out) if out else np.zeros((0, 2), int)


def _confirmed(pairs: np.ndarray, sets: dict[int, np.ndarray], percent: int) -> np.ndarray:
    """Pairs that are similar on full sets. Rows of an incidence matrix over the shingles that at least two sets have."""
    if not len(pairs):
        return pairs
    used = np.unique(pairs)
    size = {i: len(sets[i]) for i in used}
    keep = []
    if len(pairs) <= 4 * len(used):
        for i, j in pairs:
            small, large = sorted((sets[i], sets[j]), key=len)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            keep.append(int((large[at] == small).sum()))
        common = np.array(keep)
    else:
        every = np.concatenate([sets[i] for i in used])
        who = np.repeat(np.arange(len(used)), [size[i] for i in used])
        names, at, n = np.unique(every, return_inverse=True, return_counts=True)
        place = np.cumsum(n > 1) - 1
        common = np.zeros((len(used), len(used)), np.float32)
        shared = n[at] > 1
        who, col = who[shared], place[at[shared]]
        for c in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
            inside = (col >= c) & (col < c + 4096)
            m = np.zeros((len(used), 4096), np.float32)
            m[who[inside], col[inside] - c] = 1
            common += m @ m.T
        spot = np.searchsorted(used, pairs)
        common = common[spot[:, 0], spot[:, 1]].astype(np.int64)
    total = np.array([size[i] + size[j] for i, j in pairs])
    return pairs[100 * common >= percent * (total - common)]


def _sets_of(t: pa.Table, rows: np.ndarray) -> dict[int, np.ndarray]:
    """The shingle sets of some rows' texts, by row."""
    return dict(zip(rows.tolist(), shingle_sets(_split(t.column("text").take(pa.array(rows)).to_pylist()), WORDS), strict=True))


def _links(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    cat = lambda k: np.concatenate([x[k] for x in pairs]) if pairs else np.zeros(0, np.int64)
    return pa.table({"a": cat(0), "b": cat(1)})


def _star_links(percent: int):
    """Of rows (center, node, text), links of a center with the members that are similar on full sets."""

    def f(t: pa.Table) -> pa.Table:
        t = t.sort_by([("center", "ascending"), ("node", "ascending")])
        center, node = t.column("center").to_numpy(), t.column("node").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(center[1:] != center[:-1]) + 1, [len(center)]])
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = a + np.flatnonzero(np.concatenate([[True], node[a + 1 : b] != node[a : b - 1]]))  # rows with the same id and text
            own = at[node[at] == center[a]]
            if len(own):
                pairs = _confirmed(np.column_stack([np.repeat(own, len(at) - 1), at[at != own[0]]]), _sets_of(t, at), percent)
                out.append((node[pairs[:, 0]], node[pairs[:, 1]]))
        return _links(out)

    return f


def _tiles(t: pa.Table, most: int):
    """By tile pair of the table's rows: the table in order, the pair's first and last row, its candidate pairs."""
    t = t.sort_by([("family", "ascending"), ("ta", "ascending"), ("tb", "ascending"), ("node", "ascending")])
    key = np.column_stack([t.column(c).to_numpy() for c in ("family", "ta", "tb")])
    node, own, part = (t.column(c).to_numpy() for c in ("node", "tile", "part"))
    sketch = t.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH_BITS // 64)
    cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at = a + np.flatnonzero(np.concatenate([[True], node[a + 1 : b] != node[a : b - 1]]))  # rows with the same id and text
        ta, tb = key[a, 1], key[a, 2]
        pairs = _candidates(sketch, part, at[own[at] == ta], at[own[at] == tb], most)
        yield t, a, b, pairs[pairs[:, 0] < pairs[:, 1]] if ta == tb else pairs


def _tile_members(percent: int):
    """The rows of tile pairs that are in any candidate pair, without their sketches' work done again for others."""
    most = max_odd_bits(percent)

    def f(t: pa.Table) -> pa.Table:
        used, names = [np.zeros(0, np.int64)], ["family", "ta", "tb", "tile", "node", "part", "sketch"]
        whole = t
        for whole, _, _, pairs in _tiles(t, most):
            used.append(np.unique(pairs))
        return whole.select(names).take(pa.array(np.concatenate(used)))

    return f


def _tile_links(percent: int):
    most = max_odd_bits(percent)

    def f(t: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for whole, a, b, pairs in _tiles(t, most):
            node = whole.column("node").to_numpy()
            pairs = _confirmed(pairs, _sets_of(whole, np.unique(pairs)), percent)
            if len(pairs):
                root = _forest(pairs - a, b - a) + a
                linked = np.unique(pairs)
                out.append((node[linked], node[root[linked - a]]))
        return _links(out)

    return f


def _dealt(rows: DataFrame, count: int, *key: str) -> DataFrame:
    """rows with `deal`: a number for each key that gathers keys of about DEAL_ROWS of the count of rows."""
    return rows.withColumn("deal", F.pmod(F.xxhash64(*key), F.lit(max(1, count // DEAL_ROWS))))


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """Per document row: doc_id, text_hash, n_shingles, component_id and kept."""
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sig = settled(docs.mapInArrow(_signed(percent), f"doc_id {id_type}, text_hash long, {_SIG}"))
    # of the rows with the same set, the one with the smallest id stands for it
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = sig.where("n_shingles > 0").groupBy("node").agg(first.alias("first"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = settled(classes.select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), "bands", "sketch"))

    def with_texts(rows: DataFrame, count: int) -> DataFrame:
        """rows of classes with the text of each; few of them travel to the texts, so that only their texts move."""
        rows = F.broadcast(rows) if count <= BROADCAST_CLASSES else rows
        same = docs["doc_id"].eqNullSafe(rows["doc_id"]) & (docs["text_hash"] == rows["text_hash"])
        return docs.join(rows, same).drop("doc_id", "text_hash")

    # bands that several classes share, each a star around its smallest class; a class keeps its smallest center, and the others link centers
    bands = classes.select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "center")
    stars = settled(bands.join(shared, "band").groupBy("node").agg(F.array_sort(F.collect_set("center")).alias("centers")))
    own, others = F.get("centers", F.lit(0)), F.slice("centers", 2, 1000)
    edges = stars.select(own.alias("a"), F.col("node").alias("b")).union(stars.select(own.alias("a"), F.explode(others).alias("b")).distinct())
    family = components(edges)

    # first each class with the center that its sketch is nearest to, so that most families are settled by one comparison a class
    spokes = stars.select("node", F.explode("centers").alias("center")).where("node <> center")
    spokes = spokes.join(classes.select("node", "sketch"), "node").join(classes.select(F.col("node").alias("center"), F.col("sketch").alias("of_center")), "center")
    near = spokes.select("node", "center", _odd_bits(F.col("sketch"), F.col("of_center")).alias("odd")).where(F.col("odd") <= max_odd_bits(percent))
    best = settled(near.groupBy("node").agg(F.min_by("center", F.struct("odd", "center")).alias("center")))
    salts = best.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("salts"))
    members = best.join(salts, "center").select("node", "center", F.pmod(F.xxhash64("node"), "salts").alias("salt"))
    hubs = salts.select(F.col("center").alias("node"), "center", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    roles = members.union(hubs).groupBy("node").agg(F.collect_list(F.struct("center", "salt")).alias("roles"))
    n_best = best.count()
    compared = with_texts(classes.select("node", "doc_id", "text_hash").join(roles, "node"), 2 * n_best).select("node", "text", F.inline("roles"))
    links = settled(_dealt(compared, n_best, "center", "salt").groupBy("deal").applyInArrow(_star_links(percent), "a long, b long"))
    part = components(links).withColumnRenamed("label", "part")

    # then, in families that are still several parts, all members in tile pairs; only members of candidate pairs get their texts
    member = family.join(part, "node", "left").select("node", F.col("label").alias("family"), F.coalesce("part", "node").alias("part"))
    split = member.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    member = member.join(split.select("family", tiles.alias("tiles")), "family").join(classes.select("node", "sketch"), "node")
    member = member.withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    names = ["family", "ta", "tb", "tile", "node", "part", "sketch"]
    member = member.withColumn("ta", F.least("tile", "other")).withColumn("tb", F.greatest("tile", "other")).select(*names)
    kind = "family long, ta int, tb int, tile int, node long, part long, sketch array<long>"
    rows = split.agg(F.sum(F.col("n") * tiles)).first()[0] or 0
    met = settled(_dealt(member, rows, "family", "ta", "tb").groupBy("deal").applyInArrow(_tile_members(percent), kind))
    n_met = met.count()
    texts = with_texts(classes.select("node", "doc_id", "text_hash").join(met.select("node").distinct(), "node", "left_semi"), n_met).select("node", "text")
    more = _dealt(met.join(texts, "node"), n_met, "family", "ta", "tb")
    found = components(links.union(more.groupBy("deal").applyInArrow(_tile_links(percent), "a long, b long")))

    ids = sig.where("n_shingles > 0").select("doc_id", "text_hash", "n_shingles", "node").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = ids.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    alone = sig.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    out = ids.join(smallest, "label").select("doc_id", "text_hash", "n_shingles", "component_id").union(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _odd_bits(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.lit(0))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each near-duplicate group (its smallest id) and every row without words once per id and text."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00null")).alias("id")
    kept = near_duplicates(docs, **options).where("kept").select(key, F.col("text_hash").alias("hash")).distinct()
    rows = carried(docs, key, F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    # the semi join and the distinct rows need the same keys, so the texts move once
    return rows.join(kept, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"]).select("row.*")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op4_minhash_near_dedup": op4_minhash_near_dedup}
