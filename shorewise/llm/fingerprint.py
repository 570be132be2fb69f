"""Document fingerprints that tell two versions' differing paragraphs: invertible Bloom lookup sketches.

A paragraph is a sentence, or a line or the rest of one without a sentence's end,
in any script that ends sentences by a mark. Its 64-bit digest goes to one cell of each of three
sub-tables; a cell has a count and the XORs of digests and of their checksums.
Subtracting two sketches cancels what both versions have. Peeling takes digests
from cells of count 1 whose checksum agrees until none is left, and the numbers
that each side alone has give the likeness of the two sets (Jaccard). Where
peeling stops short, the pair's digests are dealt over as many more sketches as
their number needs, and those of sketches that stop short again are dealt anew,
over four times as many each round and with other hashes.

All of it is built-in expressions: arrays and lambdas within a row, and
groupings of (pair, part) for the retries. The successor of a document by id
comes from windows over id ranges; each range ends with a copy of the next
range's first row, so no task holds more than a range. Rows without an id go by
ranges of their hashes; rows of one id share a range.

Defined results: null text is empty, and so has no paragraphs; two documents
without paragraphs have likeness 1; null ids come last; rows of equal id are
ordered by their text's hash; a single row is its own successor; an empty table
gives an empty result; other columns aren't read. Ids of any type that has an order
will do: text ids compare by code point.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shorewise.llm.common import let, named, numbered, ranked, settled, table

CELLS, ROUNDS, RETRY_ROUNDS, KEYS_A_PART, RANGE_BYTES, BROADCAST_RANGES = 8, 8, 4, 6, 16_000_000, 200_000
#: Line ends; blanks after a sentence's mark, or after the quote or bracket that closes one; behind a full-width mark, blanks or none.
#: What most places lack is looked for first: a blank ahead, a letter of the East behind.
PARAGRAPH = r"[\r\n]+|(?=[ \t\xa0])(?:(?<=[.!?…؟۔।॥])|(?<=[.!?…][\"'”’»)\]]))[ \t\xa0]+|(?<![\x00-\u2fff])(?<=[。！？｡])[ \t\xa0\u3000]*"


def digests(text: Column) -> Column:
    """Distinct digests of the text's paragraphs, sorted: 63 bits, the lowest is left for a sign."""
    return F.sort_array(F.array_distinct(F.transform(F.array_remove(F.split(text, PARAGRAPH), ""), lambda p: F.xxhash64(p).bitwiseAND(F.lit(-2)))))


def _entry(digest: Column, sign: Column, salt: Column) -> Column:
    """What a digest is to the sketch: its sign, checksum and, as bits, its cell in each sub-table."""
    cell = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(digest, salt, F.lit(j)), F.lit(CELLS)).cast("int") + j * CELLS)
    return F.struct(sign.alias("n"), digest.alias("k"), _check(digest).alias("c"), cell(0).bitwiseOR(cell(1)).bitwiseOR(cell(2)).alias("cells"))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(99)).bitwiseAND(F.lit(0xFFFFFFFF))


def _add(cell: Column, e: Column) -> Column:
    return F.struct((cell["n"] + e["n"]).alias("n"), cell["k"].bitwiseXOR(e["k"]).alias("k"), cell["c"].bitwiseXOR(e["c"]).alias("c"))


def _into(entries: Column, cells: Column) -> Column:
    """The cells with all entries added."""

    def of(cell: Column, i: Column) -> Column:
        return F.aggregate(entries, cell, lambda a, e: F.when(F.getbit(e["cells"], i) == 1, _add(a, e)).otherwise(a))

    return F.transform(cells, of)


def _blank() -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(3 * CELLS)), lambda _: F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c")))


def sketch(keys: Column, salt: Column | None = None) -> Column:
    """The cells of a set of digests."""
    salt = F.lit(0) if salt is None else salt
    return let(F.transform(keys, lambda d: _entry(d, F.lit(1), salt)), lambda entries: _into(entries, _blank()))


def difference(signed: Column, salt: Column) -> Column:
    """The cells of one set less those of another, from the digests of both: those of the second have their lowest bit set and count negative."""
    entry = lambda s: _entry(s.bitwiseAND(F.lit(-2)), (F.lit(1) - 2 * s.bitwiseAND(F.lit(1))).cast("int"), salt)
    return let(F.transform(signed, entry), lambda entries: _into(entries, _blank()))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def peel(cells: Column, rounds: int = ROUNDS, salt: Column | None = None) -> Column:
    """How many digests only the first and only the second set has, as a struct of a and b; null if cells are left over."""
    salt = F.lit(0) if salt is None else salt

    def step(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _check(c["k"])))
        taken = F.array_distinct(F.transform(pure, lambda c: _entry(c["k"], -c["n"], salt)))
        return let(taken, lambda t: F.when(F.size(t) == 0, state).otherwise(after(state, t)))

    def after(state: Column, taken: Column) -> Column:
        alone = lambda sign: F.size(F.filter(taken, lambda e: e["n"] == sign))
        return F.struct(_into(taken, state["cells"]).alias("cells"), (state["a"] + alone(-1)).alias("a"), (state["b"] + alone(1)).alias("b"))

    start = F.struct(cells.alias("cells"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    left = lambda s: F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["c"] != 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: F.when(~left(s), F.struct(s["a"].alias("a"), s["b"].alias("b"))))


def likeness(n_a: Column, n_b: Column, alone: Column) -> Column:
    """Shared digests over all digests, from the sizes and what each side alone has."""
    of = lambda s: F.when(n_a + s["b"] == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(n_a - s["a"], n_a + s["b"]))))
    return let(alone, lambda s: F.when(s.isNotNull(), of(s)))


def encoded(size: Column, cells: Column) -> Column:
    """A sketch as text: the size, then the cells in base 64."""
    digits = F.transform(cells, lambda c: F.concat(F.lpad(F.hex(c["n"]), 8, "0"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["c"]), 8, "0")))
    return F.concat(size.cast("string"), F.lit(":"), F.base64(F.unhex(F.array_join(digits, ""))))


def compare_larger(pairs: DataFrame) -> DataFrame:
    """(pair, likeness) of pairs (pair, a, b): digests dealt over parts, each a sketch of its own, and those of parts that don't peel dealt anew."""
    signed = F.concat("a", F.transform("b", lambda d: d.bitwiseOR(F.lit(1))))
    out, turn = None, 1
    pending = pairs.select("pair", F.size("a").alias("n_a"), F.size("b").alias("n_b"), F.lit(0).cast("long").alias("only_a"), F.lit(0).cast("long").alias("only_b"), signed.alias("signed"))
    while True:
        salt = F.lit(turn)
        parts = F.ceil(F.size("signed") / KEYS_A_PART) * F.lit(4 ** (turn - 1))
        rows = pending.select("pair", parts.alias("parts"), F.explode("signed").alias("d"))
        rows = rows.withColumn("part", F.pmod(F.xxhash64(F.col("d").bitwiseAND(F.lit(-2)), salt, F.lit("part")), "parts"))
        peeled = rows.groupBy("pair", "part").agg(F.collect_list("d").alias("signed")).select("pair", "signed", peel(difference(F.col("signed"), salt), RETRY_ROUNDS, salt).alias("alone"))
        again = F.flatten(F.collect_list(F.when(F.col("alone").isNull(), F.col("signed"))))
        whole = peeled.groupBy("pair").agg(F.sum("alone.a").alias("a"), F.sum("alone.b").alias("b"), again.alias("signed"))
        known = pending.drop("signed").join(whole, "pair", "left")
        count = lambda side: (F.col(f"only_{side}") + F.coalesce(side, F.lit(0))).alias(f"only_{side}")
        known = settled(known.select("pair", "n_a", "n_b", count("a"), count("b"), F.coalesce("signed", F.array().cast("array<long>")).alias("signed")))
        alone = F.struct(F.col("only_a").alias("a"), F.col("only_b").alias("b"))
        done = known.where(F.size("signed") == 0).select("pair", likeness(F.col("n_a"), F.col("n_b"), alone).alias("likeness"))
        out = done if out is None else out.union(done)
        pending = known.where(F.size("signed") > 0)
        if pending.isEmpty():
            return out
        turn += 1


def with_successor(docs: DataFrame, range_bytes: int = RANGE_BYTES, *, made: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, text, hash and the next text by descending doc_id (after the last, the first); made and next_made are what is made of either text, once for both its uses."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // range_bytes))
    few = min(ranges, 1000)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / few for i in range(few + 1)], 100_000)).first()[0] or [0, 0]
    cuts = sorted(set(cuts)) if len(set(cuts)) > 1 else [cuts[0], cuts[0] + 1]
    # the range by quantile, and equal parts of it where one quantile is too large
    inner, id_ = -(-ranges // few), F.greatest(F.lit(cuts[0]), F.least(F.lit(cuts[-1]), F.col("doc_id")))
    bounds = F.array(*map(F.lit, cuts[:-1]))
    slot = F.greatest(F.lit(1), F.size(F.filter(bounds, lambda c: c <= id_)))
    low, high = F.element_at(bounds, slot), F.element_at(F.array(*map(F.lit, cuts[1:])), slot)
    part = F.least(F.lit(inner - 1), F.floor((id_ - low) * inner / (high - low + 1)))
    # rows without an id go by their hash, in as many parts as they need
    parts = max(1, -(-(docs.where("doc_id IS NULL").agg(F.sum(F.octet_length("text"))).first()[0] or 0) // range_bytes))
    sub = F.least(F.lit(parts - 1), F.floor((F.col("hash") / F.lit(2.0**64) + 0.5) * parts).cast("int"))
    docs = docs.withColumn("sub", F.when(F.col("doc_id").isNull(), sub).otherwise(0))
    docs = docs.withColumn("range", F.coalesce(slot * inner + part, F.lit(-1)).cast("long"))

    order = [F.col("doc_id").desc_nulls_last(), F.col("hash")]
    head = F.max(F.struct(F.col("doc_id"), -F.col("hash").cast("decimal(20,0)")))
    heads = docs.groupBy("range", "sub").agg(head.alias("h")).select("range", "sub", F.col("h.doc_id").alias("id"), (-F.col("h.col2")).cast("long").alias("head_hash"))
    heads = settled(ranked(heads, F.col("range"), F.col("sub").desc()))
    # the range before takes a copy of the head; the first range's goes to the last one
    after = heads.select(F.col("rank").alias("at"), F.col("range").alias("to"), F.col("sub").alias("to_sub"))
    turned = heads.join(after, (F.col("rank") + 1) % F.lit(heads.count() or 1) == F.col("at")).select(F.col("range").alias("of"), F.col("sub").alias("of_sub"), "id", "head_hash", "to", "to_sub")
    turned = F.broadcast(turned) if ranges <= BROADCAST_RANGES else turned  # a row per range at most
    first = docs.join(turned, (F.col("range") == F.col("of")) & (F.col("sub") == F.col("of_sub")) & docs["doc_id"].eqNullSafe(turned["id"]) & (F.col("hash") == F.col("head_hash")))
    ghosts = first.select("doc_id", "text", "hash", F.col("to").alias("range"), F.col("to_sub").alias("sub")).dropDuplicates(["range", "sub"])
    rows = docs.withColumn("ghost", F.lit(0)).unionByName(ghosts.withColumn("ghost", F.lit(1)))
    within = Window.partitionBy("range", "sub").orderBy("ghost", *order)
    rows, names = rows.withColumn("next", F.lead("text").over(within)), ["doc_id", "text", "hash", "next"]
    if made:
        rows, names = rows.withColumn("made", made(F.col("text"))).withColumn("next_made", F.lead("made").over(within)), [*names, "made", "next_made"]
    return rows.where("ghost = 0").select(*names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next."""
    docs, names = numbered(docs)
    sketched = lambda text: let(digests(text), lambda keys: F.struct(keys.alias("keys"), sketch(keys).alias("cells")))
    rows = with_successor(docs, made=sketched).withColumn("n_chars", F.length("text"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars") - cut), F.substr("next", F.lit(1), cut)))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("made.keys").alias("a"), digests(F.col("edited")).alias("e"), F.col("next_made.keys").alias("n"), F.col("made.cells").alias("ca"), F.col("next_made.cells").alias("cn"))
    rows = rows.select("*", sketch(F.col("e")).alias("ce"))
    like = lambda side: likeness(F.size("a"), F.size(side), peel(subtract(F.col("ca"), F.col(f"c{side}"))))
    rows = rows.select("*", like("e").alias("near_edited"), like("n").alias("near_next"))
    # digests are smaller than the sketches' text, which the last step makes of them; the row's number is written with it, so that it stays
    kept = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", "edited_sha256", "near_edited", "near_next", "a", "e", F.when(F.col("near_next").isNull(), F.col("n")).alias("n"))
    kept = settled(kept)
    pairs = [kept.where(f"{near} IS NULL").select((F.col("row") * 2 + i).alias("pair"), "a", F.col(side).alias("b")) for i, (near, side) in enumerate((("near_edited", "e"), ("near_next", "n")))]
    found = compare_larger(pairs[0].union(pairs[1]))
    of = lambda i: F.max(F.when(F.col("pair") % 2 == i, F.col("likeness")))
    again = found.groupBy(F.shiftright("pair", 1).alias("row")).agg(of(0).alias("again_edited"), of(1).alias("again_next"))
    kept = kept.drop("n").join(again, "row", "left")
    kept = kept.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", encoded(F.size("a"), sketch(F.col("a"))).alias("fingerprint"), encoded(F.size("e"), sketch(F.col("e"))).alias("edited_fingerprint"),
        F.coalesce("near_edited", "again_edited").alias("near_edited"), F.coalesce("near_next", "again_next").alias("near_next"),
    )
    return named(kept, names)


def op8_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op8_iblt_fingerprints": op8_iblt_fingerprints}
