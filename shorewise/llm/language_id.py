"""Language ID by rank-order n-gram profiles.

A language's profile is the PROFILE most frequent 1- to 3-grams of letters in a
bounded sample of its training documents, words marked at both ends. A document
gets the same ranking of its own n-grams; the out-of-place distance adds up how
far each of them is from its place in the profile, PROFILE for those that aren't
in it. The nearest language is the prediction; its score is the share of the
runner-up's distance in the two nearest distances (with one language, its
closeness).

The profiles have PROFILE rows per language and travel with the tasks; documents
are read whole, without a shuffle. Defined results: text that is null or has no
letter is `und` with score 0, and so is everything when nothing could be learned;
ties go to the language that sorts first; null languages teach nothing; repeated
rows each come back; an empty table gives an empty result; other columns pass
unread in `identify` and stay in `keep_identified`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shorewise.llm.common import id_remainder, table
from shorewise.llm.shingles import chunks

PROFILE, SAMPLE_DOCS, UNKNOWN = 400, 3000, "und"
#: Mean out-of-place distance, as a share of the largest, from which a text is like none of the languages.
FAR = 0.95
_CHUNK_CHARS = 250_000


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n of 1 to 3: keys of the n-grams, and the text of each, in order of texts."""
    low = [(t or "").lower() for t in texts]
    raw = np.frombuffer(" ".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])[: len(raw)]
    letter = _letters()[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    # one mark before the first word and after the last
    c = np.concatenate([[0], np.where(letter, raw, 0)[keep], [0]]).astype(np.uint64)
    doc = np.concatenate([[0], doc[keep], [len(low) - 1]])
    if len(c) < 3:
        return [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 3
    shift = np.uint64(21)
    one, two, three = c > 0, (c[:-1] > 0) | (c[1:] > 0), c[1:-1] > 0
    pair = (c[:-1] << shift) | c[1:] | np.uint64(1 << 42)
    triple = (c[:-2] << (shift + shift)) | (c[1:-1] << shift) | c[2:] | np.uint64(1 << 63)
    return [(c[one], doc[one]), (pair[two], np.where(c[:-1] > 0, doc[:-1], doc[1:])[two]), (triple[three], doc[1:-1][three])]


def _coded(texts: list[str | None]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The distinct keys, sorted, and for each n the places in them and where each text's begin."""
    parts, found = [], []
    for key, doc in grams(texts):
        d = pa.array(key).dictionary_encode()
        parts.append((d.dictionary.to_numpy(), d.indices.to_numpy(), np.searchsorted(doc, np.arange(len(texts) + 1))))
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys)
    rank, at = np.empty(len(keys), np.int64), 0
    rank[order] = np.arange(len(keys))
    for d, idx, cuts in parts:
        found.append((rank[at : at + len(d)][idx] if len(d) else np.zeros(0, np.int64), cuts))
        at += len(d)
    return keys[order], found


def ranked(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """Each text's most frequent n-grams' keys, most frequent first, ties by key."""
    keys, found = _coded(texts)
    for i in range(len(texts)):
        own = np.concatenate([codes[cuts[i] : cuts[i + 1]] for codes, cuts in found])
        if not len(own):
            yield np.zeros(0, np.int64), keys
            continue
        n = np.bincount(own) if len(own) * 20 > len(keys) else None
        if n is None:
            held, n = np.unique(own, return_counts=True)
        else:
            held = np.flatnonzero(n)
            n = n[held]
        yield held[np.argsort(-n, kind="stable")[:size]], keys


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs = np.array(b.column("lang").to_pylist(), dtype=object)
        texts = b.column("text").to_pylist()
        for lang in sorted(set(langs)):
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            for a, z in chunks([len(t or "") for t in own], _CHUNK_CHARS):
                keys, found = _coded(own[a:z])
                n = np.bincount(np.concatenate([c for c, _ in found]), minlength=len(keys)) if len(keys) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def learn(docs: DataFrame, training: Column, *, profile: int = PROFILE, sample_docs: int = SAMPLE_DOCS) -> dict[str, np.ndarray]:
    """The ranked profile of each language: at most `profile` keys for each, all that comes to the driver."""
    known = docs.where(training & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    share = [(r.lang, min(1.0, sample_docs / r["count"])) for r in known.groupBy("lang").count().collect()]
    if not share:
        return {}
    shares = F.broadcast(docs.sparkSession.createDataFrame(share, "lang string, share double"))
    drawn = known.join(shares, "lang").where(F.pmod(F.xxhash64(F.lit("profile"), "doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    counts = drawn.select("lang", "text").mapInArrow(_sample_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= profile)
    found: dict[str, list] = {}
    for r in best.orderBy("lang", "place").collect():
        found.setdefault(r.lang, []).append(r.gram)
    return {lang: np.array(g, np.int64).astype(np.uint64) for lang, g in found.items()}


def _identified(profiles: dict[str, np.ndarray], size: int, text: str = "text", keep: list[str] | None = None):
    """Batches with lang_pred, score and far, by the text column; of their own columns all stay, or those of `keep`."""
    langs = sorted(profiles)

    def places(keys: np.ndarray) -> np.ndarray:
        out = np.full((len(langs), len(keys)), -1, np.int64)
        for i, lang in enumerate(langs):
            at = np.searchsorted(keys, profiles[lang])
            rank = np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == profiles[lang])) if len(keys) else []
            out[i, at[rank]] = rank
        return out

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # a piece's texts alone are made Python's, and its rows go on before the next
            for a, z in chunks(pc.fill_null(pc.utf8_length(b.column(text)), 0).to_pylist(), _CHUNK_CHARS):
                piece, lang, score, far, rank = b.slice(a, z - a), [], [], [], None
                for own, keys in ranked(piece.column(text).to_pylist(), size):
                    if not len(own) or not langs:
                        lang.append(UNKNOWN), score.append(0.0), far.append(1.0)
                        continue
                    rank = places(keys) if rank is None else rank
                    r = rank[:, own]
                    d = np.where(r >= 0, np.abs(r - np.arange(len(own))), size).sum(axis=1)
                    best, most = np.argsort(d, kind="stable"), size * len(own)
                    first, second = d[best[0]], d[best[1]] if len(langs) > 1 else most
                    lang.append(langs[best[0]])
                    score.append(float(second / (first + second)) if first + second else 0.5)
                    far.append(float(first / most))
                kept = [piece.column(name) for name in (keep or b.schema.names)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.float64())], names=[*(keep or b.schema.names), "lang_pred", "score", "far"])

    return f


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], *, profile: int = PROFILE) -> DataFrame:
    """Per document row: doc_id, lang_pred, score and far (distance to the language, 0 to 1)."""
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, far double"
    return docs.select("doc_id", "text").mapInArrow(_identified(profiles, profile, keep=["doc_id"]), kind)


def keep_identified(docs: DataFrame, training: Column, *, far: float = FAR) -> DataFrame:
    """docs without those of no known language; all columns stay."""
    profiles = learn(docs, training)
    names = [f"__{i}" for i in range(len(docs.columns))]
    kind = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True)), "lang_pred string, score double, far double"])
    kept = docs.toDF(*names).mapInArrow(_identified(profiles, PROFILE, names[docs.columns.index("text")]), kind).where((F.col("lang_pred") != UNKNOWN) & (F.col("far") < far))
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op1_rank_order_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rest = table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 5)
    found = identify(docs, learn(docs, rest != 0))
    return found.select("doc_id", (rest == 0).alias("held_out"), "lang_pred", "score", "far")


QUERIES = {"op1_rank_order_language_id": op1_rank_order_language_id}
