import base64
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shorewise.llm import fingerprint as P
from shorewise.llm import lm_score as M
from shorewise.llm.common import id_remainder


def paragraphs(text):
    return {p for p in re.split(P.PARAGRAPH, text) if p}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("size", [16_000_000, 20_000])
def test_fingerprints_against_sets(spark, real, size, monkeypatch):
    monkeypatch.setattr(P.with_successor, "__defaults__", (size,))
    rows = sorted(real.select("doc_id", "text").where("doc_id < 60").collect(), key=lambda r: -r.doc_id)
    docs = spark.createDataFrame([*rows, (1000, None), (1001, rows[0].text)], "doc_id long, text string").withColumn("hash", F.lit(1))
    order = [(1001, rows[0].text), (1000, ""), *((r.doc_id, r.text or "") for r in rows)]
    got = {r.doc_id: r for r in P.fingerprints(docs).collect()}
    assert len(got) == len(order)
    for i, (doc_id, text) in enumerate(order):
        after, n = order[(i + 1) % len(order)][1], len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(paragraphs(text), paragraphs(edited)))
        assert r.near_next == pytest.approx(jaccard(paragraphs(text), paragraphs(after)))
    assert got[1001].fingerprint == got[rows[0].doc_id].fingerprint


def test_rows_without_ids_are_spread(spark):
    """Rows without an id are more than a range takes; each is still followed by the next, in the order of hashes."""
    rows = [(None, f"Without {i}. " * 20) for i in range(40)] + [(7, "Seven."), (8, "Last.")]
    got = P.with_successor(spark.createDataFrame(rows, "doc_id long, text string"), 1000).collect()
    order = sorted(got, key=lambda r: (-(r.doc_id if r.doc_id is not None else -1), r.hash))
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert [r.next for r in order] == [r.text for r in order[1:]] + [order[0].text]


def test_cells_against_plain_code(spark, real):
    docs = real.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id < 40")
    cell = lambda j: F.pmod(F.xxhash64("d", F.lit(0), F.lit(j)), F.lit(P.CELLS)).alias(f"c{j}")
    digests = docs.select("doc_id", F.explode(P.digests(F.col("text"))).alias("d")).select("doc_id", "d", P._check(F.col("d")).alias("check"), cell(0), cell(1), cell(2)).collect()
    want = defaultdict(lambda: [[0, 0, 0] for _ in range(3 * P.CELLS)])
    for r in digests:
        for j in range(3):
            c = want[r.doc_id][j * P.CELLS + r[f"c{j}"]]
            c[:] = c[0] + 1, c[1] ^ r.d, c[2] ^ r.check
    size = Counter(r.doc_id for r in digests)
    for r in P.fingerprints(docs).select("doc_id", "fingerprint").collect():
        n, _, cells = r.fingerprint.partition(":")
        raw = base64.b64decode(cells)
        got = [[*struct.unpack(">iqI", raw[i : i + 16])] for i in range(0, len(raw), 16)]
        assert int(n) == size[r.doc_id] and got == want[r.doc_id]


def test_sentences_of_any_script(spark):
    """One-line texts whose sentences begin with J-Z, in lower case or in another script have a digest a sentence."""
    sentences = [
        [f"The stone {i} lies here." for i in range(12)], [f"then {i} came!" for i in range(12)], [f"Вот строка {i}?" for i in range(12)], [f"هل هذا {i}؟" for i in range(12)],
        [f"これは{i}です。" for i in range(12)], [f"\u201cSo {i}.\u201d" for i in range(12)], ["Zwei\r\nDrei\r\n" * 3 + "Vier"],
    ]
    texts = [("" if "\u3002" in s[0] else " ").join(s) for s in sentences]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in P.fingerprints(docs).collect()}
    sizes = [int(got[i].fingerprint.split(":")[0]) for i in range(len(texts))]
    assert sizes == [12] * 6 + [3]
    for i, own in enumerate(sentences[:6]):
        kept = texts[i][: len(texts[i]) - len(texts[i]) // 3]
        whole = {x for x in own if x in kept}
        assert len(whole) >= 7 and got[i].near_edited >= len(whole) / (12 + 13)


def test_retries_take_only_what_failed(spark):
    """All of a large pair's digests count, over however many rounds."""
    df = spark.sql("SELECT id AS pair, transform(sequence(1L, 2000 + id), i -> xxhash64(i) & -2) AS a, transform(sequence(501L, 3000L), i -> xxhash64(i) & -2) AS b FROM range(2)")
    got = {r.pair: r.likeness for r in P.compare_larger(df).collect()}
    assert got == {i: pytest.approx((1500 + i) / 3000) for i in range(2)}


def test_odd_fingerprints(odd):
    rows = P.fingerprints(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert P.fingerprints(odd.where("false")).count() == 0
    assert P.fingerprints(odd.where("doc_id = 4")).first().near_next == 1


def test_fingerprints_of_text_ids(spark):
    """Text ids follow one another in their own order, and fingerprints are those of the texts whatever the ids."""
    text = lambda i: " ".join(f"Sentence {k} of {i % 7}." for k in range(i % 5 + 1))
    ids = [f"d{i}" for i in range(25)]
    docs = spark.createDataFrame([(x, text(i)) for i, x in enumerate(ids)] + [(None, "Without.")], "doc_id string, text string").withColumn("rank", F.lit(1))
    order = [*sorted(((x, text(i)) for i, x in enumerate(ids)), reverse=True), (None, "Without.")]
    got = {r.doc_id: r for r in P.fingerprints(docs).collect()}
    numbers = {r.doc_id: r for r in P.fingerprints(spark.createDataFrame([(100 - k if x else None, t) for k, (x, t) in enumerate(order)], "doc_id long, text string")).collect()}
    assert len(got) == 26
    for k, (x, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert got[x].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[x].near_next == pytest.approx(jaccard(paragraphs(t), paragraphs(after)))
        assert got[x][1:] == numbers[100 - k if x else None][1:]
    assert P.fingerprints(docs.where("false")).count() == 0


def test_peeling(spark):
    df = spark.sql("SELECT transform(sequence(1, 40), i -> xxhash64(i)) AS a, transform(sequence(38, 42), i -> xxhash64(i)) AS c, transform(sequence(3, 44), i -> xxhash64(i)) AS b")
    alone = df.select(P.peel(P.subtract(P.sketch(F.col("a")), P.sketch(F.col("b")))).alias("p")).first().p
    assert (alone.a, alone.b) == (2, 4)
    assert df.select(P.peel(P.subtract(P.sketch(F.col("a")), P.sketch(F.col("c"))))).first()[0] is None  # too many for the cells


class Plain:
    """The same model in plain code."""

    def __init__(self, texts, order):
        self.order, self.n = order, defaultdict(Counter)
        for t in texts:
            s = b"\xff" * order + t + b"\xff"
            for i in range(order, len(s)):
                for k in range(order + 1):
                    self.n[s[i - k : i]][s[i]] += 1

    def log10(self, context, symbol):
        total, out = 0.0, set()
        for k in range(self.order, -1, -1):
            seen = self.n.get(context[len(context) - k :])
            if not seen:
                continue
            left = {s: c for s, c in seen.items() if s not in out}
            n = sum(left.values())
            if symbol in left:
                return total + math.log10((2 * left[symbol] - 1) / (2 * n))
            if n:
                total += math.log10(len(left) / (2 * n))
            out = set(seen)
        return total - math.log10(256 - len(out))

    def score(self, text):
        s = b"\xff" * self.order + text + b"\xff"
        return sum(self.log10(s[i - self.order : i], s[i]) for i in range(self.order, len(s)))


@pytest.mark.parametrize("block", [10**9, 4000])
def test_scores_against_plain_code(spark, real, odd, block):
    rows = [(r.doc_id, r.text) for r in real.where("doc_id < 40").collect()] + [(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 7]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS key")
    low = [(i, (t or "").encode().lower()) for i, t in rows]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    model = Plain([t for i, t in low if not held(i)], 3)
    words = Counter(w for i, t in low if not held(i) for w in [*t.split(), b" "])
    n, v = sum(words.values()), len(words)
    want = Counter()
    for i, t in low:
        own = [words[w] for w in [*t.split(), b" "]]
        want[(i, held(i), len(own), sum(c > 0 for c in own), n, round(sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in own), 6), round(model.score(t), 6))] += 1
    got = M.score_documents(docs, id_remainder(F.col("doc_id"), 10) == 0, order=3, block_bytes=block).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want


def test_probabilities_sum_to_one():
    m = Plain([b"abracadabra", b"abba", b"cab"], 2)
    for context in (b"\xff\xff", b"ab", b"zz", b"ra", b"xa"):
        assert sum(10 ** m.log10(context, s) for s in range(256)) == pytest.approx(1)


def test_nothing_to_learn_from(odd):
    rows = M.score_documents(odd.where("doc_id = 8"), F.lit(True)).collect()
    assert rows[0].score == pytest.approx(-2 * math.log10(256)) and rows[0].n_known == 0
    assert M.score_documents(odd.where("false"), F.lit(False)).count() == 0


def test_what_is_made_of_the_next_text_is_its_own_rows(spark):
    """Digests are worked out once a text, also of a range's last row, whose next row is in another range."""
    rows = [(i, f"Text {i}. " * 30) for i in range(40)]
    got = P.with_successor(spark.createDataFrame(rows, "doc_id long, text string"), 2000, made=lambda text: F.concat(F.lit("of "), text)).collect()
    assert len(got) == 40 and all(r.made == "of " + r.text and r.next_made == "of " + r.next for r in got)


def test_paragraphs_are_split_as_by_the_plain_pattern():
    plain = r"[\r\n]+|(?:(?<=[.!?…؟۔।॥])|(?<=[.!?…][\"'”’»)\]]))[ \t\xa0]+|(?<=[。！？｡])[ \t\xa0\u3000]*"
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choices("ab .!?…؟।\"'”)\t\xa0\u3000\n\r。！｡é中", k=draw.randint(0, 40)))
        assert re.split(P.PARAGRAPH, text) == re.split(plain, text)
