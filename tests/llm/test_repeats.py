import random
from collections import Counter

import numpy as np
import pytest

from shorewise.llm import repeats, substrings


def brute_words(rows):
    first, key = {}, lambda i: (i is None, i)
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            x = tuple(w[k : k + 13])
            first[x] = min(first.get(x, key(i)), key(i))
    out = Counter()
    for i, t in rows:
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < key(i):
                gone[k : k + 13] = True
        out[(i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())] += 1
    return out


def word_rows():
    rng = random.Random(6)
    word = lambda n=400: f"v{rng.randrange(n)}"
    passages = [[word() for _ in range(n)] for n in (12, 13, 14, 60)]
    rows = []
    for i in range(60):
        text = [word() for _ in range(rng.randrange(40))]
        for _ in range(2):
            text += rng.choice(passages) + [word() for _ in range(rng.randrange(20))]
        rows.append((i * 3, " ".join(text)))
    return [*rows, (500, "Ab " * 40), (501, "ab " * 40), (400, "ab " * 20)]


@pytest.mark.parametrize("block", [10_000_000, 3000])
def test_words_against_brute_force(spark, odd, block):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + word_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS key")
    got = repeats.remove_repeats(docs, block_bytes=block).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_words(rows)
    assert all(sum(s.e - s.i for s in r.spans) == r.n_removed for r in got)


def test_words_of_text_ids(spark, odd):
    """Text ids, in their own order ("d9" after "d10"), some null and some repeated."""
    rows = [(None if i is None else f"d{i}é", t) for i, t in [(r.doc_id, r.text) for r in odd.collect()] + word_rows()]
    docs = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 AS rank", "2 AS __id")
    got = repeats.remove_repeats(docs, block_bytes=3000)
    assert dict(got.dtypes)["doc_id"] == "string"
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()) == brute_words(rows)
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def brute_bytes(texts, n):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = Counter()
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out[(len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes())] += 1
    return out


def byte_rows():
    rng = random.Random(9)
    text = lambda n, letters="abcdefgh é": "".join(rng.choice(letters) for _ in range(n))
    shared = [text(n) for n in (39, 40, 41, 120)]
    rows = [text(rng.randrange(60)) + rng.choice(shared) + text(rng.randrange(60)) + rng.choice(shared) + text(5, "ab") for _ in range(60)]
    return [*rows, "a" * 300, "ab" * 100, "a" * 39, "a" * 40, rows[0], rows[0]]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 1500}, {"block_bytes": 1500, "group": 2}, {"report": 40, "group": 1}])
def test_bytes_against_brute_force(spark, options, monkeypatch):
    rows = [(1, None), (2, ""), (None, "x"), *((10 + i, t) for i, t in enumerate(byte_rows()))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS span", "2 AS key")
    options = {"report": 25} | options
    got = substrings.remove_substrings(docs, length=40, anchor=10, **options).collect()
    counts = brute_bytes([(t or "").encode() for _, t in rows], options["report"])
    assert Counter((r.n_bytes, r.n_repeated) for r in got) == Counter({k: sum(n for x, n in counts.items() if x[:2] == k) for k in {x[:2] for x in counts}})
    assert Counter((r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == brute_bytes([(t or "").encode() for _, t in rows], 40)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT", 100)
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in (0, 39, 40, 1000, 230, 100)]
    starts = Counter()
    for who, where, lengths, buf in substrings.segments(texts, 40):
        ends = np.cumsum(lengths)
        for d, offset, n, e in zip(who, where, lengths, ends, strict=True):
            assert buf[e - n : e].tobytes() == texts[d][offset : offset + n]
            for s in range(n - 39):
                starts[(d, offset + s)] += 1
    assert starts == Counter((d, i) for d, t in enumerate(texts) for i in range(len(t) - 39))


def test_induced_order_over_key_groups():
    rng = random.Random(3)
    for _ in range(30):
        n = rng.randrange(2, 12)
        keys = np.array([rng.randrange(3) for _ in range(n)])
        before = np.array([rng.randrange(6) for _ in range(n)])
        texts = ["".join(rng.choice("ab") for _ in range(b + rng.randrange(4, 12))).encode() for b in before]
        order = sorted(range(n), key=lambda i: (keys[i], texts[i][before[i] :]))
        keys, before, texts = keys[order], before[order], [texts[i] for i in order]
        got = substrings.induced_repeats(keys, before, texts, np.full(n, 5))
        for i in range(n):
            want = []
            for back in range(before[i] + 1):
                own = texts[i][before[i] - back :][:5]
                if len(own) == 5 and any(j != i and keys[j] == keys[i] and before[j] >= back and texts[j][before[j] - back :][:5] == own for j in range(n)):
                    want.append(back)
            assert sorted(got[i]) == want


def test_empty(odd):
    assert repeats.remove_repeats(odd.where("false")).count() == 0
    assert substrings.remove_substrings(odd.where("false")).count() == 0
    assert substrings.remove_substrings(odd).count() == odd.count()
