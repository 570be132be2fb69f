import re
from collections import Counter

from pyspark.sql import functions as F

from shorewise.llm import decontaminate as D

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = lowered(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = Counter()
    for doc_id, text in docs:
        w, hit, found = lowered(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in own if x is not None}
        out[(doc_id, len(w), len(hit), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w))] += 1
    return out


def got(rows):
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in rows)


LONG = " ".join(f"w{i}" for i in range(40))
ITEMS = [(1, LONG), (2, "Short ONE here"), (3, None), (4, ""), (10, "short one here"), (None, "lonely item"), (5, "x")]


def cases(odd):
    return [(r.doc_id, r.text) for r in odd.collect()] + [
        (20, "pre " + " ".join(LONG.split()[3:20]).upper() + " post"), (21, "a short one here b " * 3), (22, " ".join(LONG.split()[:12])),
        (23, "lonely item and " + "filler " * 100), (24, LONG + " " + LONG), (24, LONG + " " + LONG), (25, "É short-one.HERE é"),
    ]


def test_against_brute_force(spark, odd):
    rows = cases(odd)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute(rows, ITEMS)
    assert got(D.scan(docs, bench).collect()) == want
    assert got(D.scan(docs, bench, broadcast_windows=0).collect()) == want


def test_empty(spark, odd):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.scan(odd.where("false"), bench).count() == 0
    rows = D.scan(odd, bench.where("false")).collect()
    assert len(rows) == odd.count() and not any(r.contaminated or r.n_hit for r in rows)


def test_remove(spark):
    bench = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Keep this, {LONG}. And that!"), (2, "clean text"), (None, LONG)], "doc_id long, text string")
    assert [r.doc_id for r in D.decontaminate(docs, bench).collect()] == [2]
    out = {r.doc_id: r.text for r in D.decontaminate(docs, bench, remove="spans").collect()}
    assert out == {1: "Keep this, And that!", 2: "clean text", None: ""}


def test_remove_with_clashing_columns(spark):
    bench = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Keep this, {LONG}. And that!"), (2, "clean text"), (None, LONG)], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(i) for i, c in enumerate(("__id", "__hash", "__spans", "row", "own", "own_key", "key", "of", "spans", "text_hash"))})
    assert [(r.doc_id, r.spans) for r in D.decontaminate(docs, bench).collect()] == [(2, 8)]
    out = D.decontaminate(docs, bench, remove="spans")
    assert out.columns == docs.columns and {r.doc_id: (r.text, r.spans) for r in out.collect()} == {1: ("Keep this, And that!", 8), 2: ("clean text", 8), None: ("", 8)}
