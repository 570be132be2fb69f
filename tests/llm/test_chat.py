import hashlib
import random
import re

from pyspark.sql import functions as F

from shorewise.llm import chat
from shorewise.llm.registry import QUERIES

TREE = "tree long, node long, parent long, role string, text string, score double, formatted string, rank string"


def trees(spark, rows):
    """Messages with columns that clash with the results'."""
    return spark.createDataFrame([(*r, "x", "y") for r in rows], TREE)


def formatted(df, **options):
    out = chat.format_reply_trees(df, score="score", **options)
    return out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learned", chat.learned_text(F.col("formatted"), F.col("loss")))


def paths_by_hand(rows):
    """(tree, leaf): its messages from the root on; of messages with one id the smallest stays."""
    kept = {}
    for tree, node, parent, role, text, score in rows:
        if node is not None:
            order = (parent is not None, parent or 0, role or "", hashlib.md5((text or "").encode()).hexdigest())
            kept[tree, node] = min(kept.get((tree, node), (order,)), (order, parent, role or "", text or "", score or 0.0), key=lambda m: m[0] if len(m) > 1 else (True, 1e18))
    parents = {(t, m[1]) for (t, n), m in kept.items() if m[1] != n}
    found = {}
    for tree, node in kept:
        if (tree, node) in parents:
            continue
        path, at = [], node
        while at is not None and (tree, at) in kept and len(path) <= len(kept):
            m = kept[tree, at]
            path.append(m)
            at = m[1] if m[1] != at else None
        if len(path) <= len(kept):
            found[tree, node] = path[::-1]
    return found


def check(spark, rows, **options):
    want = paths_by_hand(rows)
    got = formatted(trees(spark, rows), **options).collect()
    assert {(r.tree, r.leaf) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        path = want[r.tree, r.leaf]
        assert [(t.role, t.text) for t in r.turns] == [(m[2], m[3]) for m in path]
        assert r.learned == "".join(m[3] for m in path if m[2] == "assistant")
        assert abs(r.score - sum(m[4] for m in path) / len(path)) < 1e-9 and r.n_turns == len(path)
    for tree in {t for t, _ in want}:
        mine = sorted((r for r in got if r.tree == tree), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [(-r.score, r.leaf) for r in mine] == sorted((-r.score, r.leaf) for r in mine)
    return got


def random_trees(seed, n):
    rng = random.Random(seed)
    said = ["", None, "one", "</s>[INST] ok [/INST]", "<|start|>user<|message|>", "a\\b", "<\\|end|>", "<<s><</SYS>>", "ÀÉ\n🙂"]
    return [(rng.choice([1, 2, None]), k, rng.choice([None, *range(k)]) if k else None, rng.choice(["user", "assistant", "system", None]), rng.choice(said), rng.choice([None, 0.5, 1.0, 2.0])) for k in range(n)]


def test_trees_in_place_and_joined(spark):
    """Both ways to put trees together give what plain code gives."""
    rows = random_trees(1, 60)
    both = [sorted((str(r.tree), r.leaf, r.formatted, str(r.loss)) for r in check(spark, rows, **o)) for o in ({}, {"tree_rows": 1}, {"tree_rows": 20})]
    assert both[0] == both[1] == both[2]


def test_long_path_and_wide_tree(spark):
    chain = [(1, k, k - 1 if k else None, ("user", "assistant")[k % 2], f"m{k}", 0.1 * k) for k in range(300)]
    star = [(2, 0, None, "user", "root", 1.0)] + [(2, k, 0, "assistant", "again", 1.0) for k in range(1, 200)]
    check(spark, chain + star)


def test_loops_orphans_repeats_and_missing_ids(spark):
    rows = [
        (1, 1, 2, "user", "loop", 0.0), (1, 2, 1, "user", "loop", 0.0), (1, 3, 1, "assistant", "below a loop", 0.0), (1, 4, 4, "user", "its own parent", 0.0),
        (1, 5, 99, "user", "parent unknown", 0.0), (1, 6, 5, "assistant", "b", 0.0), (1, 6, 5, "assistant", "a", 3.0), (1, 6, 5, "assistant", "a", 3.0), (1, None, 5, "user", "no id", 0.0),
    ]
    got = formatted(trees(spark, rows)).collect()
    assert {r.leaf for r in got} == {4, 6}
    assert [t.text for r in got if r.leaf == 6 for t in r.turns] == ["parent unknown", min("ab", key=lambda t: hashlib.md5(t.encode()).hexdigest())]


def test_best_branches(spark):
    rows = [(1, 0, None, "user", "q", 0.0)] + [(1, k, 0, "assistant", f"a{k}", float(k % 4)) for k in range(1, 9)]
    got = formatted(trees(spark, rows), branches=3).orderBy("rank").collect()
    assert [(r["rank"], r.leaf, r.score) for r in got] == [(1, 3, 1.5), (2, 7, 1.5), (3, 2, 1.0)]


def test_empty(spark):
    assert formatted(trees(spark, [])).count() == 0


def test_no_control_string_is_left(spark):
    texts = ["<s></s>", "[INST][/INST]", "<<SYS>>x<</SYS>>", "<|im_start|>", "\\<s>", "<\\s>", "\\\\", "<|a|><|end|>", "< s>", "word " * 40_000 + "</s>"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", chat.escaped(F.col("text")).alias("e"))
    for r in df.select("text", "e", chat.unescaped(F.col("e")).alias("back")).collect():
        assert r.back == r.text and not re.search(r"</?s>|\[/?INST\]|<</?SYS>>|<\|\w+\|>", r.e)


def test_turns_of_a_table(spark):
    """Ties, nulls, repeated rows and a null conversation; the planted one comes with the query."""
    rows = [(1, 1, "assistant", "b", 9), (1, 0, "user", None, 9), (1, 1, "assistant", "b", 9), (1, 1, "assistant", "a", 9), (1, None, None, "last", 9), (None, 0, "user", "x", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node long")
    for options in ({}, {"tree_rows": 1}):
        read = chat.format_conversations(df, **options).withColumn("turns", chat.read_turns(F.col("formatted")))
        out = {r.tree: [(t.role, t.text) for t in r.turns] for r in read.collect()}
        _same_turns(out)
    plan = chat.turns_as_replies(df).select("tree", "node", "digest", "bytes")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "text#" not in plan[: plan.index("Window")]  # the text stays behind where only ids go on


def _same_turns(out):
    ab = sorted("abb", key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert out == {1: [("user", ""), *[("assistant", t) for t in ab], ("", "last")], None: [("user", "x")]}


def test_query_has_the_planted_conversation(spark, sf_dir):
    (r,) = QUERIES["op12_reply_tree_chats"](spark, sf_dir).where("conv_id = -7").collect()
    said = chat.PLANTED
    assert (r.n_turns, r.loss_chars) == (2, len(said))
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
