"""Conversations from reply trees, formatted with a loss mask.

A message knows its parent. Self-joins that double their reach list every message's
ancestors 1, 2, 4, ... steps up, so a path of d messages takes log2(d) rounds. From
these come each leaf's score (the mean of its path's messages) and, for the branches
chosen, the messages of the path from root to leaf. Only ids, scores and sizes take
part in these joins; texts come in at the end. Trees that fit a row are put together
where their texts lie, with one shuffle of the texts; larger trees meet their paths
message by message.

A turn is `<|start|>` role `<|message|>` text `<|end|>`. In roles and texts a
backslash is doubled, and one is put after the first character of whatever could
be read as a control string, so that none is left; taking away each backslash and
keeping what follows it gives the text back. The loss mask is a span (start, length,
in code points) for each turn: the text of an assistant's turn, empty for others.

Defined results: null texts, roles are empty, a null score is 0; of messages with one id in a
tree the one with the smallest (parent, role, text digest) stays; a message whose parent is null,
unknown or itself is a root; messages in a loop of parents, or below one, and those
without an id are on no path. Branches of equal score are ranked by their leaf.
Trees without an id are one tree. An empty table gives an empty result. A path's
text must fit a row of Spark's, 2 GB.

For a table of dated turns (`format_conversations`), each row answers the one before it: rows of
equal turn are in order of role and text digest, null turns come last, and repeated rows are turns of their own.
Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shorewise.llm.common import let, ranked, settled, table

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
#: What could be read as a control string, by first character and rest.
CONTROL = r"([<\[])(?=/?s>|</?SYS>>|\|[A-Za-z_]+\|>|/?INST\])"
#: Largest trees that are put together within a row.
TREE_ROWS, TREE_BYTES = 256, 16_000_000
BRANCH = ["tree", "leaf", "rank", "score"]


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), CONTROL, "$1\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _running(lengths: Column) -> Column:
    """Where each of consecutive pieces starts."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(lengths, begin, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"])


def format_turns(turns: Column, learned: str = "assistant") -> Column:
    """struct<formatted, loss> of an array of (role, text) structs."""

    def joined(parts: Column) -> Column:
        whole = F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(END)))
        starts = _running(F.transform(whole, F.length))
        span = lambda p, at: F.struct((at + F.length(p["head"])).alias("start"), F.when(p["learned"], F.length(p["body"])).otherwise(0).alias("length"))
        return F.struct(F.array_join(whole, "").alias("formatted"), F.zip_with(parts, starts, span).alias("loss"))

    part = lambda t: F.struct(F.concat(F.lit(START), escaped(t["role"]), F.lit(MESSAGE)).alias("head"), escaped(t["text"]).alias("body"), F.coalesce(t["role"] == learned, F.lit(False)).alias("learned"))
    return let(F.transform(turns, part), joined)


def read_turns(formatted: Column) -> Column:
    """(role, text) structs of a formatted conversation."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, MESSAGE, 1)
        begin = F.length(role) + len(MESSAGE)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(piece, begin + 1, F.length(piece) - begin - len(END))).alias("text"))

    return F.transform(_pieces(formatted), turn)


def _pieces(formatted: Column) -> Column:
    return let(F.split(formatted, r"<\|start\|>"), lambda p: F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped span by span."""

    def under(pieces: Column) -> Column:
        starts = _running(F.transform(pieces, lambda p: F.length(p) + len(START)))
        placed = F.zip_with(pieces, starts, lambda p, at: F.struct(p.alias("piece"), (at + len(START)).alias("at")))
        return F.array_join(F.zip_with(placed, loss, lambda p, s: unescaped(F.substr(p["piece"], s["start"] - p["at"] + 1, s["length"]))), "")

    return let(_pieces(formatted), under)


def _jumps(links: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """(tree, node, up, gain) for 1, 2, 4, ... steps up, gain being the scores of those passed; and what has an ancestor further up than there are links, if anything: loops."""
    steps = [settled(links)]
    n = steps[0].count()
    if not n:
        return [], None
    while True:
        above = steps[-1].select("tree", F.col("node").alias("up"), F.col("up").alias("far"), F.col("gain").alias("more"))
        further = settled(steps[-1].join(above, ["tree", "up"]).select("tree", "node", F.col("far").alias("up"), (F.col("gain") + F.col("more")).alias("gain")))
        if further.isEmpty():
            return steps, None
        if 2 ** len(steps) > n:
            return steps, further
        steps.append(further)


def _branches(ids: DataFrame, steps: list[DataFrame], loops: DataFrame | None, most: int | None) -> DataFrame:
    """(tree, leaf, score, rank): the best branches of each tree, rank from 1."""
    parents = steps[0].select("tree", F.col("up").alias("node")) if steps else None
    leaves = ids.join(parents, ["tree", "node"], "left_anti") if steps else ids
    if loops is not None:
        leaves = leaves.join(loops, ["tree", "node"], "left_anti")
    found = leaves.select("tree", F.col("node").alias("leaf"), "node", F.col("score").alias("total"), F.lit(1).alias("depth"))
    for k in reversed(range(len(steps))):
        found = found.join(steps[k], ["tree", "node"], "left").select(
            "tree", "leaf", F.coalesce("up", "node").alias("node"), (F.col("total") + F.coalesce("gain", F.lit(0.0))).alias("total"), (F.col("depth") + F.when(F.col("up").isNotNull(), 2**k).otherwise(0)).alias("depth")
        )
    scored = found.select("tree", "leaf", (F.col("total") / F.col("depth")).alias("score"))
    order = [F.desc("score"), F.asc("leaf")]
    if most is not None:  # Spark keeps `most` rows of a tree before it shuffles
        return settled(scored.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(*order))).where(F.col("rank") <= most))
    numbered = ranked(scored, F.asc("tree"), *order)
    first = numbered.groupBy("tree").agg(F.min("rank").alias("first"))
    return settled(numbered.join(first, "tree").select("tree", "leaf", "score", (F.col("rank") - F.col("first") + 1).cast("int").alias("rank")))


def _members(chosen: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """(tree, leaf, rank, score, node, back) for each message of each chosen path; back is how far from the leaf it is."""
    rows = chosen.select(*BRANCH, F.col("leaf").alias("node"), F.lit(0).alias("back"))
    for k in reversed(range(len(steps))):
        further = rows.join(steps[k], ["tree", "node"]).select(*BRANCH, F.col("up").alias("node"), (F.col("back") + 2**k).alias("back"))
        rows = settled(rows.union(further))
    return rows


def format_reply_trees(messages: DataFrame, *, tree: str = "tree", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text", score: str | None = None, branches: int | None = None, tree_rows: int = TREE_ROWS, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """A row for each of the best branches of each tree (all if branches is None): tree, leaf, rank, score, n_turns, formatted and loss."""
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    rows = _told(messages.where(F.col(node).isNotNull()), F.col(tree), role, text, F.col(node).alias("node"), F.col(parent).alias("parent"), value.alias("score"))
    return _formatted(rows, branches, tree_rows, tree_bytes)


def _told(messages: DataFrame, tree: Column, role: str, text: str, *others: Column) -> DataFrame:
    """tree (never null), given, role and text (never null), digest and bytes of them, and other columns: digest and bytes stand for the text where only ids are shuffled."""
    own = F.coalesce(tree.cast("string"), F.lit("\x00null"))
    rows = messages.select(own.alias("tree"), tree.alias("given"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), *others)
    return rows.select("*", F.md5(F.col("text").cast("binary")).alias("digest"), (F.octet_length("text") + F.octet_length("role")).alias("bytes"))


def _formatted(rows: DataFrame, branches: int | None, tree_rows: int, tree_bytes: int) -> DataFrame:
    order = F.struct("parent", "role", "digest")
    # a message whose id another has too is settled by the order, here and where texts are put together
    least = F.min(F.struct(order.alias("order"), F.col("score"))).alias("least")
    ids = rows.groupBy("tree", "node").agg(least, F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("copies"))
    ids = settled(ids.select("tree", "node", F.col("least.order.parent").alias("parent"), F.col("least.score").alias("score"), "bytes", "copies"))
    ups = ids.select("tree", F.col("node").alias("up"), F.col("score").alias("gain"))
    links = ids.where("parent <> node").select("tree", "node", F.col("parent").alias("up")).join(ups, ["tree", "up"]).select("tree", "node", "up", "gain")
    steps, loops = _jumps(links)
    chosen = _branches(ids.select("tree", "node", "score"), steps, loops, branches)
    members = _members(chosen, steps)
    large = settled(ids.groupBy("tree").agg(F.sum("copies").alias("n"), F.sum("bytes").alias("bytes")).where((F.col("n") > tree_rows) | (F.col("bytes") > tree_bytes)).select("tree"))
    if large.isEmpty():
        found = _in_place(rows, order, members)
    else:
        here, there = [_in_place(f(rows), order, f(members)) if small else _joined(f(rows), order, f(members)) for small, f in ((True, lambda df: df.join(large, "tree", "left_anti")), (False, lambda df: df.join(large, "tree", "left_semi")))]
        found = here.unionByName(there)
    made = found.withColumn("made", format_turns(F.col("turns")))
    return made.select(F.col("given").alias("tree"), "leaf", "rank", "score", F.size("turns").cast("long").alias("n_turns"), "made.*")


def _in_place(rows: DataFrame, order: Column, members: DataFrame) -> DataFrame:
    """BRANCH with given and turns: each tree's messages in one row, and its paths looked up in it."""
    message = F.struct(F.col("node"), order.alias("order"), F.col("role"), F.col("text"))
    trees = rows.groupBy("tree").agg(F.min("given").alias("given"), F.sort_array(F.collect_list(message)).alias("messages"))
    paths = members.groupBy(*BRANCH).agg(F.sort_array(F.collect_list(F.struct("back", "node")), False).alias("path"))
    both = trees.join(paths.groupBy("tree").agg(F.collect_list(F.struct("leaf", "rank", "score", "path")).alias("paths")), "tree")
    first = F.filter("messages", lambda m, i: (i == 0) | (F.get(F.col("messages"), i - 1)["node"] != m["node"]))
    known = both.withColumn("known", F.map_from_entries(F.transform(first, lambda m: F.struct(m["node"], F.struct(m["role"], m["text"])))))
    each = known.select("tree", "given", "known", F.explode("paths").alias("p"))
    return each.select("given", "tree", "p.leaf", "p.rank", "p.score", F.transform("p.path", lambda s: F.element_at(F.col("known"), s["node"])).alias("turns"))


def _joined(rows: DataFrame, order: Column, members: DataFrame) -> DataFrame:
    """The same for trees that don't fit a row: messages meet the paths that they are on."""
    said = rows.groupBy("tree", "node").agg(F.min(F.struct(order.alias("order"), F.col("given"), F.col("role"), F.col("text"))).alias("m"))
    on = said.select("tree", "node", "m.given", "m.role", "m.text").join(members, ["tree", "node"])
    paths = on.groupBy(*BRANCH).agg(F.min("given").alias("given"), F.sort_array(F.collect_list(F.struct("back", "role", "text")), False).alias("path"))
    return paths.select("given", *BRANCH, F.transform("path", lambda p: F.struct(p["role"], p["text"])).alias("turns"))


def turns_as_replies(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each row as the reply to the one before it: tree, given, node, parent, role, text, digest, bytes, score."""
    rows = _told(turns, F.col(conversation), role, text, F.col(turn).alias("turn"), F.lit(0.0).alias("score"))
    number = F.row_number().over(Window.partitionBy("tree").orderBy(F.asc_nulls_last("turn"), "role", "digest"))
    return rows.withColumn("node", number).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).drop("turn")


def format_conversations(turns: DataFrame, *, tree_rows: int = TREE_ROWS, tree_bytes: int = TREE_BYTES, **names) -> DataFrame:
    """format_reply_trees of a table of dated turns: a row for each conversation, whose texts are shuffled once."""
    return _formatted(turns_as_replies(turns, **names), None, tree_rows, tree_bytes)


#: A conversation of control strings only, beside those of the table.
PLANTED_ID, PLANTED = -7, "</s>[INST] ok [/INST]"


def op12_reply_tree_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    planted = spark.range(2).select(F.lit(PLANTED_ID).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PLANTED).alias("text"))
    out = format_conversations(given.unionByName(planted))
    rows = out.select("tree", "formatted", read_turns(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("loss")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op12_reply_tree_chats": op12_reply_tree_chats}


def _escaped_chars(column: str) -> str:
    marked = rf"regexp_replace(replace({column}, '\', '\\'), '<(/?s>|</?SYS>>|\|[A-Za-z_]+\|>)|\[(/?INST\])', '<\\\1\2', 'g')"
    return f"length({marked})"


ORACLES = {
    "op12_reply_tree_chats": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES ({PLANTED_ID}, 0, 'user', '{PLANTED}'), ({PLANTED_ID}, 1, 'assistant', '{PLANTED}')),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, md5(text)) AS k FROM t)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(START + MESSAGE + END)} + {_escaped_chars('role')} + {_escaped_chars('text')})::BIGINT AS formatted_chars
FROM r GROUP BY conv_id"""
}
