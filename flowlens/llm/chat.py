"""Chat formatting: reply trees to conversations in a reversible template, with a loss mask.

A message names its parent. Iterative self-joins double the known ancestors of every message
(1, 2, 4, ... steps), so a path of n messages takes log2(n) joins. Leaves are ranked by the score
of their branch, and each chosen root-to-leaf path becomes one conversation.

Template: ``<s>``, then per turn an opening mark, the escaped text and ``</s>``. Every control
string inside a text gets a backslash after its first character, and backslashes are doubled
first, so a text never holds a control string and reading back restores it exactly. The loss mask
holds the (start, length) of each assistant text, in code points of the formatted string.

Defined results: null text is empty, null role is an empty role; a message whose parent is absent
is a root; replies in a cycle are an error; repeated rows of a linear table are turns of
their own, ordered by (turn, role, text), null turns first; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.session import scratch_path

#: The marks of the template. A role without a mark of its own is written out.
BEGIN, END = "<s>", "</s>"
MARKS = {"user": "[INST] ", "assistant": "[/INST] ", "system": "[SYS] "}
OTHER, OTHER_END = "[ROLE:", "] "
CONTROL = (END, BEGIN, "[INST]", "[/INST]", "[SYS]", "[ROLE:")
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    for mark in CONTROL:
        text = F.replace(text, F.lit(f"{mark[0]}\\{mark[1:]}"), F.lit(mark))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _opening(role: Column) -> Column:
    # A written-out role holds no closing bracket: brackets and percent signs become %5D and %25.
    coded = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("]"), F.lit("%5D"))
    out = F.concat(F.lit(OTHER), escaped(coded), F.lit(OTHER_END))
    for name, mark in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def _plain_role(coded: Column) -> Column:
    return F.replace(F.replace(unescaped(coded), F.lit("%5D"), F.lit("]")), F.lit("%25"), F.lit("%"))


def _table(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def linear_tree(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(tree, node, parent, role, text, score) of a table of turns: each replies to the one before."""
    base = turns.select(F.col(conv).cast("long").alias("tree"), F.col(turn).cast("long").alias("t"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    node = F.row_number().over(Window.partitionBy("tree").orderBy("t", "role", "text")).cast("long")
    return base.withColumn("node", node).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(tree: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, rank, node, step): the messages of the chosen root-to-leaf paths, root first.

    ``best``: how many branches of each tree are chosen, by the sum of scores, ties by leaf; None: all.
    """
    nodes = _table(tree.select("tree", "node", "parent", "score"), "nodes")
    key = lambda a, b: F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))
    parents = nodes.select("tree", F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = nodes.alias("n").join(parents.alias("p"), key("n", "p") & (F.col("n.node") == F.col("p.node")), "left_anti")
    known = nodes.alias("n").join(nodes.alias("p"), key("n", "p") & (F.col("n.parent") == F.col("p.node")), "left")
    # up: the ancestor 2^k steps above, or null; sum: the scores of a message and of the 2^k - 1 above it.
    # A message whose root is nearer than that is done: only the others are joined again.
    jumps = _table(known.select("n.tree", "n.node", F.col("p.node").alias("up"), F.col("n.score").alias("sum")), "jumps")
    levels, done, active = [], jumps.where("up is null"), jumps.where("up is not null")
    while active.limit(1).count():
        levels.append(active)
        if len(levels) > 62:
            raise ValueError("the replies hold a cycle")
        j = active.alias("a").join(done.union(active).alias("b"), key("a", "b") & (F.col("a.up") == F.col("b.node")))
        jumps = _table(j.select("a.tree", "a.node", F.col("b.up").alias("up"), (F.col("a.sum") + F.col("b.sum")).alias("sum")), "jumps")
        done, active = done.union(jumps.where("up is null")), jumps.where("up is not null")
    scored = leaves.alias("n").join(done.alias("j"), key("n", "j") & (F.col("n.node") == F.col("j.node"))).select("n.tree", F.col("n.node").alias("leaf"), F.col("j.sum").alias("total"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf")))
    chosen = ranked if best is None else ranked.where(F.col("rank") <= best)
    found = chosen.select("tree", "leaf", "rank", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("above"))
    # From far to near: every known message of a path gets the one 2^k above it.
    for k in reversed(range(len(levels))):
        up = found.alias("f").join(levels[k].alias("j"), key("f", "j") & (F.col("f.node") == F.col("j.node")))
        found = _table(found.union(up.select("f.tree", "f.leaf", "f.rank", F.col("j.up").alias("node"), F.col("f.above") + (1 << k))), "found")
    return found


def formatted(turns: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, loss) of turns (tree, leaf, above, role, text): whole conversations, root first.

    Exactly one string per path is the product, so the turns of one path meet in one row.
    """
    parts = turns.select("tree", "leaf", (-F.col("above")).alias("at"), _opening(F.col("role")).alias("open"), escaped(F.col("text")).alias("body"), (F.col("role") == LEARNED).alias("learned"))
    parts = parts.withColumn("size", F.char_length("body")).withColumn("wide", F.char_length("open") + F.col("size") + len(END))
    one = parts.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("at", "open", "body", "learned", "size", "wide"))).alias("t"))
    add = lambda s, x: F.struct((s.at + x.wide).alias("at"), F.when(x.learned, F.concat(s.spans, F.array(F.struct((s.at + F.char_length(x.open)).alias("start"), x["size"].alias("length"))))).otherwise(s.spans).alias("spans"))
    start = F.struct(F.lit(len(BEGIN)).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    text = F.concat(F.lit(BEGIN), F.array_join(F.transform("t", lambda x: F.concat(x.open, x.body, F.lit(END))), ""))
    return one.select("tree", "leaf", text.alias("formatted"), F.aggregate("t", start, add, lambda s: s.spans).alias("loss"))


def read_back(text: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation."""
    body = F.substring(text, F.lit(len(BEGIN) + 1), F.char_length(text))
    pieces = F.split(body, "</s>")
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(x: Column) -> Column:
        other = F.substring_index(F.substring(x, F.lit(len(OTHER) + 1), F.char_length(x)), "]", 1)
        role = _plain_role(other)
        size = F.char_length(other) + len(OTHER) + len(OTHER_END)
        for name, mark in MARKS.items():
            role, size = F.when(F.startswith(x, F.lit(mark)), F.lit(name)).otherwise(role), F.when(F.startswith(x, F.lit(mark)), F.lit(len(mark))).otherwise(size)
        return F.struct(role.alias("role"), unescaped(F.substring(x, size + 1, F.char_length(x))).alias("text"))

    return F.transform(turns, turn)


def masked(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(text, s.start + 1, s.length))), "")


def conversations(tree: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, rank, formatted, loss) of the chosen branches of reply trees (tree, node, parent, role, text, score)."""
    chosen = _table(paths(tree, best), "paths")
    texts = tree.select("tree", "node", "role", "text")
    turns = chosen.alias("c").join(texts.alias("x"), F.col("c.tree").eqNullSafe(F.col("x.tree")) & (F.col("c.node") == F.col("x.node"))).select("c.tree", "c.leaf", "c.above", "x.role", "x.text")
    ranks = chosen.where("above = 0").select("tree", "leaf", "rank")
    out = formatted(turns)
    return out.alias("o").join(ranks.alias("r"), F.col("o.tree").eqNullSafe(F.col("r.tree")) & (F.col("o.leaf") == F.col("r.leaf"))).select("o.tree", "o.leaf", "r.rank", "o.formatted", "o.loss")
