"""Reply trees formatted as conversations.

Messages form trees by parent links.  Root-to-leaf paths are enumerated by iterative
self-joins that double the reach of a jump in each round, so a tree of depth d takes
about log2(d) joins over keys only; texts join the chosen paths at the end.  Branches are
ranked by the sum of their scores, and each chosen path is formatted as one conversation.

Format: `<conv>` turns `</conv>`, a turn being `<turn>` role, a newline, text, `</turn>`.  In
roles and texts `\\` becomes `\\e`, `<` becomes `\\l` and `[` becomes `\\b` (in roles a
newline becomes `\\n` besides), so no control string can occur inside one, and the escape is undone
exactly.  `loss` holds the spans (code points, end exclusive) of assistant texts.

Everything runs in the JVM.  Defined results: null roles and texts are empty; a parent
that doesn't exist makes a root; a cycle has no leaf of its own and is left out;
equal scores keep the leaf with the smallest key; rows that repeat a turn follow each other by role and text, none
is dropped; a null conv_id is a conversation of its own; very long texts stay whole; columns other than the named ones aren't looked
at, whatever their names; a conversation without rows has no output, so an empty table has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import materialize

OPEN, CLOSE, TURN, END = "<conv>", "</conv>", "<turn>", "</turn>"
_ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
_ROUNDS = 40


def escape(text: Column, role: bool = False) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, safe in _ESCAPES + ((("\n", "\\n"),) if role else ()):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def unescape(text: Column, role: bool = False) -> Column:
    for plain, safe in ((("\n", "\\n"),) if role else ()) + _ESCAPES[::-1]:
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def reply_paths(messages: DataFrame) -> DataFrame:
    """Root-to-leaf paths of messages (tree, node, parent: strings): tree, leaf, node, up (0 at the leaf)."""
    known = messages.select("tree", "node")
    links = messages.where("parent IS NOT NULL").select("tree", "node", "parent").join(known.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi").select("tree", "node", "parent")
    jump = materialize(links, "jump")
    leaves = known.join(jump.select("tree", F.col("parent").alias("node")), ["tree", "node"], "left_anti")
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in range(_ROUNDS):
        if jump.isEmpty():
            return paths
        far = paths.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("parent").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = materialize(paths.unionByName(far), "paths")
        again = jump.select("tree", F.col("node").alias("parent"), F.col("parent").alias("far"))
        # a jump that comes back to its own start lies on a cycle
        jump = materialize(jump.join(again, ["tree", "parent"]).where("far != node").select("tree", "node", F.col("far").alias("parent")), "jump")
    raise ValueError("paths are too long, or parents form a cycle")


def format_replies(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """messages: tree, node, parent (strings), role, text, score.  Returns tree, leaf, formatted, loss.

    loss: array of struct<start, end>.  `per_tree`: how many branches of a tree to keep, best first.
    """
    paths = reply_paths(messages)
    scored = paths.join(messages.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("score")), ["tree", "node"])
    branches = scored.groupBy("tree", "leaf").agg(F.sum("score").alias("total"))
    best = Window.partitionBy("tree").orderBy(F.desc("total"), "leaf")
    chosen = branches.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per_tree).select("tree", "leaf")
    turns = (
        paths.join(chosen, ["tree", "leaf"], "left_semi")
        .join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
        .withColumn("head", F.concat(F.lit(TURN), escape(F.col("role"), True), F.lit("\n")))
        .withColumn("body", escape(F.col("text")))
        .withColumn("size", F.length("head") + F.length("body") + len(END))
    )
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)) + len(OPEN) + F.length("head"))
    gathered = placed.groupBy("tree", "leaf").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    (-F.col("up")).alias("at"),
                    F.concat("head", "body", F.lit(END)).alias("turn"),
                    F.struct("start", (F.col("start") + F.length("body")).alias("end")).alias("span"),
                    F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("scored"),
                )
            )
        ).alias("turns")
    )
    return gathered.select(
        "tree",
        "leaf",
        F.concat(F.lit(OPEN), F.array_join(F.transform("turns", lambda t: t["turn"]), ""), F.lit(CLOSE)).alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["scored"]), lambda t: t["span"]).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of struct<role, text>, as they were given."""
    body = F.substring(formatted, F.lit(len(OPEN) + 1), F.length(formatted) - len(OPEN) - len(CLOSE))
    pieces = F.filter(F.split(body, END), lambda p: p != "")
    inside = F.transform(pieces, lambda p: F.substring(p, F.lit(len(TURN) + 1), F.length(p)))
    return F.transform(
        inside,
        lambda p: F.struct(
            unescape(F.substring_index(p, "\n", 1), True).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text"),
        ),
    )


def under_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, end to end."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def linear_messages(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages of conversations without parent links: each row replies to the one before it.

    Rows of one conversation and turn follow each other by role and text.
    """
    own = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    tree = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    at = F.row_number().over(order)
    return own.select(tree.alias("tree"), at.alias("at"), "role", "text").select(
        "tree", F.col("at").cast("string").alias("node"), F.when(F.col("at") > 1, (F.col("at") - 1).cast("string")).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )
