"""Chat formatting of reply trees (DataFrame operations only).

Messages form trees by parent links.  Iterative self-joins with doubling steps
(after step k every message knows its 2**k-th ancestor, its depth and the
score sum on the way) reach the root in log2(depth) joins of narrow rows.
Leaves, that is root-to-leaf paths, are ranked by mean score; the members of
the chosen paths are enumerated through the same ancestor tables, each exactly
once, so a path costs as many rows as it has messages.  Every chosen path
becomes one conversation text with a loss mask over the assistant's words.

Template per turn: ``### role: text </turn>`` and a line end.  ``\\``, ``#`` and
``<`` inside texts become ``\\b``, ``\\h`` and ``\\l`` (in roles ``:`` becomes
``\\c`` too), so no control string can occur inside a text, and the escape is
undone by plain replacement.

Defined cases: null text and null role count as empty; a null tree is a tree
of its own; a message whose parent is missing is a root; ties of score go to
the smaller node; rows of one turn are ordered by role, then text, and
repeated rows are turns of their own; an empty table gives an empty result;
other columns are ignored.  Messages whose parents form a cycle, or lead into
one, have no root and are on no path; ``rootless`` returns them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from complexa.llm.common import work_table

_ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]
#: Steps of doubling; paths of up to 2**40 messages.
MAX_STEPS = 40


def escape(text: Column, role: bool = False) -> Column:
    for plain, coded in _ESCAPES + ([(":", "\\c")] if role else []):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in [(":", "\\c")] + _ESCAPES[::-1]:
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def turns_as_tree(conversations: DataFrame) -> DataFrame:
    """tree, node, parent, score, role, text, conv_id: every turn answers the one before it."""
    clean = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    at = F.row_number().over(order).cast("long")
    return clean.withColumn("node", at).select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text", "conv_id")


def _ancestors(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Step k: the messages that have a 2**(k-1)-th ancestor; and the messages that reach a root, with depth and total score."""
    links = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = links.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    first = links.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"),
        F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth"), F.col("score").alias("total"))
    steps = [work_table(first, "ancestors")]
    ended = steps[0].filter("up is null")
    enough = min(MAX_STEPS, steps[0].count().bit_length() + 1)  # no path is longer than all messages: what is left then is a cycle
    while len(steps) < enough and not (active := steps[-1].filter("up is not null")).isEmpty():
        above = active.unionByName(ended)
        above = above.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        steps.append(work_table(active.join(above, ["tree", "up"]).select(
            "tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"),
            (F.col("total") + F.col("total2")).alias("total")), "ancestors"))
        ended = ended.unionByName(steps[-1].filter("up is null"))
    return steps, ended


def rootless(messages: DataFrame) -> DataFrame:
    """Defects: tree, node of the messages that no path holds, as their parents form a cycle or lead into one."""
    return messages.select("tree", "node").join(_ancestors(messages)[1].select("tree", "node"), ["tree", "node"], "left_anti")


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, path (its leaf), path_rank, node, depth for the ``branches`` best root-to-leaf paths of each tree; see ``rootless`` for cycles."""
    steps, ended = _ancestors(messages)
    leaves = ended.join(steps[0].filter("up is not null").select("tree", F.col("up").alias("node")), ["tree", "node"], "left_anti")
    rank = Window.partitionBy("tree").orderBy((F.col("total") / (F.col("depth") + 1)).desc(), "node")
    members = leaves.withColumn("path_rank", F.row_number().over(rank)).filter(F.col("path_rank") <= branches).select(
        "tree", F.col("node").alias("path"), "path_rank", "node", "depth")
    for k in reversed(range(len(steps) - 1)):  # from each member the ancestor 2**k above it
        up = steps[k].filter("up is not null").select("tree", "node", "up")
        higher = members.join(up, ["tree", "node"]).select("tree", "path", "path_rank", F.col("up").alias("node"), (F.col("depth") - 2**k).alias("depth"))
        members = work_table(members.unionByName(higher), "paths")
    return members


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """tree, path, path_rank, formatted, loss_mask (array of start and length in code points, 0-based), and the tree's conv_id."""
    turn = paths.join(messages.select("tree", "node", "role", "text", "conv_id"), ["tree", "node"]).withColumn(
        "head", F.concat(F.lit("### "), escape(F.col("role"), role=True), F.lit(": "))).withColumn("body", escape(F.col("text")))
    pieces = turn.select("tree", "path", "path_rank", "conv_id", "depth", (F.col("role") == "assistant").alias("loss"),
                         F.concat("head", "body", F.lit(" </turn>\n")).alias("piece"), F.char_length("head").alias("skip"), F.char_length("body").alias("n"))
    before = Window.partitionBy("tree", "path").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("start", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.col("skip"))
    grouped = placed.groupBy("tree", "path", "path_rank").agg(
        F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("depth", "piece", "loss", "start", "n"))).alias("turns"))
    return grouped.select(
        "tree", "path", "path_rank", "conv_id", F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["n"].alias("n"))).alias("loss_mask"))


def parse_formatted(formatted: Column) -> Column:
    """array of (role, text) read back from a formatted text."""
    parts = F.filter(F.split(formatted, "</turn>\n"), lambda p: p != "")

    def turn(part: Column) -> Column:
        head = F.substring_index(part, ":", 1)
        text = F.substr(part, F.char_length(head) + 3, F.char_length(part) - F.char_length(head) - 3)
        return F.struct(unescape(F.substr(head, F.lit(5))).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between its pieces."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), m["n"].cast("int")))), "")
