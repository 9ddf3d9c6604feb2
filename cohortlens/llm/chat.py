"""Conversations from reply trees.

DataFrame functions only. Paths from the root to each leaf are enumerated by
self-joins that double the distance: after step k every leaf knows its
ancestors up to 2^(k+1) - 1 steps away and every message the one 2^(k+1) steps
up. The branches of a tree are ranked by their score and the chosen paths
formatted, one conversation each.

Template: ``<s>``, per turn ``[TURN role]``, a line end, the text, ``[/TURN]`` and
a line end, then ``</s>``. Control strings inside texts and roles are escaped by
``~``: ~0 is ~, ~1 is <, ~2 is [, ~3 is ]; only the first sign of a control
string needs it, and every ~. The loss mask is kept as spans of code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.scratch import keep, stored

# The strings that no text may bring into the output.
CONTROL = ["<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[TURN ", "[/TURN]"]
_SIGN = {"<": "~1", "[": "~2", "]": "~3"}
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("~"), F.lit("~0"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(_SIGN[c[0]] + c[1:]))
    return out


def escape_role(role: Column) -> Column:
    out = F.replace(escape(role), F.lit("]"), F.lit("~3"))
    return F.replace(out, F.lit("["), F.lit("~2"))


def unescape(text: Column) -> Column:
    for sign, code in [("<", "~1"), ("[", "~2"), ("]", "~3"), ("~", "~0")]:
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def paths(messages: DataFrame) -> DataFrame:
    """(leaf, node, up) of every path from a leaf to its root; up counts the steps.

    ``messages`` has node and parent (null at a root; a parent that is no message
    counts as none). Nodes are unique; a branch that runs into a cycle raises ValueError.
    """
    nodes = messages.select("node", "parent")
    known = nodes.select(F.col("node").alias("parent"))
    step = keep(nodes.join(known, "parent").select("node", F.col("parent").alias("above")))
    leaves = nodes.join(step.select(F.col("above").alias("node")).distinct(), "node", "left_anti").select("node")
    found = keep(leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up")))
    distance, total = 1, nodes.count()
    while step.limit(1).count():
        if distance > total:
            raise ValueError("the replies form a cycle")
        more = found.join(step, "node").select("leaf", F.col("above").alias("node"), (F.col("up") + distance).alias("up"))
        more = keep(more)
        if not more.limit(1).count():
            break
        found = found.union(more)
        far = step.withColumnRenamed("above", "mid").join(step.select(F.col("node").alias("mid"), "above"), "mid").select("node", "above")
        step, distance = keep(far), distance * 2
    return found


def chosen_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, path, node, at) of the ``top`` best branches of each tree, at counting from the root.

    A branch's score is the sum of its messages' scores (null: 0); ties go to the
    smaller leaf. ``messages`` has tree, node, parent and score.
    """
    every = paths(messages).join(messages.select("node", "tree", F.coalesce("score", F.lit(0.0)).alias("score")), "node")
    branch = every.groupBy("tree", "leaf").agg(F.sum("score").alias("score"), F.max("up").alias("depth"))
    best = branch.withColumn("path", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))).where(F.col("path") <= top)
    return every.drop("score", "tree").join(best.select("tree", "leaf", "path", "depth"), "leaf").select("tree", "path", "node", (F.col("depth") - F.col("up")).alias("at"))


def format_paths(chosen: DataFrame, messages: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(tree, path, formatted, loss) with loss an array of (start, length) in code points."""
    rows = chosen.join(messages.select("node", "role", "text"), "node")
    body = escape(F.col("text"))
    head = F.concat(F.lit("[TURN "), escape_role(F.col("role")), F.lit("]\n"))
    rows = rows.select("tree", "path", "at", F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("loss"), F.length(head).alias("head"), F.length(body).alias("size"),
                       F.concat(head, body, F.lit("[/TURN]\n")).alias("whole"))
    # Where a turn starts: behind "<s>" and the turns before it, by one running sum.
    before = Window.partitionBy("tree", "path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.coalesce(F.sum(F.length("whole")).over(before), F.lit(0)) + 3 + F.col("head")).cast("int")
    turn = F.struct("at", "loss", start.alias("start"), F.col("size").alias("length"), "whole")
    got = rows.select("tree", "path", turn.alias("turn")).groupBy("tree", "path").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return got.select("tree", "path", F.concat(F.lit("<s>"), F.array_join(F.transform("turns", lambda t: t["whole"]), ""), F.lit("</s>")).alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    inner = F.substring(formatted, F.lit(4), F.length(formatted) - 7)
    parts = F.split(inner, r"\[/TURN\]\n", -1)
    turns = F.slice(parts, 1, F.size(parts) - 1)
    return F.transform(turns, lambda t: F.struct(
        unescape(F.substring(t, F.lit(7), F.locate("]", t) - 7)).alias("role"),
        unescape(F.substring(t, F.locate("]", t) + 2, F.length(t))).alias("text")))


def conversation_messages(rows: DataFrame) -> DataFrame:
    """Messages of ``rows`` (conv_id, turn, role, text): each turn replies to the one before it.

    Rows that share a conversation and a turn follow each other by role and text; a null
    conv_id or turn sorts first, and null conversations are one.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    # Numbered first and written, so that a message's number stands and what refers to it is one long.
    named = stored(rows.select("conv_id", "turn", "role", "text").withColumn("node", F.monotonically_increasing_id())
                   .select(F.col("conv_id").alias("tree"), "node", F.lag("node").over(order).alias("parent"), "role", "text"), "messages")
    return named.select("tree", "node", "parent", F.lit(0.0).alias("score"), "role", "text")
