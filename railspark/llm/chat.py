"""Chat formatting of reply trees with DataFrame functions only (operator 9).

Messages point at the message they reply to.  Iterative self-joins that double the distance
(parent, grandparent, 4th ancestor, ...) give every message its root, depth and path score, so a
tree of depth d takes log2(d) joins; the leaves of a tree are ranked by path score, and the same
distances walk the chosen leaves back to their root.  Each chosen path becomes one conversation
in a template that escapes control strings, with a loss mask over the assistant's text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import written

START, SEP, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common chat templates; a text never shows one after escaping.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    r"""Doubles backslashes, then puts one after the first character of every control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), sorted(CONTROLS, key=len, reverse=True), text)


def unescape(text: Column) -> Column:
    """The text before ``escape``: every backslash stands for the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, depth, node): the nodes of the ``branches`` best root-to-leaf paths of each tree.

    ``messages``: tree, node, parent (null at a root), score; nodes are unique in a tree.  A
    path's score is the sum of its messages' scores (null as 0); ties go to the smaller leaf.
    Messages whose parent is missing are roots; messages on a cycle belong to no path.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_p"))
    nodes = nodes.join(known, nodes["tree"].eqNullSafe(F.col("_t")) & (nodes["parent"] == F.col("_p")), "left") \
        .select("tree", "node", F.col("_p").alias("up"), "score")
    # up: the ancestor 2**k above; depth and total: of the path from the message up to, without, it
    cur = written(nodes.withColumn("depth", F.lit(1)).withColumnRenamed("score", "total"))
    jumps, known_roots = [], -1
    while not (open_ := cur.filter("up is not null")).isEmpty():
        if len(jumps) > 1 and (roots := cur.filter("up is null").count()) == known_roots:
            break  # what is left points around a cycle
        elif len(jumps) > 1:
            known_roots = roots
        jumps.append(open_)
        above = cur.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"),
                           F.col("depth").alias("_d"), F.col("total").alias("_s"))
        # only messages that have not met their root go on
        further = open_.join(above, open_["tree"].eqNullSafe(F.col("_t")) & (open_["up"] == F.col("_n"))) \
            .select("tree", "node", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"),
                    (F.col("total") + F.col("_s")).alias("total"))
        cur = written(cur.filter("up is null").select("tree", "node", "up", "depth", "total").unionByName(further))
    done = cur.filter("up is null")
    leaves = done
    if jumps:
        parents = jumps[0].select(F.col("tree").alias("_t"), F.col("up").alias("_u")).distinct()
        leaves = done.join(parents, done["tree"].eqNullSafe(F.col("_t")) & (done["node"] == F.col("_u")), "left_anti")
    best = leaves.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("total"), "node"))) \
        .filter(F.col("rank") <= branches)
    walk = best.select("tree", F.col("node").alias("leaf"), "rank", "depth", "node")
    for hop, jump in reversed(list(enumerate(jumps))):
        walk = written(walk)  # used twice below
        up = jump.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"))
        higher = walk.join(up, walk["tree"].eqNullSafe(F.col("_t")) & (walk["node"] == F.col("_n"))) \
            .select("tree", "leaf", "rank", (F.col("depth") - (1 << hop)).alias("depth"), F.col("_up").alias("node"))
        walk = walk.unionByName(higher)
    return walk


def format_paths(path_rows: DataFrame, messages: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, loss_spans): one conversation a path, spans (start, end) of the
    assistant's escaped texts in code points of ``formatted``.

    ``messages`` brings role and text (null: empty).  One conversation is one string, so its
    turns come together in one row.
    """
    said = messages.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.coalesce("role", F.lit("")).alias("role"),
                           F.coalesce("text", F.lit("")).alias("text"))
    turns = path_rows.join(said, path_rows["tree"].eqNullSafe(F.col("_t")) & (path_rows["node"] == F.col("_n"))) \
        .withColumn("_head", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))) \
        .withColumn("_body", escape(F.col("text")))
    before = F.coalesce(F.sum(F.char_length("_head") + F.char_length("_body") + len(END)).over(
        W.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = before + F.char_length("_head")
    turns = turns.withColumn("_span", F.when(F.col("role") == "assistant", F.struct(
        start.cast("long").alias("start"), (start + F.char_length("_body")).cast("long").alias("end"))))
    return turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct(
        "depth", F.concat("_head", "_body", F.lit(END)).alias("piece"), "_span"))).alias("_all")) \
        .select("tree", "leaf", F.array_join(F.transform("_all", lambda t: t["piece"]), "").alias("formatted"),
                F.filter(F.transform("_all", lambda t: t["_span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with turns array<struct<role,text>> and loss_text, read from the string alone
    (and the spans), unescaped."""
    parts = F.split("formatted", START.replace("|", r"\|"))
    bodies = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    plain = F.transform(bodies, lambda b: F.struct(
        unescape(F.substring_index(b, SEP, 1)).alias("role"),
        unescape(F.substr(b, F.instr(b, SEP) + len(SEP), F.char_length(b) - F.instr(b, SEP) + 1 - len(SEP) - len(END))).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(
        F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return formatted.withColumn("turns", plain).withColumn("loss_text", loss)


def chains(conversations: DataFrame, tree: str = "conv_id", order: str = "turn") -> DataFrame:
    """Flat conversations as messages: each row replies to the row before it in ``order``.

    Rows that tie in ``order`` follow by role, then text; every row is a turn, repeats too.
    """
    by = W.partitionBy("tree").orderBy("_turn", "role", "text")
    rows = conversations.select(conversations[tree].cast("long").alias("tree"), conversations[order].cast("long").alias("_turn"),
                                conversations["role"].cast("string").alias("role"), conversations["text"].cast("string").alias("text"))
    return rows.withColumn("node", F.row_number().over(by).cast("long")) \
        .withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(1.0)).drop("_turn")


def digests(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each tree's best path."""
    messages = written(messages)
    back = read_back(format_paths(paths(messages), messages))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(whole, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))
