"""Chat formatting of reply trees, with DataFrame operations only.

Messages reply to messages. Iterated self-joins double the reach of the parent
links (1, 2, 4 ... steps up), and sum the scores on the way, so every leaf knows
the score of its path from the root after log2(depth) joins. The leaves of a
conversation are ranked by the mean score of their paths; the chosen ones are
spread along the same links, from the longest to the shortest, which gives each
path its messages and their places without a list of ids growing in any row.

A formatted conversation is a run of turns

    <|im_start|>role LF text <|im_end|> LF

In texts and roles a backslash is doubled and ``<|`` becomes ``<\\|``, so control
strings stand for turns only, and :func:`read_back` restores every text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.common import cut

START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    """Null counts as empty."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|n])", "$1")


def escaped_role(role: Column) -> Column:
    """A role ends at the line's end, so line feeds in it become backslash-n."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    backslashes = F.split(role, r"\\\\\\\\", -1)  # a doubled backslash apart, the rest is unambiguous
    return F.array_join(F.transform(backslashes, lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))), "\\")


def linear_tree(turns: DataFrame) -> DataFrame:
    """Replies of a table (conv_id, turn, role, text): each turn answers the one before.

    Turns are in the order of turn, role, text (nulls first), so ties and repeated
    rows have a place of their own. Each message scores 0.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    return turns.select("conv_id", "turn", "role", "text").withColumn("msg", F.row_number().over(order).cast("long")).select(
        "conv_id", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def paths(tree: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, leaf, rank, place, msg): the messages of the best paths of each conversation.

    tree: (conv_id, msg, parent, score), msg unique in its conversation, parent
    null for a root; a parent that is missing counts as null, a null score as 0.
    The first ``branches`` leaves by mean score stay, ties by the smaller leaf.
    Messages on a cycle have no leaf and are left out.
    """
    known = tree.select("conv_id", "msg", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    ids = known.select(F.col("conv_id").alias("c"), F.col("msg").alias("m"))
    known = cut(known.join(ids, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("m") == F.col("parent")), "left").select("conv_id", "msg", F.col("m").alias("parent"), "score"))
    # up: the message 2**k steps above, steps: how many steps there are to it or beyond the root, total: scores passed.
    links = known.select("conv_id", "msg", F.col("parent").alias("up"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("total"))
    jumps, tops = [], []
    most = max(1, known.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1)
    while True:
        # Messages whose path has come to its root are done: only the others are joined on.
        tops.append(links.filter("up is null").select("conv_id", "msg", "steps", "total"))
        active = links.filter("up is not null")
        jumps.append(active.select("conv_id", "msg", "up"))
        if (1 << len(jumps)) > most or not active.limit(1).count():
            break
        above = links.unionByName(reduce(DataFrame.unionByName, tops[:-1]).withColumn("up", F.lit(None).cast("long"))) if len(tops) > 1 else links
        above = above.select(F.col("conv_id").alias("c"), F.col("msg").alias("m"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("total").alias("total2"))
        links = cut(
            active.join(above, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("m") == F.col("up"))).select(
                "conv_id", "msg", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("total") + F.col("total2")).alias("total")
            )
        )
    roots = reduce(DataFrame.unionByName, tops)
    parents = known.select(F.col("conv_id").alias("c"), F.col("parent").alias("m")).filter("m is not null").distinct()
    leaves = roots.join(parents, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("m") == F.col("msg")), "left_anti")
    # The best leaves by repeated partial aggregates would cost a pass each; a window's rank filter keeps them before the shuffle.
    order = Window.partitionBy("conv_id").orderBy(F.desc(F.round(F.col("total") / F.col("steps"), 9)), "msg")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= branches)
    path = chosen.select("conv_id", F.col("msg").alias("leaf"), "rank", F.col("steps").alias("place"), "msg")
    for k in reversed(range(len(jumps))):
        step = jumps[k].select(F.col("conv_id").alias("c"), F.col("msg").alias("m"), "up")
        more = path.join(step, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("m") == F.col("msg")))
        path = path.unionAll(more.select("conv_id", "leaf", "rank", F.col("place") - (1 << k), F.col("up").alias("msg")))
        if k % 4 == 0:
            path = cut(path)
    return path


def conversations(tree: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, leaf, rank, formatted, spans): a row per chosen path; see :func:`paths`.

    formatted is the conversation's text. spans is the loss mask: for each
    assistant turn its number, where the turn and the text to learn start in
    formatted, and the text's length, in code points from 0. Null texts and roles
    count as empty. Other columns of ``tree`` are ignored. An empty table gives
    no rows.
    """
    path = paths(tree, branches)
    said = tree.select(F.col("conv_id").alias("c"), F.col("msg").alias("m"), escaped_role(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"), (F.coalesce("role", F.lit("")) == "assistant").alias("learnt"))
    turns = path.join(said, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("m") == F.col("msg"))).select(
        "conv_id", "leaf", "rank", "place", "learnt", F.concat(F.lit(START), "role", F.lit("\n")).alias("head"), "text"
    )
    size = F.length("head") + F.length("text") + len(END)
    so_far = Window.partitionBy("conv_id", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(size.cast("long")).over(so_far), F.lit(0).cast("long")))
    ordered = F.array_sort(F.collect_list(F.struct("place", "at", "learnt", "head", "text")))
    made = turns.groupBy("conv_id", "leaf", "rank").agg(ordered.alias("turns"))
    span = lambda x: F.struct(
        (x["place"] - 1).alias("turn"), x["at"].alias("turn_start"), (x["at"] + F.length(x["head"])).alias("start"), F.length(x["text"]).cast("long").alias("length")
    )
    return made.select(
        "conv_id",
        "leaf",
        "rank",
        F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["text"], F.lit(END))), "").alias("formatted"),
        F.transform(F.filter("turns", lambda x: x["learnt"]), span).alias("spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds what the output of :func:`conversations` says: turns (role, text) and loss_texts, unescaped."""
    bodies = F.split(F.col("formatted"), r"<\|im_end\|>\n", -1)
    bodies = F.slice(bodies, F.lit(1), F.size(bodies) - 1)
    role = lambda x: F.substring_index(F.substr(x, F.lit(len(START) + 1)), "\n", 1)
    with_bodies = formatted.withColumn("bodies", bodies)
    turn = lambda x: F.struct(unescaped_role(role(x)).alias("role"), unescaped(F.substr(x, F.length(role(x)) + len(START) + 2)).alias("text"))
    learnt = lambda s: unescaped(F.substr(F.get("bodies", s["turn"].cast("int")), (s["start"] - s["turn_start"] + 1).cast("int"), s["length"].cast("int")))
    return with_bodies.withColumn("turns", F.transform("bodies", turn)).withColumn("loss_texts", F.transform("spans", learnt)).drop("bodies")


def digests(turns: DataFrame) -> DataFrame:
    """Each linear conversation formatted and read back: counts and digests.

    turns: (conv_id, turn, role, text); null text or role counts as empty. See
    :func:`linear_tree` for ties. A conversation's own text is the largest thing
    that one task holds.
    """
    read = read_back(conversations(cut(linear_tree(turns))))
    loss = F.array_join("loss_texts", "")
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
