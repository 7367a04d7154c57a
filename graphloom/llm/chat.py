"""Operator 6, chat formatting of reply trees, in DataFrame functions alone.

Messages name the message they reply to. Iterative self-joins double the distance to an ancestor each time, so
a tree of depth d takes log2(d) joins; they give each leaf its depth and the score of its branch. The best leaf of
a conversation (highest mean score, then longest, then smallest node) decides which path is formatted. Trees are searched without their
texts; these are shuffled once, when the chosen path is put together.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside texts and roles ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|``
(and a line break in a role ``&#10;``), so that only the template can hold a control string; undoing it in reverse order gives the
exact text back. The loss mask is a list of [start, end) spans, in code points, around the assistant's texts.

Defined results: null texts and roles are empty; rows with equal turns are ordered by role and text and all kept; rows with a null conversation form one, and those
with a null turn come first in theirs; where parents form a cycle it is cut at its smallest node, which becomes a root; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, save

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    # A role's own "&#10;" was escaped to "&amp;#10;", so this can't meet it.
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def linear_tree(turns: DataFrame) -> DataFrame:
    """Rows by turn as a tree without branches: conv_id, node, parent, score. A node is a struct (turn, role), so that its place needs no text; rows that share it belong to one node."""
    order = Window.partitionBy("conv_id").orderBy("node")
    nodes = turns.select("conv_id", F.struct("turn", "role").alias("node")).distinct()
    return nodes.select("conv_id", "node", F.lag("node").over(order).alias("parent"), F.lit(1.0).alias("score"))


def ladder_of(light: DataFrame) -> tuple[list[DataFrame], list[str]]:
    """Tables of jumps (conv_id, node, up, depth, gained), each twice as far as the one before: the ancestor ``depth`` steps above, and the scores of those steps.

    The last one reaches every root; nodes that still have an ``up`` in it after log2(nodes) rounds are on or below a cycle.
    """
    most = light.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    jumps = light.select("conv_id", "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("gained"))
    ladder, paths = [jumps], []
    for _ in range(int(most).bit_length() + 1):
        now = ladder[-1]
        if not now.filter("up IS NOT NULL").limit(1).count():
            break
        above = now.select("conv_id", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("gained").alias("gained2"))
        # Nodes whose jump has come to the root take no further part.
        step = now.filter("up IS NOT NULL").join(above, ["conv_id", "up"]).select("conv_id", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("gained") + F.col("gained2")).alias("gained"))
        step, path = save(now.filter("up IS NULL").select("conv_id", "node", "up", "depth", "gained").unionByName(step), "jumps")
        ladder.append(step)
        paths.append(path)
    return ladder, paths


def without_cycles(light: DataFrame, last: DataFrame) -> DataFrame:
    """``light`` with the smallest node of each cycle made a root. ``last`` is the ladder's longest jump, which from on or below a cycle ends on it."""
    ring = last.filter("up IS NOT NULL").select("conv_id", F.col("up").alias("node")).distinct()
    steps = light.join(ring, ["conv_id", "node"], "left_semi").select("conv_id", "node", F.col("parent").alias("up"), F.col("node").alias("least"))
    for _ in range(int(ring.groupBy("conv_id").count().agg(F.max("count")).first()[0]).bit_length() + 1):
        steps, _ = save(steps, "ring")
        above = steps.select("conv_id", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("least").alias("least2"))
        steps = steps.join(above, ["conv_id", "up"]).select("conv_id", "node", F.col("up2").alias("up"), F.least("least", "least2").alias("least"))
    cut = steps.filter(F.col("node") == F.col("least")).select("conv_id", "node", F.lit(True).alias("cut"))
    marked = light.join(cut, ["conv_id", "node"], "left")
    return marked.select("conv_id", "node", F.when(F.col("cut").isNull(), F.col("parent")).alias("parent"), "score")


def chosen_paths(tree: DataFrame) -> DataFrame:
    """(conv_id, node, depth) of the best branch of each conversation.

    ``tree`` has one row for each (conv_id, node), with conv_id not null; a parent that doesn't exist makes its child a root.
    """
    spark = tree.sparkSession
    names = tree.select("conv_id", F.col("node").alias("parent"))
    links = tree.select("conv_id", "node", "parent", "score").join(names.withColumn("known", F.lit(True)), ["conv_id", "parent"], "left")
    light, base = save(links.select("conv_id", "node", F.when(F.col("known"), F.col("parent")).alias("parent"), "score"), "tree")
    ladder, paths = ladder_of(light)
    if ladder[-1].filter("up IS NOT NULL").limit(1).count():
        light, cut = save(without_cycles(light, ladder[-1]), "tree")
        discard(spark, *paths)
        ladder, paths = ladder_of(light)
        paths.append(cut)
    leaves = light.join(light.select("conv_id", F.col("parent").alias("node")), ["conv_id", "node"], "left_anti").select("conv_id", "node")
    scored = ladder[-1].join(leaves, ["conv_id", "node"])
    rank = F.struct(-F.round(F.col("gained") / F.col("depth"), 9), -F.col("depth"), "node")
    best = scored.groupBy("conv_id").agg(F.min_by(F.struct("node", "depth"), rank).alias("b"))
    reached, path = save(best.select("conv_id", "b.node", "b.depth"), "leaves")
    paths.append(path)
    # Back down the ladder, by the longest jumps first: each one doubles the part of the path that is known. A step refers to
    # the part known so far twice, so that part is written and read again.
    for step in reversed(ladder[:-1]):
        hops = step.filter("up IS NOT NULL").select("conv_id", "node", "up", F.col("depth").alias("by"))
        more = reached.join(hops, ["conv_id", "node"]).select("conv_id", F.col("up").alias("node"), (F.col("depth") - F.col("by")).alias("depth"))
        reached, path = save(reached.unionByName(more).distinct(), "reached")
        paths.append(path)
    discard(spark, base, *paths[:-1])
    return reached


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans of the chosen path of each conversation. ``messages``: conv_id, node, role, text.

    Messages and places go into one shuffle by conversation, so texts move once.
    """
    both = messages.select("conv_id", "node", "role", "text", F.lit(None).cast("long").alias("depth")).unionByName(paths.select("conv_id", "node", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "depth"))
    dealt = both.repartition("conv_id").withColumn("place", F.max("depth").over(Window.partitionBy("conv_id", "node")))
    head, body = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    made = dealt.filter("depth IS NULL AND place IS NOT NULL").withColumns({"head": F.length(head), "whole": F.concat(head, body, F.lit(f"{END}\n"))})
    # Where each turn begins: a running sum over the rows, as appending to an array would copy it for each turn.
    order = Window.partitionBy("conv_id").orderBy("place", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    made = made.withColumn("begin", F.coalesce(F.sum(F.length("whole")).over(order), F.lit(0)))
    turns = made.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("begin", "role", "head", "whole"))).alias("turns"))
    own = F.filter("turns", lambda t: t["role"] == "assistant")
    spans = F.transform(own, lambda t: F.struct((t["begin"] + t["head"]).cast("int").alias("start"), (t["begin"] + F.length(t["whole"]) - len(END) - 1).cast("int").alias("end")))
    return turns.select("conv_id", F.concat_ws("", F.transform("turns", lambda t: t["whole"])).alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def parse(part: Column) -> Column:
        cut = F.instr(part, "\n")
        role = F.substring(part, F.lit(1), cut - 1)
        text = F.substring(part, cut + 1, F.length(part) - cut - len(END) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, parse)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order with nothing between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))))


def op6_chat(turns: DataFrame) -> DataFrame:
    spark = turns.sparkSession
    said = f"{END}{START}assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(own)
    # Joins compare ids by equality, so a null one is carried as a value.
    rows = rows.withColumns({"conv_id": F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("id")), "role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    rows = rows.withColumn("turn", F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn")))
    messages = rows.select("conv_id", F.struct("turn", "role").alias("node"), "role", "text")
    out = format_paths(messages, chosen_paths(linear_tree(rows)))
    back = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said_back = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        F.when(~F.col("conv_id.none"), F.col("conv_id.id")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said_back, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
