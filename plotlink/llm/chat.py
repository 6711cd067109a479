"""Chat formatting of reply trees.

Messages form trees by parent. Iterated self-joins double the reach of every message's ancestor link, so a tree of
depth d takes about log2(d) rounds: they give each message its root, depth and summed score, and then the
messages of each chosen root-to-leaf path. Branches are ranked by mean score and formatted as one conversation.

The template writes a turn as <|im_start|>role, a line feed, the text, <|im_end|> and a line feed. Inside roles and
texts "&" becomes "&amp;" and the first character of every control string an entity, so no text can open or close a
turn and the original comes back exactly.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotlink.llm import common

TURN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common chat templates (fixed values).
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
ENTITIES = {"<": "&lt;", "[": "&#91;"}


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(ENTITIES[c[0]] + c[1:]))
    return out


def unescape(text: Column) -> Column:
    out = text
    for char, entity in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    """A role is one line: its line feeds are entities too."""
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def chains(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as reply trees: each row answers the one before it by (turn, role, text).

    Nulls sort first in turn, role and text; null roles and texts are empty. Rows that repeat are turns of
    their own.
    """
    rows = turns.select(conv, turn, role, text).toDF("tree", "turn", "role", "text")
    at = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    return rows.select("tree", at.alias("node"), F.when(at > 1, at - 1).alias("parent"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0.0).alias("score"))


def paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """The best root-to-leaf paths of each tree: tree, leaf, rank, depth (0 at the root), node.

    messages: tree, node, parent (null at roots), score. Branches rank by mean score, then by least leaf. A
    message whose parent is missing is a root of its own; null scores count as 0. A tree key may be null.
    """
    base = messages.select(common.stratum_key(F.col("tree").cast("string")).alias("t"), "tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    ids = base.select("t", F.col("node").alias("parent"))
    known = base.join(ids.withColumn("has", F.lit(True)), ["t", "parent"], "left").withColumn("parent", F.when(F.col("has"), F.col("parent"))).drop("has")
    # jump: the ancestor 2^k steps up (null beyond the root); depth and total cover the steps taken so far.
    links = common.stored(known.select("t", "tree", "node", F.col("parent").alias("jump"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), "score", F.col("score").alias("total")), "tree-links")
    # Only messages that have not reached their root take part in a round: of short trees nothing is left after a few.
    open_, settled, levels = links.where("jump is not null"), [links.where("jump is null")], []
    while not open_.isEmpty():
        if len(levels) > 40:
            raise ValueError("parents form a cycle")
        levels.append(open_.select("t", "node", "jump"))
        up = links.select("t", F.col("node").alias("jump"), F.col("jump").alias("u_jump"), F.col("depth").alias("u_depth"), F.col("total").alias("u_total"))
        stepped = open_.join(up, ["t", "jump"]).select("t", "tree", "node", F.col("u_jump").alias("jump"), (F.col("depth") + F.col("u_depth")).alias("depth"), "score", (F.col("total") + F.col("u_total")).alias("total"))
        stepped = common.stored(stepped, "tree-links")
        settled.append(stepped.where("jump is null"))
        open_ = stepped.where("jump is not null")
        links = functools.reduce(DataFrame.unionByName, [*settled, open_])
    leaves = links.join(known.where("parent is not null").select("t", F.col("parent").alias("node")).distinct(), ["t", "node"], "left_anti")
    order = Window.partitionBy("t").orderBy((F.col("total") / (F.col("depth") + 1)).desc(), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("t", "tree", F.col("node").alias("leaf"), "rank", "depth")
    # Every round adds the 2^k-th ancestors of what is known, so the set doubles until it is the whole path.
    on_path = common.stored(chosen.select("t", "tree", "leaf", "rank", "depth", F.col("leaf").alias("node")), "tree-paths")
    for k, level in enumerate(levels):
        more = on_path.join(level, ["t", "node"]).select("t", "tree", "leaf", "rank", (F.col("depth") - (1 << k)).alias("depth"), F.col("jump").alias("node"))
        on_path = common.stored(on_path.unionByName(more), "tree-paths")
    return on_path


def format_paths(messages: DataFrame, best: int = 1, trained_role: str = "assistant") -> DataFrame:
    """tree, leaf, rank, formatted, loss_spans (start and length in code points of formatted, one for each text
    of the trained role) for each chosen path."""
    chosen = paths(messages, best)
    body = messages.select(common.stratum_key(F.col("tree").cast("string")).alias("t"), "node", escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == trained_role).alias("trained"))
    turns = chosen.join(body, ["t", "node"]).withColumn("head", F.concat(F.lit(TURN), "role", F.lit("\n")))
    turns = turns.groupBy("t", "tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "head", "text", "trained"))).alias("turns"))
    formatted = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["head"], x["text"], F.lit(CLOSE))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["head"])
        span = F.struct(begin.cast("long").alias("start"), F.length(x["text"]).cast("long").alias("length"))
        return F.struct((begin + F.length(x["text"]) + len(CLOSE)).cast("long").alias("at"), F.when(x["trained"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate("turns", start, step)["spans"]
    return turns.select("tree", "leaf", "rank", formatted.alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>, unescaped."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, F.greatest(F.lit(1), F.length(formatted)))

    def turn(x: Column) -> Column:
        head = F.substring_index(x, "\n", 1)
        text = F.substring(x, F.length(head) + 2, F.length(x) - F.length(head) - 1 - len(CLOSE))
        return F.struct(unescape_role(head).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def read_back(conversations: DataFrame) -> DataFrame:
    """Digests of what formatted conversations hold, worked out from the formatted text and the mask alone."""
    turns = F.concat_ws("", F.transform(parse(F.col("formatted")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))))
    out = conversations.select(F.col("tree").alias("conv_id"), F.size(parse(F.col("formatted"))).cast("long").alias("n_turns"), turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", F.sha2(common.utf8_bytes(F.col("turns")), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(common.utf8_bytes(F.col("loss")), 256).alias("loss_sha256"), "formatted_chars")


def format_conversations(turns: DataFrame) -> DataFrame:
    """The contract's query over linear conversations and the planted conversation -7.

    Null texts and roles are empty; rows go by turn, then role and text where turns tie; repeated rows stay.
    An empty table leaves conversation -7 alone.
    """
    spark = turns.sparkSession
    planted = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    rows = turns.select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = common.stored(chains(rows), "messages")
    return read_back(format_paths(messages))
