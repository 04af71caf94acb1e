"""Operator 8: chat formatting of reply trees. DataFrame functions only.

Messages point to the message that they answer. Iterative self-joins, which double the distance they reach each round,
give every path from root to leaf with the mean score of its messages; by that these branches are ranked within their
tree, and each chosen one is laid out and becomes a single conversation. The template marks turns with control strings. Any control string inside a role or
text gets a mark (U+2060) after its first character, one more if marks are there already, so that no text can be taken
for a turn and the change can be taken back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, column, staged

#: What the template writes around role and text.
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of this and of other common templates, all escaped inside texts.
CONTROL = [START, MIDDLE, END, "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
MARK = "\u2060"


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "\\^$.|?*+()[]{}" else c for c in text)


_REST = "|".join(_quoted(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))


def escape(text: Column) -> Column:
    """Break every control string."""
    return F.regexp_replace(text, rf"([<\[])({MARK}*)(?=(?:{_REST}))", f"$1$2{MARK}")


def unescape(text: Column) -> Column:
    """Take :func:`escape` back."""
    return F.regexp_replace(text, rf"([<\[])({MARK}*){MARK}(?=(?:{_REST}))", "$1$2")


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys meet null keys."""
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [left[k].eqNullSafe(right[f"__{k}"]) for k in keys]
    return left.join(right, on, how).drop(*[f"__{k}" for k in keys])


def climb(messages: DataFrame, work: Scratch) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Jumps, whole paths, and trees that are set aside, of ``tree, node, parent, score`` with nodes unique within a tree.

    Self-joins double the distance that they reach: after k of them each message knows its ancestor 2**k above and the sum of
    the scores below that one. Jumps are a table ``tree, node, to`` for each k. Paths, ``tree, node, depth, score``, are those of
    all messages up to a root, with the mean score of their messages (null counts as 0). A path has no more messages than its tree, so
    what still climbs after that many steps goes in a circle: those trees are set aside, ``tree, reason``. Messages
    whose ancestors are missing have no path.
    """
    links = work.table(messages.select("tree", "node", F.col("parent").alias("to"), F.coalesce("score", F.lit(0.0)).alias("sum"), F.lit(1).cast("long").alias("n")), "links")
    largest = links.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    now, done, jumps = links, [links.filter("to is null")], []
    for _ in range(int(largest).bit_length()):
        now = work.table(now.filter("to is not null"), "jumps")
        if now.isEmpty():
            break
        jumps.append(now.select("tree", "node", "to"))
        known = reduce(DataFrame.union, done).union(now)
        above = known.select("tree", F.col("node").alias("to"), F.col("to").alias("next"), F.col("sum").alias("more"), F.col("n").alias("further"))
        now = work.table(_join(now, above, ["tree", "to"]).select("tree", "node", F.col("next").alias("to"), (F.col("sum") + F.col("more")).alias("sum"), (F.col("n") + F.col("further")).alias("n")), "climbed")
        done.append(now.filter("to is null"))
    circles = now.filter("to is not null").select("tree").distinct().withColumn("reason", F.lit("answers go in a circle"))
    whole = reduce(DataFrame.union, done).select("tree", "node", F.col("n").alias("depth"), (F.col("sum") / F.col("n")).alias("score"))
    return jumps, whole, work.table(circles, "circles")


def rank_branches(messages: DataFrame, whole: DataFrame) -> DataFrame:
    """``tree, leaf, depth, score, rank`` of each path from a root to a leaf: by the mean score of its messages, then the leaf."""
    answered = messages.filter("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = _join(whole, answered, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    return leaves.select("tree", F.col("node").alias("leaf"), "depth", "score").withColumn("rank", F.row_number().over(best))


def branch_steps(leaves: DataFrame, jumps: list[DataFrame], work: Scratch) -> DataFrame:
    """``tree, leaf, node, up``: every message on the path above each of the ``leaves`` (``tree, leaf``), ``up`` steps above it.

    A path is laid out from the longest jump to the shortest; only paths that are asked for are.
    """
    steps = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(jumps))):
        steps = work.table(steps, "steps")
        steps = steps.union(_join(steps, jumps[k], ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), F.col("up") + (1 << k)))
    return steps


def format_trees(messages: DataFrame, *, per_tree: int = 1, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``tree, leaf, rank, score, n_turns, formatted, loss, reason``: the ``per_tree`` best branches of each tree as conversations, a staged table.

    ``messages``: ``tree, node, parent, role, text, score``. Null roles and texts are empty. Equal scores are ranked by
    the leaf's number. ``loss`` holds start (from 1) and length, in characters of ``formatted``, of each text whose role is
    in ``loss_roles``. Rows of a null tree form one tree. A tree in which answers go in a circle is set aside: one row with a
    ``reason`` (else null) and nothing formatted.
    """
    with Scratch(messages.sparkSession, "chat") as work:
        messages = work.table(messages, "messages")
        jumps, whole, circles = climb(messages, work)
        ranked = rank_branches(messages, whole).filter(F.col("rank") <= per_tree)
        chosen = work.table(_join(ranked, circles, ["tree"], "left_anti"), "chosen")
        steps = _join(branch_steps(chosen, jumps, work), chosen.select("tree", "leaf", "rank", "score"), ["tree", "leaf"]).select("tree", "leaf", "rank", "score", (-F.col("up")).alias("at"), "node")
        said = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        turn = F.struct("at", (F.concat(F.lit(START), escape(F.col("role")), F.lit(MIDDLE))).alias("head"), escape(F.col("text")).alias("body"), F.col("role").isin(*loss_roles).alias("learn"))
        turns = _join(steps, said, ["tree", "node"]).groupBy("tree", "leaf", "rank", "score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

        def piece(t: Column) -> Column:
            return F.concat(t["head"], t["body"], F.lit(END))

        begin = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

        def add(acc: Column, t: Column) -> Column:
            span = F.struct((acc["next"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))
            return F.struct((acc["next"] + F.length(piece(t))).alias("next"), F.when(t["learn"], F.concat(acc["loss"], F.array(span))).otherwise(acc["loss"]).alias("loss"))

        out = turns.select(
            "tree", "leaf", "rank", "score", F.size("turns").cast("long").alias("n_turns"),
            F.array_join(F.transform("turns", piece), "").alias("formatted"),
            F.aggregate("turns", begin, add)["loss"].alias("loss"), F.lit(None).cast("string").alias("reason"),
        )
        return staged(out.unionByName(circles, allowMissingColumns=True), "chat")


def read_turns(formatted: Column) -> Column:
    """Roles and texts of a formatted conversation, in order."""
    parts = F.split(formatted, _quoted(END))
    turns = F.slice(parts, 1, F.size(parts) - 1)
    return F.transform(turns, lambda t: F.struct(
        unescape(F.substring_index(F.substring(t, len(START) + 1, F.length(t)), MIDDLE, 1)).alias("role"),
        unescape(F.substring(t, F.locate(MIDDLE, t) + len(MIDDLE), F.length(t))).alias("text"),
    ))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"], s["length"]))), "")


def conversation_messages(rows: DataFrame) -> DataFrame:
    """Messages of a table of turns (``conv_id, turn, role, text``): each answers the one before it in its conversation.

    Turns that repeat follow each other in the order of role and text; null turns come first.
    """
    fields = {c: column(rows, c, k) for c, k in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))}
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    numbered = rows.select(fields["conv_id"].alias("tree"), fields["turn"].alias("turn"), fields["role"].alias("role"), fields["text"].alias("text")).withColumn("node", F.row_number().over(order))
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digest(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of formatted conversations."""
    text = loss_text(F.col("formatted"), F.col("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = formatted.select("tree", "formatted", read_turns(F.col("formatted")).alias("turns"), text.alias("learned"))
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -1, formatted, written, and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = "'</s>[INST] ok [/INST]'"
    extra = spark.range(2).selectExpr("-1L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"{text} as text")
    return digest(format_trees(conversation_messages(rows.union(extra))).filter("reason is null"))


_FIXED = len(START) + len(MIDDLE) + len(END)
_BROKEN = f"regexp_replace({{}}, '([<\\[])(\u2060*)({_REST})', '\\1\\2\u2060\\3', 'g')"

OP8_SQL = f"""
with c as (select conv_id, turn, role, text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from c),
g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as said,
  coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '') as learned,
  sum(length({_BROKEN.format("role")}) + length({_BROKEN.format("text")}) + {_FIXED}) as formatted_chars from t group by conv_id)
select conv_id, n_turns, sha256(said) as turns_sha256, length(learned) as loss_chars, sha256(learned) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars from g
"""
