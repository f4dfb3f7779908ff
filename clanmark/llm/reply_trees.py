"""Chat formatting of reply trees with DataFrame operations only.

A table of messages (tree, node, parent, role, text, score) is a forest.  Self-joins that double
their reach in each round give every node its depth and the summed score of its path; the leaves of
a tree are its branches, ranked by that score; further self-joins enumerate the messages on the
paths of the chosen branches, and each path is formatted as one conversation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clanmark.llm.base import col
from clanmark.sources.workspace import materialize, release

#: Characters that control strings begin with, and how a text writes them; `&` goes first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
LINE_BREAK = ("\n", "&nl;")


@dataclass(frozen=True)
class Template:
    """How a turn is marked: control strings before and after the text of each role.

    No control string may begin with a character that ``ESCAPES`` doesn't replace.  Other roles than
    user and assistant stand by name, escaped, on the first line between ``other``.
    """

    user: tuple[str, str] = ("[INST] ", "[/INST]")
    assistant: tuple[str, str] = ("<s>", "</s>")
    other: tuple[str, str] = ("<<SYS>>", "<</SYS>>")


TEMPLATE = Template()


def escape(text: Column) -> Column:
    """The text without any character that a control string begins with; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for plain, written in ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(written))
    return out


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    out = text
    for plain, written in reversed(ESCAPES):
        out = F.replace(out, F.lit(written), F.lit(plain))
    return out


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(LINE_BREAK[0]), F.lit(LINE_BREAK[1]))


def _unescape_role(role: Column) -> Column:
    # A role's own "&nl;" was written "&amp;nl;", so this pattern only meets line breaks.
    return unescape(F.replace(role, F.lit(LINE_BREAK[1]), F.lit(LINE_BREAK[0])))


def linear(messages: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations by turn as trees of one branch: each message answers the one before.

    Null turns come first; equal turns are ordered by role and text, so repeated rows follow each
    other.  Rows of a null conversation are one conversation.
    """
    own = messages.select(
        col(tree).cast("long").alias("tree"), col(turn).alias("turn"), col(role).cast("string").alias("role"),
        col(text).cast("string").alias("text"),
    )
    order = Window.partitionBy("tree").orderBy(F.asc("turn"), F.asc("role"), F.asc("text"))
    numbered = own.withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, depth, total, leaf) of (tree, node, parent, score); the jumps of the rounds.

    Each round joins the table with itself: a jump over 2^i parents follows two over 2^(i-1).  Only
    nodes that have not reached their root go on, so a long path does not make others wait.  A parent
    that is not in the tree makes its child a root.  A tree of depth d takes log2(d) + 1 rounds.

    A circle of parents has no root: messages on one, or below one, are left out.  They are what goes
    on after as many rounds as the largest tree could need.  Nodes must be unique in their tree.
    """
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(1).alias("_known")).distinct()
    state = materialize(
        nodes.join(known, ["tree", "parent"], "left").select(
            "tree",
            "node",
            F.when(F.col("_known").isNotNull(), F.col("parent")).alias("up"),
            F.lit(1).cast("long").alias("depth"),
            F.coalesce("score", F.lit(0.0)).cast("double").alias("total"),
        ),
        "jumps",
    )
    parents = state.where("up IS NOT NULL").select("tree", F.col("up").alias("node"), F.lit(1).alias("_parent")).distinct()
    largest = state.groupBy("tree").count().agg(F.max("count").alias("n")).first()["n"] or 0
    ended, jumps = state.where("up IS NULL"), []
    while len(jumps) <= int(largest).bit_length() and not (going := state.where("up IS NOT NULL")).isEmpty():
        jumps.append(going)
        above = ended.unionByName(going).select(
            "tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("total").alias("_t")
        )
        moved = going.join(above, ["tree", "up"]).select(
            "tree",
            "node",
            F.col("_up").alias("up"),
            (F.col("depth") + F.col("_d")).alias("depth"),
            (F.col("total") + F.col("_t")).alias("total"),
        )
        state = materialize(moved, "jumps")
        ended = ended.unionByName(state.where("up IS NULL"))
    marked = ended.join(parents, ["tree", "node"], "left")
    return marked.select("tree", "node", "depth", "total", F.col("_parent").isNull().alias("leaf")), jumps


def branches(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, branch, node, position): the messages of the ``best`` branches of each tree (None: all).

    Branches rank by the mean score of their messages, then by length, then by the lowest leaf.
    """
    ends, jumps = paths(nodes)
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), F.asc("node"))
    ranked = ends.where("leaf").withColumn("branch", F.row_number().over(order))
    chosen = ranked.where(F.col("branch") <= best) if best else ranked
    found = materialize(chosen.select("tree", "branch", "node", F.col("depth").alias("position")), "branches")
    for i, jump in enumerate(jumps):
        up = jump.select("tree", "node", "up")
        position = (F.col("position") - (1 << i)).alias("position")
        higher = found.join(up, ["tree", "node"]).select("tree", "branch", F.col("up").alias("node"), position)
        before, found = found, materialize(found.unionByName(higher), "branches")
        release(before)
    return found


def format_paths(messages: DataFrame, best: int | None = 1, template: Template = TEMPLATE, unique: bool = False) -> DataFrame:
    """(tree, branch, formatted, loss): each chosen branch of (tree, node, parent, role, text, score)
    as one string, and the spans of code points that the loss is taken over.

    ``loss``: array of (start, length), start from 0: the assistants' texts as they are written.
    Null texts and roles are empty.  Texts may hold any string: what begins a control string is
    escaped reversibly.

    Of messages with the same tree and node the least one (by parent, role, text and score) counts; ``unique`` says
    that there are none and saves the look.  A message without a node number is left out; one whose parents lead
    into a circle is on no branch.
    """
    # Inside a struct a null tree is a key like any other.
    own = messages.withColumn("tree", F.struct(F.col("tree").alias("key")))
    if not unique:
        least = F.min(F.struct("parent", "role", "text", "score")).alias("own")
        own = materialize(own.where("node IS NOT NULL").groupBy("tree", "node").agg(least).select("tree", "node", "own.*"), "messages")
    turns = branches(own, best).join(own.select("tree", "node", "role", "text"), ["tree", "node"])
    written = escape(F.col("text"))
    role = F.coalesce("role", F.lit(""))
    marked = (
        F.when(role == "user", F.concat(F.lit(template.user[0]), written, F.lit(template.user[1])))
        .when(role == "assistant", F.concat(F.lit(template.assistant[0]), written, F.lit(template.assistant[1])))
        .otherwise(F.concat(F.lit(template.other[0]), _escape_role(role), F.lit("\n"), written, F.lit(template.other[1])))
    )
    turns = turns.select("tree", "branch", "position", marked.alias("marked"), (role == "assistant").alias("learned"))
    before, after = (len(mark) for mark in template.assistant)
    earlier = Window.partitionBy("tree", "branch").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    length = F.char_length("marked").cast("long")
    placed = turns.select(
        "tree", "branch", "position", "marked", "learned",
        (F.coalesce(F.sum(length).over(earlier), F.lit(0)) + before).cast("long").alias("start"),
        (length - before - after).alias("length"),
    )
    turn = F.struct("position", "marked", "learned", "start", "length")
    lists = placed.groupBy("tree", "branch").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda turn: turn["marked"]), "")
    spans = F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return lists.select("tree.key", "branch", formatted.alias("formatted"), spans.alias("loss")).withColumnRenamed("key", "tree")


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """Array of (role, text) of a formatted string: the inverse of ``format_paths``."""
    inner = r"[^<\[]*"
    kinds = (template.user, template.assistant, template.other)
    pattern = "|".join(f"{_quoted(a)}{inner}{_quoted(b)}" for a, b in kinds)
    turns = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0))

    def between(turn: Column, marks: tuple[str, str]) -> Column:
        return F.substring(turn, F.lit(len(marks[0]) + 1), F.char_length(turn) - len(marks[0]) - len(marks[1]))

    def read(turn: Column) -> Column:
        named = between(turn, template.other)
        line = F.instr(named, "\n")
        role = (
            F.when(turn.startswith(template.user[0]), F.lit("user"))
            .when(turn.startswith(template.other[0]), _unescape_role(F.substring(named, F.lit(1), line - 1)))
            .otherwise(F.lit("assistant"))
        )
        text = (
            F.when(turn.startswith(template.user[0]), between(turn, template.user))
            .when(turn.startswith(template.other[0]), F.substring(named, line + 1, F.char_length(named)))
            .otherwise(between(turn, template.assistant))
        )
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(turns, read)


def _quoted(mark: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " else c for c in mark)


def read_loss(formatted: Column, loss: Column) -> Column:
    """What the loss mask covers, unescaped, one span after the other."""
    texts = F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(texts, "")


def digests(messages: DataFrame, template: Template = TEMPLATE, unique: bool = False) -> DataFrame:
    """What can be read back of every conversation's best branch: counts and digests.  ``unique``: see ``format_paths``."""
    lines = format_paths(messages, 1, template, unique)
    turns, learned = read_turns(F.col("formatted"), template), read_loss(F.col("formatted"), F.col("loss"))
    read = lines.select("tree", "formatted", turns.alias("turns"), learned.alias("learned"))
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(plain, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )

