"""Operator 3 (native): format reply trees as conversations. DataFrame functions only.

Every node points to its parent. Root-to-leaf paths come from iterative self-joins with pointer doubling: after round k
the ancestor table holds, for every leaf, its ancestors nearer than 2**k, and the pointer table maps each node to its
ancestor 2**k above; a tree of depth d takes about log2(d) rounds, and the ancestor table never holds more rows than the
paths have nodes. Paths are ranked in their tree by the mean score of their nodes (then by leaf), the first ``top`` are
formatted, and each text is joined only to chosen paths.

Template: ``<s>`` opens a conversation and each turn is ``[INST]role[/INST]text</s>``. Inside roles and texts a backslash
becomes ``\\0`` and the four control strings become ``\\1`` to ``\\4``, so control strings in the output are always the
template's own and reading back is exact.

Defined cases: null role or text is empty; repeated nodes count once, by their least row; null nodes are left out; a parent that is null or not in the tree makes its node a root; repeated
(conversation, turn) rows are all kept, ordered by role and text; nodes of a cycle raise an error; empty input, empty
result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandspark.llm._shared import materialize

OPEN, HEAD, BODY, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
CODES = {"\\": "\\0", OPEN: "\\1", CLOSE: "\\2", HEAD: "\\3", BODY: "\\4"}


def escape(c: Column) -> Column:
    for plain, code in CODES.items():
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(CODES.items()):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def root_to_leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every node of every root-to-leaf path, ``up`` steps above the leaf. ``nodes`` has the
    columns tree, node (unique in the tree) and parent."""
    known = materialize(nodes.select("tree", "node", "parent"), "chat-nodes")
    keys = known.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    up = known.join(keys, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n"))).select("tree", "node", "parent")
    up = materialize(up, "chat-up")
    parents = up.select(F.col("tree").alias("t"), F.col("parent").alias("n")).distinct()
    leaves = known.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    paths = materialize(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up")), "chat-paths")
    total, step = known.count(), 1
    while not up.isEmpty():
        if step > max(total, 1):
            raise ValueError("a reply tree has a cycle")
        jump = up.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("parent").alias("above"))
        at = F.col("tree").eqNullSafe(F.col("t"))
        more = paths.join(jump, at & (F.col("node") == F.col("n"))).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + step).alias("up"))
        paths = materialize(paths.union(more), "chat-paths")
        up = materialize(up.join(jump, at & (F.col("parent") == F.col("n"))).select("tree", "node", F.col("above").alias("parent")), "chat-up")
        step *= 2
    return paths


def format_trees(nodes: DataFrame, top: int = 1, unique: bool = False) -> DataFrame:
    """One row per chosen path: tree, leaf, branch_rank, formatted, loss_spans (first code point from 1, and length, of
    each assistant text). ``nodes``: tree, node, parent, role, text, score; of rows that share tree and node the least
    counts. ``unique`` says that there are none, and spares looking."""
    if not unique:
        row = F.struct("parent", "role", "text", "score")
        nodes = materialize(nodes.where("node IS NOT NULL").groupBy("tree", "node").agg(F.min(row).alias("r")).select("tree", "node", "r.*"), "chat-unique")
    paths = root_to_leaf_paths(nodes)
    body = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text", "score")
    on = F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))
    scored = paths.join(body.select("t", "n", "score"), on).groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("branch_score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf"))
    chosen = scored.withColumn("branch_rank", rank).where(F.col("branch_rank") <= top).select(F.col("tree").alias("ct"), F.col("leaf").alias("cl"), "branch_rank")
    picked = paths.join(chosen, F.col("tree").eqNullSafe(F.col("ct")) & (F.col("leaf") == F.col("cl"))).join(body, on)
    turn = F.struct(
        (-F.col("up")).alias("at"),
        (F.coalesce("role", F.lit("")) == "assistant").alias("loss"),
        F.concat(F.lit(HEAD), escape(F.coalesce("role", F.lit(""))), F.lit(BODY)).alias("head"),
        escape(F.coalesce("text", F.lit(""))).alias("body"),
    )
    turns = picked.groupBy("tree", "leaf", "branch_rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    piece = lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(len(OPEN)).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.char_length(piece(t))).alias("at"),
            F.when(t["loss"], F.array_append(acc["spans"], F.struct((acc["at"] + F.char_length(t["head"]) + 1).alias("start"), F.char_length(t["body"]).cast("bigint").alias("length")))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return turns.select("tree", "leaf", "branch_rank", F.concat(F.lit(OPEN), F.array_join(F.transform("turns", piece), "")).alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    parts = F.split(F.substring(formatted, len(OPEN) + 1, 1 << 30), CLOSE)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)
    role = lambda t: F.substring_index(F.substring(t, len(HEAD) + 1, 1 << 30), BODY, 1)
    body = lambda t: F.substring_index(t, BODY, -1)
    return F.transform(turns, lambda t: F.struct(unescape(role(t)).alias("role"), unescape(body(t)).alias("text")))


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as reply trees: each row answers the one before it."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(w).cast("bigint"))
    return rows.select(F.col("conv_id").alias("tree"), "node", (F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives, one row per conversation."""
    rows = materialize(linear_trees(conversations), "chat-rows")
    out = format_trees(rows, unique=True).withColumn("turns", read_back(F.col("formatted")))
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int")))), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.withColumn("masked", masked).select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("masked").cast("bigint").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
