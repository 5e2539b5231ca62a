r"""Chat formatting over reply trees, with DataFrame functions only.

A tree of messages is walked by self-joins that double the distance each round:
after k rounds every message knows its ancestor 2**k replies above it, so a thread
of a thousand replies takes ten joins. Leaves are ranked by the mean score of their
root-to-leaf path; the messages of the chosen paths are then found with the same
jump tables, from short jumps to long ones.

Template, for each turn of a path in order::

    <turn role="ROLE">\nTEXT\n</turn>\n

Escapes make it reversible: ``\`` becomes ``\b``, ``<`` becomes ``\l`` and, in roles,
``"`` becomes ``\q``. A text can therefore hold no ``<``, so no control string.

Defined results: a null role or text is empty; repeated rows stay separate turns;
equal scores choose the smallest leaf id; a message whose parent is missing is a
root; rows of a null conversation are one conversation; an empty table gives no rows;
other columns, whatever their names, are kept by ``reply_paths`` and ignored by
``format_paths``. ``leaf``, ``branch`` and ``pos`` of the messages give way to the path's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import fresh
from plumbline.sources.shared import drop_table, work_table

OPEN, MID, CLOSE = '<turn role="', '">\n', "\n</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    """Text with the template's control characters escaped."""
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(text, F.lit('"'), F.lit("\\q")) if role else text


def unescape(text: Column, role: bool = False) -> Column:
    """Inverse of ``escape``: no replacement makes a new escape, as each starts with a backslash."""
    if role:
        text = F.replace(text, F.lit("\\q"), F.lit('"'))
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def threads(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """A linear conversation as a tree: each row replies to the row before it.

    Adds ``node`` and ``parent`` (null for the first); ties in ``order`` are repeated rows.
    """
    node = F.row_number().over(Window.partitionBy(tree).orderBy(*order)).cast("long")
    return rows.withColumn("node", node).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def reply_paths(messages: DataFrame, tree: str, branches: int = 1, max_rounds: int = 40) -> DataFrame:
    """The messages on the ``branches`` best root-to-leaf paths of each tree.

    ``messages`` has ``tree, node, parent, score`` and any payload; ``(tree, node)`` is a key.
    Returns the payload with ``leaf`` (names the path), ``branch`` (its rank, from 1) and
    ``pos`` (from 0 at the root).
    """
    nodes = messages.select(F.col(tree).alias("t"), "node", "parent", F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("score"))
    known = nodes.select(F.col("t").alias("pt"), F.col("node").alias("pn"))
    rooted = nodes.join(known, F.col("t").eqNullSafe(F.col("pt")) & (F.col("parent") == F.col("pn")), "left")
    hops = work_table(rooted.select("t", "node", F.col("pn").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")), "jump0")
    inner = hops.where("up is not null").select(F.col("t").alias("it"), F.col("up").alias("iu")).distinct()
    # Only messages that are still below the root take part in the next round.
    jumps, ended = [], hops.where("up is null")
    active = hops.where("up is not null")
    while not active.isEmpty():
        if len(jumps) > max_rounds:
            raise RuntimeError("replies form a cycle")
        jumps.append(active)
        known = active.unionByName(ended)
        far = known.select(F.col("t").alias("ft"), F.col("node").alias("fn"), F.col("up").alias("fup"), F.col("total").alias("ftotal"), F.col("depth").alias("fdepth"))
        moved = work_table(
            active.join(far, F.col("t").eqNullSafe(F.col("ft")) & (F.col("up") == F.col("fn"))).select(
                "t", "node", F.col("fup").alias("up"), (F.col("total") + F.col("ftotal")).alias("total"), (F.col("depth") + F.col("fdepth")).alias("depth")
            ),
            f"jump{len(jumps)}",
        )
        ended = ended.unionByName(moved.where("up is null"))
        active = moved.where("up is not null")
    leaves = ended.join(inner, F.col("t").eqNullSafe(F.col("it")) & (F.col("node") == F.col("iu")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("t").orderBy(F.desc(F.col("total") / F.col("depth")), "node"))
    chosen = leaves.withColumn("branch", rank).where(F.col("branch") <= branches)
    path = chosen.select("t", F.col("node").alias("leaf"), "branch", "depth", "node", F.lit(0).cast("long").alias("dist"))
    for k, hop in enumerate(jumps):
        step = hop.select(F.col("t").alias("ht"), F.col("node").alias("hn"), F.col("up").alias("hu"))
        moved = path.join(step, F.col("t").eqNullSafe(F.col("ht")) & (F.col("node") == F.col("hn"))).select("t", "leaf", "branch", "depth", F.col("hu").alias("node"), (F.col("dist") + F.lit(2**k)).alias("dist"))
        longer = work_table(path.unionByName(moved), f"path{k}")
        drop_table(path)
        path = longer
    kept = [c for c in messages.columns if c.lower() not in ("leaf", "branch", "pos")]
    pt, pn = fresh("pt", kept), fresh("pn", kept)
    spot = path.select(F.col("t").alias(pt), F.col("node").alias(pn), "leaf", "branch", (F.col("depth") - 1 - F.col("dist")).alias("pos"))
    rows = messages.select(*kept)
    return rows.join(spot, rows[tree].eqNullSafe(spot[pt]) & (rows.node == spot[pn])).drop(pt, pn)


def format_paths(paths: DataFrame, tree: str, learn: str = "assistant") -> DataFrame:
    """One conversation per path: ``tree, leaf, branch, formatted, loss_spans``.

    ``loss_spans`` are the code point ranges (end exclusive) of the texts of role ``learn``.
    """
    role = F.coalesce("role", F.lit(""))
    parts = paths.select(tree, "leaf", "branch", "pos", (role == learn).alias("learned"), F.concat(F.lit(OPEN), escape(role, role=True), F.lit(MID)).alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    sized = parts.withColumn("size", F.length("head") + F.length("body") + F.lit(len(CLOSE)))
    before = Window.partitionBy(tree, "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head"))
    turn = F.struct("pos", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), F.when(F.col("learned"), F.struct(F.col("at").cast("long").alias("start"), (F.col("at") + F.length("body")).cast("long").alias("end"))).alias("span"))
    grouped = placed.groupBy(tree, "leaf", "branch").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select(tree, "leaf", "branch", F.array_join(F.transform("turns", lambda t: t.piece), "").alias("formatted"), F.filter(F.transform("turns", lambda t: t.span), lambda s: s.isNotNull()).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: ``array<struct<role, text>>``."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, MID, 1)
        return F.struct(
            unescape(F.substr(role, F.lit(len(OPEN) + 1)), role=True).alias("role"),
            unescape(F.substr(piece, F.length(role) + F.lit(len(MID) + 1))).alias("text"),
        )

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")
