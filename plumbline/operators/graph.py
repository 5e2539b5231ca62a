"""Graph operators as DataFrame loops over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.shared import drop_table, work_table


#: Labels (two columns) that are broadcast at most, instead of shuffled in each round.
MOST_LABELS = 200_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for every node of an undirected edge table: ``(node, component)``.

    Each round sends labels along edges (a partially aggregated ``min``) and then
    jumps pointers (label := label of label), so the rounds grow with the logarithm
    of the diameter rather than with the diameter. Rounds are written to the shared
    folder, so a lost executor repeats one round at most; labels are broadcast where
    the graph has few nodes. Nodes may be of any ordered type. Self loops keep isolated
    nodes; null ends are ignored.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = work_table(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = work_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    few = labels.limit(MOST_LABELS + 1).count() <= MOST_LABELS
    hint = F.broadcast if few else (lambda df: df)
    written = labels
    for _ in range(max_rounds):
        sent = both.join(hint(labels), both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        # Every node has an edge, if only to itself, so ``sent`` has them all.
        better = sent.join(hint(labels), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = F.least("mid", F.coalesce("far", "mid"))
        step = work_table(better.join(hint(jump), "mid", "left").select("node", new.alias("label"), (F.col("old") > new).alias("changed")), "labels")
        drop_table(written)
        written = step
        labels = step.select("node", "label")
        if step.where("changed").isEmpty():
            drop_table(both)
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected edges ``edge_id, src, dst, weight`` as two directed rows each."""
    back = edges.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.select("edge_id", "src", "dst", "weight").unionByName(back)


def shortest_paths(edges: DataFrame, sources: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Shortest paths from each source to every reachable node (H1, H3, H15): ``source, node, distance, path``.

    ``edges`` has ``edge_id, src, dst, weight`` (undirected, weights of 0 or more), ``sources``
    has ``source``. Each round relaxes the edges of the nodes that got nearer, so settled
    parts of the graph aren't joined again. Equal distances take the smaller path.
    """
    links = work_table(both_ways(edges), "links")
    best = work_table(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("distance"), F.array().cast("array<string>").alias("path")).distinct(), "best")
    front = written = best
    for _ in range(max_rounds):
        moved = front.join(links, front.node == links.src).select("source", F.col("dst").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"), F.concat("path", F.array(F.col("edge_id").cast("string"))).alias("path"))
        near = moved.groupBy("source", "node").agg(F.min(F.struct("distance", "path")).alias("new"))
        old = best.select("source", "node", F.struct("distance", "path").alias("old"))
        step = work_table(
            old.join(near, ["source", "node"], "full").select("source", "node", F.least("old", "new").alias("b"), (F.col("old").isNull() | F.coalesce(F.col("new") < F.col("old"), F.lit(False))).alias("changed")),
            "best",
        )
        drop_table(written)
        written = step
        best = step.select("source", "node", F.col("b.distance").alias("distance"), F.col("b.path").alias("path"))
        front = best.join(step.where("changed").select("source", "node"), ["source", "node"], "left_semi")
        if step.where("changed").isEmpty():
            return best
    raise RuntimeError(f"paths did not settle in {max_rounds} rounds")


def spanning_forest(edges: DataFrame, order: list[str], max_rounds: int = 40) -> DataFrame:
    """The spanning forest that taking edges in ``order`` gives (H5), by Boruvka rounds.

    ``order`` must be total (end it with the edge id): then the least edge of each
    component is in the forest, and all components choose at once.
    """
    todo = work_table(edges.select("edge_id", "src", "dst", F.struct(*order).alias("rank")).where("src <> dst"), "todo")
    chosen: DataFrame | None = None
    for _ in range(max_rounds):
        ends = todo.select(F.col("src").alias("node"), "rank", "edge_id").unionByName(todo.select(F.col("dst").alias("node"), "rank", "edge_id"))
        picked = work_table(ends.groupBy("node").agg(F.min_by("edge_id", "rank").alias("edge_id")).select("edge_id").distinct(), "picked")
        if picked.isEmpty():
            break
        chosen = picked if chosen is None else chosen.unionByName(picked)
        groups = connected_components(todo.join(picked, "edge_id").select("src", "dst"))
        a, b = groups.select(F.col("node").alias("src"), F.col("component").alias("a")), groups.select(F.col("node").alias("dst"), F.col("component").alias("b"))
        merged = todo.join(a, "src", "left").join(b, "dst", "left")
        todo = work_table(merged.select("edge_id", F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"), "rank").where("src <> dst"), "todo")
    else:
        raise RuntimeError("the forest did not settle")
    return edges.join(chosen, "edge_id", "left_semi") if chosen is not None else edges.where("false")


def diameter(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The longest shortest path (H4): ``distance, a, b``; ties take the smallest ends."""
    ways = shortest_paths(edges, nodes.select(F.col("node").alias("source")))
    ends = ways.where("source <= node").select("distance", F.col("source").alias("a"), F.col("node").alias("b"))
    return ends.orderBy(F.desc("distance"), "a", "b").limit(1)


def degrees(edges: DataFrame) -> DataFrame:
    """Edges at each node."""
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
