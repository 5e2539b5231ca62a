"""Occupancy grids as run-length rows, tiles, labels and routes.

A floor is never a row for each cell: walkable cells are runs ``floor, gy, x0, x1``.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.graph import connected_components


def cell_range(lo: Column, hi: Column, size: float) -> tuple[Column, Column]:
    """First and last cell whose centre lies in ``[lo, hi]``."""
    first = F.ceil(lo / size - F.lit(0.5 + 1e-9))
    last = F.floor(hi / size - F.lit(0.5 - 1e-9))
    return first.cast("int"), last.cast("int")


def raster(rects: DataFrame) -> DataFrame:
    """Walkable runs of ``floor, x0, x1, y0, y1, blocked`` cell rectangles (G4, A14): blocked cells win.

    Each rectangle gives an interval for each of its rows; a sweep over the ends of a
    row's intervals finds where something walkable and nothing blocked covers it.
    """
    rows = rects.select("floor", F.explode(F.sequence("y0", "y1")).alias("gy"), "x0", "x1", F.col("blocked").cast("int").alias("b"))
    ends = rows.select(
        "floor",
        "gy",
        F.explode(F.array(F.struct(F.col("x0").alias("x"), (1 - F.col("b")).alias("w"), F.col("b").alias("k")), F.struct((F.col("x1") + 1).alias("x"), (F.col("b") - 1).alias("w"), (-F.col("b")).alias("k")))).alias("e"),
    )
    steps = ends.groupBy("floor", "gy", F.col("e.x").alias("x")).agg(F.sum("e.w").alias("w"), F.sum("e.k").alias("k"))
    order = Window.partitionBy("floor", "gy").orderBy("x")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    state = steps.select("floor", "gy", "x", ((F.sum("w").over(upto) > 0) & (F.sum("k").over(upto) == 0)).alias("free"))
    turns = state.withColumn("was", F.coalesce(F.lag("free").over(order), F.lit(False))).where("free <> was")
    closed = turns.withColumn("stop", F.lead("x").over(order))
    return closed.where("free").select("floor", "gy", F.col("x").alias("x0"), (F.col("stop") - 1).alias("x1"))


def tile_runs(runs: DataFrame, tile: int) -> DataFrame:
    """Runs cut at tile borders (G5): ``floor, tx, ty, gy, x0, x1``."""
    cut = runs.withColumn("tx", F.explode(F.sequence(F.floor(F.col("x0") / tile), F.floor(F.col("x1") / tile))))
    return cut.select("floor", "tx", F.floor(F.col("gy") / tile).alias("ty"), "gy", F.greatest("x0", F.col("tx") * tile).cast("int").alias("x0"), F.least("x1", (F.col("tx") + 1) * tile - 1).cast("int").alias("x1"))


def label_tiles(cut: DataFrame) -> DataFrame:
    """Tile runs with the id of their 4-connected component in the tile (G6): the smallest run of it."""
    runs = cut.withColumn("run", F.struct("floor", "tx", "ty", "gy", "x0"))
    up = runs.select("floor", "tx", "ty", (F.col("gy") - 1).alias("gy"), F.col("x0").alias("ux0"), F.col("x1").alias("ux1"), F.col("run").alias("above"))
    met = runs.join(up, ["floor", "tx", "ty", "gy"]).where((F.col("x0") <= F.col("ux1")) & (F.col("ux0") <= F.col("x1")))
    edges = met.select(F.col("run").alias("src"), F.col("above").alias("dst")).unionByName(runs.select(F.col("run").alias("src"), F.col("run").alias("dst")))
    found = connected_components(edges)
    return runs.join(found, runs.run == found.node).drop("node", "run")


def _route(key: tuple, requests: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    """Routes of one floor: breadth-first over its cells, one search for each distinct start."""
    out: list[tuple] = []
    if len(runs):
        left, low = int(runs.x0.min()), int(runs.gy.min())
        free = np.zeros((int(runs.gy.max()) - low + 3, int(runs.x1.max()) - left + 3), bool)
        for gy, a, b in zip(runs.gy, runs.x0, runs.x1, strict=True):
            free[gy - low + 1, a - left + 1 : b - left + 2] = True
    for start, group in requests.groupby(["sx", "sy"], sort=True):
        if not len(runs):
            out += [(key[0], r.request, "blocked", "start not walkable", -1, 0, "", True, True) for r in group.itertuples()]
            continue

        def cell(x: int, y: int) -> tuple[int, int] | None:
            i, j = y - low + 1, x - left + 1
            return (i, j) if 0 <= i < free.shape[0] and 0 <= j < free.shape[1] and free[i, j] else None

        origin = cell(*start)
        came = np.full(free.shape, -1, np.int8)
        hops = np.full(free.shape, -1, np.int32)
        if origin:
            hops[origin] = 0
            queue = deque([origin])
            while queue:
                i, j = queue.popleft()
                for d, (di, dj) in enumerate(((0, 1), (0, -1), (1, 0), (-1, 0))):
                    t = (i + di, j + dj)
                    if free[t] and hops[t] < 0:
                        hops[t], came[t] = hops[i, j] + 1, d
                        queue.append(t)
        for r in group.itertuples():
            goal = cell(r.gx, r.gy)
            if origin is None:
                out.append((key[0], r.request, "blocked", "start not walkable", -1, 0, "", True, True))
                continue
            reached = goal is not None and hops[goal] >= 0
            if not reached:  # the reachable cell nearest to the goal
                i, j = np.nonzero(hops >= 0)
                d = (i - (r.gy - low + 1)) ** 2 + (j - (r.gx - left + 1)) ** 2
                k = np.lexsort((j, i, d))[0]
                goal = (int(i[k]), int(j[k]))
            path = [goal]
            while path[-1] != origin:
                di, dj = ((0, 1), (0, -1), (1, 0), (-1, 0))[came[path[-1]]]
                path.append((path[-1][0] - di, path[-1][1] - dj))
            path.reverse()
            corners = [p for k, p in enumerate(path) if k in (0, len(path) - 1) or (path[k - 1][0] != path[k + 1][0] and path[k - 1][1] != path[k + 1][1])]
            free_all = all(free[p] for p in path)
            square = all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(path, path[1:], strict=False))
            text = " ".join(f"{j + left - 1}:{i + low - 1}" for i, j in corners)
            out.append((key[0], r.request, "pass" if reached else "blocked", "" if reached else "goal not reachable", int(hops[goal]), int((hops >= 0).sum()), text, square, free_all))
    return pd.DataFrame(out, columns=["floor", "request", "status", "reason", "hops", "visited", "path", "orthogonal", "collision_free"])


def routes(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Hop-minimal routes of ``floor, request, sx, sy, gx, gy`` over the floors' runs.

    One task a floor and shard of its requests: floors are bounded, requests are dealt to
    shards by start, so that equal starts share one search and a busy floor is spread.
    """
    shards = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = requests.withColumn("shard", F.pmod(F.xxhash64("sx", "sy"), F.lit(shards)).cast("int"))
    used = asked.select(F.col("floor").alias("at_floor"), F.col("shard").alias("at_shard")).distinct()
    given = runs.select(F.col("floor").alias("run_floor"), "gy", "x0", "x1").join(used, F.col("run_floor") == F.col("at_floor")).drop("run_floor")
    schema = "floor int, request long, status string, reason string, hops int, visited int, path string, orthogonal boolean, collision_free boolean"
    return asked.groupBy("floor", "shard").cogroup(given.groupBy("at_floor", "at_shard")).applyInPandas(_route, schema)
