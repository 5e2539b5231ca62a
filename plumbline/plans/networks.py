"""Queries of graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import graph as G
from plumbline.plans.registry import query
from plumbline.sources.tables import table

#: Suppliers of a nation, each linked with the next two by key unless their balances differ much.
EDGES_SQL = """
    s AS (SELECT s_suppkey, s_acctbal, lead(s_suppkey) OVER w AS n1, lead(s_acctbal) OVER w AS b1, lead(s_suppkey, 2) OVER w AS n2, lead(s_acctbal, 2) OVER w AS b2 FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)),
    e AS (SELECT 'A' || s_suppkey AS edge_id, s_suppkey AS src, n1 AS dst, (1 + s_suppkey * 7 % 10)::DOUBLE AS weight FROM s WHERE abs(s_acctbal - b1) < 4000
      UNION ALL SELECT 'B' || s_suppkey, s_suppkey, n2, (3 + s_suppkey * 3 % 10)::DOUBLE FROM s WHERE abs(s_acctbal - b2) < 3000),
    u AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"""


def supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``edge_id, src, dst, weight``."""
    order = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", *[F.lead(c, k).over(order).alias(f"{n}{k}") for k in (1, 2) for c, n in (("s_suppkey", "n"), ("s_acctbal", "b"))])

    def edge(name: str, k: int, most: float, least: int, factor: int):
        weight = (F.lit(least) + F.pmod(F.col("s_suppkey") * factor, F.lit(10))).cast("double")
        return F.when(F.abs(F.col("s_acctbal") - F.col(f"b{k}")) < most, F.struct(F.concat(F.lit(name), F.col("s_suppkey").cast("string")).alias("edge_id"), F.col("s_suppkey").alias("src"), F.col(f"n{k}").alias("dst"), weight.alias("weight")))

    both = F.array(edge("A", 1, 4000, 1, 7), edge("B", 2, 3000, 3, 3))
    return s.select(F.explode(F.filter(both, lambda x: x.isNotNull())).alias("e")).select("e.*")


REACH_SQL = "r AS (SELECT src AS a, src AS b FROM u UNION SELECT r.a, u.dst FROM r JOIN u ON u.src = r.b)"

WALK_SQL = """w AS (SELECT src AS source, src AS node, 0.0::DOUBLE AS distance, [src] AS seen FROM (SELECT DISTINCT src FROM u)
      UNION ALL SELECT source, u.dst, distance + weight, list_append(seen, u.dst) FROM w JOIN u ON u.src = w.node WHERE NOT list_contains(seen, u.dst)),
    d AS (SELECT source, node, min(distance) AS distance FROM w GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {EDGES_SQL}, {REACH_SQL} SELECT a AS node, min(b) AS component FROM r GROUP BY a")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of the supplier graph (H2, H6)."""
    return G.connected_components(supplier_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {EDGES_SQL}, {REACH_SQL} SELECT a AS source, min(b) AS reached, count(*) AS n_reached FROM r GROUP BY a")
def reachable_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every supplier reaches (H3): the set's name, its smallest member, and its size.

    In an undirected graph the set is the component; it is given by name, as its members for
    each source would be the square of its size.
    """
    found = G.connected_components(supplier_edges(spark, sf_dir))
    sizes = found.groupBy("component").agg(F.count("*").alias("n_reached"))
    return found.join(sizes, "component").select(F.col("node").alias("source"), F.col("component").alias("reached"), "n_reached")


@query(f"WITH RECURSIVE {EDGES_SQL}, {WALK_SQL} SELECT * FROM d")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between all connected suppliers."""
    edges = supplier_edges(spark, sf_dir)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("source")).distinct()
    return G.shortest_paths(edges, nodes).select("source", "node", "distance")


@query(None)
def spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest of taking edges by weight and id."""
    return G.spanning_forest(supplier_edges(spark, sf_dir), ["weight", "edge_id"])


@query(f"WITH RECURSIVE {EDGES_SQL}, {WALK_SQL} SELECT distance, source AS a, node AS b FROM d WHERE source <= node ORDER BY distance DESC, a, b LIMIT 1")
def graph_diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest shortest path (H4)."""
    edges = supplier_edges(spark, sf_dir)
    return G.diameter(edges, edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct())


@query(f"WITH {EDGES_SQL} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1")
def edge_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges at each supplier."""
    return G.degrees(supplier_edges(spark, sf_dir))


#: Floors of parts: cell rectangles, those of some types blocked.
RECTS_SQL = """
    q AS (SELECT (p_partkey % 8)::INT AS floor, (p_partkey * 7 % 120)::INT AS x0, (p_size % 50)::INT AS y0, (p_partkey * 7 % 120 + 2 + p_partkey % 5)::INT AS x1, (p_size % 50 + p_partkey % 3)::INT AS y1, p_partkey % 11 < 2 AS blocked FROM part),
    c AS (SELECT DISTINCT floor, unnest(generate_series(x0, x1))::INT AS x, y FROM (SELECT floor, x0, x1, unnest(generate_series(y0, y1))::INT AS y FROM q WHERE NOT blocked)),
    k AS (SELECT DISTINCT floor, unnest(generate_series(x0, x1))::INT AS x, y FROM (SELECT floor, x0, x1, unnest(generate_series(y0, y1))::INT AS y FROM q WHERE blocked)),
    f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.floor = c.floor AND k.x = c.x AND k.y = c.y)),
    i AS (SELECT floor, y AS gy, x, x - row_number() OVER (PARTITION BY floor, y ORDER BY x) AS n FROM f),
    r AS (SELECT floor, gy, min(x) AS x0, max(x) AS x1 FROM i GROUP BY floor, gy, n)"""


def part_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``floor, x0, x1, y0, y1, blocked``."""
    e = F.expr
    return table(spark, sf_dir, "part").select(
        e("CAST(p_partkey % 8 AS INT) AS floor"),
        e("CAST(p_partkey * 7 % 120 AS INT) AS x0"),
        e("CAST(p_partkey * 7 % 120 + 2 + p_partkey % 5 AS INT) AS x1"),
        e("CAST(p_size % 50 AS INT) AS y0"),
        e("CAST(p_size % 50 + p_partkey % 3 AS INT) AS y1"),
        e("p_partkey % 11 < 2 AS blocked"),
    )


@query(f"WITH {RECTS_SQL} SELECT * FROM r")
def rect_raster_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walkable runs of rectangles, blocked ones on top."""
    from plumbline.operators.grid import raster

    return raster(part_rects(spark, sf_dir))


@query(f"WITH {RECTS_SQL} SELECT floor, (x // 16)::BIGINT AS tx, (y // 16)::BIGINT AS ty, count(*)::BIGINT AS cells FROM f GROUP BY 1, 2, 3")
def tile_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walkable cells of each tile; empty tiles have no row."""
    from plumbline.operators.grid import raster, tile_runs

    cut = tile_runs(raster(part_rects(spark, sf_dir)), 16)
    return cut.groupBy("floor", "tx", "ty").agg(F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).alias("cells"))


@query(
    f"""WITH RECURSIVE {RECTS_SQL},
    t AS (SELECT floor, x // 16 AS tx, gy // 16 AS ty, gy, x, x - row_number() OVER (PARTITION BY floor, x // 16, gy ORDER BY x) AS n FROM (SELECT floor, x, y AS gy FROM f)),
    v AS (SELECT floor, tx, ty, gy, min(x) AS x0, max(x) AS x1 FROM t GROUP BY floor, tx, ty, gy, n),
    g AS (SELECT a.floor, a.tx, a.ty, a.gy * 1000 + a.x0 AS a, b.gy * 1000 + b.x0 AS b FROM v a JOIN v b ON a.floor = b.floor AND a.tx = b.tx AND a.ty = b.ty AND abs(a.gy - b.gy) <= 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
    z AS (SELECT * FROM g UNION SELECT z.floor, z.tx, z.ty, z.a, g.b FROM z JOIN g ON g.floor = z.floor AND g.tx = z.tx AND g.ty = z.ty AND g.a = z.b),
    m AS (SELECT floor, tx, ty, a, min(b) AS root FROM z GROUP BY 1, 2, 3, 4)
    SELECT floor, tx::BIGINT AS tx, ty::BIGINT AS ty, count(DISTINCT root)::BIGINT AS n_components FROM m GROUP BY 1, 2, 3"""
)
def tile_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of 4-connected components in each tile."""
    from plumbline.operators.grid import label_tiles, raster, tile_runs

    labelled = label_tiles(tile_runs(raster(part_rects(spark, sf_dir)), 16))
    return labelled.groupBy("floor", "tx", "ty").agg(F.countDistinct("component").alias("n_components"))


@query(None)
def grid_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes to the corner of each part's rectangle on its floor, passed or as far as they go."""
    from plumbline.operators.grid import raster, routes
    from plumbline.sources.shared import work_table

    rects = part_rects(spark, sf_dir)
    runs = work_table(raster(rects), "runs")
    ends = table(spark, sf_dir, "part").select(F.expr("CAST(p_partkey % 8 AS INT) AS floor"), F.col("p_partkey").alias("request"), F.expr("CAST(p_partkey * 7 % 120 AS INT) AS gx"), F.expr("CAST(p_size % 50 AS INT) AS gy"))
    starts = runs.groupBy("floor").agg(F.min(F.struct("gy", "x0")).alias("s")).select("floor", F.col("s.x0").alias("sx"), F.col("s.gy").alias("sy"))
    return routes(ends.join(starts, "floor").select("floor", "request", "sx", "sy", "gx", "gy"), runs)
