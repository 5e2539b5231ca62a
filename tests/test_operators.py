"""Operators on tables small enough to check by hand."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import measures as M
from plumbline.operators import graph, grid, intervals, paths, relational
from plumbline.operators.rules import Rule, evaluate, residual


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_rule_policies(spark):
    df = spark.createDataFrame([(1, 0.90), (2, 0.8999), (3, 0.89996), (4, None), (5, 0.8999995)], "id int, w double")
    strict = evaluate(df, [Rule("w", "w", "minimum", 0.90, round_digits=4)], ["id"])
    assert rows(strict.select("id", "status"), "id") == [(1, "pass"), (2, "fail"), (3, "pass"), (4, "unavailable"), (5, "pass")]
    tolerant = evaluate(df, [Rule("w", "w", "minimum", 0.90, tolerance=1e-6, on_missing="advisory")], ["id"])
    assert rows(tolerant.select("id", "status"), "id") == [(1, "pass"), (2, "fail"), (3, "fail"), (4, "advisory"), (5, "pass")]


def test_residual_rule(spark):
    df = spark.createDataFrame([(1, True, 0.80), (2, True, 1.0), (3, False, 0.5), (4, True, None)], "id int, blocked boolean, door double")
    out = residual(df, "blocked", [Rule("route_door_width", "door", "minimum", 0.9)], "unreachable", ["id"])
    assert rows(out.select("id"), "id") == [(2,), (4,)]


def test_opening_width(spark):
    df = spark.createDataFrame([(1.0, 0.2), (1.0, 0.5), (0.0, 0.0), (0.30, 0.9)], "w double, d double")
    assert [r[0] for r in df.select(M.opening_width(F.col("w"), F.col("d"))).collect()] == [1.0, 0.5, None, 0.9]


def test_intervals(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 3, 4), ("a", 6, 7)], "k string, lo int, hi int")
    merged = intervals.merge(df, "k", "lo", "hi")
    assert rows(merged.select("lo", "hi"), "lo") == [(1, 4), (6, 7)]
    holes = intervals.complement(merged.withColumns({"start": F.lit(0), "stop": F.lit(8)}), "k", "lo", "hi", "start", "stop")
    assert rows(holes.select("lo", "hi"), "lo") == [(0, 1), (4, 6), (7, 8)]


def test_runs(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 7, 8)], "k string, v int")
    assert rows(intervals.runs(df, "k", "v").select("lo", "hi"), "lo") == [(1, 3), (7, 8)]
    assert intervals.runs(df.where("false"), "k", "v").count() == 0


def test_pairs(spark):
    df = spark.createDataFrame([("S1", x) for x in "ABC"] + [("S2", x) for x in "AB"], "space string, door string")
    assert rows(relational.pairs_in_group(df, "space", "door"), "space", "a", "b") == [("S1", "A", "B"), ("S1", "A", "C"), ("S1", "B", "C"), ("S2", "A", "B")]


def test_nearest_among_equal_values(spark):
    df = spark.createDataFrame([("g", 1, 5.0), ("g", 2, 5.0), ("g", 3, 5.0), ("g", 9, 6.0), ("g", 10, None), ("h", 4, 1.0)], "k string, id int, v double")
    near = relational.nearest_k_relative(df, "k", "id", "v", 2, 500.0)
    assert rows(near.select("id", "rank", "near_id"), "id", "rank") == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2), (9, 1, 1), (9, 2, 2)]


def test_number_rows_is_the_total_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert all(r.v + 1 == r.k for r in relational.number_rows(df, ["v"], "k").collect())


def test_shortest_paths_and_forest(spark):
    edges = spark.createDataFrame([("AB", "A", "B", 1.0), ("BC", "B", "C", 1.0), ("AC", "A", "C", 5.0)], "edge_id string, src string, dst string, weight double")
    start = spark.createDataFrame([("A",)], "source string")
    found = {r.node: (r.distance, r.path) for r in graph.shortest_paths(edges, start).collect()}
    assert found == {"A": (0.0, []), "B": (1.0, ["AB"]), "C": (2.0, ["AB", "BC"])}
    direct = {r.node: r.path for r in graph.shortest_paths(edges.where("edge_id <> 'BC'"), start).collect()}
    assert direct["C"] == ["AC"]
    ranked = spark.createDataFrame([("AB", "A", "B", 0, 1.0), ("BC", "B", "C", 1, 2.0), ("AC", "A", "C", 0, 3.0)], "edge_id string, src string, dst string, fails int, distance double")
    assert {r.edge_id for r in graph.spanning_forest(ranked, ["fails", "distance", "edge_id"]).collect()} == {"AB", "AC"}


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_turns_depend_on_leg_lengths(spark):
    short, long = [(0.0, 0.0), (0.12, 0.0), (0.12, 0.12)], [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]
    df = spark.createDataFrame([(1, short), (2, long), (3, [])], f"id int, path {paths.POINTS}")
    assert [r[1] for r in rows(df.select("id", paths.turns(F.col("path"))), "id")] == [0, 1, 0]


def test_compact_and_sample(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (2.0, 1.0)],)], f"path {paths.POINTS}")
    path = paths.compact(paths.dedupe(F.col("path")))
    got = df.select(path.alias("p"), paths.length(path).alias("n"), F.size(paths.sample(path, 0.5)).alias("s"), paths.at_progress(path, 0.5).alias("half")).first()
    assert [tuple(p) for p in got.p] == [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0)]
    assert (got.n, got.s, tuple(got.half)) == (3.0, 7, (1.5, 0.0))


def test_blocked_cells_win(spark):
    rects = spark.createDataFrame([(1, 0, 9, 0, 0, False), (1, 4, 5, 0, 0, True)], "floor int, x0 int, x1 int, y0 int, y1 int, blocked boolean")
    assert rows(grid.raster(rects), "x0") == [(1, 0, 0, 3), (1, 0, 6, 9)]


@pytest.mark.parametrize("gap", [True, False])
def test_rooms_and_a_gap(spark, gap):
    rects = [(1, 0, 4, 0, 4, False), (1, 6, 9, 0, 4, False)] + ([(1, 5, 5, 2, 2, False)] if gap else [])
    runs = grid.raster(spark.createDataFrame(rects, "floor int, x0 int, x1 int, y0 int, y1 int, blocked boolean"))
    asked = spark.createDataFrame([(1, 7, 0, 0, 9, 0)], "floor int, request long, sx int, sy int, gx int, gy int")
    r = grid.routes(asked, runs).first()
    assert (r.status, r.orthogonal, r.collision_free) == ("pass" if gap else "blocked", True, True)
    assert r.hops == (13 if gap else 4)
    assert r.path.startswith("0:0") and r.path.endswith("9:0" if gap else "4:0")


def test_progress_never_falls(spark):
    from plumbline.streaming.progress import progress

    df = spark.createDataFrame([("m", k, v) for k, v in enumerate((12, 24, 46, 36), 1)], "job string, seq int, raw int")
    assert [r.progress for r in progress(df, "job", "seq", "raw").orderBy("seq").collect()] == [12, 24, 46, 46]


def test_progress_stream(spark, tmp_path):
    from plumbline.streaming.progress import progress_stream

    for k, v in enumerate((40, 20, 70)):
        pd.DataFrame({"job": ["m"], "raw": [v]}).to_parquet(tmp_path / f"{k}.parquet")
    stream = spark.readStream.schema("job string, raw long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    q = progress_stream(stream, "job", "raw").writeStream.format("memory").queryName("progress_rows").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert max(r.progress for r in spark.sql("SELECT * FROM progress_rows").collect()) == 70
