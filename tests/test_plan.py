"""Plan routes, their paths, floors and texts on tiny cases."""

import pytest
from pyspark.sql import functions as F

from plumbline.domain import explain, plan
from plumbline.operators import paths as P
from plumbline.operators import relational as R
from plumbline.operators.vectors import nearest_of_all

PATH = "array<struct<x:double,y:double>>"


def points(spark, path, made):
    return [tuple(p) for p in spark.createDataFrame([(path,)], f"path {PATH}").select(made.alias("p")).first().p]


def test_turn_points(spark):
    assert points(spark, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (1.0, 1.2), (2.0, 1.2)], P.turn_points(F.col("path"))) == [(1.0, 0.0)]
    assert points(spark, [(0.0, 0.0), (1.0, 0.0), (2.0, 0.1)], P.turn_points(F.col("path"))) == []
    assert points(spark, [], P.turn_points(F.col("path"))) == []


def test_densify_and_connector(spark):
    got = points(spark, [(0.0, 0.0), (0.3, 0.0), (0.3, 0.0), (0.3, 0.1)], P.densify(F.col("path")))
    assert got == [pytest.approx(p) for p in [(0.0, 0.0), (0.1, 0.0), (0.2, 0.0), (0.3, 0.0), (0.3, 0.1)]]
    with pytest.raises(Exception, match="orthogonal"):
        points(spark, [(0.0, 0.0), (1.0, 1.0)], P.densify(F.col("path")))
    way = lambda a, b: points(spark, [a, b], P.connector(F.get("path", F.lit(0)), F.get("path", F.lit(1))))
    assert way((0.0, 0.0), (2.0, 3.0)) == [(0.0, 0.0), (2.0, 0.0), (2.0, 3.0)]
    assert way((0.0, 0.0), (2.0, 0.0)) == [(0.0, 0.0), (2.0, 0.0)] and way((1.0, 1.0), (1.0, 1.0)) == [(1.0, 1.0)]


def test_legs_become_one_path(spark):
    legs = [("a", 1, "p", "p", "q", [(0.0, 0.0), (1.0, 0.0)]), ("a", 2, "q", "r", "q", [(2.0, 5.0), (1.0, 5.0), (1.0, 0.0)]), ("b", 1, "x", "p", "q", [(0.0, 0.0), (1.0, 0.0)])]
    df = spark.createDataFrame(legs, f"chain string, seq int, at string, start string, stop string, path {PATH}")
    got = {r.chain: ([tuple(p) for p in r.path], r.whole) for r in plan.compose(df, "chain").collect()}
    assert got == {"a": ([(0.0, 0.0), (1.0, 0.0), (1.0, 5.0), (2.0, 5.0)], True), "b": ([], False)}


def test_accounting_adds_up(spark):
    rows = [("k", "pass", True), ("k", "blocked", False), ("k", "unavailable", None)]
    df = spark.createDataFrame(rows, "k string, status string, swapped boolean")
    assert tuple(plan.accounting(df, ["k"]).first()) == ("k", 3, 1, 1, 1, 1)
    with pytest.raises(Exception, match="another outcome"):
        plan.accounting(df.withColumn("status", F.lit("odd")), ["k"]).collect()


def test_advisories_without_repeats(spark):
    issues = spark.createDataFrame([("D1", "door_height"), ("D2", "door_width")], "element_guid string, rule_id string")
    checks = spark.createDataFrame([("D1", "door_height", "advisory"), ("D2", "door_height", "advisory"), ("D3", "door_height", "pass")], "elementGuid string, ruleId string, status string")
    assert sorted(tuple(r) for r in plan.element_advisories(issues, checks).collect()) == [("D1", "door_height", "issue"), ("D2", "door_height", "check")]


def test_sentences(spark):
    df = spark.createDataFrame([([("door_width", 1), ("odd", 4), ("ramp_slope", 2)], ["A", "B", "A"]), ([], [])], "c array<struct<rule:string,n:int>>, f array<string>")
    got = [r.s for r in df.select(explain.summary_sentence(F.col("c"), F.col("f")).alias("s")).collect()]
    assert got[0] == "The SHACL check found 1 door too narrow issue, 2 ramp too steep issues. Affected floors: A, B."
    assert got[1].startswith("The supplied SHACL facts contain no")
    facts = spark.createDataFrame([("missing", None, None, None, None, None), ("odd", ["a"], None, None, None, None)], "rule string, names array<string>, edge string, floor string, start string, stop string")
    assert [r.action for r in explain.short_actions(facts).collect()] == ["Add or repair the missing IFC geometry or property data for the affected IFC elements, then preprocess the model again."]


def test_nearest_in_one_large_group(spark):
    """One group of many rows: a frame that is read again for each row would take minutes."""
    left = spark.range(30_000).select(F.lit(1).alias("g"), (F.col("id") * 1.0).alias("x"))
    right = spark.range(10_000).select(F.lit(1).alias("g"), (F.col("id") * 3.0 + 1).alias("v"), F.col("id").alias("rid"))
    rows = R.nearest(left, right, ["g"], "x", "v", "rid").collect()
    assert len(rows) == 30_000 and max(r.distance for r in rows if r.x < 29_990) <= 1.5
    assert all(r.nearest_id == max(0, round((r.x - 1) / 3)) for r in rows if r.x < 29_990 and abs((r.x - 1) / 3 % 1 - 0.5) > 0.1)


def test_nearest_of_all_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.9, 0.1]), (3, None), (None, [5.0, 5.0]), (4, [1.0, 1.0, 1.0]), (100, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3)
    got = {r.vec_id: r.nearest_id for r in nearest_of_all(df, df.where("vec_id % 100 = 0"), "vec_id", "v").collect()}
    assert got == {0: 1, 100: 1}
    assert nearest_of_all(df.where("false"), df.where("false"), "vec_id", "v").count() == 0
