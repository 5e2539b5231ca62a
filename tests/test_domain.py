"""A small building from boxes to issues, floors and packages."""

import os

import pytest
from pyspark.sql import functions as F

from plumbline.domain import elements as E
from plumbline.domain import explain, floors, inspection, package, routes
from plumbline.operators import grid

GOLDEN = os.environ.get("PLUMBLINE_GOLDEN_REPORT", "")
BOX = "guid string, ifc_type string, name string, ordinal int, storey string, bbox_min struct<x:double,y:double,z:double>, bbox_max struct<x:double,y:double,z:double>"


@pytest.fixture(scope="module")
def building(spark):
    rows = [
        ("D1", "IfcDoor", "d1", 1, "L0", (0.0, 0.0, 0.0), (1.0, 0.2, 2.1)),
        ("D2", "IfcDoor", "d2", 2, "L0", (5.0, 0.0, 0.0), (5.8, 0.1, 2.1)),
        ("D3", "IfcDoor", "d3", 3, None, (9.0, 0.0, 0.1), (10.0, 0.2, 2.2)),
        ("S1", "IfcSpace", "s1", 4, "L0", (0.0, 0.0, 0.0), (8.0, 1.4, 3.0)),
        ("S2", "IfcSpace", "s2", 5, "L0", (0.0, 0.0, 0.0), (8.0, 3.0, 3.0)),
        ("T1", "IfcStair", "t1", 6, "L0", (6.0, 1.0, 0.0), (7.0, 2.0, 3.0)),
        ("R1", "IfcRamp", "r1", 7, "L0", (0.0, 0.0, 0.0), (5.0, 1.0, 0.5)),
        ("X1", "IfcWall", "x1", 8, None, None, None),
    ]
    props = [("S1", "Reference", "Main Corridor", 1), ("S1", "Name", "main corridor", 2), ("S1", "Name", "West", 3), ("S2", "Name", "Toilet", 1), ("D3", "Name", "Curtain Wall door", 1), ("D1", "Width", "0,9", 1), ("D1", "ClearWidth", "0.95", 2)]
    raw = spark.createDataFrame(rows, BOX)
    properties = spark.createDataFrame(props, "guid string, name string, value string, ordinal int")
    return E.semantics(E.geometry(raw), E.semantic_text(properties)).cache(), properties


def test_measures_and_semantics(spark, building):
    rows = {r.guid: r for r in building[0].collect()}
    assert rows["D1"].derivedDoorWidthM == 1.0 and rows["D2"].derivedDoorWidthM == pytest.approx(0.8)
    assert rows["S1"].semanticText == "main corridor | west" and rows["S1"].spaceUsage == "corridor" and rows["S1"].isCorridorLike
    assert rows["S2"].isExcludedSpace and rows["S2"].spaceUsage == "toilet"
    assert rows["D3"].isRouteRelevantDoor is False and rows["D3"].routeDoorExclusionReason == "curtain_wall"
    assert (rows["R1"].rampRunLengthM, rows["R1"].rampUsableWidthM, rows["R1"].rampSlopePercent) == (5.0, 1.0, 10.0)
    assert rows["X1"].center is None and [r.guid for r in E.missing_geometry(building[0]).collect()] == ["X1"]
    assert E.first_property(building[1], ["Width", "ClearWidth"], "w").first().w == 0.95


def test_edges_issues_and_status(spark, building):
    els = building[0]
    boundaries = spark.createDataFrame([("S1", "D1", "IfcDoor"), ("S1", "D2", "IfcDoor"), ("S1", "D2", "IfcDoor"), ("S2", "D2", "IfcDoor"), ("S2", "D3", "IfcDoor"), ("S2", "X1", "IfcWall")], "space_guid string, element_guid string, element_type string")
    pairs = routes.door_pairs(els, E.door_spaces(boundaries))
    assert [tuple(r) for r in pairs.orderBy("edge_id").collect()] == [("E00001", "D1", "D2", "S1"), ("E00002", "D2", "D3", "S2")]
    stairs = routes.stair_approaches(els, 2)
    assert [tuple(r) for r in stairs.collect()] == [("E00003", "D2", "T1", "T1")]
    edges = routes.measure(pairs, els).withColumns(
        {"routeHasTurn": F.lit(False), "routeHitsStair": F.lit(False), "routeRampSlopePercent": F.lit(None).cast("double"), "routeRampUsableWidthM": F.lit(None).cast("double"), "routeNavigationBlocked": F.col("edge_id") == "E00002"}
    )
    found = routes.issues(els, edges)
    got = [(r.issue_id, r.focus, r.rule_id) for r in found.orderBy("issue_id").collect()]
    assert got == [
        ("I0001", "element/D2", "door_width"),
        ("I0002", "element/R1", "ramp_slope"),
        ("I0003", "element/R1", "ramp_width"),
        ("I0004", "element/S1", "corridor_width"),
        ("I0005", "route/E00001", "route_door_width"),
        ("I0006", "route/E00001", "route_width"),
        ("I0007", "route/E00002", "route_door_width"),
    ]
    status = {r.edge_id: (r.status, r.reasons) for r in routes.route_status(edges, found).collect()}
    assert status == {"E00001": ("fail", ["door_width", "route_width"]), "E00002": ("fail", ["door_width"])}
    with pytest.raises(Exception, match="blocked edge passed"):
        routes.route_status(edges, found.where("false")).collect()
    refs = floors.floor_refs(els)
    placed = floors.with_floor(els, refs)
    assert {r.guid: r.floor for r in placed.collect()}["D3"] == "L0"
    summary = floors.summaries(placed, routes.route_status(edges, found), found).first()
    assert summary.floor == "L0" and summary.doorGuids == ["D1", "D2", "D3"] and summary.issueCount == 7
    assert summary.routeStatusCounts == {"fail": 2} and summary.failureReasonCounts == {"door_width": 2, "route_width": 1}
    counts = {r.rule: r.n for r in explain.issue_counts(found).collect()}
    assert counts["door_width"] == 3
    assert explain.actions(found).first().action.startswith("3 findings of door_width (worst 0.80 m")
    assert explain.context(found, routes.route_status(edges, found)).first().failedRoutes == ["E00001", "E00002"]


def test_inspection_checks(spark, building):
    got = {(r.elementGuid, r.ruleId): r.status for r in inspection.checks(building[0]).collect()}
    assert got["D2", "door_width"] == "fail" and got["D2", "door_height"] == "advisory"
    assert got["S1", "corridor_slope"] == "unavailable" and ("S2", "corridor_width") not in got
    assert got["R1", "ramp_run_length"] == "pass"
    lengths = spark.createDataFrame([(1, 10.0), (2, 10.1), (3, None)], "guid int, derivedCorridorLengthM double").withColumns({"ifc_type": F.lit("IfcSpace"), "isCorridorLike": F.lit(True)})
    limits = {r.elementGuid: r.required for r in inspection.checks(lengths).where("ruleId = 'corridor_slope'").collect()}
    assert limits == {1: 4.0, 2: 3.0, 3: 3.0}


def test_tiles_round_trip(spark):
    runs = spark.createDataFrame([(1, 0, 0, 20), (1, 17, 3, 5)], "floor int, gy int, x0 int, x1 int")
    cut = grid.tile_runs(runs, 16)
    tiles = package.encode_tiles(cut, 16)
    assert sorted(map(tuple, package.decode_tiles(tiles, 16).collect())) == sorted(map(tuple, cut.collect()))
    with pytest.raises(Exception, match="checksum"):
        package.decode_tiles(tiles.withColumn("sha256", F.lit("0")), 16).collect()


def test_report_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("b", 'r|say "x"', None, None), ("a", "plain", None, None)], "focus string, message string, source_shape string, component string")
    lines = package.report_lines(rows).orderBy("k").select("value").coalesce(1)
    lines.write.text(str(tmp_path / "r"))
    back = package.read_report(spark, str(tmp_path / "r")).orderBy("focus").collect()
    assert [(r.focus, r.message) for r in back] == [("a", "plain"), ("b", 'r|say "x"')]
    code, text = package.split_message(F.col("message"))
    assert [tuple(r) for r in rows.select(code, text).collect()] == [("r", 'say "x"'), ("shacl_violation", "plain")]


@pytest.mark.skipif(not os.path.exists(GOLDEN), reason="no golden report")
def test_golden_report(spark):
    found = package.read_report(spark, "file://" + GOLDEN)
    code, _ = package.split_message(F.col("message"))
    counts = {r.rule: r["count"] for r in found.groupBy(code.alias("rule")).count().collect()}
    assert counts == {"route_door_width": 156, "stair_block": 10, "door_width": 8, "missing_door_width": 6, "corridor_width": 2, "route_turning_space": 2, "route_width": 2}
    assert found.select("focus").distinct().count() == 184


def test_greedy_levels_and_version_gate(spark):
    z = spark.createDataFrame([("b", v) for v in (0.0, 0.5, 3.0, 3.2)], "building string, z double")
    assert floors.greedy_levels(z).first().levels == pytest.approx([0.25, 3.1])
    with pytest.raises(Exception, match="version"):
        package.gate_version(spark.createDataFrame([(2,)], "formatVersion int")).collect()
