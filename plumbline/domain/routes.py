"""Candidate routes between doors, their measurements and rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.domain import values as V
from plumbline.operators import relational as R
from plumbline.operators.rules import Rule, violations
from plumbline.sources.shared import work_table

#: Route rules on rounded measures, in the order of their ids.
ROUTE_RULES = [
    Rule("route_door_width", "routeDoorWidthMinM", "minimum", V.DOOR_WIDTH, round_digits=4, unit="m"),
    Rule("route_width", "routeClearWidthM", "minimum", V.CORRIDOR_WIDTH, round_digits=4, unit="m"),
    Rule("route_turning_space", "routeTurningSpaceM", "minimum", V.TURNING_SPACE, round_digits=4, applies="routeHasTurn", unit="m"),
    Rule("stair_block", "routeHitsStair", "flag", 0.0, unit="bool"),
    Rule("route_ramp_slope", "routeRampSlopePercent", "maximum", V.RAMP_SLOPE, round_digits=4, unit="%"),
    Rule("route_ramp_width", "routeRampUsableWidthM", "minimum", V.RAMP_WIDTH, round_digits=4, unit="m"),
]

#: Element rules. A missing door width is a failure of its own.
ELEMENT_RULES = [
    Rule("door_width", "derivedDoorWidthM", "minimum", V.DOOR_WIDTH, round_digits=4, applies="ifc_type = 'IfcDoor' and isRouteRelevantDoor", unit="m"),
    Rule("missing_door_width", "derivedDoorWidthM", "present", applies="ifc_type = 'IfcDoor' and isRouteRelevantDoor", unit="m"),
    Rule("corridor_width", "derivedClearSpaceWidthM", "minimum", V.CORRIDOR_WIDTH, round_digits=4, applies="ifc_type = 'IfcSpace' and isCorridorLike", unless="isExcludedSpace", unit="m"),
    Rule("ramp_slope", "rampSlopePercent", "maximum", V.RAMP_SLOPE, round_digits=4, applies="ifc_type = 'IfcRamp'", unit="%"),
    Rule("ramp_width", "rampUsableWidthM", "minimum", V.RAMP_WIDTH, round_digits=4, applies="ifc_type = 'IfcRamp'", unit="m"),
]


def door_pairs(elements: DataFrame, door_spaces: DataFrame) -> DataFrame:
    """Candidate edges of doors that share a space, numbered by space and pair.

    Returns ``edge_id, start_guid, end_guid, via_space_guid`` and the endpoints' measures.
    """
    placed = elements.where("center is not null")
    doors = placed.where("ifc_type = 'IfcDoor'").select(F.col("guid").alias("door_guid"))
    spaces = placed.where("ifc_type = 'IfcSpace'").select(F.col("guid").alias("space_guid"))
    known = door_spaces.join(doors, "door_guid", "left_semi").join(spaces, "space_guid", "left_semi")
    pairs = R.pairs_in_group(known, "space_guid", "door_guid")
    numbered = R.number_rows(pairs, ["space_guid", "a", "b"], "k")
    return numbered.select(F.format_string("E%05d", "k").alias("edge_id"), F.col("a").alias("start_guid"), F.col("b").alias("end_guid"), F.col("space_guid").alias("via_space_guid"))


def stair_approaches(elements: DataFrame, offset: int = 0) -> DataFrame:
    """An edge from each stair to the nearest door on its level (J4, F8); ties take the first door.

    Levels are heights within 2.2 m or the same storey. Doors and stairs meet in cells of
    their height and in their storey, so each stair sees the doors of its level only; where
    elements have a ``building``, those of its own building.
    """
    reach = 2.2
    building = F.col("building") if "building" in elements.columns else F.lit("")
    placed = elements.where("center is not null")
    doors = placed.where("ifc_type = 'IfcDoor'").select(building.alias("u"), F.col("guid").alias("start_guid"), F.col("center").alias("d"), F.col("storey").alias("ds"), F.col("ordinal").alias("o"))
    stairs = placed.where(F.col("ifc_type").isin(V.STAIRS)).select(building.alias("u"), F.col("guid").alias("end_guid"), F.col("center").alias("s"), F.col("storey").alias("ss"))
    cell = lambda z: F.floor(z / reach)
    near = stairs.withColumn("c", F.explode(F.sequence(cell(F.col("s.z")) - 1, cell(F.col("s.z")) + 1))).join(doors.withColumn("c", cell(F.col("d.z"))), ["u", "c"]).where(F.abs(F.col("d.z") - F.col("s.z")) <= reach).drop("c")
    same = stairs.withColumn("ds", F.col("ss")).join(doors, ["u", "ds"])
    gap = F.sqrt(reduce(lambda a, b: a + b, [(F.col(f"d.{x}") - F.col(f"s.{x}")) ** 2 for x in "xyz"]))
    best = near.select(same.columns).unionByName(same).withColumn("gap", gap).groupBy("end_guid").agg(F.min(F.struct("gap", "o", "start_guid")).alias("m"))
    numbered = R.number_rows(best, ["end_guid"], "k")
    return numbered.select(F.format_string("E%05d", F.col("k") + offset).alias("edge_id"), "m.start_guid", "end_guid", F.col("end_guid").alias("via_space_guid"))


def measure(edges: DataFrame, elements: DataFrame) -> DataFrame:
    """Edges with the least door width and the clear and turning widths of their space."""
    width = elements.select("guid", "derivedDoorWidthM")
    a = width.select(F.col("guid").alias("start_guid"), F.col("derivedDoorWidthM").alias("_a"))
    b = width.select(F.col("guid").alias("end_guid"), F.col("derivedDoorWidthM").alias("_b"))
    via = elements.select(F.col("guid").alias("via_space_guid"), F.col("derivedClearSpaceWidthM").alias("routeClearWidthM"), F.col("turningSpaceM").alias("routeTurningSpaceM"))
    rows = edges.join(a, "start_guid", "left").join(b, "end_guid", "left").join(via, "via_space_guid", "left")
    return rows.withColumn("routeDoorWidthMinM", F.least("_a", "_b")).drop("_a", "_b")


def overwrite(edges: DataFrame, audited: DataFrame) -> DataFrame:
    """Edges with the facts of audited navigation instead of the provisional ones, where there are any."""
    facts = [c for c in audited.columns if c != "edge_id"]
    given = audited.select("edge_id", F.lit(True).alias("_seen"), *[F.col(c).alias(f"_{c}") for c in facts])
    rows = edges.join(given, "edge_id", "left")
    for c in facts:
        old = F.col(c) if c in edges.columns else F.lit(None)
        rows = rows.withColumn(c, F.when(F.col("_seen"), F.col(f"_{c}")).otherwise(old)).drop(f"_{c}")
    return rows.drop("_seen")


def issues(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """Issues of elements and routes, numbered by focus and rule; routes name their space, else their start."""
    keys = ["focus", "element_guid", "edge_id"]
    own = violations(elements.withColumns({"focus": F.concat(F.lit("element/"), "guid"), "element_guid": F.col("guid"), "edge_id": F.lit(None).cast("string")}), ELEMENT_RULES, keys)
    routes = edges.withColumns({"focus": F.concat(F.lit("route/"), "edge_id"), "element_guid": F.coalesce("via_space_guid", "start_guid")})
    caused = violations(routes, ROUTE_RULES, keys)
    blocked = routes.where("coalesce(routeNavigationBlocked, false)").join(caused.select("edge_id"), "edge_id", "left_anti")
    alone = blocked.select(*keys, F.lit("unreachable").alias("rule_id"), F.lit("fail").alias("status"), F.lit(None).cast("double").alias("measured"), F.lit(None).cast("double").alias("required"), F.lit("").alias("unit"))
    found = own.unionByName(caused).unionByName(alone)
    known = found.join(elements.select(F.col("guid").alias("element_guid")), "element_guid", "left_semi")
    return R.number_rows(known, ["focus", "rule_id"], "k").withColumn("issue_id", F.format_string("I%04d", "k")).drop("k")


def route_status(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges with ``status`` and sorted distinct ``reasons`` (R13); a blocked edge that passes is an error."""
    names = F.create_map(*[F.lit(x) for kv in V.ROUTE_REASONS.items() for x in kv])
    reason = F.coalesce(F.element_at(names, F.col("rule_id")), F.col("rule_id"))
    got = found.where("edge_id is not null").groupBy("edge_id").agg(F.array_sort(F.collect_set(reason)).alias("reasons"))
    rows = edges.drop("status", "reasons").join(got, "edge_id", "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))
    status = F.when(F.size("reasons") > 0, "fail").otherwise("pass")
    blocked = F.coalesce(F.col("routeNavigationBlocked"), F.lit(False))
    return rows.withColumn("status", F.when(blocked & (F.size("reasons") == 0), F.raise_error(F.lit("a blocked edge passed the rules"))).otherwise(status))


def adjacency(edges: DataFrame) -> DataFrame:
    """Each edge from both ends, the path reversed for the way back."""
    back = edges.withColumns({"start_guid": F.col("end_guid"), "end_guid": F.col("start_guid"), "path": F.reverse("path")})
    return edges.unionByName(back)


def routes_by_door(edges: DataFrame, doors: DataFrame, passing_only: bool = False) -> DataFrame:
    """Shortest routes from every door with their edge lists."""
    from plumbline.operators.graph import shortest_paths

    used = edges.where("status = 'pass'") if passing_only else edges
    links = work_table(used.select("edge_id", F.col("start_guid").alias("src"), F.col("end_guid").alias("dst"), F.col("distance_m").alias("weight")), "links")
    return shortest_paths(links, doors.select(F.col("guid").alias("source")))
