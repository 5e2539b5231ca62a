"""Plan routes: their reasons, floors, ramps and accounting, and what a list or a plan shows of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.domain import values as V

#: The reason, the measure, its comparison and its limit, in the order that reasons are told.
PLAN_REASONS = [
    ("door_width", "routeDoorWidthMinM", "below", V.DOOR_WIDTH),
    ("route_width", "routeClearWidthM", "below", V.CORRIDOR_WIDTH),
    ("turning_space", "routeTurningSpaceM", "below", V.TURNING_SPACE),
    ("stair_block", "routeHitsStair", "set", None),
    ("ramp_slope", "routeRampSlopePercent", "above", V.RAMP_SLOPE),
    ("ramp_width", "routeRampUsableWidthM", "below", V.RAMP_WIDTH),
    ("ramp_run_length", "routeRampRunLengthM", "above", V.RAMP_RUN),
]


def plan_reasons() -> Column:
    """The reasons against a plan route as an array; raw measures, a missing one is no reason."""

    def holds(name: str, measure: str, kind: str, limit: float | None) -> Column:
        m = F.col(measure)
        if kind == "set":
            return F.coalesce(m, F.lit(False))
        broken = F.coalesce(m < limit if kind == "below" else m > limit, F.lit(False))
        return broken & F.coalesce(F.col("routeHasTurn"), F.lit(False)) if name == "turning_space" else broken

    return F.filter(F.array(*[F.when(holds(*r), F.lit(r[0])) for r in PLAN_REASONS]), lambda x: x.isNotNull())


def _holds_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def gross_area(*texts: Column) -> Column:
    """Whether a space's texts tell a gross area, which is no room."""
    return _holds_any(F.lower(F.concat_ws(" ", *texts)), V.GROSS_AREA)


def lift_door(name: Column, label: Column) -> Column:
    """Whether a door belongs to a lift."""
    return _holds_any(F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(label, F.lit("")))), V.LIFT)


def issue_list(rule: Column, severity: Column) -> Column:
    """The list an issue is shown in (F12, J24): ``advisory``, ``building``, or none."""
    advisory = F.coalesce(rule.isin(V.DOOR_HEIGHT_RULES), F.lit(False))
    hidden = F.coalesce(severity == "info", F.lit(False)) | F.coalesce(rule.isin(V.ROUTE_RULE_IDS), F.lit(False))
    return F.when(advisory, "advisory").when(~hidden, "building")


def element_advisories(issues: DataFrame, checks: DataFrame) -> DataFrame:
    """``element_guid, rule_id, source``: door-height issues, then advisory checks that no issue tells already."""
    told = issues.where(F.col("rule_id").isin(V.DOOR_HEIGHT_RULES)).select("element_guid", "rule_id", F.lit("issue").alias("source"))
    advised = checks.where("status = 'advisory'").select(F.col("elementGuid").alias("element_guid"), F.col("ruleId").alias("rule_id"), F.lit("check").alias("source"))
    return told.unionByName(advised.join(told.select("element_guid", "rule_id"), ["element_guid", "rule_id"], "left_anti"))


def plan_visible(roles: Column, local_route: Column, blocking: Column) -> Column:
    """Whether a plan shows an edge (F13): by its roles, or unless it is a local route that nothing blocks."""
    words = F.split(F.coalesce(roles, F.lit("")), " ")
    shown = F.array_contains(words, "physical") | F.array_contains(words, "issue")
    return shown | ~F.coalesce(local_route, F.lit(False)) | F.coalesce(blocking, F.lit(False))


def floor_table(refs: DataFrame, building: str) -> DataFrame:
    """``building, floors``: the named elevations of a building, a row for each; a building has a bounded number."""
    return refs.groupBy(building).agg(F.array_sort(F.collect_list(F.struct(F.col("name").alias("name"), F.col("elevation").cast("double").alias("z")))).alias("floors"))


def ramp_storeys(ramps: DataFrame, refs: DataFrame, building: str, reach: float = 0.40) -> DataFrame:
    """Ramps with the storeys their ends touch (P23): ``display, connected, offset, mismatch``.

    ``ramps`` has ``lower, upper, storey``. The storey itself is shown where it is touched, else the
    nearest; ramps that touch none have nulls.
    """
    met = ramps.join(floor_table(refs, building), building, "left")
    near = F.transform("floors", lambda f: F.struct(F.least(F.abs(f.z - F.col("lower")), F.abs(f.z - F.col("upper"))).alias("gap"), f["name"].alias("name")))
    met = met.withColumn("_near", F.array_sort(F.filter(near, lambda f: f.gap <= reach)))
    names = F.transform("_near", lambda f: f["name"])
    some = F.size("_near") > 0
    own = F.coalesce(F.array_contains(names, F.col("storey")), F.lit(False))
    shown = met.withColumns({"connected": F.when(some, names), "display": F.when(some, F.when(own, F.col("storey")).otherwise(F.get(names, F.lit(0)))), "offset": F.when(some, F.get("_near", F.lit(0)).gap)})
    return shown.withColumn("mismatch", F.coalesce(F.col("storey") != F.col("display"), F.lit(False))).drop("_near", "floors")


def edge_floor(edges: DataFrame, placed: DataFrame, refs: DataFrame, building: str, reach: float = 1.8) -> DataFrame:
    """Edges with ``floor`` (J25): that of the start, end or via element, else of the height, else the height itself.

    ``edges`` has ``start, stop, via, z`` (the path's mean height, null without points), ``placed`` has
    ``guid, floor``. The nearest floor of the building counts within ``reach``; ties take the first by name.
    """
    rows = edges
    for end in ("start", "stop", "via"):
        rows = rows.join(placed.select(F.col("guid").alias(end), F.col("floor").alias(f"_{end}")), end, "left")
    rows = rows.join(floor_table(refs, building), building, "left")
    gaps = F.transform("floors", lambda f: F.struct(F.abs(f.z - F.col("z")).alias("gap"), f["name"].alias("name")))
    best = F.array_min(gaps)
    by_height = F.when(F.col("z").isNotNull(), F.when(best.gap <= reach, best["name"]).otherwise(F.concat(F.lit("z="), F.format_string("%.2f", "z"))))
    return rows.withColumn("floor", F.coalesce("_start", "_stop", "_via", by_height)).drop("_start", "_stop", "_via", "floors")


def accounting(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges by outcome (A19): ``edges, passed, blocked, unavailable, swapped``; counts that don't add up are an error."""
    counts = edges.groupBy(*keys).agg(
        F.count("*").alias("edges"),
        F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(F.col("status") == "blocked").alias("blocked"),
        F.count_if(F.col("status") == "unavailable").alias("unavailable"),
        F.count_if(F.col("swapped")).alias("swapped"),
    )
    whole = F.col("passed") + F.col("blocked") + F.col("unavailable") == F.col("edges")
    return counts.withColumn("edges", F.when(whole, F.col("edges")).otherwise(F.raise_error(F.lit("edges of another outcome"))))


def compose(legs: DataFrame, chain: str) -> DataFrame:
    """``chain, path, whole``: the legs of each chain as one path, turned where they are walked backwards.

    ``legs`` has ``seq, at`` (where the walk stands), ``start, stop, path``. ``whole`` is false where a leg
    doesn't begin at ``at`` or a chain has fewer than two points. Points that repeat are taken once.
    """
    turned = F.when(F.col("at") == F.col("start"), F.col("path")).when(F.col("at") == F.col("stop"), F.reverse("path"))
    joined = legs.withColumn("_leg", turned).groupBy(chain).agg(F.array_sort(F.collect_list(F.struct("seq", F.col("_leg").alias("leg")))).alias("_legs"))
    points = F.flatten(F.transform("_legs", lambda x: F.coalesce(x.leg, F.array().cast("array<struct<x:double,y:double>>"))))
    fresh = F.filter(points, lambda p, i: (i == 0) | (F.hypot(p.x - F.get(points, i - 1).x, p.y - F.get(points, i - 1).y) > 1e-9))
    found = joined.select(chain, fresh.alias("path"), F.forall("_legs", lambda x: x.leg.isNotNull()).alias("whole"))
    return found.withColumn("whole", F.col("whole") & (F.size("path") >= 2))
