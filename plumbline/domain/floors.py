"""Floors: references, assignment and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.domain import values as V


def floor_refs(elements: DataFrame) -> DataFrame:
    """``storey, ref_z``: mean centre height of a storey's doors; of all its elements where no storey has doors."""
    rows = elements.where("storey is not null and center is not null").withColumn("_door", F.col("ifc_type") == "IfcDoor")
    any_door = rows.agg(F.max("_door").alias("_any"))
    kept = rows.join(F.broadcast(any_door), F.lit(True)).where(F.col("_door") | ~F.col("_any"))
    return kept.groupBy("storey").agg(F.avg("center.z").alias("ref_z"))


def by_height(z: Column) -> Column:
    """Name of a floor that is known by its height alone."""
    return F.format_string("z=%.2f", z)


def with_floor(elements: DataFrame, refs: DataFrame, reach: float = 1.8) -> DataFrame:
    """Elements with ``floor``: their storey, else the nearest reference within reach, else their height."""
    homeless = elements.withColumn("_z", F.when(F.col("storey").isNull(), F.col("center.z")))
    near = _nearest_small(homeless, refs)
    return near.withColumn("floor", F.coalesce("storey", F.when(F.col("_gap") <= reach, F.col("_name")), by_height(F.col("center.z")))).drop("_z", "_gap", "_name")


def _nearest_small(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """The nearest reference by a scan of all of them: floors of a building, packed to one row."""
    packed = refs.agg(F.array_sort(F.collect_list(F.struct("ref_z", "storey"))).alias("_refs"))
    seen = rows.join(F.broadcast(packed), F.lit(True), "left")
    best = F.array_min(F.transform("_refs", lambda r: F.struct(F.abs(r.ref_z - F.col("_z")).alias("gap"), r.storey.alias("name"))))
    return seen.withColumn("_best", F.when(F.col("_z").isNotNull(), best)).withColumns({"_gap": F.col("_best.gap"), "_name": F.col("_best.name")}).drop("_refs", "_best")


def median_door_bottom(elements: DataFrame) -> DataFrame:
    """``floor, elevation``: median door bottom."""
    return elements.where("ifc_type = 'IfcDoor' and bbox_min is not null").groupBy("floor").agg(F.median("bbox_min.z").alias("elevation"))


def summaries(elements: DataFrame, edges: DataFrame, issues: DataFrame) -> DataFrame:
    """One row a floor that shows something, by elevation and name."""
    n = issues.groupBy(F.col("element_guid").alias("guid")).agg(F.count("*").alias("n"))
    rows = elements.join(n, "guid", "left")

    def ids(kinds: list[str]) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("ifc_type").isin(kinds), F.col("guid"))))

    per_floor = rows.where("floor is not null").groupBy("floor").agg(
        F.min_by("center.z", F.when(F.col("center").isNotNull(), F.col("ordinal"))).alias("elevation"),
        F.count("*").alias("elements"),
        ids(["IfcDoor"]).alias("doorGuids"),
        ids(["IfcSpace"]).alias("spaceGuids"),
        ids(V.STAIRS).alias("stairGuids"),
        ids(V.RAMPS).alias("rampGuids"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("issueCount"),
    )
    start = elements.select(F.col("guid").alias("start_guid"), F.coalesce("storey", by_height(F.col("center.z"))).alias("floor"))
    placed = edges.join(start, "start_guid")

    def counts(df: DataFrame, kind: str, name: str) -> DataFrame:
        return df.groupBy("floor", kind).agg(F.count("*").alias("c")).groupBy("floor").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "c")))).alias(name))

    routes = placed.groupBy("floor").agg(F.array_sort(F.collect_list("edge_id")).alias("routeEdgeIds"))
    out = per_floor.join(routes, "floor", "left").join(counts(placed, "status", "routeStatusCounts"), "floor", "left").join(counts(placed.select("floor", F.explode("reasons").alias("reason")), "reason", "failureReasonCounts"), "floor", "left")
    shown = (F.size("doorGuids") > 0) | F.col("routeEdgeIds").isNotNull() | (F.col("issueCount") > 0)
    return out.where(shown).orderBy(F.coalesce("elevation", F.lit(999999.0)), "floor")


def greedy_levels(heights: DataFrame, reach: float = 1.8) -> DataFrame:
    """Levels of sorted heights by a running pairwise mean (A7): ``building, levels``; depends on the order."""
    zs = heights.groupBy("building").agg(F.array_sort(F.collect_list("z")).alias("zs"))

    def add(levels: Column, z: Column) -> Column:
        last = F.element_at(levels, -1)
        return F.when((F.size(levels) > 0) & (F.abs(last - z) <= reach), F.concat(F.slice(levels, F.lit(1), F.size(levels) - 1), F.array((last + z) / 2))).otherwise(F.concat(levels, F.array(z)))

    first = F.slice("zs", 1, 1)
    rest = F.slice("zs", F.lit(2), F.size("zs"))
    return zs.select("building", F.aggregate(rest, first, add).alias("levels"))


def row_order(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key (keep-first dedupe, W4)."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_k", k).where("_k = 1").drop("_k")
