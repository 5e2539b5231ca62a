"""Element tables: scans, semantics and derived measures.

Canonical input is Parquet or JSON: ``elements`` (guid, ifc_type, name, ordinal, center,
bbox_min, bbox_max as ``struct<x, y, z>``, storey, declared measures), ``properties``
(guid, name, value, ordinal), ``containment`` (guid, storey, ordinal), ``boundaries``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.domain import values as V
from plumbline.functions import measures as M
from plumbline.functions.text import ladder


def missing_geometry(elements: DataFrame) -> DataFrame:
    """Guids of elements without a box."""
    return elements.where("bbox_min is null or bbox_max is null").select("guid")


def with_storey(elements: DataFrame, containment: DataFrame) -> DataFrame:
    """Elements with the storey of their first containment (S3)."""
    first = containment.groupBy("guid").agg(F.min_by("storey", "ordinal").alias("storey"))
    return elements.drop("storey").join(first, "guid", "left")


def first_property(properties: DataFrame, names: list[str], name: str) -> DataFrame:
    """``guid, name``: the first property of a list of names that is a number."""
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name"))
    numbers = properties.where(F.col("name").isin(names)).withColumn("_v", F.col("value").try_cast("double")).where("_v is not null")
    return numbers.groupBy("guid").agg(F.min_by("_v", F.struct(rank, F.col("ordinal"))).alias(name))


def semantic_text(properties: DataFrame) -> DataFrame:
    """``guid, semanticText``: distinct semantic values without regard to case, in order, lower-cased."""
    kept = properties.where(F.col("name").isin(V.SEMANTIC_PROPERTIES) & (F.trim("value") != ""))
    first = F.row_number().over(Window.partitionBy("guid", F.lower(F.trim("value"))).orderBy("ordinal"))
    rows = kept.withColumn("_k", first).where("_k = 1")
    parts = F.array_sort(F.collect_list(F.struct("ordinal", F.trim("value").alias("v"))))
    return rows.groupBy("guid").agg(parts.alias("p")).select("guid", F.lower(F.array_join(F.transform("p", lambda s: s.v), " | ")).alias("semanticText"))


def space_usage(text: Column) -> Column:
    """Use of a space from its text, or null."""
    return F.nullif(ladder(F.concat(F.lit(" "), text, F.lit(" ")), V.SPACE_USAGE, "", ""), F.lit(""))


def door_exclusion(text: Column, height: Column) -> Column:
    """Why a door is no route door, or null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(F.contains(low, F.lit("toilet partition")), "toilet_partition")
        .when(F.contains(low, F.lit("curtain wall")), "curtain_wall")
        .when(F.contains(low, F.lit("partition")) & (height < 1.80), "low_partition")
    )


def semantics(elements: DataFrame, texts: DataFrame) -> DataFrame:
    """Elements with their text, use and flags."""
    rows = elements.join(texts, "guid", "left")
    space, door = F.col("ifc_type") == "IfcSpace", F.col("ifc_type") == "IfcDoor"
    rows = rows.withColumn("spaceUsage", F.when(space, space_usage(F.col("semanticText"))))
    usage = F.coalesce("spaceUsage", F.lit(""))
    rows = rows.withColumn("routeDoorExclusionReason", F.when(door, door_exclusion(F.col("semanticText"), F.col("height"))))
    return rows.withColumns(
        {
            "isCorridorLike": F.when(space, usage.isin(V.CORRIDOR_LIKE)),
            "isExcludedSpace": F.when(space, usage.isin(V.EXCLUDED_SPACES)),
            "isRouteRelevantDoor": F.when(door, F.col("routeDoorExclusionReason").isNull()),
        }
    )


def geometry(elements: DataFrame) -> DataFrame:
    """Elements with extents, centre, opening width, ramp and space measures."""
    rows = elements.withColumn("_x", M.extents(F.col("bbox_min"), F.col("bbox_max")))
    rows = rows.withColumns({"width": F.col("_x.width"), "depth": F.col("_x.depth"), "height": F.col("_x.height"), "center": F.when(F.col("bbox_min").isNotNull(), F.col("_x.center"))}).drop("_x")
    ramp = M.ramp(F.col("width"), F.col("depth"), F.col("height"))
    is_ramp, is_space = F.col("ifc_type").isin(V.RAMPS), F.col("ifc_type") == "IfcSpace"
    return rows.withColumns(
        {
            "derivedDoorWidthM": F.when(F.col("ifc_type") == "IfcDoor", M.opening_width(F.col("width"), F.col("depth"))),
            "rampRunLengthM": F.when(is_ramp, ramp.run),
            "rampUsableWidthM": F.when(is_ramp, ramp.usable),
            "rampSlopePercent": F.when(is_ramp, ramp.slope),
            "derivedClearSpaceWidthM": F.when(is_space, F.least("width", "depth")),
            "turningSpaceM": F.when(is_space, F.least("width", "depth")),
            "derivedCorridorLengthM": F.when(is_space, F.greatest("width", "depth")),
        }
    )


def floor_slope(faces: DataFrame, least_area: float = 0.01, least_share: float = 0.005) -> DataFrame:
    """``guid, slope``: the steepest slope (to 2 places) with enough projected area, of faces low in a space.

    ``faces`` has ``guid, z, z_low, z_high, slope, area``.
    """
    low = faces.where(F.col("z") <= F.col("z_low") + F.least(F.lit(1.5), (F.col("z_high") - F.col("z_low")) * 0.45))
    sums = low.groupBy("guid", F.round("slope", 2).alias("slope")).agg(F.sum("area").alias("area"))
    total = F.sum("area").over(Window.partitionBy("guid"))
    return sums.withColumn("_t", total).where(F.col("area") >= F.greatest(F.lit(least_area), F.col("_t") * least_share)).groupBy("guid").agg(F.max("slope").alias("slope"))


def labels(elements: DataFrame) -> DataFrame:
    """Elements with ``label``: type and name, and for spaces the first semantic name that differs."""
    base = F.concat_ws(" ", "ifc_type", "name")
    names = F.filter(F.array("semanticLongName", "semanticPsetName", "semanticCategory"), lambda v: v.isNotNull() & (v != "") & (F.lower(v) != F.lower(F.col("name"))))
    return elements.withColumn("label", F.when((F.col("ifc_type") == "IfcSpace") & (F.size(names) > 0), F.concat_ws(" ", base, F.element_at(names, 1))).otherwise(base))


def door_spaces(boundaries: DataFrame) -> DataFrame:
    """Distinct ``door_guid, space_guid``."""
    return boundaries.where("element_type = 'IfcDoor'").select(F.col("element_guid").alias("door_guid"), "space_guid").distinct()


def open_portals(boundaries: DataFrame) -> DataFrame:
    """Virtual internal boundaries as portals between two spaces, merged by pair."""
    open_rows = boundaries.where("upper(physical_or_virtual) = 'VIRTUAL' and upper(internal_or_external) = 'INTERNAL'")
    pairs = open_rows.select(F.least("space_guid", "other_space_guid").alias("a"), F.greatest("space_guid", "other_space_guid").alias("b"), "width", "height")
    return pairs.where("a < b").groupBy("a", "b").agg(F.max("width").alias("width_m"), F.min("height").alias("height_m"))


def storey_elevations(storeys: DataFrame) -> DataFrame:
    """``storey, elevation``: of the placement, else the attribute."""
    return storeys.select("storey", F.coalesce("placement_z", "elevation").alias("elevation"))


def door_hosts(doors: DataFrame, fills: DataFrame, voids: DataFrame) -> DataFrame:
    """Doors with their opening and its wall."""
    return doors.join(fills, "door_guid", "left").join(voids, "opening_guid", "left")
