"""Inspection checks of doors, corridors and ramps: raw measures, a tolerance of 1e-6, advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.domain import values as V
from plumbline.functions.text import stable_id
from plumbline.operators.rules import Rule, evaluate

SLACK = 1e-6


def rules() -> list[Rule]:
    """The checks (R16, R17, R18); a corridor's slope limit depends on its length."""
    slope = F.when(F.col("derivedCorridorLengthM") <= V.SHORT_CORRIDOR, V.SHORT_CORRIDOR_SLOPE).otherwise(V.CORRIDOR_SLOPE)
    door, space, ramp = "ifc_type = 'IfcDoor'", "ifc_type = 'IfcSpace' and isCorridorLike", "ifc_type in ('IfcRamp', 'IfcRampFlight')"
    return [
        Rule("door_width", "doorWidth", "minimum", V.DOOR_WIDTH, SLACK, applies=door, unit="m"),
        Rule("door_height", "doorHeight", "minimum", V.DOOR_HEIGHT, SLACK, on_missing="advisory", on_fail="advisory", applies=door, unit="m"),
        Rule("corridor_width", "derivedClearSpaceWidthM", "minimum", V.CORRIDOR_WIDTH, SLACK, applies=space, unit="m"),
        Rule("corridor_slope", "derivedCorridorSlopePercent", "maximum", slope, SLACK, applies=space, unit="%"),
        Rule("turning_space", "turningSpaceM", "minimum", V.TURNING_SPACE, SLACK, applies=space, unit="m"),
        Rule("ramp_width", "rampWidth", "minimum", V.RAMP_WIDTH, SLACK, applies=ramp, unit="m"),
        Rule("ramp_slope", "rampSlope", "maximum", V.RAMP_SLOPE, SLACK, applies=ramp, unit="%"),
        Rule("ramp_run_length", "rampRun", "maximum", V.RAMP_RUN, SLACK, applies=ramp, unit="m"),
    ]


#: Measure of a check and the columns it is taken from, first non-null wins.
SOURCES = {
    "doorWidth": ["inspectionDoorWidthM", "derivedDoorWidthM"],
    "doorHeight": ["inspectionDoorHeightM", "derivedDoorHeightM"],
    "rampWidth": ["planRampUsableWidthM", "rampUsableWidthM"],
    "rampSlope": ["planRampSlopePercent", "rampSlopePercent"],
    "rampRun": ["planRampRunLengthM", "inspectionRampRunLengthM", "rampRunLengthM"],
}


def checks(elements: DataFrame) -> DataFrame:
    """``checkId, elementGuid, ruleId, status, measured, required, unit`` in one pass over elements."""
    needed = {c for cs in SOURCES.values() for c in cs} | {"derivedClearSpaceWidthM", "derivedCorridorSlopePercent", "derivedCorridorLengthM", "turningSpaceM"}
    rows = elements.withColumns({c: F.lit(None).cast("double") for c in needed - set(elements.columns)})
    if "isCorridorLike" not in elements.columns:
        rows = rows.withColumn("isCorridorLike", F.lit(False))
    rows = rows.withColumns({m: F.coalesce(*cs) for m, cs in SOURCES.items()})
    out = evaluate(rows, rules(), ["guid"])
    return out.select(stable_id("I", F.col("guid"), F.col("rule_id")).alias("checkId"), F.col("guid").alias("elementGuid"), F.col("rule_id").alias("ruleId"), "status", F.round("measured", 4).alias("measured"), "required", "unit")


def failed_regions(found: DataFrame, issues: DataFrame) -> DataFrame:
    """Failing checks with the issue they show, else their own id."""
    known = issues.select(F.col("element_guid").alias("elementGuid"), F.col("rule_id").alias("ruleId"), "issue_id").groupBy("elementGuid", "ruleId").agg(F.max("issue_id").alias("issue_id"))
    return found.where("status = 'fail'").join(known, ["elementGuid", "ruleId"], "left").withColumn("region_id", F.coalesce("issue_id", "checkId"))
