"""Derived measurements of building elements as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_positive(sources: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """The first source that isn't null or zero, and its name (``missing`` where none is)."""
    value = F.coalesce(*[F.nullif(c, F.lit(0.0)) for _, c in sources])
    name = F.coalesce(*[F.when(F.nullif(c, F.lit(0.0)).isNotNull(), n) for n, c in sources], F.lit("missing"))
    return value, name


def opening_width(width: Column, depth: Column, thin: float = 0.30) -> Column:
    """Opening width from a box: the longer side of a thin one, else the shorter; null if both are 0 (P5)."""
    small, large = F.least(width, depth), F.greatest(width, depth)
    return F.when(large > 0, F.when(small <= thin, large).otherwise(small))


def unswap(width: Column, height: Column, wide: float = 1.80, low: float = 1.50) -> tuple[Column, Column, Column]:
    """Width, height and whether they were exchanged: declared too wide and too low."""
    swapped = F.coalesce((width >= wide) & (height <= low), F.lit(False))
    return F.when(swapped, height).otherwise(width), F.when(swapped, width).otherwise(height), swapped


def extents(lo: Column, hi: Column) -> Column:
    """``width, depth, height, center`` of a box of two ``struct<x, y, z>`` corners."""
    return F.struct(
        F.abs(hi.x - lo.x).alias("width"),
        F.abs(hi.y - lo.y).alias("depth"),
        F.abs(hi.z - lo.z).alias("height"),
        F.struct(((lo.x + hi.x) / 2).alias("x"), ((lo.y + hi.y) / 2).alias("y"), ((lo.z + hi.z) / 2).alias("z")).alias("center"),
    )


def box_of(vertices: Column) -> Column:
    """Corners of ``array<struct<x, y, z>>`` (P1); null for no vertices."""

    def corner(f) -> Column:
        return F.struct(*[f(vertices[a]).alias(a) for a in "xyz"])

    return F.when(F.size(vertices) > 0, F.struct(corner(F.array_min).alias("lo"), corner(F.array_max).alias("hi")))


def ramp(width: Column, depth: Column, height: Column) -> Column:
    """Run, usable width and slope percent of a ramp's box; no slope without a run."""
    run = F.greatest(width, depth)
    return F.struct(run.alias("run"), F.least(width, depth).alias("usable"), F.when(run > 0, height / run * 100).alias("slope"))


def scaled(value: Column, scale: Column) -> Column:
    """A declared length in metres."""
    return F.when(scale != 1, value * scale).otherwise(value)


def passable_width(width: Column, least: float = 0.90, slack: float = 0.005, unknown: bool = True) -> Column:
    """Whether a width suffices in navigation; a null one counts as ``unknown`` says."""
    return F.coalesce(width + slack >= least, F.lit(unknown))


def hard_obstacle(kind: Column, slope: Column, width: Column) -> Column:
    """Columns and stairs always; ramps that are steep, narrow or not known to be neither."""
    bad_ramp = slope.isNull() | width.isNull() | (slope > 6.0 + 1e-9) | (width + 0.005 < 1.20)
    return kind.isin("IfcColumn", "IfcStair", "IfcStairFlight") | (kind.isin("IfcRamp", "IfcRampFlight") & bad_ramp)


def z_overlap(lo: Column, hi: Column, other_lo: Column, other_hi: Column, slack: float = 0.0) -> Column:
    """Whether two height ranges meet."""
    return (lo <= other_hi + slack) & (other_lo <= hi + slack)


def same_level(z: Column, other: Column, storey: Column, other_storey: Column, reach: float = 2.2) -> Column:
    """Whether two elements are on one level (F8)."""
    return F.coalesce(F.abs(z - other) <= reach, F.lit(False)) | F.coalesce(storey == other_storey, F.lit(False))
