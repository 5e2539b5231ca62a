"""Polyline operators on ``array<struct<x, y>>`` columns, as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def steps(path: Column) -> Column:
    """Vectors between consecutive points; empty for fewer than two points."""
    n = F.size(path)
    pairs = F.zip_with(F.slice(path, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(path, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct((b.x - a.x).alias("x"), (b.y - a.y).alias("y")))
    return F.when(n >= 2, pairs).otherwise(F.array().cast(POINTS))


def length(path: Column) -> Column:
    """Length of a path (L1)."""
    return F.aggregate(steps(path), F.lit(0.0), lambda s, d: s + F.sqrt(d.x * d.x + d.y * d.y))


def crosses(path: Column) -> Column:
    """Unnormalised cross products at inner points."""
    d = steps(path)
    n = F.size(d)
    both = F.zip_with(F.slice(d, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(d, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a.x * b.y - a.y * b.x)
    return F.when(n >= 2, both).otherwise(F.array().cast("array<double>"))


def turns(path: Column, least: float = 0.05) -> Column:
    """Number of inner points whose cross product exceeds ``least`` (L2)."""
    return F.size(F.filter(crosses(path), lambda c: F.abs(c) > least))


def dedupe(path: Column, within: float = 1e-8) -> Column:
    """The path without points that equal the one kept before."""

    def add(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        return F.when((F.abs(last.x - p.x) <= within) & (F.abs(last.y - p.y) <= within), kept).otherwise(F.concat(kept, F.array(p)))

    return F.when(F.size(path) > 0, F.aggregate(F.slice(path, F.lit(2), F.size(path)), F.slice(path, 1, 1), add)).otherwise(path)


def compact(path: Column, within: float = 1e-8) -> Column:
    """The path without inner points on the line of the last kept point and the next."""
    index = F.sequence(F.lit(2), F.size(path) - 1)

    def add(kept: Column, i: Column) -> Column:
        a, b, c = F.element_at(kept, -1), F.element_at(path, i), F.element_at(path, i + 1)
        cross = (b.x - a.x) * (c.y - b.y) - (b.y - a.y) * (c.x - b.x)
        return F.when(F.abs(cross) <= within, kept).otherwise(F.concat(kept, F.array(b)))

    inner = F.aggregate(index, F.slice(path, 1, 1), add)
    return F.when(F.size(path) > 2, F.concat(inner, F.slice(path, -1, 1))).otherwise(path)


def sample(path: Column, step: float) -> Column:
    """Points every ``step`` along each leg, from its start, and the last point (L4)."""
    n = F.size(path)

    def leg(i: Column) -> Column:
        a, b = F.element_at(path, i), F.element_at(path, i + 1)
        d = F.sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))
        k = F.greatest(F.lit(1), F.floor(d / step).cast("int"))
        return F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct((a.x + (b.x - a.x) * j / k).alias("x"), (a.y + (b.y - a.y) * j / k).alias("y")))

    return F.when(n >= 2, F.concat(F.flatten(F.transform(F.sequence(F.lit(1), n - 1), leg)), F.slice(path, -1, 1))).otherwise(path)


def at_progress(path: Column, share: float) -> Column:
    """The point at a share of the length."""
    want = length(path) * share
    start = F.struct(F.lit(0.0).alias("gone"), F.element_at(path, 1).x.alias("x"), F.element_at(path, 1).y.alias("y"), F.lit(False).alias("done"))

    def walk(s: Column, d: Column) -> Column:
        n = F.sqrt(d.x * d.x + d.y * d.y)
        part = F.when(n > 0, F.least(F.lit(1.0), (want - s.gone) / n)).otherwise(F.lit(0.0))
        return F.when(s.done, s).otherwise(F.struct((s.gone + n).alias("gone"), (s.x + d.x * part).alias("x"), (s.y + d.y * part).alias("y"), (s.gone + n >= want).alias("done")))

    return F.aggregate(steps(path), start, walk, lambda s: F.struct(s.x.alias("x"), s.y.alias("y")))


def turn_points(path: Column, least: float = 0.15, leg: float = 0.35) -> Column:
    """Inner points where the direction turns: the normalised cross product exceeds ``least``, both legs are ``leg`` or more (L3)."""

    def turned(p: Column, i: Column) -> Column:
        before, after = F.get(path, i - 1), F.get(path, i + 1)
        ax, ay, bx, by = p.x - before.x, p.y - before.y, after.x - p.x, after.y - p.y
        a, b = F.hypot(ax, ay), F.hypot(bx, by)
        known = F.coalesce((F.least(a, b) >= leg) & (a * b > 1e-6), F.lit(False)) & (i > 0) & (i < F.size(path) - 1)
        return F.when(known, F.abs(ax * by - ay * bx) / (a * b) > least).otherwise(False)

    return F.filter(path, turned)


def connector(a: Column, b: Column) -> Column:
    """The path from one point along x, then along y, to another (L6); points that repeat are taken once."""
    middle = F.struct(b.x.alias("x"), a.y.alias("y"))
    same = lambda p, q: (F.abs(p.x - q.x) <= 1e-8) & (F.abs(p.y - q.y) <= 1e-8)
    inner = F.when(same(a, middle) | same(middle, b), F.array().cast(POINTS)).otherwise(F.array(middle).cast(POINTS))
    last = F.when(same(a, b), F.array().cast(POINTS)).otherwise(F.array(b).cast(POINTS))
    return F.concat(F.array(a).cast(POINTS), inner, last)


def densify(path: Column, step: float = 0.12) -> Column:
    """Points at most ``step`` apart on the legs of an orthogonal path, and the last point (L5); a diagonal leg is an error."""
    n = F.size(path)

    def leg(i: Column) -> Column:
        a, b = F.element_at(path, i), F.element_at(path, i + 1)
        dx, dy = b.x - a.x, b.y - a.y
        long = F.hypot(dx, dy)
        k = F.greatest(F.lit(1), F.ceil(long / step).cast("int"))
        points = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct((a.x + dx * (j / k)).alias("x"), (a.y + dy * (j / k)).alias("y")))
        diagonal = (F.abs(dx) > 1e-8) & (F.abs(dy) > 1e-8)
        # A leg without length repeats a point, which the next leg gives.
        return F.when(diagonal, F.raise_error(F.lit("a leg isn't orthogonal")).cast(POINTS)).when(long > 1e-8, points).otherwise(F.array().cast(POINTS))

    return F.when(n >= 2, F.concat(F.flatten(F.transform(F.sequence(F.lit(1), n - 1), leg)), F.slice(path, -1, 1))).otherwise(path)
