"""Interval operators by gaps and islands over sorted windows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(rows: DataFrame, key: str, lo: str, hi: str, tolerance: float = 0) -> DataFrame:
    """Unions of intervals that touch or lie within ``tolerance`` (A11, A13): ``key, lo, hi, n``."""
    order = Window.partitionBy(key).orderBy(lo, hi)
    reach = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.col(lo) > reach + F.lit(tolerance)), 1).otherwise(0)
    marked = rows.withColumn("_new", starts)
    island = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("n")).drop("_island")


def complement(merged: DataFrame, key: str, lo: str, hi: str, start: str, stop: str) -> DataFrame:
    """What merged, disjoint intervals leave of ``[start, stop]`` (A12): ``key, lo, hi``; empty gaps are dropped."""
    order = Window.partitionBy(key).orderBy(lo)
    seen = merged.withColumns({"_before": F.lag(hi).over(order), "_after": F.lead(lo).over(order)})
    gaps = seen.select(
        key,
        F.explode(
            F.array(
                F.struct(F.coalesce("_before", start).alias("lo"), F.col(lo).alias("hi")),
                F.struct(F.when(F.col("_after").isNull(), F.col(hi)).alias("lo"), F.col(stop).alias("hi")),
            )
        ).alias("gap"),
    )
    return gaps.select(key, F.col("gap.lo").alias(lo), F.col("gap.hi").alias(hi)).where(F.col(hi) > F.col(lo))


def runs(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Runs of consecutive integers (A14): ``key, lo, hi``; repeated values count once."""
    distinct = rows.select(key, value).distinct()
    island = F.col(value) - F.row_number().over(Window.partitionBy(key).orderBy(value))
    return distinct.withColumn("_island", island).groupBy(key, "_island").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).drop("_island")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], cell: int) -> DataFrame:
    """Pairs of intervals ``lid, lo, hi`` and ``rid, rlo, rhi`` that overlap within equal keys.

    Intervals are dealt to cells of their key; a pair is taken in the cell of its later start.
    """
    a = left.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))))
    b = right.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("rlo") / cell), F.floor(F.col("rhi") / cell))))
    met = a.join(b, [*keys, "_cell"]).where((F.col("lo") <= F.col("rhi")) & (F.col("rlo") <= F.col("hi")))
    return met.where(F.floor(F.greatest("lo", "rlo") / cell) == F.col("_cell")).drop("_cell")
