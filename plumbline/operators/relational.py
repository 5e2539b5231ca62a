"""Joins, nearest matches, numbering and reductions that the compliance queries are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.shared import broadcast_if_small, work_table


def pairs_in_group(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Unordered pairs ``a < b`` of distinct items that share a group."""
    items = rows.select(group, item).where(F.col(item).isNotNull()).distinct()
    left, right = items.withColumnRenamed(item, "a"), items.withColumnRenamed(item, "b")
    return left.join(right, group).where("a < b").select(group, "a", "b")


def canonical_pairs(rows: DataFrame, a: str, b: str, order: list[Column]) -> DataFrame:
    """One row for each unordered pair, the first in ``order`` (J21); adds ``lo`` and ``hi``."""
    keyed = rows.withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b)})
    first = F.row_number().over(Window.partitionBy("lo", "hi").orderBy(*order))
    return keyed.withColumn("_first", first).where("_first = 1").drop("_first")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, ref: str, ref_id: str) -> DataFrame:
    """For each left row the right row of its group with the nearest ``ref``; ties take the smallest id.

    A two-sided as-of join: both sides are sorted once in a group and each left row looks
    at the reference before and after it, so no pairs are formed. Left rows of a group
    without references keep nulls. Adds ``nearest_id`` and ``distance``.
    """
    points = right.where(F.col(ref).isNotNull()).groupBy(*keys, F.col(ref).alias("_at")).agg(F.min(ref_id).alias("_id"))
    both = left.withColumn("_at", F.col(at)).unionByName(points.withColumn("_ref", F.struct(F.col("_at").alias("v"), F.col("_id").alias("id"))).drop("_id"), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("_at")
    back = Window.partitionBy(*keys).orderBy(F.desc("_at"))
    # A range frame sees references that tie with the row, wherever they are sorted. Both frames only grow
    # along their order, so each is one pass over a group; a frame that shrinks would be read again for each row.
    before = F.last("_ref", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.last("_ref", ignorenulls=True).over(back.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    seen = both.withColumns({"_b": before, "_a": after}).where("_ref is null")

    def candidate(side: str) -> Column:
        return F.when(F.col(side).isNotNull() & F.col(at).isNotNull(), F.struct(F.abs(F.col(at) - F.col(f"{side}.v")).alias("distance"), F.col(f"{side}.id").alias("id")))

    best = F.least(candidate("_b"), candidate("_a"))
    return seen.withColumn("_best", best).withColumns({"nearest_id": F.col("_best.id"), "distance": F.col("_best.distance")}).drop("_best", "_a", "_b", "_at", "_ref")


def nearest_k_relative(rows: DataFrame, group: str, item: str, at: str, k: int, slack: float) -> DataFrame:
    """The ``k`` nearest other items of the group, no farther than the nearest plus ``slack``.

    The k nearest have the item's own value or one of the k distinct values before and the
    k after it, and are among the smallest ids of their values: lags over distinct values,
    each with its k + 1 smallest ids, replace a self join. Ties take the smaller id; rows
    without a value have no distance and are nobody's neighbour.
    """
    known = rows.where(F.col(at).isNotNull())
    nth = F.row_number().over(Window.partitionBy(group, at).orderBy(item))
    first = known.select(group, at, item).distinct().withColumn("_nth", nth).where(F.col("_nth") <= k + 1)
    values = first.groupBy(group, at).agg(F.collect_list(F.struct(F.col(at).alias("v"), F.col(item).alias("id"))).alias("_here"))
    order = Window.partitionBy(group).orderBy(at)
    sides = [F.coalesce(f("_here", j).over(order), F.array().cast(values.schema["_here"].dataType)) for j in range(1, k + 1) for f in (F.lag, F.lead)]
    values = values.select(F.col(group).alias("_group"), F.col(at).alias("_at"), F.concat("_here", *sides).alias("_around"))
    met = known.join(values, F.col(group).eqNullSafe(F.col("_group")) & (F.col(at) == F.col("_at")))
    others = F.filter("_around", lambda x: x.id != F.col(item))
    seen = met.withColumn("_near", F.array_sort(F.transform(others, lambda x: F.struct(F.abs(x.v - F.col(at)).alias("distance"), x.id.alias("id")))))
    picked = seen.select(group, item, F.posexplode(F.slice("_near", 1, k)).alias("rank", "n"), F.element_at("_near", 1).distance.alias("_best"))
    return picked.where(F.col("n.distance") <= F.col("_best") + slack).select(group, item, (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("near_id"), F.col("n.distance").alias("distance"))


def box_pairs(left: DataFrame, right: DataFrame, axes: list[tuple[str, str, float]], left_id: str, right_id: str) -> DataFrame:
    """Pairs of ids whose closed boxes meet (F1, J5): an equi join on grid cells and a residual test.

    ``axes`` names the low and high column and the cell size of each axis. A box is in
    each cell it covers; a pair is taken in the cell of the larger of its two low
    corners alone, so no pair is formed twice and nothing is deduplicated.
    """

    def celled(df: DataFrame, prefix: str, ident: str) -> DataFrame:
        out = df.select(F.col(ident).alias(f"{prefix}id"), *[F.col(c).cast("double").alias(f"{prefix}{k}") for lo, hi, _ in axes for k, c in ((lo, lo), (hi, hi))])
        for i, (lo, hi, size) in enumerate(axes):
            out = out.withColumn(f"cell{i}", F.explode(F.sequence(F.floor(F.col(f"{prefix}{lo}") / size), F.floor(F.col(f"{prefix}{hi}") / size))))
        return out

    cells = [f"cell{i}" for i in range(len(axes))]
    met = celled(left, "l_", left_id).join(celled(right, "r_", right_id), cells)
    for i, (lo, hi, size) in enumerate(axes):
        corner = F.greatest(F.col(f"l_{lo}"), F.col(f"r_{lo}"))
        met = met.where((F.col(f"l_{lo}") <= F.col(f"r_{hi}")) & (F.col(f"r_{lo}") <= F.col(f"l_{hi}")) & (F.floor(corner / size) == F.col(f"cell{i}")))
    return met.select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"))


def last_wins(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The value of the last row of each key in ``order``."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def first_of_each(rows: DataFrame, kind: str, order: list[str], most: int) -> DataFrame:
    """The first row of each kind, then the earliest others, ``most`` in all (W6, W7); adds ``opens``.

    ``order`` names columns that tell rows apart. The firsts are minima, aggregated before
    they are shuffled; no kind is sorted as a whole.
    """
    firsts = rows.groupBy(kind).agg(F.min(F.struct(*order)).alias("_first"))
    met = rows.join(broadcast_if_small(firsts, 10_000), kind)
    opens = met.withColumn("opens", (F.struct(*order) == F.col("_first")).cast("int")).drop("_first")
    return opens.orderBy(F.desc("opens"), *order).limit(most)


def number_rows(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Consecutive numbers from 1 in a total order, without sorting all rows in one task.

    Rows are range partitioned and sorted; the partitions' counts, one row each, are summed.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    placed = work_table(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"_part": F.shiftright(at, 33), "_row": at.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    return placed.join(offsets, "_part").withColumn(name, F.col("_base") + F.col("_row") + 1).drop("_part", "_row", "_base")


def histogram_of_counts(rows: DataFrame, key: str) -> DataFrame:
    """How many keys have each number of rows (A2)."""
    return rows.groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def with_default(left: DataFrame, right: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """Left keys without a right row, with a default."""
    return left.join(right.select(key).distinct(), key, "left_anti").select(key, default.alias(value))


def merge_checks(issues: DataFrame, checks: DataFrame, keys: list[str]) -> DataFrame:
    """Issues and checks with precedence (J20): a failing check overrides, a definitive one suppresses the issue.

    ``issues`` has ``severity``, ``checks`` has ``status``; both are keyed by ``keys``.
    Returns ``keys, outcome`` in {fail, issue}.
    """
    both = issues.join(checks, keys, "full")
    outcome = F.when(F.col("status") == "fail", "fail").when(F.col("severity").isNotNull() & ~F.coalesce(F.col("status") == "pass", F.lit(False)), "issue")
    return both.withColumn("outcome", outcome).where("outcome is not null").select(*keys, "outcome")


def directional(rows: DataFrame, key: str, status: str, length: str, ident: str) -> DataFrame:
    """Per key (A18): pass if every direction passes, mixed if they differ, else blocked with the longest attempt."""
    passed = F.col(status) == "pass"
    return rows.groupBy(key).agg(
        F.when(F.every(passed), "pass").when(F.some(passed), "mixed").otherwise("blocked").alias("outcome"),
        F.when(~F.some(passed), F.max_by(ident, F.struct(length, ident))).alias("attempt"),
    )
