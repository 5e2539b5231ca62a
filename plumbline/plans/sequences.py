"""Queries of intervals, runs and polylines over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import intervals as I
from plumbline.operators import paths as P
from plumbline.plans.registry import query
from plumbline.sources.tables import table

#: Microseconds since 2024, whatever the session's time zone.
MICROS_SQL = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)"

#: Intervals of SQL: each event opens half an hour for its user.
EVENTS_SQL = "e AS (SELECT user_id, (epoch_us(ts) // 1000000)::BIGINT AS lo, (epoch_us(ts) // 1000000)::BIGINT + 1800 AS hi FROM events)"


def merged_sql(tolerance: int) -> str:
    """SQL of merged intervals, as ``m``."""
    return f"""
    WITH {EVENTS_SQL},
    s AS (SELECT *, CASE WHEN lo > max(hi) OVER w + {tolerance} THEN 1 ELSE coalesce((max(hi) OVER w IS NULL)::INT, 0) END AS opens FROM e WINDOW w AS (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM s),
    m AS (SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM g GROUP BY user_id, island)
    """


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, lo, hi`` in seconds."""
    at = F.floor(F.expr(MICROS_SQL) / 1000000) + 1704067200
    return table(spark, sf_dir, "events").select("user_id", at.alias("lo"), (at + 1800).alias("hi"))


@query(merged_sql(0) + "SELECT * FROM m")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions of touching intervals of each user."""
    return I.merge(spans(spark, sf_dir), "user_id", "lo", "hi")


@query(merged_sql(3600) + "SELECT * FROM m")
def interval_merge_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions over gaps of up to an hour."""
    return I.merge(spans(spark, sf_dir), "user_id", "lo", "hi", 3600)


@query(
    merged_sql(0)
    + """, b AS (SELECT min(lo) - 60 AS start, max(hi) + 60 AS stop FROM e),
    c AS (SELECT user_id, lo, hi, lag(hi) OVER w AS before, lead(lo) OVER w AS after FROM m WINDOW w AS (PARTITION BY user_id ORDER BY lo))
    SELECT user_id, coalesce(before, start) AS lo, c.lo AS hi FROM c, b WHERE c.lo > coalesce(before, start)
    UNION ALL SELECT user_id, hi, stop FROM c, b WHERE after IS NULL AND stop > hi
    """
)
def interval_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the merged intervals of each user leave of the whole time."""
    rows = spans(spark, sf_dir)
    bounds = rows.agg((F.min("lo") - 60).alias("start"), (F.max("hi") + 60).alias("stop"))
    merged = I.merge(rows, "user_id", "lo", "hi").join(F.broadcast(bounds), F.lit(True))
    return I.complement(merged, "user_id", "lo", "hi", "start", "stop")


@query(
    "WITH i AS (SELECT DISTINCT user_id % 10 AS grp, event_id AS v FROM events), g AS (SELECT grp, v, v - row_number() OVER (PARTITION BY grp ORDER BY v) AS k FROM i) "
    "SELECT grp, min(v) AS lo, max(v) AS hi FROM g GROUP BY grp, k"
)
def run_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive event ids in groups of users."""
    rows = table(spark, sf_dir, "events")
    return I.runs(rows.select(F.expr("user_id % 10").alias("grp"), F.col("event_id").alias("v")), "grp", "v")


@query(
    merged_sql(0)
    + "SELECT a.user_id, count(*) AS n, sum(least(a.hi, b.hi) - greatest(a.lo, b.lo))::BIGINT AS seconds FROM m a JOIN m b ON b.user_id = a.user_id + 1 AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY 1"
)
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of the intervals of neighbouring users."""
    merged = I.merge(spans(spark, sf_dir), "user_id", "lo", "hi")
    left = merged.select("user_id", "lo", "hi")
    right = merged.select((F.col("user_id") - 1).alias("user_id"), F.col("lo").alias("rlo"), F.col("hi").alias("rhi"))
    met = I.overlaps(left, right, ["user_id"], 7200)
    return met.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.least("hi", "rhi") - F.greatest("lo", "rlo")).alias("seconds"))


#: A user's events in time order as a path: x in hours since 2024, y the value.
PATH_SQL = "p AS (SELECT user_id, (epoch(ts) - 1704067200) / 3600.0 AS x, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


def event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, path``."""
    x = F.expr(MICROS_SQL) / F.lit(1e6) / F.lit(3600.0)
    point = F.struct("ts", "event_id", F.struct(x.alias("x"), F.col("value").alias("y")).alias("p"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(point)).alias("e")).select("user_id", F.transform("e", lambda s: s.p).alias("path"))


@query(f"WITH {PATH_SQL}, s AS (SELECT user_id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM p WINDOW w AS (PARTITION BY user_id ORDER BY k)) SELECT user_id, round(coalesce(sum(d), 0), 3) AS length FROM s GROUP BY 1")
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each user's path."""
    return event_paths(spark, sf_dir).select("user_id", F.round(P.length(F.col("path")), 3).alias("length"))


@query(
    f"""WITH {PATH_SQL}, s AS (SELECT user_id, k, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS dy FROM p WINDOW w AS (PARTITION BY user_id ORDER BY k))
    SELECT user_id, count(*) FILTER (WHERE abs(ax * dy - ay * bx) > 50)::INT AS n_turns FROM s GROUP BY 1"""
)
def path_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each user's path: cross products over a bound (L2, L3)."""
    return event_paths(spark, sf_dir).select("user_id", P.turns(F.col("path"), 50.0).alias("n_turns"))


@query(None)
def path_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths on a coarse grid without repeated and collinear points."""
    coarse = F.transform("path", lambda p: F.struct(F.floor(p.x / 24).cast("double").alias("x"), F.floor(p.y / 200).cast("double").alias("y")))
    rows = event_paths(spark, sf_dir).select("user_id", P.compact(P.dedupe(coarse)).alias("path"))
    return rows.select("user_id", F.size("path").alias("n_points"), F.round(P.length(F.col("path")), 4).alias("length"), F.array_join(F.transform("path", lambda p: F.format_string("%d:%d", p.x.cast("long"), p.y.cast("long"))), " ").alias("points"))


@query(
    f"""WITH {PATH_SQL}, s AS (SELECT user_id, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS d FROM p WINDOW w AS (PARTITION BY user_id ORDER BY k))
    SELECT user_id, sum(coalesce(greatest(1, floor(d / 25.0)), 1))::BIGINT AS n_points FROM s GROUP BY 1"""
)
def path_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of samples at a step along each path."""
    return event_paths(spark, sf_dir).select("user_id", F.size(P.sample(F.col("path"), 25.0)).cast("long").alias("n_points"))


@query(
    f"""WITH {PATH_SQL}, b AS (SELECT user_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY 1)
    SELECT user_id, round(x0, 4) AS x0, round(x1, 4) AS x1, round(y0, 4) AS y0, round(y1, 4) AS y1, round(least(13.5 / greatest(x1 - x0, y1 - y0, 1e-9), 0.85), 6) AS scale FROM b"""
)
def scene_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of each path and the scale that fits them to the scene."""
    b = event_paths(spark, sf_dir).select("user_id", *[f(F.col(f"path.{a}")).alias(n) for a, f, n in (("x", F.array_min, "x0"), ("x", F.array_max, "x1"), ("y", F.array_min, "y0"), ("y", F.array_max, "y1"))])
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-9))
    return b.select("user_id", *[F.round(c, 4).alias(c) for c in ("x0", "x1", "y0", "y1")], F.round(F.least(F.lit(13.5) / span, F.lit(0.85)), 6).alias("scale"))


@query(
    """
    WITH s AS (SELECT user_id, event_id, (event_id * 37 % 101)::INT AS raw, row_number() OVER w AS seq, event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, max(raw) OVER (PARTITION BY user_id ORDER BY seq) AS progress,
      CASE WHEN max(raw) OVER (PARTITION BY user_id ORDER BY seq) >= 100 THEN 'complete' WHEN seq = 1 THEN 'queued' ELSE 'running' END AS status FROM s
    """
)
def progress_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress that never falls, and the job's state."""
    from plumbline.streaming.progress import progress

    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.expr("CAST(event_id * 37 % 101 AS INT)").alias("raw"))
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return progress(rows, "user_id", "seq", "raw").select("user_id", "event_id", "progress", "status")
