"""Queries of plan routes, their floors and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.domain import explain, plan
from plumbline.domain import values as V
from plumbline.operators import paths as P
from plumbline.plans.registry import query
from plumbline.sources.tables import table

MEASURES_SQL = """m AS (SELECT l_orderkey, l_linenumber, l_partkey, 0.8 + l_discount * 2 AS door, l_quantity / 20 AS clear, l_tax * 20 + 0.7 AS turn, l_linenumber % 2 = 0 AS turns,
  l_returnflag = 'R' AS stair, CASE WHEN l_linestatus = 'O' THEN l_discount * 100 END AS slope, l_tax * 4 + 1 AS ramp, l_quantity / 6 AS run FROM lineitem)"""


@query(
    f"""
    WITH {MEASURES_SQL}
    SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(',', CASE WHEN door < 0.9 THEN 'door_width' END, CASE WHEN clear < 1.5 THEN 'route_width' END, CASE WHEN turns AND turn < 1.5 THEN 'turning_space' END,
      CASE WHEN stair THEN 'stair_block' END, CASE WHEN slope > 6 THEN 'ramp_slope' END, CASE WHEN ramp < 1.2 THEN 'ramp_width' END, CASE WHEN run > 6 THEN 'ramp_run_length' END) AS reasons FROM m
    """
)
def plan_route_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reasons against each line as a plan route."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "0.8D + l_discount * 2 AS routeDoorWidthMinM", "l_quantity / 20 AS routeClearWidthM", "l_tax * 20 + 0.7D AS routeTurningSpaceM",
        "l_linenumber % 2 = 0 AS routeHasTurn", "l_returnflag = 'R' AS routeHitsStair", "CASE WHEN l_linestatus = 'O' THEN l_discount * 100 END AS routeRampSlopePercent",
        "l_tax * 4 + 1 AS routeRampUsableWidthM", "l_quantity / 6 AS routeRampRunLengthM",
    )
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(plan.plan_reasons(), ",").alias("reasons"))


RULES = [*V.ROUTE_RULE_IDS[:4], "door_height", "door_width", "corridor_width", "missing_door_height"]


@query(
    f"""
    WITH i AS (SELECT event_id, {RULES!r}[(event_id % 8 + 1)::INT] AS rule_id, CASE WHEN value < 20 THEN 'info' WHEN value < 40 THEN NULL ELSE 'fail' END AS severity FROM events)
    SELECT event_id, rule_id, CASE WHEN rule_id IN ('door_height', 'missing_door_height', 'route_door_height') THEN 'advisory' WHEN coalesce(severity, '') <> 'info' AND NOT starts_with(rule_id, 'route_') THEN 'building' END AS shown FROM i
    """
)
def issue_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list each event is shown in, as an issue."""
    rule = F.element_at(F.array(*[F.lit(r) for r in RULES]), (F.col("event_id") % 8 + 1).cast("int"))
    severity = F.when(F.col("value") < 20, "info").when(F.col("value") < 40, F.lit(None)).otherwise("fail")
    rows = table(spark, sf_dir, "events").select("event_id", rule.alias("rule_id"), severity.alias("severity"))
    return rows.select("event_id", "rule_id", plan.issue_list(F.col("rule_id"), F.col("severity")).alias("shown"))


NAMES = ["Lift 2", "Aufzug Nord", "gate", "Gross  Area", "GROSS FLOOR AREA 1", "Hissi"]


@query(
    f"""
    WITH n AS (SELECT p_partkey, lower(p_name || ' ' || {NAMES!r}[(p_size % 6 + 1)::INT]) AS t, CASE p_size % 4 WHEN 0 THEN 'physical path' WHEN 1 THEN 'local' WHEN 2 THEN 'an issue' END AS roles, p_size % 3 = 0 AS near, p_retailprice > 1200 AS stops FROM part)
    SELECT p_partkey, regexp_matches(t, 'lift|elevator|hissi|aufzug') AS lift, regexp_matches(t, 'bruttoareal|gross floor area|gross area') AS gross,
      coalesce(roles IN ('physical path', 'an issue'), false) OR NOT near OR stops AS visible FROM n
    """
)
def text_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lift doors, gross areas and edges that a plan shows."""
    label = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("p_size") % 6 + 1).cast("int"))
    roles = F.when(F.col("p_size") % 4 == 0, "physical path").when(F.col("p_size") % 4 == 1, "local").when(F.col("p_size") % 4 == 2, "an issue")
    shown = plan.plan_visible(roles, F.col("p_size") % 3 == 0, F.col("p_retailprice") > 1200)
    return table(spark, sf_dir, "part").select("p_partkey", plan.lift_door(F.col("p_name"), label).alias("lift"), plan.gross_area(F.col("p_name"), label).alias("gross"), shown.alias("visible"))


@query(
    """
    SELECT l_returnflag, count(*) AS edges, count(*) FILTER (l_linestatus = 'O') AS passed, count(*) FILTER (l_linestatus <> 'O' AND l_discount > 0) AS blocked,
      count(*) FILTER (l_linestatus <> 'O' AND NOT l_discount > 0) AS unavailable, count(*) FILTER (l_suppkey < l_partkey) AS swapped FROM lineitem GROUP BY 1
    """
)
def strict_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by outcome; the outcomes must add up."""
    status = F.when(F.col("l_linestatus") == "O", "pass").when(F.col("l_discount") > 0, "blocked").otherwise("unavailable")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", status.alias("status"), (F.col("l_suppkey") < F.col("l_partkey")).alias("swapped"))
    return plan.accounting(rows, ["l_returnflag"])


REFS_SQL = "f AS (SELECT n_regionkey AS b, n_name AS name, n_nationkey * 0.7 AS z FROM nation)"


def _floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("b"), F.col("n_name").alias("name"), (F.col("n_nationkey") * F.lit(0.7)).alias("elevation"))


@query(
    f"""
    WITH {REFS_SQL}, r AS (SELECT p_partkey, (p_size % 5)::INT AS b, p_size / 4.0 AS lower, p_size / 4.0 + 0.5 AS upper, CASE WHEN p_size % 2 = 0 THEN 'KENYA' ELSE 'CHINA' END AS storey FROM part),
    g AS (SELECT r.*, name, least(abs(z - lower), abs(z - upper)) AS gap FROM r JOIN f USING (b)),
    c AS (SELECT p_partkey, storey, string_agg(name, ' ' ORDER BY gap, name) AS connected, arg_min(name, (gap, name)) AS nearest, min(gap) AS gap, bool_or(name = storey) AS own FROM g WHERE gap <= 0.40 GROUP BY 1, 2)
    SELECT p_partkey, connected, CASE WHEN own THEN c.storey ELSE nearest END AS display, round(gap, 6) AS gap, coalesce(NOT own, false) AS mismatch FROM r LEFT JOIN c USING (p_partkey)
    """
)
def ramp_storeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The storeys that each ramp's ends touch."""
    ramps = table(spark, sf_dir, "part").selectExpr("p_partkey", "CAST(p_size % 5 AS INT) AS b", "p_size / 4.0D AS lower", "p_size / 4.0D + 0.5D AS upper", "CASE WHEN p_size % 2 = 0 THEN 'KENYA' ELSE 'CHINA' END AS storey")
    found = plan.ramp_storeys(ramps, _floors(spark, sf_dir), "b")
    return found.select("p_partkey", F.array_join("connected", " ").alias("connected"), "display", F.round("offset", 6).alias("gap"), "mismatch")


@query(
    f"""
    WITH {REFS_SQL}, p AS (SELECT s_suppkey AS guid, CASE WHEN s_acctbal > 5000 THEN s_name END AS floor FROM supplier),
    e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber AS via, (l_partkey % 6)::INT AS b, CASE WHEN l_tax > 0 THEN l_quantity / 3 END AS z FROM lineitem),
    h AS (SELECT i.b, i.z, arg_min(f.name, (abs(f.z - i.z), f.name)) AS name, min(abs(f.z - i.z)) AS gap FROM (SELECT DISTINCT b, z FROM e) i JOIN f USING (b) GROUP BY 1, 2)
    SELECT l_orderkey, l_linenumber, e.l_partkey, l_suppkey, coalesce(s.floor, t.floor, v.floor, CASE WHEN gap <= 1.8 THEN h.name END, 'z=' || printf('%.2f', e.z)) AS floor
    FROM e LEFT JOIN p s ON s.guid = l_suppkey LEFT JOIN p t ON t.guid = l_partkey LEFT JOIN p v ON v.guid = via LEFT JOIN h ON h.b = e.b AND h.z = e.z
    """
)
def plan_edge_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The floor of each line as a plan edge: of an end, the via element or the height."""
    placed = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("guid"), F.when(F.col("s_acctbal") > 5000, F.col("s_name")).alias("floor"))
    edges = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_suppkey AS start", "l_partkey AS stop", "CAST(l_linenumber AS BIGINT) AS via", "CAST(l_partkey % 6 AS INT) AS b", "CASE WHEN l_tax > 0 THEN l_quantity / 3 END AS z"
    )
    return plan.edge_floor(edges, placed, _floors(spark, sf_dir), "b").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "floor")


#: A user's events in time order as a path: x in hours since 2024, y the value.
STEP_SQL = """p AS (SELECT user_id, (epoch_us(ts) - 1704067200000000) / 3600000000.0 AS x, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  w AS (SELECT *, lag(x) OVER o AS x0, lag(y) OVER o AS y0, lead(x) OVER o AS x1, lead(y) OVER o AS y1 FROM p WINDOW o AS (PARTITION BY user_id ORDER BY k))"""


def _user_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) / 3600000000.0D")
    rows = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", hours.alias("x"), F.col("value").cast("double").alias("y")).alias("e"))
    return rows.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: F.struct(e.x.alias("x"), e.y.alias("y"))).alias("path"))


@query(
    f"""
    WITH {STEP_SQL}, t AS (SELECT *, sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)) AS a, sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) AS b FROM w)
    SELECT user_id, count(*) FILTER (least(a, b) >= 0.35 AND a * b > 1e-6 AND abs((x - x0) * (y1 - y) - (y - y0) * (x1 - x)) / (a * b) > 0.15) AS n_turns FROM t GROUP BY 1
    """
)
def path_turn_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each user's path (L3)."""
    return _user_paths(spark, sf_dir).select("user_id", F.size(P.turn_points(F.col("path"))).cast("long").alias("n_turns"))


@query(
    f"""
    WITH {STEP_SQL}, l AS (SELECT user_id, x, y, x1, y1, greatest(1, ceil(abs(x1 - x) / 6.0)) AS nx, greatest(1, ceil(abs(y1 - y) / 6.0)) AS ny FROM w WHERE x1 IS NOT NULL),
    c AS (SELECT user_id, sum(CASE WHEN abs(x1 - x) > 1e-8 THEN nx ELSE 0 END + CASE WHEN abs(y1 - y) > 1e-8 THEN ny ELSE 0 END + 1) AS n,
      sum(CASE WHEN abs(x1 - x) > 1e-8 THEN nx * x + (x1 - x) * (nx - 1) / 2 ELSE 0 END + CASE WHEN abs(y1 - y) > 1e-8 THEN ny * x1 ELSE 0 END + x1) AS sx FROM l GROUP BY 1)
    SELECT user_id, n::BIGINT AS n_points, round(sx, 3) AS sum_x FROM c
    """
)
def path_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points at most 6 apart on L-shaped ways between a user's events."""
    path = F.col("path")
    ways = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: P.densify(P.connector(F.element_at(path, i), F.element_at(path, i + 1)), 6.0))
    rows = _user_paths(spark, sf_dir).where("size(path) >= 2").select("user_id", F.flatten(ways).alias("points"))
    return rows.select("user_id", F.size("points").cast("long").alias("n_points"), F.round(F.aggregate("points", F.lit(0.0), lambda s, p: s + p.x), 3).alias("sum_x"))


ACTIONS_SQL = """
    WITH g AS (SELECT n_name, s_suppkey, s_acctbal, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    c AS (SELECT n_name, count(*) FILTER (s_acctbal < 2000) AS narrow, count(*) FILTER (s_acctbal >= 9000) AS stairs, arg_min(s_name, s_suppkey) AS first FROM g GROUP BY 1)
"""


@query(
    ACTIONS_SQL
    + """
    SELECT n_name, CASE WHEN narrow + stairs = 0 THEN 'The supplied SHACL facts contain no detected accessibility issue type.' ELSE 'The SHACL check found ' ||
      concat_ws(', ', CASE WHEN narrow > 0 THEN narrow || ' door too narrow issue' || CASE WHEN narrow = 1 THEN '' ELSE 's' END END, CASE WHEN stairs > 0 THEN stairs || ' stair blocks route issue' || CASE WHEN stairs = 1 THEN '' ELSE 's' END END)
      || '. Affected floors: ' || n_name || '.' END AS summary FROM c
    """
)
def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence of the findings in each nation."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    counts = rows.groupBy("n_name").agg(F.count_if(F.col("s_acctbal") < 2000).alias("narrow"), F.count_if(F.col("s_acctbal") >= 9000).alias("stairs"))
    told = F.filter(F.array(F.struct(F.lit("door_width").alias("rule"), F.col("narrow").alias("n")), F.struct(F.lit("stair_block").alias("rule"), F.col("stairs").alias("n"))), lambda c: c.n > 0)
    return counts.select("n_name", explain.summary_sentence(told, F.array("n_name")).alias("summary"))


@query(
    """
    SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN 'Reroute ' || s_name || ' on ' || n_name || ' from its start door to its end door so its polyline does not intersect the recorded stair geometry.'
      WHEN s_nationkey % 3 = 1 THEN 'Increase the clear opening at ' || CASE WHEN s_acctbal > 4000 THEN s_name || ', ' || n_name ELSE 'its start door' END || ', then regenerate the route measurements and rerun SHACL.'
      ELSE 'Reduce the measured slope of ' || CASE WHEN s_acctbal > 4000 THEN s_name || ', ' || n_name ELSE s_name END || ', then regenerate its ramp measurement and rerun SHACL.' END AS action
    FROM supplier JOIN nation ON n_nationkey = s_nationkey
    """
)
def short_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action of a rule, filled from each supplier's facts."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rule = F.when(F.col("s_nationkey") % 3 == 0, "stair_block").when(F.col("s_nationkey") % 3 == 1, "door_width").otherwise("ramp_slope")
    names = F.when(F.col("s_acctbal") > 4000, F.array("s_name", "n_name")).otherwise(F.array().cast("array<string>"))
    facts = rows.select(F.col("s_suppkey"), rule.alias("rule"), names.alias("names"), F.col("s_name").alias("edge"), F.col("n_name").alias("floor"), F.lit(" ").alias("start"), F.lit(None).cast("string").alias("stop"))
    return explain.short_actions(facts, ["s_suppkey"]).select("s_suppkey", "action")
