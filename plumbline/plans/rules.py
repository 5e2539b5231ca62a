"""Queries of the rule operators over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.registry import query
from plumbline.sources.tables import table


@query(
    """
    WITH f AS (SELECT round(l_discount, 4) AS d, round(l_quantity, 4) AS q, l_tax AS t FROM lineitem),
    c AS (
      SELECT 'max_discount' AS rule_id, CASE WHEN d IS NULL THEN 'unavailable' WHEN d > 0.08 THEN 'fail' ELSE 'pass' END AS status FROM f
      UNION ALL SELECT 'min_quantity', CASE WHEN q IS NULL THEN 'unavailable' WHEN q < 5 THEN 'fail' ELSE 'pass' END FROM f
      UNION ALL SELECT 'missing_tax', CASE WHEN t IS NULL THEN 'fail' ELSE 'pass' END FROM f)
    SELECT rule_id, status, count(*) AS n FROM c GROUP BY 1, 2
    """
)
def rule_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts per rule: a maximum, a minimum and a presence rule."""
    from plumbline.operators.rules import Rule, evaluate

    rules = [
        Rule("max_discount", "l_discount", "maximum", 0.08, round_digits=4),
        Rule("min_quantity", "l_quantity", "minimum", 5.0, round_digits=4),
        Rule("missing_tax", "l_tax", "present"),
    ]
    return evaluate(table(spark, sf_dir, "lineitem"), rules, keys=[]).groupBy("rule_id", "status").agg(F.count("*").alias("n"))


LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(
    """
    WITH c AS (
      SELECT *, 'discount_limit' AS rule_id, round(l_discount, 4) AS measured, 0.09 AS required FROM lineitem WHERE round(l_discount, 4) > 0.09
      UNION ALL SELECT *, 'quantity_limit', round(l_quantity, 4), 2.0 FROM lineitem WHERE round(l_quantity, 4) < 2.0
      UNION ALL SELECT *, 'returned', 1.0, NULL FROM lineitem WHERE l_returnflag = 'R')
    SELECT 'I' || lpad(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, rule_id)::VARCHAR, 8, '0') AS issue_id,
      l_orderkey, l_linenumber, rule_id, measured::DOUBLE AS measured, required::DOUBLE AS required FROM c
    """
)
def rule_violations_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All violations of three line rules, numbered in order."""
    from plumbline.operators.relational import number_rows
    from plumbline.operators.rules import Rule, violations

    lines = table(spark, sf_dir, "lineitem").withColumn("returned", F.col("l_returnflag") == "R")
    rules = [
        Rule("discount_limit", "l_discount", "maximum", 0.09, round_digits=4),
        Rule("quantity_limit", "l_quantity", "minimum", 2.0, round_digits=4),
        Rule("returned", "returned", "flag"),
    ]
    found = violations(lines, rules, LINE_KEYS)
    numbered = number_rows(found, [*LINE_KEYS, "rule_id"], "k")
    return numbered.select(F.concat(F.lit("I"), F.lpad(F.col("k").cast("string"), 8, "0")).alias("issue_id"), "l_orderkey", "l_linenumber", "rule_id", "measured", "required")


@query("SELECT c_custkey, 'missing_orders' AS rule_id, 'fail' AS status FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def rule_missing_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without the fact that a rule needs."""
    missing = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return missing.select("c_custkey", F.lit("missing_orders").alias("rule_id"), F.lit("fail").alias("status"))


@query(
    """
    WITH f AS (SELECT l_orderkey, max(l_discount) AS d, min(l_quantity) AS q, max(l_tax) AS t FROM lineitem GROUP BY 1)
    SELECT o_orderkey, 'unreachable' AS rule_id FROM orders JOIN f ON l_orderkey = o_orderkey
    WHERE o_orderstatus = 'F' AND NOT (d > 0.08) AND NOT (q < 4) AND NOT (t > 0.07)
    """
)
def rule_residual_unexplained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked orders that none of the causes explains."""
    from plumbline.operators.rules import Rule, residual

    facts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_discount").alias("d"), F.min("l_quantity").alias("q"), F.max("l_tax").alias("t"))
    rows = table(spark, sf_dir, "orders").join(facts, F.col("o_orderkey") == F.col("l_orderkey"))
    causes = [Rule("route_width", "d", "maximum", 0.08), Rule("route_door_width", "q", "minimum", 4), Rule("route_ramp_slope", "t", "maximum", 0.07)]
    return residual(rows, "o_orderstatus = 'F'", causes, "unreachable", ["o_orderkey"])


@query(
    """
    SELECT p_partkey, CASE WHEN p_retailprice > CASE WHEN p_size <= 10 THEN 1200 ELSE 1500 END THEN 'fail' ELSE 'pass' END AS status,
      (CASE WHEN p_size <= 10 THEN 1200 ELSE 1500 END)::DOUBLE AS required FROM part
    """
)
def rule_conditional_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit that depends on another measure; a null one takes the stricter branch."""
    from plumbline.operators.rules import Rule, evaluate

    limit = F.when(F.col("p_size") <= 10, 1200.0).otherwise(1500.0)
    return evaluate(table(spark, sf_dir, "part"), [Rule("price", "p_retailprice", "maximum", limit)], ["p_partkey"]).select("p_partkey", "status", "required")


@query(
    """
    WITH c AS (
      SELECT p_partkey, 'strict_rounded' AS rule_id, round(p_retailprice, 1) < 1000 AS bad FROM part
      UNION ALL SELECT p_partkey, 'tolerant', p_retailprice < 1000 - 0.000001 FROM part
      UNION ALL SELECT p_partkey, 'strict', p_retailprice < 1000 FROM part
      UNION ALL SELECT p_partkey, 'wide', p_retailprice < 1000 - 5 FROM part)
    SELECT rule_id, CASE WHEN bad THEN 'fail' ELSE 'pass' END AS status, count(*) AS n FROM c GROUP BY 1, 2
    """
)
def rule_tolerance_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same limit under four comparison policies."""
    from plumbline.operators.rules import Rule, evaluate

    rules = [
        Rule("strict_rounded", "p_retailprice", "minimum", 1000, round_digits=1),
        Rule("tolerant", "p_retailprice", "minimum", 1000, tolerance=1e-6),
        Rule("strict", "p_retailprice", "minimum", 1000),
        Rule("wide", "p_retailprice", "minimum", 1000, tolerance=5),
    ]
    return evaluate(table(spark, sf_dir, "part"), rules, []).groupBy("rule_id", "status").agg(F.count("*").alias("n"))


@query(
    """
    WITH v AS (
      SELECT l_orderkey, 'discount' AS rule_id FROM lineitem WHERE l_discount > 0.08
      UNION ALL SELECT l_orderkey, 'quantity' FROM lineitem WHERE l_quantity < 5
      UNION ALL SELECT l_orderkey, 'tax' FROM lineitem WHERE l_tax > 0.07),
    g AS (SELECT l_orderkey, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS reasons, count(*) AS n_issues FROM v GROUP BY 1)
    SELECT o_orderkey, CASE WHEN reasons IS NULL THEN 'pass' ELSE 'fail' END AS status, coalesce(reasons, '') AS reasons, coalesce(n_issues, 0)::BIGINT AS n_issues
    FROM orders LEFT JOIN g ON l_orderkey = o_orderkey
    """
)
def issue_rollup_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every order: fail where it has an issue, with its sorted distinct reasons."""
    from plumbline.operators.rules import Rule, roll_up, violations

    rules = [Rule("discount", "l_discount", "maximum", 0.08), Rule("quantity", "l_quantity", "minimum", 5), Rule("tax", "l_tax", "maximum", 0.07)]
    issues = roll_up(violations(table(spark, sf_dir, "lineitem"), rules, ["l_orderkey"]), "l_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(issues, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", F.coalesce("status", F.lit("pass")).alias("status"), F.coalesce(F.array_join("reasons", ","), F.lit("")).alias("reasons"), F.coalesce("n_issues", F.lit(0)).alias("n_issues"))


@query(
    """
    WITH i AS (SELECT DISTINCT doc_id, 'violation' AS severity FROM labels WHERE toxic = 1),
    c AS (SELECT doc_id, CASE WHEN n_chars < 500 THEN 'fail' WHEN n_chars < 2000 THEN 'pass' END AS status FROM documents)
    SELECT doc_id, CASE WHEN status = 'fail' THEN 'fail' WHEN severity IS NOT NULL AND coalesce(status, '') <> 'pass' THEN 'issue' END AS outcome
    FROM i FULL JOIN c USING (doc_id) WHERE status = 'fail' OR (severity IS NOT NULL AND coalesce(status, '') <> 'pass')
    """
)
def issue_check_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues and checks merged with precedence."""
    from plumbline.operators.relational import merge_checks

    issues = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit("violation").alias("severity")).distinct()
    checks = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") < 500, "fail").when(F.col("n_chars") < 2000, "pass").alias("status"))
    return merge_checks(issues, checks, ["doc_id"])


@query(
    """
    WITH v AS (
      SELECT 'discount' AS reason, l_discount AS x, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount > 0.08
      UNION ALL SELECT 'quantity', l_quantity, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity < 5)
    SELECT reason, CASE WHEN reason = 'discount' THEN max(x) ELSE min(x) END AS worst, count(*) AS n,
      CASE WHEN reason = 'discount' THEN arg_max(l_orderkey, (x, -l_orderkey)) ELSE arg_min(l_orderkey, (x, l_orderkey)) END AS at FROM v GROUP BY reason
    """
)
def worst_value_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst value of each reason and where: the largest for maxima, the least for minima."""
    from plumbline.operators.rules import Rule, violations

    rules = [Rule("discount", "l_discount", "maximum", 0.08), Rule("quantity", "l_quantity", "minimum", 5)]
    found = violations(table(spark, sf_dir, "lineitem"), rules, ["l_orderkey"])
    top = F.col("rule_id") == "discount"
    sign = F.when(top, -F.col("measured")).otherwise(F.col("measured"))
    return found.groupBy(F.col("rule_id").alias("reason")).agg(F.min_by("measured", sign).alias("worst"), F.count("*").alias("n"), F.min_by("l_orderkey", F.struct(sign, "l_orderkey")).alias("at"))


@query(
    """
    WITH g AS (SELECT l_orderkey, max((l_discount > 0.08)::INT) AS d, max((l_quantity < 5)::INT) AS q FROM lineitem GROUP BY 1),
    a AS (SELECT count(*) AS n, sum(d) AS nd, sum(q) AS nq FROM g)
    SELECT rule_id, n_orders::BIGINT AS n_orders, 'Review ' || n_orders || CASE WHEN n_orders = 1 THEN ' order' ELSE ' orders' END || ' for ' || rule_id || ': limit ' || lim AS action
    FROM (SELECT 'discount' AS rule_id, nd AS n_orders, '0.08' AS lim FROM a UNION ALL SELECT 'quantity', nq, '5.00' FROM a)
    """
)
def explain_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templated actions from aggregated facts, with plural forms."""
    from plumbline.operators.rules import Rule, violations

    limits = {"discount": 0.08, "quantity": 5.0}
    rules = [Rule("discount", "l_discount", "maximum", limits["discount"]), Rule("quantity", "l_quantity", "minimum", limits["quantity"])]
    counts = violations(table(spark, sf_dir, "lineitem"), rules, ["l_orderkey"]).groupBy("rule_id").agg(F.countDistinct("l_orderkey").alias("n_orders"), F.first("required").alias("limit"))
    noun = F.when(F.col("n_orders") == 1, " order").otherwise(" orders")
    return counts.select("rule_id", "n_orders", F.concat(F.lit("Review "), F.col("n_orders").cast("string"), noun, F.lit(" for "), "rule_id", F.lit(": limit "), F.format_string("%.2f", "limit")).alias("action"))
