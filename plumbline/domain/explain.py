"""Facts, counts and allowed actions for explanations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.domain import values as V


def folded(rule: Column) -> Column:
    """A rule's name for counting."""
    names = F.create_map(*[F.lit(x) for kv in V.RULE_ALIASES.items() for x in kv])
    return F.coalesce(F.element_at(names, rule), rule)


def issue_counts(issues: DataFrame) -> DataFrame:
    """``rule, n`` with aliases folded."""
    return issues.groupBy(folded(F.col("rule_id")).alias("rule")).agg(F.count("*").alias("n"))


def actions(issues: DataFrame, most: int = 4) -> DataFrame:
    """The first actions by rule: what was measured against what is required."""
    worst = issues.groupBy(folded(F.col("rule_id")).alias("rule")).agg(
        F.count("*").alias("n"), F.first("required", ignorenulls=True).alias("required"), F.min("measured").alias("low"), F.max("measured").alias("high"), F.first("unit", ignorenulls=True).alias("unit")
    )
    seen = F.when(F.col("rule").contains("slope"), F.col("high")).otherwise(F.col("low"))
    text = F.concat_ws(" ", F.col("n").cast("string"), F.when(F.col("n") == 1, "finding").otherwise("findings"), F.lit("of"), "rule", F.when(seen.isNotNull() & F.col("required").isNotNull(), F.format_string("(worst %.2f %s, required %.2f %s)", seen, F.col("unit"), F.col("required"), F.col("unit"))))
    return worst.select("rule", "n", text.alias("action")).orderBy(F.desc("n"), "rule").limit(most)


def context(issues: DataFrame, edges: DataFrame, most: int = 40) -> DataFrame:
    """One row of facts: detected types, counts, affected elements and failed routes."""
    counts = issue_counts(issues).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias("issueCountsByType"))
    touched = issues.select("element_guid").distinct().orderBy("element_guid").limit(most).agg(F.array_sort(F.collect_list("element_guid")).alias("affectedElements"))
    failed = edges.where("status = 'fail'").orderBy("edge_id").limit(most).agg(F.array_sort(F.collect_list("edge_id")).alias("failedRoutes"))
    return counts.join(touched, F.lit(True)).join(failed, F.lit(True)).withColumn("detectedIssueTypes", F.array_sort(F.map_keys("issueCountsByType")))


def progress_of_line(line: Column, steps: list[tuple[str, int]]) -> Column:
    """Progress that a log line tells: that of the first word it holds, or null (P25, T4)."""
    low = F.lower(line)
    return F.coalesce(*[F.when(F.contains(low, F.lit(word)), value) for word, value in steps])


def short_actions(facts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, rule, action``: one recommendation for each rule, filled from checked facts.

    ``facts`` has ``rule`` (folded), ``names`` (at most three elements) and ``edge, floor, start, stop`` of a
    failed route; what is missing or blank takes its substitute. Rules without an action give no row.
    """

    def said(fact: str, column: str) -> Column:
        text = F.trim(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"\s+", " "))
        return F.when(text != "", text).otherwise(F.lit(V.SUBSTITUTES[fact]))

    known = {"edge": said("edge", "edge"), "floor": said("floor", "floor"), "start": said("start", "start"), "end": said("end", "stop"), "elements": F.lit(V.SUBSTITUTES["elements"])}
    names = F.array_join("names", ", ")
    told = F.lit(None).cast("string")
    for rule, template in V.ACTIONS.items():
        text: Column = F.lit(template)
        for fact, value in known.items():
            text = F.replace(text, F.lit("{" + fact + "}"), value)
            text = F.replace(text, F.lit("{names|" + fact + "}"), F.when(F.coalesce(names, F.lit("")) != "", names).otherwise(value))
        told = F.when(F.col("rule") == rule, text).otherwise(told)
    return facts.select(*keys, "rule", told.alias("action")).where("action is not null")


def summary_sentence(counts: Column, floors: Column) -> Column:
    """The summary of ``array<struct<rule, n>>`` (folded rules, in the order they are told) and of floor names."""
    labels = F.create_map(*[F.lit(x) for kv in V.RULE_LABELS.items() for x in kv])
    known = F.filter(counts, lambda c: F.element_at(labels, c.rule).isNotNull())
    parts = F.transform(known, lambda c: F.concat(c.n.cast("string"), F.lit(" "), F.element_at(labels, c.rule), F.when(c.n == 1, F.lit(" issue")).otherwise(F.lit(" issues"))))
    where = F.when(F.size(floors) > 0, F.concat(F.lit(" Affected floors: "), F.array_join(F.array_distinct(floors), ", "), F.lit("."))).otherwise(F.lit(""))
    found = F.concat(F.lit("The SHACL check found "), F.array_join(parts, ", "), F.lit("."), where)
    return F.when(F.size(known) == 0, F.lit("The supplied SHACL facts contain no detected accessibility issue type.")).otherwise(found)
