"""Threshold rules as data, compiled to one pass of Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A rule over one measure.

    ``comparison``: ``minimum``, ``maximum``, ``present`` or ``flag`` (violated when the
    measure is true). ``limit`` is a number or a Column (a limit that depends on the row).
    ``tolerance`` widens the limit; ``round_digits`` rounds the measure first. ``on_missing``
    and ``on_fail`` are the statuses of a null measure and of a violation. ``applies`` and
    ``unless`` are SQL predicates: rows outside ``applies`` or inside ``unless`` get no check.
    """

    rule_id: str
    measure: str
    comparison: str
    limit: float | Column | None = None
    tolerance: float = 0.0
    round_digits: int | None = None
    on_missing: str = "unavailable"
    on_fail: str = "fail"
    applies: str | None = None
    unless: str | None = None
    unit: str = ""

    def measured(self) -> Column:
        """The measure as a number, rounded as the rule asks."""
        value = F.col(self.measure)
        if self.comparison == "flag":
            return F.when(value, 1.0).otherwise(0.0)
        if self.comparison == "present":
            return value.cast("string").try_cast("double")
        value = value.cast("double")
        return value if self.round_digits is None else F.round(value, self.round_digits)

    def required(self) -> Column:
        """The limit as a double column."""
        limit = self.limit if isinstance(self.limit, Column) else F.lit(self.limit)
        return limit.cast("double")

    def violated(self) -> Column:
        """Three-valued: null where the measure is missing."""
        if self.comparison == "present":
            return F.col(self.measure).isNull()
        if self.comparison == "flag":
            return F.coalesce(F.col(self.measure), F.lit(False))
        if self.comparison == "minimum":
            return self.measured() < self.required() - F.lit(self.tolerance)
        if self.comparison == "maximum":
            return self.measured() > self.required() + F.lit(self.tolerance)
        raise ValueError(f"unknown comparison {self.comparison!r}")

    def status(self) -> Column:
        """pass, the failure status or the missing status."""
        bad = self.violated()
        return F.when(bad.isNull(), self.on_missing).when(bad, self.on_fail).otherwise("pass")

    def in_scope(self) -> Column:
        """Whether the row gets a check at all."""
        scope = F.lit(True)
        if self.applies is not None:
            scope = scope & F.coalesce(F.expr(self.applies), F.lit(False))
        if self.unless is not None:
            scope = scope & ~F.coalesce(F.expr(self.unless), F.lit(False))
        return scope


def evaluate(df: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """One row per key and rule in scope: ``keys, rule_id, status, measured, required, unit``.

    All rules are evaluated in a single pass: an array of structs is filtered and
    exploded inside the scan's stage, without a shuffle or a union of scans.
    """
    checks = F.array(
        *[
            F.when(
                r.in_scope(),
                F.struct(F.lit(r.rule_id).alias("rule_id"), r.status().alias("status"), r.measured().alias("measured"), r.required().alias("required"), F.lit(r.unit).alias("unit")),
            )
            for r in rules
        ]
    )
    return df.select(*keys, F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("check")).select(*keys, "check.*")


def violations(df: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """The checks that fail."""
    return evaluate(df, rules, keys).where("status = 'fail'")


def residual(df: DataFrame, blocked: str, causes: list[Rule], rule_id: str, keys: list[str]) -> DataFrame:
    """Rows whose ``blocked`` flag is set and that none of ``causes`` explains."""
    explained = F.lit(False)
    for r in causes:
        explained = explained | (r.in_scope() & F.coalesce(r.violated(), F.lit(False)))
    return df.where(F.expr(blocked) & ~explained).select(*keys, F.lit(rule_id).alias("rule_id"))


def roll_up(issues: DataFrame, key: str) -> DataFrame:
    """Per key that has issues: ``status = fail``, the sorted distinct reasons and their number."""
    return issues.groupBy(key).agg(F.lit("fail").alias("status"), F.array_sort(F.collect_set("rule_id")).alias("reasons"), F.count("*").alias("n_issues"))
