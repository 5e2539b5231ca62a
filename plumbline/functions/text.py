"""Text, hash and fact expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ladder(text: Column, steps: list[tuple[str, list[str]]], otherwise: str, empty: str) -> Column:
    """The first step of which a keyword is in the lower-cased text."""
    low = F.lower(text)
    out = F.when(text.isNull() | (F.trim(text) == ""), empty)
    for name, words in steps:
        out = out.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), name)
    return out.otherwise(otherwise)


def join_distinct(rows: DataFrame, key: str, value: str, order: str, name: str) -> DataFrame:
    """Distinct values of each key without regard to case, in order of first sight, joined with bars."""
    first = F.row_number().over(Window.partitionBy(key, F.lower(value)).orderBy(order, value))
    kept = rows.withColumn("_k", first).where("_k = 1")
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.lower(value).alias("v")))).alias("v")).select(key, F.array_join(F.transform("v", lambda s: s.v), " | ").alias(name))


def stable_id(prefix: str, *parts: Column) -> Column:
    """An id that depends on its parts alone: a prefix and eleven hexadecimal digits."""
    return F.concat(F.lit(prefix), F.upper(F.substr(F.sha1(F.encode(F.concat_ws("|", *parts), "UTF-8")), F.lit(1), F.lit(11))))


def slug(text: Column) -> Column:
    """Lower-case letters and digits, anything else a single hyphen."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def uri_part(text: Column) -> Column:
    """A name safe in a URI."""
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "_")


def facts(rows: DataFrame, subject: Column, columns: list[str]) -> DataFrame:
    """Non-null columns as typed facts: numbers rounded to 4 places, booleans, and text (P20)."""
    kinds = dict(rows.dtypes)
    items = []
    for c in columns:
        number = kinds[c] not in ("boolean", "string")
        items.append(
            F.when(
                F.col(c).isNotNull(),
                F.struct(
                    F.lit(c).alias("predicate"),
                    (F.round(F.col(c).cast("double"), 4) if number else F.lit(None).cast("double")).alias("obj_double"),
                    (F.col(c) if kinds[c] == "boolean" else F.lit(None).cast("boolean")).alias("obj_bool"),
                    (F.col(c) if kinds[c] == "string" else F.lit(None).cast("string")).alias("obj_str"),
                ),
            )
        )
    return rows.select(subject.alias("subject"), F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("f")).select("subject", "f.*")
