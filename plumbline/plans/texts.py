"""Queries of text, hash, JSON and fact operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.plans.registry import query
from plumbline.sources.tables import table

LADDER = [("transit", ["the ", "der "]), ("stair", ["ion ", "ung "]), ("office", ["que", "tion"]), ("lobby", ["en", "el"])]


@query(
    """
    SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'none'
      WHEN contains(lower(text), 'the ') OR contains(lower(text), 'der ') THEN 'transit'
      WHEN contains(lower(text), 'ion ') OR contains(lower(text), 'ung ') THEN 'stair'
      WHEN contains(lower(text), 'que') OR contains(lower(text), 'tion') THEN 'office'
      WHEN contains(lower(text), 'en') OR contains(lower(text), 'el') THEN 'lobby' ELSE 'other' END AS usage FROM documents
    """
)
def text_classify_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered keyword ladder over whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", T.ladder(F.col("text"), LADDER, "other", "none").alias("usage"))


@query(
    """
    WITH k AS (SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY conv_id, role),
    f AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, lower(role) ORDER BY turn, role) AS k FROM conversations)
    SELECT conv_id, string_agg(lower(role), ' | ' ORDER BY turn) AS said FROM f WHERE k = 1 GROUP BY conv_id
    """
)
def text_dedupe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values without regard to case, the first kept, joined in order."""
    return T.join_distinct(table(spark, sf_dir, "conversations"), "conv_id", "role", "turn", "said")


@query(
    """
    SELECT p_partkey, 'I' || upper(substr(sha1(p_name || '|' || p_brand), 1, 11)) AS id, substr(sha256(p_brand), 1, 16) AS floor_key,
      trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(p_brand, '[^A-Za-z0-9_-]', '_', 'g') AS uri FROM part
    """
)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from hashes, slugs and URI-safe names (D7, K5 and the hash functions)."""
    return table(spark, sf_dir, "part").select("p_partkey", T.stable_id("I", F.col("p_name"), F.col("p_brand")).alias("id"), F.substr(F.sha2("p_brand", 256), F.lit(1), F.lit(16)).alias("floor_key"), T.slug(F.col("p_name")).alias("slug"), T.uri_part(F.col("p_brand")).alias("uri"))


@query("SELECT event_type, coalesce(json_extract_string(props, '$.k')::BIGINT % 10, -1) AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by a property of a JSON column (S4, S13, the JSON functions)."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type", F.coalesce(k % 10, F.lit(-1).cast("long")).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    """
    SELECT subject, predicate, obj_double, obj_bool, obj_str FROM (
      SELECT 'acc:element/' || p_partkey AS subject, 'size' AS predicate, round(p_size::DOUBLE, 4) AS obj_double, NULL::BOOLEAN AS obj_bool, NULL::VARCHAR AS obj_str FROM part WHERE p_size IS NOT NULL
      UNION ALL SELECT 'acc:element/' || p_partkey, 'price', round(p_retailprice, 4), NULL, NULL FROM part WHERE p_retailprice IS NOT NULL
      UNION ALL SELECT 'acc:element/' || p_partkey, 'large', NULL, p_size > 25, NULL FROM part WHERE p_size IS NOT NULL
      UNION ALL SELECT 'acc:element/' || p_partkey, 'brand', NULL, NULL, p_brand FROM part WHERE p_brand IS NOT NULL)
    """
)
def facts_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns as subject, predicate, object facts with typed objects."""
    parts = table(spark, sf_dir, "part").withColumns({"size": F.col("p_size"), "price": F.col("p_retailprice"), "large": F.col("p_size") > 25, "brand": F.col("p_brand")})
    return T.facts(parts, F.concat(F.lit("acc:element/"), F.col("p_partkey").cast("string")), ["size", "price", "large", "brand"])


@query(
    """
    SELECT event_type, count(*) AS n, 'n=' || count(*) || ' ' || event_type || CASE WHEN count(*) = 1 THEN '' ELSE 's' END AS said, split_part('code|' || event_type || '|x', '|', 2) AS rest
    FROM events WHERE regexp_matches(event_type, '^[a-z_]+$') GROUP BY event_type
    """
)
def text_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences from counts, and codes split from text (U5, W10 and the string functions)."""
    counts = table(spark, sf_dir, "events").where(F.rlike("event_type", F.lit("^[a-z_]+$"))).groupBy("event_type").agg(F.count("*").alias("n"))
    said = F.concat(F.lit("n="), F.col("n").cast("string"), F.lit(" "), "event_type", F.when(F.col("n") == 1, "").otherwise("s"))
    return counts.select("event_type", "n", said.alias("said"), F.split_part(F.concat(F.lit("code|"), "event_type", F.lit("|x")), F.lit("|"), F.lit(2)).alias("rest"))
