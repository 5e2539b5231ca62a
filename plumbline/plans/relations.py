"""Queries of joins, nearest matches, reductions and derived measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import measures as M
from plumbline.operators import relational as R
from plumbline.plans.registry import query
from plumbline.sources.tables import table


@query(
    """
    SELECT p_partkey, coalesce(nullif(p_size, 0)::DOUBLE * 10, nullif(p_retailprice, 0)) AS width,
      CASE WHEN p_size <> 0 THEN 'declared' WHEN p_retailprice <> 0 THEN 'property' ELSE 'missing' END AS source,
      CASE WHEN greatest(p_size, p_retailprice / 100) <= 0 THEN NULL WHEN least(p_size, p_retailprice / 100) <= 9.5 THEN greatest(p_size, p_retailprice / 100) ELSE least(p_size, p_retailprice / 100) END AS opening
    FROM part
    """
)
def coalesce_priority_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measure from the first source that has one, zero counting as missing, and its source."""
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    width, source = M.first_positive([("declared", size * 10), ("property", price)])
    return table(spark, sf_dir, "part").select("p_partkey", width.alias("width"), source.alias("source"), M.opening_width(size, price / 100, 9.5).alias("opening"))


@query("SELECT p_partkey, CASE WHEN p_size >= 30 AND p_retailprice <= 1300 THEN p_retailprice ELSE p_size::DOUBLE END AS width, CASE WHEN p_size >= 30 AND p_retailprice <= 1300 THEN p_size::DOUBLE ELSE p_retailprice END AS height, p_size >= 30 AND p_retailprice <= 1300 AS swapped FROM part")
def swap_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width and height exchanged where both look swapped."""
    w, h, s = M.unswap(F.col("p_size").cast("double"), F.col("p_retailprice"), 30, 1300)
    return table(spark, sf_dir, "part").select("p_partkey", w.alias("width"), h.alias("height"), s.alias("swapped"))


@query("WITH i AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT x.l_orderkey, x.l_partkey AS a, y.l_partkey AS b FROM i x JOIN i y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey")
def pair_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts in an order, as door pairs in a space (J3, H20); groups are orders, of a few lines."""
    return R.pairs_in_group(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query(
    """
    SELECT c_custkey, arg_min(s_suppkey, (abs(c_acctbal - s_acctbal), s_suppkey)) AS nearest_id, round(min(abs(c_acctbal - s_acctbal)), 4) AS distance
    FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey GROUP BY c_custkey
    """
)
def nearest_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer the supplier of the nation with the nearest balance."""
    left = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    right = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    return R.nearest(left, right, ["nation"], "c_acctbal", "s_acctbal", "s_suppkey").select("c_custkey", "nearest_id", F.round("distance", 4).alias("distance"))


@query(
    """
    WITH d AS (SELECT a.s_suppkey, b.s_suppkey AS near_id, abs(a.s_acctbal - b.s_acctbal) AS distance FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY distance, near_id) AS rank, min(distance) OVER (PARTITION BY s_suppkey) AS best FROM d)
    SELECT s_suppkey, rank::INT AS rank, near_id, round(distance, 4) AS distance FROM r WHERE rank <= 2 AND distance <= best + 500
    """
)
def nearest_k_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two nearest suppliers of the nation, within 500 of the nearest."""
    near = R.nearest_k_relative(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", "s_acctbal", 2, 500.0)
    return near.select("s_suppkey", "rank", "near_id", F.round("distance", 4).alias("distance"))


@query(
    """
    WITH b AS (SELECT p_partkey, p_size AS x0, p_size + 2 AS x1, p_retailprice AS y0, p_retailprice + 5 AS y1, p_brand FROM part),
    o AS (SELECT * FROM b WHERE p_brand = (SELECT min(p_brand) FROM part))
    SELECT p_partkey, EXISTS (SELECT 1 FROM o WHERE o.x0 <= b.x1 AND b.x0 <= o.x1 AND o.y0 <= b.y1 AND b.y0 <= o.y1) AS hit FROM b
    """
)
def box_overlap_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a box meets any obstacle box, the obstacles being one brand."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").alias("x0"), (F.col("p_size") + 2).alias("x1"), F.col("p_retailprice").alias("y0"), (F.col("p_retailprice") + 5).alias("y1"))
    first = parts.agg(F.min("p_brand").alias("p_brand"))
    obstacles = parts.join(first, "p_brand", "left_semi")
    met = R.box_pairs(parts, obstacles, [("x0", "x1", 8.0), ("y0", "y1", 50.0)], "p_partkey", "p_partkey").select("left_id").distinct()
    return parts.join(met, parts.p_partkey == met.left_id, "left").select("p_partkey", F.col("left_id").isNotNull().alias("hit"))


@query("SELECT l_orderkey, arg_max(l_tax, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS l_tax FROM lineitem GROUP BY 1")
def last_match_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line of each order decides."""
    return R.last_wins(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_tax")


@query("SELECT p_partkey AS part, 0.9::DOUBLE AS portal FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def anti_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts without a line get a default."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"))
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("part"))
    return R.with_default(parts, lines, "part", "portal", F.lit(0.9))


@query("SELECT size, count(*) AS n FROM (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1) GROUP BY size")
def count_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many customers have each number of orders (A2, A5)."""
    return R.histogram_of_counts(table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 20")
def type_counts_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most frequent types."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(20)


@query(
    """
    SELECT reason, l_returnflag AS status, count(*) AS n FROM (
      SELECT l_returnflag, unnest(list_filter([CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_quantity < 5 THEN 'quantity' END, CASE WHEN l_tax > 0.07 THEN 'tax' END], lambda x: x IS NOT NULL)) AS reason FROM lineitem)
    GROUP BY 1, 2
    """
)
def reason_explode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by reason and status of rows with reason arrays."""
    reasons = F.filter(F.array(F.when(F.col("l_discount") > 0.08, "discount"), F.when(F.col("l_quantity") < 5, "quantity"), F.when(F.col("l_tax") > 0.07, "tax")), lambda x: x.isNotNull())
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("status"), F.explode(reasons).alias("reason"))
    return rows.groupBy("reason", "status").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 4) AS median_price FROM lineitem GROUP BY 1, 2")
def group_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median by group."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.median("l_extendedprice"), 4).alias("median_price"))


@query(
    """
    WITH o AS (SELECT c_nationkey, count(*) AS n_orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_blocked FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1),
    c AS (SELECT c_nationkey, count(*) AS n_customers, round(avg(c_acctbal), 4) AS elevation FROM customer GROUP BY 1),
    s AS (SELECT s_nationkey, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS suppliers FROM supplier GROUP BY 1)
    SELECT n_name, r_name, coalesce(n_customers, 0)::BIGINT AS n_customers, elevation, coalesce(n_orders, 0)::BIGINT AS n_orders, coalesce(n_blocked, 0)::BIGINT AS n_blocked, coalesce(suppliers, '') AS suppliers
    FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN c ON c.c_nationkey = n_nationkey LEFT JOIN o ON o.c_nationkey = n_nationkey LEFT JOIN s ON s_nationkey = n_nationkey
    """
)
def floor_summary_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation with counts, an average and id lists: facts are aggregated before they meet."""
    customers = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").join(customers.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    o = orders.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_blocked"))
    c = customers.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_customers"), F.round(F.avg("c_acctbal"), 4).alias("elevation"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda k: k.cast("string")), ",").alias("suppliers"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = nations.join(c, "n_nationkey", "left").join(o, "n_nationkey", "left").join(s, "n_nationkey", "left")
    zero = F.lit(0).cast("long")
    return rows.select("n_name", "r_name", F.coalesce("n_customers", zero).alias("n_customers"), "elevation", F.coalesce("n_orders", zero).alias("n_orders"), F.coalesce("n_blocked", zero).alias("n_blocked"), F.coalesce("suppliers", F.lit("")).alias("suppliers"))


@query(
    """
    SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'O') THEN 'pass' WHEN bool_or(l_linestatus = 'O') THEN 'mixed' ELSE 'blocked' END AS outcome,
      CASE WHEN bool_or(l_linestatus = 'O') THEN -1 ELSE arg_max(l_partkey, (l_extendedprice, l_partkey)) END AS attempt FROM lineitem GROUP BY 1
    """
)
def directional_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status for the attempts of a key, and the longest blocked attempt."""
    lines = table(spark, sf_dir, "lineitem").withColumn("status", F.when(F.col("l_linestatus") == "O", "pass").otherwise("blocked"))
    found = R.directional(lines, "l_orderkey", "status", "l_extendedprice", "l_partkey")
    return found.withColumn("attempt", F.coalesce("attempt", F.lit(-1)))


@query(
    """
    WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate::DATE - DATE '1990-01-01' AS day, l_returnflag || l_linestatus AS reason, l_suppkey FROM lineitem),
    f AS (SELECT *, (row_number() OVER (PARTITION BY reason ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1)::INT AS opens FROM r)
    SELECT l_orderkey, l_linenumber, l_partkey, reason, opens FROM f ORDER BY opens DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 40
    """
)
def topn_with_first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty examples that show every reason first."""
    rows = table(spark, sf_dir, "lineitem").withColumn("reason", F.concat("l_returnflag", "l_linestatus"))
    return R.first_of_each(rows, "reason", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 40).select("l_orderkey", "l_linenumber", "l_partkey", "reason", "opens")


@query(
    """
    WITH p AS (SELECT least(l_suppkey, l_partkey) AS lo, greatest(l_suppkey, l_partkey) AS hi, l_orderkey, l_linenumber, l_extendedprice, l_suppkey, row_number() OVER (PARTITION BY least(l_suppkey, l_partkey), greatest(l_suppkey, l_partkey) ORDER BY l_suppkey <> least(l_suppkey, l_partkey), l_orderkey, l_linenumber, l_extendedprice) AS k FROM lineitem)
    SELECT lo, hi, l_orderkey, l_linenumber, l_suppkey = lo AS forward FROM p WHERE k = 1
    """
)
def canonical_pair_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a pair, forward direction preferred."""
    order = [(F.col("l_suppkey") != F.col("lo")), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice")]
    return R.canonical_pairs(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", order).select("lo", "hi", "l_orderkey", "l_linenumber", (F.col("l_suppkey") == F.col("lo")).alias("forward"))


@query(
    """
    SELECT vec_id, label, (SELECT arg_min(b.vec_id, (-list_dot_product(a.embedding, b.embedding), b.vec_id)) FROM embeddings b WHERE b.vec_id <> a.vec_id) AS nearest_id
    FROM embeddings a WHERE vec_id % 100 = 0
    """
)
def embedding_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query vector (ids divisible by 100) the vector of the largest dot product among all.

    The queries are a stated set, taken in blocks of bounded bytes; all rows are searched.
    """
    from plumbline.operators.vectors import nearest_of_all

    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 100 = 0")
    return queries.select("vec_id", "label").join(nearest_of_all(vectors, queries, "vec_id", "embedding"), "vec_id", "left")
