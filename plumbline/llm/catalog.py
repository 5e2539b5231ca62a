"""Thin queries over the operators of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import chat, decontamination, fingerprint, ngram_join, packing, pii, quality, token_counts, token_output, toxicity
from plumbline.llm.common import documents, fold_of
from plumbline.llm.tokens import vocabulary
from plumbline.sources.shared import broadcast_if_small, new_path, work_table


def marks(spark: SparkSession, sf_dir: str, label: str, learn: Column) -> DataFrame:
    """``doc_id, label`` of the labels that may be learnt from; repeated labels take the largest."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").where(learn).where(F.col(label).isin(0, 1))
    return rows.groupBy("doc_id").agg(F.max(label).alias("label"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text; labels of fold 0 of 5 are held out."""
    fold = fold_of(F.col("doc_id"), 5)
    docs = documents(spark, sf_dir)
    return _scored(toxicity.score(docs, toxicity.train(docs, marks(spark, sf_dir, "toxic", fold != 0))), fold == 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text; labels of fold 1 of 3 are held out."""
    fold = fold_of(F.col("doc_id"), 3)
    docs = documents(spark, sf_dir)
    return _scored(quality.score(docs, quality.train(docs, marks(spark, sf_dir, "quality", fold != 1))), fold == 1)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text; counts and digest of the base entities, and all spans, secrets and discovered ones too."""
    docs = documents(spark, sf_dir)
    grouped = work_table(pii.spans_by_document(docs, pii.find_pii(docs)), "spans")
    rows = pii.attach(docs, grouped)

    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s.rank == rank)).cast("long")

    base = pii.span_text(F.filter("spans", lambda s: s.rank < 4))
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return rows.select("doc_id", *counts[:4], F.sha2(base, 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"), *counts[4:])


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, written as Parquet lists in ascending doc_id, and read back."""
    path = new_path(spark, "tokens")
    token_output.write_tokens(documents(spark, sf_dir), path, vocabulary(), end_id=0)
    return token_output.read_digests(spark, path)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded to flat files; the end ids found again give each document's count.

    The token files have no ids of documents: the writer's sidecar names them.
    """
    path, end = new_path(spark, "flat"), 50256
    token_counts.write_flat(documents(spark, sf_dir), path, vocabulary(), end)
    counts = token_counts.count_tokens(token_counts.scan_blocks(spark, f"{path}/kind=tokens", end))
    named = token_counts.name_documents(counts, token_counts.read_ids(spark, path))
    return named.select("doc_id", "file", "ordinal", "start", "n_tokens", "closed")


def _scored(scores: DataFrame, held_out: Column) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


PROBE = "\\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -7 of control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role FROM VALUES (0, 'user'), (1, 'assistant') AS v(turn, role)").withColumn("text", F.lit(PROBE))
    turns = chat.threads(rows.unionByName(probe), "conv_id", ["turn", "role", "text"]).withColumn("score", F.lit(0.0))
    done = chat.format_paths(chat.reply_paths(turns, "conv_id"), "conv_id")
    back = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(text) + length(text) - length(replace(replace(text, '\', ''), '<', '')) AS body,
    length(role) + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '"', '')) AS head FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(head + body + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return ngram_join.jaccard_components(documents(spark, sf_dir), size=3, num=90, den=100)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items: ``doc_id, item_id, score``."""
    return decontamination.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut into sequences, which are dealt to optimal length buckets and batches."""
    return packing.pack(packing.token_lengths(documents(spark, sf_dir), vocabulary()))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash fingerprints of each text and its edited form; and near duplicates by bands, verified.

    ``near_component`` is the smallest id that verified links reach, ``near_links`` their number.
    """
    docs = documents(spark, sf_dir)
    near = fingerprint.near_duplicates(docs).where("n_links > 0").select(F.col("doc_id").alias("id"), "component_id", "n_links").distinct()
    near = broadcast_if_small(work_table(near, "near"), ngram_join.MOST_BROADCAST)
    pairs = fingerprint.edited_pairs(docs)
    joined = pairs.join(near, pairs.doc_id == near.id, "left")
    return joined.select(*pairs.columns, F.coalesce("component_id", "doc_id").alias("near_component"), F.coalesce("n_links", F.lit(0)).alias("near_links"))


OP4_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM t),
n AS (SELECT doc_id, len(g)::BIGINT AS n_shingles FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 90 * (p.n_shingles + q.n_shingles - common)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1),
d AS (SELECT a AS doc_id, count(*)::BIGINT AS n_links FROM u GROUP BY 1)
SELECT n.doc_id, n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links FROM n JOIN k USING (doc_id) LEFT JOIN d USING (doc_id)
"""

QUERIES = {"op2_pii": op2_pii, "op5_decontamination": op5_decontamination, "op6_packing": op6_packing, "op7_fingerprint": op7_fingerprint, "op4_ngram_join": op4_ngram_join, "op1_toxicity": op1_toxicity, "op3_token_output": op3_token_output, "op8_token_counts": op8_token_counts, "op9_quality": op9_quality, "op10_chat_format": op10_chat_format}
ORACLES = {"op4_ngram_join": OP4_SQL, "op10_chat_format": OP10_SQL}
