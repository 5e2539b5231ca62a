"""Packing into batches of sequences of like length.

Texts are measured in tokens (with an end id) and cut into sequences of at most
``max_length``. The histogram of sequence lengths, at most ``max_length`` rows,
covers the corpus; dynamic programming over it finds the ``buckets`` upper bounds
that minimise padding exactly. Inside a bucket, sequences are numbered and filled
into batches of ``budget`` padded tokens. Numbering is global without meeting in one
task: sequences are dealt to shards by hash, numbered there, and the shards' counts
are summed.

Defined results: a null or empty text is one sequence with the end id alone;
repeated rows are sequences of their own; texts over ``max_length`` are cut, never
dropped; fewer distinct lengths than buckets give a bucket each, without padding;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import bounded, partitions
from plumbline.llm.tokens import Encoder
from plumbline.sources.shared import work_table


@dataclass(frozen=True)
class PackingParams:
    """Longest sequence, number of buckets, padded tokens in a batch."""

    max_length: int = 4096
    buckets: int = 16
    budget: int = 65536


def token_lengths(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens`` of whole texts, the end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for b in bounded(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(encoder.encode_column(b.column("text"))[1] + 1)], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long")


def sequences(lengths: DataFrame, max_length: int) -> DataFrame:
    """``doc_id, seq, length``: each text cut into pieces of ``max_length`` and a rest."""
    pieces = F.ceil(F.col("n_tokens") / F.lit(max_length))
    cut = lengths.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("seq"))
    return cut.select("doc_id", "seq", F.least(F.lit(max_length).cast("long"), F.col("n_tokens") - F.col("seq") * max_length).alias("length"))


def bucket_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds, at most ``buckets`` of them, with the least total padding; exact, the first such on ties."""
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0), np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(k)] for k in lengths], np.int64)
    number = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    m, k = len(lengths), min(buckets, len(lengths))
    best = np.concatenate([[0], np.full(m, np.iinfo(np.int64).max // 4)])
    back = np.zeros((k, m + 1), np.int64)
    for b in range(k):
        now = np.full(m + 1, np.iinfo(np.int64).max // 4)
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (number[j] - number[:j]) - (tokens[j] - tokens[:j])
            i = int(np.argmin(cost))
            now[j], back[b, j] = cost[i], i
        best = now
    bounds, j = [], m
    for b in range(k - 1, -1, -1):
        bounds.append(int(lengths[j - 1]))
        j = int(back[b, j])
    return bounds[::-1]


def pack(lengths: DataFrame, params: PackingParams = PackingParams()) -> DataFrame:
    """``doc_id, seq, length, bucket, batch, slot`` from ``doc_id, n_tokens``.

    ``bucket`` is the padded length; ``batch`` counts within the bucket, ``slot`` within the batch.
    """
    p = params
    cut = work_table(sequences(lengths, p.max_length), "sequences")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    bounds = bucket_bounds(histogram, p.buckets) or [p.max_length]
    bound = F.element_at(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b >= F.col("length")), 1)
    shard = F.pmod(F.xxhash64("doc_id", "seq"), F.lit(partitions(cut)))
    dealt = cut.withColumns({"bucket": bound, "shard": shard})
    counts = dealt.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "seq", "length"))
    numbered = dealt.withColumn("k", place).join(offsets, ["bucket", "shard"]).withColumn("k", F.col("base") + F.col("k") - 1)
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(p.budget) / F.col("bucket")))
    return numbered.select("doc_id", "seq", "length", "bucket", F.floor(F.col("k") / room).cast("long").alias("batch"), F.pmod("k", room).cast("long").alias("slot"))
