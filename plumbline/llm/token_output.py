"""Token ids as Parquet lists, for selective reads of tokens or of metadata.

One file for each range of document ids, rows in ascending id within it; each row
has the ids, their number and their place in the file, so that readers can take any
document, id range or just the counts. Writer settings: dictionary pages for the ids
(a vocabulary of 50k needs 16 bits an id), version 2 pages, so that integer columns
which leave the dictionary are delta encoded, small row groups and pages, and the
page indexes that Parquet readers use to skip pages by ``doc_id``.

A document's global start is its file's offset plus its place in the file; only the
files' totals are summed across the corpus.

Defined results: a null or empty text has the end id alone; repeated ids stay, in
the order of their texts; a null id comes first; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import bounded, partitions
from plumbline.llm.tokens import Encoder

SCHEMA = "doc_id long, part int, place long, n_tokens long, ids array<int>"

#: Writer settings. Row groups hold about 4 million ids, pages at most 2000 rows.
LAYOUT = {
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": "1048576",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(8 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, files: int | None = None) -> None:
    """Encode ``doc_id, text`` rows and write them under ``path`` in ascending ``doc_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, place = Encoder.of(vocabulary), TaskContext.get().partitionId(), 0
        for b in bounded(batches):
            coded, counts = encoder.encode_column(b.column("text"), end_id)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(coded))
            places = place + offsets[:-1]
            place += int(offsets[-1])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(len(counts), part, np.int32)), pa.array(places), pa.array(counts), ids], ["doc_id", "part", "place", "n_tokens", "ids"])

    n = files or max(1, partitions(docs))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, SCHEMA).write.options(**LAYOUT).parquet(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens`` from the metadata columns alone; the ids aren't read."""
    meta = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "part", "place", "n_tokens")
    return meta.join(_offsets(meta), "part").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """``doc_id, ids`` of an id range; the range is pushed down to row groups and pages."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    rows = rows if first is None else rows.where(F.col("doc_id") >= first)
    rows = rows if last is None else rows.where(F.col("doc_id") <= last)
    return rows.select("doc_id", "ids")


def _offsets(meta: DataFrame) -> DataFrame:
    """Ids before each file: one row for each file is summed."""
    totals = meta.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("base"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files: starts from metadata, checksums from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            values = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            sums = [zlib.crc32(values[i:j].tobytes()) for i, j in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("place"), pa.array(np.asarray(ends - starts, np.int64)), pa.array(sums, pa.int64())], ["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(SCHEMA).parquet(path)
    sums = rows.select("doc_id", "part", "place", "ids").mapInArrow(run, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    return sums.join(_offsets(rows.select("part", "n_tokens")), "part").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
