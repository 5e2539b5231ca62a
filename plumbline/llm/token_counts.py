"""Token counts by scanning flat token files for the end-of-document id.

A flat file is nothing but ids of a fixed width, one document after another, each
closed by the end id; there is no index. Files are cut into blocks. A task looks for
the end id in each block with one vectorised comparison and returns the positions
found. A prefix scan over the blocks of a file then adds the ids before each block
and carries the last end id before it, so a document that crosses any number of
blocks is counted once.

Files are read with Spark's ``binaryFile`` source, so any store that Spark reads
will do; that source takes a file as a row, of less than 2 GB. The writer here starts a
new file after ``FILE_DOCS`` documents, so its files are far smaller and a task holds one.

The writer also keeps a sidecar: the documents' ids in the order of the files, written by
the same task that writes the tokens. The scan doesn't need it; ``name_documents`` tells
with it which document a count belongs to.

Defined results: ids after the last end id of a file form a document that is not
closed; a null or empty text has no ids; repeated rows and ids, null ids too, are
documents of their own; an empty file or folder gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import bounded
from plumbline.llm.tokens import Encoder


#: Documents in a file of the writer.
FILE_DOCS = 10_000

#: A null id in the sidecar.
NO_ID = -(1 << 63)


def write_flat(docs: DataFrame, path: str, vocabulary: str, end_id: int, width: int = 2) -> None:
    """Encode ``doc_id, text`` rows to flat files of ``width``-byte ids under ``path/kind=tokens``, in row order.

    The ids of the documents go to ``path/kind=ids``, eight bytes each. Spark's text writer
    puts a separator after each row: here the bytes of the end id. It keeps a task's rows in
    order as long as it may hold both files open.
    """
    code = f"<u{width}"
    end = np.array([end_id], code).tobytes().decode("latin-1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for b in bounded(batches):
            ids, counts = encoder.encode_column(b.column("text"))
            if len(ids) and (ids.max() >= 1 << (8 * width) or (ids == end_id).any()):
                raise ValueError("an id doesn't fit the width, or is the end id")
            body, ends = ids.astype(code).tobytes(), np.cumsum(counts) * width
            coded = [body[e - n : e] for e, n in zip(ends.tolist(), (counts * width).tolist(), strict=True)]
            names = [struct.pack("<q", NO_ID if i is None else i) for i in b.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(coded + names, pa.binary()), pa.array(["tokens"] * len(coded) + ["ids"] * len(names))], ["value", "kind"])

    flat = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "value binary, kind string")
    conf, key = docs.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, "4")
    try:
        flat.select(F.col("value").cast("string"), "kind").write.partitionBy("kind").option("maxRecordsPerFile", FILE_DOCS).option("encoding", "ISO-8859-1").option("lineSep", end).text(path)
    finally:
        conf.set(key, before)


def read_ids(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """``file, ordinal, doc_id`` of a sidecar; ``file`` is the task's and the file's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("file"), b.column("content"), strict=True):
                cells = np.frombuffer(content.as_buffer(), [("doc_id", "<i8"), ("end", f"V{width}")])["doc_id"]
                for k in range(0, len(cells), 10_000):
                    part = cells[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(part)), pa.array(np.arange(k, k + len(part))), pa.array(part.astype(np.int64), mask=part == NO_ID)], ["file", "ordinal", "doc_id"])

    return _files(spark, f"{path}/kind=ids").mapInArrow(run, "file string, ordinal long, doc_id long")


def name_documents(counts: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id`` beside each count of the writer's files: both tables are dealt by file, which holds a bounded number."""
    return counts.join(ids, ["file", "ordinal"], "left")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``file, content``: a writer's file is known by the numbers of its task and of its place there, else by its name."""
    name = F.element_at(F.split("path", "/"), -1)
    number = F.concat_ws("-", F.regexp_extract(name, "^part-([0-9]+)-.*[.-]c([0-9]+)", 1), F.regexp_extract(name, "^part-([0-9]+)-.*[.-]c([0-9]+)", 2))
    return spark.read.format("binaryFile").load(path).select(F.when(number == "-", name).otherwise(number).alias("file"), "content")


def scan_blocks(spark: SparkSession, path: str, end_id: int, width: int = 2, block_ids: int = 1 << 19) -> DataFrame:
    """One row for each block: ``file, block, n_ids, ends`` (positions of the end id in the block)."""
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("file"), b.column("content"), strict=True):
                ids = np.frombuffer(content.as_buffer(), kind, len(content.as_buffer()) // width)
                for k in range(0, len(ids), block_ids):
                    block = ids[k : k + block_ids]
                    ends = np.flatnonzero(block == end_id)
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([k // block_ids], pa.int64()), pa.array([len(block)], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))], ["file", "block", "n_ids", "ends"])

    return _files(spark, path).mapInArrow(run, "file string, block long, n_ids long, ends array<long>")


def count_tokens(blocks: DataFrame) -> DataFrame:
    """One row for each document: ``file, ordinal, start, n_tokens, closed``, stitched across blocks.

    ``start`` is the position in the file; ``n_tokens`` leaves out the end id.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    b = blocks.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))
    b = b.withColumn("at", F.transform("ends", lambda e: e + F.col("base")))
    b = b.withColumn("carried", F.coalesce(F.max(F.array_max("at")).over(before) + 1, F.lit(0)).cast("long"))
    b = b.withColumn("ordinal0", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long"))
    last = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"))) == 1
    b = b.withColumn("stop", F.when(last, F.col("base") + F.col("n_ids")))
    starts = F.concat(F.array("carried"), F.transform("at", lambda e: e + 1))
    tail = F.element_at(starts, -1)
    found = F.transform(F.arrays_zip(F.slice(starts, F.lit(1), F.size("at")).alias("s"), F.col("at").alias("e")), lambda x: F.struct(x.s.alias("start"), (x.e - x.s).alias("n_tokens"), F.lit(True).alias("closed")))
    left = F.when(F.col("stop") > tail, F.array(F.struct(tail.alias("start"), (F.col("stop") - tail).alias("n_tokens"), F.lit(False).alias("closed")))).otherwise(F.slice(found, 1, 0))
    out = b.select("file", "ordinal0", F.posexplode(F.concat(found, left)).alias("k", "doc"))
    return out.select("file", (F.col("ordinal0") + F.col("k")).alias("ordinal"), "doc.start", "doc.n_tokens", "doc.closed")
