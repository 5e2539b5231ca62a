"""Nearest vectors by dot product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of query vectors in a block, which is sent with the tasks.
BLOCK_BYTES = 16 << 20


def nearest_of_all(vectors: DataFrame, queries: DataFrame, ident: str, vector: str) -> DataFrame:
    """``ident, nearest_id``: for each query the other vector of the largest dot product (ties: smallest id).

    Queries are a stated set and are taken in blocks of ``BLOCK_BYTES``; a block is one pass over
    all vectors. A task keeps the best of each query, so a row for each query and task is
    shuffled and no pair is. Vectors that are null, or of another width than the query, are nobody's.
    """
    found: list[DataFrame] = []

    def add(block: list[tuple[int, np.ndarray]]) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[float, int]] = {}
            for b in batches:
                rows = [(i, np.array(v, np.float64)) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if i is not None and v is not None]
                for width in {len(v) for _, v in rows}:
                    ids = np.array([i for i, v in rows if len(v) == width], np.int64)
                    all_rows = np.stack([v for _, v in rows if len(v) == width])
                    for q, x in block:
                        if len(x) != width:
                            continue
                        dots = np.where(ids == q, -np.inf, np.einsum("ij,j->i", all_rows, x))
                        top = dots.max()
                        if top > -np.inf:
                            best[q] = min(best.get(q, (np.inf, 0)), (-float(top), int(ids[dots == top].min())))
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array([v[0] for v in best.values()], pa.float64()), pa.array([v[1] for v in best.values()], pa.int64())], ["q", "d", "id"])

        found.append(vectors.select(F.col(ident).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, "q long, d double, id long"))

    block: list[tuple[int, np.ndarray]] = []
    size = 0
    for r in queries.select(F.col(ident).alias("i"), F.col(vector).cast("array<double>").alias("v")).where("i is not null and v is not null").toLocalIterator():
        block.append((r.i, np.array(r.v, np.float64)))
        size += 8 * len(r.v)
        if size >= BLOCK_BYTES:
            add(block)
            block, size = [], 0
    if block or not found:
        add(block)
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    return rows.groupBy(F.col("q").alias(ident)).agg(F.min(F.struct("d", "id")).id.alias("nearest_id"))
