"""Shared pieces of the text operators: table reading, bounded batches, word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Texts handled at once by a vectorised kernel; its temporary arrays take about 40 times this.
BATCH_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text`` of the documents table; other columns are not read."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds, F.lit(0))


def fresh(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def sample_labels(marks: DataFrame, most: int, salt: int, label: int | None = None) -> DataFrame:
    """At most ``most`` rows ``doc_id, label, o`` of a label table, by a hash of the id; so few that they are broadcast."""
    order = F.xxhash64(F.col("doc_id"), F.lit(salt)).alias("o")
    rows = marks.where("label in (0, 1)" if label is None else F.col("label") == label)
    return F.broadcast(rows.select("doc_id", "label", order).orderBy("o", "doc_id").limit(most))


def bounded_rows(table: DataFrame, order: list[str], size: str, most_rows: int, most: int) -> list[Row]:
    """The first rows of a written table in ``order`` (its key: repeated rows count once), ``most`` of ``size`` in all.

    A row of more than an eighth of ``most`` is passed over. Only the keys and sizes of ``most_rows``
    rows, and then the rows taken, reach the driver.
    """
    once = table.where(F.col(size) <= most // 8).dropDuplicates(order)
    last, total = None, 0
    for r in once.select(*order, size).orderBy(*order).limit(most_rows).collect():
        total += r[size]
        if total > most:
            break
        last = r
    if last is None:
        return []
    taken = once.where(F.struct(*order) <= F.struct(*[F.lit(last[c]).cast(table.schema[c].dataType).alias(c) for c in order]))
    return sorted(taken.collect(), key=lambda r: tuple(r[c] for c in order))


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bounded(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of text each, or a single row.

    At the end of a task its worker, which Spark keeps for other tasks, returns free memory to the machine.
    """
    try:
        yield from _slices(batches, text, most)
    finally:
        hand_back()


def hand_back() -> None:
    """Return freed memory to the machine, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def one_thread() -> None:
    """Matrix products on the task's own core: OpenBLAS keeps a thread spinning on each other core of the executor."""
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def _slices(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of the ranges of ``n`` numbers from ``first`` on, one range after the other."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit sums over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_PLACES = np.random.default_rng(20240607).integers(0, 2**63, 1 << 14, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: For each byte, its lower-cased value plus 1, or 0 where it separates words.
_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)
_SOLID = np.where((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)), 0, _LOWER + 1).astype(np.uint64)
_LETTERS = np.where((_BYTES >= 128) | ((_LOWER >= 97) & (_LOWER <= 122)) | ((_BYTES >= 48) & (_BYTES <= 57)), _LOWER + 1, 0).astype(np.uint64)


def flat_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array and the n + 1 offsets of its rows; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    data = pa.concat_arrays([column])
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    body = data.buffers()[2]
    flat = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(body) else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of lower-cased (A-Z) texts: one hash each, and where rows begin.

    With ``letters``, words are runs of letters, digits and non-ASCII characters instead.
    ``hashes`` holds a 64-bit hash for each word of all rows; row i has the words
    ``first[i]`` up to ``first[i + 1]``. ``begin`` are byte positions in the batch.
    """

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, letters: bool = False):
        weight = _LETTERS if letters else _SOLID
        solid = (weight != 0)[flat]
        opens = solid.copy()
        opens[1:] &= ~solid[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        opens[heads] = solid[heads]
        self.begin = np.flatnonzero(opens)
        if len(self.begin):
            at = self.begin[0]
            spans = np.diff(np.append(self.begin, len(flat)))
            place = np.arange(at, len(flat), dtype=np.int32) - np.repeat(self.begin.astype(np.int32), spans)
            value = weight[flat[at:]]
            if spans.max() > len(_PLACES):
                value = value * (np.uint64(2) * (place >> 14).astype(np.uint64) + np.uint64(1))
            value *= _PLACES[place & (len(_PLACES) - 1)]
            self.hashes = mix(np.add.reduceat(value, self.begin - at))
        else:
            self.hashes = np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.begin, offsets)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of ``size`` words, and n + 1 offsets by row.

        A row with fewer words has its whole sequence as its only run; without words, none.
        """
        count = np.diff(self.first)
        runs = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
        first = np.concatenate([[0], np.cumsum(runs)])
        total = int(first[-1])
        if total == 0:
            return np.zeros(0, np.uint64), first
        row = np.repeat(np.arange(len(count)), runs)
        at = np.arange(total) - np.repeat(first[:-1], runs) + np.repeat(self.first[:-1], runs)
        stop = self.first[1:][row]
        out = np.zeros(total, np.uint64)
        for j in range(size):
            inside = at + j < stop
            out[inside] += self.hashes[(at + j)[inside]] * _PLACES[j + 7]
        return mix(out), first


def words_of(column: pa.Array) -> Words:
    """Word hashes of a string column."""
    return Words(*flat_utf8(column))
