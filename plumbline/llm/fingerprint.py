"""Document fingerprints: MinHash over word shingles, in vectorised numpy.

Each slot of a fingerprint is the smallest value of one multiply-shift hash over the
text's shingles, kept to 16 bits. The share of equal slots of two fingerprints
estimates the Jaccard similarity of the shingle sets. For near duplicates, bands of
slots are joined in Spark and the Jaccard similarity of what meets is verified on
the whole sets.

``edited_pairs`` compares every document with an edited form and with its successor
in ascending id. Documents are dealt to id ranges in one shuffle, compressed; the
first document of a range is also sent to the range before (of rows that repeat it,
one for each batch), so a task sees each document's successor, and the first of all
follows the last.

Defined results: a null or empty text has no shingles, equal slots with other empty
texts and with no others; equal ids are ordered by a 64-bit hash of their texts
(Spark's ``xxhash64``); a null id comes first; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bounded, partitions, words_of
from plumbline.llm.ngram_join import Signer, jaccard_components


@dataclass(frozen=True)
class MinHashParams:
    """``bands * rows`` slots over shingles of ``size`` words; 25 bands of 5 meet at 0.8 with probability 0.99995."""

    size: int = 5
    bands: int = 25
    rows: int = 5
    seed: int = 11

    @property
    def slots(self) -> int:
        """Slots of a fingerprint."""
        return self.bands * self.rows


def minima(hashes: np.ndarray, first: np.ndarray, p: MinHashParams) -> np.ndarray:
    """The 16-bit slots, ``rows x slots``, of flat shingle hashes with row offsets."""
    random = np.random.default_rng(p.seed)
    a = random.integers(0, 2**63, p.slots, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = random.integers(0, 2**63, p.slots, dtype=np.uint64)
    rows = len(first) - 1
    out = np.full((rows, p.slots), 0xFFFF, np.uint16)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        starts = first[full]
        for k in range(p.slots):
            out[full, k] = np.minimum.reduceat((hashes * a[k] + b[k]) >> np.uint64(32), starts).astype(np.uint16)
    return out


def signatures(column: pa.Array, p: MinHashParams) -> np.ndarray:
    """Slots of a string column."""
    return minima(*words_of(column).shingles(p.size), p)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal slots, row by row."""
    return (x == y).mean(axis=1)


def encode(slots: np.ndarray) -> str:
    """A fingerprint as text."""
    return base64.b64encode(slots.astype("<u2").tobytes()).decode()


def band_signer(p: MinHashParams) -> Signer:
    """One signature for each band of each set."""

    def sign(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        full = [i for i, s in enumerate(sets) if len(s)]
        if not full:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])])
        slots = minima(np.concatenate([sets[i] for i in full]), first, p).astype(np.uint64)
        keys = np.zeros((len(full), p.bands), np.uint64) + np.arange(p.bands, dtype=np.uint64)
        for r in range(p.rows):
            keys = (keys ^ slots[:, r :: p.rows]) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(29)
        return keys.ravel(), np.repeat(np.array(full), p.bands)

    return sign


def near_duplicates(docs: DataFrame, params: MinHashParams = MinHashParams(), num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links``: documents that meet in a band, verified by exact Jaccard."""
    return jaccard_components(docs, params.size, num, den, signer=band_signer(params))


def edited_pairs(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likeness.

    The edited text has its last ``floor(n / 2)`` code points replaced by the first as
    many (or all) of the next document in ascending id; the first follows the last.
    """
    p, n = params, partitions(docs)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(key.alias("key"), F.xxhash64(text).alias("tie"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    ends = np.unique(np.array(rows.approxQuantile("key", [k / n for k in range(1, n)], 0.1 / n) if n > 1 else [], np.float64).astype(np.int64))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ties = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "tie"))
            part = np.searchsorted(ends, ids, side="right")
            order = np.lexsort((ties, ids, part))
            first = order[np.unique(part[order], return_index=True)[1]] if len(order) else order
            yield pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.array(ids[first], pa.int64()), pa.array(ties[first], pa.int64())], ["part", "key", "tie"])

    # One row for each range: its first document.
    found = rows.select("key", "tie").mapInArrow(heads, "part int, key long, tie long").groupBy("part").agg(F.min(F.struct("key", "tie")).alias("first"))
    lowest = {r.part: tuple(r["first"]) for r in found.collect()}
    used = sorted(lowest)
    head_to = {lowest[q]: used[i - 1] for i, q in enumerate(used)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zs.ZstdCompressor(level=1)
        for b in bounded(batches):
            ids = b.column("key").to_numpy(zero_copy_only=False)
            part = np.searchsorted(ends, ids, side="right").astype(np.int32)
            packed = np.array([packer.compress((t or "").encode()) for t in b.column("text").to_pylist()] + [None], object)[:-1]
            ties = b.column("tie").to_numpy(zero_copy_only=False)
            heads = {k: i for i, k in enumerate(zip(ids.tolist(), ties.tolist(), strict=True)) if k in head_to}
            copy = np.array(list(heads.values()), np.int64)
            take = np.concatenate([np.arange(len(ids)), copy])
            dest = np.concatenate([part, np.array([head_to[k] for k in heads], np.int32)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(dest, pa.int32()), pa.array(np.arange(len(take)) >= len(ids)), pa.array(ids[take], pa.int64()), pa.array(ties[take], pa.int64()), b.column("doc_id").take(pa.array(take)), pa.array(packed[take].tolist(), pa.binary())],
                ["part", "after", "key", "tie", "doc_id", "packed"],
            )

    dealt = rows.mapInArrow(deal, "part int, after boolean, key long, tie long, doc_id long, packed binary")
    placed = dealt.repartition(n, "part").sortWithinPartitions("part", "after", "key", "tie").select("after", "doc_id", "packed")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zs.ZstdDecompressor()
        held: list[tuple[bool, int | None, str]] = []

        def close() -> pa.RecordBatch | None:
            pairs = [i for i in range(len(held) - 1) if not held[i][0]]
            texts = [h[2] for h in held]
            edited = []
            for i in pairs:
                cut = len(texts[i]) // 2
                edited.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
            last = held[-1]
            own, new = signatures(pa.array(texts, pa.large_string()), p), signatures(pa.array(edited, pa.large_string()), p)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([held[i][1] for i in pairs], pa.int64()),
                    pa.array([len(texts[i]) for i in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    pa.array([encode(own[i]) for i in pairs], pa.string()),
                    pa.array([encode(x) for x in new], pa.string()),
                    pa.array(likeness(own[pairs], new), pa.float64()),
                    pa.array(likeness(own[pairs], own[[i + 1 for i in pairs]]), pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            held[:] = [last]
            return out

        size = 0
        for b in bounded(batches, "packed", 1 << 19):
            for after, doc, packed in zip(b.column("after").to_pylist(), b.column("doc_id").to_pylist(), b.column("packed").to_pylist(), strict=True):
                held.append((after, doc, opener.decompress(packed).decode()))
                size += len(held[-1][2])
                if size > 1 << 20 and len(held) > 1:
                    yield close()
                    size = 0
        if len(held) > 1:
            yield close()

    return placed.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
