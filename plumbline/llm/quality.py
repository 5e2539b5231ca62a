"""Quality by logistic regression over hashed word n-grams.

Texts become tokens: runs of letters, digits and other non-ASCII characters, and
runs of ASCII punctuation, lower-cased. A token of capitals also emits a mark, and a
word equal to the one before it becomes a mark of repetition, so shouting and
repetition are n-grams too. Unigrams and bigrams are hashed to ``2**bits`` slots;
a text is the unit vector of log(1 + count). Weights are learnt by follow the
regularised leader (proximal, with per-slot rates and L1, L2 terms), one text at a
time over a bounded sample, and a text's score is a sparse dot product.

Defined results: a null or empty text has no n-grams and gets the bias alone; texts
are scored whole and by themselves, so equal texts have equal scores; rows that repeat a
labelled text with its id are learnt from once; without labels all scores are 0.5; an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import _PLACES, bounded, bounded_rows, flat_utf8, mix, sample_labels
from plumbline.sources.shared import drop_table, work_table


@dataclass(frozen=True)
class QualityParams:
    """Parameters; the training sample is at most ``max_rows`` rows of ``max_features`` n-grams in all, in the order of a hash of the id."""

    bits: int = 18
    max_rows: int = 6000
    max_features: int = 12_000_000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05


@dataclass
class QualityModel:
    """Non-zero weights by slot (the bias apart): at most 2**bits floats."""

    params: QualityParams
    weights: np.ndarray
    bias: float


CAPS, SAME = np.uint64(0x51AB), np.uint64(0x7E9F)


def ngrams(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row, distinct slots and their values: flat slots, flat values, n + 1 offsets."""
    flat, offsets = flat_utf8(column)
    n_rows = len(offsets) - 1
    upper = (flat >= 65) & (flat <= 90)
    lower = np.where(upper, flat + 32, flat)
    space = (flat <= 32) | (flat == 127)
    wordy = (flat >= 128) | upper | ((flat >= 97) & (flat <= 122)) | ((flat >= 48) & (flat <= 57))
    kind = np.where(space, 0, np.where(wordy, 1, 2)).astype(np.int8)
    opens = kind != 0
    opens[1:] &= kind[1:] != kind[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[heads] = kind[heads] != 0
    begin = np.flatnonzero(opens)
    if len(begin) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(n_rows + 1, np.int64)
    place = np.arange(len(flat)) - np.repeat(begin, np.diff(np.append(begin, len(flat))))[-len(flat) :] if begin[0] == 0 else None
    if place is None:
        place = np.zeros(len(flat), np.int64)
        place[begin[0] :] = np.arange(begin[0], len(flat)) - np.repeat(begin, np.diff(np.append(begin, len(flat))))
    value = (lower.astype(np.uint64) + np.uint64(1)) * _PLACES[place & 0x3FFF]
    value[kind == 0] = 0
    h = mix(np.add.reduceat(value, begin))
    letters = np.add.reduceat((kind == 1).astype(np.int32), begin)
    capitals = np.add.reduceat(upper.astype(np.int32), begin)
    row = np.searchsorted(offsets, begin, side="right") - 1
    word = kind[begin] == 1
    same_row = np.zeros(len(h), bool)
    same_row[1:] = row[1:] == row[:-1]
    same = same_row & word
    same[1:] &= h[1:] == h[:-1]
    previous = np.concatenate([[np.uint64(0)], h[:-1]])
    pairs = np.where(same, SAME, h * _PLACES[1] + previous * _PLACES[2])
    shout = (capitals == letters) & (letters >= 2)
    codes = np.concatenate([h, mix(pairs[same_row]), np.full(int(shout.sum()), mix(np.array([CAPS]))[0])])
    rows = np.concatenate([row, row[same_row], row[shout]])
    key = (rows.astype(np.int64) << bits) | (codes >> np.uint64(64 - bits)).astype(np.int64)
    slots, counts = np.unique(key, return_counts=True)
    rows = slots >> bits
    first = np.searchsorted(rows, np.arange(n_rows + 1))
    values = np.log1p(counts).astype(np.float64)
    norms = np.sqrt(np.add.reduceat(np.append(values**2, 0.0), first[:-1].clip(max=len(values)))) if n_rows else np.zeros(0)
    return slots & ((1 << bits) - 1), (values / norms[rows]).astype(np.float32), first


def _features(docs: DataFrame, params: QualityParams) -> DataFrame:
    """``o, label, slots, values``: the sparse vector of each row as two binary columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            slots, values, first = ngrams(b.column("text"), params.bits)
            cells = [(slots[i:j].astype("<u4").tobytes(), values[i:j].astype("<f4").tobytes()) for i, j in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("o"), b.column("label"), pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())], ["o", "label", "slots", "values"])

    return docs.select("o", F.col("label").cast("int").alias("label"), F.col("text").cast("string")).mapInArrow(run, "o long, label int, slots binary, values binary")


class Leader:
    """Follow-the-regularised-leader state of a sparse logistic regression."""

    def __init__(self, p: QualityParams):
        self.p, size = p, (1 << p.bits) + 1
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        """The leader's weights at some slots."""
        z, p = self.z[at], self.p
        return np.where(np.abs(z) <= p.l1, 0.0, -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(self.n[at])) / p.alpha + p.l2))

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        """Learn from one text."""
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, marks: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    """Fit on ``docs`` (doc_id, text) and ``marks`` (doc_id, label; one row an id).

    The sample is chosen among the labels; executors hash its texts, the driver learns
    from the vectors.
    """
    coded = _features(docs.select("doc_id", "text").join(sample_labels(marks, params.max_rows, 29), "doc_id"), params)
    sample = work_table(coded.withColumns({"h": F.xxhash64("slots", "values"), "n": F.octet_length("slots") / F.lit(4)}), "vectors")
    leader, bias, got = Leader(params), 1 << params.bits, []
    for r in bounded_rows(sample, ["o", "label", "h"], "n", params.max_rows, params.max_features):
        got.append((np.append(np.frombuffer(r.slots, "<u4").astype(np.int64), bias), np.append(np.frombuffer(r["values"], "<f4"), 1.0), float(r.label)))
    drop_table(sample)
    for _ in range(params.epochs):
        for at, x, y in got:
            leader.update(at, x, y)
    w = leader.weights(slice(None))
    return QualityModel(params, w[:-1].astype(np.float32), float(w[-1]))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score`` of each row of ``docs``; one pass without a shuffle."""
    at = np.flatnonzero(model.weights)
    sparse = (at.astype(np.uint32), model.weights[at])
    bits, bias = model.params.bits, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << bits)
        weights[sparse[0]] = sparse[1]
        for b in bounded(batches):
            slots, values, first = ngrams(b.column("text"), bits)
            # Each row's own sum: a running sum over the batch would round by what stands before.
            full = np.diff(first) > 0
            margin = np.full(len(full), bias)
            if full.any():
                margin[full] += np.add.reduceat(weights[slots] * values, first[:-1][full])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
