"""Toxicity by compression distance.

Two dictionaries are trained by zstandard on a bounded sample of labelled texts, and
loaded as trained, with their entropy tables. The ordinary one is trained on windows
of ordinary text. The toxic one is trained on the segments of toxic texts whose byte
n-grams are significantly more frequent there than in ordinary texts: zstandard
selects what is frequent, which in whole toxic texts is what is frequent in any text.
It stands behind the ordinary one, in the same compressor, so that the two compressors
differ by the toxic dictionary alone.

A text is cut into windows at spaces. The difference of a window's two compressed
lengths tells how much of it only the toxic dictionary knows. Thresholds on it are
calibrated on ordinary texts: the differences that one window in 10, 100 and 1000
reaches. Logistic regression weighs a text's largest and mean differences and its
windows over the thresholds, on labelled texts that the dictionaries did not see.

Defined results: a null or empty text has one empty window and a score; texts are
scored whole; rows that repeat a labelled text with its id are learnt from once; a
text with both labels is learnt from as both; without labels of both kinds every
score is 0; an empty table gives no rows; other columns, whatever their names, are
ignored (``reject`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bounded, bounded_rows, hand_back, sample_labels
from plumbline.sources.shared import drop_table, work_table

GAP = b"\n" * 64

#: Bytes of a text, or slots, handled at once in training.
PIECE = 1 << 16


@dataclass(frozen=True)
class ToxicityParams:
    """Parameters. ``max_toxic`` and ``max_ordinary`` rows of ``max_bytes`` in all bound the sample, in the order of a
    hash of the id; the ordinary dictionary is trained on the first ``train_bytes`` of its windows."""

    window: int = 64
    gram: int = 5
    max_toxic: int = 2000
    max_ordinary: int = 4000
    max_bytes: int = 24_000_000
    train_bytes: int = 12_000_000
    ordinary_bytes: int = 65536
    toxic_bytes: int = 16384
    min_z: float = 6.0
    min_ratio: float = 6.0
    level: int = 3
    min_match: int = 5
    quantiles: tuple[float, ...] = (0.9, 0.99, 0.999)


@dataclass
class ToxicityModel:
    """Dictionaries, thresholds and weights; some hundred kilobytes, sent with the tasks."""

    params: ToxicityParams
    ordinary: bytes = b""
    toxic: bytes = b""
    thresholds: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    shift: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)


def cut(text: bytes, size: int) -> list[bytes]:
    """Windows of at most ``size`` bytes that end after a space where there is one."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            space = text.rfind(b" ", at, end)
            end = space + 1 if space > at else end
        out.append(text[at:end])
        at = end
    return out or [b""]


def flat(text: str | None) -> bytes:
    """A text's lower-cased bytes."""
    return (text or "").lower().encode("utf-8", "surrogatepass")


def _slots(text: bytes, n: int) -> np.ndarray:
    """Slots (22 bits) of the byte n-grams of a text, made in pieces: a temporary array takes eight bytes for each of a piece."""
    a = np.frombuffer(text, np.uint8)
    out = np.zeros(max(0, len(a) - n + 1), np.uint32)
    for s in range(0, len(out), PIECE):
        part = a[s : s + PIECE + n - 1].astype(np.uint64)
        h = np.zeros(len(part) - n + 1, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + part[k : len(part) - n + 1 + k]
        h ^= h >> np.uint64(29)
        out[s : s + PIECE] = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(42)
    return out


def typical_segments(toxic: list[bytes], ordinary: list[bytes], p: ToxicityParams) -> list[bytes]:
    """The runs of toxic texts made of n-grams that are significantly more frequent in toxic than in ordinary texts."""

    def texts_with(texts: list[bytes]) -> np.ndarray:
        counts = np.zeros(1 << 22, np.int32)
        for t in texts:
            counts[np.unique(_slots(t, p.gram))] += 1
        return counts

    a, b, na, nb = texts_with(toxic), texts_with(ordinary), len(toxic), len(ordinary)
    typical = np.zeros(len(a), bool)
    for s in range(0, len(a), PIECE):  # all slots at once took 120 MB more of the driver's memory
        x, y = a[s : s + PIECE], b[s : s + PIECE]
        pooled = (x + y) / (na + nb)
        z = (x / na - y / nb) / np.sqrt(pooled * (1 - pooled) * (1 / na + 1 / nb) + 1e-12)
        typical[s : s + PIECE] = (z > min(p.min_z, 0.5 * np.sqrt(na))) & ((x + 0.5) / (na + 1) > p.min_ratio * (y + 0.5) / (nb + 1)) & (x >= 3)
    out = []
    for t in toxic:
        hits = np.flatnonzero(typical[_slots(t, p.gram)])
        if len(hits):
            breaks = np.flatnonzero(np.diff(hits) > 3)
            out += [t[i:j] for i, j in zip(np.append(hits[0], hits[breaks + 1]), np.append(hits[breaks], hits[-1]) + p.gram, strict=True)]
    return out


def dictionary(samples: list[bytes], size: int, k: int) -> bytes:
    """A zstandard dictionary trained on samples; of too few to train on, the samples themselves."""
    try:
        return zs.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-size:]


class Scorer:
    """Compressors of one task."""

    def __init__(self, model: ToxicityModel):
        p = model.params
        how = zs.ZstdCompressionParameters.from_level(p.level, min_match=p.min_match, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.model, self.pair = model, [zs.ZstdCompressor(compression_params=how, dict_data=zs.ZstdCompressionDict(d)).compress for d in (model.ordinary, model.toxic)]

    def differences(self, raw: bytes) -> np.ndarray:
        """What the toxic dictionary saves in each window of a text."""
        plain, toxic = self.pair
        return np.array([len(plain(w)) - len(toxic(w)) for w in cut(raw, self.model.params.window)], np.float64)

    def features(self, raw: bytes) -> list[float]:
        """Features of the window differences of a whole text."""
        d = self.differences(raw)
        top = np.sort(d)[::-1]
        over = [(d >= t) for t in self.model.thresholds]
        return [top[0], top[:3].mean(), np.clip(d, 0, None).sum() / np.sqrt(len(raw) + 50), d.mean(), *[o.mean() for o in over], *[np.log1p(o.sum()) for o in over], np.log1p(len(d))]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1."""
        m = self.model
        if not m.weights or not texts:
            return np.zeros(len(texts))
        x = (np.array([self.features(flat(t)) for t in texts]) - m.shift) / m.scale
        return 1 / (1 + np.exp(-np.clip(x @ np.array(m.weights[1:]) + m.weights[0], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first weight is the bias."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (q * (1 - q))[:, None]) + penalty, a.T @ (y - q) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, marks: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit on ``docs`` (doc_id, text) and ``marks`` (doc_id, label; one row an id).

    The sample is chosen among the labels, in the order of a hash of the id, and its
    texts alone reach the driver.
    """
    p = params
    chosen = sample_labels(marks, p.max_toxic, 17, 1), sample_labels(marks, p.max_ordinary, 17, 0)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"), F.octet_length(text).alias("size"))
    sample = work_table(texts.join(chosen[0], "doc_id").unionByName(texts.join(chosen[1], "doc_id")).drop("doc_id"), "labelled")
    got = [(flat(r.text), r.label, r.o) for r in bounded_rows(sample, ["o", "label", "h"], "size", p.max_toxic + p.max_ordinary, p.max_bytes)]
    drop_table(sample)
    model = ToxicityModel(p)
    fit = {k: [t for t, y, o in got if o % 3 and y == k] for k in (0, 1)}
    held = [(t, y) for t, y, o in got if o % 3 == 0]
    if min(len(fit[0]), len(fit[1])) < 8 or len({y for _, y in held}) < 2:
        return model
    windows = [w for t in fit[0] for w in cut(t, 96) if len(w) >= 8]
    windows = windows[: int(np.searchsorted(np.cumsum([len(w) for w in windows]), p.train_bytes, side="right"))]
    ordinary = dictionary(windows, p.ordinary_bytes, 48)
    del windows
    model.ordinary, model.toxic = ordinary + GAP, ordinary + dictionary(typical_segments(fit[1], fit[0], p), p.toxic_bytes, 16) + GAP
    scorer = Scorer(model)
    usual = np.concatenate([scorer.differences(t) for t, y in held if y == 0])
    model.thresholds = np.unique(np.maximum(1.0, np.quantile(usual, p.quantiles))).tolist()
    x, y = np.array([scorer.features(t) for t, _ in held]), np.array([y for _, y in held], float)
    shift, scale = x.mean(0), x.std(0) + 1e-9
    model.weights = _logistic((x - shift) / scale, y).tolist()
    model.shift, model.scale = shift.tolist(), scale.tolist()
    del got, fit, held
    hand_back()
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score`` of each row of ``docs``; one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in bounded(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scorer.scores(b.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    kept = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return kept.mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in bounded(batches):
            yield b.filter(pa.array(scorer.scores(b.column("text").to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
