"""Benchmark decontamination by latent semantic retrieval.

1. Statistics. Words are runs of letters and digits, lower-cased, known by 64-bit
   hashes. Document frequencies of the benchmark's words are counted over all
   documents; a word's weight is log((n + 1) / (df + 1)), but at least ``least`` of the
   largest weight: a leak that stands in many documents makes its own words frequent,
   and must still weigh more than the words in which its copies differ.
2. Latent space. Benchmark texts are cut into passages. The right singular vectors
   of their TF-IDF matrix, rows of unit length, are found by randomised subspace
   iteration: tasks hold passages A and return A'(A Q), a matrix of words by
   dimensions, from a fixed number of partitions. Passages of which the space keeps
   less than ``cover`` add the directions they lack, so each can be found.
3. Search. Every document is cut into overlapping windows, the sums of whole steps of
   words. A window's latent vector is compared with every passage, in blocks: as it is a
   sum over words, so is its product with the passage, and the words' products are made
   once for a block. The projection on the passage must reach the share of its length
   that ``weak`` of its words have even if they all weigh least and the others most.
4. Verification. The longest common subsequence of passage words and the words
   around the window decides: ``strong`` of the passage is a hit; from ``weak`` on the
   passage's answer (the ``answer`` column, or else its last words) must be there too.

Defined results: hits only, one row for each document and item; null or empty texts
have none; benchmark texts without words match nothing; repeated rows of a document
give one row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Words, bounded, flat_utf8, one_thread


@dataclass(frozen=True)
class LeakParams:
    """``block`` benchmark passages of ``passage`` words and ``rank`` dimensions bound what is sent to tasks (some 100 MB at most: two bytes for each word and passage)."""

    rank: int = 192
    extra: int = 16
    iterations: int = 2
    seed: int = 5
    parts: int = 8
    block: int = 1024
    step: int = 8
    short: int = 24
    long: int = 56
    passage: int = 48
    least: float = 0.8
    cover: float = 0.8
    strong: float = 0.8
    weak: float = 0.6
    answer_words: int = 6
    answer: float = 0.8

    @property
    def share(self) -> float:
        """The least share of a passage's squared length in ``weak`` of its words."""
        kept = self.weak * self.least**2
        return kept / (kept + 1 - self.weak)


def words(column: pa.Array) -> Words:
    """Words of a text column: runs of letters, digits and non-ASCII characters, lower-cased."""
    return Words(*flat_utf8(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))), letters=True)


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        match = where.get(y)
        if match:
            kept = row & match
            row = ((row + kept) | (row - kept)) & full
    return len(a) - bin(row).count("1")


@dataclass
class Passage:
    """Words of a passage and of its answer."""

    item: int
    words: np.ndarray
    answer: np.ndarray


def passages(rows: list[tuple[int, str | None, str | None]], p: LeakParams) -> list[Passage]:
    """Passages of at most ``passage`` words of each benchmark row ``(item_id, text, answer)``."""
    out = []
    texts = words(pa.array([r[1] for r in rows], pa.large_string()))
    answers = words(pa.array([r[2] for r in rows], pa.large_string()))
    for i, r in enumerate(rows):
        w = texts.hashes[texts.first[i] : texts.first[i + 1]]
        a = answers.hashes[answers.first[i] : answers.first[i + 1]]
        n = max(1, -(-len(w) // p.passage))
        cuts = np.linspace(0, len(w), n + 1).astype(int)
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e > s:
                out.append(Passage(r[0], w[s:e], a if len(a) else w[s:e][-p.answer_words :]))
    return out


class Vocabulary:
    """Sorted hashes of the benchmark's words, found by a table of their top bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        top = (self.hashes >> np.uint64(44)).astype(np.int64)
        self.top = np.full(1 << 20, -1, np.int32)
        self.top[top[::-1]] = np.arange(len(top))[::-1]
        self.alike = int(np.unique(top, return_counts=True)[1].max())

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``words`` of known words, and which words they are."""
        spot = self.top[(words >> np.uint64(44)).astype(np.int64)]
        maybe = np.flatnonzero(spot >= 0)
        spot, words = spot[maybe].astype(np.int64), words[maybe]
        same = self.hashes[spot] == words
        for k in range(1, self.alike):  # words with the same top bits stand one after the other
            other = np.flatnonzero(~same)
            at = np.minimum(spot[other] + k, len(self.hashes) - 1)
            right = self.hashes[at] == words[other]
            same[other[right]], spot[other[right]] = True, at[right]
        return maybe[same], spot[same]


def weights(docs: DataFrame, found: list[Passage], known: Vocabulary, p: LeakParams) -> np.ndarray:
    """Inverse document frequencies of the known words over all documents."""
    width = len(known.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = np.zeros(width, np.int64), 0
        for b in bounded(batches):
            w = words(b.column("text"))
            at, spot = known.find(w.hashes)
            row = np.repeat(np.arange(b.num_rows), np.diff(w.first))[at]
            few = max(1, (1 << 23) // width)
            for k in range(0, b.num_rows, few):  # a table of some documents and all words
                i, j = np.searchsorted(row, (k, k + few))
                has = np.zeros((min(few, b.num_rows - k), width), bool)
                has[row[i:j] - k, spot[i:j]] = True
                count += has.sum(0)
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(count), -1)), pa.array(np.append(count[count > 0], n))], ["k", "n"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    got = {r.k: r.n for r in counts}
    df = np.array([got.get(k, 0) for k in range(width)], np.float64)
    n = got.get(-1, 0)
    full = np.log((n + 1) / (df + 1)).clip(min=1e-3)
    return full.clip(min=p.least * full.max())


def _terms(w: np.ndarray, known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Known words of a passage and their counts."""
    return np.unique(known.find(w)[1], return_counts=True)


def _rows_of(found: list[np.ndarray], idf: np.ndarray, known: Vocabulary) -> np.ndarray:
    """Dense TF-IDF rows of passages over the known words, of unit length.

    The term frequency is the root of the count: with the count itself a repeated word outweighs many others.
    """
    a = np.zeros((len(found), len(idf)))
    for i, w in enumerate(found):
        spot, n = _terms(w, known)
        a[i, spot] = np.sqrt(n) * idf[spot]
        a[i] /= np.linalg.norm(a[i]) + 1e-12
    return a


def latent(found: list[Passage], idf: np.ndarray, known: Vocabulary, docs: DataFrame, p: LeakParams) -> np.ndarray:
    """Right singular vectors (words x rank) of the passages' TF-IDF matrix, by distributed subspace iteration."""
    width = len(idf)
    rank = min(p.rank + p.extra, len(found), width)
    table = docs.sparkSession.createDataFrame(pa.table({"words": pa.array([f.words.tobytes() for f in found], pa.binary())})).repartition(min(p.parts, len(found)))
    q = np.linalg.qr(np.random.default_rng(p.seed).standard_normal((width, rank)))[0]

    def power(q: np.ndarray, gram: bool) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_thread()
            total = np.zeros((q.shape[1] if gram else width, q.shape[1]))
            for b in batches:
                for k in range(0, b.num_rows, 64):
                    a = _rows_of([np.frombuffer(x, np.uint64) for x in b.column("words").slice(k, 64).to_pylist()], idf, known)
                    y = a @ q
                    total += y.T @ y if gram else a.T @ y
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

        parts = table.mapInArrow(run, "sum binary").toLocalIterator()
        return sum(np.frombuffer(r["sum"], np.float64).reshape(-1, q.shape[1]) for r in parts)

    for _ in range(p.iterations):
        q = np.linalg.qr(power(q, False))[0]
    values, turn = np.linalg.eigh(power(q, True))
    space = q @ turn[:, np.argsort(-values)[: min(p.rank, rank)]]
    lack = []
    for k in range(0, len(found), 64):
        a = _rows_of([f.words for f in found[k : k + 64]], idf, known)
        rest = a - (a @ space) @ space.T
        lack.append(rest[(rest**2).sum(1) > 1 - p.cover])
    missing = np.vstack(lack)
    if len(missing):
        space = np.linalg.qr(np.hstack([space, missing.T]))[0][:, : space.shape[1] + len(missing)]
    return space


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges ``[first, last)``, one after the other, and the range of each."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - (np.cumsum(n) - n - first)[of], of


def enough_words(spot: np.ndarray, first: np.ndarray, last: np.ndarray, window: np.ndarray, target: np.ndarray, terms: list[tuple[np.ndarray, np.ndarray]], need: np.ndarray, width: int) -> np.ndarray:
    """Which pairs of a window and a passage share ``need`` words, repeats counted; no common subsequence is longer.

    Window ``k`` has the words ``spot[first[k]:last[k]]``; ``window`` is sorted. Counts of at most 4 million
    windows times words are held, and the terms of at most 16384 passages.
    """
    start = np.append(0, np.cumsum([len(w) for w, _ in terms]))
    flat, count = np.concatenate([t[0] for t in terms]), np.concatenate([t[1] for t in terms]).astype(np.int16)
    nth = np.cumsum(np.append(False, window[1:] != window[:-1]))
    good = np.zeros(len(window), bool)
    s = 0
    while s < len(window):
        e = min(s + 16384, int(np.searchsorted(nth, nth[s] + max(1, (1 << 22) // width))))
        row = nth[s:e] - nth[s]
        some = window[s:e][np.append(True, row[1:] != row[:-1])]
        at, of = _ranges(first[some], last[some])
        seen = np.zeros(len(some) * width, np.int16)
        np.add.at(seen, of * width + spot[at], np.int16(1))
        term, pair = _ranges(start[target[s:e]], start[target[s:e] + 1])
        both = np.minimum(seen[row[pair] * width + flat[term]], count[term])
        good[s:e] = np.bincount(pair, weights=both, minlength=e - s) >= need[target[s:e]]
        s = e
    return good


#: 64-bit words of a signature of a set of known words.
SIGN = 16


class Signatures:
    """Bits of the known words in runs of steps: ``tables[k][i]`` are those of the ``2**k`` steps from ``i`` on."""

    def __init__(self, steps: int):
        self.tables = [np.zeros((steps, SIGN), np.uint64)]

    def add(self, step: np.ndarray, word: np.ndarray) -> None:
        """One known word at most for each step."""
        self.tables[0][step, (word >> 6) % SIGN] |= np.uint64(1) << (word & 63).astype(np.uint64)

    def close(self, longest: int) -> None:
        """Runs of up to ``longest`` steps can be asked for from now on."""
        while 2 << (len(self.tables) - 1) <= longest:
            t, half = self.tables[-1], 1 << (len(self.tables) - 1)
            up = t.copy()
            up[: len(t) - half] |= t[half:]
            self.tables.append(up)

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Signatures of the runs ``[low, high)``, none of them empty: two overlapping runs of a power of two each."""
        out = np.zeros((len(low), SIGN), np.uint64)
        power = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(power):
            at = np.flatnonzero(power == k)
            out[at] = self.tables[k][low[at]] | self.tables[k][high[at] - (1 << int(k))]
        return out


def mask_of(spot: np.ndarray) -> tuple[np.ndarray, int]:
    """The signature of distinct words, and how many of them share a bit with another."""
    mask = np.zeros(SIGN, np.uint64)
    for w in spot.tolist():
        mask[(w >> 6) % SIGN] |= np.uint64(1 << (w & 63))
    return mask, len(spot) - int(np.bitwise_count(mask).sum())


def likeness(vectors: np.ndarray, targets: np.ndarray, longest: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """For each word and passage, the part that the word adds to a window's projection on the passage; and the least sums.

    16-bit integers, rounded up, so that no window is lost; each passage has the finest scale at which
    ``longest`` words can't overflow. The last row is no word's.
    """
    square = (targets**2).sum(1)
    part = (vectors @ targets.T) / np.where(square > 0, square, 1)
    scale = 32000 / (longest * np.abs(part).max(0).clip(min=1e-6)) - 1
    out = np.zeros((len(part) + 1, len(targets)), np.int16)
    out[:-1] = np.ceil(part * scale)
    return out, np.where(square > 0, np.floor(share * scale).clip(max=32767), 32767).astype(np.int16)


def step_sums(parts: np.ndarray, slots: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of the words' parts in each step; ``slots`` has a step's words first, then the row of no word."""
    out = parts.take(slots[:, 0], axis=0)
    for k in range(1, slots.shape[1]):
        more = np.flatnonzero(count > k)
        if 2 * len(more) > len(slots):
            out += parts.take(slots[:, k], axis=0)
        elif len(more):
            out[more] += parts.take(slots[more, k], axis=0)
    return out


def run_sums(sums: np.ndarray, m: int) -> np.ndarray:
    """Sums of ``m`` rows from each row on that has so many, by powers of two."""
    n = len(sums) - m + 1
    out, at, size = np.zeros((n, sums.shape[1]), sums.dtype), 0, 1
    while True:
        if m & size:
            out += sums[at : at + n]
            at += size
        size *= 2
        if size > m:
            return out
        sums = sums[: -(size // 2)] + sums[size // 2 :]


def search(docs: DataFrame, found: list[Passage], idf: np.ndarray, known: Vocabulary, space: np.ndarray, p: LeakParams) -> DataFrame:
    """``doc_id, item_id, score``: verified hits of a block of passages in all documents."""
    vectors = (space * idf[:, None]).astype(np.float32)
    wide = np.array([len(f.words) > p.short for f in found])
    terms = [_terms(f.words, known) for f in found]
    targets = np.stack([np.sqrt(n).astype(np.float32) @ vectors[spot] for spot, n in terms])
    need = p.weak * np.array([len(f.words) for f in found]) - 1e-9
    beside = -(-p.passage // p.step)
    masks = [mask_of(spot) for spot, _ in terms]
    bits = np.stack([m for m, _ in masks])
    # So many bits a passage and the words around a window share at least: repeats in the passage and shared bits count for it.
    least = need - np.array([n.sum() - len(n) + shared for (_, n), (_, shared) in zip(terms, masks, strict=True)])
    groups = [(k, g, k // p.step, *likeness(vectors, targets[g], p.long, p.share - 1e-3)) for k, g in ((k, np.flatnonzero(wide == (k == p.long))) for k in (p.short, p.long)) if len(g)]
    width, halo = len(idf), p.long // p.step - 1
    del vectors, targets
    sent = [(f.item, f.words.tobytes(), f.answer.tobytes()) for f in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [(item, np.frombuffer(w, np.uint64), np.frombuffer(a, np.uint64)) for item, w, a in sent]
        for b in bounded(batches):
            w = words(b.column("text"))
            count = np.diff(w.first)
            steps = -(-count // p.step)
            # Steps without words follow each text, so that no window reaches into the next.
            base = np.concatenate([[0], np.cumsum(np.where(steps > 0, steps + halo, 0))])
            end = base[:-1] + steps
            row = np.repeat(np.arange(b.num_rows), count)
            live, spot = known.find(w.hashes)
            if not len(live):
                continue
            row = row[live]
            at = base[row] + (live - w.first[:-1][row]) // p.step
            full = np.bincount(at, minlength=base[-1])
            begin = np.append(0, np.cumsum(full))
            nth = np.arange(len(at)) - begin[at]
            slots = np.full((base[-1], p.step), width, np.int32)
            slots[at, nth] = spot
            signs = Signatures(base[-1])
            for k in range(p.step):
                one = nth == k
                signs.add(at[one], spot[one])
            signs.close(p.long // p.step + 2 * beside)
            holder = np.repeat(np.arange(b.num_rows), np.diff(base))
            inside = np.arange(base[-1]) < end[holder]
            hits: dict[tuple[int, int], float] = {}
            for size, group, m, parts, limit in groups:
                for s in range(0, base[-1], 8192):
                    i, t = [], []
                    for a in range(s, min(s + 8192, base[-1]), 1024):
                        e = min(a + 1024, s + 8192, base[-1])
                        if begin[min(e + m - 1, base[-1])] == begin[a]:
                            continue
                        stop = min(e + m - 1, base[-1])
                        found = np.flatnonzero(run_sums(step_sums(parts, slots[a:stop], full[a:stop]), m) >= limit)
                        i.append(a + found // len(group))
                        t.append(found % len(group))
                    if not i:
                        continue
                    i, t = np.concatenate(i), np.concatenate(t)
                    i, t = i[inside[i]], group[t[inside[i]]]
                    if not len(i):
                        continue
                    first = np.append(True, i[1:] != i[:-1])
                    some, i = i[first], np.cumsum(first) - 1
                    # What is around a window, as in the verification, in whole steps.
                    low = np.maximum(some - beside, base[holder[some]])
                    high = np.minimum(some + m + beside, end[holder[some]])
                    around_signs = signs.of(low, high)
                    shared = np.zeros(len(i), bool)
                    for q in range(0, len(i), 1 << 15):
                        part = slice(q, q + (1 << 15))
                        shared[part] = np.bitwise_count(around_signs[i[part]] & bits[t[part]]).sum(1) >= least[t[part]]
                    i, t = i[shared], t[shared]
                    if not len(i):
                        continue
                    likely = enough_words(spot, begin[low], begin[high], i, t, terms, need, width)
                    for i, t in zip(i[likely], t[likely], strict=True):
                        r = int(holder[some[i]])
                        item, passage, answer = texts[t]
                        if hits.get((r, item), 0.0) >= p.strong:
                            continue
                        start = w.first[r] + (some[i] - base[r]) * p.step
                        around = w.hashes[max(w.first[r], start - len(passage)) : min(w.first[r + 1], start + size + len(passage))]
                        share = common_length(passage, around) / len(passage)
                        if share >= p.strong or (share >= p.weak and common_length(answer, around) >= p.answer * len(answer)):
                            hits[r, item] = max(share, hits.get((r, item), 0.0))
            if hits:
                ids = b.column("doc_id")
                keys = sorted(hits)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([k[0] for k in keys])), pa.array([k[1] for k in keys], pa.int64()), pa.array([hits[k] for k in keys], pa.float64())], ["doc_id", "item_id", "score"])

    return docs.mapInArrow(run, "doc_id long, item_id long, score double")


def find_leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """``doc_id, item_id, score`` for each document that holds a benchmark item; score is the share found.

    Benchmark passages are taken in blocks of ``block``; each block is one pass over the documents.
    """
    p = params
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
    parts: list[DataFrame] = []

    def add(found: list[Passage]) -> None:
        known = Vocabulary(np.concatenate([f.words for f in found]))
        idf = weights(docs, found, known, p)
        parts.append(search(docs, found, idf, known, latent(found, idf, known, docs, p), p))

    block: list[Passage] = []
    for r in rows.toLocalIterator():
        block += passages([(r.item_id, r.text, r.answer)], p)
        while len(block) >= p.block:
            add(block[: p.block])
            block = block[p.block :]
    if block:
        add(block)
    if not parts:
        return docs.where("false").select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("score"))
    hits = parts[0]
    for h in parts[1:]:
        hits = hits.unionByName(h)
    return hits.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))
