"""Token ids of whole texts with the tokenizers library, one encoding per distinct piece.

Byte-level BPE never merges across the pieces of its pre-tokeniser, so a text's ids
are the ids of its pieces in order. Each Python worker keeps the ids of the pieces
it has met, up to a bound. All texts of a batch are cut, looked up and put together
at once: the cuts equal the pre-tokeniser's on ASCII and Latin letters, and a piece is
known by its bytes, never by a hash alone. A text with any other character, or with
a special token's string, is given to the library whole.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm.common import flat_utf8, mix, ranges

#: The pre-tokeniser's classes on U+0000-007F; bytes from 0x80 on are letters in the texts that are cut here.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT

#: Byte-level vocabularies write printable Latin-1 bytes as they are, and the others, in order, as U+0100 and on.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_WRITTEN = np.arange(256, dtype="<u4")
_WRITTEN[[b for b in range(0x100) if b not in _PRINTED]] = np.arange(0x100, 0x200 - len(_PRINTED))

#: Pieces that a worker keeps, and ids of theirs.
MOST_PIECES = 400_000
MOST_IDS = 8_000_000

#: Bytes of a piece that fit its two 64-bit keys, beside its length.
_SHORT = 15
_FIRST = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(_SHORT + 1)], np.uint64)
_SECOND = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(_SHORT + 1)], np.uint64)

_workers: dict[str, Encoder] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a vocabulary file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def unusual(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have a character beyond ASCII and the letters of U+00C0-017E."""
    out = np.zeros(len(offsets) - 1, bool)
    at = np.flatnonzero(flat >= 0xC0)
    lead, rest = flat[at], flat[at + 1]
    odd = (lead < 0xC3) | (lead > 0xC5) | ((lead == 0xC3) & ((rest == 0x97) | (rest == 0xB7))) | ((lead == 0xC5) & (rest == 0xBF))
    out[np.searchsorted(offsets, at[odd], side="right") - 1] = True
    return out


def cuts(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokeniser's pieces begin: contractions, runs of a kind with a blank before them, white space."""
    n = len(flat)
    head = np.zeros(n + 3, bool)
    head[offsets] = True
    head[n:] = True
    kind = _KIND[flat]
    begin = np.empty(n + 3, bool)
    begin[0] = True
    begin[1:n] = kind[1:] != kind[:-1]
    # The last of some white space is a piece of its own, or a blank that belongs to what follows.
    after = np.flatnonzero(begin[1:n] & (kind[:-1] == _SPACE) & ~head[1:n]) + 1
    begin[after - 1] = True
    begin[after] = flat[after - 1] != 0x20
    begin |= head
    sign = np.flatnonzero(flat == 0x27)
    sign = sign[begin[sign] & ~head[sign + 1]]
    if len(sign):
        a, b = flat[sign + 1], flat[np.minimum(sign + 2, n - 1)]
        one = (a == 0x73) | (a == 0x74) | (a == 0x6D) | (a == 0x64)
        two = ~head[sign + 2] & (((b == 0x65) & ((a == 0x72) | (a == 0x76))) | ((a == 0x6C) & (b == 0x6C)))
        begin[sign[one | two] + 1] = False
        begin[sign[one] + 2] = True
        begin[sign[two] + 3] = True
    return np.flatnonzero(begin[:n])


class Encoder:
    """Encoder of one vocabulary file.

    The pieces met are numbered; piece ``k`` has ``count[k]`` ids from ``ids[first[k]]`` on. Short ones are
    found in an open table of their bytes and lengths, the others in a dictionary.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = Tokenizer.from_file(path).model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # no word comes twice
        self.most = MOST_PIECES
        self.n, self.n_ids = 0, 0
        self.keys = np.zeros((2, self.most), np.uint64)
        self.first, self.count = np.zeros(self.most, np.int64), np.zeros(self.most, np.int64)
        self.ids = np.zeros(1 << 16, np.int32)
        self.long: dict[bytes, int] = {}
        self._empty_table()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's encoder for this file."""
        if path not in _workers:
            _workers[path] = cls(path)
        return _workers[path]

    def _empty_table(self) -> None:
        self.slots = np.uint64((1 << (2 * self.most - 1).bit_length()) - 1)
        self.table = np.full(int(self.slots) + 1, -1, np.int32)
        self.low, self.high = np.zeros(len(self.table), np.uint64), np.zeros(len(self.table), np.uint64)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ (high * np.uint64(0x9E3779B97F4A7C15))) & self.slots).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Numbers of short pieces, -1 for those not met."""
        slot = self._slot(low, high)
        out = self.table[slot]
        left = np.flatnonzero((self.low[slot] != low) | (self.high[slot] != high))
        left = left[out[left] >= 0]
        out[(self.high[slot] != high) | (self.low[slot] != low)] = -1
        slot = slot[left]
        while len(left):  # taken by another piece: the next slot
            slot = (slot + 1) & int(self.slots)
            same = (self.low[slot] == low[left]) & (self.high[slot] == high[left])
            out[left[same]] = self.table[slot[same]]
            on = ~same & (self.table[slot] >= 0)
            left, slot = left[on], slot[on]
        return out

    def _put(self, number: np.ndarray) -> None:
        """Enter short pieces, none of them there yet."""
        low, high = self.keys[0, number], self.keys[1, number]
        slot = self._slot(low, high)
        while len(number):
            free = self.table[slot] < 0
            self.table[slot[free]] = number[free]
            done = self.table[slot] == number
            self.low[slot[done]], self.high[slot[done]] = low[done], high[done]
            number, low, high, slot = number[~done], low[~done], high[~done], (slot[~done] + 1) & int(self.slots)

    def _make_room(self, new: int) -> None:
        """Forget the pieces met last where there are too many: those met first are the frequent ones."""
        if self.n + new > self.most or self.n_ids > MOST_IDS:
            ends = self.first[: self.n] + self.count[: self.n]
            self.n = min(self.n, self.most // 2, int(np.searchsorted(ends, MOST_IDS // 2, side="right")))
            self.n_ids = int(ends[self.n - 1]) if self.n else 0
            self.ids = self.ids[: max(self.n_ids, 1)].copy()
            self.long = {p: k for p, k in self.long.items() if k < self.n}
            self._empty_table()
            self._put(np.flatnonzero(self.keys[1, : self.n]))

    def _learn(self, pieces: list[bytes], keys: np.ndarray) -> None:
        """Encode new pieces: each is one word of the library's model, its bytes written as the vocabulary writes them."""
        written = _WRITTEN[np.frombuffer(b"".join(pieces), np.uint8)].tobytes().decode("utf-32-le")
        ends = list(itertools.accumulate(map(len, pieces)))
        tokens = [self.model.tokenize(written[i:j]) for i, j in zip([0, *ends], ends)]
        count = list(map(len, tokens))
        found = [t.id for word in tokens for t in word]
        stop = self.n + len(pieces)
        if self.n_ids + len(found) > len(self.ids):
            self.ids = np.append(self.ids[: self.n_ids], np.zeros(self.n_ids + 2 * len(found), np.int32))
        self.ids[self.n_ids : self.n_ids + len(found)] = found
        self.count[self.n : stop] = count
        self.first[self.n : stop] = self.n_ids + np.cumsum(count) - count
        self.keys[:, self.n : stop] = keys
        self.long.update((p, self.n + int(k)) for k in np.flatnonzero(keys[1] == 0) for p in [pieces[k]])
        self._put(self.n + np.flatnonzero(keys[1]))
        self.n, self.n_ids = stop, self.n_ids + len(found)

    def _numbers(self, body: bytes, eights: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Numbers of the pieces ``body[begin : begin + length]``, at most half as many as are kept; new ones are learnt."""
        short = length <= _SHORT
        size = np.where(short, length, 0)
        low = eights[begin] & _FIRST[size]
        high = (eights[begin + 8] & _SECOND[size]) | (size.astype(np.uint64) << np.uint64(56))
        out = self._find(low, high)
        far = np.flatnonzero(~short)
        if len(far):
            out[far] = [self.long.get(body[i:j], -1) for i, j in zip(begin[far].tolist(), (begin + length)[far].tolist(), strict=True)]
        new = np.flatnonzero(out < 0)
        if len(new):
            names = [body[i:j] for i, j in zip(begin[new].tolist(), (begin + length)[new].tolist(), strict=True)]
            fresh: dict[bytes, int] = {}
            which = np.array([fresh.setdefault(p, len(fresh)) for p in names])
            at = np.zeros(len(fresh), np.int64)
            at[which] = new
            before = self.n
            self._make_room(len(fresh))
            if self.n < before:  # some that were found may be gone
                return self._numbers(body, eights, begin, length)
            self._learn(list(fresh), np.stack([low[at], high[at]]))
            out[new] = before + which
        return out

    def encode_column(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string column, one after the other, and their number in each; ``end_id`` closes each text."""
        ids, counts = self._texts(column)
        if end_id is None:
            return ids, counts
        out = np.full(len(ids) + len(counts), end_id, np.int32)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(counts + 1) - 1] = False
        out[inside] = ids
        return out, counts + 1

    def _texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = pc.fill_null(column.cast(pa.large_string()), "")
        flat, offsets = flat_utf8(column)
        whole = unusual(flat, offsets)
        for s in self.specials:
            whole |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._plain(flat, offsets)
        ids, n = self._plain(*flat_utf8(column.filter(pa.array(~whole))))
        other = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32) for t in column.filter(pa.array(whole)).to_pylist()]
        counts = np.zeros(len(whole), np.int64)
        counts[~whole], counts[whole] = n, [len(x) for x in other]
        out = np.empty(counts.sum(), np.int32)
        of_whole = np.repeat(whole, counts)
        out[~of_whole], out[of_whole] = ids, np.concatenate(other)
        return out, counts

    def _plain(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``_texts`` for the bytes of texts that can be cut here; pieces are looked up in groups of bounded size."""
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        begin = cuts(flat, offsets)
        length = np.diff(begin, append=len(flat))
        body = flat.tobytes() + bytes(16)
        eights = np.ndarray(len(flat) + 9, "<u8", body, strides=1)
        found, count = [], []
        most = max(1, self.most // 2)
        for k in range(0, len(begin), most):
            number = self._numbers(body, eights, begin[k : k + most], length[k : k + most])
            n = self.count[number]
            found.append(self.ids[ranges(self.first[number], n)])
            count.append(n)
        before = np.append(0, np.cumsum(np.concatenate(count)))
        return np.concatenate(found), np.diff(before[np.searchsorted(begin, offsets)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text, its ids as little-endian 32-bit integers."""
        ids, counts = self.encode_column(pa.array(texts, pa.large_string()))
        ends = np.cumsum(counts)
        return [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends, counts, strict=True)]
