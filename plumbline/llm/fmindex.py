"""A compressed full-text index over sequences of word codes.

The Burrows-Wheeler transform of the texts is held as a wavelet matrix of packed bits with a rank directory: one and a half bits per word
for each bit of the alphabet's size. Every ``SAMPLE``-th text position is kept; the others are found by walking the transform. Nothing
else of the texts is kept: patterns are counted by backward search and located by the walk. All steps work on whole batches at once.
"""

from __future__ import annotations

import io

import numpy as np

#: One text position of so many is kept.
SAMPLE = 4


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, words: np.ndarray, before: np.ndarray) -> None:
        self.words, self.before = words, before

    @classmethod
    def pack(cls, flags: np.ndarray) -> Bits:
        padded = np.zeros(-(-(len(flags) + 1) // 64) * 64, np.uint8)
        padded[: len(flags)] = flags
        words = np.packbits(padded, bitorder="little").view(np.uint64)
        return cls(words, np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1].astype(np.uint32))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class FMIndex:
    """Index of distinct texts given as one flat array of codes with offsets."""

    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        self.alphabet, self.starts, self.size = parts["alphabet"], parts["starts"], int(parts["size"])
        self.levels = [Bits(parts[f"w{k}"], parts[f"r{k}"]) for k in range(int(parts["depth"]))]
        self.zeros, self.shift = parts["zeros"], parts["shift"]
        self.marks, self.kept = Bits(parts["mark_w"], parts["mark_r"]), parts["kept"]
        self.parts = parts

    @classmethod
    def build(cls, flat: np.ndarray, offsets: np.ndarray) -> FMIndex:
        lengths = np.diff(offsets)
        n_texts, size = len(lengths), len(flat) + len(lengths)
        alphabet, codes = np.unique(flat, return_inverse=True)
        text = np.zeros(size, np.int64)  # 0 closes every text
        text[np.arange(len(flat)) + np.repeat(np.arange(n_texts), lengths)] = codes + 1
        order = _sorted_rotations(text)
        bwt = text[order - 1]
        first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(alphabet) + 1))))[:-1]
        depth = max(1, int(len(alphabet)).bit_length())
        parts: dict[str, np.ndarray] = {}
        symbols, zeros, at = bwt, [], np.zeros(len(alphabet) + 1, np.int64)
        every = np.arange(len(alphabet) + 1)
        for k in range(depth):
            flag = (symbols >> (depth - 1 - k)) & 1 == 1
            bits = Bits.pack(flag)
            parts[f"w{k}"], parts[f"r{k}"] = bits.words, bits.before
            zeros.append(int(size - flag.sum()))
            symbols = np.concatenate((symbols[~flag], symbols[flag]))
            ones, up = bits.rank(at), (every >> (depth - 1 - k)) & 1 == 1
            at = np.where(up, zeros[-1] + ones, at - ones)  # where the block of each symbol begins on the next level
        sampled = order % SAMPLE == 0
        marks = Bits.pack(sampled)
        parts |= {
            "alphabet": alphabet, "starts": (offsets[:-1] + np.arange(n_texts)).astype(np.uint32), "size": np.array(size), "depth": np.array(depth), "zeros": np.array(zeros),
            "shift": first - at, "mark_w": marks.words, "mark_r": marks.before, "kept": order[sampled].astype(np.uint32),
        }
        return cls(parts)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.parts)
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> FMIndex:
        with np.load(io.BytesIO(blob)) as parts:
            return cls(dict(parts))

    def encode(self, flat: np.ndarray) -> np.ndarray:
        """Codes of this index; -1 for a word that no text has."""
        if not len(self.alphabet):
            return np.full(len(flat), -1, np.int64)
        i = np.minimum(np.searchsorted(self.alphabet, flat), len(self.alphabet) - 1)
        return np.where(self.alphabet[i] == flat, i + 1, -1)

    def _step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows that begin with ``symbol`` and go on as a row before ``row``, and rows of smaller symbols."""
        depth = len(self.levels)
        for k, bits in enumerate(self.levels):
            ones = bits.rank(row)
            row = np.where((symbol >> (depth - 1 - k)) & 1 == 1, self.zeros[k] + ones, row - ones)
        return self.shift[symbol] + row

    def _back(self, row: np.ndarray) -> np.ndarray:
        """The row of the text one word before."""
        symbol = np.zeros_like(row)
        for k, bits in enumerate(self.levels):
            one, ones = bits.get(row), bits.rank(row)
            symbol = symbol * 2 + one
            row = np.where(one, self.zeros[k] + ones, row - ones)
        return self.shift[symbol] + row

    def search(self, codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of the patterns ``codes[first:last]``: the range of rows of each; empty (lo >= hi) where it does not occur."""
        lo, hi = np.zeros(len(first), np.int64), np.full(len(first), self.size, np.int64)
        live = np.flatnonzero(last > first)
        hi[last <= first] = 0
        pos = last[live] - 1
        while len(live):
            c = codes[pos]
            known = c > 0
            hi[live[~known]] = lo[live[~known]]
            live, pos, c = live[known], pos[known], c[known]
            both = self._step(np.concatenate((c, c)), np.concatenate((lo[live], hi[live])))
            lo[live], hi[live] = both[: len(live)], both[len(live) :]
            on = (hi[live] > lo[live]) & (pos > first[live])
            live, pos = live[on], pos[on] - 1
        return lo, hi

    def locate(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text number and word position of rows."""
        at, open_, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        row = rows
        while len(open_):
            there = self.marks.get(row)
            at[open_[there]] = self.kept[self.marks.rank(row[there])].astype(np.int64) + steps
            open_, row = open_[~there], self._back(row[~there])
            steps += 1
        text = np.searchsorted(self.starts, at, side="right") - 1
        return text, at - self.starts[text].astype(np.int64)


def _sorted_rotations(text: np.ndarray) -> np.ndarray:
    """The order of all rotations, by prefix doubling; distinct texts make all rotations different."""
    rank, k = text, 1
    order = np.argsort(rank, kind="stable")
    while k < 2 * len(text):
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -k)
        order = np.argsort(key, kind="stable")
        k *= 2
        ordered = key[order]
        new = np.empty_like(rank)
        new[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = new
        if rank[order[-1]] == len(text) - 1:
            break
    return order
