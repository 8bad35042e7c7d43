"""What is known of words, kept between batches: each distinct word is worked out once, and looked up in bulk."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slabs(texts: pa.Array, limit: int = 2_000_000) -> Iterator[pa.Array]:
    """A string array in slices of about so many bytes, an empty text for null."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    cuts = np.unique(np.append(np.flatnonzero(np.diff(ends // limit)) + 1, len(texts)))
    for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
        yield texts.slice(a, b - a)


def split(texts: pa.Array, at: str) -> tuple[pa.Array, np.ndarray]:
    """The parts of all texts between single characters, and where each text's begin; an empty text has one empty part."""
    parts = pc.split_pattern(texts, at)
    offsets = parts.offsets.to_numpy()
    return parts.flatten(), offsets - offsets[0]


#: Bytes that a word takes in a table besides its own.
OVERHEAD = 150
#: Bytes of words that are worked out at once, so that what a word is worked out with stays small.
PORTION = 20_000


class WordTable:
    """Rows of numbers for words. A subclass says in learn() what a word's row holds.

    keep bounds the table in bytes, as words may be of any length: where a script sets no spaces, a whole
    text is one. A table that is full is emptied. What one call looks up is held until the next.
    """

    #: Bytes that a row takes for each byte of its word.
    weight = 2

    def __init__(self, keep: int) -> None:
        self.keep = keep
        self.place: dict[str, int] = {}
        self.held = 0

    def learn(self, words: list[str]) -> None:
        """Append a row for each word, none of which is known."""
        raise NotImplementedError

    def forget(self) -> None:
        """Drop all rows, so that memory stays bounded."""
        raise NotImplementedError

    def rows(self, words: pa.Array) -> np.ndarray:
        """The row number of each word, valid until the next call."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        sizes = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.fromiter(map(self.place.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(at < 0)
        cost = lambda: self.weight * int(sizes[new].sum()) + OVERHEAD * len(new)
        if self.place and self.held + cost() > self.keep:
            self.place, self.held = {}, 0
            self.forget()
            new = np.arange(len(distinct))
        self.held += cost()
        known, words = len(self.place), [distinct[i] for i in new.tolist()]
        ends = np.cumsum(sizes[new])
        cuts = np.unique(np.append(np.flatnonzero(np.diff(ends // PORTION)) + 1, len(new))).tolist()
        for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
            if a < b:
                self.learn(words[a:b])
                self.place.update(zip(words[a:b], range(known + a, known + b), strict=True))
        at[new] = known + np.arange(len(new))
        return at[coded.indices.to_numpy()]


class NumberTable(WordTable):
    """Each word's row is one vector; texts get the sums over their words."""

    def __init__(self, width: int, keep: int = 40_000_000) -> None:
        super().__init__(keep)
        self.width = width
        self.forget()

    def forget(self) -> None:
        self.values, self.used = np.zeros((1 << 12, self.width)), 0

    def append(self, rows: np.ndarray) -> None:
        if self.used + len(rows) > len(self.values):
            grown = np.zeros((2 * (self.used + len(rows)), self.width))
            grown[: self.used] = self.values[: self.used]
            self.values = grown
        self.values[self.used : self.used + len(rows)] = rows
        self.used += len(rows)

    def sums(self, words: pa.Array, offsets: np.ndarray) -> np.ndarray:
        """offsets: where each text's words begin, and the end of the last."""
        out = np.zeros((len(offsets) - 1, self.width))
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            rows = self.rows(words)
            out[full] = np.add.reduceat(self.values[rows], offsets[full], axis=0)
        return out


class IdTable(WordTable):
    """Each word's row is a run of token ids; texts get the runs of their words one after the other."""

    weight = 6  # a byte is an id of four bytes at most

    def __init__(self, keep: int = 40_000_000) -> None:
        super().__init__(keep)
        self.forget()

    def forget(self) -> None:
        self.ids, self.used = np.zeros(1 << 14, np.uint32), 0
        self.start, self.count, self.words = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def append(self, ids: np.ndarray, counts: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(ids), np.uint32)])
        if self.words + len(counts) > len(self.start):
            more = np.zeros(self.words + 2 * len(counts), np.int64)
            self.start, self.count = np.concatenate([self.start[: self.words], more]), np.concatenate([self.count[: self.words], more])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[self.words : self.words + len(counts)] = self.used + np.cumsum(counts) - counts
        self.count[self.words : self.words + len(counts)] = counts
        self.used, self.words = self.used + len(ids), self.words + len(counts)

    def gather(self, words: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin."""
        rows = self.rows(words)
        counts = self.count[rows]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.start[rows] - ends + counts, counts) + np.arange(total)]
        return ids, np.append(0, ends)[offsets]
