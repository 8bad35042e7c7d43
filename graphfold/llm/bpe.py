"""Byte-pair encoding by speculation: propose the greedy longest match, verify it, merge only what fails.

A segmentation into tokens is what the merges give exactly if each token is, alone, encoded as itself
and each adjacent pair, alone, is encoded as that pair. So a proposal is verified by checking its pairs,
all pairs of all words at once.
"""

from __future__ import annotations

import heapq
import json
import re

import ahocorasick
import numpy as np
import regex
#: Unicode's white space, as the tokenizer's pattern takes \s.
SPACE = "\t-\r \x85\xa0  -     　"
#: The tokenizer's pattern.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Coarser than the pattern, which never matches across a border of these.
CHUNKS = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_SEPARATOR = "￿"
#: Bytes up to which a word is merged by scanning its pairs; beyond, by a heap.
SHORT = 120


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary file: itself if it can be printed, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(spare)) for b in range(256)}


class Vocabulary:
    """The merges of a byte-level BPE vocabulary file, and which of its tokens stand alone."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        number = content["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        raw = {letter: byte for byte, letter in byte_letters().items()}
        self.size = max([*number.values(), *self.special.values()]) + 1
        self.bytes = [b""] * self.size
        for token, i in number.items():
            self.bytes[i] = bytes(raw[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = [number[byte_letters()[b]] for b in range(256)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
        left, right, made = (np.array([number[f(m)] for m in merges], np.int64) for f in (lambda m: m[0], lambda m: m[1], lambda m: m[0] + m[1]))
        # Ranks take the place of ids: a byte has rank -1, merge k has rank k.
        self.rank = np.full(self.size, -1, np.int64)
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        first = np.unique(made, return_index=True)[1]
        self.rank[made[first]], self.left[made[first]], self.right[made[first]] = first, left[first], right[first]
        self.rank_of = {pair: k for k, pair in enumerate(zip(left.tolist(), right.tolist(), strict=True))}
        self.made = made.tolist()
        key = left * self.size + right
        order = np.argsort(key)
        self.pair_keys, self.pair_ranks = key[order], np.arange(len(merges))[order]
        self.widths = np.fromiter(map(len, self.bytes), np.int64, self.size)
        self.alone = self._alone()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i in np.flatnonzero(self.alone):
            if self.bytes[i]:
                self.automaton.add_word(self.bytes[i].decode("latin-1"), int(i))
        self.automaton.make_automaton()

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, beyond all ranks where there is none."""
        none = len(self.pair_keys)
        if not none:
            return np.full(len(a), none)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), none - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], none)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge across the border of a and b comes before those that make a and b.

        Both tokens are taken apart along the border, the later merge first. At each state the two
        that meet there would merge unless something that came earlier has used one of them up; limit
        is the rank of that. before: merges from this rank on don't count.
        """
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        good = np.ones(len(a), bool)
        limit = np.full(len(a), len(self.pair_keys)) if before is None else np.array(before, np.int64)
        # A merge on the left of the border that ties in rank with one across it happens first.
        on = np.arange(len(a))
        while len(on):
            x, y, most = a[on], b[on], limit[on]
            broken = self.pair_rank(x, y) < most
            good[on[broken]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            done = broken | ((rank_x < 0) & (rank_y < 0))
            take_x = rank_x > rank_y
            limit[on] = np.where(take_x, rank_x, rank_y + 1)
            a[on] = np.where(take_x, self.right[x], x)
            b[on] = np.where(take_x, y, self.left[y])
            on = on[~done]
        return good

    def _alone(self) -> np.ndarray:
        """Which tokens their own bytes are encoded as; no proposal uses any other."""
        made = self.rank >= 0
        alone = np.array([len(x) == 1 for x in self.bytes]) & ~made
        ids = np.flatnonzero(made)
        fits = np.zeros(self.size, bool)
        fits[ids] = self.compatible(self.left[ids], self.right[ids], before=self.rank[ids])
        for i in ids[np.argsort(self.rank[ids])]:
            alone[i] = fits[i] and alone[self.left[i]] and alone[self.right[i]]
        return alone

    def exact(self, word: bytes) -> list[int]:
        """The merges themselves, earliest rank first and leftmost among equals."""
        token = [self.of_byte[b] for b in word]
        return self._by_scan(token) if len(token) <= SHORT else self._by_heap(token)

    def _by_scan(self, token: list[int]) -> list[int]:
        rank, made, none = self.rank_of, self.made, len(self.made)
        ranks = [rank.get(pair, none) for pair in zip(token, token[1:], strict=False)] + [none]
        while (least := min(ranks)) < none:
            i = ranks.index(least)
            token[i : i + 2] = [made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((token[i - 1], token[i]), none)
            if i + 1 < len(token):
                ranks[i] = rank.get((token[i], token[i + 1]), none)
            else:
                ranks[i] = none
        return token

    def _by_heap(self, token: list[int]) -> list[int]:
        """A heap of merges over a linked list of tokens: n log n for n bytes."""
        after, before = [*range(1, len(token)), -1], [-1, *range(len(token) - 1)]
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (found := self.rank_of.get((token[i], token[after[i]]))) is not None:
                heapq.heappush(heap, (found, i, token[i], token[after[i]]))

        for i in range(len(token)):
            offer(i)
        while heap:
            found, i, x, y = heapq.heappop(heap)
            j = after[i] if token[i] == x else -1
            if j < 0 or token[j] != y:
                continue
            token[i], token[j], after[i] = self.made[found], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [t for t in token if t >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """The ids of all words one after the other, the number of each word's ids, and how many words were merged exactly."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        text = _SEPARATOR.join(w.decode("latin-1") for w in words) + _SEPARATOR
        found = np.array(list(self.automaton.iter_long(text)), np.int64).reshape(-1, 2)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        last = np.cumsum(sizes + 1) - 1
        of = np.searchsorted(last, found[:, 0])
        ids = found[:, 1]
        good = np.bincount(of, self.widths[ids], len(words)) == sizes  # the proposal covers the word
        near = np.flatnonzero(of[1:] == of[:-1])
        pairs, back = np.unique(ids[near] * self.size + ids[near + 1], return_inverse=True)
        bad = ~self.compatible(pairs // self.size, pairs % self.size)[back]
        good[of[near[bad]]] = False
        count = np.bincount(of, minlength=len(words))
        failed = np.flatnonzero(~good)
        if len(failed):
            redone = [self.exact(words[i]) for i in failed]
            stays = good[of]
            owner = np.concatenate([of[stays], np.repeat(failed, [len(r) for r in redone])])
            ids = np.concatenate([ids[stays], np.array([t for r in redone for t in r], np.int64)])
            ids = ids[np.argsort(owner, kind="stable")]
            count[failed] = [len(r) for r in redone]
        return ids, count, len(failed)
