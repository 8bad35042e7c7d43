"""All segmentations of words into the pieces of a fixed vocabulary, held as edges for vectorised dynamic programs."""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import numpy as np

#: Stands before each word, as in the vocabularies.
MARK = "▁"
#: A word of more characters is gone through in blocks of so many.
BLOCK = 100_000


@dataclass
class Lattice:
    """Edges over the characters of many words.

    Node numbers run through all words: word w owns the nodes first[w] .. last[w]. An edge goes from
    node start to node end and carries a piece number, or UNKNOWN for a character that is no piece.
    Edges are sorted by their end's place in its word, then by end, then by start.
    """

    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    steps: np.ndarray  # where the edges of each place begin
    first: np.ndarray
    last: np.ndarray
    chars: str  # the characters, node by node; a separator at each word's last node


class PieceMatcher:
    """Finds every occurrence of every piece with one Aho-Corasick automaton."""

    UNKNOWN = -1

    def __init__(self, pieces: list[str]) -> None:
        self.lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, piece in enumerate(pieces):
            self.automaton.add_word(piece, number)
        self.automaton.make_automaton()

    def lattice(self, words: list[str]) -> Lattice:
        """words: none empty, none with a line feed."""
        chars = "\n".join(words) + "\n"
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        last = np.cumsum(sizes + 1) - 1
        first = last - sizes
        found = list(self.automaton.iter(chars))
        match = np.array(found, np.int64).reshape(-1, 2)
        end, piece = match[:, 0] + 1, match[:, 1]
        size = self.lengths[piece]
        known = np.zeros(len(chars), bool)
        known[end[size == 1] - 1] = True
        known[last] = True
        lone = np.flatnonzero(~known)
        start = np.concatenate([end - size, lone])
        end = np.concatenate([end, lone + 1])
        piece = np.concatenate([piece, np.full(len(lone), self.UNKNOWN)])
        place = end - np.repeat(first, sizes + 1)[end]
        order = np.lexsort((start, end, place))
        start, end, piece, place = start[order], end[order], piece[order], place[order]
        steps = np.searchsorted(place, np.arange(1, (int(sizes.max()) if len(words) else 0) + 2))
        return Lattice(start, end, piece, steps, first, last, chars)


def groups(targets: np.ndarray) -> np.ndarray:
    """Where each run of equal targets begins."""
    return np.flatnonzero(np.concatenate([[True], targets[1:] != targets[:-1]]))


def weights(lattice: Lattice, log_p: np.ndarray, log_unknown: np.ndarray) -> np.ndarray:
    """Each edge's log probabilities, a column for each model. log_p: a row for each piece."""
    return np.vstack([log_p, log_unknown[None, :]])[lattice.piece]  # UNKNOWN, -1, is the last row


def forward(lattice: Lattice, weight: np.ndarray) -> np.ndarray:
    """log of the sum over all segmentations up to each node. weight: a row of columns, or one number, for each edge."""
    alpha = np.full((len(lattice.chars), *weight.shape[1:]), -np.inf)
    alpha[lattice.first] = 0.0
    for a, b in zip(lattice.steps[:-1], lattice.steps[1:], strict=True):
        if a < b:
            end = lattice.end[a:b]
            begin = groups(end)
            alpha[end[begin]] = np.logaddexp.reduceat(alpha[lattice.start[a:b]] + weight[a:b], begin, axis=0)
    return alpha


def backward(lattice: Lattice, weight: np.ndarray) -> np.ndarray:
    """log of the sum over all segmentations from each node to its word's end."""
    beta = np.full((len(lattice.chars), *weight.shape[1:]), -np.inf)
    beta[lattice.last] = 0.0
    base = np.repeat(lattice.last, lattice.last - lattice.first + 1)
    away = base[lattice.start] - lattice.start
    order = np.lexsort((lattice.end, lattice.start, away))
    start, end, weight, away = lattice.start[order], lattice.end[order], weight[order], away[order]
    steps = np.searchsorted(away, np.arange(1, int(away.max(initial=0)) + 2))
    for a, b in zip(steps[:-1], steps[1:], strict=True):
        if a < b:
            begin = groups(start[a:b])
            beta[start[a:b][begin]] = np.logaddexp.reduceat(beta[end[a:b]] + weight[a:b], begin, axis=0)
    return beta


def expected(lattice: Lattice, weight: np.ndarray) -> np.ndarray:
    """How often each edge is used on average over its word's segmentations. weight: one number for each edge."""
    alpha, beta = forward(lattice, weight), backward(lattice, weight)
    whole = alpha[lattice.last[np.searchsorted(lattice.last, lattice.start)]]
    return np.exp(alpha[lattice.start] + weight + beta[lattice.end] - whole)


def best_paths(lattice: Lattice, score: np.ndarray, unknown_score: float, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The best score and the number of its pieces at each node. Only these go along, no back pointers.

    Ties go to the path whose last piece begins first, as a tokenizer does that walks over the starts
    in order and replaces a path only by a strictly better one. An unknown character counts as its
    bytes. known: what the first nodes have, of a lattice of one word that goes on from there.
    """
    table = np.append(score, unknown_score)
    best = np.full(len(lattice.chars), -np.inf)
    count = np.zeros(len(lattice.chars), np.int64)
    best[lattice.first] = 0.0
    skip = 0
    if known is not None:
        skip = len(known[0]) - 1
        best[: skip + 1], count[: skip + 1] = known
    points = np.frombuffer(lattice.chars.encode("utf-32-le", "surrogatepass"), np.uint32)
    widths = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    for a, b in zip(lattice.steps[skip:-1], lattice.steps[skip + 1 :], strict=True):
        if a < b:
            start, end, piece = lattice.start[a:b], lattice.end[a:b], lattice.piece[a:b]
            candidate = best[start] + table[piece]
            begin = groups(end)
            most = np.maximum.reduceat(candidate, begin)
            width = np.diff(np.append(begin, len(end)))
            place = np.where(candidate == np.repeat(most, width), np.arange(len(end)), len(end))
            winner = np.minimum.reduceat(place, begin)
            best[end[begin]] = most
            count[end[begin]] = count[start[winner]] + np.where(piece[winner] < 0, widths[start[winner]], 1)
    return best, count


def best_counts(matcher: PieceMatcher, words: list[str], score: np.ndarray, unknown_score: float) -> list[int]:
    """Pieces of each word's best segmentation. What a word takes is bounded: a long one goes through block by block."""
    out = np.zeros(len(words), np.int64)
    short = [i for i, w in enumerate(words) if len(w) <= BLOCK]
    if short:
        lattice = matcher.lattice([words[i] for i in short])
        out[short] = best_paths(lattice, score, unknown_score)[1][lattice.last]
    reach = int(matcher.lengths.max(initial=1))
    for i in (i for i, w in enumerate(words) if len(w) > BLOCK):
        word, done, known = words[i], 0, (np.zeros(1), np.zeros(1, np.int64))
        while done < len(word):
            begin = done - len(known[0]) + 1
            end = min(len(word), done + BLOCK)
            best, count = best_paths(matcher.lattice([word[begin:end]]), score, unknown_score, known)
            known = best[: end - begin + 1][-reach - 1 :], count[: end - begin + 1][-reach - 1 :]
            done = end
        out[i] = known[1][-1]
    return out.tolist()
