"""Token counts of a unigram tokenizer, without its tokens: a Viterbi pass that carries scores and counts only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphfold.llm.common import map_batches, publish, published, resident, two_columns
from graphfold.llm.lattice import MARK, PieceMatcher, best_counts
from graphfold.llm.wordtable import NumberTable, slabs, split

#: Below the lowest score of the vocabulary lies that of an unknown character, by the tokenizer's rule.
UNKNOWN_PENALTY = 10.0


def scored_pieces(path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece model that match text, and their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Counter(NumberTable):
    """Counts tokens as a unigram tokenizer with byte fallback and a mark in place of each space makes them.

    A piece has a mark at its start only, and none holds a line feed, so that text falls apart there
    into words whose counts add up. What stands between spaces is a row of the table.
    """

    def __init__(self, pieces: list[tuple[str, float]], keep: int = 120_000_000) -> None:
        super().__init__(1, keep)
        self.pieces = [p for p, _ in pieces if "\n" not in p and MARK not in p[1:]]
        by = dict(pieces)
        self.score = np.array([by[p] for p in self.pieces], np.float64)
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.matcher = PieceMatcher(self.pieces)

    def learn(self, words: list[str]) -> None:
        """With a mark before each; a line feed is one token and parts what stands on its sides."""
        split_words = [(MARK + w).split("\n") for w in words]
        distinct = list(dict.fromkeys(p for s in split_words for p in s if p))
        count = dict(zip(distinct, best_counts(self.matcher, distinct, self.score, self.unknown), strict=True))
        self.append(np.array([[sum(count[p] for p in s if p) + len(s) - 1] for s in split_words], np.float64))

    def count(self, texts: pa.Array) -> np.ndarray:
        out = []
        for slab in slabs(texts):
            marked = pc.replace_substring(slab, MARK, " ")
            # A text that begins with a space has a mark there already; an empty one has no word.
            bare = pc.or_(pc.starts_with(marked, " "), pc.equal(pc.binary_length(marked), 0)).to_numpy(zero_copy_only=False)
            words, offsets = split(marked, " ")
            mark = self.sums(pa.array([""], pa.large_string()), np.array([0, 1]))[0, 0]
            out.append(self.sums(words, offsets)[:, 0] - np.where(bare, mark, 0))
        return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def token_counts(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_tokens) of every row's whole text.

    A null or empty text has 0 of each. A line feed, and any character that is no piece, counts as its
    bytes. Rows that repeat come out as often as they came in.
    """
    publish(df.sparkSession, vocabulary_path)

    def make():
        counter = resident(("counter", vocabulary_path), lambda: Counter(scored_pieces(published(vocabulary_path))))

        def step(batch: pa.RecordBatch):
            counts = counter.count(batch.column(1))
            chars = pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), chars, pa.array(counts, pa.int64())], names=["doc_id", "n_chars", "n_tokens"])

        return step

    return map_batches(two_columns(df, id_col, text_col), make, "doc_id long, n_chars long, n_tokens long")
