"""Whole texts to byte-pair ids and back, by the speculating encoder of bpe."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from graphfold.llm.bpe import CHUNKS, PIECES, Vocabulary
from graphfold.llm.common import map_batches, publish, published, resident, two_columns
from graphfold.llm.tokens import ByteEncoder

#: Before a special token among the chunks of a text; no chunk of text has a space after a letter.
SPECIAL = "a "


class Codec(ByteEncoder):
    """Encodes and decodes whole texts as the tokenizers library does with a byte-level BPE file."""

    def __init__(self, path: str, keep: int = 150_000_000) -> None:
        super().__init__(None, keep)
        self.vocabulary = Vocabulary(path)
        found = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, found)) or r"\b\B")
        self.odd = "|".join([self.odd, *(f"\\Q{x}\\E" for x in found)])

    def learn(self, chunks: list[str]) -> None:
        split = [[c] if c.startswith(SPECIAL) else PIECES.findall(c) for c in chunks]
        words = list(dict.fromkeys(w for s in split for w in s if not w.startswith(SPECIAL)))
        ids, count, _ = self.vocabulary.encode_words([w.encode() for w in words])
        marked = sorted({c for c in chunks if c.startswith(SPECIAL)})
        ids = np.append(ids, [self.vocabulary.special[c[len(SPECIAL) :]] for c in marked]).astype(np.int64)
        count = np.append(count, np.ones(len(marked), np.int64)).astype(np.int64)
        begin = np.cumsum(count) - count
        at = {w: i for i, w in enumerate([*words, *marked])}
        width = np.fromiter(map(len, split), np.int64, len(split))
        own = np.fromiter((at[w] for s in split for w in s), np.int64, int(width.sum()))
        each = count[own]
        ends = np.cumsum(each)
        flat = ids[np.repeat(begin[own] - ends + each, each) + np.arange(int(each.sum()))]
        total = np.append(0, ends)[np.append(0, np.cumsum(width))]
        self.append(flat, np.diff(total))

    def chunks(self, text: str) -> list[str]:
        if not (self.special and self.special.search(text)):
            return CHUNKS.findall(text)
        parts, at = [], 0
        for hit in self.special.finditer(text):
            parts += [*CHUNKS.findall(text[at : hit.start()]), SPECIAL + hit[0]]
            at = hit.end()
        return parts + CHUNKS.findall(text[at:])

    def decode(self, ids: bytes) -> bytes:
        """The text's bytes; what is no valid UTF-8 comes back as replacement characters."""
        raw = b"".join(map(self.vocabulary.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


def codec(path: str) -> Codec:
    """One codec for each process and vocabulary."""
    return resident(("codec", path), lambda: Codec(published(path)))


def encode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary): little-endian unsigned 32-bit ids of every whole text. A null or empty text has none."""
    publish(df.sparkSession, vocabulary_path)

    def make():
        own = codec(vocabulary_path)

        def step(batch: pa.RecordBatch):
            ids = own.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

        return step

    return map_batches(two_columns(df, id_col, text_col), make, "doc_id long, ids binary")


def decode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of encode(). Null ids give an empty text."""
    publish(df.sparkSession, vocabulary_path)

    def make():
        own = codec(vocabulary_path)

        def step(batch: pa.RecordBatch):
            texts = [own.decode(x or b"").decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

        return step

    return map_batches(df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{ids_col}` as binary) ids"), make, "doc_id long, text string")


def round_trip(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, and its ids decoded, without moving either.

    A null or empty text has 0 tokens and the digests of nothing. Rows that repeat come out as often as they came in.
    """
    publish(df.sparkSession, vocabulary_path)

    def make():
        own = codec(vocabulary_path)
        digest = lambda x: hashlib.sha256(x).hexdigest()

        def step(batch: pa.RecordBatch):
            ids = own.encode(batch.column(1))
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(digest, ids), pa.string()), pa.array([digest(own.decode(x)) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return map_batches(two_columns(df, id_col, text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
