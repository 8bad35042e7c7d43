"""Token ids of whole texts; the ids of words between spaces are worked out once and kept for reuse."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from graphfold.llm.bpe import CHUNKS, SPACE, byte_letters
from graphfold.llm.common import published, resident
from graphfold.llm.wordtable import IdTable, slabs, split

#: Pre-tokens that are kept have so many characters at most, and take so many bytes of the table's bound each.
PART, PART_BYTES = 40, 250
#: No text that is cut at spaces in bulk holds this character.
CUT = "\x00"
#: The pre-tokens of the tokenizer that drops white space.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Up to this character, lower case and composition are the same in every version of Unicode.
SETTLED = re.compile(r"[\x20-\u02af]*")
#: ASCII marks that end most words; a run of these is one pre-token.
ENDS = ".,;:!?)"


class Encoder(IdTable):
    """Ids of texts as little-endian unsigned 32-bit integers, the end id after each, if there is one."""

    def __init__(self, end: int | None = None, keep: int = 40_000_000) -> None:
        super().__init__(keep)
        self.end = b"" if end is None else int(end).to_bytes(4, "little")

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words whose ids, one after the other, are the texts', and where each text's begin."""
        raise NotImplementedError

    def encode(self, texts: pa.Array) -> list[bytes]:
        """A null text is an empty one."""
        out: list[bytes] = []
        for slab in slabs(texts):
            ids, begin = self.gather(*self.cut(slab))
            packed, begin = ids.astype("<u4", copy=False).tobytes(), (4 * begin).tolist()
            out += [packed[a:b] + self.end for a, b in zip(begin[:-1], begin[1:], strict=True)]
        return out


class WordEncoder(Encoder):
    """Of a tokenizers file with lower case, white space dropped and word ends.

    Its pre-tokens hold no white space, so a text's ids are those of what stands between its spaces
    and line feeds. Pre-tokens of settled characters are found here, all else by the library, and each
    distinct pre-token is encoded once by the library's model.
    """

    def __init__(self, path: str, end: int, keep: int = 40_000_000) -> None:
        super().__init__(end, keep)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            self.special = tuple(t["content"] for t in json.load(file)["added_tokens"])
        self.letters = {b: x for b, x in byte_letters().items()}
        self.known: dict[str, bytes] = {}

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        return split(pc.replace_substring(texts, "\n", " "), " ")

    def part(self, word: str) -> bytes:
        """The ids of a pre-token in lower case."""
        found = self.known.get(word)
        if found is None:
            found = array("I", [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode())))]).tobytes()
            if len(word) <= PART:
                self.known[word] = found
        return found

    def learn(self, words: list[str]) -> None:
        part, out, odd = self.part, [], []
        for i, word in enumerate(words):
            lower = word.lower()
            core = lower.rstrip(ENDS)
            if core.isalpha() and (word.isascii() or SETTLED.fullmatch(word)):  # most words: letters, and marks after them
                out.append(part(core) + part(lower[len(core) :]) if len(core) < len(lower) else part(core))
            elif SETTLED.fullmatch(word) and not (word and word[0] == "<" or "<|" in word):
                plain = word if word.isascii() else unicodedata.normalize("NFC", word)
                out.append(b"".join(map(part, WORDS.findall(plain.lower()))))
            else:
                odd.append(i)
                out.append(b"")
        for i, found in zip(odd, self.tokenizer.encode_batch_fast([words[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = array("I", found.ids).tobytes()
        if len(self.known) * PART_BYTES > self.keep:
            self.known = {}
        self.append(np.frombuffer(b"".join(out), np.uint32), np.fromiter(map(len, out), np.int64, len(out)) // 4)


class ByteEncoder(Encoder):
    """Of a byte-level vocabulary with the pattern of CHUNKS.

    In a text whose white space stands alone, each a space or a line feed, what lies between its spaces
    has ids of its own, with the space before it; other texts are cut one by one.
    """

    odd = f"[{SPACE}]{{2}}|[\x00\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

    def chunks(self, text: str) -> list[str]:
        return CHUNKS.findall(text)

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        odd = pc.match_substring_regex(texts, self.odd)
        parts, offsets = split(pc.replace_substring(texts, " ", CUT + " "), CUT)
        if not pc.any(odd).as_py():
            return parts, offsets
        pieces, counts, at = [], np.diff(offsets), 0
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            own = self.chunks(texts[i].as_py())
            pieces += [parts.slice(offsets[at], offsets[i] - offsets[at]), pa.array(own, pa.large_string())]
            counts[i], at = len(own), i + 1
        pieces.append(parts.slice(offsets[at]))
        return pa.concat_arrays(pieces), np.append(0, np.cumsum(counts))


class RankEncoder(ByteEncoder):
    """Of a file of byte-level ranks; special tokens in a text are ordinary text."""

    def __init__(self, path: str, pattern: str, end: int, keep: int = 40_000_000) -> None:
        super().__init__(end, keep)
        import base64

        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.own = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def learn(self, words: list[str]) -> None:
        out = [array("I", self.own.encode_ordinary(w)).tobytes() for w in words]
        self.append(np.frombuffer(b"".join(out), np.uint32), np.fromiter(map(len, out), np.int64, len(out)) // 4)


def encoder(kind: type[Encoder], path: str, *args) -> Encoder:
    """One encoder for each process and vocabulary, whose file has been published."""
    return resident((kind.__name__, path, *args), lambda: kind(published(path), *args))
