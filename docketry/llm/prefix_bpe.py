"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one last token in its encoding. It is found among the vocabulary
tokens that are suffixes of the prefix (an automaton with suffix links reports them at every place): the one
whose predecessor, the stored last token of the remaining prefix, is compatible with it. Two tokens are
compatible when merging their joined symbols gives the two again, i.e. when no merge across the boundary
comes before the merges that build them. Following the stored tokens back from the end of the word gives the
ids that rank-ordered merging gives, in time linear in the word's length for a bounded token length.

The words are those of the tokenizer file: its special tokens, normalizer and splitting rule come first.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from docketry.llm.batches import pieces
from docketry.llm.common import documents

#: Words kept with their ids by a worker before it starts anew.
CACHED_WORDS = 150_000
#: Texts of these characters are split by a plain expression; all others by the tokenizer's own rules.
PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")
#: Added to a word's last character, so that a symbol that ends a word is one character too.
END = 0x1000


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class PrefixEncoder:
    """Exact ids of single words for a vocabulary with ranked merges."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str | None):
        self.suffix = suffix
        mark = self.marked
        self.ids = {mark(t): i for t, i in vocabulary.items()}
        ranks = {(mark(a), mark(b)): r for r, (a, b) in enumerate(merges)}
        parts = {}
        for (a, b), rank in ranks.items():
            parts.setdefault(a + b, (a, b, rank))
        self.ranks = {(self.ids[a], self.ids[b]): r for (a, b), r in ranks.items()}
        self.parts, self.tokens = parts, {i: t for t, i in self.ids.items()}
        self.lengths = {i: len(t) for t, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            if len(token) == 1 or token in parts and self.compatible(*(self.ids[x] for x in parts[token][:2]), built=parts[token][2]):
                self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}

    def marked(self, token: str) -> str:
        """A token with its end-of-word suffix as a mark on the last character."""
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            return self.word(token[: -len(self.suffix)])
        return token

    def word(self, characters: str) -> str:
        return characters[:-1] + chr(ord(characters[-1]) + END) if self.suffix else characters

    def spine(self, token: str, side: int) -> list[tuple[int, float]]:
        """(symbol, rank of the next merge) from a token's outer symbol up to the token."""
        chain, rank = [], math.inf
        while True:
            chain.append((self.ids[token], rank))
            if token not in self.parts:
                return chain[::-1]
            rank, token = self.parts[token][2], self.parts[token][side]

    def compatible(self, one: int, two: int, built: float = math.inf) -> bool:
        """Whether merging leaves a boundary between two tokens (until the merge of rank ``built``).

        The symbols next to the boundary grow as their tokens are built, in the order of ranks. A merge across
        the boundary happens if its rank is below that of the next merge on the left, and not above that of
        the next one on the right: equal merges are made from left to right.
        """
        left, right = self.spine(self.tokens[one], 1), self.spine(self.tokens[two], 0)
        i = j = 0
        while True:
            (a, grow_left), (b, grow_right) = left[i], right[j]
            across = self.ranks.get((a, b))
            if across is not None and across < built and across < grow_left and across <= grow_right:
                return False
            if grow_left == grow_right == math.inf:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def encode(self, characters: str) -> list[int]:
        """Ids of one word, given as byte characters."""
        word = self.word(characters)
        last: list[int | None] = [None] * (len(word) + 1)
        lengths, pairs = self.lengths, self.pairs
        for end, token in self.automaton.iter(word):  # at each end, the longest first
            if last[end + 1] is None:
                start = end + 1 - lengths[token]
                if start:
                    before = last[start]
                    if before is None:
                        continue
                    key = before << 32 | token
                    fits = pairs.get(key)
                    if fits is None:
                        fits = pairs[key] = self.compatible(before, token)
                    if not fits:
                        continue
                last[end + 1] = token
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at -= lengths[last[at]]
        return ids[::-1]


class Words(dict):
    """word -> (ids as little-endian 32-bit numbers, decoded tokens), worked out when first asked for."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        model = config["model"]
        self.library = Tokenizer.from_file(path)
        self.encoder = PrefixEncoder(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.special = {t: (np.uint32(i).tobytes(), t.encode()) for t, i in special.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.strings = {i: t.encode() for t, i in model["vocab"].items()}
        self.characters = byte_characters()
        super().__init__()

    def __missing__(self, word: str) -> tuple[bytes, bytes]:
        if len(self) >= CACHED_WORDS:
            self.clear()
            self.encoder.pairs.clear()
        ids = self.encoder.encode("".join(map(self.characters.__getitem__, word.encode())))
        found = self[word] = np.array(ids, "<u4").tobytes(), b" ".join([self.strings[i] for i in ids])
        return found

    def split(self, text: str) -> list[tuple[bytes, bytes]]:
        """The text's words, each with its ids and decoded tokens."""
        if PLAIN.fullmatch(text) and "<|" not in text:
            return [self[w] for w in PLAIN_WORDS.findall(text.lower())]
        found, back = [], {c: b for b, c in self.characters.items()}
        for part in self.specials.split(text):
            if part in self.special:
                found.append(self.special[part])
            elif part:
                normal = self.library.normalizer.normalize_str(part)
                for word, _ in self.library.pre_tokenizer.pre_tokenize_str(normal):
                    found.append(self[bytes(map(back.__getitem__, word)).decode()])
        return found


@cache
def words(path: str) -> Words:
    """One set of words per worker and file."""
    return Words(path)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for every row of ``docs``.

    ``ids`` is binary, little-endian unsigned 32-bit numbers; ``decoded`` is the tokens' text, special ones
    included, joined by blanks as the file (which names no decoder) asks for. Null and empty texts have no
    ids and an empty decoded text. Rows are handled one by one: null doc_ids, repeated rows, very long texts
    and other columns make no difference, and an empty table gives an empty result.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words(path)
        for piece in pieces(batches):
            ids, decoded = [], []
            for text in piece.column("text"):
                found = table.split(text.as_py())
                ids.append(b"".join([x[0] for x in found]))
                decoded.append(b" ".join([x[1] for x in found]))
            columns = [
                piece.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array(ids, pa.binary()),
                pa.array(decoded, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return documents(docs).mapInArrow(work, f"doc_id {kind}, n_tokens long, ids binary, decoded string")
