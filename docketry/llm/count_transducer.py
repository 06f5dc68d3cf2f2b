"""Token counts by a deterministic transducer compiled from a sentencepiece BPE vocabulary.

The transducer reads characters; a transition is annotated with the change of the number of tokens in the
encoding of what has been read. A state holds what later input can still depend on: for every suffix of the
input that begins some token, the suffix, the last token before it and its count relative to the whole; all
else is forgotten. The next last token is the longest token among suffix + character whose predecessor is
compatible with it (the two survive merging as they are); for every input there is exactly one. Suffixes that
no compatible token extends are left out, which keeps the states few. States and transitions are compiled when
first reached, from the vocabulary alone.

A text falls into chunks, each with a state map: entry state to exit state and count. No token reaches over
white space that follows other characters, or over a character without a piece of its own (its bytes are its
tokens), so a chunk that starts there has a constant map; longer runs are cut, and their chunks' maps are
composed. Distinct chunks are worked out once, and a prefix sum over the chunks in text order gives all counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from docketry.llm.batches import pieces, span_hashes, text_bytes
from docketry.llm.common import documents

BLANK = "▁"
#: Characters of a chunk within a long run; chunks and maps kept by a worker before it starts anew.
CHUNK, KNOWN_CHUNKS, KNOWN_MAPS = 64, 2_000_000, 100_000
#: States after which the automaton is compiled anew, to bound its memory.
MOST_STATES = 100_000
#: Pairs of tokens remembered as compatible or not; tokens tried to tell whether a suffix can be left out.
KNOWN_PAIRS, TRIED = 200_000, 8
FIRST = np.uint64(0xD1B54A32D192ED03)  # tells a text's first chunk, which has a blank put before it


class Transducer:
    """States are numbers; a state's entries are packed as (suffix in the trie, token before it, count)."""

    def __init__(self, scores: dict[str, float]):
        order = sorted(scores, key=lambda p: -scores[p])
        self.rank = {p: r for r, p in enumerate(order)}
        self.child: dict[int, int] = {}  # trie node and character -> node
        self.token, self.below = [0], [[]]  # of each node: its token (0: none), and the tokens under it
        self.spines: list[tuple[list, list]] = [([], [])]  # of each token: its outer symbols, left and right
        splits: dict[str, tuple[str, str]] = {}
        for piece in order:  # parts rank before what they make
            parts = self.halves(piece)
            if len(piece) == 1 or len(parts) == 2:
                if parts and not all(len(x) == 1 or x in splits for x in parts):
                    raise ValueError(f"the parts of {piece!r} rank behind it")
                if parts:
                    splits[piece] = parts
                self.add(piece, [self.spine(piece, splits, side) for side in (0, 1)])
        self.pairs: dict[int, bool] = {}
        self.useful: dict[int, bool] = {}
        self.restart()

    def halves(self, piece: str) -> tuple[str, ...]:
        """The two symbols that the last merge of a piece joins; () if merging doesn't give the piece."""
        parts, rank, worst = list(piece), self.rank, len(self.rank)
        while len(parts) > 2:
            ranks = [rank.get(a + b, worst) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == worst:
                return ()
            at = ranks.index(best)
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
        return tuple(parts) if len(parts) == 2 else ()

    def spine(self, piece: str, splits: dict, side: int) -> list[tuple[str, float]]:
        """(symbol, rank of the merge that takes it up) from a token's outermost symbol to the whole."""
        chain, rank = [], math.inf
        while True:
            chain.append((piece, rank))
            if piece not in splits:
                return chain[::-1]
            rank, piece = self.rank[piece], splits[piece][side]

    def add(self, piece: str, spines: list[list]) -> None:
        number, node, path = len(self.spines), 0, []
        for character in piece:
            path.append(node)
            key = node << 21 | ord(character)
            node = self.child.get(key, 0)
            if not node:
                node = self.child[key] = len(self.token)
                self.token.append(0)
                self.below.append([])
        self.token[node] = number
        self.spines.append(tuple(spines))
        for above in path[1:]:
            self.below[above].append(number)

    def restart(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: dict[int, int] = {}  # state and character -> next state and gain
        self.start = self.number((self.entry(0, 0, 0),))

    @staticmethod
    def entry(node: int, before: int, count: int) -> int:
        return node << 32 | before << 10 | count + 512

    def number(self, state: tuple) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
        return found

    def compatible(self, one: int, two: int) -> bool:
        """Whether merging leaves the boundary between two tokens.

        The symbols at the boundary grow as their tokens are built, in the order of ranks. A merge across it
        happens if its rank is below that of the next merge on the left and not above that on the right.
        """
        if not one:
            return True
        key = one << 22 | two
        found = self.pairs.get(key)
        if found is None:
            left, right, i, j, found = self.spines[one][1], self.spines[two][0], 0, 0, True
            while True:
                (a, grow_left), (b, grow_right) = left[i], right[j]
                across = self.rank.get(a + b, math.inf)
                if across < grow_left and across <= grow_right:
                    found = False
                    break
                if grow_left == grow_right == math.inf:
                    break
                if grow_left <= grow_right:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) >= KNOWN_PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def extends(self, before: int, node: int) -> bool:
        """Whether some token that goes on from a suffix is compatible with the token before it.

        Tried where few tokens go on from it; otherwise the suffix is kept, which is right in any case.
        """
        below = self.below[node]
        if len(below) > TRIED or not before:
            return bool(below)
        key = before << 32 | node
        found = self.useful.get(key)
        if found is None:
            if len(self.useful) >= KNOWN_PAIRS:
                self.useful.clear()
            found = self.useful[key] = any(self.compatible(before, token) for token in below)
        return found

    def compile(self, state: int, character: int) -> int:
        """The transition of a state on a character, as next state and change of the count."""
        if not self.token[self.child.get(character, 0)]:
            state, gain = self.start, len(chr(character).encode())
        else:
            last, gain, kept = 0, 0, []
            for packed in self.states[state]:
                node = self.child.get((packed >> 32) << 21 | character)
                if node is None:
                    continue
                before, count = packed >> 10 & 0x3FFFFF, (packed & 1023) - 512
                token = self.token[node]
                if token and not last and self.compatible(before, token):
                    last, gain = token, count + 1
                if self.extends(before, node):
                    kept.append((node, before, count))
            entries = [self.entry(n, b, c - gain) for n, b, c in kept]
            state = self.number((*entries, self.entry(0, last, 0)))
        return state << 10 | gain + 512

    def run(self, text: str, state: int) -> tuple[int, int]:
        """(exit state, count) of a chunk entered in ``state``."""
        total, table = -512 * len(text), self.next
        for character in map(ord, text):
            key = state << 21 | character
            found = table.get(key)
            if found is None:
                found = table[key] = self.compile(state, character)
            state = found >> 10
            total += found & 1023
        return state, total


class Counter:
    """Counts of whole texts from their chunks."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [
            i
            for i in range(model.get_piece_size())
            if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))
        ]
        self.transducer = Transducer({model.id_to_piece(i): model.get_score(i) for i in normal})
        if any(BLANK in p.lstrip(BLANK) for p in self.transducer.rank):
            raise ValueError("a piece goes on after a blank; texts can't be cut there")
        # an ASCII control character without a piece cuts the text on both sides
        self.cuts = np.zeros(256, bool)
        self.cuts[[b for b in range(32) if chr(b) not in self.transducer.rank]] = True
        self.maps: dict[tuple[int, str], tuple[int, int]] = {}
        self.forget()

    def forget(self) -> None:
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def count(self, text: str) -> int:
        """Tokens of a text from the start state, by composing the state maps of its chunks."""
        machine = self.transducer
        if len(machine.states) > MOST_STATES:
            machine.restart()
            self.maps.clear()
        if len(text) <= CHUNK:
            return machine.run(text, machine.start)[1]
        if len(self.maps) > KNOWN_MAPS:
            self.maps.clear()
        state, total = machine.start, 0
        for at in range(0, len(text), CHUNK):
            key = state, text[at : at + CHUNK]
            found = self.maps.get(key)
            if found is None:
                found = self.maps[key] = machine.run(key[1], state)
            state, total = found[0], total + found[1]
        return total

    def chunk_starts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where chunks start: at a run of blanks, before and after cutting characters, at a text's start."""
        first = np.zeros(len(data) + 1, bool)
        first[at] = True
        starts = first[:-1].copy()
        blank, cut = data == 0x20, self.cuts[data]
        starts[1:] |= (blank[1:] & ~blank[:-1]) | cut[1:] | cut[:-1]
        return np.flatnonzero(starts)

    def totals(self, column: pa.Array) -> np.ndarray:
        """Tokens of every text of a string column without nulls."""
        data, at = text_bytes(column)
        if BLANK.encode() in data.tobytes():  # the same symbol as a blank
            texts = [t.as_py().replace(BLANK, " ") for t in column]
            data, at = text_bytes(pa.array(texts, pa.large_string()))
        if not len(data):
            return np.zeros(len(at) - 1, np.int64)
        starts = self.chunk_starts(data, at)
        ends = np.append(starts[1:], len(data))
        keys = span_hashes(data, starts, ends)
        row = np.searchsorted(at, starts, "right") - 1
        is_first = at[row] == starts
        keys[is_first] ^= FIRST
        keys, which = np.unique(keys, return_inverse=True)
        if len(self.hashes) > KNOWN_CHUNKS:
            self.forget()
        places = np.searchsorted(self.hashes, keys)
        known = np.zeros(len(keys), bool)
        some = places < len(self.hashes)
        known[some] = self.hashes[places[some]] == keys[some]
        if not known.all():
            example = np.zeros(len(keys), np.int64)
            example[which] = np.arange(len(which))
            new, raw = example[~known], data.tobytes()
            counts = [
                self.count((BLANK if begins else "") + raw[a:b].decode().replace(" ", BLANK))
                for a, b, begins in zip(starts[new].tolist(), ends[new].tolist(), is_first[new].tolist(), strict=True)
            ]
            places = np.searchsorted(self.hashes, keys[~known])
            self.hashes = np.insert(self.hashes, places, keys[~known])
            self.counts = np.insert(self.counts, places, counts)
            places = np.searchsorted(self.hashes, keys)
        running = np.concatenate([[0], np.cumsum(self.counts[places][which])])
        return np.diff(running[np.searchsorted(starts, at)])


@cache
def counter(path: str) -> Counter:
    """One transducer per worker and file."""
    return Counter(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    Null and empty texts have no bytes and no tokens. Special strings in a text are plain text. Rows are
    handled one by one: null doc_ids, repeated rows, very long texts and other columns make no difference, and
    an empty table gives an empty result.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(path)
        for piece in pieces(batches):
            sizes = np.diff(text_bytes(piece.column("text"))[1])
            columns = [piece.column("doc_id"), pa.array(sizes), pa.array(table.totals(piece.column("text")))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = documents(docs).mapInArrow(work, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
