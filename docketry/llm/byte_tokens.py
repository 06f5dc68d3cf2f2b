"""Byte-level BPE ids of texts by the tokenizers library, with splitting and look-up of known words in numpy."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from docketry.llm.batches import span_hashes, text_bytes
from docketry.llm.prefix_bpe import byte_characters

LETTER, DIGIT, SPACE, OTHER, UNUSUAL = range(5)
#: Distinct words kept by a worker before it starts anew.
KNOWN_WORDS = 1_000_000


def byte_classes() -> np.ndarray:
    """Class of each byte of plain texts: printable ASCII, three white spaces, letters of two bytes from À."""
    classes = np.full(256, UNUSUAL, np.uint8)
    classes[0x20:0x7F] = OTHER
    classes[ord("0") : ord("9") + 1] = DIGIT
    for first, last in ((ord("A"), ord("Z")), (ord("a"), ord("z")), (0x80, 0xBF), (0xC3, 0xC3)):
        classes[first : last + 1] = LETTER
    classes[[0x20, 0x09, 0x0A, 0x0D]] = SPACE
    return classes


CLASSES = byte_classes()


def unusual_rows(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per row whether it holds a character beyond the plain ones (the signs × and ÷ are no letters)."""
    bad = CLASSES[data] == UNUSUAL
    follows = (data >= 0x80) & (data < 0xC0)
    after_lead = np.zeros(len(data), bool)
    after_lead[1:] = data[:-1] == 0xC3
    bad |= follows != after_lead
    bad |= after_lead & ((data == 0x97) | (data == 0xB7))
    rows = np.zeros(len(at) - 1, bool)
    rows[np.searchsorted(at, np.flatnonzero(bad), "right") - 1] = True
    return rows


def word_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the pieces of the byte-level splitting rule start, for plain texts end to end.

    Runs of letters, of digits and of other signs take a blank before them; white space before a text's next
    sign is a piece without its last character; the short forms 's 't 'm 'd 're 've 'll split off.
    """
    n = len(data)
    kind = CLASSES[data]
    first = np.zeros(n + 1, bool)
    first[at] = True  # starts of texts, and the end
    change = first.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    change = change[:n]
    blank_before = np.zeros(n, bool)
    blank_before[1:] = (data[:-1] == 0x20) & ~first[1:n]
    space = kind == SPACE
    starts = change & (space | ~blank_before)
    ends_run = np.zeros(n, bool)  # the last white space before a sign of the same text
    ends_run[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    starts |= ends_run
    quote = np.flatnonzero((data == 0x27) & change & ~blank_before)
    if len(quote):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        inside = lambda place: ~first[np.minimum(place, n)]  # noqa: E731  still in the same text
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & inside(quote + 1)
        long = np.zeros(len(quote), bool)
        for a, b in (b"re", b"ve", b"ll"):
            long |= (one == a) & (two == b)
        long &= inside(quote + 1) & inside(quote + 2)
        for places, length in ((quote[short], 2), (quote[long], 3)):
            starts[places + 1] = False
            after = places + length
            after = after[(after < n)]
            starts[after[(kind[after] == LETTER)]] = True
    return np.flatnonzero(starts)


class ByteTokens:
    """Ids of texts; distinct words are encoded once by the library's model and then looked up by hash."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.characters = byte_characters()
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.begins, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Add unknown words."""
        translate, tokenize = self.characters, self.model.tokenize
        found = [[t.id for t in tokenize(w.decode("latin-1").translate(translate))] for w in words]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        begins = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], np.uint32)])
        order = np.argsort(hashes)
        places = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, places, hashes[order])
        self.begins = np.insert(self.begins, places, begins[order])
        self.counts = np.insert(self.counts, places, counts[order])

    def plain(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number per row) of plain texts end to end."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        starts = word_starts(data, at)
        ends = np.append(starts[1:], len(data))
        hashes, which = np.unique(span_hashes(data, starts, ends), return_inverse=True)
        if len(self.hashes) > KNOWN_WORDS:
            self.forget()
        places = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        some = places < len(self.hashes)
        known[some] = self.hashes[places[some]] == hashes[some]
        if not known.all():
            example = np.zeros(len(hashes), np.int64)
            example[which] = np.arange(len(which))
            new, raw = example[~known], data.tobytes()
            self.learn(hashes[~known], [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            places = np.searchsorted(self.hashes, hashes)
        counts = self.counts[places][which]
        ends_at = np.cumsum(counts)
        total = int(ends_at[-1])
        source = np.repeat(self.begins[places][which] - (ends_at - counts), counts) + np.arange(total)
        per_row = np.diff(np.concatenate([[0], ends_at])[np.searchsorted(starts, at)])
        return self.ids[source], per_row

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of every text of a string column without nulls."""
        data, at = text_bytes(column)
        slow = unusual_rows(data, at)
        raw = data.tobytes()
        for token in self.special:
            place = raw.find(token)
            while place >= 0:
                slow[np.searchsorted(at, place, "right") - 1] = True
                place = raw.find(token, place + 1)
        if slow.any():
            keep = np.repeat(~slow, np.diff(at))
            sizes = np.where(slow, 0, np.diff(at))
            data, at = data[keep], np.concatenate([[0], np.cumsum(sizes)])
        ids, per_row = self.plain(data, at)
        rows = np.split(ids, np.cumsum(per_row)[:-1])
        for i in np.flatnonzero(slow).tolist():
            rows[i] = np.array(self.library.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return rows


@cache
def byte_tokens(path: str) -> ByteTokens:
    """One table of known words per worker and file."""
    return ByteTokens(path)
