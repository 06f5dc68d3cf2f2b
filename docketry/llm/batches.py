"""Arrow batches cut into pieces of bounded size, so that a task's memory doesn't depend on text lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a task works on at once; a longer single text is a piece of its own.
PIECE_BYTES = 2 << 20
PIECE_ROWS = 2048


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of consecutive rows with about ``limit`` bytes of text each; the text column has no nulls."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = offsets(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
            stop = min(stop, start + PIECE_ROWS)
            yield batch.slice(start, stop - start)
            start = stop


def offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string column's rows in its buffer, one more than there are rows."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of all rows of a string column without nulls, end to end."""
    at = offsets(column)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


#: The modulus of the rolling sums, a Mersenne prime; their base, a fixed random number below it, and its inverse.
PRIME = (1 << 61) - 1
BASE = int(np.random.Generator(np.random.PCG64(7)).integers(1 << 32, PRIME))
INVERSE = pow(BASE, -1, PRIME)
LOW, LOW_BITS = np.uint64((1 << 31) - 1), np.uint64(31)
#: Bytes between two starting points of the sums: the sums of the products of as many fit into 64 bits.
SUM_BYTES = 1 << 22


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply, as published for SplitMix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo ``PRIME``, for any x of 64 bits."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.minimum(x, x - np.uint64(PRIME))  # below the prime the difference wraps around to more than x


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo ``PRIME``, for numbers below it, from products of halves."""
    a_low, a_high, b_low, b_high = a & LOW, a >> LOW_BITS, b & LOW, b >> LOW_BITS
    middle = a_low * b_high + a_high * b_low
    # a_high * b_high counts 2 ** 62, which is 2; middle counts 2 ** 31, and its high part 2 ** 61, which is 1
    high, low = middle >> np.uint64(30), middle & np.uint64((1 << 30) - 1)
    return reduced(reduced(a_low * b_low) + (a_high * b_high << np.uint64(1)) + high + (low << LOW_BITS))


class Powers:
    """Powers of a number modulo ``PRIME``, kept and lengthened when needed."""

    def __init__(self, base: int):
        self.base, self.values = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            step = np.uint64(pow(self.base, len(self.values), PRIME))
            self.values = np.concatenate([self.values, product(self.values, step)])
        return self.values[:n]


RISING, FALLING = Powers(BASE), Powers(INVERSE)


def running_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of (byte + 1) * BASE ** place before every place, of the powers' low and high bits.

    They are right modulo ``PRIME``; each stretch of ``SUM_BYTES`` starts at a reduced value.
    """
    sums = tuple(np.zeros(len(data) + 1, np.uint64) for _ in range(2))
    powers = RISING.upto(len(data))
    for start in range(0, len(data), SUM_BYTES):
        stop = min(start + SUM_BYTES, len(data))
        values = data[start:stop].astype(np.uint64) + np.uint64(1)
        for total, part in zip(sums, (powers[start:stop] & LOW, powers[start:stop] >> LOW_BITS), strict=True):
            total[start] = reduced(total[start : start + 1])[0]
            np.cumsum(values * part, out=total[start + 1 : stop + 1])
            total[start + 1 : stop + 1] += total[start]
    return sums


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of bytes, from running sums over the whole buffer.

    Equal spans have equal hashes wherever they stand. A hash is the value, at a fixed random place modulo a prime of 61
    bits, of the polynomial whose coefficients are the span's bytes: two different spans of up to n bytes agree with
    a probability of about n / 2 ** 61.
    """
    low, high = (reduced(reduced(t[ends]) + np.uint64(PRIME) - reduced(t[starts])) for t in running_sums(data))
    values = reduced(low + product(high, np.uint64(1 << 31)))
    values = product(values, FALLING.upto(len(data) + 1)[starts])
    return mixed(values + ((ends - starts).astype(np.uint64) << np.uint64(32)))


def prefix_values(data: np.ndarray) -> np.ndarray:
    """Values, at the place of ``span_hashes``, of the polynomials of all bytes before every place."""
    low, high = (reduced(t) for t in running_sums(data))
    return reduced(low + product(high, np.uint64(1 << 31)))


def prefix_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``span_hashes`` of the bytes that ``values`` are the ``prefix_values`` of, for many spans of the same bytes."""
    found = reduced(values[ends] + np.uint64(PRIME) - values[starts])
    found = product(found, FALLING.upto(len(values))[starts])
    return mixed(found + ((ends - starts).astype(np.uint64) << np.uint64(32)))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first of every distinct key, number of every key's distinct one), in order of appearance."""
    number = pa.array(keys).dictionary_encode().indices.to_numpy()
    return np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1)), number


#: Per byte, A-Z as a-z; and whether it separates words (ASCII white space).
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A") : ord("Z") + 1] += 32
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): words of texts end to end; text i has the words first[i] to first[i + 1]."""
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~SPACES[data]
    begins = word[1:] & (~word[:-1] | first)
    stops = word[:-1] & (~word[1:] | first)
    starts = np.flatnonzero(begins[: len(data)])
    return starts, np.flatnonzero(stops[: len(data) + 1]), np.searchsorted(starts, at)
