"""Words and their hashes, vectorised over the texts of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes that separate words in the class [^\\x20\\x09-\\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that separate words in the class [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+.
MARKS = np.zeros(256, bool)
MARKS[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_SEED = np.random.Generator(np.random.PCG64(20240115))
_BYTE = _SEED.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = int(_SEED.integers(2**61, 2**63, dtype=np.uint64)) | 5
INVERSE = pow(BASE, -1, 2**64)
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS))
        _POWERS = np.full(size, BASE, np.uint64)
        _INVERSES = np.full(size, INVERSE, np.uint64)
        _POWERS[0] = _INVERSES[0] = 1
        _POWERS, _INVERSES = np.multiply.accumulate(_POWERS), np.multiply.accumulate(_INVERSES)
    return _POWERS[:n], _INVERSES[:n]


def ranges_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair, by prefix sums of a polynomial."""
    power, inverse = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:-1], out=sums[1:])
    h = (sums[end] - sums[start]) * inverse[start]
    return mix(h + (end - start).astype(np.uint64) * U(0x9E3779B97F4A7C15))


class Words:
    """Words of several texts: hash, byte span in ``blob``, and the first word of each text."""

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACE):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.blob = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.blob, np.uint8)
        inside = ~separators[raw]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
        self.start, self.end = edge[::2], edge[1::2]
        self.text_at = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.first = np.searchsorted(self.start, self.text_at)
        self.count = np.diff(self.first)
        self.hash = ranges_hash(_BYTE[raw], self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def beginnings(self, sizes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words of more characters, hashes of their first ones as words of their own) for each number of characters."""
        raw = np.frombuffer(self.blob, np.uint8)
        letters = np.flatnonzero((raw & 0xC0) != 0x80)
        first, last = np.searchsorted(letters, self.start), np.searchsorted(letters, self.end)
        power, inverse = powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * power[:-1], out=sums[1:])
        for k in sizes:
            which = np.flatnonzero(last - first > k)
            a, b = self.start[which], letters[first[which] + k]
            yield which, mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * U(0x9E3779B97F4A7C15))

    def owner(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def inner(self) -> np.ndarray:
        """The place of each word in its text."""
        return np.arange(len(self)) - np.repeat(self.first[:-1], self.count)


def parts(batches, columns: list[str], text: str = "text", most: int = 2 << 20) -> Iterator[tuple]:
    """Slices of Arrow batches of about ``most`` bytes of text: (texts as bytes, null is empty; other columns)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        texts = [b if b is not None else b"" for b in column.to_pylist()]
        sizes = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        at = 0
        while at < len(texts):
            until = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            others = [batch.column(batch.schema.get_field_index(c)).slice(at, until - at) for c in columns]
            yield texts[at:until], *others
            at = until


def shingles(h: np.ndarray, count: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and the text of each. A shorter text with a word gives its whole sequence."""
    begin, n = first[:-1], np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
    owner = np.repeat(np.arange(len(count)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    return ranges_hash(h, at, np.minimum(at + width, np.repeat(first[1:], n))), owner
