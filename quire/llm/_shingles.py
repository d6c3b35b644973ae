"""Hashed words and word shingles of whole texts (numpy, inside tasks).

Words are hashed without a loop over them: a word's hash is a polynomial in an odd number over
random 64-bit values of its bytes (A-Z have those of a-z), taken from running sums over
the bytes and then mixed. All texts of an Arrow column are read in place, end to end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MUL = np.uint64(0x9E3779B97F4A7C15)
_FIN = np.uint64(0xBF58476D1CE4E5B9)
#: bytes whose running sums are held at once
_SPAN = 1 << 17
#: bytes of text that are taken at once, or one text
SLICE = 1 << 20

_BASE = 0xD1342543DE82EF95
_VALUES = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ..., n - 1 modulo 2 ** 64."""
    out, done = np.ones(n, np.uint64), 1
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * np.uint64(base)
        base, done = base * base % (1 << 64), done * 2
    return out


_UP, _DOWN = _powers(_BASE, _SPAN), _powers(pow(_BASE, -1, 1 << 64), _SPAN)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _FIN
    return x ^ (x >> np.uint64(31))


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column's texts end to end, and where each begins, and the last ends; null is empty."""
    column = column.fill_null(b"").cast(pa.large_binary()) if column.null_count else column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the bytes, and where it begins; no word goes across a cut."""
    space = _SPACE.take(data)
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts], last[cuts - 1] = ~space[cuts], ~space[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + _SPAN, "right")))
        n = int(ends[j - 1] - a)
        up, down = (_UP, _DOWN) if n <= _SPAN else (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
        sums = _VALUES.take(data[a : a + n])
        sums *= up[:n]
        np.cumsum(sums, out=sums)
        s, h = starts[i:j] - a, sums.take(ends[i:j] - a - 1)
        h[1:] -= sums.take(s[1:] - 1)
        out[i:j] = h * down.take(s)
        i = j
    return mixed(out), starts


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each word of one text."""
    return words(np.frombuffer(data, np.uint8), np.empty(0, np.int64))[0]


def sliced(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts hold about so many bytes, or one text."""
    for b in batches:
        if not b.num_rows:
            continue
        at = joined(b.column(column))[1][:-1] // most
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [b.num_rows]])
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            yield b.slice(int(i), int(j - i))


def runs(h: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of sequences of n words each, laid end to end in h, and the sequence of each.

    A sequence of fewer words than the width is one shingle, and one of none has none. The order within a
    sequence is that of the words, but short sequences come last.
    """
    m = max(len(h) - width + 1, 0)
    acc = np.full(m, np.uint64(width), np.uint64)
    for i in range(width):
        acc *= _MUL
        acc += h[i : m + i]
    ends = np.cumsum(n)
    which = np.repeat(np.arange(len(n)), n)
    left = (ends[which] - np.arange(len(h)))[:m]  # words from here to the sequence's end
    whole = left >= width
    tokens, sequence = [mixed(acc[whole])], [which[:m][whole]]
    for k in range(1, width):
        short = np.flatnonzero(n == k)
        tokens.append(shingles(h[(ends - n)[short][:, None] + np.arange(k)].T, width)[0])
        sequence.append(short)
    return np.concatenate(tokens), np.concatenate(sequence)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of width words; with fewer words, of the whole sequence; of none, nothing."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, width)
    acc = np.full((n - k + 1, *words.shape[1:]), np.uint64(k), np.uint64)
    for i in range(k):
        acc = acc * _MUL + words[i : n - k + 1 + i]
    return mixed(acc)


def shingle_set(data: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingles(word_hashes(data or b""), width))


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The same for each text of a column."""
    data, offsets = joined(column)
    h, starts = words(data, offsets)
    n = np.diff(np.searchsorted(starts, offsets))
    tokens, which = runs(h, n, width)
    order = np.lexsort((tokens, which))
    tokens, which = tokens[order], which[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (which[1:] != which[:-1])
    tokens, which = tokens[new], which[new]
    return np.split(tokens, np.searchsorted(which, np.arange(1, len(n)))) if len(n) else []


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
