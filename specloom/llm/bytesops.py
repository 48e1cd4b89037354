"""Vectorised work on the UTF-8 bytes of a batch of texts: words, their hashes, shingles.

Hashes are polynomial, modulo 2 ** 64, over a table of random 64-bit values for the 256 bytes, then
mixed. The tables come from seeded generators, so every process computes the same hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes worked on at once. Arrays of 64-bit values over so many bytes stay in a core's cache.
PIECE = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 64, 256, dtype=np.uint64)


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n of the base and of its inverse, modulo 2 ** 64."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(n, PIECE) + 1
        _powers[base] = tuple(np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, b, U), dtype=U)]) for b in (base, pow(base, -1, 1 << 64)))
        if size > 16 * PIECE:  # for one very long text only
            return _powers.pop(base)
    return _powers[base]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_hash(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """h with h[0] = 0, from which ``span_hash`` takes the hash of any span."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values), base)[0][: len(values)], dtype=U, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    return (prefix[end] - prefix[start]) * powers(len(prefix), base)[1][start]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after another, and the n + 1 places where texts begin. Null: empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)), at - at[0]


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about PIECE bytes, one text at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > PIECE:
            yield begin, i
            begin, total = i, 0
        total += int(n)
    if begin < len(sizes):
        yield begin, len(sizes)


def word_spans(data: np.ndarray, at: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of words of each text."""
    solid = ~between[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = at[(at > 0) & (at < len(data))]  # a text's end ends its last word
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, at))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, lower: bool = False) -> np.ndarray:
    """A mixed hash of each word, of equal value wherever the word stands."""
    out = np.empty(len(starts), U)
    table = values[LOWER] if lower else values
    begin = 0
    while begin < len(starts):
        end = max(begin + 1, int(np.searchsorted(ends, starts[begin] + PIECE, "right")))
        low = int(starts[begin])
        prefix = prefix_hash(table[data[low : int(ends[end - 1])]])
        out[begin:end] = span_hash(prefix, starts[begin:end] - low, ends[begin:end] - low)
        begin = end
    return mixed(out)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a text, and how many each text has. A text with
    fewer words, but one at least, has one shingle of all of them."""
    at = np.concatenate([[0], np.cumsum(counts)])
    n = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    total = int(n.sum())
    start = np.arange(total) + np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    end = np.minimum(start + size, np.repeat(at[1:], n))
    base = 0xD6E8FEB86659FD93
    return mixed(span_hash(prefix_hash(words, base), start, end, base) + (end - start).astype(U)), n
