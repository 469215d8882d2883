"""Words of a whole column of texts as numpy arrays, straight from an Arrow buffer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GAP = np.zeros(256, bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True
#: Keeps the lowest n bytes of an 8-byte number.
LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def follow(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence from the hashes of its two parts."""
    return mix(left * ODD + right)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts on end, and where each begins (and the end). Nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def blocks(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Rows a to b of consecutive blocks of about ``most`` bytes of text, a longer text being a block of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    a = size = 0
    for b, n in enumerate(sizes.tolist()):
        if b > a and size + n > most:
            yield a, b
            a, size = b, 0
        size += n
    if len(sizes):
        yield a, len(sizes)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and the number of words before each text (and in all)."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    ink = ~GAP[data]
    before = np.concatenate([[False], ink[:-1]]) if n else ink
    begin = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.concatenate([ink[1:], [False]]) if n else ink
    end = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return begin, end, np.searchsorted(begin, offsets)


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = end - begin
    out = mix(left.astype(np.uint64) + ODD)
    at, some = begin.copy(), np.arange(len(begin))
    while len(some):
        take = np.minimum(left[some], 8)
        out[some] = follow(out[some], lanes[at[some]] & LOW_BYTES[take])
        at[some] += 8
        left[some] -= take
        some = some[left[some] > 0]
    return out


def runs(word: np.ndarray, length: int) -> np.ndarray:
    """The hash of the ``length`` words from each place; places near the end give fewer, by length - 1.

    Powers of two by doubling, then the binary parts of the length one after another.
    """
    if len(word) < length:
        return np.zeros(0, np.uint64)
    power, size, parts = word, 1, {}
    while size <= length:
        if length & size:
            parts[size] = power
        if 2 * size <= length:
            power = follow(power[: len(power) - size], power[size:])
        size *= 2
    n, out, done = len(word) - length + 1, None, 0
    for size in sorted(parts, reverse=True):
        part = parts[size][done : done + n]
        out = part[:n] if out is None else follow(out, part)
        done += size
    return out
