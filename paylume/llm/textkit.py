"""Vectorised text helpers used inside Arrow tasks: word spans, hashes and bounded sub-batches.

A batch of texts is one byte buffer with document offsets, so that all words of all texts in a batch
are found and hashed by a few numpy passes. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once inside a task; a longer single text is handled alone.
BLOCK_BYTES = 1 << 19


def _byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.ones(256, bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Bytes of the words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = _byte_set((0x20, 0x20), (0x09, 0x0D))
#: Bytes that A-Z lower-cased belong to the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = _byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the output."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Hashes of token sequences are polynomials over this prime, so that two sequences of ``n`` tokens agree with a chance
#: of at most ``n`` in ``PRIME`` over the choice of the base. (Modulo 2**64 there are sequences that agree for any base.)
PRIME = U64((1 << 61) - 1)
_BASE = [int(x) for x in np.random.default_rng(20240229).integers(1 << 59, (1 << 61) - 2, 2)]
_LANE = [U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95)]
_powers: dict[tuple[int, bool], np.ndarray] = {}


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo the prime."""
    x = (x & PRIME) + (x >> U64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, by halves of 32 bits."""
    low = U64(0xFFFFFFFF)
    a1, a0, b1, b0 = a >> U64(32), a & low, b >> U64(32), b & low
    middle, bottom = a1 * b0 + a0 * b1, a0 * b0
    total = (a1 * b1 << U64(3)) + (middle >> U64(29)) + ((middle & U64((1 << 29) - 1)) << U64(32)) + (bottom & PRIME) + (bottom >> U64(61))
    return reduced(total)


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**i modulo the prime for i < n (or of the inverse base); kept between calls."""
    kept = _powers.get((which, inverse), np.ones(1, U64))
    if len(kept) < n:
        base = pow(_BASE[which], -1, int(PRIME)) if inverse else _BASE[which]
        while len(kept) < max(n, 1 << 16):
            kept = np.concatenate([kept, product(kept, U64(pow(base, len(kept), int(PRIME))))])
        _powers[which, inverse] = kept
    return kept[:n]


def prefix_sums(values: np.ndarray, which: int) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[i:j] times powers of the base, modulo the prime. Halves are summed apart, which
    is exact for fewer than 2**32 values."""
    terms = product(reduced(values), powers(which, len(values)))
    out = np.zeros(len(values) + 1, U64)
    high = reduced(np.cumsum(terms >> U64(32), dtype=U64))
    out[1:] = reduced(product(high, U64(1 << 32)) + reduced(np.cumsum(terms & U64(0xFFFFFFFF), dtype=U64)))
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Hash of each values[start:end], equal for equal content wherever it stands."""
    total = sums[end] + PRIME - sums[start]
    return mix(product(np.where(total >= PRIME, total - PRIME, total), powers(which, len(sums), True)[start]))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of each data[start:end]: its lanes of eight bytes are mixed apart, each with its place, and summed."""
    if not len(starts):
        return np.zeros(0, U64)
    size = ends - starts
    many = np.maximum(-(-size // 8), 1)
    first = np.cumsum(many) - many
    lane = np.arange(int(many.sum())) - np.repeat(first, many)
    at = np.repeat(starts, many) + 8 * lane
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    octets = np.lib.stride_tricks.sliding_window_view(padded, 8)[at]
    left = np.minimum(np.repeat(ends, many) - at, 8)
    cut = (U64(0xFFFFFFFFFFFFFFFF) >> (U64(8) * (U64(8) - np.maximum(left, 1).astype(U64)))) * (left > 0)
    value = np.ascontiguousarray(octets).view("<u8")[:, 0] & cut
    mixed = mix(mix(value ^ _LANE[which]) + (lane.astype(U64) + U64(1)) * _LANE[1 - which])
    return mix(np.add.reduceat(mixed, first) + size.astype(U64) * _LANE[which])


def byte_grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes at each place where so many are left, by lanes of eight bytes."""
    n = len(data) - gram + 1
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lane = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8")[:, 0]
    if gram < 8:
        return mix((lane[:n] & U64((1 << 8 * gram) - 1)) + _LANE[0])
    out = np.zeros(n, U64)
    for at in [*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
        out = mix(out ^ lane[at : at + n]) * _LANE[0]
    return mix(out)


class Texts:
    """Texts of one sub-batch as bytes ``data`` with offsets ``at`` (one more than texts)."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        binary = pa.types.is_binary(column.type)
        column = pc.fill_null(column.cast(pa.large_binary() if binary else pa.large_string()), b"" if binary else "")
        at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.data, self.at = data[at[0] : at[-1]], at - at[0]

    def __len__(self) -> int:
        return len(self.at) - 1

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words in the bytes, and where each text's words begin among them."""
        inside = table[self.data]
        n = len(inside)
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edges = self.at[(self.at > 0) & (self.at < n)]
            first[edges] = inside[edges]
            last[edges - 1] = inside[edges - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.at)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, which: int = 0, lower: bool = False) -> np.ndarray:
        return word_hashes(LOWER[self.data] if lower else self.data, starts, ends, which)


def sub_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text each, one row at least. After each batch, what Arrow holds
    on to is given back, since workers wait for their next task beside others."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total, start = 0, 0
        for i, x in enumerate(lengths):
            if total and total + x > limit:
                yield batch.slice(start, i - start)
                total, start = 0, i
            total += int(x)
        yield batch.slice(start)
        del batch, lengths
        pa.default_memory_pool().release_unused()
