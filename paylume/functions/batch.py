"""Payload statistics over the byte buffer and offsets of a whole Arrow batch at once. Each function takes a
:class:`Payloads` and returns one row a payload; undefined statistics are NaN. Nulls count as empty."""

from __future__ import annotations

import bz2
import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NAN = float("nan")
BANDS = 8
#: Bytes of payloads handled at once; a longer single payload is handled alone.
BLOCK_BYTES = 1 << 19
#: Payloads of so many bytes or fewer are parsed by searching, which is faster there than sorting suffixes.
SEARCHED = 4000


def slices(batch: pa.RecordBatch, column: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of payloads each, one row at least."""
    start = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


class Payloads:
    """Bytes ``data`` of all payloads, ``at``, where each begins (one more than payloads), their sizes ``n`` and, for each
    byte, the number ``row`` of its payload."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.data, self.at = data[at[0] : at[-1]], at - at[0]
        self.n = np.diff(self.at)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self._counts: np.ndarray | None = None

    @classmethod
    def of(cls, *payloads: bytes) -> Payloads:
        return cls(pa.array(list(payloads), pa.binary()))

    def __len__(self) -> int:
        return len(self.n)

    def __iter__(self) -> Iterator[np.ndarray]:
        return (self.data[a:b] for a, b in zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True))

    @property
    def counts(self) -> np.ndarray:
        """Occurrences of the 256 bytes."""
        if self._counts is None:
            self._counts = np.bincount(self.row * 256 + self.data, minlength=256 * len(self)).reshape(-1, 256)
        return self._counts

    def sums(self, values: np.ndarray, cut: int = 0) -> np.ndarray:
        """Sums of ``values``, one a byte, by payload, without its last ``cut`` bytes; 0 where none are left."""
        out = np.zeros(len(self))
        some = self.n > cut
        if some.any():
            ends = np.stack([self.at[:-1][some], self.at[1:][some] - cut], 1).ravel()
            out[some] = np.add.reduceat(np.r_[values, np.zeros(1 + cut)], ends)[::2]
        return out

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes less their payload's mean, and the sums of their squares."""
        mean = (self.counts @ np.arange(256.0)) / np.maximum(self.n, 1)
        x = self.data - mean[self.row]
        return x, self.sums(x * x)


def chi2_tails(x: np.ndarray, dof: int) -> np.ndarray:
    """Upper tails of the chi-square distribution: series below a + 1, continued fraction above, in log space."""
    a, out = dof / 2.0, np.where(np.isnan(x), NAN, 1.0)
    z = np.where(np.isnan(x), 0.0, x) / 2.0
    low, high = np.flatnonzero((z > 0) & (z < a + 1)), np.flatnonzero(z >= a + 1)
    if len(low):
        y, term, k = z[low], np.full(len(low), 1.0 / a), a
        total = term.copy()
        while (term > 1e-16 * total).any():
            k += 1
            term = term * y / k
            total += term
        out[low] = np.maximum(0.0, 1.0 - np.exp(a * np.log(y) - y - math.lgamma(a)) * total)
    if len(high):
        y, tiny = z[high], 1e-300
        b = y + 1 - a
        c, d = np.full(len(high), 1 / tiny), 1 / b
        h, i = d.copy(), 0
        going = np.ones(len(high), bool)
        while going.any() and i < 10_000:
            i += 1
            b = b + 2
            an = -i * (i - a)
            d = an * d + b
            d = 1 / np.where(d == 0, tiny, d)
            c = b + an / c
            c = np.where(c == 0, tiny, c)
            h = np.where(going, h * d * c, h)
            going &= np.abs(d * c - 1) >= 1e-15
        out[high] = np.exp(a * np.log(y) - y - math.lgamma(a)) * h
    return out


def _entropies(clogc: np.ndarray, n: np.ndarray) -> np.ndarray:
    some = np.maximum(n, 1)
    return np.where(n > 0, np.maximum(0.0, np.log2(some) - clogc / some), 0.0)


def histogram(p: Payloads) -> np.ndarray:
    return p.counts / np.maximum(p.n, 1)[:, None]


def count_statistics(p: Payloads) -> np.ndarray:
    """Entropy (bits a byte), uniformity chi-square (NaN under 16 bytes) and index of coincidence."""
    c = p.counts.astype(float)
    n = p.n.astype(float)
    squares = (c * c).sum(axis=1)
    clogc = (c * np.log2(np.maximum(c, 1))).sum(axis=1)
    return np.stack([_entropies(clogc, n), np.where(n >= 16, 256.0 * squares / np.maximum(n, 1) - n, NAN), np.where(n > 1, (squares - n) / np.maximum(n * (n - 1), 1), 0.0)], 1)


def uniformity(p: Payloads) -> np.ndarray:
    """Entropy, chi-square, its degrees of freedom and its upper tail."""
    entropy, chi2, _ = count_statistics(p).T
    return np.stack([entropy, chi2, np.where(np.isnan(chi2), NAN, 255.0), chi2_tails(chi2, 255)], 1)


def grams(p: Payloads, g: int) -> np.ndarray:
    """Of grams of ``g`` <= 4 bytes: entropy, distinct ones, largest relative frequency, chi-square over those that occur
    (0 for one), and the unseen share of all grams. NaN for payloads shorter than a gram."""
    out = np.full((len(p), 5), NAN)
    at = np.arange(max(len(p.data) - g + 1, 0))
    at = at[p.row[at] == p.row[at + g - 1]]
    if not len(at):
        return out
    key = p.row[at].astype(np.int64)
    for i in range(g):
        key = key << 8 | p.data[at + i]
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    c, row = np.diff(np.r_[first, len(key)]).astype(float), key[first] >> 8 * g
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    have, k = row[begin], np.diff(np.r_[begin, len(row)]).astype(float)
    m = p.n[have] - g + 1.0
    top, clogc, cc = np.maximum.reduceat(c, begin), np.add.reduceat(c * np.log2(c), begin), np.add.reduceat(c * c, begin)
    out[have] = np.stack([_entropies(clogc, m), k, top / m, np.where(k > 1, cc * k / m - m, 0.0), 1 - k / 256.0**g], 1)
    return out


def pair_shares(p: Payloads) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of neighbouring bytes that occur: the payload's number, the pair as one number, and its share of the
    payload's pairs."""
    at = np.arange(max(len(p.data) - 1, 0))
    at = at[p.row[at] == p.row[at + 1]]
    key = np.sort(p.row[at].astype(np.int64) << 16 | p.data[at].astype(np.int64) << 8 | p.data[at + 1])
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    row, pair = key[first] >> 16, key[first] & 65535
    return row, pair, np.diff(np.r_[first, len(key)]) / (p.n[row] - 1.0)


def xor_repeating(data: np.ndarray, key: bytes) -> np.ndarray:
    """XOR with the first four bytes of a key over and over, of the fourth only its lowest bit (25 bits in all)."""
    word = np.frombuffer(key[:4], np.uint8) & np.array([255, 255, 255, 1], np.uint8)
    return data ^ np.resize(word, len(data))


def xor_digests(p: Payloads, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The md5 of each payload's XOR in upper-case hexadecimal, and whether a second XOR gives the payload back."""
    digests, opens = np.full(len(p), "", object), np.zeros(len(p), bool)
    for i, (x, key) in enumerate(zip(p, keys.to_pylist(), strict=True)):
        made = xor_repeating(x, key)
        digests[i], opens[i] = hashlib.md5(made.tobytes().hex().upper().encode()).hexdigest(), np.array_equal(xor_repeating(made, key), x)
    return digests, opens


def lag_correlations(p: Payloads, lags: range = range(1, 17)) -> np.ndarray:
    """Mean product of centred bytes ``k`` apart over their population variance, within [-1, 1]; NaN from lag n on; 1
    for a constant payload."""
    x, squares = p.centred()
    var = squares / np.maximum(p.n, 1)
    out = np.full((len(p), len(lags)), NAN)
    for i, k in enumerate(lags):
        if len(x) > k:
            mean = p.sums(np.r_[x[:-k] * x[k:], np.zeros(k)], k) / np.maximum(p.n - k, 1)
            out[:, i] = np.where(p.n <= k, NAN, np.where(var < 1e-12, 1.0, np.clip(mean / np.maximum(var, 1e-12), -1, 1)))
    return out


def plain_lag(p: Payloads, lag: int = 4) -> np.ndarray:
    """The product sum of centred pairs over the sum of squares, not scaled by their numbers; 0 for short or constant
    payloads."""
    x, squares = p.centred()
    pairs = p.sums(np.r_[x[:-lag] * x[lag:], np.zeros(lag)], lag) if len(x) > lag else np.zeros(len(p))
    return np.where((p.n <= lag + 1) | (squares < 1e-9), 0.0, pairs / np.maximum(squares, 1e-9))[:, None]


def runs_test(p: Payloads) -> np.ndarray:
    """Runs of bytes above the median and their z score."""
    below = p.counts.cumsum(axis=1)
    middle = lambda i: (below > i[:, None]).argmax(axis=1)
    median = (middle(np.maximum(p.n - 1, 0) // 2) + middle(p.n // 2)) / 2.0
    above = p.data > median[p.row]
    change = np.zeros(len(above))
    change[1:] = (above[1:] != above[:-1]) & (p.row[1:] == p.row[:-1])
    n, n1, runs = p.n.astype(float), p.sums(above.astype(float)), 1 + p.sums(change)
    cross = 2 * n1 * (n - n1)
    square = cross * (cross - n) / np.maximum(n * n * (n - 1), 1)
    z = np.where(square > 0, (runs - cross / np.maximum(n, 1) - 1) / np.sqrt(np.where(square > 0, square, 1)), NAN)
    return np.where(n[:, None] < 2, NAN, np.stack([runs, z], 1))


def block_rate(p: Payloads, size: int = 16) -> np.ndarray:
    """Share of full blocks whose content stands more than once; 0 with fewer than two blocks."""
    out = np.zeros((len(p), 1))
    for i, x in enumerate(p):
        many = len(x) // size
        if many > 1:
            counts = np.unique(np.ascontiguousarray(x[: many * size]).view(f"V{size}"), return_counts=True)[1]
            out[i] = counts[counts > 1].sum() / many
    return out


def ratios(p: Payloads, *by: Callable[[bytes, int], bytes]) -> np.ndarray:
    """Compressed over plain size, by zlib and by bz2 at level 9, or by other functions of that kind."""
    by = by or (zlib.compress, bz2.compress)
    return np.array([[len(f(x, 9)) / len(x) if len(x) else NAN for f in by] for x in map(bytes, p)], float).reshape(-1, len(by))


def spectrum(data: np.ndarray) -> list[float]:
    """Shares of eight index bands of the power spectrum without its mean, place of the peak, entropy of the bands."""
    power = np.square(np.abs(np.fft.rfft(data.astype(float))))[1:] if len(data) >= 8 else np.zeros(0)
    below = np.concatenate([[0.0], np.cumsum(power)])
    if below[-1] < 1e-12:
        return [NAN] * (BANDS + 2)
    share = np.diff(below[np.arange(BANDS + 1) * len(power) // BANDS]) / below[-1]
    entropy = -np.sum(share * np.log2(share, out=np.zeros(BANDS), where=share > 0))
    return [*share.tolist(), int(np.argmax(power)) / len(power), float(entropy)]


def spectra(p: Payloads) -> np.ndarray:
    return np.array([spectrum(x) for x in p], float).reshape(-1, BANDS + 2)


def suffix_ranks(p: Payloads) -> list[np.ndarray]:
    """For 4, 8, 16, ... bytes: numbers of the suffixes that order them by payload and so many first bytes, equal where
    these are; the last ones differ all. Each step sorts only what is still equal."""
    n = len(p.data)
    end = p.at[1:][p.row]
    key = p.row.astype(np.int64)
    padded = np.r_[p.data.astype(np.int64) + 1, np.zeros(4, np.int64)]
    for i in range(4):
        key = key << 9 | np.where(np.arange(n) + i < end, padded[i : n + i], 0)
    order = np.argsort(key, kind="stable")
    first = np.r_[True, key[order][1:] != key[order][:-1]] if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1] if n else 0
    levels, step = [rank], 4
    tied = np.flatnonzero(~(first & np.r_[first[1:], True])) if n else np.zeros(0, np.int64)
    while len(tied):
        some = order[tied]
        after = some + step
        further = np.where(after < end[some], levels[-1][np.minimum(after, n - 1)] + 1, 0)
        by = np.lexsort((further, levels[-1][some]))
        some, further = some[by], further[by]
        group = levels[-1][some]
        order[tied] = some
        new = np.r_[True, (group[1:] != group[:-1]) | (further[1:] != further[:-1])]
        rank = levels[-1].copy()
        rank[some] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        levels.append(rank)
        step *= 2
        tied = tied[~(new & np.r_[new[1:], True])]
    return levels


def common_prefix(p: Payloads, levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes from ``a`` equal those from ``b`` in the same payload; 0 where ``a`` is negative. Prefixes are doubled
    for the pairs that still agree, and what is left is told by ever shorter ones."""
    found = np.zeros(len(a), np.int64)
    some = np.flatnonzero((a >= 0) & (p.row[np.maximum(a, 0)] == p.row[b]))
    room = p.at[1:][p.row[b]] - np.maximum(a, b)

    def agree(at: np.ndarray, i: int) -> np.ndarray:
        """Those of the pairs that go on with ``4 << i`` equal bytes."""
        at = at[found[at] < room[at]]
        return at[levels[i][a[at] + found[at]] == levels[i][b[at] + found[at]]]

    top = [some]
    for i in range(len(levels)):
        top.append(agree(top[-1], i))
    for i in range(len(levels) - 1, -1, -1):
        # pairs that reach beyond this level have been advanced; the others that reach it start with it
        again = agree(top[i + 1][found[top[i + 1]] > 0], i)
        found[top[i + 1]] = np.where(found[top[i + 1]] > 0, found[top[i + 1]], 4 << i)
        found[again] += 4 << i
    for _ in range(3):
        some = some[found[some] < room[some]]
        some = some[p.data[a[some] + found[some]] == p.data[b[some] + found[some]]]
        found[some] += 1
    return found


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, -1 if there is none. Places that are not there yet
    go on from where the larger value before them has got to, all at once."""
    to = np.arange(len(values)) - 1
    some = np.arange(len(values))
    while True:
        some = some[to[some] >= 0]
        some = some[values[to[some]] > values[some]]
        if not len(some):
            return to
        to[some] = to[to[some]]


def longest_earlier(p: Payloads) -> np.ndarray:
    """For each byte, how many from it on also stand from an earlier place of its payload on (the two may overlap): the
    longer of what it has in common with its nearest neighbours among the sorted suffixes that begin earlier."""
    n = len(p.data)
    if not n:
        return np.zeros(0, np.int64)
    levels = suffix_ranks(p)
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    earlier = np.full((2, n), -1)
    earlier[0][order] = np.r_[order, -1][smaller_before(order)]
    earlier[1][order[::-1]] = np.r_[order[::-1], -1][smaller_before(order[::-1])]
    at = np.arange(n)
    return np.maximum(common_prefix(p, levels, earlier[0], at), common_prefix(p, levels, earlier[1], at))


def phrase_count_of_short(data: bytes) -> int:
    """Phrases of one payload by searching for ever longer strings, each from where the last one stands first; quadratic."""
    at = found = 0
    while at < len(data):
        # most phrases are longer than four bytes
        place = data.find(data[at : at + 4], 0, at + 3) if at + 4 <= len(data) else -1
        size, place = (5, place) if place >= 0 else (1, 0)
        while at + size <= len(data):
            place = data.find(data[at : at + size], place, at + size - 1)
            if place < 0:
                break
            size += 1
        at += size
        found += 1
    return found


def phrase_counts(p: Payloads) -> np.ndarray:
    """Phrases of the 1976 parsing: each is the shortest string from its start that doesn't stand earlier, where the earlier
    one may overlap it but for the last byte. Payloads of over ``SEARCHED`` bytes go by sorted suffixes; the counts are
    the same either way."""
    out = np.zeros(len(p))
    for i in np.flatnonzero(p.n <= SEARCHED).tolist():
        out[i] = phrase_count_of_short(p.data[p.at[i] : p.at[i + 1]].tobytes())
    long = np.flatnonzero(p.n > SEARCHED).tolist()
    if not long:
        return out
    rest = Payloads.of(*(p.data[p.at[i] : p.at[i + 1]].tobytes() for i in long))
    longest = longest_earlier(rest).tolist()
    for i, at, end in zip(long, rest.at[:-1].tolist(), rest.at[1:].tolist(), strict=True):
        while at < end:
            at += longest[at] + 1
            out[i] += 1
    return out


def phrases(p: Payloads) -> np.ndarray:
    """Phrases, and phrases a byte."""
    found = phrase_counts(p)
    return np.stack([found, np.where(p.n > 0, found / np.maximum(p.n, 1), NAN)], 1)
