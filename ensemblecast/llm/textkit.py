"""Vectorised text primitives over Arrow string columns.

Everything works on a concatenated byte buffer plus row offsets, a chunk of about a megabyte at a time, so
that memory depends on the longest text and never on the number of rows. Hashes are polynomials modulo 2**64
over per-byte random values; a range's hash comes from two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in BASES)

#: The separators of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, which: int = 0, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept up to a few megabytes."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 4096)
        have = np.full(size, (INVERSES if inverse else BASES)[which], np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * CHUNK_BYTES:
            _powers[which, inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of value * base**position, with a leading zero."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), which), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the ranges [start, end) under prefix sums."""
    inv = powers(len(sums), which, inverse=True)
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about ``most`` bytes; a longer row is one run."""
    if not len(column):
        return
    data, offs = buffer(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal True runs of ``mask``; runs never cross rows."""
    if not len(mask):
        z = np.zeros(0, np.int64)
        return z, z, z
    edges = offs[:-1][np.diff(offs) > 0]
    before = np.empty(len(mask), bool)
    before[0] = False
    before[1:] = mask[:-1]
    before[edges] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(len(mask), bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[edges[1:] - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words ``[^\\x20\\x09-\\x0D]+``."""
    return runs(~SPACE[data], offs)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters, in place of the UTF-8 bytes."""
    out = _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    hit = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    out[hit] |= 0x20
    return out


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and hashes of folded runs of letters, digits and non-ASCII bytes."""
    low = fold(data) if len(data) else data
    starts, ends, rows = runs(_TOKEN[data], offs)
    return starts, ends, rows, range_hash(prefix(BYTE_VALUES[0][low]), starts, ends)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return range_hash(prefix(BYTE_VALUES[which][data], which), starts, ends, which)


def word_sections(data: np.ndarray, most: int = CHUNK_BYTES, gaps: np.ndarray = SPACE) -> Iterator[tuple[int, int]]:
    """Stretches of at most ``most`` bytes that cut no word of a text; a longer word is one stretch alone. ``gaps`` are the bytes between words."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(lo + most, n)
        if hi < n:
            gap = np.flatnonzero(gaps[data[lo:hi]])
            if len(gap):
                hi = lo + int(gap[-1]) + 1
            while not len(gap) and hi < n:
                gap = np.flatnonzero(gaps[data[hi : hi + most]])
                hi = min(hi + (int(gap[0]) if len(gap) else most), n)
        yield lo, hi
        lo = hi


def section_hashes(data: np.ndarray, most: int = CHUNK_BYTES, folded: bool = False) -> np.ndarray:
    """Hashes of the words (``folded``: the tokens) of one stretch, a piece at a time where it is one long word."""
    if len(data) <= most:
        if folded:
            return tokens(data, np.array([0, len(data)]))[3]
        starts, ends, _ = words(data, np.array([0, len(data)]))
        return word_hashes(data, starts, ends)
    total, factor, base = 0, 1, int(BASES[0])
    for a in range(0, len(data), most):
        piece = data[a : a + most]
        if folded:  # a letter of two bytes may be cut
            piece = fold(data[max(0, a - 1) : a + most])[min(1, a) :]
        piece = BYTE_VALUES[0][piece]
        total += int((piece * powers(len(piece))).sum(dtype=np.uint64)) * factor
        factor = factor * pow(base, len(piece), 1 << 64) % (1 << 64)
    return mix(np.array([(total + len(data)) % (1 << 64)], np.uint64))


def intervals(spans: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that spans ``a`` to ``b`` cover."""
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.array([s[k] for s in spans], np.int64) for k in "ab")
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    fresh = np.append(True, a[1:] > b[:-1])
    return a[fresh], b[np.append(np.flatnonzero(fresh)[1:] - 1, len(b) - 1)]


def grams(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First positions and hashes of the k-grams that lie in one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return at, range_hash(prefix(hashes, 1), at, at + k, 1)


def counts(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    out = np.bincount(rows, weights, n)
    return out.astype(np.int64) if weights is None else out


def spread(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window [at, at + k)."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + k, -1)
    return np.cumsum(delta[:-1]) > 0


def long_hashes(data: np.ndarray, folded: bool = False) -> np.ndarray:
    """Hashes of the words (or tokens) of one long text, worked out a stretch at a time."""
    parts = [section_hashes(data[a:b], CHUNK_BYTES, folded) for a, b in word_sections(data, CHUNK_BYTES, ~_TOKEN if folded else SPACE)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def gram_sections(hashes: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """First position and hashes of the k-grams of one text, some at a time."""
    size = max(1, CHUNK_BYTES // 8)
    for a in range(0, len(hashes) - k + 1, size):
        own = hashes[a : a + size + k - 1]
        yield a, grams(own, np.zeros(len(own), np.int8), k)[1]


def is_long(data: np.ndarray, offs: np.ndarray) -> bool:
    """Whether a run is one text of over a megabyte."""
    return len(offs) == 2 and len(data) > CHUNK_BYTES


def in_words(data: np.ndarray) -> np.ndarray:
    """Where a code point of a word begins."""
    return ~SPACE[data] & ((data & 0xC0) != 0x80)
