"""Words and word n-grams as 64-bit hashes, computed with numpy over the UTF-8 bytes of an Arrow batch.

Only ASCII bytes are lower-cased or act as separators, so working on bytes equals
working on code points.  Texts are processed whole, in segments of a few MB that are
cut between words, so memory does not follow the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(2**40, 2**62)) * 8 + 5
_OFFSETS = _RNG.integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: separators of the word pattern [^\x20\x09-\x0D]+
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: every ASCII byte that is no letter and no digit
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[128:] = False
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    PUNCTUATION[_lo:_hi] = False

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SEGMENT)
        up = np.full(size, _BASE % 2**64, dtype=np.uint64)
        down = np.full(size, pow(_BASE, -1, 2**64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _tag(n: int) -> np.uint64:
    return np.uint64(n * int(_LENGTH) % 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer; returns a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _segment(raw: np.ndarray, starts: np.ndarray, separators: np.ndarray, apart: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw)
    b = LOWER[raw]
    sep = separators[b]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = sep[:-1]
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = sep[1:]
    if apart:  # a word also ends between bytes of the two kinds
        one, two = apart[0][b], apart[1][b]
        one[1:] |= (b[:-1] == 0xC3) & (b[1:] != 0x97) & (b[1:] != 0xB7)  # the last byte of a letter from À to ÿ
        between = (one[1:] & two[:-1]) | (two[1:] & one[:-1])
        first[1:] |= between
        last[:-1] |= between
    cut = starts[starts < n]
    first[cut] = True
    last[cut[cut > 0] - 1] = True
    word = ~sep
    s, e = np.flatnonzero(first & word), np.flatnonzero(last & word) + 1
    up, down = _power(n)
    v = _BYTE[b]
    v *= up[:n]
    c = np.empty(n + 1, np.uint64)
    c[0] = 0
    np.cumsum(v, out=c[1:])
    return mix((c[e] - c[s]) * down[s] + (e - s).astype(np.uint64) * _LENGTH), s, e


def word_hashes(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, in order, and the offsets of the rows in that array."""
    return word_places(raw, offsets, separators)[:2]


def word_places(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, apart: tuple | None = None):
    """As ``word_hashes``, with every word's first byte and end; ``apart``: two kinds of bytes to part words between."""
    hashes, counts, begins, ends = [], np.zeros(len(offsets) - 1, np.int64), [], []
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SEGMENT, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[end])
        if hi - lo <= SEGMENT:
            if hi > lo:
                h, s, e = _segment(raw[lo:hi], offsets[row:end] - lo, separators, apart)
                hashes.append(h)
                begins.append(s + lo)
                ends.append(e + lo)
                at = np.searchsorted(s, offsets[row : end + 1] - lo)
                counts[row:end] = np.diff(at)
        else:  # one long text: cut after a separator
            while lo < hi:
                to = min(lo + SEGMENT, hi)
                if to < hi:
                    inside = np.flatnonzero(separators[raw[lo:to]])
                    if len(inside):
                        to = lo + int(inside[-1]) + 1
                    else:
                        while to < hi and not separators[raw[to]]:
                            to += 1
                h, s, e = _segment(raw[lo:to], np.zeros(1, np.int64), separators, apart)
                hashes.append(h)
                begins.append(s + lo)
                ends.append(e + lo)
                counts[row] += len(h)
                lo = to
        row = end
    out = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    places = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begins, ends)]
    return out, np.concatenate([[0], np.cumsum(counts)]), *places


def windows(words: np.ndarray, offsets: np.ndarray, picks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the words at ``picks`` (offsets in a window of picks[-1] + 1 words) for every window inside a row.

    Returns the hashes and each window's first word (its index in ``words``).
    """
    span = picks[-1] + 1
    n = len(words) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in picks:
        h += words[j : j + n] * _OFFSETS[j % 64]
    row_end = np.repeat(offsets[1:], np.diff(offsets))[:n]
    at = np.flatnonzero(np.arange(span, n + span) <= row_end)
    return mix(h[at] + _tag(len(picks))), at


def shingle_sets(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of every row (a shorter row: its whole sequence as one) and row offsets."""
    h, at = windows(words, offsets, list(range(k)))
    n = np.diff(offsets)
    counts = np.maximum(n - k + 1, 0)
    out_at = np.concatenate([[0], np.cumsum(np.where((n > 0) & (n < k), 1, counts))])
    out = np.empty(out_at[-1], np.uint64)
    long_rows = np.repeat(n >= k, np.diff(out_at))
    out[long_rows] = h
    for size in range(1, k):
        rows = np.flatnonzero(n == size)
        if len(rows):
            s = np.zeros(len(rows), np.uint64)
            for j in range(size):
                s += words[offsets[rows] + j] * _OFFSETS[j]
            out[out_at[rows]] = mix(s + _tag(size))
    for a, b in zip(out_at[:-1].tolist(), out_at[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[out_at[:-1][out_at[:-1] < len(out)]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return out[fresh], kept[out_at]
