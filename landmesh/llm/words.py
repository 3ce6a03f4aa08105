"""Vectorized word and window hashes of Arrow string columns."""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are hashed at once; a cut falls on white space or between texts.
SLICE = 512 << 10
#: Longer words are hashed one by one.
LANES = 8
#: Windows that are hashed at once, so that the steps stay in a core's cache.
BLOCK = 16384

#: Window hashes are polynomials modulo this Mersenne prime; modulo 2**64 distinct long
#: sequences of a known form (Thue and Morse's) have equal hashes whatever the base.
PRIME = np.uint64((1 << 61) - 1)
#: Bases and seeds of the two independent hashes of words and windows.
BASES = (0x11E3779B97F4A7C1, 0x0D6E8FEB86659FD9)
SEEDS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on all of an array."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and text boundaries of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def word_hashes(data: np.ndarray, ends: np.ndarray, lower: bool = False, ways: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """``ways`` independent 64-bit hashes of each word, and the words of each text.

    A word is a run of other bytes than 0x20 and 0x09 to 0x0D; ``lower`` lowers A-Z.
    """
    hashes, counts, size = [], np.zeros(len(ends) - 1, np.int64), len(data)
    lo = 0
    while lo < size:
        hi = _cut(data, ends, lo, min(lo + SLICE, size))
        part = data[lo:hi]
        space = _SPACE[part]
        inner = ends[np.searchsorted(ends, lo, "right") : np.searchsorted(ends, hi, "left")] - lo
        begins = ~space
        begins[1:] &= space[:-1]
        begins[inner] = ~space[inner]
        stops = ~space
        stops[:-1] &= space[1:]
        stops[inner - 1] = ~space[inner - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        hashes.append(_of_words(_LOWER[part] if lower else part, first, last - first, ways))
        counts += np.bincount(np.searchsorted(ends, first + lo, "right") - 1, minlength=len(counts))
        lo = hi
    return [np.concatenate([h[w] for h in hashes]) if hashes else np.zeros(0, np.uint64) for w in range(ways)], counts


def _of_words(part: np.ndarray, first: np.ndarray, size: np.ndarray, ways: int) -> list[np.ndarray]:
    """A chain over eight bytes at a time, all words in step; words over ``LANES`` such lanes by XXH3."""
    padded = np.zeros(len(part) + 8, np.uint8)
    padded[: len(part)] = part
    lanes = np.ndarray(len(part) + 1, "<u8", padded, strides=(1,))
    out = [mix(size.astype(np.uint64) ^ SEEDS[w]) for w in range(ways)]
    live, at, left = slice(None), first, size
    for lane in range(LANES):
        value = lanes[at] & _FIRST_BYTES[np.minimum(left, 8)]
        for h in out:
            h[live] = mix(h[live] ^ value)
        live = np.flatnonzero(size > 8 * (lane + 1))
        if not len(live):
            return out
        at, left = first[live] + 8 * (lane + 1), size[live] - 8 * (lane + 1)
    for i in live:
        both = xxhash.xxh3_128_intdigest(part[first[i] : first[i] + size[i]].tobytes())
        for w, h in enumerate(out):
            h[i] = both >> (64 * w) & (2**64 - 1)
    return out


def _cut(data, ends, lo, hi):
    """The first place from ``hi`` on that is a text's start or white space."""
    if hi >= len(data):
        return len(data)
    text_end = int(ends[np.searchsorted(ends, hi, "left")])
    step = hi
    while step < text_end:
        found = np.flatnonzero(_SPACE[data[step : step + 65536]])
        if len(found):
            return min(step + int(found[0]), text_end)
        step += 65536
    return text_end


def _folded(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, or up to 8 more than the prime."""
    return (x & PRIME) + (x >> np.uint64(61))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = _folded(x)
    x[x >= PRIME] -= PRIME
    return x


def times(x: np.ndarray, factor: int) -> np.ndarray:
    """``x * factor`` modulo the prime in 64-bit arithmetic, folded; ``x`` is folded, ``factor`` below the prime."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    a, b = np.uint64(factor >> 31), np.uint64(factor & ((1 << 31) - 1))
    xh, xl = x >> half, x & low
    mid = xh * b + xl * a
    return _folded(((xh * a) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << half) + xl * b)


def _rolled(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes of all runs of ``size`` words, block by block."""
    n = max(len(words) - size + 1, 0)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, BLOCK):
        hi = min(lo + BLOCK, n)
        out[lo:hi] = _reduced(_doubled(words[lo : hi + size - 1], size, base))
    return out


def _doubled(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """The same for one block, folded: a run is put together from two of half its length."""
    if size == 1:
        return _folded(words)
    k = size // 2
    half = _doubled(words, k, base)
    n = len(words) - 2 * k + 1
    out = _folded(times(half[:n], pow(base, k, int(PRIME))) + half[k : k + n])
    if size % 2:
        n -= 1
        out = _folded(times(out[:n], base) + _folded(words[size - 1 : size - 1 + n]))
    return out


def window_hashes(words: list[np.ndarray], counts: np.ndarray, size: int, whole: bool = False) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all windows of ``size`` words inside each text, one array for each hash of the words.

    Returns the hashes, each window's first word (its place among ``words``) and the
    windows of each text. ``whole``: a text of fewer words, but at least one, is one window.
    """
    n = np.maximum(counts - size + 1, 0)
    begin = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < size)) if whole else np.zeros(0, np.int64)
    n[short] = 1
    starts = np.repeat(begin, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    place = (np.cumsum(n) - n)[short]
    out = []
    for w, h in enumerate(words):
        rolled = _rolled(h, size, BASES[w])
        got = rolled[np.minimum(starts, max(len(rolled) - 1, 0))] if len(rolled) else np.zeros(len(starts), np.uint64)
        length = np.full(len(got), size, np.uint64)
        if len(short):
            some = _folded(h[begin[short]])
            for k in range(1, size - 1):
                more = counts[short] > k
                some[more] = _folded(times(some[more], BASES[w]) + _folded(h[begin[short][more] + k]))
            some = _reduced(some)
            got[place], length[place] = some, counts[short].astype(np.uint64)
        out.append(mix(got ^ mix(length)))
    return out, starts, n


def give_back() -> None:
    """Return freed memory to the system; Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def gives_back(f):
    """``f`` of two arguments, a group's key and rows or two tables, that gives back its memory at its end."""

    def run(left, right):
        try:
            return f(left, right)
        finally:
            give_back()

    return run
