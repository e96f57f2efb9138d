"""Vectorised 64-bit hashes of words, windows and shingles of a text, for use inside tasks.

Prefix sums of ``byte * base ** position`` modulo 2**64 give the hash of every
substring by one subtraction; the base is odd, so its powers have inverses.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
# The bytes that separate words.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PART = 1 << 22
_powers = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, kept while they grow."""
    if not _powers or len(_powers["up"]) < n:
        size = 1 << max(16, int(n).bit_length())
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            steps = np.full(size, base, dtype=U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the word (the finaliser of a splittable generator)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix(values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum((values.astype(U) + U(1)) * up, out=out[1:])
    return out


def windows(values: np.ndarray, size: int, sums: np.ndarray | None = None, salt: int = 0) -> np.ndarray:
    """The hash of each run of ``size`` values; empty where there are fewer."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    sums = prefix(values) if sums is None else sums
    return mix((sums[size:] - sums[:n]) * powers(n)[1] + U(salt))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one byte of each word."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~BLANK[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, last-plus-one byte) of each word of UTF-8 bytes."""
    first, last = word_spans(data)
    if not len(first):
        return np.zeros(0, dtype=U), first, last
    if len(data) > PART and len(first) > 1:
        # long texts in parts that end between words, to bound memory
        cuts = np.unique(np.searchsorted(first, np.arange(PART, len(data), PART)))
        found = [(lo, words(data[first[lo]:last[hi - 1]])[0]) for lo, hi in zip([0, *cuts], [*cuts, len(first)], strict=True) if hi > lo] \
            if cuts.size and (cuts[0] > 0 or len(cuts) > 1 or cuts[-1] < len(first)) and np.diff([0, *cuts, len(first)]).max() < len(first) else None
        if found:
            return np.concatenate([h for _, h in found]), first, last
    sums, down = prefix(data), powers(len(data))[1]
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(U)), first, last


def utf8(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return np.frombuffer(data.tobytes().lower(), dtype=np.uint8)


def shingles(text: str | None, size: int = 5, lower: bool = True) -> np.ndarray:
    """Sorted distinct shingle hashes; shorter texts give one for all their words, texts without words none."""
    data = utf8(text)
    h, _, _ = words(lowered(data) if lower else data)
    if not len(h):
        return np.zeros(0, dtype=U)
    return np.unique(windows(h, min(size, len(h)), salt=len(h) if len(h) < size else 0))


PLACE_BITS = 18


def least(values: np.ndarray, span: int) -> np.ndarray:
    """Position of the least value in each window of ``span``; values count by their leading bits, the leftmost of equals.

    The position stands in the trailing bits, so one minimum finds both; at most 2 ** PLACE_BITS values.
    """
    places = U((1 << PLACE_BITS) - 1)
    cur, k = values & ~places | np.arange(len(values), dtype=U), 1
    while 2 * k <= span:
        cur = np.minimum(cur[k:], cur[:-k])
        k *= 2
    n, gap = len(values) - span + 1, span - k
    return (np.minimum(cur[gap:gap + n], cur[:n]) & places).astype(np.int64)


def identifiers(grams: np.ndarray, gram: int, size: int, at: np.ndarray) -> np.ndarray:
    """Identifiers of the windows of ``size`` at some positions, from those of ``gram``.

    The identifier of twice a length is made of those at the position and one length later, again
    and again; the last step takes two that overlap.
    """
    length = gram
    while 2 * length <= size:
        length *= 2
    if size > length:
        return pair(identifiers(grams, gram, length, at), identifiers(grams, gram, length, at + (size - length)))
    if length == gram:
        return grams[at]
    return pair(identifiers(grams, gram, length // 2, at), identifiers(grams, gram, length // 2, at + length // 2))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U(0x9E3779B97F4A7C15) + b)
