"""Vectorised work on the bytes of many texts at once.

Texts come as Arrow strings. They are handled in blocks of about one megabyte,
so that temporary arrays stay small however many rows an Arrow batch has. A word
is hashed as a polynomial over random 64-bit values of its bytes (mod 2^64, odd
base), then mixed; a window or shingle is hashed from the hashes of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK_BYTES = 1 << 20
_MASK = (1 << 64) - 1


def splitmix(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    out, x = [], seed & _MASK
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit; works in place."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: The white space of the contracts: x20 and x09 to x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = splitmix(7, 256) | U(1)
#: The value of each byte in a word's hash, as it is and with A-Z lowered.
EXACT = _BYTES.copy()
LOWER = _BYTES.copy()
LOWER[65:91] = _BYTES[97:123]
EXACT[SPACE] = LOWER[SPACE] = U(0)
_BASE = int(splitmix(11, 1)[0]) | 1
_powers: dict[str, np.ndarray] = {}


def _power(n: int, inverse: bool) -> np.ndarray:
    key = "inverse" if inverse else "power"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + (BLOCK_BYTES >> 2))
        base = np.full(size, pow(_BASE, -1, 1 << 64) if inverse else _BASE, dtype=U)
        base[0] = U(1)
        have = np.multiply.accumulate(base)
        if n <= BLOCK_BYTES * 4:  # the powers for one huge text are not kept
            _powers[key] = have
    return have[:n]


def plain(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The texts as one large_string array without nulls (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if isinstance(texts, pa.ChunkedArray):  # no chunk at all
        texts = pa.array([], pa.large_string())
    texts = texts.cast(pa.large_string())
    return texts.fill_null("") if texts.null_count else texts


def blocks(texts: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, their bytes, offsets within these bytes); a text is never cut."""
    arr = plain(texts)
    if not len(arr):
        return
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(arr):
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), len(arr))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def spans(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the count of words of each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    inside = ~space[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offs[:-1][np.diff(offs) > 0]
    tails = offs[1:][np.diff(offs) > 0] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def word_hashes(data: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; the table is 0 for bytes outside words."""
    if not len(starts):
        return np.zeros(0, dtype=U)
    values = table[data]
    values *= _power(len(data), False)
    out = np.add.reduceat(values, starts)
    out *= _power(len(data), True)[starts]
    return mix(out)


def windows(words: np.ndarray, counts: np.ndarray, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word (of the block) and text of each k consecutive words of one text."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(of[:m] == of[k - 1 :])
    base = splitmix(seed, 1)[0] | U(1)
    acc = words[:m].copy()
    for i in range(1, k):
        acc *= base
        acc += words[i : i + m]
    return mix(acc[at]), at, of[at]


def shingles(words: np.ndarray, counts: np.ndarray, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """As windows, in order of the texts: the hashes and the count for each text; a text of fewer words has its whole sequence as one, an empty one none."""
    h, _, of = windows(words, counts, k, seed)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])
        extra = np.zeros(len(short), dtype=U)
        base = splitmix(seed + 101, 1)[0] | U(1)
        for i in range(k - 1):
            more = counts[short] > i
            extra[more] = extra[more] * base + words[first[short[more]] + i]
        extra = mix(extra + counts[short].astype(U))
        order = np.argsort(np.concatenate([of, short]), kind="stable")
        h = np.concatenate([h, extra])[order]
        of = np.concatenate([of, short])[order]
    return h, np.bincount(of, minlength=len(counts)).astype(np.int64)


def sets(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and how many."""
    out, sizes, at = [], np.zeros(len(counts), np.int64), 0
    for i, c in enumerate(counts.tolist()):
        if c:
            own = np.sort(h[at : at + c])
            keep = np.empty(c, dtype=bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
            out.append(own)
            sizes[i] = len(own)
            at += c
    return np.concatenate(out) if out else np.zeros(0, dtype=U), sizes


def totals(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths, 0 for empty ones."""
    out = np.zeros(len(counts), dtype=values.dtype)
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full])
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All the indices of many ranges, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)
