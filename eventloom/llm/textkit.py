"""Vectorised text primitives shared by the corpus operators.

Everything works on numpy arrays of bytes or of word hashes, so that one call handles a whole
document (or a long slice of one) without a Python step per byte.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: The bytes that separate words: space and the controls from tab to carriage return.
SPACE_BYTES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])

_U64 = np.uint64
_FULL = _U64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True

_powers: dict[int, np.ndarray] = {}


def _byte_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)


BYTE_NAMES = _byte_table(7)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept and grown in powers of two."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def prefix_hash(names: np.ndarray) -> np.ndarray:
    """Prefix sums of names[i] * base ** i; :func:`span_hash` reads substring hashes from them."""
    out = np.zeros(len(names) + 1, dtype=np.uint64)
    np.cumsum(names * powers(_BASE, len(names)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The 64-bit names of the spans [start, end): equal spans have equal names."""
    inverse = powers(_BASE_INV, len(prefix))
    return mix64((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def window_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """The names of all windows of `size` items, by start."""
    n = len(prefix) - size
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return mix64((prefix[size:] - prefix[:n]) * powers(_BASE_INV, n))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not in SPACE_BYTES."""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_IS_SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    return edge[0::2], edge[1::2]


#: Bytes up to which words are named eight at a time, all at once; longer ones are named one by one.
LONG_WORD = 64


def word_names(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit names of the words of a text: each eight bytes are mixed in before the next."""
    start, end = word_spans(data)
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    padded = np.frombuffer(data + bytes(8), np.uint8)
    eights = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    size = end - start
    names = mix64(size.astype(np.uint64) * _U64(_BASE))
    left = np.arange(len(start))
    for at in range(0, LONG_WORD, 8):
        held = np.minimum(size[left] - at, 8)
        part = eights[start[left] + at] & (_FULL >> ((8 - held) * 8).astype(np.uint64))
        names[left] = mix64((names[left] ^ part) * _U64(_BASE) + _U64(at))
        left = left[size[left] > at + 8]
        if not len(left):
            break
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        names[k] = xxhash.xxh64_intdigest(data[start[k] : end[k]], 11)
    return start, end, names


def all_word_names(texts: list[bytes], most: int = 8 << 20) -> list[np.ndarray]:
    """The names of the words of each text; short texts are named together."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0

    def named() -> None:
        start, _, names = word_names(b" ".join(group))
        edges = np.cumsum([0, *(len(t) + 1 for t in group)])
        cuts = np.searchsorted(start, edges)
        out.extend(names[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))

    for text in texts:
        group.append(text)
        held += len(text)
        if held >= most:
            named()
            group, held = [], 0
    if group:
        named()
    return out


def selected(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` consecutive gram names, the position of its smallest (leftmost of equals).

    The choice depends on nothing but the window's content, so equal windows choose the same
    position within themselves, wherever they stand.
    """
    if len(grams) < width:
        return np.zeros(0, np.int64)
    low = _U64((1 << 26) - 1)
    if len(grams) > 1 << 26:
        raise ValueError("slice the input: more than 2 ** 26 grams at once")
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        rest = width - span
        least = np.minimum(least[: len(least) - rest], least[rest:])
    return (least & low).astype(np.int64)


def run_bounds(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1))
    return first, np.concatenate((first[1:], [len(values)])) - 1


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Boolean mask of length n: True within any of the spans [start, end)."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:n]) > 0


def counted(count: np.ndarray) -> np.ndarray:
    """0 .. count - 1 for each count, in one array."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def all_windows(named: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The names of the windows of all sequences, one sequence after the other, and how many each has."""
    length = np.array([len(n) for n in named], np.int64)
    count = np.maximum(length - size + 1, 0)
    if not count.any():
        return np.zeros(0, np.uint64), count
    every = window_hash(prefix_hash(np.concatenate(named)), size)
    return every[np.repeat(np.cumsum(length) - length, count) + counted(count)], count
