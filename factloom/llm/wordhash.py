"""Hashes of words and of word shingles, for whole batches of texts at once.

Words are maximal runs of bytes outside U+0020 and U+0009..U+000D.  A word's hash is a polynomial in its
bytes, read off prefix sums over the batch; shingle hashes combine word hashes, so the kind and
number of separators between words do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BLOCK = 1 << 19  # bytes hashed at once; a longer text is cut between words
_U = np.uint64
_GAPS = np.zeros(256, bool)
_GAPS[[0x20, *range(0x09, 0x0E)]] = True


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return scrambled(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed * 0x632BE59BD9B4E019 % 2**64))


_BYTES = numbers(256, 1)
_BASE = int(numbers(1, 2)[0]) | 1
_ORDER = numbers(64, 3) | _U(1)
_powers = np.ones(1, _U), np.ones(1, _U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, at least n of them."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            _powers = tuple(
                np.concatenate([np.ones(1, _U), np.cumprod(np.full(size - 1, b, _U))])
                for b in (_BASE, pow(_BASE, -1, 2**64))
            )
    return _powers


def _of(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a buffer."""
    raw = np.frombuffer(buffer, np.uint8)
    gap = np.concatenate([[True], _GAPS[raw], [True]])
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[0::2], edges[1::2]
    up, down = powers(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTES[raw] * up[: len(raw)])])
    return starts, scrambled((sums[ends] - sums[starts]) * down[starts])


def _long(text: bytes) -> np.ndarray:
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        while end < len(text) and not _GAPS[text[end]]:
            end += 1
        parts.append(_of(text[at:end])[1])
        at = end
    return np.concatenate(parts)


def word_hashes(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, in order."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        if group and size + len(text) > BLOCK:
            yield from _group(group)
            group, size = [], 0
        if len(text) > BLOCK:
            yield _long(text)
            continue
        group.append(text)
        size += len(text) + 1
    if group:
        yield from _group(group)


def _group(group: list[bytes]) -> Iterator[np.ndarray]:
    starts, hashes = _of(b"\n".join(group))
    ends = np.cumsum([len(t) + 1 for t in group])
    cuts = np.searchsorted(starts, ends)
    at = 0
    for cut in cuts:
        yield hashes[at:cut]
        at = cut


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles in order; fewer words are one shingle, none are none."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return scrambled((words * _ORDER[:n]).sum(keepdims=True, dtype=_U) + _U(n))
    total = words[: n - k + 1] * _ORDER[0]
    for i in range(1, k):
        total = total + words[i : n - k + 1 + i] * _ORDER[i]
    return scrambled(total)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles."""
    found = np.sort(shingles(words, k))
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found
