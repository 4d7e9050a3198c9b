"""Content-defined anchors of byte strings, for whole batches at once.

An anchor is the start of a q-gram whose hash is the least of some window of q-grams that together span
``length`` bytes.  So every string of that length has an anchor inside, and equal strings have it at
the same place.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from factloom.llm.wordhash import BLOCK, _BYTES, powers, scrambled

_U = np.uint64


def slid(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every window of ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return x if span == width else pick(x[: len(x) - (width - span)], x[width - span :])


def gram_hashes(raw: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at each place of a byte array of q bytes or more."""
    up, down = powers(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTES[raw] * up[: len(raw)])])
    return scrambled((sums[q:] - sums[:-q]) * down[: len(raw) - q + 1])


def _of(raw: np.ndarray, inside: np.ndarray | None, length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    hashes = gram_hashes(raw, q)
    rank = (hashes >> _U(32)).astype(np.uint32)
    if inside is not None:
        rank[~inside[: len(rank)]] = 0xFFFFFFFF
    width = length - q + 1
    if len(rank) < width:
        at = np.flatnonzero(rank == rank.min())
    else:
        least = slid(rank, width, np.minimum)
        pad = np.zeros(width - 1, np.uint32)
        at = np.flatnonzero(slid(np.concatenate([pad, least, pad]), width, np.maximum) == rank)
    if inside is not None:
        at = at[inside[at]]
    return at, hashes[at]


def anchors(texts: Iterable[bytes], length: int, q: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the places and hashes of its anchors; none for texts shorter than ``length``."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        if group and size + len(text) > BLOCK:
            yield from _group(group, length, q)
            group, size = [], 0
        if len(text) > BLOCK:
            yield _long(text, length, q)
            continue
        group.append(text)
        size += len(text)
    if group:
        yield from _group(group, length, q)


def _long(text: bytes, length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    raw, places, hashes = np.frombuffer(text, np.uint8), [], []
    for at in range(0, len(raw), BLOCK):
        part = raw[at : at + BLOCK + length]
        if len(part) >= length or at == 0:
            p, h = _of(part, None, length, q)
            places.append(p + at)
            hashes.append(h)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(hashes)[first]


def _group(group: list[bytes], length: int, q: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    none = np.zeros(0, np.int64), np.zeros(0, _U)
    kept = [t for t in group if len(t) >= length]
    if not kept:
        yield from (none for _ in group)
        return
    raw = np.frombuffer(b"".join(kept), np.uint8)
    ends = np.cumsum([len(t) for t in kept])
    inside = np.ones(len(raw), bool)
    for end in ends:  # q-grams that would cross into the next text
        inside[end - q + 1 : end] = False
    at, hashes = _of(raw, inside, length, q)
    cuts = np.searchsorted(at, ends)
    start = first = i = 0
    for text in group:
        if len(text) < length:
            yield none
            continue
        yield at[first : cuts[i]] - start, hashes[first : cuts[i]]
        start, first, i = ends[i], cuts[i], i + 1
