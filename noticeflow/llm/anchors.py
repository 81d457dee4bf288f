"""Anchors: positions of a text that every long enough string picks by its content alone.

A string of ``LENGTH`` bytes has LENGTH - GRAM + 1 grams of ``GRAM`` bytes; its anchor is the gram with
the least hash, the leftmost of equal ones. Wherever the string stands it picks the same anchor, so two
texts that share such a string share an anchor whose surroundings agree around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

LENGTH, GRAM = 50, 20
WINDOW = LENGTH - GRAM + 1
SIDE = WINDOW - 1  # bytes on either side that strings with this anchor can reach
CONTEXT = SIDE + GRAM + SIDE
PAD = 64
CHUNK = 1 << 18

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass
class Found:
    """Anchors of some texts; ``doc`` is the text's place in the list."""

    doc: np.ndarray
    start: np.ndarray  # byte where the gram starts in its text
    gram: np.ndarray  # hash of the gram
    context: np.ndarray  # hash of the gram with its surroundings and of how far these reach
    left: np.ndarray  # bytes of surroundings there are on the left, SIDE at most
    right: np.ndarray


def _words(buffer: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on, as a number."""
    n = len(buffer) - 7
    return np.lib.stride_tricks.as_strided(buffer[:8].view(np.uint64), (n,), (1,))


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= _K3
    h ^= h >> np.uint64(32)
    return h


def hashed(buffer: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash (64 and 32 bits) of the ``LENGTH`` bytes from each of some positions on."""
    high, low = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    if len(at):
        words = _words(buffer)
        for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            w = words[at + k]
            high = (high + w) * _K2
            high ^= high >> np.uint64(31)
            low = (low ^ w) * _K1
            low ^= low >> np.uint64(29)
    return _mix(high), (_mix(low) >> np.uint64(32)).astype(np.uint32)


def _chunk(buffer: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, first: int) -> Found:
    """Anchors of texts that stand in one buffer, each with ``PAD`` zero bytes around it."""
    words = _words(buffer)
    n = len(buffer) - GRAM + 1
    h = np.ascontiguousarray(words[:n])
    h *= _K1
    h += words[8 : n + 8]
    h *= _K2
    h += words[12 : n + 12]
    h = _mix(h)
    bits = np.uint64(max(18, int(len(buffer)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    v = (h & ~low) | np.arange(n, dtype=np.uint64)
    reach = 1
    while 2 * reach <= WINDOW:
        v = np.minimum(v[:-reach], v[reach:])
        reach *= 2
    if reach < WINDOW:
        v = np.minimum(v[: len(v) - (WINDOW - reach)], v[WINDOW - reach :])
    counts = np.maximum(0, sizes - LENGTH + 1)
    doc = np.repeat(np.arange(len(sizes)), counts)
    ends = np.cumsum(counts)
    at = np.arange(len(doc)) - np.repeat(ends - counts, counts) + np.repeat(offsets, counts)
    pick = (v[at] & low).astype(np.int64)
    new = np.ones(len(pick), bool)
    new[1:] = pick[1:] != pick[:-1]
    pick, doc = pick[new], doc[new]
    start = pick - offsets[doc]
    left = np.minimum(SIDE, start)
    right = np.minimum(SIDE, sizes[doc] - start - GRAM)
    context = (left * 64 + right).astype(np.uint64)
    for k in range(0, CONTEXT, 8):
        context *= _K2
        context += words[pick - SIDE + k]
        context ^= context >> np.uint64(31)
    gram = _mix(h[pick] * _K1)  # anchors have small hashes by choice; mixed anew they spread evenly
    return Found(doc + first, start, gram, _mix(context), left.astype(np.uint8), right.astype(np.uint8))


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > CHUNK:
            yield begin, i
            begin, total = i, 0
        total += len(t) + PAD
    if begin < len(texts):
        yield begin, len(texts)


def anchors(texts: list[bytes]) -> Found:
    """The anchors of a list of texts, in the order of the texts and of their places."""
    found = []
    for a, b in _chunks(texts):
        pad = bytes(PAD)
        buffer = np.frombuffer(pad + pad.join(texts[a:b]) + pad, np.uint8)
        sizes = np.array([len(t) for t in texts[a:b]])
        offsets = PAD + np.concatenate(([0], np.cumsum(sizes + PAD)[:-1]))
        found.append(_chunk(buffer, offsets, sizes, a))
    if not found:
        none = np.zeros(0, np.int64)
        return Found(none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint8), none.astype(np.uint8))
    return Found(*(np.concatenate([getattr(f, k) for f in found]) for k in Found.__dataclass_fields__))
