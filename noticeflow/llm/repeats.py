"""Maximal repeats of a set of byte strings: enhanced suffix array and interval tree.

Suffixes are sorted, neighbours get the length of their common prefix, and a stack scan of these lengths
yields the tree of common-prefix intervals. An interval is a maximal repeat where its occurrences are
preceded by different bytes; otherwise a longer repeat one byte to the left holds the same occurrences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Suffixes:
    """Sorted suffixes that begin with at least ``least`` bytes of their string."""

    string: np.ndarray
    start: np.ndarray
    common: np.ndarray  # bytes shared with the suffix before, 0 for the first
    before: np.ndarray  # the byte in front; from 256 on where it is not known or there is none


def padded(strings: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Strings of equal width, zero outside of ``first`` to ``last``, with room to read words beyond their end."""
    n, width = strings.shape
    out = np.zeros((n, 2 * width + 8), np.uint8)
    inside = np.arange(width)[None, :]
    out[:, :width] = np.where((inside >= first[:, None]) & (inside < last[:, None]), strings, 0)
    return out


def suffixes(rows: np.ndarray, first: np.ndarray, last: np.ndarray, string: np.ndarray, start: np.ndarray) -> Suffixes:
    """Some suffixes of padded strings, given by string and start, in order."""
    room = rows.shape[1]
    n_words = -(-(room - 8) // 16)
    flat = rows.ravel()
    at = string * room + start
    words = [flat[at[:, None] + np.arange(8 * k, 8 * k + 8)].view(">u8").ravel().astype(np.uint64) for k in range(n_words)]
    order = np.lexsort(words[::-1])
    string, start, at = string[order], start[order], at[order]
    common = np.zeros(len(order), np.int64)
    same = np.ones(max(0, len(order) - 1), bool)
    for w in words:
        w = w[order]
        differ = w[1:] ^ w[:-1]
        # leading equal bytes of the word, counted while all words before were equal
        equal = np.zeros(len(differ), np.int64)
        for k in range(1, 9):
            equal += (differ >> np.uint64(64 - 8 * k)) == 0
        common[1:][same] += equal[same]
        same &= differ == 0
    ends = last[string] - start
    if len(common) > 1:
        common[1:] = np.minimum(common[1:], np.minimum(ends[1:], ends[:-1]))
    unknown = start == first[string]
    before = np.where(unknown, 0, flat[np.maximum(at - 1, 0)]).astype(np.int64)
    before[unknown] = 256 + np.flatnonzero(unknown)
    return Suffixes(string, start, common, before)


def intervals(common: np.ndarray, before: np.ndarray, owner: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """Maximal repeats (length, first, last, least owner) of sorted suffixes, inner ones before outer ones.

    All occurrences of a repeat are the suffixes from first to last.
    """
    out = []
    n = len(common)
    long = np.flatnonzero(common >= least)
    if not len(long):
        return out
    cuts = np.flatnonzero(np.diff(long) > 1) + 1
    for run in np.split(long, cuts):
        lo, hi = int(run[0]) - 1, int(run[-1])
        lengths, front, own = common[lo : hi + 2].tolist(), before[lo : hi + 1].tolist(), owner[lo : hi + 1].tolist()
        # stack of (length, first, byte in front or -1 if they differ, least owner)
        stack = [[0, 0, front[0], own[0]]]
        for i in range(1, hi - lo + 2):
            length = lengths[i] if i <= hi - lo and lo + i < n else 0
            if length < least:
                length = 0
            first, byte, least_owner = i - 1, front[i - 1], own[i - 1]
            while stack and stack[-1][0] > length:
                size, first, seen, o = stack.pop()
                byte = seen if seen == byte else -1
                least_owner = min(o, least_owner)
                if byte == -1:
                    out.append((size, lo + first, lo + i - 1, least_owner))
            if stack and stack[-1][0] == length:
                top = stack[-1]
                top[2] = top[2] if top[2] == byte else -1
                top[3] = min(top[3], least_owner)
            else:
                stack.append([length, first, byte, least_owner])
    return out


def covered(strings: np.ndarray, first: np.ndarray, last: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string the span that maximal repeats shared with a smaller owner cover, (0, 0) if none.

    The strings are aligned: what they share stands at the same place in each. So suffixes are taken start
    by start, which bounds the memory; spans of one string are taken together, as they overlap.
    """
    rows = padded(strings, first, last)
    lo = np.full(len(strings), 255, np.int64)
    hi = np.zeros(len(strings), np.int64)
    for start in range(strings.shape[1] - least + 1):
        chosen = np.flatnonzero((first <= start) & (last - start >= least))
        if len(chosen) < 2:
            continue
        found = suffixes(rows, first, last, chosen, np.full(len(chosen), start))
        own = owner[found.string]
        for length, a, b, smallest in intervals(found.common, found.before, own, least):
            later = found.string[a : b + 1][own[a : b + 1] > smallest]
            lo[later] = np.minimum(lo[later], start)
            hi[later] = np.maximum(hi[later], start + length)
    lo[hi == 0] = 0
    return lo, hi
