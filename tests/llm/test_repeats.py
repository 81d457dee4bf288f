"""Maximal repeats against brute force."""

import random

import numpy as np

from noticeflow.llm import anchors, repeats


def strings(r, n, width):
    letters = r.choice([b"ab", b"abc", b"abcdefgh"])
    s = np.array([[r.choice(letters) for _ in range(width)] for _ in range(n)], np.uint8)
    for _ in range(3):
        i, j, p = r.randrange(n), r.randrange(n), r.randrange(width - 8)
        s[i, p : p + 8] = s[j, p : p + 8]
    first = np.array([r.randint(0, 4) for _ in range(n)])
    last = np.array([r.randint(width - 8, width) for _ in range(n)])
    return s, first, last, np.array([r.randint(0, 5) for _ in range(n)])


def test_intervals_hold_all_occurrences():
    r = random.Random(3)
    for _ in range(120):
        s, first, last, owner = strings(r, r.randint(1, 12), 24)
        least = 5
        rows = repeats.padded(s, first, last)
        pairs = [(i, p) for i in range(len(s)) for p in range(first[i], last[i] - least + 1)]
        if not pairs:
            continue
        found = repeats.suffixes(rows, first, last, *np.array(pairs).T)
        own = owner[found.string]
        cover = [np.zeros(24, bool) for _ in s]
        for length, a, b, smallest in repeats.intervals(found.common, found.before, own, least):
            assert smallest == min(own[a : b + 1])
            said = {bytes(s[found.string[i], found.start[i] : found.start[i] + length]) for i in range(a, b + 1)}
            assert len(said) == 1
            text = said.pop()
            held = sum(bytes(s[i, p : p + length]) == text and p + length <= last[i] for i, p in pairs)
            assert held == b - a + 1  # all occurrences, not just neighbours
            for i in range(a, b + 1):
                if own[i] > smallest:
                    cover[found.string[i]][found.start[i] : found.start[i] + length] = True
        for i in range(len(s)):
            want = np.zeros(24, bool)
            for p in range(first[i], last[i] - least + 1):
                g = bytes(s[i, p : p + least])
                if any(owner[k] < owner[i] and g in bytes(s[k, first[k] : last[k]]) for k in range(len(s))):
                    want[p : p + least] = True
            assert (want == cover[i]).all()


def test_equal_strings_pick_equal_anchors():
    r = random.Random(4)
    text = lambda n: bytes(r.choice(b"abcd ") for _ in range(n))
    shared = text(anchors.LENGTH)
    texts = [text(r.randint(0, 90)) + shared + text(r.randint(0, 90)) for _ in range(20)] + [b"", b"short", b"a" * 300]
    found = anchors.anchors(texts)
    picked = []
    for k, t in enumerate(texts[:20]):
        at = t.index(shared)
        own = found.start[found.doc == k]
        inside = {int(p) - at for p in own if at <= p <= at + anchors.LENGTH - anchors.GRAM}
        assert inside
        picked.append(inside)
    assert set.intersection(*picked)
    assert set(found.doc.tolist()) == {*range(20), 22}
