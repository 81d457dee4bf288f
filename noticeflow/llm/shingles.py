"""Word shingles as hashes, and improved consistent weighted sampling of weighted sets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SHINGLE = 5
_K = np.uint64(0x9E3779B97F4A7C15)
_K_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACES = np.zeros(256, bool)
_SPACES[list(b" \t\n\r\v\f")] = True
CHUNK = 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Bags:
    """Distinct shingles of texts, by text and hash, with how often each occurs."""

    text: np.ndarray
    shingle: np.ndarray
    count: np.ndarray


def _chunk(raw: list[bytes], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    sizes = np.array([len(r) + 1 for r in raw])
    space = _SPACES[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(len(b), _K))
        back = np.multiply.accumulate(np.full(len(b), _K_INVERSE))
        sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate((b.astype(np.uint64) + np.uint64(1)) * powers)))
        words = mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
        doc = np.searchsorted(np.cumsum(sizes), starts, "right")
        per_doc = np.bincount(doc, minlength=len(raw))
        begin = np.cumsum(per_doc) - per_doc
        n = len(words) - SHINGLE + 1
        parts_doc, parts = [], []
        if n > 0:
            h = np.zeros(n, np.uint64)
            for k in range(SHINGLE):
                h = (h + words[k : n + k]) * _M1
                h ^= h >> np.uint64(29)
            same = doc[:n] == doc[SHINGLE - 1 :]
            parts_doc.append(doc[:n][same])
            parts.append(mixed(h[same]))
        for d in np.flatnonzero((per_doc > 0) & (per_doc < SHINGLE)):
            h = np.zeros(1, np.uint64)
            for w in words[begin[d] : begin[d] + per_doc[d]]:
                h = (h + w) * _M1
                h ^= h >> np.uint64(29)
            parts_doc.append(np.array([d]))
            parts.append(mixed(h + np.uint64(per_doc[d])))
    doc, h = np.concatenate(parts_doc), np.concatenate(parts)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at] + first, h[at], np.diff(np.append(at, len(h)))


def bags(texts: list[str]) -> Bags:
    """The shingles of texts: five words in a row, or all words of a text that has fewer; case is ignored."""
    out = []
    raw: list[bytes] = []
    first = size = 0
    for i, t in enumerate(texts):
        raw.append(t.lower().encode("utf-8", "surrogatepass"))
        size += len(raw[-1])
        if size > CHUNK or i == len(texts) - 1:
            out.append(_chunk(raw, first))
            raw, first, size = [], i + 1, 0
    if not out:
        return Bags(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Bags(*(np.concatenate(x) for x in zip(*out, strict=True)))


class Sampler:
    """Improved consistent weighted sampling: two weighted sets agree in a sample with their weighted Jaccard.

    For each element and hash function there are r, c ~ Gamma(2, 1) and b ~ U(0, 1), drawn from the
    element's hash. With t = floor(ln w / r + b) and y = exp(r (t - b)) the element with the least
    c / (y exp(r)) is the sample, together with its t. Gamma quantiles come from tables.
    """

    def __init__(self, samples: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.samples = samples
        self.odd = rng.integers(1, 1 << 63, samples, np.uint64) * np.uint64(2) + np.uint64(1)
        self.r = np.sort(rng.gamma(2.0, 1.0, (4096, 64)).ravel())[32::64]
        fine = np.sort(rng.gamma(2.0, 1.0, (65_536, 16)).ravel())[8::16]
        self.log_c = np.log(fine)

    def sample(self, shingles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(element's place, t) of each sample of one weighted set."""
        best = np.full(self.samples, np.inf)
        place, level = np.zeros(self.samples, np.int64), np.zeros(self.samples, np.int64)
        log_w = np.log(weights)
        for a in range(0, len(shingles), 512):
            with np.errstate(over="ignore"):
                h = shingles[a : a + 512, None] * self.odd[None, :]
                h ^= h >> np.uint64(32)
                h *= _M2
                h ^= h >> np.uint64(29)
            r = self.r[(h >> np.uint64(52)).astype(np.int64)]
            c = self.log_c[(h >> np.uint64(36) & np.uint64(0xFFFF)).astype(np.int64)]
            b = (h & np.uint64(0xFFFFFF)).astype(np.float64) * (1.0 / (1 << 24))
            t = np.floor(log_w[a : a + 512, None] / r + b)
            score = c - r * (t - b + 1.0)
            at = score.argmin(axis=0)
            column = np.arange(self.samples)
            found = score[at, column]
            better = found < best
            best[better], place[better], level[better] = found[better], at[better] + a, t[at, column][better]
        return place, level

    def keys(self, shingles: np.ndarray, weights: np.ndarray, rows: int) -> np.ndarray:
        """One key for each band of ``rows`` samples."""
        place, level = self.sample(shingles, weights)
        with np.errstate(over="ignore"):
            own = mixed(shingles[place] + level.astype(np.uint64) * _K)
            h = np.zeros(self.samples // rows, np.uint64)
            for k in range(rows):
                h = (h + own[k::rows][: len(h)]) * _M1
                h ^= h >> np.uint64(29)
        return mixed(h).astype(np.int64)
