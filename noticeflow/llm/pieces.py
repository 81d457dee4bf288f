"""SentencePiece encoding with N-best segmentations, and decoding.

A text is a lattice over its characters whose edges are the vocabulary's pieces with their stored
scores. A forward Viterbi pass gives every position the score of the best way to it. Backward A* search
from the end then yields segmentations from best to worst: the forward scores are exact heuristics for
what remains to the beginning, so each path popped from the agenda is the next best.

No piece of a vocabulary reaches across the start of a word (checked when it is loaded; otherwise the
whole text is one stretch). Stretches between word starts are therefore solved one by one and kept in a
cache; a text's N best combine those of its stretches. A text's N best can differ from its best only in
the N - 1 stretches whose second-best segmentation costs least, so only these are searched further.

Edge cases: a null text is the empty text, which has one segmentation with no pieces; a character that
no piece has becomes its UTF-8 bytes' pieces (or the unknown id) at the vocabulary's least score less 10;
of equally good segmentations the one with longer last pieces comes first; fewer than N exist for short
texts; decoding drops the dummy space in front and turns unknown ids into U+2047; ids that aren't in the
vocabulary are an error; equal texts get equal results; an empty table gives an empty table; columns of
the input pass through, those named as new ones are replaced.

The N best are given as changes to the best ids (``changed`` applies them), so that N long texts aren't
written where a few words differ. The best ids of a stretch and the cost of its second-best segmentation come
from one Viterbi pass; the A* search runs in the few stretches that the text's N best can differ in.

Scale: a map over rows without a shuffle, a batch of texts at a time: each text is a list of numbers of
kept stretches, and ids, scores and costs are gathered by number. What is kept is emptied between batches
when it outgrows a fixed size.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import count

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import small_batches, text_of

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
N_BEST = 5
TOGETHER, LEAST_TOGETHER = 4096, 48  # stretches of one length that are solved at once
CACHED_STRETCHES, CACHED_CHARACTERS, CACHED_SEARCHES = 600_000, 12_000_000, 20_000
_WORST = float("-inf")
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: Runs of letters, of line ends and of other characters: a stretch may be cut between them.
_RUNS = re.compile(r"[^\W\d_]+|\n+|[^\S\n]+|[^\w\s]+|[\d_]+|\s+")


def _key(stretch: str) -> str:
    """What a stretch is kept by: itself without its mark in front, or with a space where it has none."""
    return stretch[1:] if stretch[:1] == SPACE else " " + stretch


def _stretch(key: str) -> str:
    return key[1:] if key[:1] == " " else SPACE + key


@dataclass
class Segmented:
    """A text's best ids and score, and its n best segmentations as (score, changes to the best ids).

    A change (start, stop, ids) puts ids in place of the best ids from start to stop.
    """

    ids: np.ndarray
    score: float
    nbest: list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]


class Kept(dict):
    """Stretches solved so far: a number for each key; by number the score, the cost of the second best, and ids."""

    def __init__(self, solve: Callable[[str], tuple[float, list[int], float]]) -> None:
        self.solve = solve
        self.start()

    def start(self) -> None:
        self.clear()
        self.scores, self.costs, self.ends, self.ids, self.characters = array("d"), array("d"), array("q", [0]), array("i"), 0

    def __missing__(self, key: str) -> int:
        score, ids, cost = self.solve(key)
        n = self[key] = len(self.scores)
        self.scores.append(score)
        self.costs.append(cost)
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        self.characters += len(key)
        return n

    def add(self, keys: Sequence[str], scores: np.ndarray, costs: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Take in many stretches at once; none of them is kept already."""
        self.update(zip(keys, range(len(self.scores), len(self.scores) + len(keys)), strict=True))
        self.scores.frombytes(scores.astype(np.float64).tobytes())
        self.costs.frombytes(costs.astype(np.float64).tobytes())
        self.ends.frombytes((self.ends[-1] + np.cumsum(sizes)).astype(np.int64).tobytes())
        self.ids.frombytes(ids.astype(np.int32).tobytes())
        self.characters += sum(map(len, keys))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.scores), np.array(self.costs), np.array(self.ends), np.array(self.ids, np.int32)

    def full(self) -> bool:
        return len(self) > CACHED_STRETCHES or self.characters > CACHED_CHARACTERS


class Trie:
    """Beginnings of pieces as numbered nodes, for Viterbi passes over many stretches of one length at once.

    Steps (node, character) are keys of a hash table that is mostly empty; a place that another key has
    leads on to the next one.
    """

    BITS = 21  # of a character

    def __init__(self, scores: dict[str, float], ids: dict[str, int]) -> None:
        nodes = {"": 0}
        for piece in scores:
            for k in range(1, len(piece) + 1):
                nodes.setdefault(piece[:k], len(nodes))
        self.score = np.array([scores.get(p, _WORST) for p in nodes])
        self.id = np.array([ids.get(p, -1) for p in nodes], np.int32)
        self.longest = max(map(len, nodes))
        bits = (16 * len(nodes)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.key = np.full(1 << bits, -1, np.int64)
        self.next = np.zeros(1 << bits, np.int32)
        key = np.array([nodes[p[:-1]] << self.BITS | ord(p[-1]) for p in nodes if p], np.int64)
        node = np.arange(1, len(nodes), dtype=np.int32)
        at = self._place(key)
        while len(key):
            free = self.key[at] < 0
            at_free, first = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.key[at_free], self.next[at_free] = key[chosen], node[chosen]
            left = np.delete(np.arange(len(key)), chosen)
            key, node, at = key[left], node[left], (at[left] + 1) % len(self.key)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, character: np.ndarray) -> np.ndarray:
        """The nodes that characters lead to, 0 where there is none."""
        key = node.astype(np.int64) << self.BITS | character
        at = self._place(key)
        found = self.key[at]
        out = np.where(found == key, self.next[at], 0)
        other = np.flatnonzero((found != key) & (found >= 0))
        while len(other):
            at[other] = (at[other] + 1) % len(self.key)
            found = self.key[at[other]]
            same = found == key[other]
            out[other[same]] = self.next[at[other[same]]]
            other = other[~same & (found >= 0)]
        return out

    def solve(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores, costs of the second best, numbers of ids and ids of stretches of one length whose characters all are pieces."""
        n, size = len(texts), len(texts[0])
        text = np.ascontiguousarray(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).T).ravel()
        deep = min(size, self.longest)
        edge = np.full((deep, size, n), _WORST)  # score of the piece by its characters less one, where it begins, and stretch
        ids = np.zeros((deep, size, n), np.int32)
        live, node = np.arange(size * n), np.zeros(size * n, np.int32)
        for d in range(deep):
            inside = live < (size - d) * n
            live, node = live[inside], node[inside]
            node = self.step(node, text[live + d * n])
            live, node = live[node > 0], node[node > 0]
            edge[d].reshape(-1)[live] = self.score[node]
            ids[d].reshape(-1)[live] = self.id[node]
        first, second = np.full((size + 1, n), _WORST), np.full((size + 1, n), _WORST)
        back = np.zeros((size + 1, n), np.int64)
        first[0] = 0.0
        for end in range(1, size + 1):
            for wide in range(min(end, deep), 0, -1):
                score = edge[wide - 1, end - wide]
                x, f = first[end - wide] + score, first[end]
                better = x > f
                second[end] = np.where(better, np.maximum(f, second[end - wide] + score), np.maximum(second[end], x))
                first[end] = np.maximum(x, f)
                back[end][better] = wide
        out = np.full((size, n), -1, np.int32)  # filled from the end
        end, own = np.full(n, size), np.arange(n)
        for k in range(size):
            wide = back[end[own], own]
            out[size - 1 - k, own] = ids[wide - 1, end[own] - wide, own]
            end[own] -= wide
            own = own[end[own] > 0]
            if not len(own):
                break
        used = out.T >= 0
        return first[size], first[size] - second[size], used.sum(1), out.T[used]


class Lattice:
    """A vocabulary's pieces, with what is kept of the stretches solved so far."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            self._load(sentencepiece_model_pb2.ModelProto.FromString(f.read()))
        self.kept, self.parts = (Kept(lambda key: self.solve(_stretch(key))) for _ in range(2))
        self.known: dict[tuple[str, int], list] = {}

    def _load(self, model) -> None:
        if model.normalizer_spec.precompiled_charsmap:
            raise ValueError("only vocabularies without a character map can be read")
        self.dummy = model.normalizer_spec.add_dummy_prefix
        self.squeeze = model.normalizer_spec.remove_extra_whitespaces
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (_NORMAL, _USER)}
        self.scores = {p.piece: p.score for p in model.pieces if p.type in (_NORMAL, _USER)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == _UNKNOWN)
        self.control = {i for i, p in enumerate(model.pieces) if p.type == _CONTROL}
        self.lost = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.singles = {p for p in self.scores if len(p) == 1}
        self.matches = ahocorasick.Automaton()
        for p, score in self.scores.items():
            self.matches.add_word(p, (len(p), score))
        self.matches.make_automaton()
        self.trie = Trie(self.scores, self.ids)
        #: the text of each id; a byte from 128 on is no text by itself
        self.texts = [p.replace(SPACE, " ") for p in self.pieces]
        for b, i in self.bytes.items():
            self.texts[i] = chr(b) if b < 128 else ""
        for i in self.control:
            self.texts[i] = ""
        self.texts[self.unknown] = " ⁇ "
        self.high = {i for b, i in self.bytes.items() if b >= 128}
        self.words = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.scores)
        #: neighbouring characters inside pieces; between any others a text can be cut
        self.pairs = {p[k : k + 2] for p in self.scores for k in range(len(p) - 1)}

    def edges(self, text: str) -> Iterator[tuple[int, tuple[int, float]]]:
        """(last character, (size, score)) of the edges of a stretch, by their end, the longest first."""
        if self.singles.issuperset(text):
            return self.matches.iter(text)
        return iter(self._edges(text))

    def _edges(self, text: str) -> list[tuple[int, tuple[int, float]]]:
        """The same where some characters are no pieces: each of these is an edge that costs much."""
        found = list(self.matches.iter(text))
        found += [(i, (1, self.lost)) for i, c in enumerate(text) if c not in self.singles]
        return sorted(found, key=lambda x: (x[0], -x[1][0]))

    def piece_ids(self, piece: str) -> list[int]:
        own = self.ids.get(piece)
        if own is not None:
            return [own]
        if self.bytes:
            return [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def solve(self, text: str) -> tuple[float, list[int], float]:
        """A stretch's best score, its ids, and how much worse its second-best segmentation is."""
        n = len(text)
        first, second, back = [_WORST] * (n + 1), [_WORST] * (n + 1), [0] * (n + 1)
        first[0] = 0.0
        for last, (size, score) in self.edges(text):
            end = last + 1
            begin = end - size
            x, f = first[begin] + score, first[end]
            if x > f:
                y = second[begin] + score
                second[end] = f if f > y else y
                first[end], back[end] = x, begin
            elif x > second[end]:
                second[end] = x
        ids, end, own = [], n, self.ids
        while end:
            begin = back[end]
            piece = text[begin:end]
            if piece in own:
                ids.append(own[piece])
            else:
                ids += self.piece_ids(piece)[::-1]
            end = begin
        ids.reverse()
        return first[n], ids, first[n] - second[n]

    def n_best(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a stretch, best first: forward scores, backward A*."""
        kept = self.known.get((text, n))
        if kept is not None:
            return kept
        size = len(text)
        forward = [0.0] + [_WORST] * size
        into: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
        for last, (wide, score) in self.edges(text):
            end = last + 1
            at = end - wide
            into[end].append((at, score))
            if forward[at] + score > forward[end]:
                forward[end] = forward[at] + score
        order = count()
        agenda = [(-forward[size], next(order), size, 0.0, ())]
        out = []
        while agenda and len(out) < n:
            _, _, at, done, path = heapq.heappop(agenda)
            if at == 0:
                ids: list[int] = []
                link = path
                while link:
                    piece, link = link
                    ids += self.piece_ids(piece)
                out.append((done, tuple(ids)))
                continue
            for begin, score in into[at]:
                g = done + score
                heapq.heappush(agenda, (-(g + forward[begin]), next(order), begin, g, (text[begin:at], path)))
        if size <= 16:
            if len(self.known) >= CACHED_SEARCHES:
                self.known.clear()
            self.known[text, n] = out
        return out

    def cut(self, key: str) -> list[str]:
        """The keys of a stretch's parts, between which no piece reaches."""
        if key.isalpha():
            return [key]
        runs = _RUNS.findall(_stretch(key))
        out = [runs[0]]
        for run in runs[1:]:
            if out[-1][-1] + run[0] in self.pairs:
                out[-1] += run
            else:
                out.append(run)
        return list(map(_key, out))

    def learn(self, keys: list[list[str]]) -> None:
        """Solve all stretches that aren't kept: parts of one length together, others from their parts."""
        new = set().union(*keys) - self.kept.keys()
        mixed = sorted(key for key in new if not key.isalpha())
        cuts = list(map(self.cut, mixed))
        self._solve(self.kept, new.difference(mixed))
        self._solve(self.parts, set().union(*cuts) - self.parts.keys())
        if mixed:
            parts, sizes = self.parts, np.array(list(map(len, cuts)))
            at = np.array([parts[p] for own in cuts for p in own], np.int64)
            scores, costs, ends, pool = parts.arrays()
            begins = np.cumsum(sizes) - sizes
            n_ids = ends[at + 1] - ends[at]
            ids = pool[np.repeat(ends[at] - np.cumsum(n_ids) + n_ids, n_ids) + np.arange(n_ids.sum())]
            self.kept.add(mixed, np.add.reduceat(scores[at], begins), np.minimum.reduceat(costs[at], begins), np.add.reduceat(n_ids, begins), ids)

    def _solve(self, kept: Kept, keys: set[str]) -> None:
        by_size: dict[int, list[tuple[str, str]]] = {}
        for key in sorted(keys):
            stretch = _stretch(key)
            if self.singles.issuperset(stretch):
                by_size.setdefault(len(stretch), []).append((key, stretch))
        for own in by_size.values():
            for at in range(0, len(own) - LEAST_TOGETHER, TOGETHER):
                some, texts = zip(*own[at : at + TOGETHER], strict=True)
                kept.add(some, *self.trie.solve(texts))

    def stretches(self, text: str) -> list[str]:
        """A text in stretches, each by its key."""
        if self.squeeze:
            text = " ".join([w for w in text.split(" ") if w])
        if not text:
            return []
        if not self.words or not self.dummy or SPACE in text or "  " in text or text[0] == " ":
            full = ((SPACE if self.dummy else "") + text).replace(" ", SPACE)
            cut = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", full) if self.words else [full]
            return [_key(s) for s in cut]
        return text.split(" ")

    def encode(self, texts: Sequence[str], n: int) -> list[Segmented]:
        """The best ids of each text, and its n best segmentations."""
        if self.kept.full() or self.parts.full():
            self.kept.start()
            self.parts.start()
        keys = [self.stretches(t) for t in texts]
        self.learn(keys)
        numbers = [np.array(list(map(self.kept.__getitem__, k)), np.int64) for k in keys]
        scores, costs, ends, pool = self.kept.arrays()
        out = []
        for own, at in zip(keys, numbers, strict=True):
            begin, size = ends[at], ends[at + 1] - ends[at]
            starts = np.cumsum(size) - size
            ids = pool[np.repeat(begin - starts, size) + np.arange(size.sum())]
            best = float(scores[at].sum())
            out.append(Segmented(ids, best, [(best - c, ch) for c, ch in self._combined(own, at, scores, costs[at], starts, size, ids, n)]))
        return out

    def _combined(self, keys, at, scores, cost, starts, size, ids, n: int) -> list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]:
        """(cost, changes) of a text's n best segmentations.

        They differ from the best one in the n - 1 stretches alone whose second-best segmentation costs least.
        """
        open_to = np.flatnonzero(cost < np.inf)
        if len(open_to) > n - 1:
            near = cost[open_to]
            open_to = open_to[near <= (np.partition(near, n - 2)[n - 2] if n > 1 else -1.0)]
            open_to = open_to[np.argsort(cost[open_to], kind="stable")[: n - 1]]
        results: list[tuple[float, list]] = [(0.0, [])]
        for i in sorted(open_to.tolist()):
            start, stop = int(starts[i]), int(starts[i] + size[i])
            own, score = tuple(ids[start:stop].tolist()), float(scores[at[i]])
            alternatives = [(0.0, [])] + [(score - s, [(start, stop, other)]) for s, other in self.n_best(_stretch(keys[i]), n) if other != own]
            both = [(c + extra, changes + change) for c, changes in results for extra, change in alternatives[:n]]
            results = sorted(both, key=lambda x: x[0])[:n]
        return results

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        if self.high.isdisjoint(ids):
            text = "".join(map(self.texts.__getitem__, ids))
        else:
            whole = b"".join([bytes((self.byte_of[i],)) if i in self.high else self.texts[i].encode() for i in ids])
            text = whole.decode("utf-8", "replace")
        return text[1:] if self.dummy and text[:1] == " " else text


_lattices: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    """The worker's lattice for a vocabulary file."""
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


#: What encoding yields: the best ids, their CRC, whether they decode to the text, the best score, and the n
#: best as changes to the best ids.
ENCODED = (
    "ids array<int>, ids_crc32 long, exact boolean, score double, "
    "nbest array<struct<rank:int,score:double,n_pieces:int,changes:array<struct<start:int,stop:int,ids:array<int>>>>>"
)


def _lists(rows: list[list], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values)


def _nbest(found: list[Segmented]) -> pa.Array:
    """The n best of some texts as one Arrow column."""
    best = [s.nbest for s in found]
    flat = [(rank, score, len(s.ids), changes) for s in found for rank, (score, changes) in enumerate(s.nbest, 1)]
    changes = [c for *_, own in flat for c in own]
    ids = [c[2] for c in changes]
    inner = pa.StructArray.from_arrays(
        [pa.array([c[0] for c in changes], pa.int32()), pa.array([c[1] for c in changes], pa.int32()), _lists(ids, pa.array([i for c in ids for i in c], pa.int32()))],
        ["start", "stop", "ids"],
    )
    sizes = [n + sum(len(c[2]) - (c[1] - c[0]) for c in own) for _, _, n, own in flat]
    columns = [
        pa.array([f[0] for f in flat], pa.int32()),
        pa.array([f[1] for f in flat], pa.float64()),
        pa.array(sizes, pa.int32()),
        _lists([f[3] for f in flat], inner),
    ]
    return _lists(best, pa.StructArray.from_arrays(columns, ["rank", "score", "n_pieces", "changes"]))


def encoded(docs: DataFrame, n: int = N_BEST, text_col: str = "text", vocabulary: str | None = None, out: str = "encoded") -> DataFrame:
    """The rows with a struct of ids, ids_crc32, exact (the ids decode to the text), score and nbest."""
    small_batches(docs.sparkSession)
    path = vocabulary or vocabulary_path()

    @F.arrow_udf(ENCODED)
    def encode(column: pa.Array) -> pa.Array:
        own, texts = lattice(path), column.to_pylist()
        found = own.encode(texts, n)
        ids = [s.ids for s in found]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        exact = [own.decode(s.ids.tolist()) == t for s, t in zip(found, texts, strict=True)]
        columns = [
            _lists(ids, pa.array(flat, pa.int32())),
            pa.array([zlib.crc32(i.astype("<i4").tobytes()) for i in ids], pa.int64()),
            pa.array(exact, pa.bool_()),
            pa.array([s.score for s in found], pa.float64()),
            _nbest(found),
        ]
        return pa.StructArray.from_arrays(columns, ["ids", "ids_crc32", "exact", "score", "nbest"])

    return docs.withColumn(out, encode(text_of(text_col)))


def changed(ids: F.Column, changes: F.Column) -> F.Column:
    """The ids of another segmentation: the best ids with its changes, which are in order and don't overlap."""
    begin = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))

    def put(done: F.Column, c: F.Column) -> F.Column:
        return F.struct(F.concat(done["out"], F.slice(ids, done["at"] + 1, c["start"] - done["at"]), c["ids"]).alias("out"), c["stop"].alias("at"))

    return F.aggregate(changes, begin, put, lambda d: F.concat(d["out"], F.slice(ids, d["at"] + 1, F.size(ids))))


def decoded(rows: DataFrame, ids_col: F.Column, vocabulary: str | None = None, out: str = "decoded") -> DataFrame:
    """The rows with the text of their ids; null ids give null."""
    small_batches(rows.sparkSession)
    path = vocabulary or vocabulary_path()

    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        own = lattice(path)
        return pd.Series([None if x is None else own.decode(x.tolist()) for x in column], dtype=object)

    return rows.withColumn(out, decode(ids_col))
