"""Packing documents into sequences by best-fit decreasing.

A document is its token ids followed by id 1. Documents longer than a sequence are cut into pieces of
the sequence's length, the last one shorter. Pieces go from long to short, each into the open sequence
with the tightest room that still takes it.

What best-fit decreasing does depends only on how many pieces there are of each length. So Spark counts
the lengths (at most ``capacity`` rows), and the packing itself runs over these counts: open sequences
with the same room stand together as a range of numbers, and a segment tree over the possible rooms
finds the tightest one in logarithmic time. Equal pieces are placed as a run at once. The result is a
table of runs (length, ranks, sequences, offset); it is bounded by the capacity, not by the input, as a
range is halved in room whenever it takes pieces. Each piece finds its run by its length and its rank
among the pieces of that length.

Edge cases: a null or empty text is the single id 1; equal rows are packed each for itself; a null id
is kept; an empty table gives an empty table; extra columns are not read.

Scale: texts are read once, by a map that yields a few numbers for each piece. Ranks are counted within
(length, salt), so that a length that a third of all pieces have is spread over many tasks.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.common import small_batches, text_of, written

CAPACITY, END_ID, SALTS = 4096, 1, 256
#: Words kept in each of the two generations of a worker's cache.
CACHED_WORDS = 250_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


#: Fixed value: how the vocabulary's file splits lower-cased text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordIds(dict):
    """Ids of space-separated words as bytes (little-endian uint32), found once and kept for a while.

    White space never gets into an id, so words can be encoded one by one. Words that need the
    tokenizer's own normalisation (added tokens, control characters, text that isn't composed) go
    through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.pattern = regex.compile(WORDS)
        self.letters = _byte_letters()
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def encode(self, word: str) -> bytes:
        if not word:
            return b""
        plain = word.isascii() or (unicodedata.is_normalized("NFC", word) and "Σ" not in word and "İ" not in word)
        if not plain or "<|" in word or not word.isprintable():
            ids = self.whole.encode(word, add_special_tokens=False).ids
            return b"".join(i.to_bytes(4, "little") for i in ids)
        return b"".join([self.part(p) for p in self.pattern.findall(word.lower())])

    def part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= CACHED_WORDS:
                self.parts.clear()
            letters = "".join([self.letters[b] for b in part.encode()])
            found = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])
            if len(part) <= 64:
                self.parts[part] = found
        return found

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.encode(word)
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found

    def ids(self, text: str) -> bytes:
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, words))


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each piece of each document."""
    small_batches(docs.sparkSession)
    end = END_ID.to_bytes(4, "little")
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = ids_of.ids(text) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    for column, value in zip(out, (doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECES, strict=True)], schema=_PIECES)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Rooms:
    """Segment tree over rooms 0..capacity: which have open sequences, as ranges (first number, how many)."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << (capacity + 1).bit_length()
        self.filled = [False] * (2 * self.width)
        self.ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _mark(self, room: int) -> None:
        at = room + self.width
        self.filled[at] = bool(self.ranges[room])
        while at > 1:
            at //= 2
            self.filled[at] = self.filled[2 * at] or self.filled[2 * at + 1]

    def add(self, room: int, first: int, count: int) -> None:
        if count and room:
            self.ranges[room].append((first, count))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        found = self.ranges[room].pop()
        self._mark(room)
        return found

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that an open sequence has."""
        at = least + self.width
        if self.filled[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.filled[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.filled[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


def best_fit_runs(counts: Iterable[tuple[int, int]], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over (length, count): runs of equal pieces, and the number of sequences.

    A run is (length, first rank, rank after the last, first sequence, pieces in each, offset there).
    """
    rooms, runs, opened = Rooms(capacity), [], 0
    for length, count in sorted(counts, reverse=True):
        rank = 0
        while rank < count:
            left = count - rank
            room = rooms.tightest(length)
            if room is None:
                room = capacity
                first, many = opened, -(-left // (capacity // length))
                opened += many
            else:
                first, many = rooms.take(room)
            each = room // length
            full = min(many, left // each)
            offset = capacity - room
            if full:
                runs.append((length, rank, rank + full * each, first, each, offset))
                rank += full * each
                rooms.add(room - each * length, first, full)
            rest = count - rank
            if full < many and rest:  # fewer than ``each``: they share one more sequence
                runs.append((length, rank, count, first + full, rest, offset))
                rank = count
                rooms.add(room - rest * length, first + full, 1)
                full += 1
            rooms.add(room, first + full, many - full)
    return runs, opened


def packed(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence and its place there.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    own = written(pieces(docs, vocabulary or vocabulary_path(), capacity, id_col, text_col).withColumn("at", F.monotonically_increasing_id()), "pieces")
    counts = [(r.length, r.n) for r in own.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()]  # a row for each length
    runs, _ = best_fit_runs(counts, capacity)
    plan = spark.createDataFrame(runs or [(0, 0, 0, 0, 1, 0)], "r_length long, r_from long, r_to long, first long, each long, begins long")
    salted = own.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "at"), F.lit(SALTS)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (
        salted.groupBy("length", "salt")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    )
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "at")
    ranked = salted.join(ahead.hint("shuffle_hash"), ["length", "salt"]).withColumn(
        "rank", F.col("ahead") + F.row_number().over(inside) - 1
    )
    own_run = (F.col("length") == F.col("r_length")) & (F.col("rank") >= F.col("r_from")) & (F.col("rank") < F.col("r_to"))
    place = F.col("rank") - F.col("r_from")
    return ranked.join(F.broadcast(plan), own_run).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first") + F.floor(place / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("begins") + place % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
