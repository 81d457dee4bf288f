"""Benchmark decontamination: runs of words that documents share with benchmark items.

The windows of an item are its runs of ``WINDOW`` words; an item with fewer words, but not none, is one window. The
hashes of all windows are broadcast as a set. Each task rolls a hash over the words of its documents, for each
length that windows have, looks it up in the set, and verifies every hit word for word. A document word inside any
occurrence of a window is hit. Hit words come back as spans, and whoever calls removes these spans or whole documents.

Edge cases: null and empty texts have no words and no hits and stay as they are; very long texts are scanned
piece by piece, pieces overlapping by a window less one word; an item without words has no window; of several
items with the same window all are named; an item without an id hits words but is not named, and an id that
several rows of the benchmark share is one item; rows without an id and repeated rows are judged like any other; a text without hits
is returned letter for letter; an empty benchmark or table hits nothing; columns pass through in a struct, so that no name clashes.

Scale: one pass over the texts without a shuffle. A broadcast holds ``BLOCK_BYTES`` of windows at most; a benchmark with
more is dealt to several blocks, each scanned over all documents, and what the blocks hit is put together by
row, so the result is the same. No group is formed, so no key can be hot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import row_of, small_batches, written
from noticeflow.llm.words import PIECE, word_lists

WINDOW = 10
#: Bytes of window texts and item ids that one broadcast holds at most.
BLOCK_BYTES = 64 << 20
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPANS = "array<struct<first:long,last:long>>"


def _hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words from the words' codes."""
    n = max(0, len(codes) - length + 1)
    out = np.full(n, length, np.uint64)
    for j in range(length):
        out *= _FACTOR
        out += codes[j : j + n]
    return (out ^ (out >> np.uint64(29))) * _MIX


def _codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint32, len(words)).astype(np.uint64)


def windows(text: bytes | None, length: int = WINDOW) -> set[bytes]:
    """The windows of an item, words joined by a space."""
    words = [w for part in word_lists(text) for w in part]
    return {b" ".join(words[i : i + length]) for i in range(max(1, len(words) - length + 1))} if words else set()


class Needles:
    """A set of windows with the items they are of."""

    def __init__(self, pairs: list[tuple[bytes, str | None]]) -> None:
        self.items: dict[bytes, list[str]] = {}
        for text, item in pairs:
            own = self.items.setdefault(text, [])
            if item is not None:
                own.append(item)
        by_length: dict[int, list[np.ndarray]] = {}
        for text in self.items:
            words = text.split(b" ")
            by_length.setdefault(len(words), []).append(_hashes(_codes(words), len(words)))
        self.sets = {n: np.unique(np.concatenate(h)) for n, h in by_length.items()}
        #: bits of the hash by which most runs are told to be in no set
        self.bits = min(26, max(16, 8 + len(self.items).bit_length()))
        self.sieves = {}
        for n, own in self.sets.items():
            self.sieves[n] = np.zeros(1 << self.bits, np.bool_)
            self.sieves[n][own >> np.uint64(64 - self.bits)] = True
        self.longest = max(self.sets, default=1)

    def hits(self, words: list[bytes], owner: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """(place, length, window) of the runs of words of one owner that are windows, each verified."""
        codes = _codes(words)
        for n, own in self.sets.items():
            hashes = _hashes(codes, n)
            at = np.flatnonzero(self.sieves[n][hashes >> np.uint64(64 - self.bits)])
            at = at[owner[at] == owner[at + n - 1]]
            found = np.searchsorted(own, hashes[at])
            at = at[own[np.minimum(found, len(own) - 1)] == hashes[at]]
            for i in at.tolist():
                text = b" ".join(words[i : i + n])
                if text in self.items:
                    yield i, n, text


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (first and last word) that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(last, out[-1][1])
        else:
            out.append((first, last))
    return out


def scan(texts: list[bytes | None], needles: Needles) -> tuple[list[int], dict[int, tuple[list[tuple[int, int]], list[str]]]]:
    """The number of words of each text, and for texts with hits their merged spans and the items hit."""
    counts: list[int] = []
    spans: dict[int, list[tuple[int, int]]] = {}
    seen: dict[int, set[bytes]] = {}

    def look(words: list[bytes], owner: np.ndarray, begin: dict[int, int]) -> None:
        for i, n, text in needles.hits(words, owner):
            k = int(owner[i])
            spans.setdefault(k, []).append((i - begin[k], i - begin[k] + n - 1))
            seen.setdefault(k, set()).add(text)

    buffer: list[bytes] = []
    sizes: list[tuple[int, int]] = []  # texts in the buffer and their words
    begin: dict[int, int] = {}
    held = 0

    def flush() -> None:
        nonlocal held
        if buffer:
            look(buffer, np.repeat(np.array([k for k, _ in sizes], np.int64), [n for _, n in sizes]), begin)
        buffer.clear()
        sizes.clear()
        begin.clear()
        held = 0

    for k, text in enumerate(texts):
        if text is not None and len(text) > PIECE:
            total, before = 0, []
            for part in word_lists(text):
                line = before + part
                look(line, np.full(len(line), k, np.int64), {k: len(before) - total})
                total += len(part)
                before = line[-(needles.longest - 1) :] if needles.longest > 1 else []
            counts.append(total)
            continue
        words = next(word_lists(text), [])
        begin[k] = len(buffer)
        sizes.append((k, len(words)))
        counts.append(len(words))
        buffer += words
        held += len(text or b"")
        if held > PIECE:
            flush()
    flush()
    found = {}
    for k, own in spans.items():
        items = {i for text in seen[k] for i in needles.items[text]}
        found[k] = merged(own), sorted(items)
    return counts, found


def _pairs(benchmark: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """(window, item): each window of the benchmark once for each item that has it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                own = sorted(windows(text, length))
                yield pa.record_batch([pa.array(own, pa.binary()), pa.array([item] * len(own), pa.string())], ["window", "item"])

    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "window binary, item string").distinct()


def _scanned(rows: DataFrame, needles: Needles) -> DataFrame:
    """The rows (row, text) with n_words, spans and items; these two are empty where nothing is hit."""
    shared = rows.sparkSession.sparkContext.broadcast(needles)
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = scan(batch.column("text").cast(pa.binary()).to_pylist(), shared.value)
            none: tuple[list, list] = [], []
            own = [found.get(k, none) for k in range(batch.num_rows)]
            spans = pa.array([[{"first": a, "last": b} for a, b in s] for s, _ in own], span_type)
            items = pa.array([i for _, i in own], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), spans, items], [*batch.schema.names, "n_words", "spans", "items"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(look, f"{kinds}, n_words long, spans {SPANS}, items array<string>")


def _merged(lists: pd.Series) -> pd.Series:
    return pd.Series([[{"first": a, "last": b} for a, b in merged([(s["first"], s["last"]) for s in own])] for own in lists])


def n_hit(spans: Column) -> Column:
    """How many words some merged spans hold."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def matched(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    length: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """row (all columns of a document), text, n_words, spans (first and last word of each stretch that is hit) and items (ids as text)."""
    small_batches(docs.sparkSession)
    pairs = written(_pairs(benchmark, item_col, item_text_col, length), "windows")
    size = F.sum(F.length("window") + F.coalesce(F.length("item"), F.lit(0)) + 16)
    blocks = max(1, math.ceil((pairs.agg(size).first()[0] or 0) / block_bytes))
    rows = docs.select(row_of(docs.drop(text_col)) if len(docs.columns) > 1 else F.struct(F.lit(0).alias("nf_none")).alias("row"), F.col(text_col).alias("text"))

    def block(b: int) -> Needles:
        own = pairs.filter(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == b)
        return Needles([(bytes(r["window"]), r["item"]) for r in own.toLocalIterator()])  # bounded by block_bytes

    if blocks == 1:
        return _scanned(rows, block(0))
    rows = written(rows.withColumn("at", F.monotonically_increasing_id()), "documents")
    parts = [_scanned(rows.select("at", "text"), block(b)).select("at", "n_words", "spans", "items") for b in range(blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part.filter(F.size("spans") > 0))
    whole = found.groupBy("at").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    whole = whole.withColumn("spans", F.pandas_udf(_merged, SPANS)("spans"))
    return rows.join(whole.hint("merge"), "at").select("row", "text", "n_words", "spans", "items")


def _without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without the stretches that some spans of words take up."""
    out = []
    for text, own in zip(texts, spans, strict=True):
        if len(own):
            places = [m.span() for m in _WORD.finditer(text)]
            kept, at = [], 0
            for s in own:
                kept.append(text[at : places[s["first"]][0]])
                at = places[s["last"]][1]
            text = "".join(kept) + text[at:]
        out.append(text)
    return pd.Series(out, dtype=object)


def decontaminated(docs: DataFrame, benchmark: DataFrame, how: str = "spans", share: float = 0.0, text_col: str = "text", **settings) -> DataFrame:
    """The documents with their own columns and without what a benchmark has.

    ``how="spans"`` cuts the stretches of hit words out of the texts; ``how="documents"`` drops the documents of whose words
    more than ``share`` are hit.
    """
    found = matched(docs, benchmark, text_col=text_col, **settings)
    if how == "documents":
        found = found.filter((n_hit(F.col("spans")) == 0) | (n_hit(F.col("spans")) <= F.lit(float(share)) * F.col("n_words")))
    elif how == "spans":
        found = found.withColumn("text", F.pandas_udf(_without, "string")("text", "spans"))
    else:
        raise ValueError("how is spans or documents")
    return found.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
