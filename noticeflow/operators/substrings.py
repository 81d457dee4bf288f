"""Which terms of a table stand anywhere in the texts of another one: joins by substring.

An automaton over the terms reads each text once, whatever the number of terms. Terms travel as shards of bounded size,
each broadcast on its own and read over all texts, so a table of any size can be looked for; what the shards find is put
together by union, as no term is in two of them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of the terms of one shard; an automaton takes some 60 bytes for each.
SHARD_LETTERS = 2_000_000
#: Rows of (item, term) up to which the items of a term are broadcast.
BROADCAST_ROWS = 200_000
Checkpoint = Callable[[DataFrame, str], DataFrame]


@lru_cache(maxsize=1)
def _automaton(shared: Broadcast) -> ahocorasick.Automaton:
    """The automaton of a shard, built once in each worker and kept until the next shard comes."""
    found = ahocorasick.Automaton()
    for term in shared.value:
        found.add_word(term, term)
    found.make_automaton()
    return found


def occurrences(text: str | None, automaton: ahocorasick.Automaton) -> Counter:
    """How often each term stands in a text, overlaps included."""
    return Counter(term for _, term in automaton.iter(text)) if text and len(automaton) else Counter()


def shards(terms: DataFrame, term_col: str, letters: int = SHARD_LETTERS) -> Iterator[Broadcast]:
    """The distinct terms of a written table in broadcasts of about so many letters."""
    own = terms.select(F.col(term_col).alias("term")).filter("term <> ''").distinct()
    n = max(1, math.ceil((own.agg(F.sum(F.length("term"))).first()[0] or 0) / letters))
    dealt = own.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(n)))
    for k in range(n):
        yield terms.sparkSession.sparkContext.broadcast([r["term"] for r in dealt.filter(F.col("shard") == k).collect()])  # bounded by letters


def term_hits(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, term_col: str = "term", letters: int = SHARD_LETTERS) -> DataFrame:
    """(id, term, n): each term that a text holds anywhere, and how often. Both are taken as written: normalise them first.

    Null and empty texts and terms match nothing; a term that several rows have is one term; rows of one id are
    counted row by row. ``terms`` is read more than once, so let it be a written table.
    """
    kind = texts.select(id_col).schema[0].dataType.simpleString()

    def find(shared: Broadcast) -> DataFrame:
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared)
            for batch in batches:
                at, names, counts = [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for term, n in occurrences(text, automaton).items():
                        at.append(i)
                        names.append(term)
                        counts.append(n)
                ids = batch.column(0).take(pa.array(at, pa.int64()))
                yield pa.record_batch([ids, pa.array(names, pa.string()), pa.array(counts, pa.int32())], [id_col, "term", "n"])

        return texts.select(id_col, text_col).mapInArrow(read, f"`{id_col}` {kind}, term string, n int")

    out = None
    for shared in shards(terms, term_col, letters):
        part = find(shared)
        out = part if out is None else out.unionByName(part)
    return out


def overlaps(texts: DataFrame, items: DataFrame, text_id: str, item_id: str, text_col: str, words: str, checkpoint: Checkpoint, letters: int = SHARD_LETTERS) -> DataFrame:
    """(text, item, n_common, common): the words of an item that a text holds anywhere in it, for pairs that have one.

    ``words`` are arrays. A text's hits stay in one partition, so where the items' words can be broadcast (their number is
    counted) pairs are summed before they are shuffled; else hits and words are joined by word, and words in many rows are split.
    """
    own = checkpoint(items.select(item_id, F.explode(F.array_distinct(words)).alias("term")).filter("term <> ''").distinct(), "item-words")
    hits = term_hits(texts, own, text_id, text_col, letters=letters).select(text_id, "term")
    side = F.broadcast(own) if own.count() <= BROADCAST_ROWS else own.hint("merge")
    common = F.array_sort(F.collect_set("term"))
    return hits.join(side, "term").groupBy(text_id, item_id).agg(common.alias("common")).select(text_id, item_id, F.size("common").alias("n_common"), "common")


def weighted_terms(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, most: int = 100, top: int = 4, letters: int = SHARD_LETTERS) -> DataFrame:
    """(id, score, n_terms, reasons): the sum of the weights of the terms a text holds, at most ``most``, and its heaviest terms.

    ``terms`` is a written table with term, weight and position; ties go to the lesser position. Texts without a term have no row.
    """
    hits = term_hits(texts, terms, id_col, text_col, letters=letters)
    side = terms.select("term", "weight", "position")
    side = F.broadcast(side) if side.count() <= BROADCAST_ROWS else side.hint("merge")
    entry = F.struct((-F.col("weight")).alias("w"), "position", "term")
    found = hits.select(id_col, "term").join(side, "term").groupBy(id_col).agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n_terms"), F.array_sort(F.collect_list(entry)).alias("terms"))
    reasons: Column = F.array_join(F.transform(F.slice("terms", 1, top), lambda x: x["term"]), ", ")
    return found.select(id_col, F.least(F.lit(most), F.col("total")).cast("int").alias("score"), "n_terms", reasons.alias("reasons"))
