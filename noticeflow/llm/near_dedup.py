"""MinHash near-deduplication by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its five-word shingles, weighted by count and inverse document frequency.
Consistent weighted samples agree between two texts with the probability of their weighted Jaccard
similarity; they are banded, texts that share a band's key are compared, and pairs of at least
``SIMILARITY`` by their exact weighted Jaccard are linked. Classes are the connected texts.

The weight is count * (1 + IDF_WEIGHT * ln(N / df) / ln N), with N distinct texts and df over them. The idf
part is kept small on purpose: with count * (1 + ln(N / df)) an edit's own shingles outweigh what a large
group of copies shares by so much that most copies of it no longer reach the threshold (README, with figures).

Equal texts are one from the start. Of the others, a text less than 80 % of whose weight lies on shingles
that any other text has can't reach the similarity with any, and isn't sampled; this filter is exact.

In each band the texts of a bucket get the bucket's least key as their representative, and texts that
share a representative are brought together, once however many bands they share it in. There an inverted
index over their shingles yields all pairs of at least the similarity at once; only as many links leave
the task as connect the same texts. A group of more than ``MEMBERS`` texts is dealt out in parts: first each
part meets about ``GUIDES`` texts of the whole group; then the texts that this left outside of the group's
largest class meet all others, part by part. Two texts of one class need no further link, so every pair that
shares a bucket is compared or connected, and nothing is capped.

Edge cases: a null text is the empty text; texts without words are alike only if equal; texts under five
words are one shingle; a null id has no class of its own and takes none; rows of one id and text are one
document; an empty table gives an empty table; extra columns are not read by ``classes`` and pass through
``drop_near_copies`` whatever their names.

Scale: texts are shuffled once, packed, with copies taken out before; document frequencies are counted
over hashes dealt by value, and come back as one byte for each shingle; everything after the sampling
handles ids, keys and the weighted sets of texts that have near copies. Keys that hold more than a two
thousandth of all rows (a text with very many copies, the label of a large class, the representative of a
large group) are joined by broadcast, as there are fewer than two thousand of them; nothing else is
broadcast, and no row is collected.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import hot_keys, hot_split_join, own_columns, row_of, small_batches, text_of, written
from noticeflow.llm.shingles import Sampler, bags, mixed

SIMILARITY, IDF_WEIGHT = 0.8, 0.1
BANDS, ROWS = 20, 5
GROUP_BYTES, BUCKET_SHINGLES, MOST_BUCKETS = 6 << 20, 400_000, 1 << 24
#: Texts of one representative that are compared in one task, and those that all parts of a larger group meet first.
MEMBERS, GUIDES = 512, 16

_TEXTS = pa.schema([("g", pa.int32()), ("key", pa.string()), ("packed", pa.binary())])
_COUNTS = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("n", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_CODES = pa.schema([("g", pa.int32()), ("bucket", pa.int32()), ("codes", pa.binary())])
_SAMPLED = pa.schema([("key", pa.string()), ("bands", pa.list_(pa.int64())), ("weight", pa.float64()), ("shared", pa.binary())])
_LINKS = pa.schema([("a", pa.string()), ("b", pa.string())])
_DDL = {
    "texts": "g int, key string, packed binary",
    "counts": "bucket int, g int, n int, hashes binary, counts binary",
    "codes": "g int, bucket int, codes binary",
    "sampled": "key string, bands array<bigint>, weight double, shared binary",
    "links": "a string, b string",
}


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class _Group:
    """A group's distinct texts in the order of their keys, and their distinct shingles by bucket."""

    def __init__(self, table: pa.Table, bits: int) -> None:
        unpack = zstandard.ZstdDecompressor().decompress
        by_key = dict(zip(table["key"].to_pylist(), table["packed"].to_pylist(), strict=True))
        self.keys = sorted(by_key)
        self.bags = bags([unpack(by_key[k]).decode("utf-8", "surrogatepass") for k in self.keys])
        wide = self.bags.shingle >> np.uint64(24 - bits)  # the bucket's bits and 40 more
        self.distinct, self.place, self.counts = np.unique(wide, return_inverse=True, return_counts=True)
        self.bucket = (self.distinct >> np.uint64(40)).astype(np.int64)

    def slices(self) -> Iterator[tuple[int, int, int]]:
        if len(self.bucket):
            cuts = np.flatnonzero(np.diff(self.bucket)) + 1
            edges = [0, *cuts.tolist(), len(self.bucket)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield int(self.bucket[a]), a, b


def _send_counts(key: tuple, table: pa.Table, bits: int) -> pa.Table:
    group = _Group(table, bits)
    rows = []
    for bucket, a, b in group.slices():
        h = group.distinct[a:b]
        parts = np.concatenate((h.astype(np.uint32).view(np.uint8), (h >> np.uint64(32)).astype(np.uint8)))
        rows.append((bucket, key[0].as_py(), b - a, parts.tobytes(), zlib.compress(group.counts[a:b].astype(np.uint32).tobytes(), 1)))
    return _table(rows, _COUNTS)


def _code(df: np.ndarray) -> np.ndarray:
    """Document frequencies on a logarithmic scale of one byte: 0 for a single text, eight steps for each doubling."""
    return np.where(df > 1, np.minimum(255, np.rint(8 * np.log2(np.maximum(df, 1)))), 0).astype(np.uint8)


def _sum_counts(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    low = np.concatenate([np.frombuffer(r["hashes"][: 4 * r["n"]], np.uint32) for r in rows]).astype(np.uint64)
    high = np.concatenate([np.frombuffer(r["hashes"][4 * r["n"] :], np.uint8) for r in rows]).astype(np.uint64)
    counts = np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), np.uint32) for r in rows]).astype(np.int64)
    h = low | high << np.uint64(32)
    order = np.argsort(h)
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    sums = np.add.reduceat(counts[order], np.flatnonzero(new))
    codes = np.empty(len(s), np.uint8)
    codes[order] = _code(sums)[np.cumsum(new) - 1]
    ends = np.cumsum([r["n"] for r in rows]).tolist()
    return _table([(r["g"], r["bucket"], zlib.compress(codes[e - r["n"] : e].tobytes(), 1)) for r, e in zip(rows, ends, strict=True)], _CODES)


def weights(count: np.ndarray, code: np.ndarray, n_texts: int) -> np.ndarray:
    """TF-IDF weights from counts and coded document frequencies."""
    scale = math.log(max(2, n_texts))
    return count * (1.0 + IDF_WEIGHT * np.clip(1.0 - code.astype(np.float64) * (math.log(2) / 8) / scale, 0.0, 1.0))


def _sample(table: pa.Table, answers: pa.Table, bits: int, n_texts: int) -> pa.Table:
    rows = []
    if table.num_rows and answers.num_rows:
        group = _Group(table, bits)
        by_bucket = {r["bucket"]: zlib.decompress(r["codes"]) for r in answers.to_pylist()}
        code = np.frombuffer(b"".join([by_bucket[b] for b, _, _ in group.slices()]), np.uint8)[group.place]
        own = group.bags
        weight = weights(own.count, code, n_texts)
        total = np.bincount(own.text, weight, len(group.keys))
        shared = np.bincount(own.text, weight * (code > 0), len(group.keys))
        edges = np.searchsorted(own.text, np.arange(len(group.keys) + 1))
        sampler = Sampler(BANDS * ROWS)
        for i in np.flatnonzero((total > 0) & (shared >= SIMILARITY * total * (1 - 1e-9))):
            at = slice(edges[i], edges[i + 1])
            known = code[at] > 0
            h = own.shingle[at][known]
            vector = np.concatenate((h.view(np.uint8), weight[at][known].view(np.uint8)))
            bands = sampler.keys(own.shingle[at], weight[at], ROWS)
            bands = (mixed(bands.view(np.uint64) + np.arange(BANDS, dtype=np.uint64))).astype(np.int64)
            rows.append((group.keys[i], bands.tolist(), float(total[i]), vector.tobytes()))
    return _table(rows, _SAMPLED)


def _vector(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 16
    return np.frombuffer(raw[: 8 * n], np.uint64), np.frombuffer(raw[8 * n :], np.float64)


def _links(table: pa.Table) -> pa.Table:
    """Links between the texts of one task, found through an inverted index.

    Rows of side 0 are compared with each other, rows of side 1 with those of side 2. Of the pairs that are
    alike only as many come back as connect the same texts.
    """
    rows = table.to_pylist()
    m = len(rows)
    sets = [_vector(r["shared"]) for r in rows]
    whole = np.array([r["weight"] for r in rows])
    side = np.array([r["side"] for r in rows])
    sizes = np.array([len(h) for h, _ in sets])
    owner = np.repeat(np.arange(m), sizes)
    ids, element = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
    weight = np.concatenate([w for _, w in sets])
    order = np.argsort(element, kind="stable")
    by_owner, by_weight = owner[order], weight[order]
    ptr = np.concatenate(([0], np.cumsum(np.bincount(element, minlength=len(ids)))))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x in np.flatnonzero(side < 2).tolist():
        own = element[edges[x] : edges[x + 1]]
        starts, counts = ptr[own], ptr[own + 1] - ptr[own]
        at = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        least = np.minimum(np.repeat(weight[edges[x] : edges[x + 1]], counts), by_weight[at])
        common = np.bincount(by_owner[at], least, m)
        alike = common >= SIMILARITY * (whole[x] + whole - common) - 1e-9
        if side[x] == 0:
            alike[: x + 1] = False
        else:
            alike &= side == 2
        for y in np.flatnonzero(alike).tolist():
            a, b = find(x), find(y)
            if a != b:
                root[max(a, b)] = min(a, b)
                if rows[x]["a"] != rows[y]["a"]:
                    out.append((rows[x]["a"], rows[y]["a"]))
    return _table(out, _LINKS)


def _parts(n: str) -> F.Column:
    return F.ceil(F.col(n) / MEMBERS).cast("int")


def _each(n: F.Column) -> F.Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def verified(pairs: DataFrame, sampled: DataFrame) -> DataFrame:
    """Links (a, b) among texts that share a representative: ``pairs`` has (text a, representative b)."""
    sets = sampled.select(F.col("key").alias("a"), "weight", "shared")
    sizes = written(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    dealt = hot_split_join(pairs, sizes, "b")

    def compared(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.join(sets.hint("shuffle_merge"), "a").groupBy(*keys).applyInArrow(_links, _DDL["links"])

    links = compared(dealt.filter(F.col("n") <= MEMBERS).select("a", "b", F.lit(0).alias("side")), "b")
    if sizes.filter(F.col("n") > MEMBERS).isEmpty():
        return links
    part = F.pmod(F.xxhash64("a"), _parts("n")).cast("int")
    large = written(dealt.filter(F.col("n") > MEMBERS).select("a", "b", "n", part.alias("part")), "large-groups")
    guides = large.filter(F.pmod(F.xxhash64("b", "a"), F.ceil(F.col("n") / GUIDES)) == 0).select("a", "b", _each(_parts("n")).alias("part"))
    first = large.select("a", "b", "part", F.lit(2).alias("side")).unionByName(guides.withColumn("side", F.lit(1)))
    known = written(compared(first, "b", "part"), "guide-links")
    labelled = large.join(components(known).withColumnRenamed("key", "a").hint("shuffle_hash"), "a", "left").withColumn("label", F.coalesce("label", "a"))
    labelled = written(labelled, "large-labels")
    counts = labelled.groupBy("b", "label").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("b").agg(F.max_by("label", F.struct("c", "label")).alias("main"), (F.sum("c") - F.max("c")).alias("n_rest"))
    told = hot_split_join(labelled, written(main, "largest-classes"), "b").filter("n_rest > 0")
    others = told.select("a", "b", "part", _each(_parts("n_rest")).alias("rest"), F.lit(2).alias("side"))
    own = F.pmod(F.xxhash64("a"), _parts("n_rest")).cast("int").alias("rest")
    rest = told.filter("label <> main").select("a", "b", _each(_parts("n")).alias("part"), own, F.lit(1).alias("side"))
    second = compared(others.unionByName(rest), "b", "part", "rest")
    return links.unionByName(known).unionByName(second)


def components(links: DataFrame) -> DataFrame:
    """(key, label): for each linked key the least key that it is connected with.

    Labels spread to neighbours, and each label is replaced by its own label, so that chains halve in
    every round. Each round is written to the shared folder.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "key"), "labels")
    hubs = hot_keys(both, "b")
    while True:
        near = hot_split_join(both, labels.withColumnRenamed("key", "b"), "b", hot=hubs).groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(near.withColumnRenamed("a", "key").hint("shuffle_hash"), "key").select(
            "key", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("further"))
        met = written(met, "labels")
        after = written(hot_split_join(met, jump, "label").select("key", "old", F.least("label", "further").alias("label")), "labels")
        if after.filter(F.col("old") != F.col("label")).isEmpty():
            return after.select("key", "label")
        labels = after.select("key", "label")


def linked(docs: DataFrame, n_texts: int, text_col: str = "text") -> DataFrame:
    """(key, label) of the texts that have near copies, of ``n_texts`` distinct ones; a text's key is its MD5 in hex."""
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parallel = spark.sparkContext.defaultParallelism
    groups = max(1, math.ceil(total / GROUP_BYTES), min(4 * parallel, total >> 20))
    wanted = max(2 * parallel, total // 7 // BUCKET_SHINGLES)
    bits = min(MOST_BUCKETS.bit_length() - 1, max(0, wanted - 1).bit_length())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                raw = text.encode("utf-8", "surrogatepass")
                own = hashlib.md5(raw)
                if own.digest() not in seen:
                    seen.add(own.digest())
                    rows.append((int.from_bytes(own.digest()[:6], "big") % groups, own.hexdigest(), squeeze(raw)))
            yield from _table(rows, _TEXTS).to_batches()

    def send(key: tuple, table: pa.Table) -> pa.Table:
        return _send_counts(key, table, bits)

    def sample(texts: pa.Table, answers: pa.Table) -> pa.Table:
        return _sample(texts, answers, bits, n_texts)

    texts = docs.select(text_of(text_col).alias("text")).mapInArrow(pack, _DDL["texts"])
    counts = texts.groupBy("g").applyInArrow(send, _DDL["counts"])
    codes = counts.groupBy("bucket").applyInArrow(_sum_counts, _DDL["codes"])
    sampled = written(texts.groupBy("g").cogroup(codes.groupBy("g")).applyInArrow(sample, _DDL["sampled"]), "sampled")

    members = sampled.select(F.col("key").alias("a"), F.explode("bands").alias("band"))
    least = members.groupBy("band").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "b")
    pairs = written(hot_split_join(written(members, "bands"), least, "band").select("a", "b").distinct(), "near-pairs")
    return components(written(verified(pairs, sampled), "near-links"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, class_id, class_size): for each row the least id of its class of near copies, and the rows of that class."""
    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(text_of(text_col)).alias("text_key")), "text-keys")
    texts = written(rows.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "texts")
    labels = linked(docs, texts.count(), text_col).withColumnRenamed("key", "text_key")
    members = written(labels.join(texts.hint("shuffle_hash"), "text_key"), "members")
    tops = members.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    of_text = hot_split_join(members.select("text_key", "label"), written(tops, "class-ids"), "label").drop("label")
    by_text = texts.join(of_text.hint("shuffle_hash"), "text_key", "left").select(
        "text_key", F.coalesce("class_id", "least").alias("class_id"), F.coalesce("class_size", "copies").alias("class_size")
    )
    return hot_split_join(rows, written(by_text, "class-of-text"), "text_key").select(
        "doc_id", "text_key", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), "class_size"
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, that of the least id, with its own columns; rows without an id stay."""
    found = written(classes(docs, id_col, text_col), "classes")
    kept = found.filter(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("id"), "text_key").distinct()
    keyed = docs.select(row_of(docs), F.col(id_col).cast("long").alias("id"), F.md5(text_of(text_col)).alias("text_key"))
    out = keyed.join(kept.hint("shuffle_hash"), ["id", "text_key"], "left_semi")
    if found.count() != found.select("doc_id", "text_key").distinct().count():
        out = out.dropDuplicates(["id", "text_key"])
    return out.unionByName(keyed.filter(F.col("id").isNull())).select(own_columns(docs))
