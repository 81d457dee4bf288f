"""Suffix-array deduplication: strings of 50 bytes that an earlier document has are taken out.

Every byte covered by a 50-byte string that also starts in a document of smaller id is removed. Strings
are judged on the input, matches never cross documents, and repeats within one document don't count.

How it is dealt out. Each 50-byte string picks an anchor inside it by content alone (see ``anchors``), so
equal strings share an anchor with equal surroundings. Four steps, each a grouped map:

1. Documents are grouped by a hash of the id. A group sends, for each distinct anchor with its
   surroundings (a class), a hash of the anchor, a hash of the class and the least id to the bucket of
   the anchor's hash.
2. A bucket answers with one byte for each class: an earlier document has the whole class; or the class is
   first here, but the anchor has other surroundings elsewhere; or nothing.
3. In the second case the group sends the surroundings themselves (80 bytes, from the document of least
   id alone). Their bucket sorts all suffixes of 50 bytes or more, stack-scans the tree of common-prefix
   intervals, keeps those whose occurrences differ in the byte in front (maximal repeats), and answers
   with the span that repeats shared with a smaller id cover.
4. The group joins the spans of both answers and cuts them out.

A class is what equal surroundings collapse to before suffixes are sorted: one string with all its occurrences,
which are at least ``LENGTH`` bytes alike as a whole. It is told by 96 bits at least: a hash of the anchor (32 bits
and those of its bucket) and one of the surroundings (64 bits).

An anchor with very many surroundings (a common phrase, the edge of a passage that many documents share) is
never gathered in one place. A group that has more than ``HOT_HERE`` of its classes sends a mark in place
of them in step 1; the bucket answers that the anchor is hot where it sees a mark or more than
``HOT_CLASSES`` classes. In step 3 a group then sends the 50-byte strings around hot anchors, each
once, as a hash (96 bits) and the least id to the bucket of that hash, which answers whether an earlier
document has the string.

Edge cases: a null text is the empty text; texts under 50 bytes lose nothing; a null id counts as smaller
than any other; rows of one id are no duplicates of each other; equal rows get equal results; a span may
cut a character in two, so the text form drops broken characters at its edges; an empty table gives an
empty table; columns of the input pass through whatever their names, but for one named as the result.

Scale: a class of a third of all documents is one entry for each group, as groups send only its least
id; so is a string around a hot anchor. Of one anchor a bucket sees ``HOT_HERE`` classes of each group and
``HOT_CLASSES`` surroundings at most. All data go by hash, nothing is broadcast; the driver sees one number,
the bytes in all. There are as many buckets as the input asks for, so what meets in one stays of the same
size; beyond some hundreds of GB a group's rows for each bucket get narrower, which costs shuffled bytes.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.llm.anchors import CONTEXT, GRAM, LENGTH, SIDE, Found, anchors, hashed
from noticeflow.llm.common import small_batches
from noticeflow.llm.repeats import covered

#: Bytes of text in a group, and classes in a bucket, about.
GROUP_BYTES, BUCKET_CLASSES = 6 << 20, 200_000
MOST_BUCKETS = 1 << 26
NULL_ID = -(1 << 63)
NOTHING, EARLIER, DIFFERS, HOT = 0, 1, 2, 3
#: Classes of one anchor that a group sends, and of which a bucket asks for the surroundings, at most.
HOT_HERE, HOT_CLASSES = 64, 4096
MARK = (1 << 64) - 1  # in place of a class's hash: the group has more classes of this anchor than it sends
_MIDDLE = 15  # two strings of 50 bytes around an anchor share so much on one side of it at least


@dataclass
class Group:
    """A group's documents and the classes of their anchors, always in the same order."""

    table: pa.Table
    ids: np.ndarray
    texts: list[bytes]
    found: Found
    order: np.ndarray  # anchors by bucket, anchor hash, class hash, id
    begins: np.ndarray  # where in ``order`` each class begins
    bucket: np.ndarray  # of each class
    gram: np.ndarray
    label: np.ndarray
    least: np.ndarray  # least id of each class in the group
    crowded: np.ndarray  # classes of anchors that have too many of them here
    sent: np.ndarray  # the classes that are sent, one alone of those that are crowded

    @classmethod
    def of(cls, table: pa.Table, buckets: int) -> Group:
        ids = table["id"].to_numpy()
        sha = [hashlib.md5(t).digest() for t in table["text"].to_pylist()]
        rank = np.lexsort((np.array(sha, "S16"), ids)) if len(ids) else np.zeros(0, np.int64)
        table = table.take(pa.array(rank))
        ids, texts = ids[rank], table["text"].to_pylist()
        found = anchors(texts)
        bits = buckets.bit_length() - 1
        bucket = (found.gram >> np.uint64(64 - bits)) if bits else np.zeros(len(found.gram), np.uint64)
        gram = (found.gram >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)
        label = np.minimum(found.context, np.uint64(MARK - 1))
        order = np.lexsort((ids[found.doc], label, gram, bucket))
        b, g, c = bucket[order], gram[order], label[order]
        new = np.ones(len(order), bool)
        new[1:] = (b[1:] != b[:-1]) | (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        begins = np.flatnonzero(new)
        b, g = b[begins].astype(np.int64), g[begins]
        first = np.ones(len(begins), bool)
        first[1:] = (b[1:] != b[:-1]) | (g[1:] != g[:-1])
        at_gram = np.cumsum(first) - 1
        crowded = (np.bincount(at_gram) > HOT_HERE)[at_gram] if len(begins) else first
        sent = np.flatnonzero(first | ~crowded)
        return cls(table, ids, texts, found, order, begins, b, g, c[begins], ids[found.doc[order[begins]]], crowded, sent)

    def slices(self) -> list[tuple[int, int, int]]:
        """(bucket, from, to) of the classes of each bucket."""
        if not len(self.bucket):
            return []
        cuts = np.flatnonzero(np.diff(self.bucket)) + 1
        edges = [0, *cuts.tolist(), len(self.bucket)]
        return [(int(self.bucket[a]), a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def status(self, answers: list[dict]) -> np.ndarray:
        """What the buckets know of each class."""
        out = np.full(len(self.begins), HOT, np.uint8)
        out[self.sent] = _answers(self, answers, 1)
        out[self.crowded] = HOT
        return out


@dataclass
class Windows:
    """The 50-byte strings around a group's hot anchors, and the distinct ones by bucket and hash."""

    doc: np.ndarray
    start: np.ndarray
    which: np.ndarray  # of the distinct ones
    bucket: np.ndarray  # of each distinct one
    high: np.ndarray
    low: np.ndarray
    least: np.ndarray

    @classmethod
    def of(cls, group: Group, status: np.ndarray, buckets: int) -> Windows:
        found = group.found
        hot = group.order[np.repeat(status == HOT, np.diff(np.append(group.begins, len(group.order))))]
        left = found.left[hot].astype(np.int64)
        counts = left + found.right[hot] + GRAM - LENGTH + 1
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in group.texts]))).astype(np.int64)
        at = np.unique(np.repeat(offsets[found.doc[hot]] + found.start[hot] - left, counts) + within)
        doc = np.searchsorted(offsets, at, "right") - 1
        high, low = hashed(np.frombuffer(b"".join(group.texts), np.uint8), at)
        order = np.lexsort((group.ids[doc], low, high))
        doc, at, high, low = doc[order], at[order], high[order], low[order]
        new = np.ones(len(order), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        bits = buckets.bit_length() - 1
        bucket = (high[new] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(new.sum(), np.int64)
        # numbered after the buckets of anchors
        return cls(doc, at - offsets[doc], np.cumsum(new) - 1, bucket + buckets, high[new], low[new], group.ids[doc[new]])

    def slices(self) -> list[tuple[int, int, int]]:
        return Group.slices(self)


def _send_classes(table: pa.Table, buckets: int, name: int) -> pa.Table:
    """Step 1: a row for each bucket."""
    group = Group.of(table, buckets)
    rows: dict[str, list] = {"bucket": [], "g": [], "n": [], "gram": [], "label": [], "least": []}
    for bucket, a, b in group.slices():
        sent = group.sent[np.searchsorted(group.sent, a) : np.searchsorted(group.sent, b)]
        label = np.where(group.crowded[sent], np.uint64(MARK), group.label[sent])
        for key, value in (
            ("bucket", bucket),
            ("g", name),
            ("n", len(sent)),
            ("gram", group.gram[sent].astype(np.uint32).tobytes()),
            ("label", label.tobytes()),
            ("least", _packed(group.least[sent])),
        ):
            rows[key].append(value)
    return pa.table(rows, schema=_CLASSES)


_CLASSES = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("n", pa.int32()), ("gram", pa.binary()), ("label", pa.binary()), ("least", pa.binary())])
_CLASSES_DDL = "bucket int, g int, n int, gram binary, label binary, least binary"
_ANSWER = pa.schema([("g", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("answer", pa.binary())])
_ANSWER_DDL = "g int, bucket int, kind int, answer binary"


def _packed(ids: np.ndarray) -> bytes:
    narrow = len(ids) and 0 <= ids.min() and ids.max() < 1 << 32
    return (ids.astype(np.uint32) if narrow else ids).tobytes()


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint32 if len(raw) == 4 * n else np.int64).astype(np.int64)


def _judge_classes(table: pa.Table) -> pa.Table:
    """Step 2: what a bucket knows of each class it was sent."""
    rows = table.to_pylist()
    sizes = np.array([r["n"] for r in rows])
    gram = np.concatenate([np.frombuffer(r["gram"], np.uint32) for r in rows])
    label = np.concatenate([np.frombuffer(r["label"], np.uint64) for r in rows])
    own = np.concatenate([_ids(r["least"], r["n"]) for r in rows])
    order = np.lexsort((own, label, gram))
    g, c, d = gram[order], label[order], own[order]
    new_gram = np.ones(len(order), bool)
    new_gram[1:] = g[1:] != g[:-1]
    new = new_gram.copy()
    new[1:] |= c[1:] != c[:-1]
    at_gram, at_class = np.cumsum(new_gram) - 1, np.cumsum(new) - 1
    begins = np.flatnonzero(new_gram)
    several = np.bincount(at_gram[new]) > 1
    shared = np.maximum.reduceat(d, begins) > np.minimum.reduceat(d, begins)
    status = np.zeros(len(order), np.uint8)
    status[d > d[new][at_class]] = EARLIER
    status[new & (several & shared)[at_gram]] = DIFFERS
    hot = np.bincount(at_gram[new]) > HOT_CLASSES
    hot[at_gram[c == np.uint64(MARK)]] = True
    status[hot[at_gram] & (status != EARLIER)] = HOT
    back = np.empty(len(order), np.uint8)
    back[order] = status
    ends = np.cumsum(sizes)
    out = [(r["g"], r["bucket"], 1, zlib.compress(back[e - r["n"] : e].tobytes(), 1)) for r, e in zip(rows, ends.tolist(), strict=True)]
    return pa.table(dict(zip(_ANSWER.names, zip(*out, strict=True), strict=True)), schema=_ANSWER)


def _answers(group: Group | Windows, rows: list[dict], kind: int) -> np.ndarray:
    """The bytes that buckets answered, for the classes sent (kind 1), those that differ (kind 2) or strings (kind 3)."""
    by_bucket = {r["bucket"]: zlib.decompress(r["answer"]) for r in rows if r["kind"] == kind}
    return np.frombuffer(b"".join([by_bucket.get(b, b"") for b, _, _ in group.slices()]), np.uint8)


def _send_contexts(table: pa.Table, answers: pa.Table, buckets: int, name: int) -> pa.Table:
    """Step 3, first half: the surroundings of classes that differ from others with the same anchor, and strings around hot anchors."""
    rows: dict[str, list] = {k: [] for k in _CONTEXTS.names}
    if table.num_rows and answers.num_rows:
        group = Group.of(table, buckets)
        status = group.status(answers.to_pylist())
        pad = bytes(SIDE)
        for bucket, a, b in group.slices():
            chosen = np.flatnonzero(status[a:b] == DIFFERS) + a
            if not len(chosen):
                continue
            first = group.order[group.begins[chosen]]
            strings = []
            for doc, start in zip(group.found.doc[first].tolist(), group.found.start[first].tolist(), strict=True):
                text = group.texts[doc]
                if start >= SIDE and start + GRAM + SIDE <= len(text):
                    strings.append(text[start - SIDE : start - SIDE + CONTEXT])
                else:
                    strings.append((pad + text + pad)[start : start + CONTEXT])
            ids = group.least[chosen]
            for key, value in (
                ("bucket", bucket),
                ("g", name),
                ("n", len(chosen)),
                ("strings", b"".join(strings)),
                ("gram", group.gram[chosen].astype(np.uint32).tobytes()),
                ("sides", np.concatenate((group.found.left[first], group.found.right[first])).tobytes()),
                ("least", ids.tobytes()),
            ):
                rows[key].append(value)
        windows = Windows.of(group, status, buckets)
        for bucket, a, b in windows.slices():
            for key, value in (
                ("bucket", bucket),
                ("g", name),
                ("n", b - a),
                ("strings", windows.high[a:b].tobytes()),
                ("gram", windows.low[a:b].tobytes()),
                ("sides", b""),
                ("least", _packed(windows.least[a:b])),
            ):
                rows[key].append(value)
    return pa.table(rows, schema=_CONTEXTS)


_CONTEXTS = pa.schema(
    [("bucket", pa.int32()), ("g", pa.int32()), ("n", pa.int32()), ("strings", pa.binary()), ("gram", pa.binary()), ("sides", pa.binary()), ("least", pa.binary())]
)
_CONTEXTS_DDL = "bucket int, g int, n int, strings binary, gram binary, sides binary, least binary"


def _shares(key: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Which rows agree with another one in both keys."""
    order = np.lexsort((more, key))
    same = (key[order][1:] == key[order][:-1]) & (more[order][1:] == more[order][:-1])
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _judge_contexts(table: pa.Table) -> pa.Table:
    """Step 3, second half: the part of each context that repeats shared with smaller ids cover."""
    rows = table.to_pylist()
    sizes = [r["n"] for r in rows]
    strings = np.concatenate([np.frombuffer(r["strings"], np.uint8).reshape(-1, CONTEXT) for r in rows])
    gram = np.concatenate([np.frombuffer(r["gram"], np.uint32) for r in rows])
    left = np.concatenate([np.frombuffer(r["sides"][: r["n"]], np.uint8) for r in rows]).astype(np.int64)
    right = np.concatenate([np.frombuffer(r["sides"][r["n"] :], np.uint8) for r in rows]).astype(np.int64)
    own = np.concatenate([np.frombuffer(r["least"], np.int64) for r in rows])

    def part(a: int, b: int) -> np.ndarray:
        raw = np.zeros((len(strings), 16), np.uint8)
        raw[:, : b - a] = strings[:, a:b]
        words = raw.view(np.uint64)
        return words[:, 0] * np.uint64(0x9E3779B97F4A7C15) + words[:, 1]

    near = _shares(gram, part(SIDE - _MIDDLE, SIDE)) | _shares(gram, part(SIDE + GRAM, SIDE + GRAM + _MIDDLE))
    spans = np.zeros((len(strings), 2), np.uint8)
    if near.any():
        lo, hi = covered(strings[near], SIDE - left[near], SIDE + GRAM + right[near], own[near], LENGTH)
        spans[near, 0], spans[near, 1] = lo, hi
    ends = np.cumsum(sizes)
    out = [(r["g"], r["bucket"], 2, zlib.compress(spans[e - r["n"] : e].tobytes(), 1)) for r, e in zip(rows, ends.tolist(), strict=True)]
    return pa.table(dict(zip(_ANSWER.names, zip(*out, strict=True), strict=True)), schema=_ANSWER)


def _judge_windows(table: pa.Table) -> pa.Table:
    """Step 3, second half, for strings around hot anchors: whether a smaller id has them."""
    rows = table.to_pylist()
    high = np.concatenate([np.frombuffer(r["strings"], np.uint64) for r in rows])
    low = np.concatenate([np.frombuffer(r["gram"], np.uint32) for r in rows])
    own = np.concatenate([_ids(r["least"], r["n"]) for r in rows])
    order = np.lexsort((own, low, high))
    h, w, d = high[order], low[order], own[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    back = np.empty(len(order), np.uint8)
    back[order] = d > d[new][np.cumsum(new) - 1]
    ends = np.cumsum([r["n"] for r in rows])
    out = [(r["g"], r["bucket"], 3, zlib.compress(back[e - r["n"] : e].tobytes(), 1)) for r, e in zip(rows, ends.tolist(), strict=True)]
    return pa.table(dict(zip(_ANSWER.names, zip(*out, strict=True), strict=True)), schema=_ANSWER)


def _spans(group: Group, answers: list[dict], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, from, to) of what is to go, spans may overlap."""
    found, order = group.found, group.order
    sizes = np.diff(np.append(group.begins, len(order)))
    known = group.status(answers)
    status = np.repeat(known, sizes)
    least = np.repeat(group.least, sizes)
    spans = np.zeros((len(group.begins), 2), np.int64)
    differs = known == DIFFERS
    if differs.any():
        spans[differs] = _answers(group, answers, 2).reshape(-1, 2)
    lo, hi = np.repeat(spans[:, 0], sizes), np.repeat(spans[:, 1], sizes)
    doc, start = found.doc[order], found.start[order]
    whole = (status == EARLIER) | (group.ids[doc] > least)
    begin = np.where(whole, start - found.left[order], start - SIDE + lo)
    end = np.where(whole, start + GRAM + found.right[order], start - SIDE + hi)
    gone = whole | (hi > 0)
    windows = Windows.of(group, known, buckets)
    has = (_answers(windows, answers, 3) == EARLIER)[windows.which] | (group.ids[windows.doc] > windows.least[windows.which])
    at = windows.start[has]
    return np.append(doc[gone], windows.doc[has]), np.append(begin[gone], at), np.append(end[gone], at + LENGTH)


def _cut(table: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """Step 4: documents with their spans and what is left."""
    group = Group.of(table, buckets)
    n = len(group.ids)
    spans: list[list[dict]] = [[] for _ in range(n)]
    kept = list(group.texts)
    removed = np.zeros(n, np.int64)
    if answers.num_rows:
        doc, begin, end = _spans(group, answers.to_pylist(), buckets)
        order = np.lexsort((begin, doc))
        doc, begin, end = doc[order], begin[order], end[order]
        edges = np.searchsorted(doc, np.arange(n + 1))
        for i in np.unique(doc).tolist():
            a, b = begin[edges[i] : edges[i + 1]], end[edges[i] : edges[i + 1]]
            reach = np.maximum.accumulate(b)
            new = np.ones(len(a), bool)
            new[1:] = a[1:] > reach[:-1]
            froms = a[new].tolist()
            tos = reach[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)].tolist()
            text = group.texts[i]
            kept[i] = b"".join([text[x:y] for x, y in zip([0, *tos], [*froms, len(text)], strict=True)])
            spans[i] = [{"start": x, "stop": y} for x, y in zip(froms, tos, strict=True)]
            removed[i] = len(text) - len(kept[i])
    rest = group.table["rest"].combine_chunks()
    missing = group.table["missing"].to_pylist()
    texts = pa.array([None if m else k.decode("utf-8", "ignore") for m, k in zip(missing, kept, strict=True)], pa.string())
    cut = {
        "n_bytes": pa.array([len(t) for t in group.texts], pa.int64()),
        "n_removed": pa.array(removed),
        "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
    }
    return pa.table({"rest": rest, "text": texts, "cut": pa.StructArray.from_arrays(list(cut.values()), list(cut))})


_CUT = "n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept_sha256 string"


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "cut") -> DataFrame:
    """The rows with their text cut.

    Adds a struct of n_bytes, n_removed, spans (start and stop in bytes of each maximal removed run) and
    kept_sha256 (of the remaining bytes) to the rows' own columns.
    """
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parallel = spark.sparkContext.defaultParallelism
    groups = max(1, math.ceil(total / GROUP_BYTES), min(4 * parallel, total >> 20))
    wanted = max(2 * parallel, int(total * 0.065) // BUCKET_CLASSES)  # 6.5 % of all bytes are anchors
    buckets = min(MOST_BUCKETS, 1 << max(0, wanted - 1).bit_length())
    others = [f for f in docs.columns if f != text_col]
    keyed = docs.select(  # the same columns in every step, so that one shuffle of the texts serves them all
        F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)), F.lit(groups)).cast("int").alias("g"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
        F.struct(*[F.col(f"`{f}`") for f in others]).alias("rest"),
        F.col(text_col).isNull().alias("missing"),
    )

    def grouped(step: Callable) -> Callable:
        return lambda key, left, right: step(left, right, buckets, key[0].as_py())

    def send_classes(key: tuple, table: pa.Table) -> pa.Table:
        return _send_classes(table, buckets, key[0].as_py())

    classes = keyed.groupBy("g").applyInArrow(send_classes, _CLASSES_DDL)
    first = classes.groupBy("bucket").applyInArrow(_judge_classes, _ANSWER_DDL)
    contexts = (
        keyed.groupBy("g").cogroup(first.groupBy("g")).applyInArrow(grouped(_send_contexts), _CONTEXTS_DDL)
    )

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        return _judge_windows(table) if key[0].as_py() >= buckets else _judge_contexts(table)

    second = contexts.groupBy("bucket").applyInArrow(judge, _ANSWER_DDL)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        return _cut(left, right, buckets)

    schema = T.StructType().add("rest", T.StructType([docs.schema[f] for f in others])).add("text", "string").add("cut", T.StructType.fromDDL(_CUT))
    done = keyed.groupBy("g").cogroup(first.unionByName(second).groupBy("g")).applyInArrow(cut, schema)
    columns = [F.col("text").alias(f) if f == text_col else F.col("rest").getField(f).alias(f) for f in docs.columns if f != out]
    return done.select(*columns, F.col("cut").alias(out))
