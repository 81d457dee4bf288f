"""Document fingerprints: a quartile bucket digest.

Six byte triplets of every five-byte window of the UTF-8 text are hashed into 512 buckets. The digest
holds, in hex: a checksum byte, the length on a logarithmic scale, the ratios of the quartiles of the
bucket counts, and for each bucket two bits that say between which quartiles its count lies. Two
digests are compared by a difference score: the sum of differences of these parts, bounded by ``BOUND``.
Likeness is 1 - difference / BOUND.

Edge cases: a null text is the empty text; texts under five bytes are padded with zero bytes to one
window; equal texts have equal digests; rows are ordered by id, nulls first, and rows of one id by
text; the only row of a table follows itself; an empty table gives an empty table.

Scale: one range shuffle by id brings each row beside the next one, and rows are streamed from there.
Only the first and the last row of a partition wait for the neighbouring partition; they are joined
over partition numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.common import small_batches, text_of, written

BUCKETS = 512
#: Above this difference two digests count as wholly unlike.
BOUND = 900
#: Positions in a five-byte window that make up a triplet with its first byte.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))


def digest(text: str) -> str:
    """The hex digest of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw.ljust(5, b"\0"), np.uint8).astype(np.uint32)
    windows = len(b) - 4
    w = [b[i : windows + i] for i in range(5)]
    first = w[0] * np.uint32(0x9E3779B1)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    counts = np.zeros(BUCKETS, np.int64)
    for k, (i, j) in enumerate(TRIPLETS):
        h = first + w[i] * np.uint32(0x85EBCA77) + w[j] * np.uint32(0xC2B2AE3D) + np.uint32(k * 0x27D4EB2F & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        counts += np.bincount((h >> shift).astype(np.int64), minlength=BUCKETS)
    at = BUCKETS // 4
    q1, q2, q3 = (int(x) for x in np.partition(counts, (at, 2 * at, 3 * at))[[at, 2 * at, 3 * at]])
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    check = hashlib.md5(raw).digest()[0]
    length = min(255, int(np.log(max(1, len(raw))) / np.log(1.1)))
    ratios = (q1 * 100 // q3 % 16) << 4 | (q2 * 100 // q3 % 16) if q3 else 0
    return bytes((check, length, ratios)).hex() + body.astype(np.uint8).tobytes().hex()


def _parts(code: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(code), np.uint8)
    body = raw[3:]
    return raw[:3].astype(np.int64), np.stack([body >> s & 3 for s in (0, 2, 4, 6)]).astype(np.int64)


def difference(a: str, b: str) -> int:
    """The bounded difference score of two digests: 0 for equal ones, ``BOUND`` at most."""
    if a == b:
        return 0
    (ha, ba), (hb, bb) = _parts(a), _parts(b)
    apart = abs(ba - bb)
    total = int(apart.sum() + 3 * (apart == 3).sum())  # opposite ends of the scale weigh double
    total += int(ha[0] != hb[0])
    steps = abs(int(ha[1]) - int(hb[1]))
    total += steps if steps <= 1 else min(120, 12 * (steps - 1))
    for s in (0, 4):
        d = abs((int(ha[2]) >> s & 15) - (int(hb[2]) >> s & 15))
        total += min(d, 16 - d)
    return min(total, BOUND)


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / BOUND


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = [
    ("doc_id", pa.int64()),
    ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()),
    ("near_next", pa.float64()),
]
_OUT = pa.schema(_FIELDS)
_ENDS = pa.schema([*_FIELDS, ("part", pa.int32()), ("kind", pa.string()), ("text", pa.string())])
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id: int | None, text: str, code: str, following: str, following_code: str) -> tuple:
    changed = edited(text, following)
    new = digest(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, code, new, likeness(code, new), likeness(code, following_code)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition; its first and last ones with their text, for the neighbours."""
    part = TaskContext.get().partitionId()
    before = None
    for batch in batches:
        out = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            code = digest(text)
            if before is None:
                out.append((doc_id, len(text), None, code, None, None, None, part, "head", text))
            else:
                out.append((*_row(*before, text, code), part, "row", None))
            before = doc_id, text, code
        yield _batch(out, _ENDS)
    if before is not None:
        doc_id, text, code = before
        yield _batch([(doc_id, len(text), None, code, None, None, None, part, "tail", text)], _ENDS)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last rows of partitions with the first row of the next one."""
    for batch in batches:
        yield _batch([_row(*r.values()) for r in batch.to_pylist()], _OUT)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's digest, the digest of its edited text, and its likeness to that text and to the next row's."""
    small_batches(docs.sparkSession)
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
        .repartitionByRange("doc_id", F.substring("text", 1, 64))  # the beginning parts the rows of an id in the order of whole texts
        .sortWithinPartitions("doc_id", "text")
    )
    found = written(ordered.mapInArrow(_along, f"{_DDL}, part int, kind string, text string"), "fingerprints")
    heads = found.filter(F.col("kind") == "head").select("part", F.col("text").alias("h_text"), F.col("fingerprint").alias("h_code"))
    tails = found.filter(F.col("kind") == "tail").select("part", "doc_id", "text", F.col("fingerprint").alias("code"))
    every = Window.orderBy("part")  # a number for each partition, no more
    parts = heads.select("part").select("part", F.lead("part").over(every).alias("next"), F.min("part").over(every).alias("first"))
    linked = tails.join(parts.hint("shuffle_hash"), "part").withColumn("h_part", F.coalesce("next", "first"))
    ends = linked.join(heads.withColumnRenamed("part", "h_part").hint("shuffle_hash"), "h_part").select(
        "doc_id", "text", "code", "h_text", "h_code"
    )
    names = [n for n, _ in _FIELDS]
    return found.filter(F.col("kind") == "row").select(names).unionByName(ends.mapInArrow(_across, _DDL))
