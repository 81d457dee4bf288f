"""Sharding by fixed virtual slots, in DataFrame functions only.

Rows are hashed by id into a fixed number of virtual slots. Bytes and rows are summed for each slot
before anything is moved. A slot map (slot, part, shard, version) says which shard holds which slot and is
kept in a folder, one file for each version: version 1 deals slots in turn, and rebalancing edits the
newest version into the next one. A slot stays where it is as long as its shard has no more than an even
share of the bytes; only what is over goes to the least filled shards. Moving a slot never rehashes a row.

A slot with more than ``LARGE`` even slots' bytes (one id that very many rows have, rows without an id, very
long texts) is dealt out by the parts that its rows fall into by turns, each with a place of its own in the
map; so the law holds even if a third of all rows share an id.

The law is ``bytes``, by id: equal texts under different ids may stand in different shards.

Edge cases: a null text has no bytes, and any row counts one byte more than its text; rows without an id
share a slot, by turns in parts; equal rows stand in the same slot and follow each other unless the slot
is large; an empty table gives an empty table and a map of empty slots; extra columns are not read.

Scale: the text is read once, into a narrow table of (id, size, crc, slot, part). A slot map has as many
rows as there are slots, and ``PARTS`` more for each large one, of which there are fewer than
``slots`` / ``LARGE`` whatever the input, so it is broadcast. Rows are numbered slot by slot; a slot's
first number follows from the sums, so no shard is ever sorted as a whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeflow.llm.common import shared_dir, text_of, written

SLOTS, PARTS, LARGE = 4096, 64, 16
MAP = "vslot int, part int, shard int, version int"


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot, part) for each row; a row's part goes by its place in the input."""
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(slots)).cast("int").alias("vslot"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PARTS)).cast("int").alias("part"),
    )


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, part, bytes, n_rows, large) for every slot, empty ones too, and for every part of a large one.

    A slot that isn't large has part 0 alone.
    """
    sums = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    zero = F.lit(0).cast("long")
    sums = every.join(F.broadcast(sums), "vslot", "left").select("vslot", *[F.coalesce(c, zero).alias(c) for c in ("bytes", "n_rows")])
    sums = written(sums.withColumn("large", F.col("bytes") * slots > F.sum("bytes").over(Window.partitionBy()) * LARGE), "slot-sums")
    large = F.broadcast(sums.filter("large").select("vslot"))
    parts = rows.join(large, "vslot").groupBy("vslot", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
    whole = sums.filter(~F.col("large")).select("vslot", F.lit(0).alias("part"), "bytes", "n_rows", "large")
    return whole.unionByName(parts.withColumn("large", F.lit(True)))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of a slot map: slots dealt in turn."""
    return spark.range(slots).select(
        F.col("id").cast("int").alias("vslot"), F.lit(0).alias("part"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("version")
    )


def rebalanced(sizes: DataFrame, slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of a slot map: near equal bytes in each of ``shards`` shards, by moving little.

    Slots go from large to small. A slot stays in its shard while that would hold no more than an even share
    of the bytes, and else waits; those that wait, from large to small again, go to the least filled shard.
    A part without a place of its own in the map has its slot's. The folds run over one array with an entry
    for each slot or part: its size is fixed by the number of slots, not by the data.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    own = slot_map.select("vslot", "part", F.col("shard").alias("own"))
    slots = slot_map.groupBy("vslot").agg(F.min_by("shard", "part").alias("of_slot"), F.max("version").alias("version"))
    both = sizes.join(F.broadcast(own), ["vslot", "part"], "left").join(F.broadcast(slots), "vslot", "left")
    shard = F.coalesce("own", "of_slot", F.pmod("vslot", F.lit(shards)).cast("int"))
    entry = F.struct((-F.col("bytes")).alias("rank"), F.col("vslot"), F.col("part"), shard.alias("shard"), F.col("bytes"))
    items = both.agg(F.array_sort(F.collect_list(entry)).alias("items"), F.sum("bytes").alias("total"), F.max("version").alias("version"))
    empty = F.array().cast("array<struct<vslot:int,part:int,shard:int,bytes:bigint>>")
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), empty.alias("out"), empty.alias("wait"))

    def put(done: F.Column, x: F.Column, shard: F.Column) -> tuple[F.Column, F.Column]:
        load = F.transform(done["load"], lambda v, i: F.when(i == shard, v + x["bytes"]).otherwise(v))
        return load, F.struct(x["vslot"].alias("vslot"), x["part"].alias("part"), shard.alias("shard"), x["bytes"].alias("bytes"))

    def keep(done: F.Column, x: F.Column) -> F.Column:
        load, entry = put(done, x, x["shard"])
        stays = F.coalesce((x["shard"] < shards) & (F.get(load, x["shard"]) * shards <= x["total"]), F.lit(False))
        return F.when(stays, F.struct(load.alias("load"), F.concat(done["out"], F.array(entry)).alias("out"), done["wait"].alias("wait"))).otherwise(
            F.struct(done["load"].alias("load"), done["out"].alias("out"), F.concat(done["wait"], F.array(entry)).alias("wait"))
        )

    def place(done: F.Column, x: F.Column) -> F.Column:
        least = (F.array_position(done["load"], F.array_min(done["load"])) - 1).cast("int")
        load, entry = put(done, x, least)
        return F.struct(load.alias("load"), F.concat(done["out"], F.array(entry)).alias("out"), done["wait"].alias("wait"))

    first = items.select("version", F.aggregate(F.transform("items", lambda x: x.withField("total", F.col("total"))), start, keep).alias("kept"))
    second = first.select("version", F.explode(F.aggregate("kept.wait", F.col("kept"), place, lambda s: s["out"])).alias("m"))
    return second.select("m.vslot", "m.part", "m.shard", (F.col("version") + 1).cast("int").alias("version"))


def save_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Store a version of a slot map; a version that is stored already is an error."""
    slot_map.coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The stored versions of a slot map, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of a slot map, the newest by default."""
    version = versions(spark, path)[-1] if version is None else version
    return spark.read.schema(MAP).parquet(f"{path}/version={version}")


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """Every row with its shard and its place there, in shards of near equal bytes.

    The newest slot map in ``map_path`` is loaded, edited for these rows and stored as the next version; where
    the folder has none, version 1 is made first. Without a path the map has a new folder of its own, so that
    equal tables give equal shards.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (the row's place in its shard, gapless
    from 0), grown_shard (null under this law), vslot and map_version.
    """
    spark = docs.sparkSession
    path = map_path or f"{shared_dir(spark)}/noticeflow/slot-map-{uuid.uuid4().hex}"
    rows = written(slotted(docs, id_col, text_col, slots), "slotted")
    sizes = written(slot_sizes(rows, slots), "slot-sizes")
    known = versions(spark, path)
    if not known:
        save_map(first_map(spark, shards, slots), path, 1)
        known = [1]
    save_map(rebalanced(sizes, load_map(spark, path), shards), path, known[-1] + 1)
    edited = load_map(spark, path, known[-1] + 1)
    ahead = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    places = edited.join(F.broadcast(sizes), ["vslot", "part"]).withColumn("first", F.coalesce(F.sum("n_rows").over(ahead), F.lit(0)))
    large = sizes.filter("large").select("vslot").distinct().withColumn("is_large", F.lit(True))
    keyed = rows.join(F.broadcast(large), "vslot", "left").withColumn("part", F.when(F.col("is_large"), F.col("part")).otherwise(0))
    own = Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size")
    return keyed.join(F.broadcast(places.select("vslot", "part", "shard", "version", "first")), ["vslot", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.row_number().over(own) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
        F.col("version").alias("map_version"),
    )
