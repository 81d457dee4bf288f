"""State tables in versioned folders, published together by a manifest that is written last.

Small tables are written whole for each version (``commit``). Large keyed tables lie in parts by a hash of the key (``upsert_parts``): a version adds only the
rows of the keys that changed, and a part is written anew once what was added outweighs it. The manifest names the versions of each part.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow import policy

_MANIFEST = "version long, tables array<string>"


def _published(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).json(f"{root}/manifest")


def newest(spark: SparkSession, root: str) -> int:
    """The newest published version, 0 if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return 0
    return _published(spark, root).agg(F.max("version")).first()[0] or 0


def load(spark: SparkSession, root: str, name: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """A state table of a published version; empty before the first one. Its columns must be those promised."""
    version = newest(spark, root) if version is None else version
    if not version:
        return spark.createDataFrame([], schema)
    found = spark.read.parquet(f"{root}/version={version}/{name}")
    if missing := [f.name for f in schema.fields if f.name not in found.columns]:
        raise ValueError(f"{name} of version {version} has no {', '.join(missing)}")
    return found.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def commit(spark: SparkSession, root: str, tables: Mapping[str, DataFrame | Callable[[], DataFrame]], version: int | None = None, partitions: dict[str, list[str]] | None = None) -> int:
    """Write all tables as a new version, then publish it. A version that is published already is left alone.

    The version before stays readable while the new one is made from it. ``partitions`` names columns by whose values a table is
    put into folders. A function in
    place of a table is called when the tables before it have been written, so it can use what their writes observed.
    """
    now = newest(spark, root)
    version = now + 1 if version is None else version
    if version <= now:
        return now
    for name, df in tables.items():
        df = df() if callable(df) else df
        df.write.mode("overwrite").partitionBy(*(partitions or {}).get(name, [])).parquet(f"{root}/version={version}/{name}")
    spark.createDataFrame([(version, sorted(tables))], _MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifest")
    return version


def newest_runs(history: DataFrame, order: str = "run_at", most: int = policy.RUNS) -> DataFrame:
    return history.orderBy(F.desc(order)).limit(most)


#: Parts of a keyed table, and the share of a part's rows that may be added before it is written anew.
PARTS, MOST_ADDED = 8, 0.25
_PARTS = "version long, name string, part int, at array<long>, base long, added long"
_PART, _VERSION = "nf_part", "nf_version"


def _parts(spark: SparkSession, root: str, name: str) -> tuple[int, dict[int, tuple[list[int], int, int]]]:
    """The newest version of a keyed table, and for each part its versions in order, the rows of the first and those added: one row a part."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/parts-manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return 0, {}
    rows = spark.read.schema(_PARTS).json(f"{root}/parts-manifest").filter(F.col("name") == name)
    newest_ = rows.agg(F.max("version")).first()[0] or 0
    return newest_, {r["part"]: (list(r["at"]), r["base"], r["added"]) for r in rows.filter(F.col("version") == newest_).collect() if r["part"] >= 0}


def _read_parts(spark: SparkSession, root: str, name: str, schema: T.StructType, key: str, parts: dict[int, list[int]]) -> DataFrame:
    """The rows of some parts: of each key the row of the newest version."""
    whole = T.StructType([*schema.fields, T.StructField(_VERSION, T.LongType())])
    read = lambda some: spark.read.schema(whole).parquet(*[f"{root}/{name}/version={v}/{_PART}={p}" for p, at in some.items() for v in at])
    plain, added = {p: at for p, at in parts.items() if len(at) == 1}, {p: at for p, at in parts.items() if len(at) > 1}
    out = read(plain).drop(_VERSION) if plain else spark.createDataFrame([], schema)
    if added:
        row = F.struct(*[F.col(f"`{f.name}`") for f in schema.fields]).alias("row")
        newest_ = read(added).select(F.col(key).alias("nf_key"), _VERSION, row).groupBy("nf_key").agg(F.max_by("row", _VERSION).alias("row"))
        out = out.unionByName(newest_.select("row.*"))
    return out


def _of_keys(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """Rows whose key is among some keys, or isn't; null is a key like others."""
    return rows.join(keys.select(F.col(key).alias("nf_key")).hint("shuffle_hash"), F.col(key).eqNullSafe(F.col("nf_key")), how)


def load_parts(spark: SparkSession, root: str, name: str, schema: T.StructType, key: str) -> DataFrame:
    """A keyed table of the newest version; empty before the first one."""
    return _read_parts(spark, root, name, schema, key, {p: at for p, (at, _, _) in _parts(spark, root, name)[1].items()})


def upsert_parts(
    spark: SparkSession,
    root: str,
    name: str,
    schema: T.StructType,
    key: str,
    changes: DataFrame,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    version: int | None = None,
    parts: int = PARTS,
    most_added: float = MOST_ADDED,
) -> int:
    """Bring a keyed table up to date: ``merge`` makes the new rows of the keys in ``changes`` from their rows before and the changes.

    Only parts with changed keys are read, only the rows of changed keys are written, and parts of which more than ``most_added`` was added are written anew. The
    version is published last; one that is published already is left alone. ``changes`` is read several times: let it be a written table.
    """
    now, known = _parts(spark, root, name)
    version = now + 1 if version is None else version
    if version <= now:
        return now
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")
    keys = changes.select(key).distinct()
    touched = {r[_PART]: r["n"] for r in keys.groupBy(part.alias(_PART)).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each part at most
    full = {p for p, n in touched.items() if p in known and known[p][2] + n > most_added * known[p][1]}
    read = lambda some: _read_parts(spark, root, name, schema, key, {p: known[p][0] for p in some if p in known})
    rows = merge(_of_keys(read(touched), keys, key, "left_semi").select(schema.names), changes)
    rows = rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    if full:  # what else is in these parts is written beside the changed rows, and they begin anew
        rows = rows.unionByName(_of_keys(read(full), keys, key, "left_anti").select(schema.names))
    path = f"{root}/{name}/version={version}"
    own = rows.withColumns({_PART: part, _VERSION: F.lit(version).cast("long")}).repartition(max(1, min(parts, len(touched))), _PART)
    own.write.mode("overwrite").partitionBy(_PART).parquet(path)
    sizes = {r[_PART]: r["n"] for r in spark.read.parquet(path).groupBy(_PART).agg(F.count(F.lit(1)).alias("n")).collect()} if touched else {}
    state = dict(known)
    for p, n in sizes.items():
        at, base, added = known.get(p, ([], 0, 0))
        state[p] = ([*at, version], base, added + n) if at and p not in full else ([version], n, 0)
    entries = [(version, name, p, *x) for p, x in sorted(state.items())] or [(version, name, -1, [], 0, 0)]
    spark.createDataFrame(entries, _PARTS).coalesce(1).write.mode("append").json(f"{root}/parts-manifest")
    return version
