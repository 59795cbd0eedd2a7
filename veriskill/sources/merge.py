"""Keyed tables of partitioned Parquet that are merged into, not appended to.

A table is a folder: `data/version=V/<partition columns>` holds files, `manifest/V` says for every partition which version is
live, `schema` is an empty file of its columns. A merge rewrites the partitions that it touches as a new version, and is committed by renaming one finished manifest into
place. So a reader sees all of a merge or nothing, one that fails leaves the table as it was, one repeated gives the same
table, and of two at a time the second fails instead of losing the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Partition columns and keys of the two tables of grid files, and the columns that a merge sets.
PARTITIONS = ("run_id", "variable_id", "forecast_hour")
MEMBER_KEYS = (*PARTITIONS, "ensemble_member", "latitude", "longitude")
FIELD_KEYS = (*PARTITIONS, "latitude", "longitude")


def _fs(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Committed versions, the oldest first; none of a table that does not exist."""
    path, fs = _fs(spark, folder)
    top = path(f"{folder}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
    return sorted(int(n) for n in names if n.isdigit())


def _manifest(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest/{version:010d}")


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """The table as of `version`, by default the newest; without rows before the first commit, None before the first merge.

    The manifest has a row for each partition; joined with the partition columns it prunes the folders of other versions.
    """
    path, fs = _fs(spark, folder)
    if not fs.exists(path(f"{folder}/schema")):
        return None
    schema, known = spark.read.parquet(f"{folder}/schema").schema, versions(spark, folder)
    if not known:
        return spark.createDataFrame([], schema)
    live = _manifest(spark, folder, known[-1] if version is None else version)
    rows = spark.read.schema(StructType([*schema.fields, StructField("version", IntegerType())])).parquet(f"{folder}/data")
    return rows.join(F.broadcast(live), live.columns, "left_semi").drop("version")  # a row for each partition of the table


def merge(incoming: DataFrame, folder: str, keys: tuple[str, ...], partitions: tuple[str, ...] = PARTITIONS, creates: str | None = None) -> int:
    """Merges `incoming` (keys, values) into the table and gives the version committed.

    Rows meet by `keys`, null keys alike; a value that comes as null leaves the one that is there, any other replaces it, and of
    several rows of one key the greatest value counts, whatever the order of files. With `creates`, a boolean
    column of `incoming`, a key that is new and has it nowhere true is dropped: such rows update only. Touched
    partitions alone are read, joined and written again, by one shuffle, in files of even size. No rows make no version.
    """
    spark = incoming.sparkSession
    values = [c for c in incoming.columns if c not in (*keys, creates)]
    may = F.max(creates) if creates else F.lit(True)
    new = incoming.groupBy(*keys).agg(*(F.max(c).alias(c) for c in values), may.alias("__may"))
    touched = incoming.select(*partitions).distinct()
    new.select(*keys, *values).limit(0).write.mode("ignore").parquet(f"{folder}/schema")
    known = versions(spark, folder)
    if not touched.limit(1).count():
        return known[-1] if known else 0
    version = (known[-1] if known else 0) + 1
    if known:
        old = read(spark, folder).join(F.broadcast(touched), list(partitions), "left_semi")  # a row for each touched partition
        sides = old.withColumns({"__new": F.lit(False), "__may": F.lit(True)}).unionByName(new.withColumn("__new", F.lit(True)))
        newest = lambda c: F.coalesce(F.max(F.when(F.col("__new"), F.col(c))), F.max(F.when(~F.col("__new"), F.col(c)))).alias(c)
        new = sides.groupBy(*keys).agg(*(newest(c) for c in values), F.max("__may").alias("__may"))  # keys are unique on each side
    new = new.where("__may").drop("__may")
    new.hint("rebalance", *partitions).write.partitionBy(*partitions).mode("overwrite").parquet(f"{folder}/data/version={version}")
    live = touched.withColumn("version", F.lit(version))
    if known:
        live = live.unionByName(_manifest(spark, folder, known[-1]).join(F.broadcast(touched), list(partitions), "left_anti").select(*partitions, "version"))
    _commit(live, folder, version)
    return version


def _commit(live: DataFrame, folder: str, version: int) -> None:
    """Writes a manifest aside and renames it into place, which fails where another has taken the number."""
    spark = live.sparkSession
    path, fs = _fs(spark, folder)
    here, there = f"{folder}/manifest/_{version:010d}", path(f"{folder}/manifest/{version:010d}")
    live.coalesce(1).write.mode("overwrite").parquet(here)
    if fs.exists(there) or not fs.rename(path(here), there):
        raise RuntimeError(f"version {version} of {folder} is there already: merge again")


def vacuum(spark: SparkSession, folder: str, partitions: tuple[str, ...] = PARTITIONS) -> int:
    """Removes partitions that the newest manifest does not name, and older manifests; how many partitions went."""
    known = versions(spark, folder)
    path, fs = _fs(spark, folder)
    live = {tuple(map(str, r)) for r in _manifest(spark, folder, known[-1]).select("version", *partitions).collect()} if known else set()  # a row for each partition
    gone = 0
    for s in fs.globStatus(path(f"{folder}/data/version=*/" + "/".join(f"{c}=*" for c in partitions))) or []:
        parts = s.getPath().toString().split("/")[-1 - len(partitions) :]
        if tuple(p.split("=")[1] for p in parts) not in live:
            gone += fs.delete(s.getPath(), True)
    for v in known[:-1]:
        fs.delete(path(f"{folder}/manifest/{v:010d}"), True)
    return gone
