"""Grid files: JSON arrays of {lat, lon, value}, whose names hold lead hour, member and kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriskill.sources import merge

POINT = "lat double, lon double, value double"


def name_parts(name: Column) -> dict[str, Column]:
    """forecast_hour (0 without one), ensemble_member (null without one) and kind, tested in this order."""
    number = lambda pattern: F.when(F.regexp_extract(name, pattern, 1) != "", F.regexp_extract(name, pattern, 1)).try_cast("int")
    member = number(r"_member_(\d+)\.json")
    kind = F.when(member.isNotNull(), "member").when(name.contains("_mean.json"), "mean").when(name.contains("_std.json"), "std").otherwise("deterministic")
    return {"forecast_hour": F.coalesce(number(r"-(\d+)h-"), F.lit(0)), "ensemble_member": member, "kind": kind}


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    """Points with `file`: the file's own name, or that of its folder where tasks have written `file=<name>` folders."""
    raw = spark.read.schema(POINT).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder)
    return raw if "file" in raw.columns else raw.select("*", F.col("_metadata.file_name").alias("file"))


def _placed(raw: DataFrame) -> DataFrame:
    rows = raw.where("lat IS NOT NULL AND lon IS NOT NULL").withColumns(name_parts(F.col("file")))
    return rows.select("run_id", "variable_id", "forecast_hour", "ensemble_member", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "value", "kind")


def read_grid_files(spark: SparkSession, folder: str, run_id: int, variable_id: int) -> DataFrame:
    """One distributed read of all files of a folder; files that are no JSON give no rows, see `file_report`."""
    return _placed(_raw(spark, folder).withColumns({"run_id": F.lit(run_id), "variable_id": F.lit(variable_id)}))


def read_grid_tree(spark: SparkSession, folder: str) -> DataFrame:
    """One distributed read of the files of many runs and variables, as `write_grid_files` lays them out."""
    return _placed(_raw(spark, folder))


def write_grid_files(points: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Points (run_id, variable_id, file, latitude, longitude, value) as grid files, written by the tasks that hold them.

    The layout is run_id=/variable_id=/file=<name>/; a file holds one field, a bounded number of points.
    """
    one = F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "value")
    write_texts(points.groupBy("run_id", "variable_id", "file").agg(F.to_json(F.collect_list(one)).alias("content")), folder, mode)


def write_texts(texts: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Each row's `content` as a file of its own, in a folder for every value of the other columns."""
    texts.write.mode(mode).partitionBy(*(c for c in texts.columns if c != "content")).text(folder)


def file_report(spark: SparkSession, folder: str) -> DataFrame:
    """file, n_points, n_errors of each file: points read, and elements without a place; one error where it is no JSON."""
    raw = spark.read.format("binaryFile").load(folder)
    name = F.col("file") if "file" in raw.columns else F.col("_metadata.file_name")
    text = raw.select(name.alias("file"), F.from_json(F.col("content").cast("string"), f"array<struct<{POINT}>>").alias("points"))
    placed = F.filter("points", lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    return text.select("file", F.coalesce(F.size(placed), F.lit(0)).cast("bigint").alias("n_points"), F.coalesce(F.size("points") - F.size(placed), F.lit(1)).cast("bigint").alias("n_errors"))


def route_members(points: DataFrame) -> DataFrame:
    """Rows of forecast_data: members, and deterministic fields with a null member."""
    return points.where(F.col("kind").isin("member", "deterministic")).drop("kind")


def route_statistics(points: DataFrame) -> DataFrame:
    """Rows of ensemble_statistics: a mean, a deviation or both for each cell of a field, and whether there is a mean."""
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("value")))
    rows = points.where(F.col("kind").isin("mean", "std")).groupBy(*merge.FIELD_KEYS)
    return rows.agg(pick("mean").alias("mean_value"), pick("std").alias("std_dev"), F.max(F.col("kind") == "mean").alias("has_mean"))


def upsert_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    """`runs` with `new` (model_id, initialization_time): known pairs keep their run_id, others get the next ones."""
    from pyspark.sql import Window

    fresh = new.select("model_id", "initialization_time").distinct().join(runs, ["model_id", "initialization_time"], "left_anti")
    top = F.broadcast(runs.agg(F.coalesce(F.max("run_id"), F.lit(0)).alias("top")))
    numbered = fresh.withColumn("k", F.row_number().over(Window.orderBy("model_id", "initialization_time")))  # a dimension of runs, a few rows
    return runs.unionByName(numbered.join(top).select((F.col("top") + F.col("k")).cast("int").alias("run_id"), "model_id", "initialization_time"))


def load(points: DataFrame, data_folder: str, stats_folder: str) -> None:
    """Merges points into the two tables, forecast_data and ensemble_statistics; loading again changes nothing.

    A deviation goes to the mean of its cell, whether that comes with it or was loaded before; without one it is lost.
    Means replace means; a mean that comes again without its deviation keeps the one it has.
    """
    merge.merge(route_members(points), data_folder, merge.MEMBER_KEYS)
    merge.merge(route_statistics(points), stats_folder, merge.FIELD_KEYS, creates="has_mean")


def load_folders(spark: SparkSession, folders: dict[str, int], run_id: int, data_folder: str, stats_folder: str) -> dict[str, int]:
    """Loads several variables' folders into the two tables; their row counts."""
    for folder, variable_id in folders.items():
        load(read_grid_files(spark, folder, run_id, variable_id), data_folder, stats_folder)
    return {"forecast_data": merge.read(spark, data_folder).count(), "ensemble_statistics": merge.read(spark, stats_folder).count()}


def to_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text, for serving."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
