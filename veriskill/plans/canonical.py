"""The domain's tables, derived from `lineitem` and `events`; the same rules as SQL for the oracles.

Forecasts: run by return flag, lead hour, member and cell by key remainders, values by average quantity. Observations:
hour and cell by event time and user. Averages are rounded once, here, so that comparisons with thresholds do not
hang on the order of summation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INIT = "TIMESTAMP_NTZ '2024-01-02 00:00:00'"
MODELS = ((1, "AIFS", 50, 6), (2, "GEFS", 30, 3), (3, "UKMO", 18, 1), (4, "SPARE", 1, 1))
SCALE = 0.91372645193831  # keeps sums of few-digit inputs off the ties of later rounding
VARIABLES = ((1, "precipitation", "mm/hr"), (2, "temperature_2m", "K"), (3, "wind_u_10m", "m/s"), (4, "wind_v_10m", "m/s"), (5, "pressure_msl", "Pa"))
#: Runs 11 to 13 are older than 1 to 3; the fourth model has none.
RUNS = tuple((r, r % 10, f"2024-01-0{2 if r < 10 else 1} 00:00:00") for r in (1, 2, 3, 11, 12, 13))


def models(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, MODELS)) + " AS t(model_id, model_name, ensemble_count, accum_h)")


def variables(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, VARIABLES)) + " AS t(variable_id, variable_name, units)")


def forecast_runs(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({r}, {m}, TIMESTAMP_NTZ '{t}')" for r, m, t in RUNS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(run_id, model_id, initialization_time)")


def forecast_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, variable_id, forecast_hour, ensemble_member, latitude, longitude, value; one scan, one aggregate."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    run = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    keyed = line.select(
        run.alias("run_id"), (6 * (F.col("l_orderkey") % 21)).cast("int").alias("forecast_hour"), (F.col("l_partkey") % 10).cast("int").alias("ensemble_member"),
        (25 + 0.5 * (F.col("l_suppkey") % 4)).alias("latitude"), (-85 + 0.5 * (F.floor(F.col("l_suppkey") / 4) % 3)).alias("longitude"), "l_quantity", "l_linenumber",
    )
    base = keyed.groupBy("run_id", "forecast_hour", "ensemble_member", "latitude", "longitude").agg(F.avg("l_quantity").alias("q"), F.avg("l_linenumber").alias("n"))
    accum = F.when(F.col("run_id") == 1, 6.0).when(F.col("run_id") == 2, 3.0).otherwise(1.0)
    kinds = F.array(*(F.struct(F.lit(k).alias("variable_id"), (x * SCALE).alias("value")) for k, x in ((1, F.col("q") * accum / 6), (3, F.col("q") - 25), (4, F.col("n") * 5 - 15))))
    return base.withColumn("k", F.explode(kinds)).select("run_id", "k.variable_id", "forecast_hour", "ensemble_member", "latitude", "longitude", "k.value")


def ensemble_statistics(data: DataFrame) -> DataFrame:
    """Mean, sample deviation, extremes and exact quartiles over members."""
    quartiles = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = data.groupBy("run_id", "variable_id", "forecast_hour", "latitude", "longitude").agg(F.round(F.avg("value"), 9).alias("mean_value"), F.round(F.stddev_samp("value"), 9).alias("std_dev"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), quartiles.alias("q"))
    return out.select("run_id", "variable_id", "forecast_hour", "latitude", "longitude", "mean_value", "std_dev", "min_value", "max_value", *(F.round(F.col("q")[k], 9).alias(n) for k, n in enumerate(("percentile_25", "percentile_50", "percentile_75"))))


def field_statistics(data: DataFrame) -> DataFrame:
    """Only the mean and deviation, which most queries need."""
    return data.groupBy("run_id", "variable_id", "forecast_hour", "latitude", "longitude").agg(F.round(F.avg("value"), 9).alias("mean_value"), F.round(F.stddev_samp("value"), 9).alias("std_dev"))


def regridded_forecast(spark: SparkSession, stats: DataFrame) -> DataFrame:
    """Statistics with model and variable names; the dimensions have a handful of rows each."""
    named = forecast_runs(spark).join(F.broadcast(models(spark)), "model_id").select("run_id", "model_name")
    out = stats.join(F.broadcast(named), "run_id").join(F.broadcast(variables(spark).select("variable_id", "variable_name")), "variable_id")
    return out.select("run_id", "model_name", "variable_name", "forecast_hour", "latitude", "longitude", "mean_value", "std_dev")


def observation_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_time, latitude, longitude, precipitation, wind_speed: one row for each event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("obs_time"), (25 + 0.5 * (F.col("user_id") % 4)).alias("latitude"), (-85 + 0.5 * (F.floor(F.col("user_id") / 4) % 3)).alias("longitude"),
        (F.col("value") / 20 * SCALE).alias("precipitation"), (F.col("value") / 25 * SCALE).alias("wind_speed"),
    )


def regridded_observation(observed: DataFrame) -> DataFrame:
    """variable_name, source, obs_time, latitude, longitude, value: means of a cell's hour."""
    means = observed.groupBy("obs_time", "latitude", "longitude").agg(F.round(F.avg("precipitation"), 10).alias("p"), F.round(F.avg("wind_speed"), 10).alias("w"))
    kinds = F.array(F.struct(F.lit("precipitation").alias("variable_name"), F.lit("GPM_IMERG_V07B").alias("source"), F.col("p").alias("value")), F.struct(F.lit("wind_speed").alias("variable_name"), F.lit("ERA5_WIND").alias("source"), F.col("w").alias("value")))
    return means.withColumn("k", F.explode(kinds)).select("k.variable_name", "k.source", "obs_time", "latitude", "longitude", "k.value")


_rows = lambda rows: ", ".join(map(str, rows))

#: The same tables as common table expressions.
SQL = f"""
WITH models(model_id, model_name, ensemble_count, accum_h) AS (VALUES {_rows(MODELS)}),
variables(variable_id, variable_name, units) AS (VALUES {_rows(VARIABLES)}),
forecast_runs(run_id, model_id, initialization_time) AS (SELECT * FROM (VALUES {", ".join(f"({r}, {m}, TIMESTAMP '{t}')" for r, m, t in RUNS)}) v),
fbase AS (SELECT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS run_id, CAST(6 * (l_orderkey % 21) AS INTEGER) AS forecast_hour, CAST(l_partkey % 10 AS INTEGER) AS ensemble_member,
  25 + 0.5::DOUBLE * (l_suppkey % 4) AS latitude, -85 + 0.5::DOUBLE * ((l_suppkey // 4) % 3) AS longitude, avg(l_quantity) AS q, avg(l_linenumber) AS n FROM lineitem GROUP BY ALL),
forecast_data AS (
  SELECT run_id, 1 AS variable_id, forecast_hour, ensemble_member, latitude, longitude, q * CASE run_id WHEN 1 THEN 6e0 WHEN 2 THEN 3e0 ELSE 1e0 END / 6 * {SCALE}e0 AS value FROM fbase
  UNION ALL SELECT run_id, 3, forecast_hour, ensemble_member, latitude, longitude, (q - 25) * {SCALE}e0 FROM fbase
  UNION ALL SELECT run_id, 4, forecast_hour, ensemble_member, latitude, longitude, (n * 5 - 15) * {SCALE}e0 FROM fbase),
ensemble_statistics AS (SELECT run_id, variable_id, forecast_hour, latitude, longitude, round(avg(value), 9) AS mean_value, round(stddev_samp(value), 9) AS std_dev, min(value) AS min_value, max(value) AS max_value,
  round(quantile_cont(value, 0.25), 9) AS percentile_25, round(quantile_cont(value, 0.5), 9) AS percentile_50, round(quantile_cont(value, 0.75), 9) AS percentile_75 FROM forecast_data GROUP BY ALL),
regridded_forecast AS (SELECT s.run_id, m.model_name, v.variable_name, s.forecast_hour, s.latitude, s.longitude, s.mean_value, s.std_dev
  FROM ensemble_statistics s JOIN forecast_runs r USING (run_id) JOIN models m USING (model_id) JOIN variables v USING (variable_id)),
observation_data AS (SELECT date_trunc('hour', ts) AS obs_time, 25 + 0.5::DOUBLE * (user_id % 4) AS latitude, -85 + 0.5::DOUBLE * ((user_id // 4) % 3) AS longitude, value / 20 * {SCALE}e0 AS precipitation, value / 25 * {SCALE}e0 AS wind_speed FROM events),
obs_mean AS (SELECT obs_time, latitude, longitude, round(avg(precipitation), 10) AS p, round(avg(wind_speed), 10) AS w FROM observation_data GROUP BY ALL),
regridded_observation AS (SELECT 'precipitation' AS variable_name, 'GPM_IMERG_V07B' AS source, obs_time, latitude, longitude, p AS value FROM obs_mean
  UNION ALL SELECT 'wind_speed', 'ERA5_WIND', obs_time, latitude, longitude, w FROM obs_mean)
"""
