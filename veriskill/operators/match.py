"""Joins of forecasts, runs and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriskill.functions import exprs as E

#: Forecast variable, observed variable and source for a requested variable.
ALIASES = {"wind": ("wind_u_10m", "wind_speed", "ERA5_WIND")}


def alias(variable: str) -> tuple[str, str, str]:
    """Wind is scored by its eastward component against observed speed; all else against precipitation."""
    return ALIASES.get(E.checked_token(variable), (variable, "precipitation", "GPM_IMERG_V07B"))


def latest_runs(runs: DataFrame, models: DataFrame) -> DataFrame:
    """model_name, run_id, initialization_time of each model's newest run; a row for each model."""
    newest = F.max_by(F.struct("run_id", "initialization_time"), "initialization_time")
    return runs.join(F.broadcast(models.select("model_id", "model_name")), "model_id").groupBy("model_name").agg(newest.alias("r")).select("model_name", "r.*")


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def in_radius(lat: Column, lon: Column, at_lat: float, at_lon: float, radius: float) -> Column:
    """A square, axis by axis; the slightly wider ranges reach the file scan, which the distances do not."""
    wide = radius + 1e-6
    return in_box(lat, lon, at_lat - wide, at_lat + wide, at_lon - wide, at_lon + wide) & (F.abs(lat - at_lat) <= radius) & (F.abs(lon - at_lon) <= radius)


def in_polygon(lat: Column, lon: Column, vertices: list[tuple[float, float]]) -> Column:
    """Even-odd rule over (lat, lon) vertices, as one expression."""
    inside = F.lit(False)
    for (yi, xi), (yj, xj) in zip(vertices, [vertices[-1], *vertices[:-1]]):
        if yi != yj:
            crosses = ((F.lit(yi) > lat) != (F.lit(yj) > lat)) & (lon < (xj - xi) * (lat - yi) / (yj - yi) + xi)
            inside = inside != crosses
    return inside


def wind_components(stats: DataFrame, keys: list[str], u_id: int = 3, v_id: int = 4, value: str = "value") -> DataFrame:
    """u and v of each key that has both: one scan and a conditional aggregate in place of a self-join."""
    pick = lambda k: F.first(F.when(F.col("variable_id") == k, F.col(value)), ignorenulls=True)
    return stats.where(F.col("variable_id").isin(u_id, v_id)).groupBy(*keys).agg(pick(u_id).alias("u"), pick(v_id).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")


def verified_hours(data: DataFrame, observed: DataFrame, init: Column) -> DataFrame:
    """Distinct lead hours that have an observation at their valid time; both sides are restricted before."""
    hours = data.select("forecast_hour").distinct().withColumn("obs_time", F.expr("timestampadd(HOUR, forecast_hour, init)") if "init" in data.columns else init)
    return hours.join(observed.select("obs_time").distinct(), "obs_time", "left_semi").select("forecast_hour")


def snapped_pairs(stats: DataFrame, observed: DataFrame, obs: str, per_degree: int = 4) -> DataFrame:
    """Statistics with the observation of their cell at exactly their valid time.

    `stats` has initialization_time. Where a cell has several observations their mean is taken, and of several
    forecasts the one of least latitude and longitude, so that the result does not hang on row order.
    """
    seen = observed.where(F.col(obs).isNotNull()).groupBy("obs_time", E.cell(F.col("latitude"), per_degree).alias("cy"), E.cell(F.col("longitude"), per_degree).alias("cx")).agg(F.round(F.avg(obs), 10).alias("obs"))
    timed = stats.where("mean_value IS NOT NULL AND std_dev IS NOT NULL").withColumns({"obs_time": E.valid_time("initialization_time", "forecast_hour"), "cy": E.cell(F.col("latitude"), per_degree), "cx": E.cell(F.col("longitude"), per_degree)})
    one = timed.groupBy("model_name", "forecast_hour", "obs_time", "cy", "cx").agg(F.min(F.struct("latitude", "longitude", "mean_value", "std_dev")).alias("f"))
    return one.join(seen, ["obs_time", "cy", "cx"]).select("model_name", "forecast_hour", "cy", "cx", "f.*", "obs")


#: Accumulation windows that forecasts have, in hours.
WINDOWS = tuple(sorted({1, *E.ACCUM_HOURS.values()}))


def window_means(observed: DataFrame, keys: list[str], windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """(keys, end, hours, obs_rate, n_obs): the mean of the hourly means of (end - hours, end], for each length of `windows`.

    `observed` has obs_time, value and the keys. Each hour is sent to the few ends that it counts for, so that a window is a
    partial aggregate; a window without any hour has no row.
    """
    hourly = observed.groupBy("obs_time", *keys).agg(F.avg("value").alias("__o"))
    ends = F.array(*(F.struct(F.lit(w).alias("hours"), F.lit(back).alias("back")) for w in windows for back in range(w)))
    sent = hourly.withColumn("__to", F.explode(ends)).select(*keys, F.expr("timestampadd(HOUR, __to.back, obs_time)").alias("end"), "__to.hours", "__o")
    return sent.groupBy(*keys, "end", "hours").agg(F.avg("__o").alias("obs_rate"), F.count("*").alias("n_obs"))


def window_pairs(forecast: DataFrame, observed: DataFrame, accum: Column, keys: tuple[str, ...] = ("latitude", "longitude"), divide: Column | None = None, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """`forecast` rows with mean_rate, std_rate, obs_rate and n_obs: hourly observations of (valid - accum, valid].

    `forecast` has initialization_time, mean_value and std_dev; `observed` has obs_time, value and the keys; `accum` is one
    of `windows`. Either side is read once: observations become window means, which meet the forecast rows by cell, end and
    length, so each forecast row stays a row, repeated ones too. At least one hour must be there. Coordinates join by
    integer cell keys of a hundredth of a degree.
    """
    fine = {f"__{k}": E.cell(F.col(k), 100) for k in keys}
    met = window_means(observed.withColumns(fine), list(fine), windows).withColumnsRenamed({"end": "__end", "hours": "__accum"})
    return met_pairs(forecast, met, accum, keys, divide)


def met_pairs(forecast: DataFrame, met: DataFrame, accum: Column, keys: tuple[str, ...] = ("latitude", "longitude"), divide: Column | None = None, per_degree: int = 100) -> DataFrame:
    """`forecast` rows with their window's mean: `met` has __end, __accum, a cell key __<key> for each of `keys`, obs_rate and n_obs."""
    fine = {f"__{k}": E.cell(F.col(k), per_degree) for k in keys}
    rows = forecast.where("mean_value IS NOT NULL AND std_dev IS NOT NULL").withColumns(fine).withColumns({"__accum": accum.cast("int"), "__end": E.valid_time("initialization_time", "forecast_hour")})
    by = divide if divide is not None else F.col("__accum")
    rows = rows.withColumns({"mean_rate": F.col("mean_value") / by, "std_rate": F.col("std_dev") / by})
    return rows.join(met, ["__end", "__accum", *fine]).select(*forecast.columns, "mean_rate", "std_rate", "obs_rate", "n_obs")


def with_default(mean: DataFrame, std: DataFrame, keys: list[str]) -> DataFrame:
    """Mean fields with their spread; 0 where a cell has none."""
    return mean.join(std, keys, "left").withColumn("std_dev", E.zero_if_null(F.col("std_dev")))
