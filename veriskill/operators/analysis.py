"""Point, comparison and region analyses composed from joins and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriskill.functions import exprs as E
from veriskill.operators import metrics as M

PERCENTILES = (0.10, 0.25, 0.75, 0.90)


def point_series(members: DataFrame, value: str = "value", divide: Column | float = 1.0, places: int = 4) -> DataFrame:
    """Mean, sample deviation, extremes and exact percentiles for each lead hour, null as 0, rounded."""
    by = divide if isinstance(divide, Column) else F.lit(divide)
    x = F.col(value) / by
    got = members.groupBy("model_name", "forecast_hour").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.percentile(x, F.array(*map(F.lit, PERCENTILES))).alias("p"))
    cols = {"mean": F.col("mean"), "std": F.col("std"), "min": F.col("min"), "max": F.col("max")} | {f"p{round(q * 100)}": F.col("p")[k] for k, q in enumerate(PERCENTILES)}
    return got.select("model_name", "forecast_hour", *(E.exact_round(E.zero_if_null(c), places).alias(n) for n, c in cols.items()))


def spread_skill(members: DataFrame, observed: DataFrame) -> DataFrame:
    """Per model and hour: population spread of members, error of their mean, their ratio.

    `members` (model_name, forecast_hour, obs_time, value) has no null member; `observed` (obs_time, obs) one mean for
    each time. The inner join is at once the test whether an hour can be verified.
    """
    spread = members.groupBy("model_name", "forecast_hour", "obs_time").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.count("*").alias("n_members"))
    met = spread.join(observed, "obs_time").withColumn("e", F.abs(F.col("m") - F.col("obs")))
    ratio = F.when(F.col("e") * F.col("e") > E.NEAR_ZERO, E.exact_round(F.try_divide(F.col("v"), F.col("e") * F.col("e")), 4))
    return met.select("model_name", "forecast_hour", E.exact_round(F.sqrt("v"), 4).alias("spread"), E.exact_round("e", 4).alias("error"), ratio.alias("ssr"), E.exact_round("m", 4).alias("ens_mean"), E.exact_round("obs", 4).alias("obs"), "n_members")


def spread_skill_summary(hours: DataFrame) -> DataFrame:
    """Correlation over the rounded hours, mean ratio over those that have one, number of hours."""
    return hours.groupBy("model_name").agg(E.exact_round(M.pearson("spread", "error"), 4).alias("correlation"), E.exact_round(F.avg("ssr"), 4).alias("mean_ssr"), F.count("*").alias("n_cases"))


def compare_hours(pairs: DataFrame) -> DataFrame:
    """Scores of each forecast row of `pairs` at a point; rows of one hour are not put together."""
    err = F.col("mean_rate") - F.col("obs_rate")
    ssr = F.when(err * err > E.NEAR_ZERO, F.try_divide(F.col("std_rate") * F.col("std_rate"), err * err))
    raw = pairs.withColumns({"__err": err, "__ssr": ssr, "__crps": F.expr(E.crps_sql("mean_rate", "std_rate", "obs_rate", clamp=False))})
    err = F.col("__err")
    return raw.select(
        "model_name", "forecast_hour", "latitude", "longitude", E.accum_hours(F.col("model_name")).cast("int").alias("accum_h"), E.exact_round("__ssr", 4).alias("ssr"), E.exact_round("__crps", 6).alias("crps"),
        E.exact_round(err, 4).alias("bias"), E.exact_round(F.abs(err), 4).alias("mae"), E.exact_round(F.abs(err), 4).alias("rmse"), E.exact_round("std_rate", 4).alias("spread"), E.exact_round("mean_rate", 4).alias("mean_val"),
        E.exact_round("obs_rate", 4).alias("obs"), E.exact_round("mean_value", 4).alias("raw_mean"), E.exact_round("std_dev", 4).alias("raw_std"), F.col("n_obs").alias("n_obs_in_window"),
    )


def compare_summary(hours: DataFrame) -> DataFrame:
    """Means of the rounded hours by model, root mean square of rmse, correlation of spread and error.

    obs_hours: the sorted lead hours that any model was verified at, the same in all rows.
    """
    mean = lambda c: E.exact_round(F.avg(c), 4).alias(c)
    out = hours.groupBy("model_name").agg(E.exact_round(F.avg("ssr"), 4).alias("mean_ssr"), E.exact_round(M.pearson("spread", "mae"), 4).alias("correlation"), E.exact_round(F.avg("crps"), 4).alias("mean_crps"), mean("bias"), mean("mae"), E.exact_round(F.sqrt(F.avg(F.col("rmse") * F.col("rmse"))), 4).alias("rmse"), F.count_distinct("forecast_hour").alias("n_hours"))
    return out.join(F.broadcast(hours.agg(F.sort_array(F.collect_set("forecast_hour")).alias("obs_hours"))))  # one row: a few hundred lead hours


def hour_union(series: DataFrame) -> DataFrame:
    """The lead hours that any model has, in order, and how many models have each."""
    return series.groupBy("forecast_hour").agg(F.count_distinct("model_name").alias("n_models")).orderBy("forecast_hour")


def with_tiers(scores: DataFrame, names: list[str], by: tuple[str, ...] = ("model_name", "latitude", "longitude")) -> DataFrame:
    """One row for each group and metric of `names`: metric, value and the number of its tier, 1 the first; no null values."""
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"), E.tier(F.col(n), [(sign, edge, k + 1) for k, (sign, edge) in enumerate(EDGES[n])], len(EDGES[n]) + 1).alias("tier")) for n in names)))
    return scores.withColumn("__t", rows).select(*by, "__t.*").where("value IS NOT NULL")


def point_events(pairs: DataFrame, limit: float) -> DataFrame:
    """Event flags and chance of the event for each forecast row at a point."""
    chance = F.expr(E.event_probability_sql("mean_rate", "std_rate", f"{limit!r}E0"))
    return pairs.withColumn("__chance", chance).select("model_name", "forecast_hour", "latitude", "longitude", (F.col("mean_rate") > limit).alias("is_fcst"), (F.col("obs_rate") > limit).alias("is_obs"), E.exact_round("__chance", 4).alias("p_event"), E.exact_round("mean_rate", 4).alias("mean_rate"), E.exact_round("obs_rate", 4).alias("obs_rate"))


def point_summary(pairs: DataFrame, limit: float, models: DataFrame | None = None) -> DataFrame:
    """Contingency, ratios, Brier score and composite by model; one of `models` (model_name) without pairs has nulls."""
    out = M.contingency(pairs, limit, ("model_name",)).drop("fss", "fcst_frac", "obs_frac", "n_pts").withColumn("composite", M.composite())
    return out if models is None else F.broadcast(models.select("model_name").distinct()).join(out, "model_name", "left")


def region_hours(pairs: DataFrame, limit: float) -> DataFrame:
    return M.contingency(pairs, limit, ("model_name", "forecast_hour"))


def region_summary(pairs: DataFrame, forecast: DataFrame, limit: float) -> DataFrame:
    """Pooled counts, Brier over all pairs, mean of the rounded hourly skill, cells of all forecasts; by model.

    The hours' sums are added up, so that pairs are made and read once.
    """
    hours = M.counts(pairs, limit, ("model_name", "forecast_hour"))
    skill = M.fractions_skill("f", "o")
    hours = hours.withColumns({"f": F.col("f_sum") / F.col("n_pts"), "o": F.col("o_sum") / F.col("n_pts")}).withColumn("hour_fss", skill)
    pooled = hours.groupBy("model_name").agg(*(F.sum(c).alias(c) for c in M.SUMS), E.exact_round(F.avg("hour_fss"), 4).alias("mean_fss"))
    pooled = M.scored(pooled).drop("fss", "fcst_frac", "obs_frac").withColumnRenamed("mean_fss", "fss")
    cells = forecast.select("model_name", "latitude", "longitude").distinct().groupBy("model_name").agg(F.count("*").alias("n_grid_pts"))
    out = cells.join(pooled, "model_name", "left")
    return out.withColumn("composite", F.when(F.col("fss").isNull(), M.composite()).otherwise(M.composite(fss="fss")))


def cumulative_ratios(hours: DataFrame) -> DataFrame:
    """Running counts by lead hour and their ratios, three places."""
    upto = Window.partitionBy("model_name").orderBy("forecast_hour").rowsBetween(Window.unboundedPreceding, 0)
    h, m, fa = (F.sum(c).over(upto) for c in ("hits", "misses", "false_alarms"))
    run = hours.select("model_name", "forecast_hour", h.alias("h"), m.alias("m"), fa.alias("fa"))
    h, m, fa = F.col("h"), F.col("m"), F.col("fa")
    return run.select("model_name", "forecast_hour", E.exact_round(M.ratio(h, h + m + fa), 3).alias("csi"), E.exact_round(M.ratio(h, h + m), 3).alias("pod"), E.exact_round(M.ratio(fa, h + fa), 3).alias("far"))


def coverage(hours: DataFrame) -> DataFrame:
    """Number of lead hours verified, and the first and last of them."""
    return hours.groupBy("model_name").agg(F.count_distinct("forecast_hour").alias("n_hours"), F.min("forecast_hour").alias("first_hour"), F.max("forecast_hour").alias("last_hour"))


def coverage_message(n: int, first: int | None, last: int | None) -> str:
    return "No observations cover these lead times." if not n else f"Observations cover {n} lead time{'s' * (n != 1)} ({first}-{last} h)."


#: Ends and middle of the colour scale of correlations, from -1 over 0 to 1; fixed values.
CORRELATION_SCALE = ((52, 152, 219), (240, 240, 240), (231, 76, 60))


def correlation_colour(value: Column) -> dict[str, Column]:
    """r, g, b of a correlation: a line from the lower end to the middle, another to the upper end, halves rounded up."""
    share = (value + 1) / 2
    line = lambda a, b, at: E.half_up(a + (b - a) * at).cast("int")
    return {c: F.when(share <= 0.5, line(low, mid, share * 2)).otherwise(line(mid, high, (share - 0.5) * 2)) for c, low, mid, high in zip("rgb", *CORRELATION_SCALE)}


#: Edges of the spatial metrics' tiers, tested in order; tiers go by number, one more than there are edges. Fixed values.
EDGES = {
    "ssr": (("<", 0.5), ("<", 0.8), ("<=", 1.2), ("<=", 2.0)),
    "ssr_agg": (("<", 0.5), ("<", 0.8), ("<=", 1.2), ("<=", 2.0)),
    "bias": (("<", -1.0), ("<", -0.3), ("<=", 0.3), ("<=", 1.0)),
    "mae": (("<", 0.2), ("<", 0.5), ("<", 1.0)),
    "rmse": (("<", 0.3), ("<", 0.7), ("<", 1.2)),
    "crps": (("<", 0.15), ("<", 0.35), ("<", 0.6)),
    "csi": ((">=", 0.6), (">=", 0.4), (">=", 0.2)),
    "pod": ((">=", 0.7), (">=", 0.5), (">=", 0.3)),
    "far": (("<=", 0.2), ("<=", 0.4), ("<=", 0.6)),
    "brier": (("<=", 0.05), ("<=", 0.15), ("<=", 0.25)),
}


def disagreement(forecast: DataFrame) -> DataFrame:
    """Sample deviation of the models' means by cell, raw units, where two or more models have one."""
    out = forecast.where("mean_value IS NOT NULL").groupBy("forecast_hour", "latitude", "longitude").agg(F.stddev_samp("mean_value").alias("d"), F.avg("mean_value").alias("m"), F.count_distinct("model_name").alias("n_models"))
    return out.where("n_models >= 2").select("forecast_hour", "latitude", "longitude", E.exact_round("d", 4).alias("disagreement"), E.exact_round("m", 4).alias("avg_mean"), "n_models")


def field_range(field: DataFrame, value: str = "value") -> DataFrame:
    """Least positive, greatest and mean value and the number of finite ones; 0.01 and 100 stand in."""
    x = F.col(value)
    fine = field.where(x.isNotNull() & ~F.isnan(x))
    got = fine.agg(F.min(F.when(x > 0, x)).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"), F.count("*").alias("count"))
    return got.select(E.exact_round(F.coalesce("lo", F.lit(0.01)), 6).alias("min"), E.exact_round(F.when(F.coalesce("hi", F.lit(0.0)) <= 0, 100.0).otherwise(F.col("hi")), 6).alias("max"), E.exact_round("mean", 4).alias("mean"), "count")


def merged_series(series: DataFrame, models: list[str], precipitation: bool = True, places: int = 6) -> DataFrame:
    """One row for each hour: mean, upper and lower band and raw values of each model, the first row of an hour."""
    by = E.accum_hours(F.col("model_name")) if precipitation else F.lit(1.0)
    std = E.zero_if_null(F.col("std_dev"))
    first = series.groupBy("model_name", "forecast_hour").agg(F.min(F.struct("latitude", "longitude", "mean_value", "std_dev")).alias("r")).select("model_name", "forecast_hour", "r.*")
    cols = {"mean": F.col("mean_value") / by, "hi": (F.col("mean_value") + std) / by, "lo": F.greatest(F.lit(0.0), (F.col("mean_value") - std) / by), "raw_mean": F.col("mean_value"), "raw_std": F.col("std_dev")}
    wide = first.withColumns(cols).groupBy("forecast_hour").pivot("model_name", models).agg(*(E.exact_round(F.first(c), places).alias(c) for c in cols))
    return wide


def peaks(series: DataFrame, precipitation: bool = True) -> DataFrame:
    by = E.accum_hours(F.col("model_name")) if precipitation else F.lit(1.0)
    return series.groupBy("model_name").agg(F.max((E.zero_if_null(F.col("mean_value")) + E.zero_if_null(F.col("std_dev"))) / by).alias("peak"))


def normalised(series: DataFrame, precipitation: bool = True) -> DataFrame:
    """Means as shares of the model's peak; a model that is next to zero everywhere keeps its values."""
    by = E.accum_hours(F.col("model_name")) if precipitation else F.lit(1.0)
    peak = F.max((E.zero_if_null(F.col("mean_value")) + E.zero_if_null(F.col("std_dev"))) / by).over(Window.partitionBy("model_name"))
    return series.withColumn("peak", F.when(peak > 1e-9, peak).otherwise(1.0)).select("model_name", "forecast_hour", "latitude", "longitude", E.exact_round(F.col("mean_value") / by / F.col("peak"), 6).alias("share"))


def scale_ratio(series: DataFrame, precipitation: bool = True) -> DataFrame:
    """Greatest over least positive peak, 1 with under two; a warning over 5."""
    got = peaks(series, precipitation).where("peak > 0").agg(F.count("*").alias("n"), F.max("peak").alias("hi"), F.min("peak").alias("lo"))
    return got.select(F.when(F.col("n") < 2, 1.0).otherwise(E.exact_round(F.try_divide(F.col("hi"), F.col("lo")), 4)).alias("ratio")).withColumn("warn", F.col("ratio") > 5)


def wide_by_hour(hours: DataFrame, value: str, models: list[str]) -> DataFrame:
    first = hours.groupBy("model_name", "forecast_hour").agg(F.min(F.struct("latitude", "longitude", value)).alias("r"))
    return first.groupBy("forecast_hour").pivot("model_name", models).agg(F.first(F.col(f"r.{value}")))
