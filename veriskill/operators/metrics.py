"""Verification metrics: named lists of aggregate columns with a guard, all computable in one aggregate over pairs.

Pairs have mean_rate (m), std_rate (s) and obs_rate (o). Two registries are the extension points: `METRICS` holds the
aggregates over window pairs, `SPATIAL` every spatial metric by name, whatever pairs it is taken from. Results are
rounded at their edges by their exact values, halves to even.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriskill.functions import exprs as E
from veriskill.operators import sums
from veriskill.scratch import written

M, S, O = F.col, F.col, F.col  # noqa: E741


@dataclass(frozen=True)
class Metric:
    """`value` over a group of pairs, given the threshold; kept where `guard` holds, rounded to `places`."""

    value: Callable[[float], Column]
    guard: Callable[[float], Column] = lambda limit: F.count("*") >= 1
    places: int = 4


def _error() -> Column:
    return F.col("mean_rate") - F.col("obs_rate")


def hits(limit: float) -> Column:
    return F.count_if((F.col("mean_rate") > limit) & (F.col("obs_rate") > limit))


def misses(limit: float) -> Column:
    return F.count_if((F.col("mean_rate") <= limit) & (F.col("obs_rate") > limit))


def false_alarms(limit: float) -> Column:
    return F.count_if((F.col("mean_rate") > limit) & (F.col("obs_rate") <= limit))


def correct_negatives(limit: float) -> Column:
    return F.count_if((F.col("mean_rate") <= limit) & (F.col("obs_rate") <= limit))


def ratio(top: Column, low: Column) -> Column:
    return F.when(low > 0, top / low)


def brier_term(limit: float) -> Column:
    miss = F.expr(E.event_probability_sql("mean_rate", "std_rate", f"{limit!r}E0")) - (F.col("obs_rate") > limit).cast("double")
    return miss * miss


METRICS: dict[str, Metric] = {
    "ssr_agg": Metric(lambda t: F.try_divide(F.avg(F.col("std_rate") * F.col("std_rate")), F.avg(_error() * _error())), lambda t: (F.count("*") >= 2) & (F.avg(_error() * _error()) > E.NEAR_ZERO)),
    "bias": Metric(lambda t: F.avg(_error())),
    "mae": Metric(lambda t: F.avg(F.abs(_error()))),
    "rmse": Metric(lambda t: F.sqrt(F.avg(_error() * _error()))),
    "crps": Metric(lambda t: F.avg(F.expr(E.crps_sql("mean_rate", "std_rate", "obs_rate")))),
    "csi": Metric(lambda t: ratio(hits(t), hits(t) + misses(t) + false_alarms(t)), lambda t: hits(t) + misses(t) + false_alarms(t) > 0),
    "pod": Metric(lambda t: ratio(hits(t), hits(t) + misses(t)), lambda t: hits(t) + misses(t) > 0),
    "far": Metric(lambda t: ratio(false_alarms(t), hits(t) + false_alarms(t)), lambda t: hits(t) + false_alarms(t) > 0),
    "brier": Metric(lambda t: F.avg(brier_term(t)), places=6),
}


def score(pairs: DataFrame, names: list[str], limit: float, by: tuple[str, ...] = ("model_name", "latitude", "longitude")) -> DataFrame:
    """All of `names` for each group in one aggregate; null where a metric's guard does not hold."""
    out = pairs.groupBy(*by).agg(*(F.when(METRICS[n].guard(limit), METRICS[n].value(limit)).alias(n) for n in names))
    return out.select(*by, *(E.exact_round(n, METRICS[n].places).alias(n) for n in names))


def spatial(pairs: DataFrame, name: str, limit: float) -> DataFrame:
    """model_name, latitude, longitude, value of one metric, without the cells its guard drops."""
    return score(pairs, [name], limit).where(F.col(name).isNotNull()).withColumnRenamed(name, "value")


def pearson(x: str, y: str, n: Column | None = None) -> Column:
    """Correlation from sums; null under two rows or where either is next to constant, instead of an error.

    `n` counts the rows where there are nulls, which must then be null in both.
    """
    n, fx, fy = F.count("*") if n is None else n, F.col(x), F.col(y)
    sxx, syy, sxy = F.var_pop(fx) * n, F.var_pop(fy) * n, F.covar_pop(fx, fy) * n
    low = F.sqrt(sxx * syy)
    return F.when((n >= 2) & (low > E.NEAR_ZERO), F.try_divide(sxy, low))


def single_hour_ssr(pairs: DataFrame, hour: int) -> DataFrame:
    """std^2 / error^2 of snapped pairs at one lead hour, raw units; cells without error go."""
    err = (F.col("mean_value") - F.col("obs")) * (F.col("mean_value") - F.col("obs"))
    return pairs.where(F.col("forecast_hour") == hour).withColumn("e2", err).where(F.col("e2") > E.NEAR_ZERO).select("model_name", "latitude", "longitude", E.exact_round(F.col("std_dev") * F.col("std_dev") / F.col("e2"), 4).alias("value"))


def spread_error_correlation(pairs: DataFrame, hours: DataFrame | None = None) -> DataFrame:
    """Correlation of spread and absolute error over the fixed lead hours, for each snapped cell.

    With `hours` (model_name, forecast_hour that have both forecasts and observations), n_hours counts a model's.
    """
    rows = pairs.where(F.col("forecast_hour").isin(*E.CORRELATION_HOURS)).withColumn("err", F.abs(F.col("mean_value") - F.col("obs")))
    place = F.min_by(F.struct("latitude", "longitude"), "forecast_hour")
    out = rows.groupBy("model_name", "cy", "cx").agg(place.alias("p"), E.exact_round(pearson("std_dev", "err"), 4).alias("value")).where("value IS NOT NULL").select("model_name", "p.latitude", "p.longitude", "value")
    if hours is None:
        return out
    counted = hours.where(F.col("forecast_hour").isin(*E.CORRELATION_HOURS)).groupBy("model_name").agg(F.count_distinct("forecast_hour").alias("n_hours"))
    return out.join(F.broadcast(counted), "model_name", "left")  # a row for each model


class Inputs(NamedTuple):
    """What spatial metrics are taken from: window pairs, snapped pairs, a threshold and a lead hour."""

    window: DataFrame
    snapped: DataFrame
    limit: float
    hour: int


#: Every spatial metric by name: (model_name, latitude, longitude, value) of its cells.
SPATIAL: dict[str, Callable[[Inputs], DataFrame]] = {
    "ssr": lambda x: single_hour_ssr(x.snapped, x.hour),
    "correlation": lambda x: spread_error_correlation(x.snapped),
    **{name: lambda x, name=name: spatial(x.window, name, x.limit) for name in METRICS},
}


def spatial_all(x: Inputs, names: list[str] | None = None) -> DataFrame:
    """(metric, model_name, latitude, longitude, value) of many of `SPATIAL`, all by default, as each gives it by its name.

    All that come from window pairs are one aggregate, and both that come from snapped pairs another, so that no pair is
    made twice. A metric that is registered apart from these is called by its name.
    """
    names = list(SPATIAL) if names is None else names
    at = ("model_name", "latitude", "longitude")
    row = lambda n, value: F.struct(F.lit(n).alias("metric"), value.alias("value"))
    parts = []
    if window := [n for n in names if n in METRICS]:
        scores = score(x.window, window, x.limit)
        parts.append(scores.withColumn("__m", F.explode(F.array(*(row(n, F.col(n).cast("double")) for n in window)))).select("__m.metric", *at, "__m.value").where("value IS NOT NULL"))
    if {"ssr", "correlation"} <= set(names):
        own = F.abs(F.col("mean_value") - F.col("obs"))
        rows = x.snapped.withColumns({"err": own, "__fixed": F.col("forecast_hour").isin(*E.CORRELATION_HOURS)}).where(F.col("__fixed") | (F.col("forecast_hour") == x.hour))
        fixed = lambda c: F.when(F.col("__fixed"), F.col(c))
        place = F.min(F.when(F.col("__fixed"), F.struct("forecast_hour", "latitude", "longitude")))
        hour = F.max(F.when(F.col("forecast_hour") == x.hour, F.struct("latitude", "longitude", "std_dev", (F.col("err") * F.col("err")).alias("e2"))))
        both = rows.withColumns({"__s": fixed("std_dev"), "__e": fixed("err")}).groupBy("model_name", "cy", "cx").agg(place.alias("p"), hour.alias("h"), pearson("__s", "__e", F.count("__s")).alias("r"))
        ssr = F.when(F.col("h.e2") > E.NEAR_ZERO, F.try_divide(F.col("h.std_dev") * F.col("h.std_dev"), F.col("h.e2")))
        both = both.withColumn("ssr", ssr)
        found = F.array(F.struct(F.lit("ssr").alias("metric"), F.col("h.latitude").alias("latitude"), F.col("h.longitude").alias("longitude"), F.col("ssr").alias("value")), F.struct(F.lit("correlation").alias("metric"), F.col("p.latitude").alias("latitude"), F.col("p.longitude").alias("longitude"), F.col("r").alias("value")))
        parts.append(both.withColumn("__m", F.explode(found)).select("__m.metric", "model_name", "__m.latitude", "__m.longitude", "__m.value").where("value IS NOT NULL").withColumn("value", E.exact_round("value", 4)))
        names = [n for n in names if n not in ("ssr", "correlation")]
    parts += [SPATIAL[n](x).select(F.lit(n).alias("metric"), *at, "value") for n in names if n not in METRICS]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def counts(pairs: DataFrame, limit: float, by: tuple[str, ...]) -> DataFrame:
    """Sums for each group, from which `scored` makes scores; those of several groups may be added up."""
    event = lambda c: F.sum((F.col(c) > limit).cast("long"))
    return pairs.groupBy(*by).agg(F.count("*").alias("n_pts"), hits(limit).alias("hits"), misses(limit).alias("misses"), false_alarms(limit).alias("false_alarms"), correct_negatives(limit).alias("correct_neg"), F.sum(brier_term(limit)).alias("brier_sum"), event("mean_rate").alias("f_sum"), event("obs_rate").alias("o_sum"))


SUMS = ("n_pts", "hits", "misses", "false_alarms", "correct_neg", "brier_sum", "f_sum", "o_sum")


def scored(totals: DataFrame) -> DataFrame:
    """Counts, ratios, Brier score, event shares and whole-domain fractions skill of the groups of `counts`."""
    out = totals.withColumns({"brier_score": E.exact_round(F.col("brier_sum") / F.col("n_pts"), 6), "f": F.col("f_sum") / F.col("n_pts"), "o": F.col("o_sum") / F.col("n_pts")})
    out = with_ratios(out).withColumn("fss", fractions_skill("f", "o"))
    return out.withColumn("fcst_frac", E.exact_round("f", 4)).withColumn("obs_frac", E.exact_round("o", 4)).drop("f", "o", "brier_sum", "f_sum", "o_sum")


def box_scores(pairs: DataFrame, limit: float, boxes: DataFrame, by: tuple[str, ...] = ("model_name", "forecast_hour"), per_degree: int = 2) -> DataFrame:
    """`scored` counts of every box (box_id, south, north, west, east) for each group of `by`, all in one job.

    Summed-area tables of the counts by cell give each box from four corners, so that a box costs the same whatever it
    holds. Bounds are degrees, both ends in, and cells are where pairs snap to. A box without pairs in a group has no row.
    """
    cells = pairs.withColumns({"cy": E.cell(F.col("latitude"), per_degree).cast("bigint"), "cx": E.cell(F.col("longitude"), per_degree).cast("bigint")})
    table = written(sums.area_table(counts(cells, limit, (*by, "cy", "cx")), by, SUMS), "areas")  # written: it is read three times
    ends = {f"{axis}{k}": f(F.col(c) * per_degree).cast("bigint") for axis, (low, high) in (("y", ("south", "north")), ("x", ("west", "east"))) for k, c, f in ((0, low, F.ceil), (1, high, F.floor))}
    groups = F.broadcast(table.select(*by).distinct())  # a row for each model and lead hour
    asked = boxes.select("box_id", *(x.alias(c) for c, x in ends.items())).join(groups)
    return scored(sums.box_sums(table, asked, by, SUMS, ("box_id", *by)).where("n_pts > 0"))


def contingency(pairs: DataFrame, limit: float, by: tuple[str, ...]) -> DataFrame:
    """Counts, ratios, Brier score, event shares and whole-domain fractions skill for each group."""
    return scored(counts(pairs, limit, by))


def fractions_skill(f: str, o: str) -> Column:
    f, o = F.col(f), F.col(o)
    low = (f * f + o * o) * 0.5
    return F.when(low <= E.NEAR_ZERO, 1.0).otherwise(E.exact_round(1 - F.try_divide((f - o) * (f - o), low), 4))


def with_ratios(counts: DataFrame) -> DataFrame:
    h, m, fa = F.col("hits"), F.col("misses"), F.col("false_alarms")
    return counts.withColumns({"csi": E.exact_round(ratio(h, h + m + fa), 4), "pod": E.exact_round(ratio(h, h + m), 4), "far": E.exact_round(ratio(fa, h + fa), 4), "fbi": E.exact_round(ratio(h + fa, h + m), 4)})


def composite(csi: str = "csi", pod: str = "pod", far: str = "far", fss: str | None = None) -> Column:
    """Weighted confidence of rounded ratios; null where any is null."""
    if fss is None:
        return E.exact_round((0.40 * F.col(csi) + 0.20 * F.col(pod) + 0.10 * (1 - F.col(far))) / 0.70, 4)
    return E.exact_round(0.40 * F.col(csi) + 0.30 * F.col(fss) + 0.20 * F.col(pod) + 0.10 * (1 - F.col(far)), 4)
