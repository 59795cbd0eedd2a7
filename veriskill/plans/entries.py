"""Registered queries of the verification operators and their SQL twins; names are operator id and slug."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriskill.functions import exprs as E
from veriskill.operators import analysis as A
from veriskill.operators import grid as G
from veriskill.operators import match as J
from veriskill.operators import metrics as M
from veriskill.operators import places as P
from veriskill.operators import sums as SM
from veriskill.plans import canonical as C
from veriskill.scratch import scratch_path
from veriskill.sources import gridfiles as S
from veriskill.sources import merge as MG
from veriskill.streaming import observations as O
from veriskill.streaming import windows as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODELS3 = ["AIFS", "GEFS", "UKMO"]
BOX = (25.0, 45.0, -85.0, -65.0)  # the domain's default, which holds all cells
POINT, RADIUS = (25.5, -84.5), 0.5
LIMIT = E.threshold("precipitation")
POLYGON = [(24.9, -85.2), (26.2, -85.1), (25.4, -83.8)]


class Frames:
    """The canonical tables over one folder, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf = spark, sf_dir
        self.models, self.variables, self.runs = C.models(spark), C.variables(spark), C.forecast_runs(spark)

    @cached_property
    def data(self) -> DataFrame:
        return C.forecast_data(self.spark, self.sf)

    @cached_property
    def stats(self) -> DataFrame:
        return C.field_statistics(self.data)

    @cached_property
    def latest(self) -> DataFrame:
        return F.broadcast(J.latest_runs(self.runs, self.models))  # a row for each model

    @cached_property
    def observed(self) -> DataFrame:
        return C.observation_data(self.spark, self.sf)

    def timed(self, variable_id: int, frame: DataFrame | None = None) -> DataFrame:
        """Statistics (or other rows) of each model's newest run, with its name and start."""
        frame = self.stats if frame is None else frame
        return frame.where(F.col("variable_id") == variable_id).join(self.latest, "run_id")

    def observations(self, variable: str = "precipitation") -> DataFrame:
        column = "precipitation" if variable == "precipitation" else "wind_speed"
        return self.observed.groupBy("obs_time", "latitude", "longitude").agg(F.bround(F.avg(column), 10).alias("value"))

    def pairs(self, variable_id: int = 1, variable: str = "precipitation", divide: bool = True) -> DataFrame:
        """Window pairs in the box, all lead hours."""
        fc = self.timed(variable_id).where(J.in_box(F.col("latitude"), F.col("longitude"), *BOX)).select("model_name", "initialization_time", "forecast_hour", "latitude", "longitude", "mean_value", "std_dev")
        return J.window_pairs(fc, self.observations(variable), E.accum_hours(F.col("model_name")), divide=None if divide else F.lit(1.0))

    def point(self, frame: DataFrame) -> DataFrame:
        return frame.where(J.in_radius(F.col("latitude"), F.col("longitude"), *POINT, E.POINT_BOX))


#: Shared pieces of the SQL twins.
_LATEST = "latest AS (SELECT model_name, run_id, initialization_time, accum_h FROM (SELECT m.model_name, m.accum_h, r.run_id, r.initialization_time, row_number() OVER (PARTITION BY m.model_name ORDER BY r.initialization_time DESC) AS k FROM forecast_runs r JOIN models m USING (model_id)) WHERE k = 1)"


def _pairs_sql(variable_id: int = 1, obs: str = "p", divide: str = "l.accum_h") -> str:
    return f"""{C.SQL}, {_LATEST},
fc AS (SELECT l.model_name, l.accum_h, l.initialization_time, s.forecast_hour, s.latitude, s.longitude, s.mean_value, s.std_dev, s.mean_value / {divide} AS m, s.std_dev / {divide} AS s
  FROM ensemble_statistics s JOIN latest l USING (run_id) WHERE s.variable_id = {variable_id} AND s.mean_value IS NOT NULL AND s.std_dev IS NOT NULL AND s.latitude BETWEEN {BOX[0]} AND {BOX[1]} AND s.longitude BETWEEN {BOX[2]} AND {BOX[3]}),
pairs AS (SELECT f.model_name, f.accum_h, f.forecast_hour, f.latitude, f.longitude, f.mean_value, f.std_dev, f.m, f.s, avg(o.{obs}) AS o, count(*) AS n_obs
  FROM fc f JOIN obs_mean o ON o.latitude = f.latitude AND o.longitude = f.longitude AND o.obs_time <= f.initialization_time + f.forecast_hour * INTERVAL 1 HOUR AND o.obs_time > f.initialization_time + (f.forecast_hour - f.accum_h) * INTERVAL 1 HOUR GROUP BY ALL)"""


def query(name: str, sql: str | None = None, six: tuple[str, ...] = ()):
    """Registers a query; the columns `six`, raw means otherwise, are rounded to six places on both sides."""

    def add(f: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Frames(spark, sf_dir)).withColumns({c: F.bround(c, 6) for c in six})
        if sql is not None:
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'round_even({c}, 6) AS {c}' for c in six)}) FROM ({sql})" if six else sql
        return f

    return add


#: The standard normal law of the twins, by its power series; the library's own form is a rational one.
_DENSITY = "exp(-({0})*({0})/2) / sqrt(2 * pi())"
_LAW = f"CASE WHEN ({{0}}) > 12 THEN 1e0 WHEN ({{0}}) < -12 THEN 0e0 WHEN ({{0}}) = 0 THEN 0.5e0 ELSE 0.5e0 + sign({{0}}) * {_DENSITY} * list_sum(list_transform(range(0, 320), lambda k: exp((2 * k + 1) * ln(abs({{0}})) + k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2)))) END"
_Z = "(o - m) / nullif(s, 0)"
_CRPS = f"(CASE WHEN s <= 1e-10 THEN abs(m - o) ELSE s * ({_Z} * (2 * ({_LAW.format(_Z)}) - 1) + 2 * {_DENSITY.format(_Z)} - 1 / sqrt(pi())) END)"

_T = f"{LIMIT!r}::DOUBLE"
_H, _MI, _FA, _CN = (f"count(*) FILTER (WHERE m {a} {_T} AND o {b} {_T})" for a, b in ((">", ">"), ("<=", ">"), (">", "<="), ("<=", "<=")))
_P = f"(CASE WHEN s <= 1e-10 THEN CASE WHEN m > {_T} THEN 1e0 ELSE 0e0 END ELSE {_LAW.format(f'((m - {_T}) / nullif(s, 0))')} END)"
_BRIER = f"avg(({_P} - CASE WHEN o > {_T} THEN 1e0 ELSE 0e0 END) ** 2)"
_SPATIAL = {
    "ssr_agg": ("round_even(avg(s*s) / avg((m-o)*(m-o)), 4)", "count(*) >= 2 AND avg((m-o)*(m-o)) > 1e-10"),
    "bias": ("round_even(avg(m-o), 4)", "count(*) >= 1"),
    "mae": ("round_even(avg(abs(m-o)), 4)", "count(*) >= 1"),
    "rmse": ("round_even(sqrt(avg((m-o)*(m-o))), 4)", "count(*) >= 1"),
    "crps": (f"round_even(avg(greatest({_CRPS}, 0)), 4)", "count(*) >= 1"),
    "csi": (f"round_even({_H} / ({_H} + {_MI} + {_FA}), 4)", f"{_H} + {_MI} + {_FA} > 0"),
    "pod": (f"round_even({_H} / ({_H} + {_MI}), 4)", f"{_H} + {_MI} > 0"),
    "far": (f"round_even({_FA} / ({_H} + {_FA}), 4)", f"{_H} + {_FA} > 0"),
    "brier": (f"round_even({_BRIER}, 6)", "count(*) >= 1"),
}
for _k, (_name, (_value, _guard)) in zip(("02", "04", "05", "06", "07", "08", "09", "10", "11"), _SPATIAL.items()):
    query(f"met{_k}_{_name}", f"{_pairs_sql()} SELECT model_name, latitude, longitude, {_value} AS value FROM pairs GROUP BY ALL HAVING {_guard}")(lambda f, n=_name: M.spatial(f.pairs(), n, LIMIT))


@query("met00_all_spatial_metrics", f"{_pairs_sql()} SELECT model_name, latitude, longitude, " + ", ".join(f"CASE WHEN {g} THEN {v} END AS {n}" for n, (v, g) in _SPATIAL.items()) + " FROM pairs GROUP BY ALL")
def _all(f: Frames) -> DataFrame:
    return M.score(f.pairs(), list(M.METRICS), LIMIT)


# -- sources and lookups ---------------------------------------------------------------------------------------------

_ORDER_RUNS = f"{C.SQL.rstrip()}, pairs_of AS (SELECT DISTINCT CAST(o_custkey % 3 + 1 AS INTEGER) AS model_id, date_trunc('day', o_orderdate) AS initialization_time, bool_or(o_orderstatus = 'F') AS old FROM orders GROUP BY ALL), old_runs AS (SELECT CAST(row_number() OVER (ORDER BY model_id, initialization_time) AS INTEGER) AS run_id, model_id, initialization_time FROM pairs_of WHERE old), all_runs AS (SELECT * FROM old_runs UNION ALL SELECT CAST((SELECT max(run_id) FROM old_runs) + row_number() OVER (ORDER BY model_id, initialization_time) AS INTEGER), model_id, initialization_time FROM pairs_of WHERE NOT old)"


def order_runs(f: Frames) -> DataFrame:
    """A run for each model and day that has orders: those with a finished one first, the others by an upsert of all orders."""
    from pyspark.sql import Window

    orders = f.spark.read.parquet(f"{f.sf}/orders.parquet").select((F.col("o_custkey") % 3 + 1).cast("int").alias("model_id"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("initialization_time"), "o_orderstatus")
    known = orders.where("o_orderstatus = 'F'").select("model_id", "initialization_time").distinct()
    known = known.select(F.row_number().over(Window.orderBy("model_id", "initialization_time")).alias("run_id"), "model_id", "initialization_time")  # a row for each model and day
    return S.upsert_runs(known, orders)


_STEM = "lower(model_name) || '-' || lpad(CAST(forecast_hour AS VARCHAR), 3, '0') || 'h-x'"


@query("src02_file_names", f"{C.SQL}, {_LATEST}, d AS (SELECT DISTINCT {_STEM} AS stem, forecast_hour, ensemble_member AS m FROM forecast_data JOIN latest USING (run_id)), n AS (SELECT stem || '_member_' || m || '.json' AS file, forecast_hour, m, 'member' AS kind FROM d UNION SELECT stem || '_mean.json', forecast_hour, NULL, 'mean' FROM d UNION SELECT stem || '_std.json', forecast_hour, NULL, 'std' FROM d UNION SELECT stem || '.json', forecast_hour, NULL, 'deterministic' FROM d UNION SELECT 'run_member_' || m || '.json', 0, m, 'member' FROM d) SELECT file, forecast_hour, m AS ensemble_member, kind FROM n")
def _names(f: Frames) -> DataFrame:
    """Names of the files of all fields and members, taken apart again; some have no hour."""
    at = f.data.join(f.latest, "run_id").select(F.format_string("%s-%03dh-x", F.lower("model_name"), "forecast_hour").alias("stem"), F.col("ensemble_member").alias("m")).distinct()
    names = F.array(F.format_string("%s_member_%d.json", "stem", "m"), F.concat("stem", F.lit("_mean.json")), F.concat("stem", F.lit("_std.json")), F.concat("stem", F.lit(".json")), F.format_string("run_member_%d.json", "m"))
    return at.select(F.explode(names).alias("file")).distinct().withColumns(S.name_parts(F.col("file")))


@query("src11_row_counts", f"{C.SQL} SELECT (SELECT count(*) FROM forecast_data) AS forecast_data, (SELECT count(*) FROM ensemble_statistics) AS ensemble_statistics")
def _counts(f: Frames) -> DataFrame:
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(f.data, "forecast_data").join(n(f.stats, "ensemble_statistics"))  # one row each


@query("lkp01_latest_run", f"{_ORDER_RUNS} SELECT model_name, run_id, initialization_time FROM (SELECT m.model_name, r.run_id, r.initialization_time, row_number() OVER (PARTITION BY m.model_name ORDER BY r.initialization_time DESC) AS k FROM all_runs r JOIN models m USING (model_id)) WHERE k = 1")
def _latest(f: Frames) -> DataFrame:
    return J.latest_runs(order_runs(f), f.models)


@query("lkp02_latest_run_join", f"{C.SQL}, {_LATEST} SELECT rf.model_name, rf.variable_name, l.run_id, count(*) AS n_rows FROM regridded_forecast rf JOIN latest l ON rf.model_name = l.model_name AND rf.run_id = l.run_id GROUP BY ALL")
def _latest_join(f: Frames) -> DataFrame:
    return C.regridded_forecast(f.spark, f.stats).join(f.latest, ["model_name", "run_id"]).groupBy("model_name", "variable_name", "run_id").agg(F.count("*").alias("n_rows"))


@query("lkp03_variable_by_name", f"{C.SQL} SELECT variable_id, count(*) AS n_rows FROM forecast_data WHERE variable_id = (SELECT variable_id FROM variables WHERE variable_name = 'wind_u_10m') GROUP BY ALL")
def _variable(f: Frames) -> DataFrame:
    one = f.variables.where("variable_name = 'wind_u_10m'").select("variable_id")
    return f.data.join(F.broadcast(one), "variable_id").groupBy("variable_id").agg(F.count("*").alias("n_rows"))


@query("lkp04_variable_alias", f"{C.SQL} SELECT t.*, (SELECT count(*) FROM regridded_forecast WHERE variable_name = forecast) AS n_forecast, (SELECT count(*) FROM regridded_observation o WHERE o.variable_name = observed AND o.source = t.source) AS n_observed FROM (VALUES ('wind', 'wind_u_10m', 'wind_speed', 'ERA5_WIND'), ('precipitation', 'precipitation', 'precipitation', 'GPM_IMERG_V07B')) t(variable, forecast, observed, source)")
def _alias(f: Frames) -> DataFrame:
    """What a requested variable stands for on both sides, and how many rows there are of it."""
    asked = f.spark.createDataFrame([(v, *J.alias(v)) for v in ("wind", "precipitation")], "variable string, forecast string, observed string, source string")
    fc = C.regridded_forecast(f.spark, f.stats).groupBy(F.col("variable_name").alias("forecast")).agg(F.count("*").alias("n_forecast"))
    obs = C.regridded_observation(f.observed).groupBy(F.col("variable_name").alias("observed"), "source").agg(F.count("*").alias("n_observed"))
    return fc.join(F.broadcast(asked), "forecast").join(obs, ["observed", "source"]).select("variable", "forecast", "observed", "source", "n_forecast", "n_observed")


@query("lkp05_models_with_runs", f"{_ORDER_RUNS} SELECT DISTINCT model_name, model_id FROM models JOIN all_runs USING (model_id) ORDER BY model_name")
def _with_runs(f: Frames) -> DataFrame:
    return f.models.join(order_runs(f), "model_id", "left_semi").select("model_name", "model_id").orderBy("model_name")


@query("lkp06_variables", f"{C.SQL} SELECT variable_name FROM variables WHERE variable_id IN (SELECT variable_id FROM forecast_data) ORDER BY 1")
def _variables(f: Frames) -> DataFrame:
    """Variables that have forecasts, in order."""
    return f.variables.join(f.data, "variable_id", "left_semi").select("variable_name").orderBy("variable_name")


@query("lkp07_health", f"{C.SQL} SELECT 'ok' AS status, count(*) AS forecast_records FROM forecast_data")
def _health(f: Frames) -> DataFrame:
    return f.data.agg(F.count("*").alias("forecast_records")).select(F.lit("ok").alias("status"), "forecast_records")


# -- filters and scalar functions ------------------------------------------------------------------------------------


@query("flt01_bbox", f"{C.SQL} SELECT * EXCLUDE (min_value, max_value, percentile_25, percentile_50, percentile_75) FROM ensemble_statistics WHERE latitude BETWEEN 25.5 AND 26 AND longitude BETWEEN -85 AND -84.5 AND mean_value IS NOT NULL", six=('mean_value', 'std_dev'))
def _bbox(f: Frames) -> DataFrame:
    return f.stats.where(J.in_box(F.col("latitude"), F.col("longitude"), 25.5, 26.0, -85.0, -84.5) & F.col("mean_value").isNotNull())


@query("flt02_hours", f"{C.SQL} SELECT run_id, forecast_hour, count(*) AS n_rows FROM forecast_data WHERE forecast_hour BETWEEN 12 AND 48 GROUP BY ALL")
def _hours(f: Frames) -> DataFrame:
    return f.data.where(F.col("forecast_hour").between(12, 48)).groupBy("run_id", "forecast_hour").agg(F.count("*").alias("n_rows"))


@query("flt03_radius", f"{C.SQL} SELECT * REPLACE (round_even(value, 6) AS value) FROM forecast_data WHERE abs(latitude - 25.4) <= 0.3 AND abs(longitude + 84.6) <= 0.3 AND variable_id = 1")
def _radius(f: Frames) -> DataFrame:
    return f.data.where(J.in_radius(F.col("latitude"), F.col("longitude"), 25.4, -84.6, 0.3) & (F.col("variable_id") == 1)).withColumn("value", F.bround("value", 6))


@query("flt04_null_filters", f"{C.SQL} SELECT run_id, count(*) AS n_rows, count(*) FILTER (WHERE std_dev IS NOT NULL) AS n_std FROM ensemble_statistics WHERE mean_value IS NOT NULL GROUP BY ALL")
def _nulls(f: Frames) -> DataFrame:
    return f.stats.where("mean_value IS NOT NULL").groupBy("run_id").agg(F.count("*").alias("n_rows"), F.count("std_dev").alias("n_std"))


def member_field(f: Frames, member: str, run_id: int = 1, variable_id: int = 1, hour: int = 12) -> DataFrame:
    """Latitude, longitude, value of the mean, the spread or one member of a field; null as 0."""
    here = (F.col("run_id") == run_id) & (F.col("variable_id") == variable_id) & (F.col("forecast_hour") == hour)
    if member in ("mean", "std"):
        rows = f.stats.where(here & (F.lit(True) if member == "mean" else F.col("std_dev").isNotNull())).withColumn("value", F.col("mean_value" if member == "mean" else "std_dev"))
    else:
        rows = f.data.where(here & (F.col("ensemble_member") == int(member)))
    return rows.select("latitude", "longitude", E.zero_if_null(F.col("value")).alias("value"))


for _m, _sql in (("mean", "coalesce(mean_value, 0) AS value FROM ensemble_statistics WHERE"), ("std", "std_dev AS value FROM ensemble_statistics WHERE std_dev IS NOT NULL AND"), ("3", "value FROM forecast_data WHERE ensemble_member = 3 AND")):
    query(f"flt05_field_{_m}", f"{C.SQL} SELECT latitude, longitude, {_sql} run_id = 1 AND variable_id = 1 AND forecast_hour = 12", six=("value",))(lambda f, m=_m: member_field(f, m))


@query("flt06_models", f"{C.SQL} SELECT model_name, count(*) AS n_rows FROM regridded_forecast WHERE model_name IN ('AIFS', 'UKMO') GROUP BY ALL")
def _some_models(f: Frames) -> DataFrame:
    return C.regridded_forecast(f.spark, f.stats).where(F.col("model_name").isin("AIFS", "UKMO")).groupBy("model_name").agg(F.count("*").alias("n_rows"))


def _polygon_sql() -> str:
    terms = [f"CASE WHEN (({yi} > latitude) <> ({yj} > latitude)) AND longitude < ({xj - xi}) * (latitude - {yi}) / ({yj - yi}) + ({xi}) THEN 1 ELSE 0 END" for (yi, xi), (yj, xj) in zip(POLYGON, [POLYGON[-1], *POLYGON[:-1]])]
    return " + ".join(terms)


@query("flt07_polygon", f"{C.SQL} SELECT DISTINCT latitude, longitude FROM ensemble_statistics WHERE ({_polygon_sql()}) % 2 = 1")
def _polygon(f: Frames) -> DataFrame:
    return f.stats.select("latitude", "longitude").where(J.in_polygon(F.col("latitude"), F.col("longitude"), POLYGON)).distinct()


_SPOTS = "spots AS (SELECT c_custkey AS spot, 20 + (c_custkey * 7919 % 100003) / 5000::DOUBLE AS latitude, -100 + (c_custkey * 104729 % 100019) / 2500::DOUBLE AS longitude FROM customer)"
_SHAPES = "shapes AS (SELECT s_suppkey AS polygon_id, 20 + (s_suppkey * 6007 % 10007) / 500::DOUBLE AS y, -100 + (s_suppkey * 7001 % 10009) / 250::DOUBLE AS x, 0.25 + (s_suppkey % 17) / 8::DOUBLE AS r FROM supplier), corners AS (SELECT polygon_id, [y - r, y - r * 0.25::DOUBLE, y + r, y + r * 0.125::DOUBLE, y + r] AS ys, [x - r, x + r, x + r * 0.5::DOUBLE, x, x - r] AS xs FROM shapes), edges AS (SELECT polygon_id, ys[k] AS yi, xs[k] AS xi, ys[(k + 3) % 5 + 1] AS yj, xs[(k + 3) % 5 + 1] AS xj FROM corners, range(1, 6) t(k))"


def spots(f: Frames) -> DataFrame:
    """A place for every customer."""
    k = F.col("c_custkey")
    return f.spark.read.parquet(f"{f.sf}/customer.parquet").select(k.alias("spot"), (20 + k * 7919 % 100003 / 5000.0).alias("latitude"), (-100 + k * 104729 % 100019 / 2500.0).alias("longitude"))


def shapes(f: Frames) -> DataFrame:
    """A polygon of five corners, one of them inwards, for every supplier."""
    k, y, x, r = F.col("s_suppkey"), F.col("y"), F.col("x"), F.col("r")
    at = f.spark.read.parquet(f"{f.sf}/supplier.parquet").select(k.alias("polygon_id"), (20 + k * 6007 % 10007 / 500.0).alias("y"), (-100 + k * 7001 % 10009 / 250.0).alias("x"), (0.25 + k % 17 / 8.0).alias("r"))
    corners = ((y - r, x - r), (y - r * 0.25, x + r), (y + r, x + r * 0.5), (y + r * 0.125, x), (y + r, x - r))
    return at.select("polygon_id", F.array(*(F.struct(a.alias("lat"), b.alias("lon")) for a, b in corners)).alias("vertices"))


@query("flt07_many_polygons", f"WITH {_SPOTS}, {_SHAPES} SELECT spot, latitude, longitude, polygon_id FROM spots, edges WHERE (yi > latitude) <> (yj > latitude) AND longitude < (xj - xi) * (latitude - yi) / (yj - yi) + xi GROUP BY ALL HAVING count(*) % 2 = 1")
def _many_polygons(f: Frames) -> DataFrame:
    return P.in_polygons(spots(f), shapes(f))


@query("flt01_key_ranges", f"WITH {_SPOTS} SELECT spot, latitude, longitude FROM spots WHERE latitude BETWEEN 24.5 AND 29.25 AND longitude BETWEEN -92.125 AND -85")
def _key_ranges(f: Frames) -> DataFrame:
    """A table written in key order, of which a box reads only some ranges."""
    table = scratch_path(f.spark, "keyed")
    P.with_key(spots(f)).write.parquet(table)
    return P.in_box(f.spark.read.parquet(table), 24.5, 29.25, -92.125, -85.0).drop("z_key")


_WIND = "wind AS (SELECT u.run_id, u.forecast_hour, u.latitude, u.longitude, u.mean_value AS u, v.mean_value AS v FROM ensemble_statistics u JOIN ensemble_statistics v USING (run_id, forecast_hour, latitude, longitude) WHERE u.variable_id = 3 AND v.variable_id = 4)"
_FIELD = ["run_id", "forecast_hour", "latitude", "longitude"]


def wind_field(f: Frames) -> DataFrame:
    return J.wind_components(f.stats, _FIELD, value="mean_value")


@query("fn02_wind_speed_direction", f"{C.SQL}, {_WIND} SELECT run_id, forecast_hour, latitude, longitude, round_even(sqrt(u*u+v*v), 2) AS speed, round_even((degrees(atan2(u, v)) + 180) % 360, 1) AS direction FROM wind")
def _speed(f: Frames) -> DataFrame:
    return wind_field(f).select(*_FIELD, F.bround(E.wind_speed(F.col("u"), F.col("v")), 2).alias("speed"), F.bround(E.wind_direction(F.col("u"), F.col("v")), 1).alias("direction"))


@query("fn04_unit_rate", f"{C.SQL} SELECT model_name, forecast_hour, latitude, longitude, round_even(mean_value / accum_h, 7) AS rate FROM regridded_forecast JOIN models USING (model_name) WHERE variable_name = 'precipitation'")
def _rate(f: Frames) -> DataFrame:
    rows = C.regridded_forecast(f.spark, f.stats).where("variable_name = 'precipitation'")
    return rows.select("model_name", "forecast_hour", "latitude", "longitude", F.bround(F.col("mean_value") / E.accum_hours(F.col("model_name")), 7).alias("rate"))


@query("fn05_threshold", f"{C.SQL}, {_LATEST}, {_WIND}, x AS (SELECT 'precipitation' AS variable, model_name, mean_value / accum_h AS rate, 25e0 / 6 AS threshold FROM ensemble_statistics JOIN latest USING (run_id) WHERE variable_id = 1 UNION ALL SELECT 'wind', model_name, sqrt(u * u + v * v), 10e0 FROM wind JOIN latest USING (run_id)) SELECT variable, model_name, round_even(threshold, 6) AS threshold, count(*) FILTER (WHERE rate > threshold) AS n_events FROM x GROUP BY ALL")
def _threshold(f: Frames) -> DataFrame:
    """How many cells are over the threshold of their variable: rain as a rate, wind as a speed."""
    rain = f.timed(1).select(F.lit("precipitation").alias("variable"), "model_name", (F.col("mean_value") / E.accum_hours(F.col("model_name"))).alias("rate"))
    wind = wind_field(f).join(f.latest, "run_id").select(F.lit("wind").alias("variable"), "model_name", E.wind_speed(F.col("u"), F.col("v")).alias("rate"))
    limit = F.when(F.col("variable") == "wind", E.threshold("wind")).otherwise(E.threshold("precipitation"))
    over = rain.unionByName(wind).withColumn("threshold", limit)
    return over.groupBy("variable", "model_name", F.bround("threshold", 6).alias("threshold")).agg(F.count_if(F.col("rate") > F.col("threshold")).alias("n_events"))


@query("fn06_valid_time", f"{C.SQL} SELECT DISTINCT run_id, forecast_hour, initialization_time + forecast_hour * INTERVAL 1 HOUR AS valid_time FROM forecast_data JOIN forecast_runs USING (run_id)")
def _valid(f: Frames) -> DataFrame:
    return f.data.select("run_id", "forecast_hour").distinct().join(F.broadcast(f.runs), "run_id").select("run_id", "forecast_hour", E.valid_time("initialization_time", "forecast_hour").alias("valid_time"))


@query("fn07_grid_cells", "SELECT s_suppkey, CAST(round_even(s_acctbal / 1000 * 4, 0) AS INTEGER) AS quarter, CAST(round_even(s_acctbal / 1000 * 2, 0) AS INTEGER) AS half FROM supplier")
def _cells(f: Frames) -> DataFrame:
    return f.spark.read.parquet(f"{f.sf}/supplier.parquet").select("s_suppkey", E.cell(F.col("s_acctbal") / 1000, 4).alias("quarter"), E.cell(F.col("s_acctbal") / 1000, 2).alias("half"))


_PRICES = {"tax_2": ("l_extendedprice * l_tax", 2), "half_2": ("l_extendedprice / 8", 2), "eighth_1": ("l_quantity / 8 + l_linenumber / 16", 1), "share_4": ("l_discount / l_linenumber + l_quantity / 160000", 4), "minus_0": ("l_quantity / 2 - 30", 0)}


@query("flt08_tokens", "SELECT p_partkey, p_brand, regexp_full_match(p_name, '[A-Za-z0-9_]{1,40}') AS name_allowed, regexp_full_match(replace(p_name, ' ', '_'), '[A-Za-z0-9_]{1,40}') AS joined_allowed, regexp_full_match(p_type, '[A-Za-z0-9_]{1,40}') AS type_allowed FROM part")
def _tokens(f: Frames) -> DataFrame:
    """Which names of all parts would pass as identifiers."""
    part = f.spark.read.parquet(f"{f.sf}/part.parquet")
    return part.select("p_partkey", "p_brand", E.is_token(F.col("p_name")).alias("name_allowed"), E.is_token(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).alias("joined_allowed"), E.is_token(F.col("p_type")).alias("type_allowed"))


@query("fn08_exact_rounding", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"CAST(printf('%.{n}f', CAST({x} AS DOUBLE)) AS DOUBLE) + 0 AS {c}" for c, (x, n) in _PRICES.items()) + " FROM lineitem")
def _exact(f: Frames) -> DataFrame:
    """Amounts of all order lines, many of them on a half, rounded by their exact binary value."""
    line = f.spark.read.parquet(f"{f.sf}/lineitem.parquet")
    raw = line.select("l_orderkey", "l_linenumber", *(F.expr(x).cast("double").alias(c) for c, (x, _) in _PRICES.items()))
    return raw.select("l_orderkey", "l_linenumber", *((E.exact_round(c, n) + 0.0).alias(c) for c, (_, n) in _PRICES.items()))


@query("fn09_normal_law", f"SELECT s_suppkey, round_even({_LAW.format('(s_acctbal/1500)')}, 10) AS cdf, round_even({_DENSITY.format('(s_acctbal/1500)')}, 10) AS pdf FROM supplier")
def _normal(f: Frames) -> DataFrame:
    return f.spark.read.parquet(f"{f.sf}/supplier.parquet").select("s_suppkey", F.bround(F.expr(E.normal_cdf_sql("s_acctbal/1500")), 10).alias("cdf"), F.bround(F.expr(E.normal_pdf_sql("s_acctbal/1500")), 10).alias("pdf"))


@query("fn10_event_probability", f"{_pairs_sql()} SELECT model_name, forecast_hour, latitude, longitude, round_even({_P}, 6) AS p FROM pairs")
def _probability(f: Frames) -> DataFrame:
    return f.pairs().select("model_name", "forecast_hour", "latitude", "longitude", F.bround(F.expr(E.event_probability_sql("mean_rate", "std_rate", f"{LIMIT!r}E0")), 6).alias("p"))


@query("fn11_date_label", f"{C.SQL} SELECT DISTINCT forecast_hour, strftime(TIMESTAMP '2025-09-08' + forecast_hour * INTERVAL 1 HOUR, '%a, %-m/%-d') AS label FROM forecast_data")
def _label(f: Frames) -> DataFrame:
    at = F.expr("timestampadd(HOUR, forecast_hour, TIMESTAMP_NTZ '2025-09-08 00:00:00')")
    return f.data.select("forecast_hour").distinct().select("forecast_hour", F.date_format(at, "E, M/d").alias("label"))


@query("fn12_cone", f"{C.SQL} SELECT run_id, forecast_hour, latitude, longitude, round(greatest(0, mean_value - std_dev), 9) AS lower1, round(mean_value + std_dev, 9) AS upper1, round(greatest(0, mean_value - 2 * std_dev), 9) AS lower2, round(mean_value + 2 * std_dev, 9) AS upper2 FROM ensemble_statistics WHERE variable_id = 1 AND std_dev IS NOT NULL")
def _cone(f: Frames) -> DataFrame:
    rows = f.stats.where("variable_id = 1 AND std_dev IS NOT NULL")
    return rows.select(*_FIELD, *(F.round(c, 9).alias(n) for n, c in E.cone(F.col("mean_value"), F.col("std_dev")).items()))


# -- joins -----------------------------------------------------------------------------------------------------------


@query("jn01_wind_mean", f"{C.SQL}, {_WIND} SELECT run_id, forecast_hour, latitude, longitude, u, v FROM wind", six=('u', 'v'))
def _wind_mean(f: Frames) -> DataFrame:
    return wind_field(f)


_MEMBER_WIND = "mw AS (SELECT u.run_id, u.forecast_hour, u.ensemble_member, u.latitude, u.longitude, sqrt(u.value * u.value + v.value * v.value) AS speed FROM forecast_data u JOIN forecast_data v USING (run_id, forecast_hour, ensemble_member, latitude, longitude) WHERE u.variable_id = 3 AND v.variable_id = 4)"


def member_wind(f: Frames) -> DataFrame:
    both = J.wind_components(f.data.where("ensemble_member IS NOT NULL"), ["run_id", "forecast_hour", "ensemble_member", "latitude", "longitude"])
    return both.withColumn("speed", E.wind_speed(F.col("u"), F.col("v")))


@query("jn02_wind_members", f"{C.SQL}, {_MEMBER_WIND} SELECT run_id, forecast_hour, ensemble_member, latitude, longitude, round_even(speed, 4) AS speed FROM mw")
def _wind_members(f: Frames) -> DataFrame:
    return member_wind(f).select("run_id", "forecast_hour", "ensemble_member", "latitude", "longitude", F.bround("speed", 4).alias("speed"))


@query("jn03_runs_models", f"{_ORDER_RUNS} SELECT run_id, model_name, ensemble_count, initialization_time FROM all_runs JOIN models USING (model_id)")
def _runs_models(f: Frames) -> DataFrame:
    return order_runs(f).join(F.broadcast(f.models), "model_id").select("run_id", "model_name", "ensemble_count", "initialization_time")


@query("jn04_latest_forecast", f"{C.SQL}, {_LATEST} SELECT rf.model_name, rf.forecast_hour, rf.latitude, rf.longitude, rf.mean_value, rf.std_dev, l.initialization_time FROM regridded_forecast rf JOIN models USING (model_name) JOIN latest l ON l.model_name = rf.model_name WHERE variable_name = 'precipitation'", six=('mean_value', 'std_dev'))
def _latest_forecast(f: Frames) -> DataFrame:
    rows = C.regridded_forecast(f.spark, f.stats).where("variable_name = 'precipitation'")
    return rows.join(f.latest.select("model_name", "initialization_time"), "model_name").select("model_name", "forecast_hour", "latitude", "longitude", "mean_value", "std_dev", "initialization_time")


@query("jn05_verified_hours", f"{C.SQL} SELECT DISTINCT forecast_hour FROM forecast_data f WHERE run_id = 1 AND variable_id = 1 AND EXISTS (SELECT 1 FROM observation_data o WHERE o.obs_time = TIMESTAMP '2024-01-02' + f.forecast_hour * INTERVAL 1 HOUR AND abs(o.latitude - 25.5) <= 0.5 AND abs(o.longitude + 84.5) <= 0.5 AND o.precipitation IS NOT NULL)")
def _verified(f: Frames) -> DataFrame:
    seen = f.observed.where(J.in_radius(F.col("latitude"), F.col("longitude"), 25.5, -84.5, 0.5) & F.col("precipitation").isNotNull())
    return J.verified_hours(f.data.where("run_id = 1 AND variable_id = 1"), seen, F.expr(f"timestampadd(HOUR, forecast_hour, {C.INIT})"))


_SNAP = f"""{C.SQL}, {_LATEST},
seen AS (SELECT obs_time, CAST(round_even(latitude * 4, 0) AS INTEGER) AS cy, CAST(round_even(longitude * 4, 0) AS INTEGER) AS cx, round_even(avg(precipitation), 10) AS obs FROM observation_data WHERE precipitation IS NOT NULL GROUP BY ALL),
snap AS (SELECT l.model_name, s.forecast_hour, s.latitude, s.longitude, s.mean_value, s.std_dev, o.obs FROM ensemble_statistics s JOIN latest l USING (run_id) JOIN seen o ON o.obs_time = l.initialization_time + s.forecast_hour * INTERVAL 1 HOUR AND o.cy = round_even(s.latitude * 4, 0) AND o.cx = round_even(s.longitude * 4, 0) WHERE s.variable_id = 1 AND s.std_dev IS NOT NULL)"""


def snapped(f: Frames) -> DataFrame:
    return J.snapped_pairs(f.timed(1), f.observed, "precipitation")


@query("jn06_snapped_pairs", f"{_SNAP} SELECT * FROM snap", six=('mean_value', 'std_dev', 'obs'))
def _snapped(f: Frames) -> DataFrame:
    return snapped(f).drop("cy", "cx")


@query("jn07_window_pairs", f"{_pairs_sql()} SELECT model_name, forecast_hour, latitude, longitude, round_even(m, 7) AS mean_rate, round_even(s, 7) AS std_rate, round_even(o, 7) AS obs_rate, n_obs FROM pairs")
def _pairs(f: Frames) -> DataFrame:
    return f.pairs().select("model_name", "forecast_hour", "latitude", "longitude", *(F.bround(c, 7).alias(c) for c in ("mean_rate", "std_rate", "obs_rate")), "n_obs")


@query("jn07_arriving_observations", f"{_pairs_sql()} SELECT model_name, latitude, longitude, " + ", ".join(f"CASE WHEN {g} THEN {v} END AS {n}" for n, (v, g) in _SPATIAL.items()) + " FROM pairs GROUP BY ALL")
def _arriving(f: Frames) -> DataFrame:
    """All observations come as a stream, in files without order in time; metrics are taken from the windows it keeps."""
    here = scratch_path(f.spark, "arriving")
    seen = f.observed.select(F.col("obs_time").cast("timestamp"), "latitude", "longitude", F.col("precipitation").alias("value"))
    files = f.spark.sparkContext.defaultParallelism  # of one batch; there are three
    seen.repartition(3 * files, F.xxhash64("obs_time", "latitude", "value")).write.parquet(f"{here}/in")
    updates = W.window_updates(O.observation_stream(f.spark, f"{here}/in", files))
    W.keep_windows(updates, f"{here}/windows", f"{here}/state").awaitTermination()
    fc = f.timed(1).where(J.in_box(F.col("latitude"), F.col("longitude"), *BOX)).select("model_name", "initialization_time", "forecast_hour", "latitude", "longitude", "mean_value", "std_dev")
    pairs = W.streamed_pairs(fc, MG.read(f.spark, f"{here}/windows"), E.accum_hours(F.col("model_name")))
    return M.score(pairs, list(M.METRICS), LIMIT)


@query("jn09_left_default", f"{C.SQL} SELECT run_id, forecast_hour, latitude, longitude, mean_value, coalesce(std_dev, 0) AS std_dev FROM ensemble_statistics WHERE variable_id = 1", six=('mean_value', 'std_dev'))
def _left(f: Frames) -> DataFrame:
    rows = f.stats.where("variable_id = 1")
    return J.with_default(rows.select(*_FIELD, "mean_value"), rows.where("std_dev IS NOT NULL").select(*_FIELD, "std_dev"), _FIELD)


# -- aggregates ------------------------------------------------------------------------------------------------------

_SERIES = "round_even(coalesce(avg(x), 0), 7) AS mean, round_even(coalesce(stddev_samp(x), 0), 7) AS std, round_even(coalesce(min(x), 0), 7) AS min, round_even(coalesce(max(x), 0), 7) AS max, " + ", ".join(f"round_even(coalesce(quantile_cont(x, {q}), 0), 7) AS p{round(q * 100)}" for q in A.PERCENTILES)
_NEAR = f"abs(latitude - {POINT[0]}) <= {RADIUS} AND abs(longitude - {POINT[1]}) <= {RADIUS}"


def at_point(frame: DataFrame) -> DataFrame:
    return frame.where(J.in_radius(F.col("latitude"), F.col("longitude"), *POINT, RADIUS))


@query("agg01_point_series", f"{C.SQL}, {_LATEST}, x AS (SELECT model_name, forecast_hour, value / accum_h AS x FROM forecast_data JOIN latest USING (run_id) WHERE variable_id = 1 AND {_NEAR}) SELECT model_name, forecast_hour, {_SERIES} FROM x GROUP BY ALL")
def _series(f: Frames) -> DataFrame:
    return A.point_series(at_point(f.timed(1, f.data)), divide=E.accum_hours(F.col("model_name")), places=7)


@query("agg02_point_wind_series", f"{C.SQL}, {_LATEST}, {_MEMBER_WIND}, x AS (SELECT model_name, forecast_hour, speed AS x FROM mw JOIN latest USING (run_id) WHERE {_NEAR}) SELECT model_name, forecast_hour, {_SERIES} FROM x GROUP BY ALL")
def _wind_series(f: Frames) -> DataFrame:
    return A.point_series(at_point(member_wind(f)).join(f.latest, "run_id"), "speed", places=7)


@query("agg03_obs_cell_mean", f"{C.SQL} SELECT obs_time, latitude, longitude, p AS value FROM obs_mean", six=('value',))
def _obs_cells(f: Frames) -> DataFrame:
    return f.observations()


@query("agg04_obs_time_mean", f"{C.SQL} SELECT obs_time, round_even(avg(p), 6) AS value FROM obs_mean WHERE abs(latitude - 25.5) <= 0.26 AND abs(longitude + 84.5) <= 0.26 GROUP BY ALL")
def _obs_times(f: Frames) -> DataFrame:
    return f.point(f.observations()).groupBy("obs_time").agg(F.bround(F.avg("value"), 6).alias("value"))


def point_obs(f: Frames, column: str = "precipitation") -> DataFrame:
    return at_point(f.observed).where(F.col(column).isNotNull()).groupBy("obs_time").agg(F.bround(F.avg(column), 10).alias("obs"))


@query("agg05_obs_point_mean", f"{C.SQL} SELECT obs_time, round_even(avg(precipitation), 10) AS obs FROM observation_data WHERE {_NEAR} AND precipitation IS NOT NULL GROUP BY ALL", six=('obs',))
def _obs_point(f: Frames) -> DataFrame:
    return point_obs(f)


@query("agg06_spread", f"{C.SQL}, {_LATEST} SELECT model_name, forecast_hour, round_even(var_pop(value / accum_h), 6) AS variance, round_even(stddev_pop(value / accum_h), 6) AS spread, round_even(avg(value / accum_h), 6) AS mean, count(*) AS n_members FROM forecast_data JOIN latest USING (run_id) WHERE variable_id = 1 AND {_NEAR} GROUP BY ALL")
def _spread(f: Frames) -> DataFrame:
    x = F.col("value") / E.accum_hours(F.col("model_name"))
    return at_point(f.timed(1, f.data)).groupBy("model_name", "forecast_hour").agg(F.bround(F.var_pop(x), 6).alias("variance"), F.bround(F.stddev_pop(x), 6).alias("spread"), F.bround(F.avg(x), 6).alias("mean"), F.count("*").alias("n_members"))


_DIS = f"{C.SQL}, dis AS (SELECT forecast_hour, latitude, longitude, round_even(stddev_samp(mean_value), 4) AS disagreement, round_even(avg(mean_value), 4) AS avg_mean, count(DISTINCT model_name) AS n_models FROM regridded_forecast WHERE variable_name = 'precipitation' AND mean_value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT model_name) >= 2)"


def model_disagreement(f: Frames) -> DataFrame:
    return A.disagreement(C.regridded_forecast(f.spark, f.stats).where("variable_name = 'precipitation'"))


@query("agg07_disagreement", f"{_DIS} SELECT * FROM dis")
def _disagreement(f: Frames) -> DataFrame:
    return model_disagreement(f)


@query("agg08_disagreement_max", f"{_DIS} SELECT max(n_models) AS max_models, max(disagreement) AS max_disagreement, count(*) AS n_points FROM dis")
def _disagreement_max(f: Frames) -> DataFrame:
    return model_disagreement(f).agg(F.max("n_models").alias("max_models"), F.max("disagreement").alias("max_disagreement"), F.count("*").alias("n_points"))


@query("agg09_field_range", f"{C.SQL} SELECT round_even(coalesce(min(mean_value) FILTER (WHERE mean_value > 0), 0.01), 6) AS min, round_even(CASE WHEN coalesce(max(mean_value), 0) <= 0 THEN 100 ELSE max(mean_value) END, 6) AS max, round_even(avg(mean_value), 4) AS mean, count(*) AS count FROM ensemble_statistics WHERE variable_id = 1 AND run_id = 1 AND forecast_hour = 12 AND mean_value IS NOT NULL")
def _range(f: Frames) -> DataFrame:
    return A.field_range(member_field(f, "mean"))


_NORM = f"{C.SQL}, field AS (SELECT latitude, longitude, mean_value, coalesce(std_dev, 0) AS std_dev FROM ensemble_statistics WHERE run_id = 1 AND variable_id = 1 AND forecast_hour = 12), top AS (SELECT coalesce(nullif(max(mean_value) FILTER (WHERE mean_value >= 0), 0), 1) AS mm, coalesce(nullif(max(std_dev) FILTER (WHERE std_dev >= 0), 0), 1) AS ms FROM field), norm AS (SELECT latitude, longitude, least(mean_value / mm, 1) AS v, least(std_dev / ms, 1) AS s FROM field, top)"


def field_shares(f: Frames) -> DataFrame:
    """A field's mean and spread as shares of their maxima (1 where a maximum is 0)."""
    field = f.stats.where("run_id = 1 AND variable_id = 1 AND forecast_hour = 12").select("latitude", "longitude", "mean_value", E.zero_if_null(F.col("std_dev")).alias("std_dev"))
    top = field.agg(*(F.coalesce(F.nullif(F.max(F.when(F.col(c) >= 0, F.col(c))), F.lit(0.0)), F.lit(1.0)).alias(n) for c, n in (("mean_value", "mm"), ("std_dev", "ms"))))
    return field.join(F.broadcast(top)).select("latitude", "longitude", F.least(F.col("mean_value") / F.col("mm"), F.lit(1.0)).alias("v"), F.least(F.col("std_dev") / F.col("ms"), F.lit(1.0)).alias("s"))


@query("agg10_field_shares", f"{_NORM} SELECT latitude, longitude, round_even(v, 6) AS v, round_even(s, 6) AS s FROM norm")
def _shares(f: Frames) -> DataFrame:
    return field_shares(f).select("latitude", "longitude", F.bround("v", 6).alias("v"), F.bround("s", 6).alias("s"))


@query("agg11_ensemble_statistics", f"{C.SQL} SELECT * FROM ensemble_statistics", six=('mean_value', 'std_dev', 'min_value', 'max_value', 'percentile_25', 'percentile_50', 'percentile_75'))
def _statistics(f: Frames) -> DataFrame:
    return C.ensemble_statistics(f.data)


@query("agg11_large_groups", f"{C.SQL} SELECT variable_id, count(value) AS n, " + ", ".join(f"round_even(quantile_cont(value, {q}), 6) AS p{round(q * 100)}" for q in A.PERCENTILES) + " FROM forecast_data GROUP BY ALL")
def _large_groups(f: Frames) -> DataFrame:
    """Percentiles of each variable over all runs, hours, members and cells: three groups of any size."""
    got = SM.exact_percentiles(f.data, ("variable_id",), "value", A.PERCENTILES)
    return got.select("variable_id", "n", *(F.bround(F.col("p")[k], 6).alias(f"p{round(q * 100)}") for k, q in enumerate(A.PERCENTILES)))


# -- point metrics ---------------------------------------------------------------------------------------------------


@query("met01_ssr", f"{_SNAP} SELECT model_name, latitude, longitude, round_even(std_dev * std_dev / ((mean_value - obs) * (mean_value - obs)), 4) AS value FROM snap WHERE forecast_hour = 6 AND (mean_value - obs) * (mean_value - obs) > 1e-10")
def _ssr(f: Frames) -> DataFrame:
    return M.single_hour_ssr(snapped(f), 6)


def _pearson_sql(x: str, y: str) -> str:
    low = f"sqrt(var_pop({x}) * count(*) * var_pop({y}) * count(*))"
    return f"round_even(CASE WHEN count(*) >= 2 AND {low} > 1e-10 THEN covar_pop({x}, {y}) * count(*) / {low} END, 4)"


_CORR = f"c AS (SELECT model_name, latitude, longitude, {_pearson_sql('std_dev', 'abs(mean_value - obs)')} AS value FROM snap WHERE forecast_hour IN {E.CORRELATION_HOURS} GROUP BY ALL)"


@query("met03_correlation", f"{_SNAP}, {_CORR}, nh AS (SELECT model_name, count(DISTINCT forecast_hour) AS n_hours FROM ensemble_statistics s JOIN latest l USING (run_id) WHERE variable_id = 1 AND std_dev IS NOT NULL AND forecast_hour IN {E.CORRELATION_HOURS} AND l.initialization_time + s.forecast_hour * INTERVAL 1 HOUR IN (SELECT obs_time FROM seen) GROUP BY ALL) SELECT c.*, n_hours FROM c LEFT JOIN nh USING (model_name) WHERE value IS NOT NULL")
def _correlation(f: Frames) -> DataFrame:
    timed = f.timed(1).where("std_dev IS NOT NULL").select("model_name", "forecast_hour", E.valid_time("initialization_time", "forecast_hour").alias("obs_time")).distinct()
    verified = timed.join(f.observed.where("precipitation IS NOT NULL").select("obs_time").distinct(), "obs_time", "left_semi")
    return M.spread_error_correlation(snapped(f), verified)


_REGISTRY = " UNION ALL ".join(
    [f"SELECT 'ssr' AS metric, model_name, latitude, longitude, {{0}}(std_dev * std_dev / ((mean_value - obs) * (mean_value - obs)), 4) AS value FROM snap WHERE forecast_hour = 6 AND (mean_value - obs) * (mean_value - obs) > 1e-10", "SELECT 'correlation', * FROM c WHERE value IS NOT NULL"]
    + [f"SELECT '{n}', model_name, latitude, longitude, {v} FROM pairs GROUP BY ALL HAVING {g}" for n, (v, g) in _SPATIAL.items()]
).replace("{0}", "round_even")


@query("met00_registry", _pairs_sql().replace(f"{C.SQL}, {_LATEST}", _SNAP) + f", {_CORR} {_REGISTRY}")
def _registry(f: Frames) -> DataFrame:
    """Every registered spatial metric; window pairs and snapped pairs are made once."""
    return M.spatial_all(M.Inputs(f.pairs(), snapped(f), LIMIT, 6))


_SKILL = f"""{C.SQL}, {_LATEST}, po AS (SELECT obs_time, round_even(avg(precipitation), 10) AS obs FROM observation_data WHERE {_NEAR} AND precipitation IS NOT NULL GROUP BY ALL),
sp AS (SELECT model_name, forecast_hour, initialization_time + forecast_hour * INTERVAL 1 HOUR AS obs_time, avg(value / accum_h) AS m, var_pop(value / accum_h) AS v, count(*) AS n_members FROM forecast_data JOIN latest USING (run_id) WHERE variable_id = 1 AND {_NEAR} AND ensemble_member IS NOT NULL GROUP BY ALL),
sk AS (SELECT model_name, forecast_hour, round_even(sqrt(v), 4) AS spread, round_even(abs(m - obs), 4) AS error, CASE WHEN (m - obs) * (m - obs) > 1e-10 THEN round_even(v / (abs(m - obs) * abs(m - obs)), 4) END AS ssr, round_even(m, 4) AS ens_mean, round_even(obs, 4) AS obs, n_members FROM sp JOIN po USING (obs_time))"""


def skill_hours(f: Frames) -> DataFrame:
    rows = at_point(f.timed(1, f.data)).where("ensemble_member IS NOT NULL").select("model_name", "forecast_hour", E.valid_time("initialization_time", "forecast_hour").alias("obs_time"), (F.col("value") / E.accum_hours(F.col("model_name"))).alias("value"))
    return A.spread_skill(rows, point_obs(f))


@query("met12_spread_skill", f"{_SKILL} SELECT * FROM sk")
def _skill(f: Frames) -> DataFrame:
    return skill_hours(f)


@query("met12_spread_skill_summary", f"{_SKILL} SELECT model_name, {_pearson_sql('spread', 'error')} AS correlation, round_even(avg(ssr), 4) AS mean_ssr, count(*) AS n_cases FROM sk GROUP BY ALL")
def _skill_summary(f: Frames) -> DataFrame:
    return A.spread_skill_summary(skill_hours(f))


QUERIES["agg12_mean_ssr"], ORACLES["agg12_mean_ssr"] = (lambda s, d: A.spread_skill_summary(skill_hours(Frames(s, d))).select("model_name", "mean_ssr")), f"{_SKILL} SELECT model_name, round_even(avg(ssr), 4) AS mean_ssr FROM sk GROUP BY ALL"

_AT = "abs(latitude - 25.5) <= 0.26 AND abs(longitude + 84.5) <= 0.26"
_CH = f"""{_pairs_sql()}, ch AS (SELECT model_name, forecast_hour, latitude, longitude, accum_h, CASE WHEN (m-o)*(m-o) > 1e-10 THEN round_even(s*s/((m-o)*(m-o)), 4) END AS ssr, round_even({_CRPS}, 6) AS crps,
round_even(m-o, 4) AS bias, round_even(abs(m-o), 4) AS mae, round_even(abs(m-o), 4) AS rmse, round_even(s, 4) AS spread, round_even(m, 4) AS mean_val, round_even(o, 4) AS obs, round_even(mean_value, 4) AS raw_mean, round_even(std_dev, 4) AS raw_std, n_obs AS n_obs_in_window FROM pairs WHERE {_AT})"""


@query("met13_compare_hours", f"{_CH} SELECT * FROM ch")
def _compare(f: Frames) -> DataFrame:
    return A.compare_hours(f.point(f.pairs()))


@query("met13_compare_wind_hours", f"{_CH.replace(_pairs_sql(), _pairs_sql(3, 'w'))} SELECT * FROM ch")
def _compare_wind(f: Frames) -> DataFrame:
    """Wind is divided by the accumulation hours here as well, as the comparison does for every variable."""
    return A.compare_hours(f.point(f.pairs(3, "wind")))


@query("met14_compare_summary", f"{_CH} SELECT model_name, round_even(avg(ssr), 4) AS mean_ssr, {_pearson_sql('spread', 'mae')} AS correlation, round_even(avg(crps), 4) AS mean_crps, round_even(avg(bias), 4) AS bias, round_even(avg(mae), 4) AS mae, round_even(sqrt(avg(rmse*rmse)), 4) AS rmse, count(DISTINCT forecast_hour) AS n_hours, (SELECT string_agg(h, ',' ORDER BY h) FROM (SELECT DISTINCT forecast_hour AS h FROM ch)) AS obs_hours FROM ch GROUP BY ALL")
def _compare_summary(f: Frames) -> DataFrame:
    return A.compare_summary(A.compare_hours(f.point(f.pairs()))).withColumn("obs_hours", F.concat_ws(",", F.transform("obs_hours", lambda h: h.cast("string"))))


@query("met15_point_events", f"{_pairs_sql()} SELECT model_name, forecast_hour, latitude, longitude, m > {_T} AS is_fcst, o > {_T} AS is_obs, round_even({_P}, 4) AS p_event, round_even(m, 4) AS mean_rate, round_even(o, 4) AS obs_rate FROM pairs WHERE {_AT}")
def _events(f: Frames) -> DataFrame:
    return A.point_events(f.point(f.pairs()), LIMIT)


def _ratios_sql(inner: str) -> str:
    return f"SELECT *, CASE WHEN hits+misses+false_alarms > 0 THEN round_even(hits/(hits+misses+false_alarms), 4) END AS csi, CASE WHEN hits+misses > 0 THEN round_even(hits/(hits+misses), 4) END AS pod, CASE WHEN hits+false_alarms > 0 THEN round_even(false_alarms/(hits+false_alarms), 4) END AS far, CASE WHEN hits+misses > 0 THEN round_even((hits+false_alarms)/(hits+misses), 4) END AS fbi FROM ({inner})"


_COUNTS = f"count(*) AS n_pts, {_H} AS hits, {_MI} AS misses, {_FA} AS false_alarms, {_CN} AS correct_neg, round_even({_BRIER}, 6) AS brier_score, avg(CASE WHEN m > {_T} THEN 1e0 ELSE 0e0 END) AS f, avg(CASE WHEN o > {_T} THEN 1e0 ELSE 0e0 END) AS ob"
_COMP = "round_even((0.40e0 * csi + 0.20e0 * pod + 0.10e0 * (1 - far)) / 0.70e0, 4)"


@query("met16_point_summary", f"{_pairs_sql()}, ps AS ({_ratios_sql(f'SELECT model_name, {_COUNTS} FROM pairs WHERE {_AT} GROUP BY ALL')}) SELECT model_name, p.* EXCLUDE (model_name) FROM (SELECT model_name FROM models WHERE model_id IN (SELECT model_id FROM forecast_runs) OR model_name = 'SPARE') LEFT JOIN (SELECT * EXCLUDE (n_pts, f, ob), {_COMP} AS composite FROM ps) p USING (model_name)")
def _point_summary(f: Frames) -> DataFrame:
    return A.point_summary(f.point(f.pairs()), LIMIT, f.models)


QUERIES["met17_point_composite"] = lambda s, d: A.point_summary(Frames(s, d).point(Frames(s, d).pairs()), LIMIT).select("model_name", "composite")
ORACLES["met17_point_composite"] = f"{_pairs_sql()}, ps AS ({_ratios_sql(f'SELECT model_name, {_COUNTS} FROM pairs WHERE {_AT} GROUP BY ALL')}) SELECT model_name, {_COMP} AS composite FROM ps"

_RH = f"{_pairs_sql()}, rh AS (SELECT * EXCLUDE (f, ob), CASE WHEN (f*f+ob*ob)*0.5e0 <= 1e-10 THEN 1 ELSE round_even(1 - (f-ob)*(f-ob)/((f*f+ob*ob)*0.5e0), 4) END AS fss, round_even(f, 4) AS fcst_frac, round_even(ob, 4) AS obs_frac FROM ({_ratios_sql(f'SELECT model_name, forecast_hour, {_COUNTS} FROM pairs GROUP BY ALL')}))"


@query("met18_region_hours", f"{_RH} SELECT * FROM rh")
def _region_hours(f: Frames) -> DataFrame:
    return A.region_hours(f.pairs(), LIMIT)


QUERIES["met19_fss"], ORACLES["met19_fss"] = (lambda s, d: A.region_hours(Frames(s, d).pairs(), LIMIT).select("model_name", "forecast_hour", "fss")), f"{_RH} SELECT model_name, forecast_hour, fss FROM rh"
_RS = f"{_RH}, pooled AS ({_ratios_sql(f'SELECT model_name, {_COUNTS} FROM pairs GROUP BY ALL')}), cells AS (SELECT model_name, count(*) AS n_grid_pts FROM (SELECT DISTINCT model_name, latitude, longitude FROM ensemble_statistics JOIN latest USING (run_id) WHERE variable_id = 1 AND latitude BETWEEN {BOX[0]} AND {BOX[1]} AND longitude BETWEEN {BOX[2]} AND {BOX[3]}) GROUP BY ALL), sk AS (SELECT model_name, round_even(avg(fss), 4) AS fss FROM rh GROUP BY ALL), rs AS (SELECT * EXCLUDE (f, ob), CASE WHEN fss IS NULL THEN {_COMP} ELSE round_even(0.40e0 * csi + 0.30e0 * fss + 0.20e0 * pod + 0.10e0 * (1 - far), 4) END AS composite FROM cells LEFT JOIN pooled USING (model_name) LEFT JOIN sk USING (model_name))"


def region(f: Frames) -> DataFrame:
    fc = f.timed(1).where(J.in_box(F.col("latitude"), F.col("longitude"), *BOX))
    return A.region_summary(f.pairs(), fc, LIMIT)


@query("met20_region_summary", f"{_RS} SELECT * FROM rs")
def _region(f: Frames) -> DataFrame:
    return region(f)


_BOXES = "boxes AS (SELECT s_suppkey AS box_id, 24.75 + (s_suppkey % 5) * 0.375::DOUBLE AS south, 24.75 + (s_suppkey % 5) * 0.375::DOUBLE + (s_suppkey % 7) * 0.25::DOUBLE AS north, -85.5 + (s_suppkey % 3) * 0.5::DOUBLE AS west, -85.5 + (s_suppkey % 3) * 0.5::DOUBLE + (s_suppkey % 11) * 0.25::DOUBLE AS east FROM supplier)"


@query("met18_any_box", f"{_pairs_sql()}, {_BOXES}, b AS (SELECT box_id, model_name, forecast_hour, count(*) AS n_pts, {_H} AS hits, {_MI} AS misses, {_FA} AS false_alarms, {_CN} AS correct_neg, round_even({_BRIER}, 6) AS brier_score FROM pairs JOIN boxes ON latitude BETWEEN south AND north AND longitude BETWEEN west AND east GROUP BY ALL) SELECT *, CASE WHEN hits + misses + false_alarms > 0 THEN round_even(hits / (hits + misses + false_alarms), 4) END AS csi, CASE WHEN hits + misses > 0 THEN round_even(hits / (hits + misses), 4) END AS pod, CASE WHEN hits + false_alarms > 0 THEN round_even(false_alarms / (hits + false_alarms), 4) END AS far FROM b")
def _any_box(f: Frames) -> DataFrame:
    """Scores of a box for every supplier, each model and lead hour, from one set of summed-area tables."""
    k = F.col("s_suppkey")
    south, west = 24.75 + k % 5 * 0.375, -85.5 + k % 3 * 0.5
    boxes = f.spark.read.parquet(f"{f.sf}/supplier.parquet").select(k.alias("box_id"), south.alias("south"), (south + k % 7 * 0.25).alias("north"), west.alias("west"), (west + k % 11 * 0.25).alias("east"))
    return M.box_scores(f.pairs(), LIMIT, boxes).select("box_id", "model_name", "forecast_hour", "n_pts", "hits", "misses", "false_alarms", "correct_neg", "brier_score", "csi", "pod", "far")


@query("met21_region_composite", f"{_RS} SELECT model_name, composite FROM rs")
def _region_composite(f: Frames) -> DataFrame:
    return region(f).select("model_name", "composite")


@query("met22_cumulative", f"{_RH}, cu AS (SELECT model_name, forecast_hour, sum(hits) OVER w AS h, sum(misses) OVER w AS m, sum(false_alarms) OVER w AS fa FROM rh WINDOW w AS (PARTITION BY model_name ORDER BY forecast_hour)) SELECT model_name, forecast_hour, CASE WHEN h+m+fa > 0 THEN round_even(h/(h+m+fa), 3) END AS csi, CASE WHEN h+m > 0 THEN round_even(h/(h+m), 3) END AS pod, CASE WHEN h+fa > 0 THEN round_even(fa/(h+fa), 3) END AS far FROM cu")
def _cumulative(f: Frames) -> DataFrame:
    return A.cumulative_ratios(A.region_hours(f.pairs(), LIMIT))


@query("met23_coverage", f"{_pairs_sql()} SELECT model_name, count(DISTINCT forecast_hour) AS n_hours, min(forecast_hour) AS first_hour, max(forecast_hour) AS last_hour FROM pairs GROUP BY ALL")
def _coverage(f: Frames) -> DataFrame:
    return A.coverage(f.pairs())


@query("met24_tiers", f"{_SKILL} SELECT model_name, forecast_hour, CAST(CASE WHEN ssr IS NULL THEN NULL WHEN ssr < 0.5 THEN 1 WHEN ssr < 0.8 THEN 2 WHEN ssr <= 1.2 THEN 3 WHEN ssr <= 2.0 THEN 4 ELSE 5 END AS INTEGER) AS tier FROM sk")
def _tiers(f: Frames) -> DataFrame:
    edges = A.EDGES["ssr"]
    return skill_hours(f).select("model_name", "forecast_hour", E.tier(F.col("ssr"), [(sign, edge, k + 1) for k, (sign, edge) in enumerate(edges)], len(edges) + 1).alias("tier"))


_HALF = "CAST(floor({0} + ({1} - {0}) * (value + 1) + 0.5) AS INTEGER)", "CAST(floor({0} + ({1} - {0}) * value + 0.5) AS INTEGER)"


@query("met24_correlation_colours", f"{_SNAP}, {_CORR} SELECT model_name, latitude, longitude, " + ", ".join(f"CASE WHEN value <= 0 THEN {_HALF[0].format(a, 240)} ELSE {_HALF[1].format(240, b)} END AS {c}" for c, a, b in (("r", 52, 231), ("g", 152, 76), ("b", 219, 60))) + " FROM c WHERE value IS NOT NULL")
def _correlation_colours(f: Frames) -> DataFrame:
    return M.spread_error_correlation(snapped(f)).select("model_name", "latitude", "longitude", *(c.alias(n) for n, c in A.correlation_colour(F.col("value")).items()))


def _tier_sql(name: str) -> str:
    edges = A.EDGES[name]
    return f"SELECT model_name, latitude, longitude, '{name}' AS metric, CAST({name} AS DOUBLE) AS value, CASE " + " ".join(f"WHEN {name} {sign} {edge} THEN {k + 1}" for k, (sign, edge) in enumerate(edges)) + f" ELSE {len(edges) + 1} END AS tier FROM sc WHERE {name} IS NOT NULL"


@query("met24_metric_tiers", f"{_pairs_sql()}, sc AS (SELECT model_name, latitude, longitude, " + ", ".join(f"CASE WHEN {g} THEN {v} END AS {n}" for n, (v, g) in _SPATIAL.items()) + " FROM pairs GROUP BY ALL) " + " UNION ALL ".join(map(_tier_sql, _SPATIAL)))
def _metric_tiers(f: Frames) -> DataFrame:
    return A.with_tiers(M.score(f.pairs(), list(M.METRICS), LIMIT), list(M.METRICS))


# -- grids and reshaping ---------------------------------------------------------------------------------------------

_POINTS = f"{C.SQL}, pts AS (SELECT latitude, longitude, mean_value AS value FROM ensemble_statistics WHERE run_id = 1 AND variable_id = 1 AND forecast_hour = 12)"


def points(f: Frames) -> DataFrame:
    return member_field(f, "mean")


_NODES = "box AS (SELECT min(latitude) s, max(latitude) n, min(longitude) w, max(longitude) e FROM {0}), nodes AS (SELECT s + i * {1} AS ty, w + j * {1} AS tx FROM box, range(1000) a(i), range(1000) b(j) WHERE i <= floor((n - s) / {1} + 1e-9) AND j <= floor((e - w) / {1} + 1e-9))"


@query("grd01_idw", f"{_POINTS}, {_NODES.format('pts', '0.25e0')}, near AS (SELECT ty, tx, value, ((latitude-ty)*(latitude-ty)+(longitude-tx)*(longitude-tx)) AS d FROM nodes, pts WHERE (latitude-ty)*(latitude-ty)+(longitude-tx)*(longitude-tx) < 0.5625), w AS (SELECT ty, tx, value, CASE WHEN d / 0.0004e0 < 1 THEN 1 ELSE 1 / ((d / 0.0004e0) * (d / 0.0004e0)) END AS w FROM near) SELECT ty, tx, round_even(greatest(sum(w * value) / sum(w), 0), 6) AS value FROM w GROUP BY ALL")
def _idw(f: Frames) -> DataFrame:
    return G.idw(points(f)).withColumn("value", F.bround("value", 6))


@query("grd02_bucketed", f"{_POINTS}, t AS (SELECT max(value) AS top FROM pts) SELECT latitude, longitude, round(CASE WHEN top > 0 AND least(value / top, 1) >= 0.01 THEN (floor(least(least(value / top, 1), 0.9999) * 6) + 0.5) / 6 * top ELSE value END, 6) AS value FROM pts, t")
def _bucketed(f: Frames) -> DataFrame:
    p = points(f)
    return p.join(F.broadcast(p.agg(F.max("value").alias("top")))).select("latitude", "longitude", F.bround(E.bucketed_value(F.col("value"), F.col("top"), 6), 6).alias("value"))


@query("grd03_dense", f"{_POINTS}, k AS (SELECT CAST(latitude * 2 AS INTEGER) AS cy, CAST(longitude * 2 AS INTEGER) AS cx, value FROM pts) SELECT cy / 2 AS latitude, cx / 2 AS longitude, value, cy / 2 - 0.25 AS south, cy / 2 + 0.25 AS north, cx / 2 - 0.25 AS west, cx / 2 + 0.25 AS east FROM (SELECT DISTINCT cy FROM k) CROSS JOIN (SELECT DISTINCT cx FROM k) LEFT JOIN k USING (cy, cx)", six=('value',))
def _dense(f: Frames) -> DataFrame:
    return G.dense(points(f), 2)


@query("grd04_decimate", f"{_POINTS} SELECT latitude, longitude, value FROM (SELECT *, row_number() OVER (PARTITION BY floor(latitude + 0.5), floor(longitude + 0.5) ORDER BY latitude, longitude) AS k FROM pts) WHERE k = 1", six=('value',))
def _decimate(f: Frames) -> DataFrame:
    return G.decimate(points(f))


@query("grd05_grid_step", f"{_POINTS} SELECT greatest(coalesce((SELECT y FROM (SELECT DISTINCT latitude AS y FROM pts) ORDER BY 1 LIMIT 1 OFFSET 1) - min(latitude), 0.25), coalesce((SELECT x FROM (SELECT DISTINCT longitude AS x FROM pts) ORDER BY 1 LIMIT 1 OFFSET 1) - min(longitude), 0.25)) AS step FROM pts")
def _step(f: Frames) -> DataFrame:
    return G.grid_step(points(f))


_W1 = f"{C.SQL}, {_WIND}, w1 AS (SELECT latitude, longitude, u, v FROM wind WHERE run_id = 1 AND forecast_hour = 12)"


def one_wind(f: Frames) -> DataFrame:
    return wind_field(f).where("run_id = 1 AND forecast_hour = 12").select("latitude", "longitude", "u", "v")


def _nearest(step: str, reach: str = "1e9") -> str:
    return f"{_NODES.format('w1', step)}, nn AS (SELECT * FROM (SELECT ty, tx, u, v, row_number() OVER (PARTITION BY ty, tx ORDER BY (latitude-ty)*(latitude-ty)+(longitude-tx)*(longitude-tx), latitude, longitude) AS k FROM nodes, w1 WHERE (latitude-ty)*(latitude-ty)+(longitude-tx)*(longitude-tx) < {reach}) WHERE k = 1)"


@query("grd06_arrows", f"{_W1}, {_nearest('0.5e0', '0.5625')} SELECT ty, tx, round_even(atan2(v, u), 6) AS angle, round_even(least(sqrt(u*u+v*v) * 3, 32), 6) AS length FROM nn WHERE u <> 0 AND sqrt(u*u+v*v) >= 0.5")
def _arrows(f: Frames) -> DataFrame:
    return G.arrows(one_wind(f))


@query("grd07_resample", f"{_W1}, {_nearest('0.2e0')} SELECT round_even(ty, 6) AS ty, round_even(tx, 6) AS tx, u, v FROM nn", six=('u', 'v'))
def _resample(f: Frames) -> DataFrame:
    return G.resample(one_wind(f), 0.2).select(F.bround("ty", 6).alias("ty"), F.bround("tx", 6).alias("tx"), "u", "v")


@query("grd08_streamlines")
def _streamlines(f: Frames) -> DataFrame:
    return G.streamlines(one_wind(f)).drop("dots")


@query("grd09_arc_points")
def _arc(f: Frames) -> DataFrame:
    return G.streamlines(one_wind(f)).select("seed_y", "seed_x", F.posexplode("dots").alias("k", "dot"))


# -- the same grids over all runs and lead hours, one job each -----------------------------------------------------

FIELD = ("run_id", "forecast_hour")
_EVERY = f"{C.SQL}, pts AS (SELECT run_id, forecast_hour, latitude, longitude, coalesce(mean_value, 0) AS value FROM ensemble_statistics WHERE variable_id = 1), w1 AS (SELECT u.run_id, u.forecast_hour, u.latitude, u.longitude, u.mean_value AS u, v.mean_value AS v FROM ensemble_statistics u JOIN ensemble_statistics v USING (run_id, forecast_hour, latitude, longitude) WHERE u.variable_id = 3 AND v.variable_id = 4)"
_ALL_NODES = "box AS (SELECT run_id, forecast_hour, min(latitude) s, max(latitude) n, min(longitude) w, max(longitude) e FROM {0} GROUP BY ALL), nodes AS (SELECT run_id, forecast_hour, s + i * {1} AS ty, w + j * {1} AS tx FROM box, range(100) a(i), range(100) b(j) WHERE i <= floor((n - s) / {1} + 1e-9) AND j <= floor((e - w) / {1} + 1e-9))"
_D2 = "(latitude-ty)*(latitude-ty)+(longitude-tx)*(longitude-tx)"


def _all_nearest(step: str, reach: str = "1e9") -> str:
    return f"{_ALL_NODES.format('w1', step)}, nn AS (SELECT * FROM (SELECT nodes.run_id, nodes.forecast_hour, ty, tx, u, v, row_number() OVER (PARTITION BY nodes.run_id, nodes.forecast_hour, ty, tx ORDER BY {_D2}, latitude, longitude) AS k FROM nodes JOIN w1 USING (run_id, forecast_hour) WHERE {_D2} < {reach}) WHERE k = 1)"


def all_points(f: Frames) -> DataFrame:
    """Precipitation fields of all runs and lead hours."""
    return f.stats.where("variable_id = 1").select(*FIELD, "latitude", "longitude", E.zero_if_null(F.col("mean_value")).alias("value"))


def all_winds(f: Frames) -> DataFrame:
    return wind_field(f).select(*FIELD, "latitude", "longitude", "u", "v")


@query("grd01_idw_all_fields", f"{_EVERY}, {_ALL_NODES.format('pts', '0.25e0')}, near AS (SELECT run_id, forecast_hour, ty, tx, value, {_D2} AS d FROM nodes JOIN pts USING (run_id, forecast_hour) WHERE {_D2} < 0.5625), w AS (SELECT *, CASE WHEN d / 0.0004e0 < 1 THEN 1 ELSE 1 / ((d / 0.0004e0) * (d / 0.0004e0)) END AS w FROM near) SELECT run_id, forecast_hour, ty, tx, round_even(greatest(sum(w * value) / sum(w), 0), 6) AS value FROM w GROUP BY ALL")
def _idw_all(f: Frames) -> DataFrame:
    return G.idw(all_points(f), by=FIELD).withColumn("value", F.bround("value", 6))


@query("grd03_dense_all_fields", f"{_EVERY}, k AS (SELECT run_id, forecast_hour, CAST(latitude * 2 AS INTEGER) AS cy, CAST(longitude * 2 AS INTEGER) AS cx, value FROM pts) SELECT run_id, forecast_hour, cy / 2 AS latitude, cx / 2 AS longitude, value, cy / 2 - 0.25 AS south, cy / 2 + 0.25 AS north, cx / 2 - 0.25 AS west, cx / 2 + 0.25 AS east FROM (SELECT DISTINCT run_id, forecast_hour, cy FROM k) JOIN (SELECT DISTINCT run_id, forecast_hour, cx FROM k) USING (run_id, forecast_hour) LEFT JOIN k USING (run_id, forecast_hour, cy, cx)", six=("value",))
def _dense_all(f: Frames) -> DataFrame:
    return G.dense(all_points(f), 2, FIELD)


@query("grd04_decimate_all_fields", f"{_EVERY} SELECT run_id, forecast_hour, latitude, longitude, value FROM (SELECT *, row_number() OVER (PARTITION BY run_id, forecast_hour, floor(latitude + 0.5), floor(longitude + 0.5) ORDER BY latitude, longitude) AS k FROM pts) WHERE k = 1", six=("value",))
def _decimate_all(f: Frames) -> DataFrame:
    return G.decimate(all_points(f), FIELD)


@query("grd05_grid_step_all_fields", f"{_EVERY}, y AS (SELECT run_id, forecast_hour, list(DISTINCT latitude ORDER BY latitude) AS ys, list(DISTINCT longitude ORDER BY longitude) AS xs FROM pts GROUP BY ALL) SELECT run_id, forecast_hour, greatest(coalesce(ys[2] - ys[1], 0.25), coalesce(xs[2] - xs[1], 0.25)) AS step FROM y")
def _step_all(f: Frames) -> DataFrame:
    return G.grid_step(all_points(f), by=FIELD)


@query("grd06_arrows_all_fields", f"{_EVERY}, {_all_nearest('0.5e0', '0.5625')} SELECT run_id, forecast_hour, ty, tx, round_even(atan2(v, u), 6) AS angle, round_even(least(sqrt(u*u+v*v) * 3, 32), 6) AS length FROM nn WHERE u <> 0 AND sqrt(u*u+v*v) >= 0.5")
def _arrows_all(f: Frames) -> DataFrame:
    return G.arrows(all_winds(f), by=FIELD)


@query("grd07_resample_all_fields", f"{_EVERY}, {_all_nearest('0.2e0')} SELECT run_id, forecast_hour, round_even(ty, 6) AS ty, round_even(tx, 6) AS tx, u, v FROM nn", six=("u", "v"))
def _resample_all(f: Frames) -> DataFrame:
    return G.resample(all_winds(f), 0.2, FIELD).select(*FIELD, F.bround("ty", 6).alias("ty"), F.bround("tx", 6).alias("tx"), "u", "v")


@query("grd09_lines", f"""{C.SQL}, p AS (SELECT run_id, variable_id, latitude, longitude, forecast_hour AS x, mean_value AS y FROM ensemble_statistics),
g AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY run_id, variable_id, latitude, longitude ORDER BY x)),
c AS (SELECT *, sqrt((x1-x)*(x1-x)+(y1-y)*(y1-y)) AS l FROM g WHERE x1 IS NOT NULL), d AS (SELECT *, sum(l) OVER (PARTITION BY run_id, variable_id, latitude, longitude ORDER BY x) AS upto, sum(l) OVER (PARTITION BY run_id, variable_id, latitude, longitude) AS whole FROM c)
SELECT run_id, variable_id, latitude, longitude, count(*) AS n_dots, round_even(sum(y + (y1-y) * (k * 40 - upto + l) / l), 5) AS sum_y, round_even(sum(x + (x1-x) * (k * 40 - upto + l) / l), 5) AS sum_x FROM d, range(0, 100) t(k) WHERE whole >= 10 AND k * 40 >= upto - l AND k * 40 < upto GROUP BY ALL""")
def _lines(f: Frames) -> DataFrame:
    """The course of every cell's mean over lead hours, as a line with dots at equal distances."""
    by = ("run_id", "variable_id", "latitude", "longitude")
    dots = G.line_dots(f.stats.select(*by, F.col("forecast_hour").cast("double").alias("k"), F.col("mean_value").alias("y"), F.col("forecast_hour").cast("double").alias("x")), by)
    return dots.groupBy(*by).agg(F.count("*").alias("n_dots"), F.bround(F.sum("y"), 5).alias("sum_y"), F.bround(F.sum("x"), 5).alias("sum_x"))


@query("grd08_streamlines_all_fields")
def _streamlines_all(f: Frames) -> DataFrame:
    return G.streamlines(all_winds(f), by=FIELD).drop("dots")


def _snap_sql(x: str, n: int) -> str:
    return f"(floor(least(greatest({x}, 0), 0.9999) * {n}) + 0.5) / {n}"


@query("grd10_snap", f"{_NORM} SELECT latitude, longitude, round_even({_snap_sql('v', 5)}, 6) AS v, round_even({_snap_sql('1 - s', 5)}, 6) AS s FROM norm")
def _snap(f: Frames) -> DataFrame:
    return field_shares(f).select("latitude", "longitude", F.bround(E.snap(F.col("v"), 5), 6).alias("v"), F.bround(E.snap(1 - F.col("s"), 5), 6).alias("s"))


_RINGS = {1: [8, 4, 2, 1], 2: [2, 1], 5: [5, 2, 1], 16: [16, 8, 4, 2, 1]}


@query("grd11_vsup_levels", " UNION ALL ".join(f"SELECT CAST({n} AS INTEGER) AS buckets, round_even((ring + 0.5) / {len(r)}, 6) AS s, count(*) AS n_lines, count(DISTINCT v) AS n_values FROM (SELECT least(floor(l_discount * 10 * {len(r)}), {len(r) - 1})::INTEGER AS ring, floor(least(l_quantity / 50, 0.9999) * {r}[ring + 1]) AS v FROM lineitem) GROUP BY ALL" for n, r in _RINGS.items()))
def _levels(f: Frames) -> DataFrame:
    """All order lines as value and uncertainty, quantised in trees of 1, 2, 5 and 16 values."""
    line, out = f.spark.read.parquet(f"{f.sf}/lineitem.parquet").select((F.col("l_quantity") / 50).alias("v"), (F.col("l_discount") * 10).alias("s")), None
    for n in _RINGS:
        v, s = E.vsup_snap(F.col("v"), F.col("s"), n)
        rows = line.select(F.lit(n).alias("buckets"), F.bround(s, 6).alias("s"), v.alias("v")).groupBy("buckets", "s").agg(F.count("*").alias("n_lines"), F.count_distinct("v").alias("n_values"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("grd12_vsup_snap", f"{_NORM}, r AS (SELECT *, least(floor(s * 4), 3)::INTEGER AS ring FROM norm) SELECT latitude, longitude, round((floor(least(greatest(v, 0), 0.9999) * [8, 4, 2, 1][ring + 1]) + 0.5) / [8, 4, 2, 1][ring + 1], 6) AS v, round_even((ring + 0.5) / 4, 6) AS s FROM r")
def _vsup(f: Frames) -> DataFrame:
    v, s = E.vsup_snap(F.col("v"), F.col("s"), 8)
    return field_shares(f).select("latitude", "longitude", F.bround(v, 6).alias("v"), F.bround(s, 6).alias("s"))


def _map_sql(at: str, name: str, k: int) -> str:
    stops = [int(c[k : k + 2], 16) for c in E.COLORMAPS[name]]
    n = len(stops) - 1
    seg = f"least(floor(least({at}, 0.9999) * {n}), {n - 1})::INTEGER"
    return f"floor({stops}[{seg} + 1] + ({stops}[{seg} + 2] - {stops}[{seg} + 1]) * (({at}) * {n} - {seg}) + 0.5)"


@query("grd13_muted_colour", f"{_NORM} SELECT latitude, longitude, " + ", ".join(f"CAST(floor(({_map_sql('(v * (1 - s * 0.92) + s * 0.92 * 0.5)', 'Viridis', k)}) + (185 - ({_map_sql('(v * (1 - s * 0.92) + s * 0.92 * 0.5)', 'Viridis', k)})) * (s * 0.92 * 0.80) + 0.5) AS BIGINT) AS {c}" for k, c in ((1, "r"), (3, "g"), (5, "b"))) + " FROM norm")
def _muted(f: Frames) -> DataFrame:
    return field_shares(f).select("latitude", "longitude", *(c.cast("bigint").alias(n) for c, n in zip(E.muted_colour(F.col("v"), F.col("s"), True, "Viridis"), "rgb")))


@query("grd14_box_size", f"{_NORM} SELECT latitude, longitude, round_even(0.08 + sqrt(least(greatest(s, 0), 1)) * 0.32, 6) AS half FROM norm")
def _box(f: Frames) -> DataFrame:
    return field_shares(f).select("latitude", "longitude", F.bround(E.box_half_size(F.col("s")), 6).alias("half"))


@query("grd15_colormap", f"{_NORM} SELECT latitude, longitude, " + ", ".join(f"CAST({_map_sql('v', 'Default', k)} AS BIGINT) AS {c}" for k, c in ((1, "r"), (3, "g"), (5, "b"))) + ", CAST(CASE WHEN v < 0.01 THEN 0 ELSE floor((0.5 + v * 0.3) * 255 + 0.5) END AS BIGINT) AS a FROM norm")
def _colormap(f: Frames) -> DataFrame:
    alpha = F.when(F.col("v") < 0.01, 0).otherwise(E.half_up((0.5 + F.col("v") * 0.3) * 255))
    return field_shares(f).select("latitude", "longitude", *(c.cast("bigint").alias(n) for c, n in zip([*E.colormap(F.col("v")), alpha], "rgba")))


for _name in ("RdYlBu", "Spectral"):
    query(f"grd15_{_name.lower()}", f"{_NORM} SELECT latitude, longitude, " + ", ".join(f"CAST({_map_sql('v', _name, k)} AS BIGINT) AS {c}" for k, c in ((1, "r"), (3, "g"), (5, "b"))) + " FROM norm")(lambda f, name=_name: field_shares(f).select("latitude", "longitude", *(c.cast("bigint").alias(n) for c, n in zip(E.colormap(F.col("v"), name), "rgb"))))


@query("grd16_textures", f"{_NORM} SELECT latitude, longitude, round_even(greatest(1.5, 30 * (1 - s * 0.95)), 6) AS spacing, round_even(s * (10 * 0.92), 6) AS square FROM norm")
def _textures(f: Frames) -> DataFrame:
    return field_shares(f).select("latitude", "longitude", F.bround(E.line_spacing(F.col("s"), 12.0, 10.0), 6).alias("spacing"), F.bround(E.square_size(F.col("s"), 12.0, 10.0), 6).alias("square"))


_RF = f"{C.SQL}, rs AS (SELECT model_name, forecast_hour, latitude, longitude, mean_value, std_dev, mean_value / accum_h AS m, coalesce(std_dev, 0) / accum_h AS s FROM regridded_forecast JOIN models USING (model_name) WHERE variable_name = 'precipitation' AND {_AT} AND model_name IN ('AIFS', 'GEFS', 'UKMO'))"


def box_series(f: Frames) -> DataFrame:
    return f.point(C.regridded_forecast(f.spark, f.stats)).where((F.col("variable_name") == "precipitation") & F.col("model_name").isin(MODELS3)).select("model_name", "forecast_hour", "latitude", "longitude", "mean_value", "std_dev")


@query("rsh01_series", f"{_RF} SELECT model_name, forecast_hour, latitude, longitude, round_even(mean_value, 4) AS mean, round_even(std_dev, 4) AS std FROM rs")
def _box_series(f: Frames) -> DataFrame:
    return box_series(f).select("model_name", "forecast_hour", "latitude", "longitude", F.bround("mean_value", 4).alias("mean"), F.bround("std_dev", 4).alias("std"))


_WIDE = {"mean": "m", "hi": "(mean_value + coalesce(std_dev, 0)) / accum_h", "lo": "greatest(0, (mean_value - coalesce(std_dev, 0)) / accum_h)", "raw_mean": "mean_value", "raw_std": "std_dev"}


@query("rsh02_pivot", _RF.replace("mean_value / accum_h AS m", "accum_h, mean_value / accum_h AS m") + ", f1 AS (SELECT *, row_number() OVER (PARTITION BY model_name, forecast_hour ORDER BY latitude, longitude) AS k FROM rs) SELECT forecast_hour, " + ", ".join(f"round_even(max({x}) FILTER (WHERE model_name = '{m}'), 7) AS \"{m}_{n}\"" for m in MODELS3 for n, x in _WIDE.items()) + " FROM f1 WHERE k = 1 GROUP BY ALL")
def _pivot(f: Frames) -> DataFrame:
    return A.merged_series(box_series(f), MODELS3, places=7)


@query("rsh03_normalised", f"{_RF}, pk AS (SELECT model_name, CASE WHEN max(m + s) > 1e-9 THEN max(m + s) ELSE 1 END AS peak FROM (SELECT model_name, (mean_value + coalesce(std_dev, 0)) AS ms, m, s FROM rs) GROUP BY ALL) SELECT model_name, forecast_hour, latitude, longitude, round_even(m / peak, 6) AS share FROM rs JOIN pk USING (model_name)")
def _normalised(f: Frames) -> DataFrame:
    return A.normalised(box_series(f))


@query("rsh04_scale_ratio", f"{_RF}, pk AS (SELECT model_name, max(m + s) AS peak FROM rs GROUP BY ALL) SELECT CASE WHEN count(*) < 2 THEN 1 ELSE round_even(max(peak) / min(peak), 4) END AS ratio, (CASE WHEN count(*) < 2 THEN 1 ELSE round_even(max(peak) / min(peak), 4) END) > 5 AS warn FROM pk WHERE peak > 0")
def _scale(f: Frames) -> DataFrame:
    return A.scale_ratio(box_series(f))


@query("rsh06_hour_union", f"{_CH} SELECT forecast_hour, count(DISTINCT model_name) AS n_models FROM ch GROUP BY ALL ORDER BY 1")
def _hour_union(f: Frames) -> DataFrame:
    return A.hour_union(A.compare_hours(f.point(f.pairs())))


for _v in ("ssr", "crps"):
    query(f"rsh05_{_v}_by_hour", f"{_CH}, f1 AS (SELECT *, row_number() OVER (PARTITION BY model_name, forecast_hour ORDER BY latitude, longitude) AS k FROM ch) SELECT forecast_hour, " + ", ".join(f"max({_v}) FILTER (WHERE model_name = '{m}') AS \"{m}\"" for m in MODELS3) + " FROM f1 WHERE k = 1 GROUP BY ALL")(lambda f, v=_v: A.wide_by_hour(A.compare_hours(f.point(f.pairs())), v, MODELS3))





def grid_files(f: Frames, folder: str, kinds: tuple[str, ...], variables: tuple[int, ...] = (1, 3, 4)) -> None:
    """Writes all runs' fields as grid files, one for each run, variable, lead hour and member, mean or deviation."""
    at = F.format_string("%s-%03dh-x_", F.lower("model_name"), "forecast_hour")
    keyed = lambda rows, name, value: rows.where(F.col("variable_id").isin(*variables)).join(F.broadcast(f.latest.select("model_name", "run_id")), "run_id").select("run_id", "variable_id", F.concat(at, name).alias("file"), "latitude", "longitude", F.col(value).alias("value"))
    out = {"member": lambda: keyed(f.data, F.format_string("member_%d.json", "ensemble_member"), "value"), "mean": lambda: keyed(f.stats, F.lit("mean.json"), "mean_value"), "std": lambda: keyed(f.stats, F.lit("std.json"), "std_dev")}
    for kind in kinds:
        S.write_grid_files(out[kind](), folder, "append")


def broken_files(f: Frames, folder: str) -> None:
    """A file that is no JSON, an empty one and one without a place, among the others."""
    rows = [(1, 1, "bad.json", "{oops"), (1, 1, "none.json", "[]"), (1, 1, "placeless-6h-x_mean.json", '[{"lat": 25.0}]')]
    S.write_texts(f.spark.createDataFrame(rows, "run_id int, variable_id int, file string, content string"), folder, "append")


def loader_folders(f: Frames) -> tuple[str, str, str]:
    here = scratch_path(f.spark, "loader")
    return f"{here}/files", f"{here}/data", f"{here}/stats"


@query("src01_loaded_members", f"{C.SQL} SELECT run_id, variable_id, forecast_hour, ensemble_member, latitude, longitude, value FROM forecast_data WHERE variable_id = 1", six=("value",))
def _loaded_members(f: Frames) -> DataFrame:
    """Members of all runs, written as files and loaded."""
    files, data, stats = loader_folders(f)
    grid_files(f, files, ("member",), (1,))
    broken_files(f, files)
    S.load(S.read_grid_tree(f.spark, files), data, stats)
    return MG.read(f.spark, data)


_FIELDS_SQL = f"{C.SQL} SELECT run_id, variable_id, forecast_hour, latitude, longitude, mean_value, std_dev FROM ensemble_statistics"


@query("src06_loaded_statistics", f"{_FIELDS_SQL} WHERE variable_id = 1", six=("mean_value", "std_dev"))
def _loaded_statistics(f: Frames) -> DataFrame:
    files, data, stats = loader_folders(f)
    grid_files(f, files, ("mean", "std"), (1,))
    broken_files(f, files)
    S.load(S.read_grid_tree(f.spark, files), data, stats)
    return MG.read(f.spark, stats)


@query("src06_late_deviations", _FIELDS_SQL, six=("mean_value", "std_dev"))
def _late_deviations(f: Frames) -> DataFrame:
    """Means of all runs and variables are loaded, their deviations later and twice."""
    files, data, stats = loader_folders(f)
    for k, kind in enumerate(("mean", "std")):
        grid_files(f, f"{files}{k}", (kind,))
    for k in (0, 1, 1):
        S.load(S.read_grid_tree(f.spark, f"{files}{k}"), data, stats)
    MG.vacuum(f.spark, stats)
    return MG.read(f.spark, stats)


for _k, _models in (("src09", ("AIFS",)), ("src10", ("GEFS", "UKMO"))):

    @query(f"{_k}_wind_folders", f"{C.SQL}, {_LATEST} SELECT run_id, variable_id, forecast_hour, count(*) AS n_points, round_even(sum(mean_value), 4) AS total FROM ensemble_statistics JOIN latest USING (run_id) WHERE variable_id IN (3, 4) AND model_name IN {str(_models).replace(',)', ')')} GROUP BY ALL")
    def _wind_folders(f: Frames, models: tuple[str, ...] = _models) -> DataFrame:
        """A folder of each run and wind component, loaded one after the other by the names that they stand under."""
        files, data, stats = loader_folders(f)
        grid_files(f, files, ("mean",), (3, 4))
        for run in (r for r, m, _ in C.RUNS if r < 10 and C.MODELS[m - 1][1] in models):
            S.load_folders(f.spark, {f"{files}/run_id={run}/variable_id={v}": v for v in (3, 4)}, run, data, stats)
        return MG.read(f.spark, stats).groupBy("run_id", "variable_id", "forecast_hour").agg(F.count("*").alias("n_points"), F.bround(F.sum("mean_value"), 4).alias("total"))


@query("src03_file_report", f"{C.SQL}, {_LATEST}, d AS (SELECT lower(model_name) || '-' || lpad(CAST(forecast_hour AS VARCHAR), 3, '0') || 'h-x_' AS stem, ensemble_member FROM forecast_data JOIN latest USING (run_id) WHERE variable_id = 1), s AS (SELECT lower(model_name) || '-' || lpad(CAST(forecast_hour AS VARCHAR), 3, '0') || 'h-x_' AS stem FROM ensemble_statistics JOIN latest USING (run_id) WHERE variable_id = 1) SELECT stem || 'member_' || ensemble_member || '.json' AS file, count(*) AS n_points, CAST(0 AS BIGINT) AS n_errors FROM d GROUP BY ALL UNION ALL SELECT stem || 'mean.json', count(*), CAST(0 AS BIGINT) FROM s GROUP BY ALL UNION ALL SELECT * FROM (VALUES ('bad.json', 0, 1), ('none.json', 0, 0), ('placeless-6h-x_mean.json', 0, 1)) t(a, b, c)")
def _file_report(f: Frames) -> DataFrame:
    files, _, _ = loader_folders(f)
    grid_files(f, files, ("member", "mean"), (1,))
    broken_files(f, files)
    return S.file_report(f.spark, files)


@query("src09_upserted_runs", f"{_ORDER_RUNS} SELECT * FROM all_runs")
def _upserted(f: Frames) -> DataFrame:
    """Known pairs of model and start keep their id, new ones get the next, repeated ones come once."""
    return order_runs(f)


@query("snk03_json", f"{C.SQL}, r AS (SELECT model_name, forecast_hour, count(*) AS n FROM regridded_forecast GROUP BY ALL) SELECT '{{\"model_name\":\"' || model_name || '\",\"forecast_hour\":' || forecast_hour || ',\"n_cells\":' || n || '}}' AS json FROM r")
def _json(f: Frames) -> DataFrame:
    return S.to_json(C.regridded_forecast(f.spark, f.stats).groupBy("model_name", "forecast_hour").agg(F.count("*").alias("n_cells")))


@query("rg01_regrid", f"{C.SQL} SELECT obs_time, CAST(round_even(latitude, 0) AS INTEGER) / 1 AS latitude, CAST(round_even(longitude, 0) AS INTEGER) / 1 AS longitude, round_even(avg(p), 6) AS value FROM obs_mean GROUP BY ALL")
def _regrid(f: Frames) -> DataFrame:
    return G.regrid(f.observations(), ["obs_time"], per_degree=1).withColumn("value", F.bround("value", 6))


@query("ext_neighbourhood_fss", f"""{_pairs_sql()}, k AS (SELECT model_name, forecast_hour, CAST(round_even(latitude * 2, 0) AS INTEGER) AS cy, CAST(round_even(longitude * 2, 0) AS INTEGER) AS cx, CASE WHEN m > {_T} THEN 1e0 ELSE 0e0 END AS f, CASE WHEN o > {_T} THEN 1e0 ELSE 0e0 END AS ob FROM pairs),
sh AS (SELECT w.model_name, w.forecast_hour, w.cy, w.cx, avg(k.f) AS f, avg(k.ob) AS ob FROM (SELECT DISTINCT model_name, forecast_hour, cy, cx FROM k) w JOIN k ON k.model_name = w.model_name AND k.forecast_hour = w.forecast_hour AND abs(k.cy - w.cy) <= 1 AND abs(k.cx - w.cx) <= 1 GROUP BY ALL)
SELECT model_name, forecast_hour, CASE WHEN avg(f*f + ob*ob) <= 1e-10 THEN 1 ELSE round_even(1 - avg((f-ob)*(f-ob)) / avg(f*f + ob*ob), 4) END AS fss FROM sh GROUP BY ALL""")
def _neighbourhood(f: Frames) -> DataFrame:
    return G.neighbourhood_skill(f.pairs(), LIMIT, 1)


@query("ext_wind_speed_mode", f"{_pairs_sql(3, 'w', '1')}, {_WIND}, sp AS (SELECT l.model_name, w.forecast_hour, w.latitude, w.longitude, sqrt(w.u*w.u + w.v*w.v) AS speed FROM wind w JOIN latest l USING (run_id)) SELECT p.model_name, p.latitude, p.longitude, round_even(avg(sp.speed - p.o), 4) AS bias FROM pairs p JOIN sp USING (model_name, forecast_hour, latitude, longitude) GROUP BY ALL")
def _speed_mode(f: Frames) -> DataFrame:
    """Bias of wind speed, not of its eastward component, against observed speed (an extension)."""
    speed = wind_field(f).join(f.latest, "run_id").select("model_name", "forecast_hour", "latitude", "longitude", E.wind_speed(F.col("u"), F.col("v")).alias("speed"))
    return f.pairs(3, "wind", divide=False).join(speed, ["model_name", "forecast_hour", "latitude", "longitude"]).groupBy("model_name", "latitude", "longitude").agg(F.bround(F.avg(F.col("speed") - F.col("obs_rate")), 4).alias("bias"))
