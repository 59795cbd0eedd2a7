"""Every registered query against its SQL twin, and the parts that SQL cannot check."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracle import connect, differences
from veriskill.functions import exprs as E
from veriskill.operators import analysis as A
from veriskill.operators import grid as G
from veriskill.operators import match as J
from veriskill.operators import metrics as M
from veriskill.operators import places as P
from veriskill.operators import sums as SM
from veriskill.plans import entries as V
from veriskill.sources import gridfiles as S
from veriskill.sources import merge as MG
from veriskill.streaming import observations as O
from veriskill.streaming import windows as W

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(V.QUERIES))
def test_query(spark, con, name):
    if name in V.ORACLES:
        assert differences(spark, con, V.QUERIES[name], V.ORACLES[name], SF) is None
    else:
        assert V.QUERIES[name](spark, SF).count() > 0


def pairs(spark, rows):
    return spark.createDataFrame([("AIFS", 6 * k, 25.0, -85.0, *map(float, r)) for k, r in enumerate(rows)], "model_name string, forecast_hour int, latitude double, longitude double, mean_rate double, std_rate double, obs_rate double")


def test_normal_law(spark):
    xs = [k / 50 for k in range(-400, 401)] + [-40.0, 40.0, 7.08, -7.08]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", F.expr(E.normal_cdf_sql("x")).alias("c"), F.expr(E.normal_pdf_sql("x")).alias("d")).collect()
    assert max(abs(r.c - 0.5 * math.erfc(-r.x / math.sqrt(2))) for r in got) < 5e-15
    assert max(abs(r.d - math.exp(-r.x * r.x / 2) / math.sqrt(2 * math.pi)) for r in got) < 1e-15


def test_exact_rounding(spark):
    """Ties, near ties and all kinds of doubles as Python rounds them."""
    rng = random.Random(7)
    xs = [0.0, -0.0, 2.675, 8.345, 1.005, 0.5, 1.5, 2.5, -2.5, 1e15 + 0.3, 1e300, -1e-300, 123456789.125, 0.125, 0.375, 5e-5, 0.00015, 4503599627370497.5]
    xs += [rng.randrange(10**6) / 10**5 + 5e-5 for _ in range(20_000)] + [rng.randrange(-(2**30), 2**30) / 2 ** rng.randrange(1, 20) for _ in range(20_000)]
    xs += [rng.uniform(-1e4, 1e4) for _ in range(20_000)] + [math.ldexp(rng.random(), rng.randrange(-60, 60)) for _ in range(20_000)]
    xs += [math.nextafter(rng.randrange(10**6) / 10**5 + 5e-5, s) for s in (-math.inf, math.inf) for _ in range(10_000)]
    places = (0, 2, 4, 6)
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *(E.exact_round(F.col("x"), n).alias(f"r{n}") for n in places)).collect()
    assert len(rows) > 100_000 - 1000
    for r in rows:
        for n in places:
            assert r[f"r{n}"] == round(r.x, n), (r.x, n)
    none = spark.sql("SELECT CAST(NULL AS DOUBLE) AS x, double('NaN') AS y").select(E.exact_round(F.col("x"), 2).alias("x"), E.exact_round(F.col("y"), 2).alias("y")).first()
    assert none.x is None and math.isnan(none.y)


def test_metric_edges(spark):
    """Equality with the threshold is no event; zero spread is a step; guards drop what has no denominator."""
    limit = 4.0
    r = M.score(pairs(spark, [(4, 1, 4), (5, 0, 5), (3, 0, 5), (5, 1, 3)]), list(M.METRICS), limit).first()
    assert (r.csi, r.pod, r.far) == (round(1 / 3, 4), 0.5, 0.5) and r.bias == 0.0 and r.mae == 1.0 and r.rmse == round(math.sqrt(2), 4)
    one = M.score(pairs(spark, [(1, 1, 1)]), list(M.METRICS), limit).first()
    assert (one.csi, one.pod, one.far, one.ssr_agg) == (None, None, None, None) and one.bias == 0.0
    flat = M.score(pairs(spark, [(2, 1, 2), (3, 1, 3)]), ["ssr_agg"], limit).first()
    assert flat.ssr_agg is None
    none = A.region_hours(pairs(spark, [(1, 1, 1)]), limit).first()
    assert none.fss == 1.0 and none.csi is None
    missing = A.point_summary(pairs(spark, [(5, 1, 5)]), limit, spark.createDataFrame([("AIFS",), ("GEFS",)], "model_name string")).orderBy("model_name").collect()
    assert [(r.model_name, r.hits, r.csi) for r in missing] == [("AIFS", 1, 1.0), ("GEFS", None, None)]
    half = M.score(pairs(spark, [(1.00005, 1, 0), (1.00005, 1, 0)]), ["bias", "mae"], limit).first()
    assert half.bias == half.mae == round(1.00005, 4) == 1.0001  # the double is just over the half that its text shows
    even = M.score(pairs(spark, [(0.03125, 1, 0), (0.03125, 1, 0)]), ["bias", "mae"], limit).first()
    assert even.bias == even.mae == round(0.03125, 4) == 0.0312  # a true half goes to the even digit
    assert set(M.SPATIAL) == set(M.METRICS) | {"ssr", "correlation"} and set(A.EDGES) == set(M.SPATIAL) - {"correlation"}
    assert A.compare_summary(A.compare_hours(pairs(spark, [(1, 1, 2), (2, 1, 3)]).withColumns({"mean_value": F.lit(1.0), "std_dev": F.lit(1.0), "n_obs": F.lit(1)}))).first().correlation is None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 12), st.floats(0, 5), st.floats(0, 12)), min_size=2, max_size=12))
def test_metric_laws(spark, rows):
    r = M.score(pairs(spark, rows), list(M.METRICS), 4.0).first()
    for name in ("csi", "pod", "far", "brier"):
        assert r[name] is None or 0 <= r[name] <= 1
    assert r.rmse + 1e-4 >= r.mae and r.mae + 1e-4 >= abs(r.bias) and r.crps >= 0
    assert r.csi is None or r.pod is None or r.csi <= r.pod


def test_window_join(spark):
    """Half-open window, partial windows, none at all; the mean is taken over hours that were averaged before."""
    fc = spark.sql("SELECT 'GEFS' AS model_name, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS initialization_time, h AS forecast_hour, 25.0D AS latitude, -85.0D AS longitude, 6.0D AS mean_value, 3.0D AS std_dev FROM VALUES (6), (12), (60) AS t(h)")
    obs = spark.sql("SELECT timestampadd(HOUR, h, TIMESTAMP_NTZ '2024-01-01 00:00:00') AS obs_time, 25.0D AS latitude, -85.0D AS longitude, v AS value FROM VALUES (3, 100.0D), (4, 1.0D), (6, 2.0D), (6, 4.0D), (12, 7.0D) AS t(h, v)")
    got = {r.forecast_hour: (r.mean_rate, r.obs_rate, r.n_obs) for r in J.window_pairs(fc, obs, E.accum_hours(F.col("model_name"))).collect()}
    assert got == {6: (2.0, 2.0, 2), 12: (2.0, 7.0, 1)}
    twice = J.window_pairs(fc.unionByName(fc), obs, E.accum_hours(F.col("model_name"))).where("forecast_hour = 6").collect()
    assert [(r.obs_rate, r.n_obs) for r in twice] == [(2.0, 2)] * 2  # repeated forecast rows stay rows of their own
    plan = J.window_pairs(fc, obs, E.accum_hours(F.col("model_name")))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def scans(spark, name):
    plan = V.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    return [sum(f"{t}.parquet" in line and "Scan parquet" in line for line in plan.split("\n")) for t in ("lineitem", "events")]


def test_pairs_read_each_side_once(spark):
    assert scans(spark, "met00_all_spatial_metrics") == [1, 1] and scans(spark, "jn07_window_pairs") == [1, 1]
    assert scans(spark, "met00_registry") == [2, 2]


def test_metrics_at_once_are_metrics_by_name(spark):
    f = V.Frames(spark, SF)
    given = M.Inputs(f.pairs(), V.snapped(f), V.LIMIT, 6)
    got = {}
    for r in M.spatial_all(given).collect():
        got.setdefault(r.metric, []).append((r.model_name, r.latitude, r.longitude, r.value))
    assert set(got) == set(M.SPATIAL)
    for name in ("ssr", "correlation", "bias", "brier"):
        assert sorted(got[name]) == sorted(tuple(r) for r in M.SPATIAL[name](given).collect())
    assert {r.metric for r in M.spatial_all(given, ["ssr", "mae"]).collect()} == {"ssr", "mae"}


def test_plans_stay_in_the_jvm(spark):
    for name in V.QUERIES:
        if not name.startswith(("grd07", "grd08", "grd09_arc", "jn07_arriving")):
            plan = V.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert "Python" not in plan and "Pandas" not in plan, name
    scan = V.QUERIES["agg07_disagreement"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in scan and "l_shipdate" not in scan


def test_idw_is_within_its_neighbours(spark):
    rng = random.Random(2)
    rows = [(25 + rng.random() * 2, -85 + rng.random() * 2, rng.random() * 9) for _ in range(40)]
    got = G.idw(spark.createDataFrame(rows, "latitude double, longitude double, value double"), radius=0.5, step=0.2, unit=0.02).collect()
    for r in got:
        near = [(v, (y - r.ty) ** 2 + (x - r.tx) ** 2) for y, x, v in rows if (y - r.ty) ** 2 + (x - r.tx) ** 2 < 0.25]
        w = [(v, 1 if d / 0.0004 < 1 else 1 / (d / 0.0004) ** 2) for v, d in near]
        assert abs(r.value - sum(v * k for v, k in w) / sum(k for _, k in w)) < 1e-9


def test_polygon_of_a_box_is_the_box(spark):
    df = spark.range(400).select((F.col("id") % 20 * 0.1 + 0.05).alias("y"), (F.floor(F.col("id") / 20) * 0.1 + 0.05).alias("x"))
    inside = J.in_polygon(F.col("y"), F.col("x"), [(0.5, 0.5), (0.5, 1.5), (1.5, 1.5), (1.5, 0.5)])
    assert df.where(inside != J.in_box(F.col("y"), F.col("x"), 0.5, 1.5, 0.5, 1.5)).count() == 0


def star(rng, y, x, r, corners):
    """Corners around a place, near and far in turn; some on whole cells."""
    out = []
    for k in range(corners):
        far = r * rng.uniform(0.3, 1)
        out.append((y + far * math.sin(2 * math.pi * k / corners), x + far * math.cos(2 * math.pi * k / corners)))
    return [(round(a * 4) / 4, round(b * 4) / 4) for a, b in out] if rng.random() < 0.2 else out


def test_many_polygons(spark):
    """10,000 polygons of all sizes and shapes, against the even-odd rule over all of their edges."""
    rng = random.Random(11)
    shapes = [star(rng, rng.uniform(20, 45), rng.uniform(-100, -60), rng.choice([0.05, 0.3, 1.0, 4.0 if k % 50 == 0 else 0.5]), rng.randrange(3, 9)) for k in range(9_990)]
    shapes += [[], [(30.0, -80.0)], [(30.0, -80.0), (31.0, -80.0)], [(30.0, -80.0), (30.0, -79.0), (31.0, -79.0), (31.0, -80.0)], [(30.1, -80.1), (30.1, -70.1), (30.2, -70.1), (30.2, -80.1)], [(30.0, -80.0)] * 4, [(30.0, -80.0), (31.0, -79.0), (31.0, -80.0), (30.0, -79.0)], [(-1.0, -1.0), (-1.0, 1.0), (1.0, 1.0), (1.0, -1.0)], [(20.0, -100.0), (20.0, -60.0), (45.0, -60.0), (45.0, -100.0)], [(30.125, -80.125), (30.125, -79.875), (30.13, -79.875)]]
    places = [(rng.uniform(20, 45), rng.uniform(-100, -60)) for _ in range(700)] + [(rng.randrange(80, 180) / 4, rng.randrange(-400, -240) / 4) for _ in range(200)] + [(30.0, -80.0), (30.5, -79.5), (30.15, -75.0), (0.0, 0.0)]
    at = np.array(places)
    want = set()
    for k, vertices in enumerate(shapes):
        inside = np.zeros(len(at), bool)
        for (yi, xi), (yj, xj) in zip(vertices, [vertices[-1], *vertices[:-1]] if vertices else []):
            if yi != yj:
                inside ^= ((yi > at[:, 0]) != (yj > at[:, 0])) & (at[:, 1] < (xj - xi) * (at[:, 0] - yi) / (yj - yi) + xi)
        want.update((int(i), k) for i in np.flatnonzero(inside))
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)] + [(-1, None, 3.0)], "spot int, latitude double, longitude double")
    polygons = spark.createDataFrame([(k, [tuple(map(float, v)) for v in s]) for k, s in enumerate(shapes)], "polygon_id int, vertices array<struct<lat:double,lon:double>>")
    got = P.in_polygons(points, polygons, 0.5)
    rows = [(r.spot, r.polygon_id) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 4000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert P.in_polygons(points, polygons.limit(0)).count() == 0


def shuffled_rows(node):
    """Rows that the exchanges of an executed plan wrote, each exchange once."""
    kind, seen = node.getClass().getSimpleName(), []
    if kind == "AdaptiveSparkPlanExec":
        return shuffled_rows(node.executedPlan())
    if kind == "ShuffleQueryStageExec":
        seen = [int(node.getRuntimeStatistics().rowCount().get())]
    if kind.endswith("QueryStageExec"):
        return seen + shuffled_rows(node.plan())
    children = node.children()
    return seen + [n for k in range(children.size()) for n in shuffled_rows(children.apply(k))]


def test_pairs_of_points_and_polygons_are_not_shuffled(spark):
    """400 points in one cell, on the edge of 300 polygons: exchanges hold points and cells, not 120,000 pairs."""
    points = spark.range(400).select(F.col("id").alias("spot"), (F.lit(30.1) + F.col("id") / 10_000).alias("latitude"), F.lit(-80.1).alias("longitude"))
    square = lambda r: F.array(*(F.struct((F.lit(30.05) + a * r).alias("lat"), (F.lit(-80.15) + b * r).alias("lon")) for a, b in ((0, 0), (0, 1), (1, 1), (1, 0))))
    polygons = spark.range(300).select(F.col("id").alias("polygon_id"), square(F.lit(0.2) + F.col("id") / 1000).alias("vertices"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = P.in_polygons(points, polygons, 0.5)
        assert len(got.collect()) == 120_000
        rows = shuffled_rows(got._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert rows and max(rows) < 10_000


def broadcast_rows(node):
    """Rows that an executed plan sent through the driver to all executors."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return broadcast_rows(node.executedPlan())
    if kind == "BroadcastQueryStageExec":
        return [int(node.getRuntimeStatistics().rowCount().get())]
    if kind.endswith("QueryStageExec"):
        return broadcast_rows(node.plan())
    children = node.children()
    return [n for k in range(children.size()) for n in broadcast_rows(children.apply(k))]


def test_covers_of_polygons_are_not_broadcast(spark):
    """Ten stars, few bytes as a table, cover some 30,000 cells, which never pass the driver; some rows hold more than FEW_EDGES edges."""
    points = spark.range(2_000).select(F.col("id").alias("spot"), (F.lit(20.0) + F.col("id") % 50 / 2.1).alias("latitude"), (F.lit(-100.0) + F.col("id") / 50.3).alias("longitude"))
    rng = random.Random(5)
    shapes = [star(rng, 32 + k / 7, -80 - k / 3, 12.0, 5 if k % 2 else 16) for k in range(10)]
    polygons = spark.createDataFrame([(k, [tuple(map(float, v)) for v in s]) for k, s in enumerate(shapes)], "polygon_id int, vertices array<struct<lat:double,lon:double>>")
    got = P.in_polygons(points, polygons)
    rows = got.collect()
    sent = broadcast_rows(got._jdf.queryExecution().executedPlan())
    assert max(sent, default=0) <= 2_000
    want = set()
    at = [(r.spot, r.latitude, r.longitude) for r in points.collect()]
    for k, vertices in enumerate(shapes):
        for spot, y, x in at:
            odd = False
            for (yi, xi), (yj, xj) in zip(vertices, [vertices[-1], *vertices[:-1]]):
                odd ^= (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi
            want |= {(spot, k)} if odd else set()
    assert len(rows) == len(want) > 1_000 and {(r.spot, r.polygon_id) for r in rows} == want


def test_boxes_read_ranges(spark, tmp_path):
    """A keyed table gives a box's rows from a share of its row groups that falls with the box."""
    folder = str(tmp_path / "keyed")
    rows = spark.range(120_000).select((F.rand(1) * 40 + 10).alias("latitude"), (F.rand(2) * 60 - 120).alias("longitude"), "id")
    P.with_key(rows).write.option("parquet.block.size", 65536).parquet(folder)
    table = spark.read.parquet(folder)

    def read(box):
        df = P.in_box(table, *box)
        n = len(df.collect())
        assert n == table.where(F.col("latitude").between(*box[:2]) & F.col("longitude").between(*box[2:])).count()
        return n, df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()

    whole, half, small = read((0.0, 90.0, -180.0, 0.0)), read((10.0, 30.0, -120.0, -60.0)), read((30.0, 32.0, -90.0, -87.0))
    assert whole == (120_000, 120_000) and half[1] < 90_000 and small[0] > 100 and small[1] < 12_000
    for box in ((10.0, 10.0, -120.0, -120.0), (44.9, 45.0, -179.9, 179.9), (-90.0, 90.0, -180.0, 180.0)):
        ranges = P.z_ranges(*box)
        assert len(ranges) <= 48 and all(a <= b < c for (a, b), (c, _) in zip(ranges, ranges[1:]))


def test_box_sums(spark):
    """100 boxes over two fields with holes, each against a plain sum; boxes that stick out, or lie outside."""
    rng = random.Random(5)
    cells = [(k, rng.randrange(-6, 9), rng.randrange(-4, 12), rng.randrange(1, 50)) for k in (1, 2) for _ in range(90)]
    boxes = [(b, *sorted((rng.randrange(-9, 12), rng.randrange(-9, 12))), *sorted((rng.randrange(-9, 15), rng.randrange(-9, 15)))) for b in range(98)] + [(98, 30, 40, 30, 40), (99, -99, 99, -99, 99)]
    df = spark.createDataFrame(cells, "field int, cy bigint, cx bigint, n bigint")
    asked = spark.createDataFrame([(k, *b) for k in (1, 2) for b in boxes], "field int, box int, y0 bigint, y1 bigint, x0 bigint, x1 bigint")
    got = {(r.field, r.box): r.n for r in SM.box_sums(SM.area_table(df, ("field",), ("n",)), asked, ("field",), ("n",), ("field", "box")).collect()}
    want = {(k, b): sum(n for f, y, x, n in cells if f == k and y0 <= y <= y1 and x0 <= x <= x1) for k in (1, 2) for b, y0, y1, x0, x1 in boxes}
    assert {k: n for k, n in got.items() if n} == {k: n for k, n in want.items() if n} and (1, 98) not in got


def test_exact_percentiles(spark):
    """Groups of all rows, of ties, of wide ranges, small ones, one without values; numpy's law between the nearest."""
    rng = np.random.default_rng(3)
    groups = {"wide": np.exp(rng.normal(0, 9, 30_000)), "ties": rng.integers(0, 5, 20_000).astype(float), "even": rng.random(9_000), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "flat": np.full(6_000, 7.5), None: rng.normal(size=5_001)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("none", None), ("even", None), ("even", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = (0.0, 0.1, 0.25, 0.5, 0.999, 1.0)
    got = {r.g: (r.n, r.p) for r in SM.exact_percentiles(df, ("g",), "x", shares).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g][0] == len(xs) and np.allclose(got[g][1], np.quantile(xs, shares), rtol=1e-12, atol=0)
    every = SM.exact_percentiles(df, (), "x", (0.5,)).first()
    assert every.n == sum(map(len, groups.values())) and every.p[0] == np.quantile(np.concatenate(list(groups.values())), 0.5)


def test_streamline_follows_a_steady_wind():
    line = G.trace(np.full((20, 40), 3.0), np.zeros((20, 40)), 40.0, 16.0, 8.0)
    assert line[0] == (40.0, 16.0) and all(y == 40.0 for y, _ in line) and line[-1][1] > 300
    assert G.along(line)[1] == (40.0, 56.0) and G.along([(0, 0), (0, 3)]) == []
    assert len(G.trace(np.full((5, 5), 0.1), np.zeros((5, 5)), 8.0, 8.0, 8.0)) == 1


def test_streamlines_by_tiles(spark):
    """Lines of tiles are those traced over the whole grid at once, over a wind that turns and dies in places."""
    wind = spark.range(60 * 90).select((25 + F.expr("id div 90") * 0.25).alias("latitude"), (-85 + (F.col("id") % 90) * 0.25).alias("longitude"), (F.sin(F.col("id") * 0.01) * 3).alias("u"), F.cos(F.col("id") * 0.003).alias("v"))
    rows = wind.collect()
    u, v = (np.array([r[c] for r in rows]).reshape(60, 90) for c in "uv")
    want = {}
    for y in np.arange(14.0, 59 * 8.0, 28.0):
        for x in np.arange(14.0, 89 * 8.0, 28.0):
            line = G.trace(u, v, y, x, 8.0)
            if len(line) >= 3:
                want[y, x] = (len(line), [tuple(p) for p in G.along(line)])
    for tile in (8, 64):
        got = {(r.seed_y, r.seed_x): (r.n_points, [(d.y, d.x) for d in r.dots]) for r in G.streamlines(wind, tile=tile).collect()}
        assert got == want and len(want) > 100
    assert G.streamlines(wind.limit(0)).count() == 0 and G.resample(wind.limit(0)).count() == 0


def nearest(sites, ty, tx):
    return min(((y - ty) ** 2 + (x - tx) ** 2, y, x, u, v) for y, x, u, v in sites)[3:]


def test_resample_is_the_nearest_however_far(spark):
    """Scattered vectors, repeated ones, a void of half the grid, fields of one vector, of one line and of ties."""
    rng = random.Random(8)
    fields = {1: [(rng.random() * 4, rng.random() * 6, rng.random(), rng.random()) for _ in range(60)], 2: [(25 + i * 0.5, -85 + j * 0.5, i, j) for i in range(13) for j in range(13) if i in (0, 12) or j < 3], 3: [(5.0, 5.0, 1.0, 2.0)], 4: [(1.0, float(j), j, -j) for j in range(5)], 5: [(float(i), float(j), i, j) for i in range(4) for j in range(4)] * 2}
    df = spark.createDataFrame([(k, *map(float, r)) for k, rows in fields.items() for r in rows], "field int, latitude double, longitude double, u double, v double")
    got = G.resample(df, 0.25, ("field",)).collect()
    assert len({(r.field, r.row, r.column) for r in got}) == len(got) == sum((int((max(y for y, *_ in f) - min(y for y, *_ in f)) / 0.25 + 1e-9) + 1) * (int((max(x for _, x, *_ in f) - min(x for _, x, *_ in f)) / 0.25 + 1e-9) + 1) for f in fields.values())
    for r in got:
        assert (r.u, r.v) == nearest(fields[r.field], r.ty, r.tx)
    one = G.resample(df.where("field = 2").drop("field"), 0.25).collect()
    assert {(r.ty, r.tx): (r.u, r.v) for r in one} == {(r.ty, r.tx): (r.u, r.v) for r in got if r.field == 2}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 60)), min_size=1, max_size=12, unique_by=lambda t: t[0]))
def test_lower_envelope(sites):
    y, g = np.array(sorted(sites), float).T
    at = np.arange(0, 31, 0.5)
    got = G.lower_envelope(y, g, at)
    for x, k in zip(at, got):
        assert (x - y[k]) ** 2 + g[k] == min((x - y) ** 2 + g)


def test_fields_apart_are_fields_at_once(spark):
    """What is asked of all fields in one job is what each gives alone."""
    rng = random.Random(6)
    rows = [(k, 25 + rng.randrange(9) / 4, -85 + rng.randrange(9) / 4, rng.random() * 9 - 4, rng.random() * 9 - 4) for k in (1, 2) for _ in range(30)]
    df = spark.createDataFrame(rows, "field int, latitude double, longitude double, u double, v double").withColumn("value", F.col("u") + 4)
    one = df.groupBy("field", "latitude", "longitude").agg(F.min(F.struct("u", "v", "value")).alias("p")).select("field", "latitude", "longitude", "p.*")
    for op in (lambda d, **k: G.idw(d.drop("u", "v"), **k), lambda d, **k: G.dense(d, 4, **k), lambda d, **k: G.decimate(d, **k), lambda d, **k: G.grid_step(d, **k), lambda d, **k: G.arrows(d, **k), lambda d, **k: G.streamlines(d, **k)):
        both = op(one, by=("field",))
        for field in (1, 2):
            rest = [c for c in both.columns if c != "field"]
            apart = op(one.where(F.col("field") == field).drop("field")).select(*rest)
            tidy = lambda df: sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.collect())
            assert tidy(both.where(F.col("field") == field).select(*rest)) == tidy(apart)


def test_line_dots(spark):
    """Dots of all lines at once are those of each line alone."""
    rng = random.Random(12)
    lines = {k: [(rng.uniform(0, 90), rng.uniform(0, 90)) for _ in range(rng.randrange(1, 9))] for k in range(30)} | {30: [(0.0, 0.0), (0.0, 3.0)], 31: [(0.0, 0.0), (0.0, 80.0)], 32: [(1.0, 1.0), (1.0, 1.0), (1.0, 50.0)]}
    df = spark.createDataFrame([(k, j, *p) for k, line in lines.items() for j, p in enumerate(line)], "line int, k int, y double, x double")
    got = {}
    for r in sorted(G.line_dots(df, ("line",)).collect()):
        got.setdefault(r.line, []).append((r.y, r.x))
    for k, line in lines.items():
        assert np.allclose(got.get(k, []), G.along(line) if len(line) > 1 else [])


def test_names_and_levels(spark):
    names = {"aifs-006h-p_member_3.json": (6, 3, "member"), "gefs-12h-x_mean.json": (12, None, "mean"), "u_std.json": (0, None, "std"), "ukmo-24h-run.json": (24, None, "deterministic"), "plain_member_12.json": (0, 12, "member"), "a-7h-b_std.json": (7, None, "std")}
    rows = spark.createDataFrame([(n,) for n in names], "file string").withColumns(S.name_parts(F.col("file"))).collect()
    assert {r.file: (r.forecast_hour, r.ensemble_member, r.kind) for r in rows} == names
    assert [E.vsup_levels(n) for n in (1, 2, 5, 16)] == [[8, 4, 2, 1], [2, 1], [5, 2, 1], [16, 8, 4, 2, 1]]
    assert J.alias("wind")[1:] == ("wind_speed", "ERA5_WIND") and J.alias("pressure_msl") == ("pressure_msl", "precipitation", "GPM_IMERG_V07B")
    words = ["a_1", "", "a b", "x\n", "a" * 40, "a" * 41]
    assert [r.ok for r in spark.createDataFrame([(w,) for w in words], "w string").select(E.is_token(F.col("w")).alias("ok")).collect()] == [True, False, False, False, True, False]


def test_tokens():
    assert E.checked_token("wind_u_10m")
    for bad in ("", "a b", "x;--", "a" * 41):
        with pytest.raises(ValueError):
            E.checked_token(bad)


def test_grid_files(spark, tmp_path):
    """Members, mean, deviation, an empty file, a file without hour, a deviation without mean, a broken file."""
    folder = tmp_path / "in"
    folder.mkdir()
    point = '[{"lat": 25.0, "lon": -85.0, "value": %s}, {"lat": 25.5, "lon": -85.0, "value": null}]'
    for name, text in {"a-6h-x_member_0.json": point % 1, "a-6h-x_member_1.json": point % 3, "a-6h-x_mean.json": point % 2, "a-6h-x_std.json": point % 1.5, "a-12h-x_std.json": point % 9, "run.json": point % 7, "none.json": "[]", "bad.json": "{oops"}.items():
        (folder / name).write_text(text)
    counts = S.load_folders(spark, {str(folder): 1}, 5, str(tmp_path / "data"), str(tmp_path / "stats"))
    assert counts == {"forecast_data": 6, "ensemble_statistics": 2}
    data = MG.read(spark, str(tmp_path / "data"))
    assert sorted((r.forecast_hour, r.ensemble_member, r.value) for r in data.where("value IS NOT NULL").collect() if r.ensemble_member is not None) == [(6, 0, 1.0), (6, 1, 3.0)]
    assert [(r.forecast_hour, r.value) for r in data.where("ensemble_member IS NULL AND value IS NOT NULL").collect()] == [(0, 7.0)]
    first = MG.read(spark, str(tmp_path / "stats")).where("mean_value IS NOT NULL").first()
    assert (first.mean_value, first.std_dev) == (2.0, 1.5)


def fields(spark, rows):
    """Points of run 1 and variable 1: (hour, latitude, kind, value)."""
    return spark.createDataFrame([(1, 1, h, None, y, -85.0, v, k) for h, y, k, v in rows], "run_id int, variable_id int, forecast_hour int, ensemble_member int, latitude double, longitude double, value double, kind string")


def test_merged_loads(spark, tmp_path):
    """Late deviations, repeated loads, new means, deviations without a mean, and a commit that comes second."""
    data, stats = str(tmp_path / "data"), str(tmp_path / "stats")
    now = lambda v=None: sorted((r.forecast_hour, r.latitude, r.mean_value, r.std_dev) for r in MG.read(spark, stats, v).collect())
    assert MG.read(spark, stats) is None
    S.load(fields(spark, [(6, 25.0, "std", 9.0)]), data, stats)
    assert now() == []  # lost: no mean has come
    S.load(fields(spark, [(6, 25.0, "mean", 1.0), (6, 25.5, "mean", 2.0), (12, 25.0, "mean", 3.0)]), data, stats)
    assert now() == [(6, 25.0, 1.0, None), (6, 25.5, 2.0, None), (12, 25.0, 3.0, None)]
    late = [(6, 25.0, "std", 0.5), (6, 26.0, "std", 7.0)]
    for _ in range(2):
        S.load(fields(spark, late), data, stats)
        assert now() == [(6, 25.0, 1.0, 0.5), (6, 25.5, 2.0, None), (12, 25.0, 3.0, None)]
    S.load(fields(spark, [(6, 25.0, "mean", 4.0), (6, 25.0, "mean", 3.5)]), data, stats)
    want = [(6, 25.0, 4.0, 0.5), (6, 25.5, 2.0, None), (12, 25.0, 3.0, None)]
    assert now() == want and now(2)[0] == (6, 25.0, 1.0, None)
    newest = MG.versions(spark, stats)[-1]
    S.load(fields(spark, []), data, stats)
    assert MG.versions(spark, stats)[-1] == newest
    live = spark.read.parquet(f"{stats}/manifest/{newest:010d}").collect()
    assert {(r.forecast_hour, r.version) for r in live} == {(6, newest), (12, 2)}  # hour 12 was not written again
    with pytest.raises(RuntimeError):
        MG._commit(spark.read.parquet(f"{stats}/manifest/{newest:010d}"), stats, newest)
    assert MG.vacuum(spark, stats) == newest - 2 and now() == want and MG.versions(spark, stats) == [newest]
    members = spark.createDataFrame([(1, 1, 6, m, 25.0, -85.0, v, "member" if m is not None else "deterministic") for m, v in ((0, 1.0), (None, 2.0), (0, 5.0), (None, 2.0))], "run_id int, variable_id int, forecast_hour int, ensemble_member int, latitude double, longitude double, value double, kind string")
    for _ in range(2):
        S.load(members, data, stats)
    assert sorted((r.ensemble_member is None, r.value) for r in MG.read(spark, data).collect()) == [(False, 5.0), (True, 2.0)]


def test_upsert(spark):
    old = spark.sql("SELECT 1 AS run_id, 1 AS model_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS initialization_time")
    new = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2024-01-01 00:00:00'), (2, TIMESTAMP_NTZ '2024-01-01 00:00:00'), (2, TIMESTAMP_NTZ '2024-01-01 00:00:00') AS t(model_id, initialization_time)")
    assert sorted((r.run_id, r.model_id) for r in S.upsert_runs(old, new).collect()) == [(1, 1), (2, 2)]


def test_stream(spark, tmp_path):
    """Hours are written when the watermark has passed them; later rows do not change them."""
    folder, table, check = (str(tmp_path / n) for n in ("in", "out", "state"))
    put = lambda rows: spark.createDataFrame(rows, "t string, latitude double, longitude double, value double").select(F.to_timestamp("t").alias("obs_time"), "latitude", "longitude", "value").coalesce(1).write.mode("append").parquet(folder)
    put([("2024-01-01 00:10:00", 25.0, -85.0, 1.0), ("2024-01-01 00:50:00", 25.0, -85.0, 3.0)])
    O.keep_hourly(spark, folder, table, check).awaitTermination()
    put([("2024-01-01 12:00:00", 25.0, -85.0, 9.0)])
    O.keep_hourly(spark, folder, table, check).awaitTermination()
    put([("2024-01-01 00:20:00", 25.0, -85.0, 100.0), ("2024-01-02 12:00:00", 25.0, -85.0, 5.0)])
    O.keep_hourly(spark, folder, table, check).awaitTermination()
    got = sorted((r.obs_time.hour, r.value, r.n) for r in spark.read.parquet(table).collect())
    assert got == [(0, 2.0, 2), (12, 9.0, 1)]


def test_windows_of_late_observations(spark, tmp_path):
    """In any order of arrival, the kept windows end up as those of all observations; each batch revises what it touches."""
    folder, table, check = (str(tmp_path / n) for n in ("in", "out", "state"))
    rng = random.Random(4)
    rows = [(f"2024-01-0{rng.randrange(1, 4)} {rng.randrange(24):02d}:{rng.randrange(60):02d}:00", 25.0 + rng.randrange(2) / 2, -85.0, float(rng.randrange(16))) for _ in range(90)]
    rows += [("2024-01-01 23:30:00", 25.0, -85.0, 1.0), ("2024-01-01 23:40:00", 25.0, -85.0, None), (None, 25.0, -85.0, 2.0)]
    frame = lambda some: spark.createDataFrame(some, "t string, latitude double, longitude double, value double").select(F.to_timestamp("t").alias("obs_time"), "latitude", "longitude", "value")
    for k in range(3):
        frame(rows[k::3]).coalesce(1).write.mode("append").parquet(folder)
        W.keep_windows(W.window_updates(O.observation_stream(spark, folder, 1)), table, check).awaitTermination()
        so_far = [r for j in range(k + 1) for r in rows[j::3]]
        hourly = frame(so_far).where("value IS NOT NULL AND obs_time IS NOT NULL").withColumns({"obs_time": F.date_trunc("hour", "obs_time"), "cy": E.cell(F.col("latitude"), 100), "cx": E.cell(F.col("longitude"), 100)})
        want = {(r.cy, r.cx, r.end, r.hours): (r.obs_rate, r.n_obs) for r in J.window_means(hourly, ["cy", "cx"]).collect()}
        got = {(r.cy, r.cx, r.end, r.hours): (r.obs_rate, r.n_obs) for r in MG.read(spark, table).collect()}
        assert set(got) == set(want) and all(got[w][1] == want[w][1] and abs(got[w][0] - want[w][0]) < 1e-9 for w in want)
    assert MG.vacuum(spark, table, ("day",)) > 0 and MG.read(spark, table).count() == len(want)


def test_observations_reach_the_state_as_sums(spark, tmp_path):
    """10,000 observations of four hours: the state takes a few sums, and goes through a batch once."""
    folder, table, check = (str(tmp_path / n) for n in ("in", "out", "state"))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 4 * 3600)
    spark.range(0, 10_000, 1, 2).select(at.alias("obs_time"), F.lit(25.0).alias("latitude"), F.lit(-85.0).alias("longitude"), (F.col("id") % 7).cast("double").alias("value")).write.parquet(folder)
    before, kept = W.merge.merge, []

    def watched(batch, *rest):
        kept.append(batch.storageLevel.useMemory)
        return before(batch, *rest)

    W.merge.merge = watched
    try:
        W.keep_windows(W.window_updates(O.observation_stream(spark, folder)), table, check).awaitTermination()
    finally:
        W.merge.merge = before
    assert kept and all(kept)
    got = {(r.end.hour, r.hours): (r.obs_rate, r.n_obs) for r in MG.read(spark, table).collect()}
    mean = [sum(k % 7 for k in range(h, 10_000, 4)) / 2500 for h in range(4)]
    assert abs(got[3, 3][0] - sum(mean[1:]) / 3) < 1e-9 and got[3, 3][1] == 3 and abs(got[0, 1][0] - mean[0]) < 1e-9
    sent = W._summed(spark.read.parquet(folder).select("obs_time", F.lit(1).alias("cy"), F.lit(1).alias("cx"), "value")).collect()
    assert sum(r.n for r in sent) == 10_000 and len(sent) <= 4 * 2 * spark.sparkContext.defaultParallelism


def test_rest_stands_without_the_corpus_part(tmp_path):
    """With the corpus folders taken away, the entry module imports and has the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[1]
    shutil.copytree(root / "veriskill", tmp_path / "veriskill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op')] and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
