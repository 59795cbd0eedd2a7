"""Gridding: interpolation by bucketed equi-joins, dense grids, decimation, nearest neighbours, streamlines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriskill.functions import exprs as E
from veriskill.operators import sums as S


def near(targets: DataFrame, points: DataFrame, radius: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Targets (ty, tx) with the points (latitude, longitude, ...) of the same field closer than `radius`, and d2.

    A field is what shares the columns `by`. Both sides are cut into squares of the radius; a point is copied to the
    nine squares around its own, so that an equi-join by field and square finds all neighbours of all fields, and every
    square's load is bounded by its points, not by the grid.
    """
    square = lambda c: F.floor(F.col(c) / radius).cast("long")
    around = F.sequence(F.lit(-1), F.lit(1))
    copied = points.withColumn("__y", F.explode(F.transform(around, lambda k: square("latitude") + k))).withColumn("__x", F.explode(F.transform(around, lambda k: square("longitude") + k)))
    both = targets.withColumns({"__y": square("ty"), "__x": square("tx")}).join(copied, [*by, "__y", "__x"])
    d2 = (F.col("latitude") - F.col("ty")) * (F.col("latitude") - F.col("ty")) + (F.col("longitude") - F.col("tx")) * (F.col("longitude") - F.col("tx"))
    return both.withColumn("d2", d2).where(F.col("d2") < radius * radius).drop("__y", "__x")


def boxes(points: DataFrame, step: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, south, west, rows, columns): the regular grid inside each field's box. A row for each field."""
    corner = points.groupBy(*by).agg(F.min("latitude").alias("south"), F.max("latitude").alias("n"), F.min("longitude").alias("west"), F.max("longitude").alias("e")).where("south IS NOT NULL")
    count = lambda a, b: (F.floor((F.col(b) - F.col(a)) / step + 1e-9) + 1).alias
    return corner.select(*by, "south", "west", count("south", "n")("rows"), count("west", "e")("columns"))


def nodes_of(boxes: DataFrame, step: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, row, column, ty, tx) of every node of each field's grid; rows are dealt out before columns are made."""
    lines = boxes.withColumn("row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1))).repartition(*by, "row")
    at = lines.withColumn("column", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("columns") - 1)))
    return at.select(*by, "row", "column", (F.col("south") + F.col("row") * step).alias("ty"), (F.col("west") + F.col("column") * step).alias("tx"))


def target_grid(points: DataFrame, step: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Nodes (by, ty, tx) of a regular grid inside each field's box; all tasks make their share of them."""
    return nodes_of(boxes(points, step, by), step, by).select(*by, "ty", "tx")


def idw(points: DataFrame, radius: float = 0.75, step: float = 0.25, unit: float = 0.02, by: tuple[str, ...] = ()) -> DataFrame:
    """Inverse-distance interpolation of each field: weight 1/d^4 in units of `unit` (1 when closer than it), never under 0.

    Nodes without a neighbour have no row.
    """
    d2 = F.col("d2") / (unit * unit)
    weight = F.when(d2 < 1, 1.0).otherwise(F.try_divide(F.lit(1.0), d2 * d2))
    got = near(target_grid(points, step, by), points, radius, by).withColumn("w", weight)
    return got.groupBy(*by, "ty", "tx").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("v")).select(*by, "ty", "tx", F.greatest("v", F.lit(0.0)).alias("value"))


def dense(points: DataFrame, per_degree: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Every cell of each field's distinct latitudes by its distinct longitudes, null where there is no point; edges half a step away."""
    keyed = points.groupBy(*by, E.cell(F.col("latitude"), per_degree).alias("cy"), E.cell(F.col("longitude"), per_degree).alias("cx")).agg(F.max_by("value", F.struct("latitude", "longitude")).alias("value"))
    # Both are axes of a grid, at most 360 * per_degree values; their product is the result that is asked for.
    axes = keyed.groupBy(*by).agg(F.collect_set("cy").alias("ys"), F.collect_set("cx").alias("xs"))
    cells = axes.withColumn("cy", F.explode("ys")).repartition(*by, "cy").withColumn("cx", F.explode("xs")).select(*by, "cy", "cx")
    half = 0.5 / per_degree
    out = cells.join(keyed, [*by, "cy", "cx"], "left").select(*by, (F.col("cy") / per_degree).alias("latitude"), (F.col("cx") / per_degree).alias("longitude"), "value")
    return out.withColumns({"south": F.col("latitude") - half, "north": F.col("latitude") + half, "west": F.col("longitude") - half, "east": F.col("longitude") + half})


def decimate(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The point of least latitude, then longitude, of each one-degree cell (halves rounded up) of each field."""
    cols = [c for c in points.columns if c not in ("latitude", "longitude", *by)]
    one = points.groupBy(*by, E.half_up(F.col("latitude")).alias("cy"), E.half_up(F.col("longitude")).alias("cx")).agg(F.min(F.struct("latitude", "longitude", *cols)).alias("p"))
    return one.select(*by, "p.*")


def grid_step(points: DataFrame, fallback: float = 0.25, by: tuple[str, ...] = ()) -> DataFrame:
    """The wider of the steps between the two least latitudes and the two least longitudes of each field."""
    low = lambda c: F.slice(F.array_sort(F.collect_set(F.round(c, 3))), 1, 2)
    step = lambda a: F.when(F.size(a) >= 2, F.round(F.try_element_at(a, F.lit(2)) - F.try_element_at(a, F.lit(1)), 6)).otherwise(fallback)
    return points.groupBy(*by).agg(low("latitude").alias("y"), low("longitude").alias("x")).select(*by, F.greatest(step(F.col("y")), step(F.col("x"))).alias("step"))


def arrows(wind: DataFrame, spacing: float = 0.5, reach: float = 0.75, by: tuple[str, ...] = ()) -> DataFrame:
    """The nearest vector of each node within reach: angle and length; calm nodes (under 0.5) and u = 0 go."""
    nearest = near(target_grid(wind, spacing, by), wind, reach, by).groupBy(*by, "ty", "tx").agg(F.min(F.struct("d2", "latitude", "longitude", "u", "v")).alias("p"))
    speed = E.wind_speed(F.col("p.u"), F.col("p.v"))
    return nearest.where((F.col("p.u") != 0) & (speed >= 0.5)).select(*by, "ty", "tx", F.round(F.atan2("p.v", "p.u"), 6).alias("angle"), F.round(F.least(speed * 3, F.lit(32.0)), 6).alias("length"))


def lower_envelope(y: np.ndarray, g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each of `at` (ascending), the place of the least of the parabolas (at - y)^2 + g; `y` ascending and different.

    The envelope is built in one pass and searched once. Where parabolas meet, rounding may hide a neighbour that is
    as near, so both neighbours in the envelope are looked at as well; ties go to the smaller y.
    """
    hull: list[int] = []
    cuts: list[float] = []  # from which on each of the hull is the least
    for k in range(len(y)):
        while hull:
            j = hull[-1]
            cut = ((g[k] + y[k] * y[k]) - (g[j] + y[j] * y[j])) / (2 * (y[k] - y[j]))
            if cut > cuts[-1]:
                break
            hull.pop()
            cuts.pop()
        cuts.append(cut if hull else -np.inf)
        hull.append(k)
    own = np.array(hull)
    place = np.searchsorted(np.array(cuts), at, side="left") - 1
    near_by = own[np.clip(np.stack([place - 1, place, place + 1]), 0, len(own) - 1)]
    cost = (y[near_by] - at) ** 2 + g[near_by]
    return near_by[np.argmin(cost, axis=0), np.arange(len(at))]


def resample(wind: DataFrame, step: float = 0.25, by: tuple[str, ...] = ()) -> DataFrame:
    """u and v of the nearest vector of each node of each field, however far; ties to the smaller latitude, then longitude.

    An exact distance transform, one axis at a time. Along the columns: of each latitude that has vectors, the nearest one
    of every column's longitude, by two window scans. Along the rows: of each column, the least of its parabolas over
    those latitudes at every row. Both passes look at latitudes times columns and at nodes, whatever voids lie between, and
    a group is one latitude or one column of one field. Without vectors there is no row.
    """
    held = F.broadcast(boxes(wind, step, by))  # a row for each field
    at = wind.groupBy(*by, "latitude", "longitude").agg(F.min(F.struct("u", "v")).alias("wind"))
    sites = at.select(*by, "latitude", F.col("longitude").alias("x"), F.lit(None).cast("bigint").alias("column"), F.struct("longitude", "wind.u", "wind.v").alias("site"))
    own = wind.select(*by, "latitude").distinct()
    lines = (own.join(held, list(by)) if by else own.crossJoin(held)).withColumn("column", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("columns") - 1)))
    asked = lines.select(*by, "latitude", (F.col("west") + F.col("column") * step).alias("x"), "column", F.lit(None).cast(sites.schema["site"].dataType).alias("site"))
    line = Window.partitionBy(*by, "latitude").orderBy("x", F.col("column").isNotNull())  # a vector before a node at its place
    met = sites.unionByName(asked).withColumns({"left": F.last("site", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)), "right": F.first("site", ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))})
    away = lambda s: (F.col(f"{s}.longitude") - F.col("x")) * (F.col(f"{s}.longitude") - F.col("x"))
    best = F.least(F.when(F.col("left").isNotNull(), F.struct(away("left").alias("g"), F.col("left").alias("site"))), F.when(F.col("right").isNotNull(), F.struct(away("right").alias("g"), F.col("right").alias("site"))))
    sided = met.where(F.col("column").isNotNull()).withColumn("best", best).select(*by, "column", F.col("x").alias("tx"), "latitude", "best.g", "best.site.u", "best.site.v", "best.site.longitude")
    sided = sided.join(held.select(*by, "south", "rows"), list(by)) if by else sided.crossJoin(held.select("south", "rows"))

    def column(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("latitude", ignore_index=True)
        row = np.arange(int(rows.rows[0]))
        ty = rows.south[0] + row * step
        k = lower_envelope(rows.latitude.to_numpy(), rows.g.to_numpy(), ty)
        out = {c: rows[c][0] for c in by} | {"row": row, "column": rows["column"][0], "ty": ty, "tx": rows.tx[0], "u": rows.u.to_numpy()[k], "v": rows.v.to_numpy()[k]}
        return pd.DataFrame(out)

    kinds = {f.name: f.dataType.simpleString() for f in wind.schema.fields}
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "row bigint", "column bigint", "ty double", "tx double", "u double", "v double"])
    return sided.groupBy(*by, "column").applyInPandas(column, ddl)


STEPS, LENGTH = 120, 3.0  # of a traced line


def trace(u: np.ndarray, v: np.ndarray, y0: float, x0: float, unit: float, steps: int = STEPS, length: float = LENGTH, corner: tuple[int, int] = (0, 0), shape: tuple[int, int] | None = None) -> list[tuple[float, float]]:
    """A line through a wind grid (rows by y, `unit` apart), in unit steps; ends at calm or at the edge.

    `u` and `v` may be a part of a grid of `shape`, whose first node is `corner`; it must hold all that a line reaches.
    """
    rows, cols = shape or u.shape
    top, right = (rows - 1) * unit, (cols - 1) * unit
    line, y, x = [(y0, x0)], y0, x0
    for _ in range(steps):
        r, c = int(y / unit + 0.5) - corner[0], int(x / unit + 0.5) - corner[1]
        a, b = u[r, c], v[r, c]
        speed = (a * a + b * b) ** 0.5
        if not speed >= 0.3:
            break
        nx, ny = x + a / speed * length, y + b / speed * length
        if not (0 <= nx <= right and 0 <= ny <= top):
            break
        line.append((ny, nx))
        y, x = ny, nx
    return line


def along(line: list[tuple[float, float]], every: float = 40.0, least: float = 10.0) -> list[tuple[float, float]]:
    """Points at equal distances along a line; none on lines shorter than `least`."""
    p = np.array(line)
    at = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
    if at[-1] < least:
        return []
    where = np.arange(0.0, at[-1], every)
    return list(zip(np.interp(where, at, p[:, 0]).tolist(), np.interp(where, at, p[:, 1]).tolist()))


def line_dots(points: DataFrame, by: tuple[str, ...], every: float = 40.0, least: float = 10.0) -> DataFrame:
    """(by, dot, y, x): what `along` gives, of many lines (by, k, y, x; in order of k) as joins of nothing: windows over
    each line for its lengths, and every stretch makes the dots that fall on it."""
    line = Window.partitionBy(*by).orderBy("k")
    ends = points.withColumns({"y1": F.lead("y").over(line), "x1": F.lead("x").over(line)})
    length = F.sqrt((F.col("y1") - F.col("y")) * (F.col("y1") - F.col("y")) + (F.col("x1") - F.col("x")) * (F.col("x1") - F.col("x")))
    parts = ends.withColumn("l", length).where("l > 0").withColumns({"upto": F.sum("l").over(line), "whole": F.sum("l").over(Window.partitionBy(*by))})
    first, last = F.ceil((F.col("upto") - F.col("l")) / every), F.ceil(F.col("upto") / every) - 1
    dots = parts.where((F.col("whole") >= least) & (first <= last)).withColumn("dot", F.explode(F.sequence(first, last)))
    share = (F.col("dot") * every - F.col("upto") + F.col("l")) / F.col("l")
    return dots.select(*by, "dot", (F.col("y") + (F.col("y1") - F.col("y")) * share).alias("y"), (F.col("x") + (F.col("x1") - F.col("x")) * share).alias("x"))


def streamlines(wind: DataFrame, step: float = 0.25, unit: float = 8.0, seed_every: float = 28.0, tile: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, seed_y, seed_x, n_points, length, dots) of each traced line of three points or more, of every field.

    Tracing is sequential along a line and needs the wind around it, but a line reaches no further than its steps are
    long. So seeds are grouped by field and by tiles of `tile` nodes each way, and every tile gets its nodes and those of a margin
    that wide: a group's size does not hang on the grid's. Nodes without wind are calm. Without vectors there is no line.
    """
    margin = int(STEPS * LENGTH / unit) + 2
    held = boxes(wind, step, by)
    seeds_in = lambda c: F.floor(F.greatest(F.lit(0), F.ceil(((F.col(c) - 1) * unit - seed_every / 2) / seed_every)))
    steps = lambda c: F.explode(F.when(seeds_in(c) > 0, F.sequence(F.lit(0).cast("bigint"), seeds_in(c) - 1)))
    tile_of = lambda c: F.floor(F.floor(F.col(c) / unit + 0.5) / tile)
    seeds = held.withColumn("k", steps("rows")).repartition(*by, "k").withColumn("j", steps("columns"))
    seeds = seeds.select(*by, "rows", "columns", (F.col("k") * seed_every + seed_every / 2).alias("y"), (F.col("j") * seed_every + seed_every / 2).alias("x"))
    seeds = seeds.withColumns({"ky": tile_of("y"), "kx": tile_of("x")})
    nodes = resample(wind, step, by).select(*by, F.col("row").alias("i"), F.col("column").alias("j"), "u", "v")
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - margin) / tile), F.floor((F.col(c) + margin) / tile)))
    nodes = nodes.withColumn("ky", tiles("i")).withColumn("kx", tiles("j"))

    def lines(key: tuple, here: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        names = [*by, "seed_y", "seed_x", "n_points", "length", "dots"]
        if here.empty:
            return pd.DataFrame([], columns=names)
        shape = int(here.rows[0]), int(here["columns"][0])
        first = tuple(max(0, int(k) * tile - margin) for k in key[-2:])
        size = tuple(min(n, (int(k) + 1) * tile + margin + 1) - f for n, k, f in zip(shape, key[-2:], first))
        u, v = np.zeros(size), np.zeros(size)
        i, j = around.i.to_numpy() - first[0], around.j.to_numpy() - first[1]
        inside = (i >= 0) & (j >= 0) & (i < size[0]) & (j < size[1])
        u[i[inside], j[inside]], v[i[inside], j[inside]] = around.u[inside], around.v[inside]
        out = []
        for y, x in zip(here.y, here.x):
            line = trace(u, v, y, x, unit, corner=first, shape=shape)
            if len(line) >= 3:
                out.append((*key[:-2], y, x, len(line), LENGTH * (len(line) - 1), [{"y": a, "x": b} for a, b in along(line)]))
        return pd.DataFrame(out, columns=names)

    kinds = {f.name: f.dataType.simpleString() for f in wind.schema.fields}
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "seed_y double, seed_x double, n_points int, length double, dots array<struct<y:double,x:double>>"])
    return seeds.groupBy(*by, "ky", "kx").cogroup(nodes.groupBy(*by, "ky", "kx")).applyInPandas(lines, ddl)


def regrid(points: DataFrame, keys: list[str], value: str = "value", per_degree: int = 2) -> DataFrame:
    """Means of `value` on a common grid (an extension)."""
    at = {"latitude": E.cell(F.col("latitude"), per_degree) / per_degree, "longitude": E.cell(F.col("longitude"), per_degree) / per_degree}
    return points.withColumns(at).groupBy(*keys, "latitude", "longitude").agg(F.avg(value).alias(value))


def neighbourhood_skill(pairs: DataFrame, limit: float, radius: int, per_degree: int = 2) -> DataFrame:
    """Fractions skill over squares of (2 radius + 1) cells around each cell, by model and hour (an extension).

    Event shares of all squares come from summed-area tables: four corners each, whatever the radius.
    """
    by, values = ("model_name", "forecast_hour"), ("n", "nf", "no")
    event = lambda c: (F.col(c) > limit).cast("bigint")
    cells = pairs.select(*by, E.cell(F.col("latitude"), per_degree).cast("bigint").alias("cy"), E.cell(F.col("longitude"), per_degree).cast("bigint").alias("cx"), F.lit(1).cast("bigint").alias("n"), event("mean_rate").alias("nf"), event("obs_rate").alias("no"))
    asked = cells.select(*by, F.col("cy").alias("y"), F.col("cx").alias("x")).distinct()
    asked = asked.select("*", *((F.col(c) + d * radius).alias(f"{c}{k}") for c in "yx" for k, d in ((0, -1), (1, 1))))
    met = S.box_sums(S.area_table(cells, by, values), asked, by, values, (*by, "y", "x")).select(*by, (F.col("nf") / F.col("n")).alias("f"), (F.col("no") / F.col("n")).alias("o"))
    got = met.groupBy("model_name", "forecast_hour").agg(F.avg((F.col("f") - F.col("o")) * (F.col("f") - F.col("o"))).alias("mse"), F.avg(F.col("f") * F.col("f") + F.col("o") * F.col("o")).alias("ref"))
    return got.select("model_name", "forecast_hour", F.when(F.col("ref") <= E.NEAR_ZERO, 1.0).otherwise(E.exact_round(1 - F.try_divide(F.col("mse"), F.col("ref")), 4)).alias("fss"))
