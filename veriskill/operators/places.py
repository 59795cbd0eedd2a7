"""Points in many polygons by a cover of cells, and boxes cut into ranges of a space-filling key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE = ("yi", "xi", "yj", "xj")
_NEAR = 1e-9  # degrees by which an edge is thought wider when its cells are taken


def edges(polygons: DataFrame) -> DataFrame:
    """(polygon_id, yi, xi, yj, xj): each vertex with the one before it; `polygons` has vertices, array<struct<lat, lon>>."""
    before = lambda k: F.element_at("vertices", F.when(k == 0, -1).otherwise(k))
    pairs = F.transform("vertices", lambda v, k: F.struct(v["lat"].alias("yi"), v["lon"].alias("xi"), before(k)["lat"].alias("yj"), before(k)["lon"].alias("xj")))
    return polygons.where(F.size("vertices") > 0).select("polygon_id", F.explode(pairs).alias("e")).select("polygon_id", "e.*")


def _rows(edge: DataFrame, size: float) -> DataFrame:
    """`edge` with `cy`, once for each row of cells that it touches."""
    floor = lambda x: F.floor(x / size)
    return edge.withColumn("cy", F.explode(F.sequence(floor(F.least("yi", "yj") - _NEAR), floor(F.greatest("yi", "yj") + _NEAR))))


def crosses(lat: Column, lon: Column, e: Column) -> Column:
    """Whether the line from a point towards greater longitudes crosses an edge, by the even-odd rule's own formula."""
    return ((e["yi"] > lat) != (e["yj"] > lat)) & (lon < (e["xj"] - e["xi"]) * (lat - e["yi"]) / F.nullif(e["yj"] - e["yi"], F.lit(0.0)) + e["xi"])


def cover(polygons: DataFrame, size: float) -> DataFrame:
    """(polygon_id, cy, run, inner, edges): of each row of cells that a polygon's edges touch, `cx` of the cells of `size`
    degrees that they run through and of those that the polygon fills, and its edges there but for flat ones.

    Edge cells come from each edge cut at the row; inner cells from the crossings of the row's middle, taken in pairs. A
    row of a polygon is gathered in one place, so memory follows the edges in that row.
    """
    floor = lambda x: F.floor(x / size)
    at = lambda y: F.when(F.col("yi") == F.col("yj"), F.col("xi")).otherwise((F.col("xj") - F.col("xi")) * (y - F.col("yi")) / F.nullif(F.col("yj") - F.col("yi"), F.lit(0.0)) + F.col("xi"))
    low, high = (F.greatest(F.least("yi", "yj"), F.least(F.greatest("yi", "yj"), b)) for b in (F.col("cy") * size, (F.col("cy") + 1) * size))
    flat, middle = F.col("yi") == F.col("yj"), (F.col("cy") + 0.5) * size
    west, east = (F.when(flat, f("xi", "xj")).otherwise(f(at(low), at(high))) for f in (F.least, F.greatest))
    crossing = F.when((F.col("yi") > middle) != (F.col("yj") > middle), at(middle))
    touching = F.struct(*EDGE, floor(west - _NEAR).alias("first"), floor(east + _NEAR).alias("last"), crossing.alias("x"))
    rows = _rows(edges(polygons), size).groupBy("polygon_id", "cy").agg(F.collect_list(touching).alias("all"))
    steep = F.transform(F.filter("all", lambda e: e["yi"] != e["yj"]), lambda e: F.struct(*(e[n].alias(n) for n in EDGE)))
    rows = rows.select("polygon_id", "cy", "all", F.array_sort(F.array_compact("all.x")).alias("xs"), steep.alias("edges"))
    cells = lambda first, last: F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    between = lambda k: cells(F.ceil(F.col("xs")[k * 2] / size - 0.5), F.floor(F.col("xs")[k * 2 + 1] / size - 0.5))
    pairs = F.when(F.size("xs") > 0, F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    run = F.aggregate("all", F.array().cast("array<bigint>"), lambda held, e: F.array_union(held, cells(e["first"], e["last"])))  # a cell is held once, however many edges touch it
    return rows.select("polygon_id", "cy", run.alias("run"), F.flatten(F.transform(pairs, between)).alias("filled"), "edges").select("polygon_id", "cy", "run", F.array_except("filled", "run").alias("inner"), "edges")


FEW_EDGES = 6  # of a row of cells: up to so many are tested in the join itself


def in_polygons(points: DataFrame, polygons: DataFrame, size: float = 0.25) -> DataFrame:
    """`points` (latitude, longitude, ...) with polygon_id, a row for each polygon that holds the point.

    Points meet the polygons' covers by cell; inner cells settle it, and only in edge cells the even-odd test runs,
    over the edges of the polygon in that row of cells. It gives what the test over all edges gives. Edge cells bring
    these edges along as columns, so that pairs are tested where they meet and never shuffled; where a row has more than
    FEW_EDGES, pairs fetch them. Nothing is compared but within a cell; `size` should be a small part of a polygon. Null
    places are in none.

    Spark takes covers to be as small as the polygons, as it does not know how many cells come of one; so the joins are
    told to sort and merge, else it broadcasts all cells through the driver. A cell's points are held at a time.
    """
    parts = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    covered = lambda p: cover(p.repartition(parts, "polygon_id"), size).withColumnsRenamed({"cy": "__cy", "edges": "__edges"})  # noqa: E731 made where the polygon is
    lat, lon, here = F.col("latitude"), F.col("longitude"), ["__cy", "__cx"]
    keyed = points.where(lat.isNotNull() & lon.isNotNull()).withColumns({"__cy": F.floor(lat / size), "__cx": F.floor(lon / size)})
    brought, few = {}, F.lit(False)
    for k in range(FEW_EDGES):  # one that is not there crosses nothing
        e, yi, yj, xi, dx, dy = F.get("__edges", F.lit(k)), f"__yi{k}", f"__yj{k}", f"__xi{k}", f"__dx{k}", f"__dy{k}"
        values = {yi: (e["yi"], 0.0), yj: (e["yj"], 0.0), xi: (e["xi"], 0.0), dx: (e["xj"] - e["xi"], 0.0), dy: (e["yj"] - e["yi"], 1.0)}
        brought |= {name: F.coalesce(value, F.lit(none)) for name, (value, none) in values.items()}
        few = few != (((F.col(yi) > lat) != (F.col(yj) > lat)) & (lon < F.col(dx) * (lat - F.col(yi)) / F.col(dy) + F.col(xi)))
    rows, many = covered(polygons), covered(polygons.where(F.size("vertices") > FEW_EDGES)).where(F.size("__edges") > FEW_EDGES)
    inner = rows.select("polygon_id", "__cy", F.explode("inner").alias("__cx"))
    light = rows.where(F.size("__edges").between(1, FEW_EDGES)).select("polygon_id", "__cy", "run", *(v.alias(n) for n, v in brought.items())).withColumn("__cx", F.explode("run")).drop("run")
    odd = F.aggregate("__edges", F.lit(False), lambda s, e: s != crosses(lat, lon, e))
    columns = [*points.columns, "polygon_id"]
    meet = lambda cells: cells.hint("merge").join(keyed, here)
    tested = meet(many.select("polygon_id", "__cy", F.explode("run").alias("__cx"))).hint("merge").join(many.select("polygon_id", "__cy", "__edges"), ["polygon_id", "__cy"]).where(odd)
    return meet(inner).select(*columns).unionByName(meet(light).where(few).select(*columns)).unionByName(tested.select(*columns))


BITS = 16  # of each coordinate in a key


def _spread(x: Column) -> Column:
    """The lower 16 bits of `x`, each followed by an empty one."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _place(x: float, low: float, span: float) -> int:
    return min((1 << BITS) - 1, max(0, int((x - low) / span * (1 << BITS))))


def z_key(lat: Column, lon: Column) -> Column:
    """Bits of latitude and longitude in turn: near places have near keys."""
    held = lambda x, low, span: F.least(F.greatest(F.floor((x - low) / span * (1 << BITS)), F.lit(0)), F.lit((1 << BITS) - 1)).cast("bigint")
    return F.shiftleft(_spread(held(lat, -90.0, 180.0)), 1).bitwiseOR(_spread(held(lon, -180.0, 360.0)))


def z_ranges(south: float, north: float, west: float, east: float, most: int = 48) -> list[tuple[int, int]]:
    """Ranges of keys that hold a box, at most `most`: squares are halved while they stick out, the largest first."""
    y0, y1, x0, x1 = _place(south, -90.0, 180.0), _place(north, -90.0, 180.0), _place(west, -180.0, 360.0), _place(east, -180.0, 360.0)
    done, open_ = [], [(0, 0, BITS)]  # square: corner and its side as a power of two
    interleaved = lambda y, x: sum(((y >> b & 1) << (2 * b + 1)) | ((x >> b & 1) << (2 * b)) for b in range(BITS))
    while open_:
        if len(done) + len(open_) > most - 4:
            done += open_
            break
        y, x, b = open_.pop(0)
        side = 1 << b
        if y > y1 or x > x1 or y + side <= y0 or x + side <= x0:
            continue
        if b == 0 or (y >= y0 and x >= x0 and y + side - 1 <= y1 and x + side - 1 <= x1):
            done.append((y, x, b))
        else:
            half = side // 2
            open_ += [(y + i * half, x + j * half, b - 1) for i in (0, 1) for j in (0, 1)]
    out: list[tuple[int, int]] = []
    for first, last in sorted((k, k + (1 << (2 * b)) - 1) for y, x, b in done if not (y > y1 or x > x1 or y + (1 << b) <= y0 or x + (1 << b) <= x0) for k in [interleaved(y, x)]):
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(last, out[-1][1])
        else:
            out.append((first, last))
    return out


def with_key(rows: DataFrame) -> DataFrame:
    """`rows` (latitude, longitude, ...) with z_key, in order of it: files and row groups then hold near places."""
    return rows.withColumn("z_key", z_key(F.col("latitude"), F.col("longitude"))).repartitionByRange("z_key").sortWithinPartitions("z_key")


def in_box(rows: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """Rows of a keyed table inside a box: key ranges, which the scan's statistics can rule out, and the box itself."""
    some = F.lit(False)
    for first, last in z_ranges(south, north, west, east):
        some = some | F.col("z_key").between(first, last)
    return rows.where(some & F.col("latitude").between(south, north) & F.col("longitude").between(west, east))
