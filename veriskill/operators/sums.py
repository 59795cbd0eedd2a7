"""Sums over any box from summed-area tables, and exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriskill.scratch import written


def area_table(cells: DataFrame, by: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """(by, cy, cx, values): for every cell of each field's grid the sums over all cells up to it, both axes.

    `cells` has integer cy and cx and the values; cells that miss count as zeros. Two running sums, along rows and then
    along columns; a window is one row or one column of one field.
    """
    sums = cells.groupBy(*by, "cy", "cx").agg(*(F.sum(v).alias(v) for v in values))
    side = sums.groupBy(*by).agg(F.min("cy").alias("y0"), F.max("cy").alias("y1"), F.min("cx").alias("x0"), F.max("cx").alias("x1"))
    grid = side.withColumn("cy", F.explode(F.sequence("y0", "y1"))).repartition(*by, "cy").withColumn("cx", F.explode(F.sequence("x0", "x1"))).select(*by, "cy", "cx")
    full = grid.join(sums, [*by, "cy", "cx"], "left").fillna(0, list(values))
    for line, along in (("cy", "cx"), ("cx", "cy")):
        upto = Window.partitionBy(*by, line).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
        full = full.withColumns({v: F.sum(v).over(upto) for v in values})
    return full


def box_sums(table: DataFrame, asked: DataFrame, by: tuple[str, ...], values: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """(keys, values) of `asked` (keys, y0, y1, x0, x1 in cells, both ends in), which hold `by`: four corners for each.

    Boxes may stick out of the grid; those without a cell in it have no row.
    """
    side = table.groupBy(*by).agg(F.min("cy").alias("s"), F.max("cy").alias("n"), F.min("cx").alias("w"), F.max("cx").alias("e"))
    held = asked.join(side, list(by)).where("y0 <= n AND y1 >= s AND x0 <= e AND x1 >= w AND y0 <= y1 AND x0 <= x1")
    y, x = (F.least("y1", "n"), F.col("y0") - 1), (F.least("x1", "e"), F.col("x0") - 1)
    corners = F.array(*(F.struct(a.cast("bigint").alias("cy"), b.cast("bigint").alias("cx"), F.lit(1 if i == j else -1).alias("sign")) for i, a in enumerate(y) for j, b in enumerate(x)))
    asking = held.withColumn("c", F.explode(corners)).select(*keys, *(c for c in by if c not in keys), "s", "w", "c.*").where("cy >= s AND cx >= w")
    met = asking.join(table, [*by, "cy", "cx"])
    return met.groupBy(*keys).agg(*(F.sum(F.col("sign") * F.col(v)).alias(v) for v in values))


BINS, FEW = 1024, 4096  # bins of a histogram; values that are sorted at the end, at most


def exact_percentiles(rows: DataFrame, by: tuple[str, ...], value: str, shares: tuple[float, ...]) -> DataFrame:
    """(by, n, p): the count of `value` and its exact percentiles at `shares`, between the two nearest values in proportion.

    A group is never gathered. Each order statistic that is asked for has a range that holds it; every pass counts the
    values of the range in BINS bins of equal width, by partial aggregates with each bin's least and greatest value, and
    keeps the bin of the wanted rank, until that has one value only or no more than FEW, which are sorted. Ranges narrow
    to values that occur, so every pass gets further. Nulls and NaN take no part; a group without other values has no row.
    Without `by` all rows are one group.
    """
    if not by:
        return exact_percentiles(rows.withColumn("__all", F.lit(1)), ("__all",), value, shares).drop("__all")
    data = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("v"))
    n = written(data.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "groups")
    place = lambda q: F.lit(q) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(q)), F.ceil(place(q))) for q in shares))))
    open_ = written(n.withColumn("rank", F.explode(ranks)).select(*by, "rank", F.col("rank").alias("left"), F.col("n").alias("held"), "lo", "hi"), "ranges")
    found = open_.where("lo = hi").select(*by, "rank", F.col("lo").alias("v"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    while True:
        wide = open_.where((F.col("lo") < F.col("hi")) & (F.col("held") > FEW))
        if not wide.limit(1).count():
            break
        ranges = wide.select(*by, "lo", "hi").distinct()
        bin_ = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        inside = _joined(data, ranges, same).where("v BETWEEN lo AND hi").withColumn("bin", bin_)
        bins = inside.groupBy(*by, "lo", "hi", "bin").agg(F.count("*").alias("m"), F.min("v").alias("a"), F.max("v").alias("b"))
        order = Window.partitionBy(*by, "lo", "hi").orderBy("bin")
        bins = written(bins.withColumn("upto", F.sum("m").over(order)).select(*by, F.col("lo").alias("l0"), F.col("hi").alias("h0"), "m", "a", "b", "upto"), "bins")
        next_ = _joined(wide, bins, same).where("lo = l0 AND hi = h0 AND left < upto AND left >= upto - m")
        next_ = next_.select(*by, "rank", (F.col("left") - F.col("upto") + F.col("m")).alias("left"), F.col("m").alias("held"), F.col("a").alias("lo"), F.col("b").alias("hi"))
        rest = open_.where((F.col("lo") < F.col("hi")) & (F.col("held") <= FEW))
        open_ = written(rest.unionByName(next_), "ranges")
        found = found.unionByName(open_.where("lo = hi").select(*by, "rank", F.col("lo").alias("v")))
    last = open_.where("lo < hi")
    few = _joined(data, last.select(*by, "lo", "hi").distinct(), same).where("v BETWEEN lo AND hi").groupBy(*by, "lo", "hi").agg(F.array_sort(F.collect_list("v")).alias("vs"))  # FEW values at most
    few = few.withColumnsRenamed({"lo": "l0", "hi": "h0"})
    sorted_ = _joined(last, few, same).where("lo = l0 AND hi = h0")
    found = written(found.unionByName(sorted_.select(*by, "rank", F.element_at("vs", (F.col("left") + 1).cast("int")).alias("v"))), "statistics")
    held = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    at = lambda f, q: F.element_at("at", f(place(q)))
    part = lambda q: place(q) - F.floor(place(q))
    p = F.array(*(at(F.floor, q) * (1 - part(q)) + at(F.ceil, q) * part(q) for q in shares))
    return _joined(n.select(*by, "n"), held, same).select(*by, "n", p.alias("p"))


def _joined(left: DataFrame, right: DataFrame, same: list) -> DataFrame:
    """Inner join by equal (or equally null) group columns, which are those of `left`."""
    names = [c for c in right.columns if c not in left.columns]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return left.alias("l").join(right.alias("r"), on).select("l.*", *(f"r.{c}" for c in names))
