"""Scalar expressions: wind, units, thresholds, grid cells, the normal law, colour and size scales."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain.
ACCUM_HOURS = {"AIFS": 6, "GEFS": 3, "UKMO": 1}
NEAR_ZERO = 1e-10
POINT_BOX = 0.26
CORRELATION_HOURS = (0, 6, 12, 18, 24, 48, 72, 96, 120, 144, 168)
TOKEN = re.compile(r"[A-Za-z0-9_]{1,40}")


def checked_token(name: str) -> str:
    """`name` if it is an allowed identifier, else ValueError; before any plan is built."""
    if not TOKEN.fullmatch(name or ""):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def is_token(name: Column) -> Column:
    """Whether a column's name would pass `checked_token`."""
    return name.rlike(f"^(?:{TOKEN.pattern})\\z")


def zero_if_null(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction(u: Column, v: Column) -> Column:
    """Degrees that the wind blows from."""
    return F.pmod(F.degrees(F.atan2(u, v)) + 180.0, F.lit(360.0))


def accum_hours(model: Column) -> Column:
    out = F.lit(1.0)
    for name, hours in ACCUM_HOURS.items():
        out = F.when(model == name, float(hours)).otherwise(out)
    return out


def threshold(variable: str, mm_6h: float = 25.0, metres_s: float = 10.0) -> float:
    return mm_6h / 6.0 if variable == "precipitation" else metres_s


def valid_time(init: str, hour: str) -> Column:
    return F.expr(f"timestampadd(HOUR, {hour}, {init})")


def cell(x: Column, per_degree: int = 2) -> Column:
    """Integer key of the grid cell of `x`, halves to even."""
    return F.bround(x * per_degree).cast("int")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


_SPLIT = 134217729.0  # 2^27 + 1


def exact_round(x: Column | str, places: int) -> Column:
    """`x` rounded to `places` decimals by its exact binary value, halves to even, as doubles are rounded by the decimal law.

    Spark rounds the shortest decimal text of a double, which may stand on a half that the double does not. Here x * 10^places is
    taken as a double and the exact rest of that product (both factors cut in two halves, whose products have no
    rest), and the sign of (fraction - 1/2 + rest) decides. Nulls, NaN and values without decimals stay. `x` is repeated
    in the expression: give it a column, an aggregate or something as cheap.
    """
    x = F.col(x) if isinstance(x, str) else x
    power = 10.0**places
    high = power * _SPLIT - (power * _SPLIT - power)
    low = power - high
    product = F.abs(x) * power
    head = x * _SPLIT - (x * _SPLIT - x)
    tail = x - head
    rest = ((head * high - x * power) + head * low + tail * high) + tail * low
    side = (product - F.floor(product) - 0.5) + F.signum(x) * rest
    whole = F.floor(product) + F.when((side > 0) | ((side == 0) & (F.floor(product) % 2 == 1)), 1).otherwise(0)
    return F.when(product < 2.0**53, F.when(x == 0, x).otherwise(F.signum(x) * whole / power)).otherwise(x)


def normal_cdf_sql(x: str) -> str:
    """Hart's rational form of the standard normal law as published by West (2005); absolute error near 1e-16."""
    a = f"abs({x})"
    horner = lambda cs: "(" * (len(cs) - 1) + f"{cs[0]}" + "".join(f"*{a}+{c})" for c in cs[1:])
    top = horner(("3.52624965998911E-2", "0.700383064443688E0", "6.37396220353165E0", "33.912866078383E0", "112.079291497871E0", "221.213596169931E0", "220.206867912376E0"))
    low = horner(("8.83883476483184E-2", "1.75566716318264E0", "16.064177579207E0", "86.7807322029461E0", "296.564248779674E0", "637.333633378831E0", "793.826512519948E0", "440.413735824752E0"))
    bell = f"exp(-({x})*({x})/2E0)"
    tail = f"({bell}/({a}+1E0/({a}+2E0/({a}+3E0/({a}+4E0/({a}+0.65E0)))))/2.506628274631E0)"
    lower = f"(CASE WHEN {a} > 37E0 THEN 0E0 WHEN {a} < 7.07106781186547E0 THEN {bell}*{top}/{low} ELSE {tail} END)"
    return f"(CASE WHEN ({x}) > 0 THEN 1E0 - {lower} ELSE {lower} END)"


def normal_pdf_sql(x: str) -> str:
    return f"(exp(-({x})*({x})/2E0)/2.5066282746310002E0)"


def event_probability_sql(mean: str, std: str, limit: str) -> str:
    """Chance of more than `limit` under a normal law; a step where the spread is next to nothing."""
    z = f"(({limit}) - ({mean}))/({std})"
    return f"(CASE WHEN {std} <= 1E-10 THEN CASE WHEN {mean} > {limit} THEN 1E0 ELSE 0E0 END ELSE 1E0 - {normal_cdf_sql(z)} END)"


def crps_sql(mean: str, std: str, obs: str, clamp: bool = True) -> str:
    """Continuous ranked probability score of a normal forecast."""
    z = f"(({obs}) - ({mean}))/({std})"
    score = f"(({std})*({z}*(2E0*{normal_cdf_sql(z)} - 1E0) + 2E0*{normal_pdf_sql(z)} - 0.5641895835477563E0))"
    score = f"greatest({score}, 0E0)" if clamp else score
    return f"(CASE WHEN {std} <= 1E-10 THEN abs({mean} - {obs}) ELSE {score} END)"


def cone(mean: Column, std: Column) -> dict[str, Column]:
    floor = lambda x: F.greatest(F.lit(0.0), x)
    return {"lower1": floor(mean - std), "upper1": mean + std, "lower2": floor(mean - 2 * std), "upper2": mean + 2 * std}


def snap(x: Column, buckets: int) -> Column:
    """Centre of the bucket of a share, or the share itself, held to 0..1, without buckets."""
    if not buckets:
        return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return (F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(0.9999)) * buckets) + 0.5) / buckets


def bucketed_value(value: Column, top: Column, buckets: int) -> Column:
    """Value at the centre of its bucket of 0..top; values under a hundredth of top stay."""
    share = F.least(value / top, F.lit(1.0))
    return F.when((top > 0) & (share >= 0.01), (F.floor(F.least(share, F.lit(0.9999)) * buckets) + 0.5) / buckets * top).otherwise(value)


def vsup_levels(buckets: int) -> list[int]:
    out = [buckets if buckets >= 2 else 8]
    while out[-1] > 1:
        out.append(out[-1] // 2)
    return out


def vsup_snap(value: Column, spread: Column, buckets: int) -> tuple[Column, Column]:
    """Value and spread (shares) at bucket centres; fewer value buckets where the spread is wide."""
    levels = vsup_levels(buckets)
    ring = F.least(F.floor(spread * len(levels)), F.lit(len(levels) - 1)).cast("int")
    bins = F.element_at(F.array(*map(F.lit, levels)), ring + 1)
    return (F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(0.9999)) * bins) + 0.5) / bins, (ring + 0.5) / len(levels)


def box_half_size(spread: Column, invert: bool = False, buckets: int = 0) -> Column:
    share = F.least(spread, F.lit(1.0))
    return 0.08 + F.sqrt(snap(1 - share if invert else share, buckets)) * (0.4 - 0.08)


def line_spacing(share: Column, width: float = 1.0, height: float = 1.0) -> Column:
    """Distance of hatching lines in a cell of this size; denser where the spread is wide."""
    return F.greatest(F.lit(1.5), max(width, height) * 2.5 * (1 - share * 0.95))


def square_size(share: Column, width: float = 1.0, height: float = 1.0) -> Column:
    return share * (min(width, height) * 0.92)


#: Colours of the sequential and diverging maps.
COLORMAPS = {
    "Default": ("#FFFFCC", "#C8F0C8", "#A0E6E6", "#70C8D2", "#5098C8", "#3264AA", "#001E6E", "#000050"),
    "Viridis": ("#440154", "#414487", "#2a788e", "#22a884", "#7ad151", "#fde725"),
    "Plasma": ("#0d0887", "#6a00a8", "#b12a90", "#e16462", "#fca636", "#f0f921"),
    "Inferno": ("#000004", "#420a68", "#932667", "#dd513a", "#fca50a", "#fcffa4"),
    "Turbo": ("#30123b", "#4662d7", "#36a9e1", "#13eb6b", "#a7fc3c", "#faba39", "#e8443a"),
    "Cool": ("#00ffff", "#00d4ff", "#00aaff", "#0080ff", "#0055ff", "#002bff", "#0000ff"),
    "Warm": ("#ffff00", "#ffdd00", "#ffbb00", "#ff9900", "#ff7700", "#ff5500", "#ff0000"),
    "RdYlBu": ("#a50026", "#d73027", "#f46d43", "#fdae61", "#fee090", "#ffffbf", "#e0f3f8", "#abd9e9", "#74add1", "#4575b4", "#313695"),
    "Spectral": ("#9e0142", "#d53e4f", "#f46d43", "#fdae61", "#fee08b", "#ffffbf", "#e6f598", "#abdda4", "#66c2a5", "#3288bd", "#5e4fa2"),
}


def colormap(share: Column, name: str = "Default", flip: bool = False) -> list[Column]:
    """Red, green and blue at a share of the map, between neighbouring colours in proportion."""
    stops = COLORMAPS[name]
    at = 1 - share if flip else share
    segment = F.least(F.floor(F.least(at, F.lit(0.9999)) * (len(stops) - 1)), F.lit(len(stops) - 2)).cast("int")
    within = at * (len(stops) - 1) - segment
    out = []
    for k in (1, 3, 5):
        channel = F.array(*(F.lit(int(s[k : k + 2], 16)) for s in stops))
        low, high = F.element_at(channel, segment + 1), F.element_at(channel, segment + 2)
        out.append(half_up(low + (high - low) * within))
    return out


def muted_colour(value: Column, spread: Column, vsup: bool = False, name: str = "Default") -> list[Column]:
    """Colour of a value, greyed by its spread; with `vsup` its hue goes to the middle of the map as well."""
    strength = 0.92 if vsup else 0.60
    at = value * (1 - spread * strength) + spread * strength * 0.5 if vsup else value
    return [half_up(c + (185 - c) * (spread * strength * 0.80)) for c in colormap(at, name)]


def tier(x: Column, edges: list[tuple[str, float, str | int]], last: str | int) -> Column:
    """Name of the first tier whose edge (`<`, `<=` or `>=`, limit, name) holds; null stays null."""
    out = F.lit(last)
    for sign, limit, name in reversed(edges):
        out = F.when({"<": x < limit, "<=": x <= limit, ">=": x >= limit}[sign], F.lit(name)).otherwise(out)
    return F.when(x.isNotNull(), out)
