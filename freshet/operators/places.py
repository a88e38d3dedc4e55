"""Values and features at places: planes sampled at points, areas of rings, lines of levels, networks matched to each other."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.weather import wind_from, wind_speed
from freshet.operators.snapping import _kept, snap_by_area

#: WGS84's semi-axis in km and first eccentricity.
SEMI_AXIS, ECCENTRICITY = 6378.137, 0.0818191908426215


# --- planes ----------------------------------------------------------------------------------------------------


def bilinear_sample(points: DataFrame, plane: DataFrame, by: list[str], rows: int, cols: int, degrees: float, least: float = 0.8) -> DataFrame:
    """(point_id, by, value): values of global planes (by, row, col, value), row 0 at 90 north and col 0 at 180 west, at points.

    Each plane becomes blocks of four neighbouring cells, so that a point meets its block by one equi-join and no row of a point and a plane
    is shuffled. Longitudes wrap, rows end at the poles. Missing corners don't take part; less than `least` of the weight gives NULL.
    Points outside -90..90 or -180..360 have no row; rows that repeat a point weigh together.
    """
    inside = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 360)
    at_row = F.least(F.greatest((90.0 - F.col("lat")) / degrees, F.lit(0.0)), F.lit(float(rows - 1)))
    at_col = F.pmod(F.col("lon") + 180, F.lit(360.0)) / degrees
    r, c = F.floor(at_row), F.floor(at_col)
    dr, dc = at_row - r, at_col - c
    row, col = F.col("row").cast("bigint"), F.col("col").cast("bigint")
    block = lambda up, back, k: F.struct((row - up).alias("_r"), F.pmod(col - back, F.lit(cols)).alias("_c"), F.lit(k).alias("_k"))
    part = plane.where(F.col("col").between(0, cols - 1)).select(*by, F.col("value").cast("double").alias("_v"), F.inline(F.array(block(0, 0, 0), block(0, 1, 1), block(1, 0, 2), block(1, 1, 3)))).where("_r >= 0")
    own = lambda k: F.col("_k") == k
    corners = [x for k in range(4) for x in (F.count_if(own(k)).alias(f"_p{k}"), F.count(F.when(own(k), F.col("_v"))).alias(f"_n{k}"), F.coalesce(F.sum(F.when(own(k), F.col("_v"))), F.lit(0.0)).alias(f"_s{k}"))]
    blocks = part.groupBy(*by, "_r", "_c").agg(*corners)
    placed = points.where(inside).groupBy("point_id", "lat", "lon").agg(F.count(F.lit(1)).alias("_rows"))
    w = [(1 - dr) * (1 - dc), (1 - dr) * dc, dr * (1 - dc), dr * dc]
    placed = placed.select("point_id", "_rows", r.cast("bigint").alias("_r"), F.pmod(c, F.lit(cols)).cast("bigint").alias("_c"), *[x.alias(f"_w{k}") for k, x in enumerate(w)])
    met = placed.join(blocks.hint("merge"), ["_r", "_c"])
    total = lambda what: sum((F.when(F.col(f"_w{k}") > 0, F.col(f"_w{k}") * F.col(f"_{what}{k}")).otherwise(0.0) for k in range(4)), F.lit(0.0))
    met = met.where(total("p") > 0).withColumn("_w", total("n") * F.col("_rows"))
    return met.select("point_id", *by, F.when(F.col("_w") >= least - 1e-6, total("s") * F.col("_rows") / F.col("_w")).alias("value"))


def point_timeseries(points: DataFrame, planes: DataFrame, leads: list[int], rows: int, cols: int, degrees: float) -> DataFrame:
    """(point_id, model, lead, precip, accumulated, temperature, wind_speed, wind_direction, pressure): all models' curves at points.

    planes: (model, stream, lead, row, col, value) with the streams precip (mm/h over the interval that ends at its lead), temp, u10,
    v10 and mslp. A point takes its nearest cell. A rate holds for the first stored lead at or after the wanted one, a
    state only at its own lead. Rain adds up over the stored intervals and is missing from the first missing one on. Points
    outside the globe have no rows; leads beyond a model's run and streams that it lacks are NULL.
    """
    near = points.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 360)).select(
        "point_id", F.least(F.greatest(F.round((90.0 - F.col("lat")) / degrees), F.lit(0)), F.lit(rows - 1)).cast("bigint").alias("row"),
        F.pmod(F.round(F.pmod(F.col("lon") + 180, F.lit(360.0)) / degrees), F.lit(cols)).cast("bigint").alias("col"))
    met = near.join(planes.select("model", "stream", "lead", F.col("row").cast("bigint"), F.col("col").cast("bigint"), "value"), ["row", "col"])
    stored = met.groupBy("point_id", "model", "lead").agg(*[F.max(F.when(F.col("stream") == s, F.col("value"))).alias(s) for s in ("precip", "temp", "u10", "v10", "mslp")], F.max(F.col("stream") == "precip").alias("_rain"))
    w = Window.partitionBy("point_id", "model").orderBy("lead")
    rain = stored.where("_rain").withColumn("_hours", F.col("lead") - F.coalesce(F.lag("lead").over(w), F.lit(0)))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = F.count_if(F.col("precip").isNull() & (F.col("_hours") > 0)).over(upto) == 0
    rain = rain.withColumn("accumulated", F.when(whole, F.sum(F.col("precip") * F.col("_hours")).over(upto)))
    wanted = F.explode(F.array(*[F.lit(k) for k in leads]))
    asked = stored.select("point_id", "model").distinct().withColumn("lead", wanted)
    steps = rain.withColumn("_from", F.coalesce(F.lag("lead").over(w) + 1, F.lit(1))).select("point_id", "model", "_from", F.col("lead").alias("_to"), "precip", "accumulated")
    hours = F.explode(F.filter(F.array(*[F.lit(k) for k in leads]), lambda k: (F.greatest(k, F.lit(1)) >= F.col("_from")) & (k <= F.col("_to")) & (F.col("_to") > 0)))
    rates = steps.withColumn("lead", hours).withColumn("accumulated", F.when(F.col("lead") == 0, 0.0).when(F.col("lead") == F.col("_to"), F.col("accumulated")).otherwise(F.col("accumulated") - F.col("precip") * (F.col("_to") - F.col("lead"))))
    out = asked.join(rates.select("point_id", "model", "lead", "precip", "accumulated"), ["point_id", "model", "lead"], "left").join(stored.drop("precip", "_rain"), ["point_id", "model", "lead"], "left")
    speed, direction = wind_speed(F.col("u10"), F.col("v10")), wind_from(F.col("u10"), F.col("v10"))
    return out.select(
        "point_id", "model", "lead", F.bround("precip", 2).alias("precip"), F.bround("accumulated", 1).alias("accumulated"), F.bround("temp", 1).alias("temperature"),
        F.bround(speed, 1).alias("wind_speed"), (F.floor(direction) % 360).cast("int").alias("wind_direction"), F.bround("mslp", 1).alias("pressure"),
    )


# --- areas and flows -------------------------------------------------------------------------------------------


def geodesic_area_km2(ring: Column) -> Column:
    """Area of a ring (array of struct lon, lat in degrees) on the WGS84 ellipsoid, whichever way it runs.

    Latitudes become authalic ones, by the closed form, and the ring a polygon of great circles on the sphere of equal
    area; edges go the shorter way around. Rings of fewer than three vertices have none. Within 0.1 % of geodesics for edges of a few degrees.
    """
    e, e2 = ECCENTRICITY, ECCENTRICITY**2
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    pole = (1 - e2) * (1 / (1 - e2) - math.log((1 - e) / (1 + e)) / (2 * e))
    half = F.transform(ring, lambda p: F.tan(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q(F.sin(F.radians(p["lat"]))) / pole))) / 2))
    n = F.size(ring)

    def part(i):
        a, b = i, F.pmod(i, n) + 1
        turn = F.radians(F.pmod(F.element_at(ring, b)["lon"] - F.element_at(ring, a)["lon"] + 540, F.lit(360.0)) - 180)
        x, y = F.element_at(half, a), F.element_at(half, b)
        return 2 * F.atan(F.tan(turn / 2) * (x + y) / (1 + x * y))

    excess = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, i: acc + part(i))
    return F.when(n >= 3, F.abs(excess) * (SEMI_AXIS**2 * pole / 2)).when(ring.isNotNull(), 0.0)


#: Knots of ratio to the 2-year flow below 1 with their percentiles, those at and above the 2-year flow, and least percentiles by rank.
_LOW = [(0.0, 2.0), (0.12, 25.0), (0.32, 50.0), (0.65, 75.0), (0.85, 84.0), (1.0, 90.0)]
_HIGH, _FLOORS = (95.0, 99.0, 99.9), {1: 91.0, 2: 96.0, 3: 99.3, 4: 99.8}


def live_flow_metrics(flow: Column, q2: Column, q5: Column, q20: Column, q50: Column, min_rank: Column) -> Column:
    """struct(percentile, rank, flow, q2): a live flow among its return periods.

    Thresholds that don't rise fall back on 1.66 and 2.50 times the 2-year flow, the highest on none. The percentile is linear
    between fixed ratios to the 2-year flow and at least that of the rank; without a 2-year flow it is 50, or 5 for no flow.
    """
    real = lambda c: F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)
    q = F.greatest(F.lit(0.0), F.coalesce(real(flow), F.lit(0.0)))
    two = F.when(real(q2) > 0, q2).otherwise(0.0)
    five = F.when(real(q5) > two, q5).otherwise(1.66 * two)
    twenty = F.when(real(q20) > five, q20).otherwise(2.50 * two)
    fifty = F.when(real(q50) > twenty, q50).otherwise(0.0)
    rank = F.when((fifty > 0) & (q >= fifty), 4).when((twenty > 0) & (q >= twenty), 3).when((five > 0) & (q >= five), 2).when((two > 0) & (q >= two), 1).otherwise(0)
    rank = F.greatest(rank, F.coalesce(min_rank.cast("int"), F.lit(0)))
    ratio = F.try_divide(q, F.when(two > 0, two))
    r5 = F.greatest(F.lit(1.05), F.try_divide(five, F.when(two > 0, two)))
    r20 = F.greatest(r5 + 0.10, F.try_divide(twenty, F.when(two > 0, two)))
    knots = [*((F.lit(r), p) for r, p in _LOW), (r5, _HIGH[0]), (r20, _HIGH[1]), (r20 * 1.5, _HIGH[2])]
    percent = F.lit(knots[-1][1])
    for (a, x), (b, y) in reversed(list(zip(knots, knots[1:]))):
        percent = F.when(ratio <= b, x + (ratio - a) / (b - a) * (y - x)).otherwise(percent)
    percent = F.when(two > 0, percent).when(q > 0, 50.0).otherwise(5.0)
    floor = F.coalesce(*[F.when(rank == k, F.lit(v)) for k, v in _FLOORS.items()], F.when(rank > 4, F.lit(_FLOORS[4])), F.lit(1.0))
    return F.struct(F.bround(F.least(F.greatest(percent, floor), F.lit(99.9)), 1).alias("percentile"), rank.alias("rank"), F.bround(q, 2).alias("flow"), F.when(two > 0, F.bround(two, 2)).alias("q2"))


def product_of_feature(features: DataFrame, feature: str, aliases: DataFrame) -> DataFrame:
    """features with the product of each `<product>_<band>` name: the longest whole-token prefix among aliases (alias, product), else its first token in capitals.

    Prefixes are compared in lower case with `-` as `_`; the last token is the band and is no part of a prefix.
    """
    key = F.lower(F.translate(F.col(feature), "-", "_"))
    tokens = F.split(key, "_")
    n = F.size(tokens)
    prefixes = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(tokens, 1, k), "_").alias("alias"))))
    numbered = features.withColumn("_row", F.monotonically_increasing_id())
    found = numbered.select("_row", F.inline(prefixes)).join(F.broadcast(aliases.select("alias", "product")), "alias")  # a registry
    best = found.groupBy("_row").agg(F.max_by("product", "k").alias("_p"))
    return numbered.join(best, "_row", "left").withColumn("product", F.coalesce("_p", F.upper(F.get(F.split(F.col(feature), "_"), F.lit(0))))).drop("_row", "_p")


# --- lines and levels ------------------------------------------------------------------------------------------

#: Steps in rows and columns of keypad drain directions; 5 is a pit.
KEYPAD = {1: (1, -1), 2: (1, 0), 3: (1, 1), 4: (0, -1), 6: (0, 1), 7: (-1, -1), 8: (-1, 0), 9: (-1, 1)}


def ldd_graph(cells: DataFrame, min_area: float) -> DataFrame:
    """(row, col, area, down_row, down_col) of cells (row, col, code, area) of min_area at least: the cell that each drains to.

    Codes are those of a keypad. Pits, other codes, and directions to a cell that isn't kept end there.
    """
    kept = cells.where(F.col("area") >= min_area)
    step = lambda i: F.coalesce(*[F.when(F.col("code") == c, F.lit(v[i])) for c, v in KEYPAD.items()])
    led = kept.select("row", "col", "area", (F.col("row") + step(0)).alias("_r"), (F.col("col") + step(1)).alias("_c"))
    there = kept.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.lit(True).alias("_in"))
    out = led.join(there, ["_r", "_c"], "left")
    return out.select("row", "col", "area", F.when(F.col("_in"), F.col("_r")).alias("down_row"), F.when(F.col("_in"), F.col("_c")).alias("down_col"))


def orient_reaches(reaches: DataFrame, node: str, down: str, line: str) -> DataFrame:
    """reaches with lines (array of struct lon, lat) that run downstream: one whose first vertex is nearer to the reach below than its last is reversed."""
    ends = reaches.select(F.col(node).alias("_down"), F.element_at(line, 1).alias("_a"), F.element_at(line, -1).alias("_b"))
    gap = lambda p, e: F.hypot(p["lon"] - e["lon"], p["lat"] - e["lat"])
    near = lambda p: F.least(gap(p, F.col("_a")), gap(p, F.col("_b")))
    met = reaches.join(ends, F.col(down) == F.col("_down"), "left")
    turned = near(F.element_at(line, 1)) + 1e-9 < near(F.element_at(line, -1))
    return met.withColumn(line, F.when(turned, F.reverse(line)).otherwise(F.col(line))).drop("_down", "_a", "_b")


def level_features(lines: DataFrame, west: float, south: float, east: float, north: float, severity: DataFrame, key: str) -> DataFrame:
    """Lines (key, line, has_forecast, area) whose box meets the query's, with their severity; those without a forecast or a status have 0.

    Lines of one vertex don't count. Coordinates are rounded to 4 digits and areas to 1.
    """
    lon, lat = F.transform("line", lambda p: p["lon"]), F.transform("line", lambda p: p["lat"])
    meets = (F.array_max(lon) >= west) & (F.array_min(lon) <= east) & (F.array_max(lat) >= south) & (F.array_min(lat) <= north)
    kept = lines.where((F.size("line") >= 2) & meets).join(severity.select(key, F.col("severity").alias("_s")), key, "left")
    rounded = F.transform("line", lambda p: F.struct(F.bround(p["lon"], 4).alias("lon"), F.bround(p["lat"], 4).alias("lat")))
    rank = F.when(F.col("has_forecast"), F.coalesce("_s", F.lit(0))).otherwise(0)
    return kept.withColumns({"line": rounded, "area": F.bround("area", 1), "severity": rank}).drop("_s")


def promote_active(coarse: DataFrame, fine: DataFrame, active: DataFrame, key: str, cell: float) -> DataFrame:
    """coarse with the fine level's lines of active keys that it lacks, marked `promoted`, one for each end cell.

    Cells of `cell` degrees: an end cell that a coarse line ends in is taken; of several promoted lines the one of the largest area, then the lowest key.
    """
    end = lambda c: F.struct(*[F.floor(F.element_at("line", -1)[x] / cell).alias(x) for x in ("lon", "lat")])
    needed = fine.where(F.size("line") >= 2).join(active.select(key).distinct(), key, "left_semi").join(coarse.select(key), key, "left_anti").withColumn("_end", end("line"))
    free = needed.join(coarse.where(F.size("line") >= 1).select(end("line").alias("_end")).distinct(), "_end", "left_anti")
    first = free.withColumn("_n", F.row_number().over(Window.partitionBy("_end").orderBy(F.desc("area"), key))).where("_n = 1").drop("_n", "_end")
    return coarse.withColumn("promoted", F.lit(False)).unionByName(first.select(*coarse.columns).withColumn("promoted", F.lit(True)))


def top_points(points: DataFrame, west: float, south: float, east: float, north: float, min_area: float, unit: str, n: int) -> DataFrame:
    """The n largest prediction points in a box: one of each unit, that of the largest area among those with a forecast, if any has one.

    Points of unit NULL stand for themselves. Ties go to the lower point_id; a top-n report.
    """
    inside = points.where(F.col("lon").between(west, east) & F.col("lat").between(south, north) & (F.col("area") >= min_area))
    own = F.coalesce(F.col(unit).cast("string"), F.concat(F.lit("point "), F.col("point_id").cast("string")))
    w = Window.partitionBy(own).orderBy(F.desc("has_forecast"), F.desc("area"), "point_id")
    first = inside.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.orderBy(F.desc("area"), "point_id").limit(n)


# --- networks --------------------------------------------------------------------------------------------------


def write_units(units: DataFrame, path: str, unit: str) -> None:
    """Units in folders by the first digit and the first two digits of their id, for unit_lookup."""
    text = F.col(unit).cast("bigint").cast("string")
    split = units.withColumns({"pfaf1": F.substring(text, 1, 1).cast("int"), "pfaf2": F.substring(text, 1, 2).cast("int")})
    split.repartition("pfaf1", "pfaf2").write.mode("overwrite").partitionBy("pfaf1", "pfaf2").parquet(path)


def unit_lookup(ids: DataFrame, stored: DataFrame, unit: str) -> DataFrame:
    """Rows of stored units whose ids are asked for; only the folders of those ids are read.

    The prefixes of the ids meet the folders' columns, so the scan is pruned when it runs. Ids of fewer than two digits are an error.
    """
    number = F.col(unit).cast("bigint")
    known = F.when(number >= 10, number).otherwise(F.raise_error(F.concat(F.lit("no such unit: "), F.coalesce(number.cast("string"), F.lit("null")))).cast("bigint"))
    text = known.cast("string")
    asked = ids.select(known.cast(stored.schema[unit].dataType).alias(unit), F.substring(text, 1, 1).cast("int").alias("pfaf1"), F.substring(text, 1, 2).cast("int").alias("pfaf2")).distinct()
    return stored.join(F.broadcast(asked.where("pfaf2 >= 10")), ["pfaf1", "pfaf2", unit], "left_semi")  # ids of one request


def cross_network_match(clicks: DataFrame, networks: dict[str, DataFrame], order: list[str], near_km: float, far_km: float, near_ratio: float, far_ratio: float, weight: float) -> DataFrame:
    """(point_id, target_area, a struct for each network): a click's element of each network, snapped in turn.

    clicks: (point_id, lat, lon, target_area). The first network that finds a reach fixes the area that the next are held to, and its place
    is where they look. Structs (reach_id, area, km) are NULL where none fits; clicks without a positive area have no row.
    """
    at = clicks.where("target_area > 0").select("point_id", "lat", "lon", "target_area")
    found = []
    for i, name in enumerate(order):
        reaches = networks[name]
        snapped = snap_by_area(at, reaches, near_km, far_km, near_ratio, far_ratio, weight)
        own = reaches.select("reach_id", F.col("area").alias("_area"), ((F.col("lat1") + F.col("lat2")) / 2).alias("_lat"), ((F.col("lon1") + F.col("lon2")) / 2).alias("_lon"))
        one = snapped.where("reach_id IS NOT NULL").join(own, "reach_id")
        found.append(one.select("point_id", F.struct("reach_id", F.col("_area").alias("area"), "km").alias(name)))
        if i == 0:
            moved = at.join(one.select("point_id", "_area", "_lat", "_lon"), "point_id", "left")
            at = _kept(moved.select("point_id", F.coalesce("_lat", "lat").alias("lat"), F.coalesce("_lon", "lon").alias("lon"), F.coalesce("_area", "target_area").alias("target_area")))
    out = at.select("point_id", "target_area")
    for one in found:
        out = out.join(one, "point_id", "left")
    return out


def partition_outputs(df: DataFrame, path: str, basin: str, kind: str = "parquet", files: int = 1) -> None:
    """One folder for each sub-dataset, what precedes the first underscore of a basin's id, from `files` tasks each."""
    split = df.withColumn("subdataset", F.split_part(F.col(basin), F.lit("_"), F.lit(1)))
    spread = split.repartition("subdataset", F.pmod(F.xxhash64(basin), F.lit(files)))
    writer = spread.write.mode("overwrite").partitionBy("subdataset")
    writer.parquet(path) if kind == "parquet" else writer.option("header", True).csv(path)
