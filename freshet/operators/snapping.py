"""Points to reaches and boxes to boxes: equi-joins on grid cells, then exact scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _kept(df: DataFrame) -> DataFrame:
    """Computed once: checkpoint() to the shared folder where there is one."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def _east(lon: Column, lon0: Column) -> Column:
    """How far lon is east of lon0, from -180 up to 180 degrees."""
    return F.pmod(lon - lon0 + 540, F.lit(360.0)) - 180


def represented(df: DataFrame, key: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that agree in `by` are one: the distinct rows (rep, n, by) and the members (rep, key). n is their number, and rep names them by
    their lowest key, with a number in case that others have it too."""
    least = df.groupBy(*by).agg(F.min(key).alias("_least"), F.count(F.lit(1)).alias("n"))
    number = F.row_number().over(Window.partitionBy("_least").orderBy(*by))
    reps = least.select(F.struct("_least", number.alias("_number")).alias("rep"), "n", *by)
    return reps, df.select(key, *by).join(reps.select("rep", *by).hint("merge"), by).select("rep", key)


#: Rows of a task that makes rows for all members of pairs, and the most such tasks.
EXPANDED_ROWS, EXPANDED_TASKS = 2_000_000, 4_000


def expanded(pairs: DataFrame, a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """(a_id, b_id, others of pairs) for all members of pairs (a_rep, b_rep, a_n, b_n, others). Small tables make many rows here, so the
    tasks' number follows the result's rows; nothing is aggregated or shuffled after the last join."""
    pairs = _kept(pairs)
    parts = max(1, min(EXPANDED_TASKS, (pairs.agg(F.sum(F.col("a_n") * F.col("b_n"))).first()[0] or 0) // EXPANDED_ROWS))
    half = pairs.drop("a_n", "b_n").join(b.toDF("b_rep", b_id).hint("merge"), "b_rep").drop("b_rep")
    both = half.repartition(parts, "a_rep").join(a.toDF("a_rep", a_id).repartition(parts, "a_rep").hint("merge"), "a_rep")
    return both.select(a_id, b_id, *[c for c in pairs.columns if c not in ("a_rep", "b_rep", "a_n", "b_n")])


def segment_km(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance to a short segment; longitudes are shortened by the cosine of the point's latitude."""
    k = F.cos(F.radians(lat))
    dx, dy, px, py = _east(lon2, lon1) * k, lat2 - lat1, _east(lon, lon1) * k, lat - lat1
    f = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(px * dx + py * dy, dx * dx + dy * dy))), F.lit(0.0))
    return F.sqrt((px - f * dx) ** 2 + (py - f * dy) ** 2) * 111.195


def _candidates(points: DataFrame, reaches: DataFrame, degrees: float) -> DataFrame:
    """Pairs of points and reaches (lat1, lon1, lat2, lon2) that could be within `degrees` of latitude: cells of that size,
    a reach in all cells that its box, widened by the distance, meets. Columns wrap, and are more towards the poles."""
    n = max(1, int(360 / degrees))
    width = 360 / n
    row = lambda lat: F.floor((lat + 90) / degrees).cast("int")
    south, north = F.least("lat1", "lat2") - degrees, F.greatest("lat1", "lat2") + degrees
    shrink = F.greatest(F.lit(1e-6), F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(south), F.abs(north))))))
    half = F.abs(_east(F.col("lon2"), F.col("lon1"))) / 2 + degrees / shrink
    middle = F.col("lon1") + _east(F.col("lon2"), F.col("lon1")) / 2
    first = F.floor((middle + 180 - half) / width).cast("int")
    last = F.least(first + n - 1, F.floor((middle + 180 + half) / width).cast("int"))
    columns = F.array_distinct(F.transform(F.sequence(first, last), lambda c: F.pmod(c, F.lit(n))))
    placed = reaches.withColumn("_r", F.explode(F.sequence(row(south), row(north)))).withColumn("_c", F.explode(columns))
    at = F.pmod(F.floor((F.col("lon") + 180) / width).cast("int"), F.lit(n))
    return points.withColumn("_r", row(F.col("lat"))).withColumn("_c", at).join(placed.hint("merge"), ["_r", "_c"]).drop("_r", "_c")


def _distinct_reaches(reaches: DataFrame) -> DataFrame:
    """Of reaches of one course and area the one of the lowest id."""
    return reaches.groupBy("lat1", "lon1", "lat2", "lon2", "area").agg(F.min("reach_id").alias("reach_id"))


def snap_to_reach(points: DataFrame, reaches: DataFrame, max_km: float, weight: float) -> DataFrame:
    """For each point the reach with the least distance / (1 + weight log10(area)) within max_km; ties go to the lower id.

    Points at one place are looked up once, and reaches of one course and area are one.
    """
    asked, own = points.select("lat", "lon").distinct(), _distinct_reaches(reaches)
    found = _candidates(asked, own, max_km / 111.195).withColumn("km", segment_km(*[F.col(c) for c in ("lat", "lon", "lat1", "lon1", "lat2", "lon2")]))
    score = F.col("km") / (1 + F.log10(F.greatest(F.lit(1.0), F.col("area"))) * weight)
    least = F.min(F.struct(F.round(score, 9).alias("score"), F.col("reach_id"), F.col("km")))
    there = found.where(F.col("km") <= max_km).groupBy("lat", "lon").agg(least.alias("_b"))
    best = points.select("point_id", "lat", "lon").join(there.hint("merge"), ["lat", "lon"]).groupBy("point_id").agg(F.min("_b").alias("_b"))
    return best.select("point_id", "_b.reach_id", "_b.km")


def snap_by_area(points: DataFrame, reaches: DataFrame, near_km: float, far_km: float, near_ratio: float, far_ratio: float, weight: float) -> DataFrame:
    """As snap_to_reach from near_km, and from far_km where that finds none; reaches whose area differs by more than the tier's ratio are refused.

    Points carry target_area; a NULL one accepts any area. Each place has one list of the reaches around it, in order of tier, score and id,
    and each point there takes the first that fits its area, so that no row of a point and a reach is made.
    """
    asked, own = points.select("lat", "lon").distinct(), _distinct_reaches(reaches)
    found = _candidates(asked, own, max(near_km, far_km) / 111.195).withColumn("km", segment_km(*[F.col(c) for c in ("lat", "lon", "lat1", "lon1", "lat2", "lon2")]))
    tier = F.when(F.col("km") <= near_km, 0).when(F.col("km") <= far_km, 1)
    score = F.round(F.col("km") / (1 + F.log10(F.greatest(F.lit(1.0), F.col("area"))) * weight), 9)
    found = found.withColumn("tier", tier).where("tier IS NOT NULL")
    around = found.groupBy("lat", "lon").agg(F.array_sort(F.collect_list(F.struct("tier", score.alias("score"), "reach_id", "km", "area"))).alias("_around"))

    def fits(x: Column) -> Column:
        off = F.greatest(F.try_divide(x["area"], F.col("target_area")), F.try_divide(F.col("target_area"), x["area"]))
        return F.coalesce(off <= F.when(x["tier"] == 0, near_ratio).otherwise(far_ratio), F.col("target_area").isNull())

    first = points.join(around.hint("merge"), ["lat", "lon"], "left").select("point_id", F.get(F.filter("_around", fits), F.lit(0)).alias("_b"))
    return first.select("point_id", "_b.reach_id", "_b.km", "_b.tier")


#: Fixed values of the lookup: degrees, bounds of the ratio of areas and of the scale, and what the regression gives for the first flow
#: (factor and power) and the later ones relative to it.
LOOKUP_DEGREES, AREA_RATIO, SCALE, REGRESSION, LATER = 0.45, (0.33, 3.0), (0.4, 2.5), (0.365, 0.75), (1.66, 2.50)


def threshold_lookup(points: DataFrame, reaches: DataFrame, thresholds: list[str]) -> DataFrame:
    """(point_id, reach_id, thresholds): a point's flows of rising periods from the reach that fits it best, scaled by area.

    Reaches within LOOKUP_DEGREES, longitudes shortened by the cosine of the point's latitude, that have a first flow and an area within
    AREA_RATIO of the point's; the least of |ln ratio| + 2 degrees, of a tie the lowest id. A point's area is 50 at least, 500 if
    unknown, a reach's 10. Without such a reach the flows follow the regression on the area.
    """
    area = F.greatest(F.when(F.col("target_area") != 0, F.col("target_area")).otherwise(500.0), F.lit(50.0))
    area = F.when(F.col("target_area").isNull(), 500.0).otherwise(area)
    known = points.withColumn("_area", area)
    own = reaches.select("reach_id", F.greatest("area", F.lit(10.0)).alias("_own"), *thresholds, F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    found = _candidates(known, own.where(F.col(thresholds[0]) > 0), LOOKUP_DEGREES)
    away = F.sqrt((F.col("lat") - F.col("lat1")) ** 2 + (_east(F.col("lon1"), F.col("lon")) * F.cos(F.radians("lat"))) ** 2)
    found = found.withColumn("_d", away).where((F.col("_d") <= LOOKUP_DEGREES) & F.col("_own").between(F.col("_area") * AREA_RATIO[0], F.col("_area") * AREA_RATIO[1]))
    scale = F.least(F.lit(SCALE[1]), F.greatest(F.lit(SCALE[0]), (F.col("_area") / F.col("_own")) ** REGRESSION[1]))
    score = F.round(F.abs(F.log(F.col("_own") / F.col("_area"))) + 2 * F.col("_d"), 9)
    best = found.groupBy("point_id").agg(F.min(F.struct(score.alias("score"), "reach_id", *[(F.col(t) * scale).alias(t) for t in thresholds])).alias("_b"))
    plain = REGRESSION[0] * F.col("_area") ** REGRESSION[1]
    out = known.join(best, "point_id", "left")
    return out.select("point_id", F.col("_b.reach_id").alias("reach_id"), *[F.coalesce(f"_b.{t}", f * plain).alias(t) for t, f in zip(thresholds, (1.0, *LATER))])


def overlap_boxes(a: DataFrame, b: DataFrame, degrees: float, least: float = 0.0, values: dict[str, Column] | None = None) -> DataFrame:
    """(a_id, b_id, overlap): pairs of boxes (id, south, west, north, east; no box crosses the antimeridian) that share an area in square degrees.

    Boxes are placed in the grid cells that they meet; a pair counts in the cell that holds the south-west corner of what it shares.
    Boxes of equal sides are met once and expanded to their ids in the end. Overlaps up to `least` don't count. `values` are computed from
    overlap, a_area and b_area for such pairs, and returned in place of these three.
    """
    cell = lambda c: F.floor(c / degrees).cast("int")

    sides = ["south", "west", "north", "east"]
    (a_reps, a_members), (b_reps, b_members) = represented(a, "id", sides), represented(b, "id", sides)

    def placed(df: DataFrame, p: str) -> DataFrame:
        own = df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("rep", "n", *sides)])
        own = own.withColumn("_r", F.explode(F.sequence(cell(F.col(f"{p}_south")), cell(F.col(f"{p}_north")))))
        return own.withColumn("_c", F.explode(F.sequence(cell(F.col(f"{p}_west")), cell(F.col(f"{p}_east")))))

    both = placed(a_reps, "a").join(placed(b_reps, "b").hint("merge"), ["_r", "_c"])
    south, west = F.greatest("a_south", "b_south"), F.greatest("a_west", "b_west")
    height, width = F.least("a_north", "b_north") - south, F.least("a_east", "b_east") - west
    both = both.where((height > 0) & (width > 0) & (F.col("_r") == cell(south)) & (F.col("_c") == cell(west)))
    area = lambda p: (F.col(f"{p}_north") - F.col(f"{p}_south")) * (F.col(f"{p}_east") - F.col(f"{p}_west"))
    pairs = both.select("a_rep", "b_rep", "a_n", "b_n", (height * width).alias("overlap"), area("a").alias("a_area"), area("b").alias("b_area"))
    if least > 0:
        pairs = pairs.where(F.col("overlap") > least)
    if values:
        pairs = pairs.select("a_rep", "b_rep", "a_n", "b_n", *[v.alias(k) for k, v in values.items()])
    return expanded(pairs, a_members, b_members, "a_id", "b_id")


def iou_dice(overlap: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Intersection over union, Dice, and the error of b's area in percent of a's."""
    return F.try_divide(overlap, a + b - overlap), F.try_divide(2 * overlap, a + b), F.try_divide(100 * (b - a), a)


def domain_coverage(south: Column, west: Column, north: Column, east: Column, box: tuple[float, float, float, float]) -> Column:
    """The share of a box that lies inside the grid's (south, west, north, east)."""
    height = F.greatest(F.lit(0.0), F.least(north, F.lit(box[2])) - F.greatest(south, F.lit(box[0])))
    width = F.greatest(F.lit(0.0), F.least(east, F.lit(box[3])) - F.greatest(west, F.lit(box[1])))
    return F.try_divide(height * width, (north - south) * (east - west))


def max_rank(lines: DataFrame, ranks: DataFrame, key: str, cells: list[str], every: bool = False) -> DataFrame:
    """The highest rank of the grid cells of a line's vertices (array of structs of cell indices); 0 where none has one.

    Unless `every` vertex is to count, five count of lines of five vertices and more: the first, those at the quarters, and the last.
    """
    n = F.size("vertices")
    at = F.array(F.lit(0), F.floor(n / 4), F.floor(n / 2), F.floor(n * 3 / 4), F.lit(0) + n - 1)
    some = F.col("vertices") if every else F.when(n < 5, F.col("vertices")).otherwise(F.transform(at, lambda i: F.get("vertices", i.cast("int"))))
    each = lines.select(key, F.explode_outer(some).alias("_v")).select(key, *[F.col("_v")[c].alias(c) for c in cells])
    return each.join(ranks, cells, "left").groupBy(key).agg(F.coalesce(F.max("rank"), F.lit(0)).alias("rank"))


def query_reaches(df: DataFrame, west: float, south: float, east: float, north: float, min_order: int, min_area: float) -> DataFrame:
    """Reaches in a box, which may cross the antimeridian, of an order and area at least; of an id in several rows the one of the largest area."""
    lon = F.col("lon").between(west, east) if west <= east else (F.col("lon") >= west) | (F.col("lon") <= east)
    kept = df.where(lon & F.col("lat").between(south, north) & (F.col("order") >= min_order) & (F.col("area") >= min_area))
    rest = [c for c in df.columns if c != "reach_id"]
    best = kept.groupBy("reach_id").agg(F.max(F.struct(F.col("area").alias("_a"), F.struct(*rest).alias("_r"))).alias("_b"))
    return best.select("reach_id", "_b._r.*").select(*df.columns)
