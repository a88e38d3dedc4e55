"""River networks and places: closures by pointer doubling, stems, snapping by grid buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.snapping import expanded, represented


def _kept(df: DataFrame) -> DataFrame:
    """Cuts the lineage of an iteration: checkpoint() to the shared folder where there is one."""
    sc = df.sparkSession.sparkContext
    return df.checkpoint() if sc.getCheckpointDir() else df


def upstream_closure(edges: DataFrame, node: str, down: str) -> DataFrame:
    """(start, member, hops): every node that drains to start, itself included, for all starts; all pairs by definition.

    Doubling: from all pairs up to 2^k hops apart come those up to 2^(k+1), until none is added. A path longer than
    the number of nodes is a cycle, which is an error.
    """
    base = edges.select(F.col(node).alias("member"), F.col(down).alias("start"))
    known = edges.select(F.col(node).alias("member"), F.col(node).alias("start"), F.lit(0).alias("hops"))
    reach = base.join(edges.select(F.col(node).alias("start")), "start", "left_semi").withColumn("hops", F.lit(1))
    pairs, nodes, step = known.unionByName(reach.select("member", "start", "hops")), edges.count(), 1
    while True:
        ahead = pairs.where(F.col("hops") == step).select(F.col("member").alias("mid"), F.col("start").alias("top"))
        more = _kept(pairs.where("hops > 0").join(ahead, F.col("start") == F.col("mid")).select("member", F.col("top").alias("start"), (F.col("hops") + step).alias("hops")))
        step *= 2
        if more.isEmpty():
            return pairs.select("start", "member", "hops")
        if step >= nodes and not more.where(F.col("hops") >= nodes).isEmpty():
            raise ValueError("the network has a cycle")
        pairs = pairs.unionByName(more)


def path_sums(nodes: DataFrame, node: str, down: str, sums: list[str]) -> DataFrame:
    """(start, sums, depth): for each node the sums over all that drain to it, itself included, and its longest path.

    Each round adds to a node the sums of those whose pointer it is, 2^k hops above it, and doubles the pointers:
    a row for each node in each of log2(depth) rounds. Pointers that outlast the number of nodes are a cycle.
    """
    state = nodes.select(F.col(node).alias("start"), F.col(down).alias("to"), *[F.col(c) for c in sums], F.lit(0).alias("depth"))
    state = _kept(state.join(nodes.select(F.col(node).alias("to"), F.lit(True).alias("_in")), "to", "left").withColumn("to", F.when(F.col("_in"), F.col("to"))).drop("_in"))
    total, hops = nodes.count(), 1
    while not state.where("to IS NOT NULL").isEmpty():
        if hops > total:
            raise ValueError("the network has a cycle")
        above = state.where("to IS NOT NULL").groupBy(F.col("to").alias("start")).agg(*[F.sum(c).alias(f"_{c}") for c in sums], F.max("depth").alias("_d"))
        ahead = state.select(F.col("start").alias("to"), F.col("to").alias("_to"))
        added = state.join(above, "start", "left").join(ahead, "to", "left")
        more = [F.when(F.col("_d").isNull(), F.col(c)).otherwise(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums]
        state = _kept(added.select("start", F.col("_to").alias("to"), *more, F.greatest("depth", F.col("_d") + hops).alias("depth")))
        hops *= 2
    return state.select("start", *sums, "depth")


def contributing(nodes: DataFrame, node: str, down: str, area: str) -> DataFrame:
    """(start, units, area, depth): what drains to each node, itself included, and its longest path."""
    own = nodes.select(F.col(node).alias("_node"), F.col(down).alias("_down"), F.lit(1).cast("bigint").alias("units"), F.col(area).alias("area"))
    return path_sums(own, "_node", "_down", ["units", "area"])


def path_ends(links: DataFrame, keys: list[str], node: str, to: str) -> DataFrame:
    """(keys, node, last, hops): where the path of each node ends, by pointers that double; links are within the same keys.

    A path ends at a node without a link, or whose link leads to no node. Nodes that have arrived take no part in later rounds. Paths
    that never end are cycles and have no row.
    """
    nodes = links.select(*keys, F.col(node).alias("node"), F.col(to).alias("to"))
    there = nodes.select(*keys, F.col("node").alias("to"), F.lit(True).alias("_in"))
    state = _kept(nodes.join(there, [*keys, "to"], "left").select(*keys, "node", F.when(F.col("_in"), F.col("to")).alias("to")))
    done = state.where("to IS NULL").select(*keys, "node", F.col("node").alias("last"), F.lit(0).cast("bigint").alias("hops"))
    live, total, step = state.where("to IS NOT NULL").withColumn("hops", F.lit(1).cast("bigint")), nodes.count(), 1
    while not live.isEmpty() and step <= 2 * total:
        arrived = done.select(*keys, F.col("node").alias("to"), F.col("last"), F.col("hops").alias("_more"), F.lit(None).cast(live.schema["to"].dataType).alias("_to"))
        ahead = live.select(*keys, F.col("node").alias("to"), F.lit(None).cast(live.schema["to"].dataType).alias("last"), F.col("hops").alias("_more"), F.col("to").alias("_to"))
        moved = _kept(live.join(arrived.unionByName(ahead), [*keys, "to"]).select(*keys, "node", F.col("_to").alias("to"), "last", (F.col("hops") + F.col("_more")).alias("hops")))
        done = done.unionByName(moved.where("to IS NULL").select(*keys, "node", "last", "hops"))
        live, step = moved.where("to IS NOT NULL").select(*keys, "node", "to", "hops"), step * 2
    return done


def walks(starts: DataFrame, links: DataFrame, node: str, to: str, steps: int) -> DataFrame:
    """(start, step, node): up to `steps` nodes that follow each start, in order. Doubling: what is known of a walk leads on by pointers of as many hops."""
    jump = links.where(F.col(to).isNotNull()).select(F.col(node).alias("node"), F.col(to).alias("to"))
    known = starts.select(F.col(node).alias("start"), F.lit(0).alias("step"), F.col(node).alias("node"))
    hops = 1
    while hops <= steps:
        more = known.where(F.col("step") + hops <= steps).join(jump, "node").select("start", (F.col("step") + hops).alias("step"), F.col("to").alias("node"))
        known = _kept(known.unionByName(more))
        jump = _kept(jump.select(F.col("node").alias("from"), F.col("to").alias("node")).join(jump, "node").select(F.col("from").alias("node"), "to"))
        hops *= 2
    return known.where("step > 0")


def main_stem_chain(starts: DataFrame, reaches: DataFrame, node: str, down: str, area: str, steps: int = 40) -> DataFrame:
    """(start, step, node): the main stem through each start: reaches below it are steps 1, 2, ..., those above it -1, -2, ...

    Down along the network, up to the tributary of the largest area (of a tie the lowest id), `steps` reaches each way
    at most; the start is step 0. A walk that comes back to a reach ends there.
    """
    there = reaches.select(F.col(node).alias(down))
    below = reaches.join(there, down, "left_semi").select(node, F.col(down).alias("_to"))
    above = main_stem(reaches.join(there, down, "left_semi"), node, down, area).select(F.col("node").alias(node), F.col("up").alias("_to"))
    asked = starts.select(F.col(node)).distinct().join(reaches.select(node), node, "left_semi")
    both = asked.select(F.col(node).alias("start"), F.lit(0).alias("step"), F.col(node).alias("node"))
    both = both.unionByName(walks(asked, below, node, "_to", steps)).unionByName(walks(asked, above, node, "_to", steps).withColumn("step", -F.col("step")))
    seen = both.withColumn("_n", F.row_number().over(Window.partitionBy("start", "node").orderBy(F.abs("step"), F.desc("step"))))
    side = F.signum("step")
    again = F.max(F.when(F.col("_n") > 1, 1).otherwise(0)).over(Window.partitionBy("start", side).orderBy(F.abs("step")).rowsBetween(Window.unboundedPreceding, 0))
    return seen.withColumn("_again", again).where("_again = 0").select("start", "step", "node")


def split_chains(reaches: DataFrame, node: str, down: str, keep: Column, include_end: bool = False) -> DataFrame:
    """(chain, position, node, own): the kept network cut at confluences into lines that run downstream.

    A line begins at a source or below a confluence, is named after its first node and ends before the next line
    begins; with include_end it also has that node, which isn't its own, and lines of one node go. Positions count from 0, by the
    lengths of paths back to the first node. Cycles without a confluence belong to no line.
    """
    kept = reaches.where(keep).select(F.col(node).alias("node"), F.col(down).alias("to"))
    linked = kept.join(kept.select(F.col("node").alias("to"), F.lit(True).alias("_in")), "to", "left").select("node", F.when(F.col("_in"), F.col("to")).alias("to"))
    into = linked.where("to IS NOT NULL").groupBy(F.col("to").alias("node")).agg(F.count(F.lit(1)).alias("ups"), F.min("node").alias("up"))
    back = linked.join(into, "node", "left").select("node", "to", F.when(F.col("ups") == 1, F.col("up")).alias("back"))
    back = _kept(back)
    placed = path_ends(back, [], "node", "back").select("node", F.col("last").alias("chain"), F.col("hops").alias("position"), F.lit(True).alias("own"))
    if not include_end:
        return placed.select("chain", "position", "node", "own")
    placed = _kept(placed)
    heads = back.where("back IS NULL").select(F.col("node").alias("to"))
    ends = back.join(heads, "to", "left_semi").join(placed, "node").select("chain", (F.col("position") + 1).alias("position"), F.col("to").alias("node"), F.lit(False).alias("own"))
    both = placed.select("chain", "position", "node", "own").unionByName(ends)
    return both.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("chain"))).where("_n > 1").drop("_n")


def pour_point_sums(fragments: DataFrame, key: str, node: str, down: str, overlap: str, area: str, values: list[str], least_overlap: float = 0.0) -> DataFrame:
    """(key, pour_point, units, values): sums over the units that drain straight to where a basin's main path leaves it.

    The path begins at the unit with the largest share of its area inside (of a tie the lowest id) and goes on while the next unit
    is at least half inside; all paths of all basins are followed at once by doubling pointers that stop there. Units
    count if they overlap by more than least_overlap or half of them does; where none counts, the first unit does.
    """
    share = F.coalesce(F.try_divide(F.col(overlap), F.when(F.col(area) > 0, F.col(area))), F.lit(0.0))
    own = fragments.select(key, F.col(node).alias("node"), F.col(down).alias("down"), F.col(overlap).alias("_o"), share.alias("_share"), *values)
    into = own.where(F.col("_share") >= 0.5).select(key, F.col("node").alias("down"), F.lit(True).alias("_goes"))
    links = own.join(into, [key, "down"], "left").select(key, "node", "down", F.when(F.col("_goes") & (F.col("down") != 0), F.col("down")).alias("to"))
    first = own.groupBy(key).agg(F.max_by("node", F.struct("_share", -F.col("node"))).alias("node"))
    ends = path_ends(links, [key], "node", "to").join(first, [key, "node"], "left_semi").select(key, F.col("node").alias("first"), F.col("last").alias("node"))
    leave = ends.join(own.select(key, "node", "down"), [key, "node"]).select(key, "first", F.col("down").alias("pour_point"))
    counted = own.where((F.col("_o") > least_overlap) | (F.col("_share") > 0.5)).select(key, F.col("down").alias("pour_point"), *values)
    sums = counted.groupBy(key, "pour_point").agg(F.count(F.lit(1)).alias("units"), *[F.sum(v).alias(v) for v in values])
    alone = own.select(key, F.col("node").alias("first"), *[F.col(v).alias(f"_{v}") for v in values])
    out = leave.join(sums, [key, "pour_point"], "left").join(alone, [key, "first"])
    return out.select(key, "pour_point", F.coalesce("units", F.lit(0)).alias("units"), *[F.when(F.col("units").isNull(), F.col(f"_{v}")).otherwise(F.col(v)).alias(v) for v in values])


def main_stem(edges: DataFrame, node: str, down: str, area: str) -> DataFrame:
    """For each node the upstream neighbour with the largest area, the lowest id of a tie."""
    return edges.where(F.col(down) != 0).groupBy(F.col(down).alias("node")).agg(F.max_by(node, F.struct(F.col(area), -F.col(node))).alias("up"), F.count(F.lit(1)).alias("tributaries"))


def chain_heads(edges: DataFrame, node: str, down: str) -> DataFrame:
    """Nodes where a line begins when the network is cut at confluences: sources and nodes below two or more."""
    degree = edges.groupBy(F.col(down).alias(node)).agg(F.count(F.lit(1)).alias("ups"))
    return edges.join(degree, node, "left").withColumn("ups", F.coalesce("ups", F.lit(0))).where("ups <> 1").select(node, "ups")


#: Code of a direction and its step in rows and columns.
D8 = {1: (0, 1), 2: (1, 1), 4: (1, 0), 8: (1, -1), 16: (0, -1), 32: (-1, -1), 64: (-1, 0), 128: (-1, 1)}


def d8_edges(cells: DataFrame) -> DataFrame:
    """(row, col, code) to edges between cells; a code that isn't a direction ends there."""
    row = F.coalesce(*[F.when(F.col("code") == c, F.lit(r)) for c, (r, _) in D8.items()])
    col = F.coalesce(*[F.when(F.col("code") == c, F.lit(k)) for c, (_, k) in D8.items()])
    return cells.select("row", "col", (F.col("row") + row).alias("down_row"), (F.col("col") + col).alias("down_col"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0088) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def nearest(points: DataFrame, gauges: DataFrame, radius_km: float, cell_degrees: float | None = None) -> DataFrame:
    """For each point the nearest gauge within the radius: (point_id, gauge_id, km); ties go to the lower id.

    Gauges go to their cell and the cells around it, so an equi-join finds candidates. A column's width shrinks
    with the cosine of the latitude, so near the poles a gauge goes to more columns; longitudes wrap. Unless given, cells
    are about as large as the radius. Points at one place are looked up once, and of gauges at one place only the lowest id counts.
    """
    reach = math.degrees(radius_km / 6371.0)
    n = int(round(360 / cell_degrees)) if cell_degrees else max(1, min(72_000, int(360 / max(reach, 1e-9))))
    cell_degrees = cell_degrees or 360 / n
    row = lambda c: F.floor((F.col(c) + 90) / cell_degrees).cast("int")
    col = lambda c: F.floor((F.col(c) + 180) / cell_degrees).cast("int")
    spread = F.ceil(reach / F.greatest(F.lit(1e-6), F.cos(F.radians(F.least(F.lit(90.0), F.abs("g_lat") + reach)))) / cell_degrees)
    columns = F.least(F.lit(n // 2), spread).cast("int")
    rows = math.ceil(reach / cell_degrees)
    own = gauges.groupBy("g_lat", "g_lon").agg(F.min("gauge_id").alias("gauge_id"))
    placed = own.withColumn("_r", F.explode(F.sequence(row("g_lat") - rows, row("g_lat") + rows))).withColumn("_c", F.explode(F.array_distinct(F.transform(F.sequence(col("g_lon") - columns, col("g_lon") + columns), lambda c: F.pmod(c, F.lit(n))))))
    asked = points.select("lat", "lon").distinct()
    found = asked.withColumn("_r", row("lat")).withColumn("_c", F.pmod(col("lon"), F.lit(n))).join(placed.hint("merge"), ["_r", "_c"])
    found = found.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("g_lat"), F.col("g_lon"))).where(F.col("km") <= radius_km)
    there = found.groupBy("lat", "lon").agg(F.min(F.struct(F.round("km", 9).alias("km"), F.col("gauge_id"))).alias("_b"))
    best = points.select("point_id", "lat", "lon").join(there.hint("merge"), ["lat", "lon"]).groupBy("point_id").agg(F.min("_b").alias("_b"))
    return best.select("point_id", F.col("_b.gauge_id").alias("gauge_id"), F.col("_b.km").alias("km"))


def row_spans(cells: DataFrame, key: str = "basin") -> DataFrame:
    """A catchment's cells as runs of columns in each row."""
    w = Window.partitionBy(key, "row").orderBy("col")
    runs = cells.select(key, "row", "col").distinct().withColumn("_g", F.col("col") - F.row_number().over(w))
    return runs.groupBy(key, "row", "_g").agg(F.min("col").alias("first"), F.max("col").alias("last")).drop("_g")


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Whether a point lies in a ring (array of struct lon, lat) by the number of edges that a ray to the east meets."""
    n = F.size(ring)

    def meets(i):
        a, b = F.element_at(ring, i + 1), F.element_at(ring, F.pmod(i + 1, n) + 1)
        at = a["lon"] + F.try_divide((lat - a["lat"]) * (b["lon"] - a["lon"]), b["lat"] - a["lat"])
        return F.when(((a["lat"] > lat) != (b["lat"] > lat)) & (lon < at), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + meets(i)) % 2 == 1


def locate_units(points: DataFrame, units: DataFrame, cell_degrees: float = 5.0) -> DataFrame:
    """(point_id, unit_id) of the units that hold each point: units go to the cells of their box, then an exact test.

    Rings may run past the antimeridian; columns and points wrap. Points at one place and units of one ring are met once and
    expanded to their ids in the end. No side is broadcast, as rows that go to several cells outgrow what their table lets expect.
    """
    (asked, p_members), (shapes, u_members) = represented(points, "point_id", ["lat", "lon"]), represented(units, "unit_id", ["ring"])
    n = int(round(360 / cell_degrees))
    at = lambda c, base: F.floor((c + base) / cell_degrees).cast("int")
    lat, lon = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lon"])
    columns = F.array_distinct(F.transform(F.sequence(at(F.array_min(lon), 180), at(F.array_max(lon), 180)), lambda c: F.pmod(c, F.lit(n))))
    placed = shapes.select(F.col("rep").alias("b_rep"), F.col("n").alias("b_n"), "ring").withColumn("_west", F.array_min(lon)).withColumn("_r", F.explode(F.sequence(at(F.array_min(lat), 90), at(F.array_max(lat), 90)))).withColumn("_c", F.explode(columns))
    asked = asked.select(F.col("rep").alias("a_rep"), F.col("n").alias("a_n"), "lat", "lon")
    found = asked.withColumn("_r", at(F.col("lat"), 90)).withColumn("_c", F.pmod(at(F.col("lon"), 180), F.lit(n))).join(placed.hint("merge"), ["_r", "_c"])
    east = F.when(F.col("lon") < F.col("_west"), F.col("lon") + 360).when(F.col("lon") - 360 >= F.col("_west"), F.col("lon") - 360).otherwise(F.col("lon"))
    inside = found.where(in_ring(F.col("lat"), east, F.col("ring"))).select("a_rep", "b_rep", "a_n", "b_n")
    return expanded(inside, p_members, u_members, "point_id", "unit_id")
