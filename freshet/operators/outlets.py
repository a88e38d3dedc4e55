"""Flow-direction rasters: accumulation by tiles and doubling between them, outlets of gauges on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.operators.network import D8, _kept, path_sums
from freshet.operators.snapping import snap_to_reach

#: Cells of a tile's side; a tile is what one task holds.
TILE = 512
#: An outlet is rated by the cells within so many hops above it, up to so many, less a penalty for each cell of distance.
NEAR_HOPS, NEAR_CELLS, PENALTY = 100, 5000, 2.0
KM_PER_DEGREE = 111.32


def cell_area(row: Column, lat_top: float, degrees: float) -> Column:
    """Area in square km of a cell of a row below lat_top."""
    lat = F.lit(lat_top) - row * degrees
    return F.lit((degrees * KM_PER_DEGREE) ** 2) * F.greatest(F.lit(0.05), F.cos(F.radians(lat)))


# --- inside a tile ---------------------------------------------------------------------------------------------


class _Tile:
    """Cells of one tile with the index of the cell below each, or else the place outside to which it flows."""

    def __init__(self, row: np.ndarray, col: np.ndarray, code: np.ndarray, side: int):
        self.row, self.col, self.n = row, col, len(row)
        self.top, self.left = row.min() // side * side if len(row) else 0, col.min() // side * side if len(col) else 0
        grid = np.full((side, side), -1, np.int64)
        grid[row - self.top, col - self.left] = np.arange(self.n)
        self.grid = grid
        step = np.zeros((256, 2), np.int64)
        for k, at in D8.items():
            step[k] = at
        flows = np.isin(code, list(D8))
        kind = np.where(flows, code, 0).astype(np.int64)
        self.to_row, self.to_col = row + step[kind, 0], col + step[kind, 1]
        inside = (self.to_row >= self.top) & (self.to_row < self.top + side) & (self.to_col >= self.left) & (self.to_col < self.left + side)
        self.down = np.full(self.n, -1, np.int64)
        at = np.flatnonzero(flows & inside)
        self.down[at] = grid[self.to_row[at] - self.top, self.to_col[at] - self.left]
        self.leaves = flows & ~inside
        r, c = row - self.top, col - self.left
        self.edge = (r == 0) | (c == 0) | (r == side - 1) | (c == side - 1)

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Sums over all cells above, by doubling pointers."""
        total, to = values.astype(np.float64).copy(), self.down.copy()
        for _ in range(self.n.bit_length() + 1):
            at = np.flatnonzero(to >= 0)
            if not len(at):
                return total
            total = total + np.bincount(to[at], total[at], self.n)
            ahead = np.full(self.n, -1, np.int64)
            ahead[at] = to[to[at]]
            to = ahead
        raise ValueError("the flow directions have a cycle")

    def ends(self) -> np.ndarray:
        """Where each cell's path in the tile ends."""
        to = np.where(self.down < 0, np.arange(self.n), self.down)
        for _ in range(self.n.bit_length() + 1):
            to = to[to]
        return to

    def within(self, hops: int) -> np.ndarray:
        """Cells at most `hops` above each cell, itself included, from the binary digits of the number of levels."""
        levels, count, to = hops + 1, np.ones(self.n), self.down.copy()
        total, at = np.zeros(self.n), np.arange(self.n)
        while levels:
            own = np.flatnonzero(at >= 0)
            if levels & 1:
                total = total + np.bincount(at[own], count[own], self.n)
                at = np.where(at >= 0, to[at], -1)
            live = np.flatnonzero(to >= 0)
            count = count + np.bincount(to[live], count[live], self.n)
            to = np.where(to >= 0, to[to], -1)
            levels >>= 1
        return total


def _tile_of(pdf: pd.DataFrame, side: int) -> tuple[_Tile, pd.DataFrame]:
    own = pdf[pdf["code"].notna()].drop_duplicates(["row", "col"])
    return _Tile(own["row"].to_numpy(), own["col"].to_numpy(), own["code"].to_numpy().astype(np.int64), side), own


def accumulation(cells: DataFrame, side: int = TILE) -> DataFrame:
    """(row, col, code, area, cells, upstream_area, near): what drains to each cell (row, col, code, area) of a raster.

    Each tile is summed by the task that holds it. Between tiles only cells on their edges count: what leaves a tile
    enters the next, and follows it to its exit; those entries are a small network whose sums come from doubling. A
    second pass adds what enters to the paths inside. near counts the cells within NEAR_HOPS above, of the same tile, as outlets
    are rated by. Codes that are no direction end there, and so do directions to a place without a cell.
    """
    tiled = cells.select(F.col("row").cast("bigint"), F.col("col").cast("bigint"), F.coalesce("code", F.lit(0)).cast("int").alias("code"), F.coalesce("area", F.lit(0.0)).cast("double").alias("area"))
    tiled = tiled.withColumn("_tr", F.floor(F.col("row") / side)).withColumn("_tc", F.floor(F.col("col") / side))

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        tile, own = _tile_of(pdf, side)
        out = np.flatnonzero(tile.leaves)
        cells_, area = tile.summed(np.ones(tile.n)), tile.summed(own["area"].to_numpy())
        end = tile.ends()
        edge = np.flatnonzero(tile.edge)
        last = end[edge]
        goes = tile.leaves[last]
        flows = pd.DataFrame({"kind": 0, "row": tile.to_row[out], "col": tile.to_col[out], "to_row": None, "to_col": None, "cells": cells_[out], "area": area[out]})
        links = pd.DataFrame({"kind": 1, "row": tile.row[edge], "col": tile.col[edge], "to_row": pd.array(np.where(goes, tile.to_row[last], 0), "Int64"), "to_col": pd.array(np.where(goes, tile.to_col[last], 0), "Int64"), "cells": 0.0, "area": 0.0})
        links.loc[~goes, ["to_row", "to_col"]] = pd.NA
        return pd.concat([flows.astype({"to_row": "Int64", "to_col": "Int64"}), links], ignore_index=True)

    schema = "kind int, row bigint, col bigint, to_row bigint, to_col bigint, cells double, area double"
    edges = _kept(tiled.groupBy("_tr", "_tc").applyInPandas(leave, schema))
    place = lambda r, c: F.when(F.col(r).isNotNull(), F.struct(F.col(r).alias("row"), F.col(c).alias("col")))
    entering = edges.where("kind = 0").groupBy("row", "col").agg(F.sum("cells").alias("cells"), F.sum("area").alias("area"))
    nodes = edges.where("kind = 1").select("row", "col", place("to_row", "to_col").alias("to")).join(entering, ["row", "col"]).select(place("row", "col").alias("node"), "to", "cells", "area")
    inflow = path_sums(nodes, "node", "to", ["cells", "area"]).select("start.row", "start.col", F.lit(None).cast("int").alias("code"), "cells", "area")
    both = tiled.withColumn("cells", F.lit(0.0)).unionByName(inflow.withColumn("_tr", F.floor(F.col("row") / side)).withColumn("_tc", F.floor(F.col("col") / side)))

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        tile, own = _tile_of(pdf, side)
        more = pdf[pdf["code"].isna()]
        at = tile.grid[more["row"].to_numpy() - tile.top, more["col"].to_numpy() - tile.left]
        cells_, area = np.ones(tile.n), own["area"].to_numpy().copy()
        np.add.at(cells_, at, more["cells"].to_numpy())
        np.add.at(area, at, more["area"].to_numpy())
        return pd.DataFrame({"row": tile.row, "col": tile.col, "code": own["code"].to_numpy().astype(np.int32), "area": own["area"].to_numpy(), "cells": tile.summed(cells_).astype(np.int64), "upstream_area": tile.summed(area), "near": tile.within(NEAR_HOPS).astype(np.int64)})

    return both.groupBy("_tr", "_tc").applyInPandas(enter, "row bigint, col bigint, code int, area double, cells bigint, upstream_area double, near bigint")


# --- outlets ---------------------------------------------------------------------------------------------------


def _window(points: DataFrame, raster: DataFrame, reach: int, side: int | None = None) -> DataFrame:
    """Points (point_id, row, col, ...) with each cell at most `reach` rows and columns away: blocks of that size meet, then the exact test.

    With side, cells of another tile than the point's aren't considered.
    """
    size = 2 * reach + 1
    block = lambda c: F.floor(c / size).cast("bigint")
    near = lambda c: F.sequence(block(F.col(c) - reach), block(F.col(c) + reach))
    asked = points.withColumnsRenamed({"row": "_row", "col": "_col"}).withColumn("_br", F.explode(near("_row"))).withColumn("_bc", F.explode(near("_col")))
    found = asked.join(raster.withColumn("_br", block(F.col("row"))).withColumn("_bc", block(F.col("col"))), ["_br", "_bc"])
    found = found.withColumn("_dr", F.col("row") - F.col("_row")).withColumn("_dc", F.col("col") - F.col("_col")).where((F.abs("_dr") <= reach) & (F.abs("_dc") <= reach))
    if side is not None:
        found = found.where((F.floor(F.col("row") / side) == F.floor(F.col("_row") / side)) & (F.floor(F.col("col") / side) == F.floor(F.col("_col") / side)))
    return found.withColumn("distance", F.hypot(F.col("_dr").cast("double"), F.col("_dc").cast("double"))).drop("_br", "_bc")


def snap_outlets(points: DataFrame, raster: DataFrame, reach: int = 12, side: int = TILE) -> DataFrame:
    """(point_id, row, col, cells, upstream_area, distance): the best-rated cell around each point (point_id, row, col) in its tile.

    Rated by its near cells, NEAR_CELLS at most, less PENALTY for each cell of distance; the first by row and column of a tie. Points without
    a cell around them have no row.
    """
    found = _window(points, raster, reach, side)
    score = F.round(F.least(F.col("near"), F.lit(NEAR_CELLS)) - PENALTY * F.col("distance"), 9)
    best = found.groupBy("point_id").agg(F.max(F.struct(score.alias("score"), (-F.col("_dr")).alias("r"), (-F.col("_dc")).alias("c"), "row", "col", "cells", "upstream_area", "distance")).alias("b"))
    return best.select("point_id", *[F.col(f"b.{c}").alias(c) for c in ("row", "col", "cells", "upstream_area", "distance")])


def area_guided_outlets(points: DataFrame, raster: DataFrame, tolerance: float = 0.5, reach: int = 12, search: int = 60, side: int = TILE) -> DataFrame:
    """(point_id, status, row, col, cells, upstream_area, distance, closest_area) of each point (point_id, row, col, expected_area).

    The snapped outlet if nothing is expected (`snapped`) or its area fits (`fits`); else the nearest cell with a direction within
    `search` whose area fits (`found`, the first by row and column of a tie); else `mismatch`, with the closest area
    seen and no outlet. `bad_hint`: the expected area isn't positive; `no_cell`: there is no cell around the point. No
    input is dropped. Areas come from the accumulation table, so no basin is walked.
    """
    hint = F.col("expected_area")
    low, high = hint * max(0.05, 1 - tolerance), hint * (1 + tolerance)
    fits = F.col("upstream_area").between(low, high)
    snapped = snap_outlets(points, raster, reach, side)
    first = points.select("point_id", "expected_area").join(snapped, "point_id", "left")
    good = hint.isNull() | (F.coalesce(hint > 0, F.lit(False)) & ~F.isnan(hint) & (hint < float("inf")))
    status = F.when(~good, "bad_hint").when(F.col("row").isNull(), "no_cell").when(hint.isNull(), "snapped").when(fits, "fits")
    first = _kept(first.withColumn("status", status))
    open_ = points.join(first.where("status IS NULL").select("point_id"), "point_id", "left_semi")
    around = _window(open_, raster.where(F.col("code").isin(*D8)), max(search, reach), side)
    nearest = F.min(F.when(fits, F.struct(F.round("distance", 9).alias("d"), "_dr", "_dc", "row", "col", "cells", "upstream_area", "distance"))).alias("b")
    closest = F.min_by("upstream_area", F.struct(F.round(F.abs(F.col("upstream_area") - hint), 9), "upstream_area")).alias("closest_area")
    second = around.groupBy("point_id").agg(nearest, closest)
    names = ["row", "col", "cells", "upstream_area", "distance"]
    settled = first.where("status IS NOT NULL")
    kept = F.col("status").isin("snapped", "fits")
    settled = settled.select("point_id", "status", *[F.when(kept, F.col(c)).alias(c) for c in names], F.when(kept, F.col("upstream_area")).alias("closest_area"))
    rest = first.where("status IS NULL").select("point_id").join(second, "point_id", "left")
    rest = rest.select("point_id", F.when(F.col("b").isNotNull(), "found").otherwise("mismatch").alias("status"), *[F.col(f"b.{c}").alias(c) for c in names], F.coalesce("b.upstream_area", "closest_area").alias("closest_area"))
    return settled.unionByName(rest)


def _projected(points: DataFrame, snapped: DataFrame, reaches: DataFrame) -> DataFrame:
    """Points with the nearest place on their reach and its area; where there is none, their own place."""
    own = reaches.select("reach_id", "lat1", "lon1", "lat2", "lon2", F.col("area").alias("reach_area"))
    both = points.join(snapped.select("point_id", "reach_id"), "point_id", "left").join(own, "reach_id", "left")
    k = F.cos(F.radians("lat"))
    dx, dy, px, py = (F.col("lon2") - F.col("lon1")) * k, F.col("lat2") - F.col("lat1"), (F.col("lon") - F.col("lon1")) * k, F.col("lat") - F.col("lat1")
    f = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(px * dx + py * dy, dx * dx + dy * dy))), F.lit(0.0))
    at = lambda a, b, c: F.coalesce(F.col(a) + f * (F.col(b) - F.col(a)), F.col(c))
    return both.select("point_id", "reach_id", "reach_area", at("lat1", "lat2", "lat").alias("lat"), at("lon1", "lon2", "lon").alias("lon"))


def hybrid_outlets(points: DataFrame, reaches: DataFrame, raster: DataFrame, lat_top: float, lon_left: float, degrees: float, max_km: float = 0.25, weight: float = 0.0,
                   coarse: int = 4, fine: int = 12, ratio: float = 0.25, hints: tuple[float, float] = (10.0, 25000.0), tolerance: float = 0.55, search: int = 60, side: int = TILE) -> DataFrame:
    """area_guided_outlets' columns with reach_id: outlets of points (point_id, lat, lon) by reaches first, then the raster.

    A point moves to its nearest reach within max_km, if any, and is snapped in a coarse window. If the outlet's area
    stays below `ratio` of the reach's, the window probably hit a side channel, and reaches of an area within `hints`
    guide a second search in a fine window; both searches run over all points of their kind at once.
    """
    snapped = snap_to_reach(points, reaches, max_km, weight)
    moved = _projected(points, snapped, reaches)
    moved = _kept(moved.withColumn("row", F.round((lat_top - F.col("lat")) / degrees).cast("bigint")).withColumn("col", F.round((F.col("lon") - lon_left) / degrees).cast("bigint")))
    first = _kept(area_guided_outlets(moved.select("point_id", "row", "col", F.lit(None).cast("double").alias("expected_area")), raster, tolerance, coarse, coarse, side))
    hint = F.col("reach_area")
    again = moved.join(first.select("point_id", "upstream_area"), "point_id").where(hint.between(*hints) & (F.coalesce("upstream_area", F.lit(0.0)) < ratio * hint))
    second = area_guided_outlets(again.select("point_id", "row", "col", hint.alias("expected_area")), raster, tolerance, fine, search, side)
    both = first.join(again.select("point_id"), "point_id", "left_anti").unionByName(second)
    return both.join(moved.select("point_id", "reach_id"), "point_id")
