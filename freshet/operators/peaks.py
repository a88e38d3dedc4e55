"""Peaks of series and the skill metrics about them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Middles of the runs of equal values that both neighbours are below; runs at the ends don't count."""
    if len(x) < 3:
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(x) != 0) + 1])
    last = np.concatenate([first[1:] - 1, [len(x) - 1]])
    level = x[first]
    top = np.zeros(len(first), bool)
    top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    return (first[top] + last[top]) // 2


def spaced(x: np.ndarray, peaks: np.ndarray, distance: int) -> np.ndarray:
    """Peaks that no higher kept one is nearer than `distance` to; of equal ones the later counts as higher."""
    keep = np.ones(len(peaks), bool)
    for i in np.lexsort((peaks, x[peaks]))[::-1]:
        if keep[i]:
            near = np.abs(peaks - peaks[i]) < distance
            near[i] = False
            keep[near] = False
    return peaks[keep]


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Each peak's height above the higher of the two lowest points between it and higher ground or the ends."""
    out = np.zeros(len(peaks))
    for k, p in enumerate(peaks):
        left, right = np.flatnonzero(x[:p] > x[p]), np.flatnonzero(x[p + 1 :] > x[p])
        a = left[-1] + 1 if len(left) else 0
        b = p + right[0] + 1 if len(right) else len(x)
        out[k] = x[p] - max(x[a : p + 1].min(), x[p:b].min())
    return out


def find_peaks(x: np.ndarray, distance: int = 1, height: float | None = None, prominence: float | None = None) -> np.ndarray:
    peaks = local_maxima(x)
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    peaks = spaced(x, peaks, distance)
    return peaks if prominence is None else peaks[prominences(x, peaks) >= prominence]


def peak_metrics(df: DataFrame, key: str, t: str, obs: str = "obs", sim: str = "sim", timing_window: int = 3, missed_window: int = 1, percentile: float = 80) -> DataFrame:
    """Per series: mean days between observed and simulated peaks, share of missed peaks, mean percentage error at peaks.

    Rows without both values are left out first; a peak whose window isn't whole days on end doesn't count. Finding
    peaks needs a whole series of days in a task; series are in parallel.
    """
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[obs, sim]).sort_values(t)
        if pdf.empty:
            return pd.DataFrame({key: [], "peak_timing": [], "missed_peaks": [], "peak_mape": []})
        day = pd.to_datetime(pdf[t]).to_numpy().astype("datetime64[D]").astype(np.int64)
        o, s = pdf[obs].to_numpy(float), pdf[sim].to_numpy(float)

        def whole(i: int, w: int) -> bool:
            return i - w >= 0 and i + w < len(o) and day[i + w] - day[i - w] == 2 * w

        prominent = find_peaks(o, 100, prominence=float(np.std(o)))
        delays = []
        for i in prominent:
            if whole(i, timing_window):
                at_peak = s[i] > s[i - 1] and s[i] > s[i + 1]
                delays.append(0 if at_peak else abs(int(np.argmax(s[i - timing_window : i + timing_window + 1])) - timing_window))
        high = find_peaks(o, 30, height=float(np.percentile(o, percentile)))
        seen = find_peaks(s, 30, height=float(np.percentile(s, percentile)))
        counted = [i for i in high if whole(i, missed_window)]
        missed = [not (np.abs(seen - i) <= missed_window).any() for i in counted]
        row = {
            key: [pdf[key].iloc[0]],
            "peak_timing": [float(np.mean(delays)) if delays else None],
            "missed_peaks": [0.0 if not len(high) else float(np.mean(missed)) if missed else None],
            "peak_mape": [float(np.mean(np.abs((s[prominent] - o[prominent]) / o[prominent])) * 100) if len(prominent) else None],
        }
        return pd.DataFrame({c: pd.Series(v, dtype=None if c == key else "float64") for c, v in row.items()})

    return df.select(key, t, obs, sim).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, peak_timing double, missed_peaks double, peak_mape double")


def clipped_area(ring: list[tuple[float, float]], west: float, south: float, east: float, north: float) -> float:
    """Area of a ring inside a rectangle: clip by each side in turn, then the shoelace formula."""
    points = list(ring)
    for axis, limit, sign in ((0, west, 1), (0, east, -1), (1, south, 1), (1, north, -1)):
        out: list[tuple[float, float]] = []
        for a, b in zip(points, points[1:] + points[:1]):
            ina, inb = sign * (a[axis] - limit) >= 0, sign * (b[axis] - limit) >= 0
            if ina:
                out.append(a)
            if ina != inb:
                f = (limit - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + f * (b[0] - a[0]), a[1] + f * (b[1] - a[1])))
        points = out
        if not points:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))) / 2


def _half(points: np.ndarray, axis: int, limit: float, above: bool) -> np.ndarray:
    """The part of a polygon on one side of an axis-parallel line: its vertices there, and where its edges cross the line."""
    if not len(points):
        return points
    after = np.roll(points, -1, axis=0)
    side = points[:, axis] >= limit if above else points[:, axis] <= limit
    crosses = side != np.roll(side, -1)
    run = np.where(crosses, after[:, axis] - points[:, axis], 1.0)
    both = np.empty((2 * len(points), 2))
    both[0::2], both[1::2] = points, points + ((limit - points[:, axis]) / run)[:, None] * (after - points)
    return both[np.column_stack([side, crosses]).ravel()]


def ring_cells(points: np.ndarray, degrees: float) -> list[tuple[int, int, float]]:
    """(lat_idx, lon_idx, area times the cosine of the row's latitude) of the cells that a ring of (lon, lat) meets: cut into rows once, rows into cells."""
    out = []
    at = lambda v, base: int(math.floor((v + base) / degrees))
    for i in range(at(points[:, 1].min(), 90), at(points[:, 1].max(), 90) + 1):
        south = i * degrees - 90
        row = _half(_half(points, 1, south, True), 1, south + degrees, False)
        if len(row) < 3:
            continue
        shrink = math.cos(math.radians(south + degrees / 2))
        for j in range(at(row[:, 0].min(), 180), at(row[:, 0].max(), 180) + 1):
            west = j * degrees - 180
            x, y = _half(_half(row, 0, west, True), 0, west + degrees, False).T
            area = abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2
            if area > 0:
                out.append((i, j, area * shrink))
    return out


#: Bytes of vertices and cells of rings that a task remembers.
KNOWN_BYTES = 64_000_000


def cell_weights(rings: DataFrame, degrees: float) -> DataFrame:
    """(basin, lat_idx, lon_idx, weight): overlap of each basin with grid cells times cos(latitude), shares of a basin.

    rings: (basin, is_hole, pts array of (lon, lat)). Rings are dealt to all tasks, as tables may come in few parts, and cut into their cells
    there; a task cuts equal rings once, and no join looks at all cells. Holes subtract. A basin that covers nothing measurable is
    its centre's cell. Rings may run past the antimeridian; columns wrap.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    lon, lat = F.transform("pts", lambda p: p["lon"]), F.transform("pts", lambda p: p["lat"])
    at = lambda c, base: F.floor((c + base) / degrees).cast("int")
    kinds = dict(rings.dtypes)

    def cut(batches):
        known, held = {}, 0  # cells of rings by their vertices
        for batch in batches:
            pts = batch.column("pts")
            ends, flat = pts.offsets.to_numpy() - pts.offsets[0].as_py(), pts.flatten()
            vertices = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat")]).astype(float)
            rows, cells = [], []
            for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                own = vertices[a:b]
                name = own.tobytes()
                found = known.get(name)
                if found is None:
                    found = np.array(ring_cells(own, degrees) if b > a else [], float).reshape(-1, 3)
                    held += len(name) + found.nbytes
                    if held > KNOWN_BYTES:
                        known, held = {}, len(name) + found.nbytes
                    known[name] = found
                rows.append(np.full(len(found), k))
                cells.append(found)
            if not rows:
                continue
            at, all_ = np.concatenate(rows).astype(np.int64), np.concatenate(cells)
            hole = batch.column("is_hole").to_numpy(zero_copy_only=False).astype(bool)[at]
            ints = [pa.array(all_[:, c].astype(np.int32)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("basin").take(pa.array(at)), *ints, pa.array(np.where(hole, -all_[:, 2], all_[:, 2]))], names=["basin", "lat_idx", "lon_idx", "area"])

    spread = rings.select("basin", "is_hole", "pts").where("pts IS NOT NULL").repartition("basin")
    measured = spread.mapInArrow(cut, f"basin {kinds['basin']}, lat_idx int, lon_idx int, area double")
    measured = measured.withColumn("lon_idx", F.pmod("lon_idx", F.lit(round(360 / degrees))))
    areas = measured.groupBy("basin", "lat_idx", "lon_idx").agg(F.sum("area").alias("area"))
    total = F.sum(F.greatest(F.col("area"), F.lit(0.0))).over(Window.partitionBy("basin"))
    weighed = areas.withColumn("_t", total).where("area > 1e-12 AND _t > 0").select("basin", "lat_idx", "lon_idx", (F.col("area") / F.col("_t")).alias("weight"))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size("pts")
    centres = rings.where("NOT is_hole").join(weighed.select("basin").distinct(), "basin", "left_anti").groupBy("basin").agg(F.first(at(mean(lat), 90)).alias("lat_idx"), F.first(at(mean(lon), 180)).alias("lon_idx"))
    return weighed.unionByName(centres.withColumn("weight", F.lit(1.0)))
