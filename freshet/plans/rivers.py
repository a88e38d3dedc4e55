"""Queries on flow-direction rasters, outlets, stems and chains, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import network, outlets
from freshet.plans import base
from freshet.plans.base import VIEWS, query

R = lambda c, n=6: F.round(c, n)
SIDE = 16

#: Parts as the cells of a raster of 64 columns whose directions never lead up, so it has no cycle.
VIEWS |= {
    "raster": """SELECT p_partkey // 64 AS row, p_partkey % 64 AS col, ([1, 4, 8, 2, 4])[p_partkey * 7 % 5 + 1] AS code, 1 + p_partkey % 7 * 0.125::DOUBLE AS area FROM part""",
    "flow_down": """SELECT row, col, code, area, row + CASE WHEN code = 1 THEN 0 ELSE 1 END AS to_row, col + CASE code WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 4 THEN 0 ELSE -1 END AS to_col FROM raster""",
    "gauged": """SELECT c_custkey AS point_id, c_custkey // 64 AS row, c_custkey % 64 AS col, CASE WHEN c_custkey % 9 > 0 THEN (c_custkey % 9 * c_custkey % 41 - 2)::DOUBLE END AS expected_area FROM customer""",
}


def raster(spark, d):
    k = F.col("p_partkey")
    code = F.element_at(F.array(*[F.lit(c) for c in (1, 4, 8, 2, 4)]), (k * 7 % 5 + 1).cast("int"))
    return base.read(spark, d, "part").select(F.floor(k / 64).alias("row"), (k % 64).alias("col"), code.alias("code"), (1 + k % 7 * 0.125).alias("area"))


def gauged(spark, d):
    k = F.col("c_custkey")
    hint = F.when(k % 9 > 0, (k % 9 * k % 41 - 2).cast("double"))
    return base.read(spark, d, "customer").select(k.alias("point_id"), F.floor(k / 64).alias("row"), (k % 64).alias("col"), hint.alias("expected_area"))


_ABOVE = f"""up AS (SELECT row AS r, col AS c, row, col, 0 AS hops, true AS local FROM raster UNION ALL
SELECT up.r, up.c, f.row, f.col, hops + 1, local AND f.row // {SIDE} = up.row // {SIDE} AND f.col // {SIDE} = up.col // {SIDE} FROM up JOIN flow_down f ON f.to_row = up.row AND f.to_col = up.col),
acc AS (SELECT r AS row, c AS col, count(*) AS cells, sum(area) AS upstream_area, count(*) FILTER (local AND hops <= 100) AS near FROM up JOIN raster USING (row, col) GROUP BY 1, 2)"""


@query("raster_accumulation", f"WITH RECURSIVE {_ABOVE} SELECT row, col, cells, upstream_area, near FROM acc", "raster flow_down")
def raster_accumulation(spark, d):
    return outlets.accumulation(raster(spark, d), SIDE).select("row", "col", "cells", "upstream_area", "near")


_SNAPPED = f"""near AS (SELECT g.point_id, a.row, a.col, cells, upstream_area, sqrt((a.row - g.row) ^ 2 + (a.col - g.col) ^ 2) AS distance, a.row - g.row AS dr, a.col - g.col AS dc, near
FROM gauged g JOIN acc a ON abs(a.row - g.row) <= 3 AND abs(a.col - g.col) <= 3 AND a.row // {SIDE} = g.row // {SIDE} AND a.col // {SIDE} = g.col // {SIDE}),
snapped AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY round(least(near, 5000) - 2 * distance, 9) DESC, dr, dc) = 1)"""


@query("snapped_outlets", f"WITH RECURSIVE {_ABOVE}, {_SNAPPED} SELECT point_id, row, col, cells, upstream_area, round(distance, 6) AS distance FROM snapped", "raster flow_down gauged")
def snapped_outlets(spark, d):
    found = outlets.snap_outlets(gauged(spark, d).drop("expected_area"), outlets.accumulation(raster(spark, d), SIDE), 3, SIDE)
    return found.withColumn("distance", R("distance"))


@query("area_guided_outlets", f"""WITH RECURSIVE {_ABOVE}, {_SNAPPED},
s AS (SELECT g.point_id, g.row AS r, g.col AS c, expected_area AS e, s.row, s.col, cells, upstream_area, distance,
CASE WHEN NOT coalesce(expected_area > 0, true) THEN 'bad_hint' WHEN s.row IS NULL THEN 'no_cell' WHEN expected_area IS NULL THEN 'snapped' WHEN upstream_area BETWEEN 0.8 * expected_area AND 1.2 * expected_area THEN 'fits' END AS status
FROM gauged g LEFT JOIN snapped s USING (point_id)),
w AS (SELECT s.point_id, e, a.row, a.col, a.cells, a.upstream_area, sqrt((a.row - r) ^ 2 + (a.col - c) ^ 2) AS distance, a.row - r AS dr, a.col - c AS dc, a.upstream_area BETWEEN 0.8 * e AND 1.2 * e AS fits
FROM s JOIN acc a ON abs(a.row - r) <= 9 AND abs(a.col - c) <= 9 AND a.row // {SIDE} = r // {SIDE} AND a.col // {SIDE} = c // {SIDE} WHERE status IS NULL),
b AS (SELECT * FROM w WHERE fits QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY round(distance, 9), dr, dc) = 1),
k AS (SELECT point_id, upstream_area AS closest FROM w QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY round(abs(upstream_area - e), 9), upstream_area) = 1)
SELECT point_id, status, CASE WHEN status IN ('snapped', 'fits') THEN row END AS row, CASE WHEN status IN ('snapped', 'fits') THEN col END AS col, CASE WHEN status IN ('snapped', 'fits') THEN cells END AS cells, CASE WHEN status IN ('snapped', 'fits') THEN upstream_area END AS closest_area FROM s WHERE status IS NOT NULL
UNION ALL SELECT s.point_id, CASE WHEN b.row IS NULL THEN 'mismatch' ELSE 'found' END, b.row, b.col, b.cells, coalesce(b.upstream_area, k.closest) FROM s LEFT JOIN b USING (point_id) LEFT JOIN k USING (point_id) WHERE s.status IS NULL""", "raster flow_down gauged")
def area_guided_outlets(spark, d):
    found = outlets.area_guided_outlets(gauged(spark, d), outlets.accumulation(raster(spark, d), SIDE), 0.2, 3, 9, SIDE)
    return found.select("point_id", "status", "row", "col", "cells", "closest_area")


@query("main_stem_chain", """WITH RECURSIVE stem AS (SELECT d.reach_id AS node, max_by(u.reach_id, u.area * 1e9 - u.reach_id) AS up FROM reaches u JOIN reaches d ON u.next_down = d.reach_id GROUP BY 1),
below AS (SELECT reach_id AS start, 0 AS step, reach_id AS node FROM reaches UNION ALL SELECT start, step + 1, r.next_down FROM below JOIN reaches r ON r.reach_id = below.node JOIN reaches t ON t.reach_id = r.next_down WHERE step < 5),
above AS (SELECT reach_id AS start, 0 AS step, reach_id AS node FROM reaches UNION ALL SELECT start, step - 1, up FROM above JOIN stem USING (node) WHERE step > -5)
SELECT * FROM below UNION ALL SELECT * FROM above WHERE step < 0""", "reaches")
def main_stem_chain(spark, d):
    r = base.reaches(spark, d)
    return network.main_stem_chain(r.select("reach_id"), r, "reach_id", "next_down", "area", 5)


VIEWS |= {"wide": "SELECT reach_id, next_down FROM reaches WHERE reach_id % 7 <> 3"}
_CHAINS = """l AS (SELECT w.reach_id AS node, t.reach_id AS down FROM wide w LEFT JOIN wide t ON t.reach_id = w.next_down),
n AS (SELECT node, down, (SELECT count(*) FROM l u WHERE u.down = l.node) AS ups FROM l),
c AS (SELECT node AS chain, 0 AS position, node FROM n WHERE ups <> 1 UNION ALL SELECT chain, position + 1, n.down FROM c JOIN n USING (node) JOIN n m ON m.node = n.down WHERE m.ups = 1)"""


@query("split_chains", f"WITH RECURSIVE {_CHAINS} SELECT *, true AS own FROM c", "reaches wide")
def split_chains(spark, d):
    return network.split_chains(base.reaches(spark, d), "reach_id", "next_down", F.col("reach_id") % 7 != 3)


@query("joined_chains", f"""WITH RECURSIVE {_CHAINS}, b AS (SELECT *, true AS own FROM c UNION ALL SELECT chain, position + 1, n.down, false FROM c JOIN n USING (node) JOIN n m ON m.node = n.down WHERE m.ups <> 1)
SELECT * FROM b QUALIFY count(*) OVER (PARTITION BY chain) > 1""", "reaches wide")
def joined_chains(spark, d):
    return network.split_chains(base.reaches(spark, d), "reach_id", "next_down", F.col("reach_id") % 7 != 3, include_end=True)


#: Pieces of supplier units in ten basins: unit k drains to k // 2 and belongs to several basins by a varying part.
VIEWS |= {"pieces": """SELECT b AS basin, s_suppkey AS unit, s_suppkey // 2 AS next_down, 100.0::DOUBLE AS area, (s_suppkey * (b + 3) * 13 % 101)::DOUBLE AS overlap, s_acctbal AS runoff
FROM supplier, range(10) t(b) WHERE (s_suppkey + b) % 3 > 0 AND s_suppkey > 0"""}


@query("pour_point_sums", """WITH RECURSIVE f AS (SELECT basin, unit, next_down FROM pieces QUALIFY row_number() OVER (PARTITION BY basin ORDER BY overlap DESC, unit) = 1),
walk AS (SELECT basin, unit, next_down, 0 AS n FROM f UNION ALL SELECT w.basin, p.unit, p.next_down, n + 1 FROM walk w JOIN pieces p ON p.basin = w.basin AND p.unit = w.next_down WHERE p.overlap >= 50 AND w.next_down <> 0),
e AS (SELECT basin, max_by(next_down, n) AS pour_point FROM walk GROUP BY 1),
p AS (SELECT basin AS pb, unit AS own, next_down AS down, overlap, runoff FROM pieces),
s AS (SELECT basin, pour_point, count(own) AS units, sum(runoff) AS total FROM e LEFT JOIN p ON pb = basin AND down = pour_point AND overlap > 20 GROUP BY ALL)
SELECT basin, pour_point, units, round(CASE WHEN units = 0 THEN runoff ELSE total END, 4) AS runoff FROM s JOIN f USING (basin) JOIN p ON pb = basin AND own = unit""", "pieces")
def pour_point_sums(spark, d):
    k = F.col("s_suppkey")
    units = base.read(spark, d, "supplier").where("s_suppkey > 0").withColumn("basin", F.explode(F.sequence(F.lit(0), F.lit(9))))
    pieces = units.where((k + F.col("basin")) % 3 > 0).select("basin", k.alias("unit"), F.floor(k / 2).alias("next_down"), F.lit(100.0).alias("area"), (k * (F.col("basin") + 3) * 13 % 101).cast("double").alias("overlap"), F.col("s_acctbal").alias("runoff"))
    out = network.pour_point_sums(pieces, "basin", "unit", "next_down", "overlap", "area", ["runoff"], 20.0)
    return out.withColumn("runoff", R("runoff", 4))
