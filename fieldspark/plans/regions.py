"""Connected regions, ponding, clouds and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.operators import cloud, components, grid, hydrology, spatial, thermal, zonal
from fieldspark.plans.adapters import cte, table, view
from fieldspark.plans.rasters import AREA, BASE, CELLS, DIFF, KEY, centred, diff, r4, ratios, zone_rings
from fieldspark.plans.registry import query


def labels(mask: str, conn: int, extra: str = "''") -> str:
    """Smallest-cell label of each cell of ``mask`` (columns survey_id, part, row_idx, col_idx)."""
    near = "abs(a.row_idx - b.row_idx) <= 1 AND abs(a.col_idx - b.col_idx) <= 1" if conn == 8 else "abs(a.row_idx - b.row_idx) + abs(a.col_idx - b.col_idx) = 1"
    steps = "(VALUES (0,1),(0,-1),(1,0),(-1,0)" + (",(1,1),(1,-1),(-1,1),(-1,-1)" if conn == 8 else "") + ") d(dr, dc)"
    return f""",
mask AS MATERIALIZED ({mask}),
adj AS MATERIALIZED (SELECT a.survey_id, a.part, a.id AS u, b.id AS v FROM (SELECT *, row_idx + dr AS r2, col_idx + dc AS c2, row_idx::BIGINT * 2147483648 + col_idx AS id FROM mask, {steps}) a
  JOIN (SELECT *, row_idx::BIGINT * 2147483648 + col_idx AS id FROM mask) b ON a.survey_id = b.survey_id AND a.part = b.part AND b.row_idx = a.r2 AND b.col_idx = a.c2),
cc(survey_id, part, id, lab) USING KEY (survey_id, part, id) AS (
  SELECT survey_id, part, row_idx::BIGINT * 2147483648 + col_idx, row_idx::BIGINT * 2147483648 + col_idx FROM mask
  UNION
  (SELECT adj.survey_id, adj.part, adj.v, min(cc.lab) FROM cc JOIN adj ON adj.survey_id = cc.survey_id AND adj.part = cc.part AND adj.u = cc.id
   JOIN recurring.cc r ON r.survey_id = adj.survey_id AND r.part = adj.part AND r.id = adj.v WHERE cc.lab < r.lab GROUP BY 1, 2, 3)),
lab AS MATERIALIZED (SELECT m.*, cc.lab AS region FROM cc JOIN mask m ON m.survey_id = cc.survey_id AND m.part = cc.part AND cc.id = m.row_idx::BIGINT * 2147483648 + m.col_idx)"""


@query("label_regions_4", CELLS + labels("SELECT survey_id, '' AS part, row_idx, col_idx FROM cells WHERE class_id IN (0, 1, 2)", 4) + "SELECT survey_id, row_idx, col_idx, CAST(region AS BIGINT) AS region FROM lab")
def label_regions_4(spark, sf):
    return components.label_regions(view(spark, sf, "cells").where("class_id IN (0, 1, 2)"), KEY, 4, tile=16).select("survey_id", "row_idx", "col_idx", "region")


@query("label_regions_8", CELLS + labels("SELECT survey_id, '' AS part, row_idx, col_idx FROM cells WHERE class_id IN (0, 1)", 8) + "SELECT survey_id, row_idx, col_idx, CAST(region AS BIGINT) AS region FROM lab")
def label_regions_8(spark, sf):
    return components.label_regions(view(spark, sf, "cells").where("class_id IN (0, 1)"), KEY, 8, tile=16).select("survey_id", "row_idx", "col_idx", "region")


@query("region_boundary", CELLS + labels("SELECT survey_id, '' AS part, row_idx, col_idx FROM cells WHERE class_id IN (0, 1)", 8) + """,
e AS (SELECT survey_id, region, row_idx + i AS r, col_idx AS c, 'h' AS o FROM lab, (VALUES (0), (1)) v(i) UNION ALL SELECT survey_id, region, row_idx, col_idx + i, 'v' FROM lab, (VALUES (0), (1)) v(i)),
b AS (SELECT survey_id, region, r, c, o FROM e GROUP BY ALL HAVING count(*) = 1)
SELECT survey_id, CAST(region AS BIGINT) AS region, CAST(count(*) AS BIGINT) AS edges FROM b GROUP BY 1, 2""")
def region_boundary(spark, sf):
    lab = components.label_regions(view(spark, sf, "cells").where("class_id IN (0, 1)"), KEY, 8)
    return components.region_boundary(lab, KEY).groupBy("survey_id", "region").agg(F.count(F.lit(1)).alias("edges"))


@query("change_regions", DIFF + labels("SELECT survey_id, CASE WHEN d > 0 THEN 'surface_rise' ELSE 'surface_fall' END AS part, row_idx, col_idx, d FROM k WHERE abs(d) >= 28", 8) + """
SELECT survey_id, part AS change, CAST(region AS BIGINT) AS region, CAST(count(*) AS BIGINT) AS cell_count, round(abs(sum(d)) * 0.25, 4) AS volume_m3, round(avg(d), 4) AS mean_delta_m, CASE WHEN part = 'surface_rise' THEN max(d) ELSE min(d) END AS extreme_delta_m
FROM lab GROUP BY 1, 2, 3 HAVING count(*) * 0.25 >= 0.5""")
def change_regions(spark, sf):
    d = grid.change_regions(diff(spark, sf), KEY, AREA, 28.0, 0.5)
    return d.select("survey_id", "change", "region", "cell_count", *r4("volume_m3", "mean_delta_m"), "extreme_delta_m")


@query("deformation_regions", DIFF + labels("SELECT survey_id, CASE WHEN d > 0 THEN 'uplift' ELSE 'subsidence' END AS part, row_idx, col_idx, d FROM k WHERE abs(d) > 5.0 + 12.0", 4) + """
SELECT survey_id, part AS direction, CAST(region AS BIGINT) AS region, CAST(count(*) AS BIGINT) AS cell_count, max(abs(d)) AS max_displacement_m, round(avg(abs(d)), 4) AS mean_displacement_m, round(sum(d) * 0.25, 4) AS volume_change_m3, round(avg(row_idx), 4) AS centroid_row
FROM lab GROUP BY 1, 2, 3 HAVING count(*) >= 9""")
def deformation_regions(spark, sf):
    d = grid.deformation_regions(diff(spark, sf), KEY, AREA, 3.0, 4.0, -12.0)
    return d.select("survey_id", "direction", "region", "cell_count", "max_displacement_m", *r4("mean_displacement_m", "volume_change_m3", "centroid_row"))


@query("encroachment_regions", CELLS + ", zones AS (" + cte("zones").split("AS (", 1)[1] + labels("SELECT c.survey_id, '' AS part, row_idx, col_idx FROM cells c WHERE class_id IN (1, 2) AND NOT EXISTS (SELECT 1 FROM zones z WHERE c.col_idx + 0.5 > z.x0 AND c.col_idx + 0.5 < z.x1 AND c.row_idx + 0.5 > z.y0 AND c.row_idx + 0.5 < z.y1)", 8)
       + "SELECT survey_id, CAST(region AS BIGINT) AS region, CAST(count(*) AS BIGINT) AS cell_count FROM lab GROUP BY 1, 2 HAVING count(*) >= 4")
def encroachment_regions(spark, sf):
    r = zone_rings(spark, sf).withColumnRenamed("zone_id", "boundary_id")
    e = zonal.encroachment(centred(spark, sf), r, KEY, "class_id", {"building": [1, 2]}, AREA, bucket=8.0)
    return components.label_regions(e, KEY, 8).groupBy("survey_id", "region").agg(F.count(F.lit(1)).alias("cell_count")).where("cell_count >= 4")


@query("anomaly_candidates", BASE + ", z AS (SELECT p.survey_id, row_idx, col_idx, abs(v - center) / scale AS z FROM p JOIN s USING (survey_id, band)), sc AS (SELECT survey_id, row_idx, col_idx, max(z) AS score FROM z GROUP BY 1, 2, 3 HAVING count(*) = 2)"
       + labels("SELECT survey_id, '' AS part, row_idx, col_idx, score FROM sc WHERE score >= 1.45", 8)
       + "SELECT survey_id, CAST(region AS BIGINT) AS region, CAST(count(*) AS BIGINT) AS cell_count, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score FROM lab GROUP BY 1, 2 HAVING count(*) * 0.25 >= 1")
def anomaly_candidates(spark, sf):
    return thermal.anomaly_candidates(ratios(spark, sf), KEY, AREA, threshold=1.45).select("survey_id", "region", "cell_count", *r4("max_score", "mean_score", n=6))


@query("hotspot_frames", CELLS + ", q AS (SELECT survey_id, greatest(40, quantile_cont(z_t1, 0.992)) AS t, max(z_t1) AS mx, avg(z_t1) AS av FROM cells WHERE z_t1 IS NOT NULL GROUP BY 1)"
       + labels("SELECT c.survey_id, '' AS part, row_idx, col_idx FROM cells c JOIN q USING (survey_id) WHERE z_t1 >= t", 8)
       + ", r AS (SELECT survey_id, region, count(*) AS n FROM lab GROUP BY 1, 2 HAVING count(*) >= 2) SELECT q.survey_id, round(t, 4) AS threshold_c, mx AS max_c, round(av, 4) AS mean_c, CAST(count(r.region) AS BIGINT) AS hotspots, CAST(coalesce(sum(r.n), 0) AS BIGINT) AS hotspot_cells FROM q LEFT JOIN r USING (survey_id) GROUP BY ALL")
def hotspot_frames(spark, sf):
    d = thermal.hotspot_frames(view(spark, sf, "cells").where("z_t1 IS NOT NULL"), KEY, "z_t1", threshold=40.0, min_cells=2)
    return d.select("survey_id", *r4("threshold_c"), "max_c", *r4("mean_c"), "hotspots", "hotspot_cells")


@query("module_arrays", CELLS + labels("SELECT DISTINCT survey_id, '' AS part, row_idx + dr AS row_idx, col_idx + dc AS col_idx FROM cells, (VALUES (0,0),(0,1),(0,-1),(1,0),(-1,0)) d(dr, dc) WHERE class_id = 2 AND row_idx + dr BETWEEN 0 AND 63 AND col_idx + dc BETWEEN 0 AND 63", 8)
       + "SELECT c.survey_id, c.row_idx * 64 + c.col_idx + 1 AS module_id, CAST(lab.region AS BIGINT) AS array_id FROM cells c JOIN lab ON lab.survey_id = c.survey_id AND lab.row_idx = c.row_idx AND lab.col_idx = c.col_idx WHERE c.class_id = 2")
def module_arrays(spark, sf):
    m = view(spark, sf, "cells").where("class_id = 2").withColumn("module_id", F.col("row_idx") * 64 + F.col("col_idx") + 1)
    return zonal.module_arrays(m, KEY, "module_id", 1, 64, 64).select("survey_id", "module_id", "array_id")


FLOOD = cte("cells") + """,
k AS MATERIALIZED (SELECT survey_id, row_idx, col_idx, z_t1 AS z, row_idx::BIGINT * 2147483648 + col_idx AS id FROM cells WHERE z_t1 IS NOT NULL),
fadj AS MATERIALIZED (SELECT a.survey_id, a.id AS u, b.id AS v, b.z AS z FROM (SELECT *, row_idx + dr AS r2, col_idx + dc AS c2 FROM k, (VALUES (0,1),(0,-1),(1,0),(-1,0)) d(dr, dc)) a
  JOIN k b ON a.survey_id = b.survey_id AND b.row_idx = a.r2 AND b.col_idx = a.c2),
deg AS (SELECT survey_id, v, count(*) AS n FROM fadj GROUP BY 1, 2),
f(survey_id, id, w) USING KEY (survey_id, id) AS (
  SELECT k.survey_id, k.id, CASE WHEN coalesce(deg.n, 0) < 4 THEN z ELSE 1e18 END FROM k LEFT JOIN deg ON deg.survey_id = k.survey_id AND deg.v = k.id
  UNION
  (SELECT fadj.survey_id, fadj.v, min(greatest(f.w, fadj.z)) FROM f JOIN fadj ON fadj.survey_id = f.survey_id AND fadj.u = f.id JOIN recurring.f r ON r.survey_id = fadj.survey_id AND r.id = fadj.v
   WHERE greatest(f.w, fadj.z) < r.w GROUP BY 1, 2)),
filled AS MATERIALIZED (SELECT k.*, f.w FROM k JOIN f USING (survey_id, id))"""


@query("fill_sinks", FLOOD + "SELECT survey_id, row_idx, col_idx, w AS filled FROM filled")
def fill_sinks(spark, sf):
    c = view(spark, sf, "cells").where("z_t1 IS NOT NULL").select("survey_id", "row_idx", "col_idx", "z_t1")
    return hydrology.fill_sinks(c, KEY, "z_t1", tile=16).select("survey_id", "row_idx", "col_idx", "filled")


@query("ponding_regions", FLOOD + labels("SELECT survey_id, '' AS part, row_idx, col_idx, w - z AS d FROM filled WHERE w - z > 2.0", 4)
       + "SELECT survey_id, CAST(region AS BIGINT) AS region, CAST(count(*) AS BIGINT) AS cell_count, max(d) AS max_depth_m, round(avg(d), 4) AS mean_depth_m, round(sum(d) * 0.25, 4) AS volume_m3 FROM lab GROUP BY 1, 2 HAVING count(*) >= 3")
def ponding_regions(spark, sf):
    c = view(spark, sf, "cells").select("survey_id", "row_idx", "col_idx", "z_t1")
    d = hydrology.ponding_regions(c, KEY, "z_t1", AREA, 1.0, min_cells=3)
    return d.select("survey_id", "region", "cell_count", "max_depth_m", *r4("mean_depth_m", "volume_m3"))


@query("voxel_downsample", cte("points") + "SELECT cloud_id, min(point_id) AS point_id FROM points GROUP BY cloud_id, floor(x / 0.1), floor(y / 0.1), floor(z / 0.1)")
def voxel_downsample(spark, sf):
    return cloud.voxel_downsample(view(spark, sf, "points"), ["cloud_id"], 0.1, "point_id").select("cloud_id", "point_id")


@query("rasterize_points", cte("points") + """, q AS (SELECT cloud_id, quantile_cont(x, 0.005) AS xl, quantile_cont(x, 0.995) AS xh, quantile_cont(y, 0.005) AS yl, quantile_cont(y, 0.995) AS yh, quantile_cont(z, 0.005) AS zl, quantile_cont(z, 0.995) AS zh FROM points GROUP BY 1),
i AS (SELECT p.* FROM points p JOIN q USING (cloud_id) WHERE x BETWEEN xl - (xh - xl) / 4 AND xh + (xh - xl) / 4 AND y BETWEEN yl - (yh - yl) / 4 AND yh + (yh - yl) / 4 AND z BETWEEN zl - (zh - zl) / 4 AND zh + (zh - zl) / 4),
b AS (SELECT cloud_id, min(x) AS w, max(y) AS n FROM i GROUP BY 1 HAVING count(*) >= 16)
SELECT cloud_id, CAST(floor((n - y) / 0.05) AS INT) AS row_idx, CAST(floor((x - w) / 0.05) AS INT) AS col_idx, round(max(z), 6) AS dsm, round(min(z), 6) AS z_min, CAST(count(*) AS BIGINT) AS points FROM i JOIN b USING (cloud_id) GROUP BY 1, 2, 3""")
def rasterize_points(spark, sf):
    d = cloud.rasterize_points(view(spark, sf, "points"), ["cloud_id"], 0.05)
    return d.select("cloud_id", "row_idx", "col_idx", *r4("dsm", "z_min", n=6), "points")


@query("clip_points", cte("points") + "SELECT cloud_id, point_id FROM points WHERE x * 1 + y * 2 - z >= 0 AND x + 0.02 >= 0")
def clip_points(spark, sf):
    return cloud.clip_points(view(spark, sf, "points"), [cloud.in_front((0, 0, 0), (1, 2, -1)), cloud.in_front((-0.02, 0, 0), (1, 0, 0))]).select("cloud_id", "point_id")


@query("points_in_polygons", cte("zones") + ", p AS (SELECT p_partkey, (p_partkey * 37 % 640) / 10.0::DOUBLE + 0.03::DOUBLE AS x, (p_partkey * 53 % 640) / 10.0::DOUBLE + 0.03::DOUBLE AS y FROM part) SELECT p_partkey, zone_id FROM p JOIN zones ON x > x0 AND x < x1 AND y > y0 AND y < y1")
def points_in_polygons(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", "(p_partkey * 37 % 640) / 10.0D + 0.03D AS x", "(p_partkey * 53 % 640) / 10.0D + 0.03D AS y")
    return spatial.points_in_polygons(p, zone_rings(spark, sf, False), [], 8.0, row_key=["p_partkey"]).select("p_partkey", "zone_id")



@query("zones_with_holes", cte("zones") + """, p AS (SELECT p_partkey, (p_partkey * 37 % 640) / 10.0::DOUBLE + 0.03::DOUBLE AS x, (p_partkey * 53 % 640) / 10.0::DOUBLE + 0.03::DOUBLE AS y FROM part)
SELECT p_partkey, zone_id FROM p JOIN zones ON x > x0 AND x < x1 AND y > y0 AND y < y1
WHERE NOT (x > x0 + (x1 - x0) / 4 AND x < x1 - (x1 - x0) / 4 AND abs(x - (x0 + x1) / 2) / ((x1 - x0) / 4) + abs(y - (y0 + y1) / 2) / ((y1 - y0) / 4) < 1)""")
def zones_with_holes(spark, sf):
    """Zones less the diamond in their middle, which is a second ring of each."""
    p = table(spark, sf, "part").selectExpr("p_partkey", "(p_partkey * 37 % 640) / 10.0D + 0.03D AS x", "(p_partkey * 53 % 640) / 10.0D + 0.03D AS y")
    z = zone_rings(spark, sf, False).select("zone_id", "ring")
    lo, hi = (lambda c: F.array_min(F.transform("ring", lambda v: v[c]))), (lambda c: F.array_max(F.transform("ring", lambda v: v[c])))
    mid, half = (lambda c: (lo(c) + hi(c)) / 2), (lambda c: (hi(c) - lo(c)) / 4)
    corner = lambda dx, dy: F.struct((mid("x") + half("x") * dx).alias("x"), (mid("y") + half("y") * dy).alias("y"))
    hole = F.array(*[corner(dx, dy) for dx, dy in ((-1, 0), (0, -1), (1, 0), (0, 1))])
    return spatial.zones_over_cells(p, z.unionByName(z.withColumn("ring", hole)), [], "zone_id", 0.5, cell_key=["p_partkey"]).select("p_partkey", "zone_id")


SEGD = "sqrt(pow(px - (ax + t * (qx - ax)), 2) + pow(py - (ay + t * (qy - ay)), 2))"
CLEAR = cte("zones") + f""", p AS (SELECT p_partkey, (p_partkey * 37 % 640) / 10.0::DOUBLE + 0.03::DOUBLE AS px, (p_partkey * 53 % 640) / 10.0::DOUBLE + 0.03::DOUBLE AS py FROM part),
s AS (SELECT zone_id, x0 AS ax, y0 AS ay, x1 AS qx, y0 AS qy FROM zones UNION ALL SELECT zone_id, x1, y0, x1, y1 FROM zones UNION ALL SELECT zone_id, x1, y1, x0, y1 FROM zones),
d AS (SELECT *, least(1, greatest(0, ((px - ax) * (qx - ax) + (py - ay) * (qy - ay)) / ((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay)))) AS t FROM p, s),
m AS (SELECT p_partkey, zone_id, min({SEGD}) AS dist FROM d GROUP BY 1, 2)"""


@query("clearance_violations", CLEAR + "SELECT p_partkey, zone_id, round(dist, 6) AS distance_m, round(2.5 - dist, 6) AS shortfall_m FROM m WHERE dist < 2.5")
def clearance_violations(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", "(p_partkey * 37 % 640) / 10.0D + 0.03D AS x", "(p_partkey * 53 % 640) / 10.0D + 0.03D AS y")
    d = spatial.clearance(p, zone_rings(spark, sf, False), [], 2.5, point_id="p_partkey", surface_id="zone_id")
    return d.select("p_partkey", "zone_id", *r4("distance_m", "shortfall_m", n=6))


@query("closest_approach", CLEAR + "SELECT zone_id, round(min(dist), 6) AS closest_m FROM m GROUP BY 1")
def closest_approach(spark, sf):
    p = table(spark, sf, "part").selectExpr("(p_partkey * 37 % 640) / 10.0D + 0.03D AS x", "(p_partkey * 53 % 640) / 10.0D + 0.03D AS y")
    return spatial.closest_approach(p, zone_rings(spark, sf, False), [], "zone_id", start_m=0.5).select("zone_id", *r4("closest_m", n=6))


@query("hazards_near", cte("planned") + """, m AS (SELECT s_suppkey AS marker_id, -81.75::DOUBLE + (s_suppkey % 97) / 5000.0::DOUBLE AS lon, 41.3::DOUBLE + (s_suppkey % 13) / 20000.0::DOUBLE AS lat, (s_suppkey % 5 * 10)::DOUBLE AS radius_m, CAST(s_suppkey % 50 + 1 AS INT) AS mission_id FROM supplier),
d AS (SELECT m.mission_id, marker_id, min(2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians(p.lat - m.lat) / 2), 2) + cos(radians(m.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - m.lon) / 2), 2))))) - any_value(radius_m) AS gap FROM m JOIN planned p USING (mission_id) GROUP BY 1, 2)
SELECT mission_id, marker_id, round(gap, 4) AS gap_m FROM d WHERE gap <= 30""")
def hazards_near(spark, sf):
    m = table(spark, sf, "supplier").selectExpr("s_suppkey AS marker_id", "-81.75D + (s_suppkey % 97) / 5000.0D AS lon", "41.3D + (s_suppkey % 13) / 20000.0D AS lat", "CAST(s_suppkey % 5 * 10 AS DOUBLE) AS radius_m", "CAST(s_suppkey % 50 + 1 AS INT) AS mission_id")
    return spatial.hazards_near(view(spark, sf, "planned"), m, ["mission_id"], 30.0).select("mission_id", "marker_id", *r4("gap_m"))


@query("tile_covers_area", """WITH a AS (SELECT p_partkey AS area_id, (p_partkey % 71) / 10.0::DOUBLE AS w, (p_partkey % 53) / 10.0::DOUBLE AS s FROM part), t AS (SELECT s_suppkey AS k, (s_suppkey % 7)::DOUBLE AS w, (s_suppkey % 5)::DOUBLE AS s, s_suppkey % 4 <> 0 AS present FROM supplier),
j AS (SELECT area_id, min(CASE WHEN present AND t.w <= a.w AND t.s <= a.s AND t.w + 1.5 >= a.w + 0.4 AND t.s + 1.5 >= a.s + 0.4 THEN k END) AS ok, count(*) FILTER (WHERE NOT present AND t.w <= a.w AND t.s <= a.s AND t.w + 1.5 >= a.w + 0.4 AND t.s + 1.5 >= a.s + 0.4) AS gone,
 count(*) FILTER (WHERE present AND t.w <= a.w + 0.4 AND t.w + 1.5 >= a.w AND t.s <= a.s + 0.4 AND t.s + 1.5 >= a.s) AS part FROM a, t GROUP BY 1)
SELECT area_id, CAST(ok AS VARCHAR) AS tile_id, CASE WHEN ok IS NOT NULL THEN 'covered' WHEN gone > 0 THEN 'file_missing' WHEN part > 0 THEN 'partial' ELSE 'elsewhere' END AS status FROM j""")
def tile_covers_area(spark, sf):
    a = table(spark, sf, "part").selectExpr("p_partkey AS area_id", "(p_partkey % 71) / 10.0D AS west", "(p_partkey % 53) / 10.0D AS south").withColumn("east", F.col("west") + 0.4).withColumn("north", F.col("south") + 0.4)
    t = table(spark, sf, "supplier").selectExpr("s_suppkey AS tile_seq", "CAST(s_suppkey AS STRING) AS tile_id", "CAST(s_suppkey % 7 AS DOUBLE) AS west", "CAST(s_suppkey % 5 AS DOUBLE) AS south", "s_suppkey % 4 <> 0 AS present")
    return spatial.tile_covers_area(a, t.withColumn("east", F.col("west") + 1.5).withColumn("north", F.col("south") + 1.5))


@query("idw_at_points", """WITH p AS (SELECT c_custkey AS pid, c_nationkey AS site, (c_custkey % 97)::DOUBLE AS x, (c_custkey % 89)::DOUBLE AS y FROM customer), s AS (SELECT s_nationkey AS site, (s_suppkey % 83)::DOUBLE AS x, (s_suppkey % 79)::DOUBLE AS y, s_acctbal AS z FROM supplier),
j AS (SELECT pid, count(s.z) AS n, sum(s.z / greatest(0.25, sqrt(pow(p.x - s.x, 2) + pow(p.y - s.y, 2)))) / sum(1 / greatest(0.25, sqrt(pow(p.x - s.x, 2) + pow(p.y - s.y, 2)))) AS e FROM p LEFT JOIN s USING (site) GROUP BY 1)
SELECT pid, CASE WHEN n >= 3 THEN round(e, 4) END AS elevation_m, CASE WHEN n >= 3 THEN 'ok' ELSE 'refused' END AS status FROM j""")
def idw_at_points(spark, sf):
    p = table(spark, sf, "customer").selectExpr("c_custkey AS pid", "c_nationkey AS site", "CAST(c_custkey % 97 AS DOUBLE) AS x", "CAST(c_custkey % 89 AS DOUBLE) AS y")
    s = table(spark, sf, "supplier").selectExpr("s_nationkey AS site", "CAST(s_suppkey % 83 AS DOUBLE) AS x", "CAST(s_suppkey % 79 AS DOUBLE) AS y", "s_acctbal AS z")
    return spatial.idw_at_points(p, s, ["site"], "pid").select("pid", *r4("elevation_m"), "status")


@query("fit_similarity")
def fit_similarity(spark, sf):
    return cloud.fit_similarity(pairs(spark, sf), ["cloud_id"]).select("cloud_id", "n", *r4("scale", n=6))


@query("fit_similarity_robust", cte("points") + """SELECT cloud_id, CAST(count(*) FILTER (WHERE point_id % 9 <> 0) AS BIGINT) AS inliers, 2.5::DOUBLE AS scale FROM points GROUP BY 1 HAVING count(*) FILTER (WHERE point_id % 9 <> 0) >= 3""")
def fit_similarity_robust(spark, sf):
    return cloud.fit_similarity_robust(pairs(spark, sf), ["cloud_id"], "point_id", rounds=32, tolerance=0.01).where("inliers >= 3").select("cloud_id", "inliers", *r4("scale", n=6))


def pairs(spark, sf):
    """Points against a scaled, turned and shifted copy with some gross errors."""
    p = view(spark, sf, "points")
    bad = F.when(F.col("point_id") % 9 == 0, 0.5).otherwise(0.0)
    return p.selectExpr("cloud_id", "point_id", "x AS px", "y AS py", "z AS pz").withColumn("qx", -2.5 * F.col("py") + 10 + bad).withColumn("qy", 2.5 * F.col("px") - 3).withColumn("qz", 2.5 * F.col("pz") + 7)


@query("mesh_closure_volume", """SELECT c_custkey AS model_id, round(pow(1 + c_custkey % 7, 3), 4) AS volume_m3, round(6 * pow(1 + c_custkey % 7, 2), 4) AS area_m2, 'ok' AS status FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, NULL, round(6 * pow(1 + c_custkey % 7, 2) - pow(1 + c_custkey % 7, 2) / 2, 4), 'refused' FROM customer WHERE c_custkey % 3 = 0""")
def mesh_closure_volume(spark, sf):
    """One box per customer; every third box lacks a face."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("model_id"), (1 + F.col("c_custkey") % 7).cast("double").alias("s"))
    corners = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    v = c.select("model_id", "s", F.posexplode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for x, y, z in corners])).alias("vid", "p"))
    v = v.select("model_id", "vid", *[(F.col(f"p.{a}") * F.col("s")).alias(a) for a in "xyz"])
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    tri = [t for a, b, d, e in quads for t in ((a, b, d), (a, d, e))]
    f = c.select("model_id", F.posexplode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(d).alias("c")) for a, b, d in tri])).alias("fid", "t"))
    f = f.where((F.col("model_id") % 3 != 0) | (F.col("fid") > 0)).select("model_id", "fid", "t.a", "t.b", "t.c")
    return cloud.mesh_closure_volume(v, f, ["model_id"]).select("model_id", *r4("volume_m3", "area_m2"), "status")
