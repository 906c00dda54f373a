"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import bands, geo, physics, text
from fieldspark.plans.adapters import cte, table, view
from fieldspark.plans.registry import query


def r(*pairs, n=6):
    return [F.round(c, n).alias(a) for a, c in pairs]


POS = "(o_orderkey % 3600) / 10.0{d} - 180 AS lon, (o_orderkey * 7 % 1680) / 10.0{d} - 80 AS lat"


def positions(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey", *POS.format(d="D").split(", "))


@query("utm_epsg", f"""WITH p AS (SELECT o_orderkey, {POS.format(d='::DOUBLE')} FROM orders) SELECT o_orderkey, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32
WHEN lat >= 72 AND lat < 84 AND lon >= 0 AND lon < 42 THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END ELSE floor((lon + 180) / 6) % 60 + 1 END AS INT) AS epsg FROM p""")
def utm_epsg(spark, sf):
    return positions(spark, sf).select("o_orderkey", geo.utm_epsg("lat", "lon").alias("epsg"))


@query("utm_round_trip", "SELECT o_orderkey, 0.0::DOUBLE AS miss FROM orders")
def utm_round_trip(spark, sf):
    """Projecting into the zone and back returns the position (to a micro-degree)."""
    p = positions(spark, sf).withColumn("epsg", geo.utm_epsg("lat", "lon")).withColumn("u", geo.lonlat_to_utm("lon", "lat", "epsg"))
    b = p.withColumn("b", geo.utm_to_lonlat("u.easting", "u.northing", "epsg"))
    return b.select("o_orderkey", (F.round(F.greatest(F.abs(F.col("b.lon") - F.col("lon")), F.abs(F.col("b.lat") - F.col("lat"))), 6) + 0.0).alias("miss"))


# the oracle projects by the truncated series in the second eccentricity, the library by the series in the third flattening
_E2 = geo.WGS84_F * (2 - geo.WGS84_F)
_UTM = f"""
z AS (SELECT mission_id, avg(lon) AS clon, avg(lat) AS clat FROM planned GROUP BY 1),
e AS (SELECT p.*, 32600 + CAST(floor((clon + 180) / 6) AS INT) + 1 AS epsg, radians(lat) AS phi, radians(floor((clon + 180) / 6) * 6 - 177) AS lon0 FROM planned p JOIN z USING (mission_id)),
k AS (SELECT *, {geo.WGS84_A} / sqrt(1 - {_E2} * sin(phi) * sin(phi)) AS nu, tan(phi) * tan(phi) AS t, {_E2} / (1 - {_E2}) * cos(phi) * cos(phi) AS c, (radians(lon) - lon0) * cos(phi) AS a,
  {geo.WGS84_A} * ({1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256 - 175 * _E2**4 / 16384} * phi - {3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024 + 105 * _E2**4 / 4096} * sin(2 * phi)
    + {15 * _E2**2 / 256 + 45 * _E2**3 / 1024 + 525 * _E2**4 / 16384} * sin(4 * phi) - {35 * _E2**3 / 3072 + 175 * _E2**4 / 12288} * sin(6 * phi)
    + {315 * _E2**4 / 131072} * sin(8 * phi)) AS m FROM e),
u AS (SELECT mission_id, idx, epsg, alt_m, 0.9996 * nu * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * {_E2 / (1 - _E2)}) * a ** 5 / 120) AS x,
  0.9996 * (m + nu * tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * {_E2 / (1 - _E2)}) * a ** 6 / 720)) AS y FROM k),
o AS (SELECT mission_id, avg(x) AS mx, avg(y) AS my, avg(alt_m) AS mz FROM u GROUP BY 1)"""


@query("local_enu", cte("planned") + f""", {_UTM}
SELECT mission_id, idx, epsg, round(x - mx, 3) + 0.0 AS east, round(y - my, 3) + 0.0 AS north, round(alt_m - mz, 4) + 0.0 AS up FROM u JOIN o USING (mission_id)""")
def local_enu(spark, sf):
    from fieldspark.operators.spatial import local_enu as run
    return run(view(spark, sf, "planned"), ["mission_id"]).select("mission_id", "idx", "epsg", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("east", 3), ("north", 3), ("up", 4))])


@query("lonlat_to_utm", cte("planned") + f""", {_UTM}
SELECT mission_id, idx, round(x + 500000, 2) AS easting, round(y, 2) AS northing FROM u""")
def lonlat_to_utm(spark, sf):
    from fieldspark.operators.spatial import local_enu as run
    p = run(view(spark, sf, "planned"), ["mission_id"])
    return p.select("mission_id", "idx", F.round(F.col("east") + F.col("origin_east"), 2).alias("easting"), F.round(F.col("north") + F.col("origin_north"), 2).alias("northing"))


@query("mercator_tile", f"""WITH p AS (SELECT o_orderkey, {POS.format(d='::DOUBLE')} FROM orders), c AS (SELECT *, greatest(-85.05112878, least(85.05112878, lat)) AS cl FROM p)
SELECT o_orderkey, CAST(greatest(0, least(4095, trunc((lon + 180) / 360 * 4096))) AS BIGINT) AS x, CAST(greatest(0, least(4095, trunc((1 - ln(tan(radians(cl)) + sqrt(tan(radians(cl)) * tan(radians(cl)) + 1)) / pi()) / 2 * 4096))) AS BIGINT) AS y FROM c""")
def mercator_tile(spark, sf):
    t = positions(spark, sf).select("o_orderkey", geo.mercator_tile("lon", "lat", F.lit(12)).alias("t"))
    return t.select("o_orderkey", "t.x", "t.y")


@query("count_tiles", """SELECT o_orderkey, CAST(1 + 1 AS BIGINT) * 0 + CAST((greatest(a1, b1) - least(a1, b1) + 1) * 1 AS BIGINT) AS tiles FROM (SELECT o_orderkey, CAST(trunc((o_orderkey % 300 - 150 + 180) / 360.0 * 256) AS BIGINT) AS a1, CAST(trunc((o_orderkey % 300 - 150 + 20 + 180) / 360.0 * 256) AS BIGINT) AS b1 FROM orders)""")
def count_tiles(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "CAST(o_orderkey % 300 - 150 AS DOUBLE) AS w").withColumn("e", F.col("w") + 20.0)
    return o.select("o_orderkey", geo.count_tiles("w", F.lit(10.0), "e", F.lit(10.0), 8, 8).alias("tiles"))


@query("ring_measures", cte("zones") + "SELECT zone_id, round((x1 - x0) * (y1 - y0), 6) AS area, round(2 * (x1 - x0 + y1 - y0), 6) AS perimeter, round(x1 - x0 + y1 - y0, 6) AS path FROM zones")
def ring_measures(spark, sf):
    from fieldspark.plans.rasters import zone_rings
    z = zone_rings(spark, sf, False)
    return z.select("zone_id", *r(("area", geo.shoelace("ring")), ("perimeter", geo.perimeter("ring")), ("path", geo.polyline_length(F.slice("ring", 1, 3)))))


@query("pixel_measures", cte("zones") + "SELECT zone_id, round(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) * 0.5, 6) AS distance_mm, round((x1 - x0) * (y1 - y0) * 0.25, 6) AS area_mm2 FROM zones")
def pixel_measures(spark, sf):
    """Diagonal and area of zones taken as pixels of half a millimetre."""
    from fieldspark.plans.rasters import zone_rings
    low, high = (lambda c: F.array_min(F.transform("ring", lambda v: v[c]))), (lambda c: F.array_max(F.transform("ring", lambda v: v[c])))
    z = zone_rings(spark, sf, False)
    return z.select("zone_id", *r(("distance_mm", geo.pixel_distance_mm(low("x"), low("y"), high("x"), high("y"), F.lit(0.5))), ("area_mm2", geo.pixel_area_mm2("ring", F.lit(0.5)))))


@query("palette_labels", """WITH c AS (SELECT p_partkey, p_partkey % 3 * 100 AS red, p_partkey % 2 * 200 AS green, p_size % 3 * 60 AS blue FROM part)
SELECT p_partkey, CASE WHEN red = 100 AND green = 200 AND blue = 60 THEN 3 WHEN red = 200 AND green = 0 AND blue = 0 THEN 7 ELSE 0 END AS label, CAST(greatest(red, green, blue) > 127 AS INT) AS bright FROM c""")
def palette_labels(spark, sf):
    from fieldspark.operators import grid
    c = table(spark, sf, "part").selectExpr("p_partkey", "p_partkey % 3 * 100 AS red", "p_partkey % 2 * 200 AS green", "p_size % 3 * 60 AS blue")
    both = grid.remap_palette(c, {(100, 200, 60): 3, (200, 0, 0): 7}).withColumnRenamed("label", "named")
    return grid.binarise(both).select("p_partkey", F.col("named").alias("label"), F.col("label").alias("bright"))


@query("equirect_area", cte("zones") + "SELECT zone_id, round((x1 - x0) * (y1 - y0) * 1e-6 * cos(radians((y0 + y1) / 2)) * pow(pi() * 6371000 / 180, 2), 2) AS area_m2 FROM zones")
def equirect_area(spark, sf):
    from fieldspark.plans.rasters import zone_rings
    small = F.transform("ring", lambda p: F.struct((p["x"] / 1000).alias("x"), p["y"].alias("y")))
    z = zone_rings(spark, sf, False).withColumn("ring", small)
    return z.select("zone_id", F.round(geo.equirect_area_m2("ring", geo.EARTH_RADIUS_TRACK_M) / 1000.0, 2).alias("area_m2"))


@query("newell_area", cte("zones") + "SELECT zone_id, round((x1 - x0) * (y1 - y0) * sqrt(1.25), 5) AS surface, round((x1 - x0) * (y1 - y0), 5) AS planimetric, round(degrees(acos(1 / sqrt(1.25))), 5) AS slope_deg FROM zones")
def newell_area(spark, sf):
    from fieldspark.plans.rasters import zone_rings
    z = zone_rings(spark, sf, False).withColumn("ring", F.transform("ring", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), (p["x"] / 2).alias("z"))))
    n = z.withColumn("n", geo.newell_area("ring"))
    return n.select("zone_id", *r(("surface", F.col("n.surface")), ("planimetric", F.col("n.planimetric")), ("slope_deg", F.col("n.slope_deg")), n=5))


@query("length_height", cte("points") + "SELECT point_id, round(sqrt((x - 1) * (x - 1) + y * y + z * z), 6) AS length, round(sqrt((x - 1) * (x - 1) + y * y), 6) AS horizontal, round(abs(z), 6) AS height FROM points")
def length_height(spark, sf):
    p = view(spark, sf, "points").withColumn("l", geo.length_height(F.lit(1.0), F.lit(0.0), F.lit(0.0), "x", "y", "z"))
    return p.select("point_id", *r(("length", F.col("l.length")), ("horizontal", F.col("l.horizontal")), ("height", F.col("l.height"))))


@query("apply_similarity", cte("points") + "SELECT point_id, round(-2.5 * y + 10, 6) AS x2, round(2.5 * x - 3, 6) AS y2, round(2.5 * z + 7, 6) AS z2 FROM points")
def apply_similarity(spark, sf):
    rot, t = F.array(*[F.lit(float(v)) for v in (0, -1, 0, 1, 0, 0, 0, 0, 1)]), F.array(F.lit(10.0), F.lit(-3.0), F.lit(7.0))
    p = view(spark, sf, "points").withColumn("q", geo.apply_similarity(F.lit(2.5), rot, t, "x", "y", "z"))
    return p.select("point_id", *r(("x2", F.col("q.x")), ("y2", F.col("q.y")), ("z2", F.col("q.z"))))


@query("affine_xy", cte("cells") + "SELECT survey_id, row_idx, col_idx, 500000 + 0.5 * (col_idx + 0.5) AS x, 4570000 - 0.5 * (row_idx + 0.5) AS y FROM cells")
def affine_xy(spark, sf):
    c = view(spark, sf, "cells").withColumn("p", geo.affine_xy("row_idx", "col_idx", 0.5, 0.0, 500000.0, 0.0, -0.5, 4570000.0))
    return c.select("survey_id", "row_idx", "col_idx", "p.x", "p.y")


@query("dms_to_degrees", "SELECT o_orderkey, round((o_orderkey % 180 + (o_orderkey % 60) / 60.0 + (o_orderkey % 3600) / 60.0 / 3600.0) * CASE WHEN o_orderkey % 4 >= 2 THEN -1 ELSE 1 END, 6) AS deg FROM orders")
def dms_to_degrees(spark, sf):
    o = table(spark, sf, "orders").withColumn("s", geo.rational(F.col("o_orderkey") % 3600, F.lit(60.0))).withColumn("ref", F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'E' WHEN 2 THEN 's' ELSE 'W' END"))
    return o.select("o_orderkey", *r(("deg", geo.dms_to_degrees(F.col("o_orderkey") % 180, F.col("o_orderkey") % 60, "s", "ref"))))


@query("gps_to_utc", "SELECT o_orderkey, CAST(epoch_us(TIMESTAMP '1980-01-06') + (2000 + o_orderkey % 300) * 604800000000 + (o_orderkey % 604800) * 1000000 + 250000 - 18000000 AS BIGINT) AS us FROM orders")
def gps_to_utc(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.unix_micros(physics.gps_to_utc(2000 + F.col("o_orderkey") % 300, F.col("o_orderkey") % 604800 + 0.25)).alias("us"))


@query("bearing", f"""WITH p AS (SELECT o_orderkey, {POS.format(d='::DOUBLE')} FROM orders), b AS (SELECT o_orderkey, degrees(atan2((10.05 - lon) * cos(radians((lat + 20.05) / 2)), 20.05 - lat)) AS d FROM p) SELECT o_orderkey, round(CASE WHEN d < 0 THEN d + 360 ELSE d END, 6) AS bearing FROM b""")
def bearing(spark, sf):
    return positions(spark, sf).select("o_orderkey", *r(("bearing", geo.bearing_deg("lat", "lon", F.lit(20.05), F.lit(10.05)))))


CAM = "SELECT p_partkey, 20.0{d} + p_partkey % 100 AS alt, 13.2{d} AS sw, 8.8{d} AS sh, 8.0{d} + p_partkey % 3 AS f, 4000 + p_partkey % 5 * 100 AS iw FROM {t}"


@query("camera_geometry", f"""WITH c AS ({CAM.format(d='::DOUBLE', t='part')}) SELECT p_partkey, round(alt * (sw / f) / iw * 100, 6) AS gsd_cm, round(sw * alt / f, 6) AS width_m, round(degrees(2 * atan(sw / (2 * f))), 6) AS fov,
round(2.0 / 100 * iw / (sw / f), 6) AS altitude_for_gsd, round(sw * 1000 / iw, 6) AS pitch_um, round(iw * 3000 / 1000000.0, 6) AS megapixels, round(least(1 / 250.0, greatest(1 / 2000.0, greatest(1e-4, alt * (sw / f) / iw) * 0.7 / 5)), 8) AS shutter FROM c""")
def camera_geometry(spark, sf):
    c = spark.sql(CAM.format(d="D", t="{p}"), p=table(spark, sf, "part"))
    gsd = physics.gsd_cm("alt", "sw", "f", "iw")
    return c.select("p_partkey", *r(("gsd_cm", gsd), ("width_m", physics.footprint_m("alt", "sw", "sh", "f")["width"]), ("fov", physics.fov_deg("sw", "f")), ("altitude_for_gsd", physics.altitude_for_gsd_m(F.lit(2.0), "sw", "f", "iw")),
                                    ("pitch_um", physics.pixel_pitch_um("sw", "iw")), ("megapixels", physics.megapixels("iw", F.lit(3000)))), F.round(physics.shutter_s(F.lit(5.0), gsd), 8).alias("shutter"))


@query("sample_gsd", """SELECT p_partkey, round(CASE p_partkey % 3 WHEN 0 THEN 4.7 * cos(radians(degrees(2 * atan(exp((p_partkey % 80 * 100000) / 6378137.0)) - pi() / 2))) WHEN 1 THEN 0.0001 * 111320 * cos(radians((p_partkey % 60 + p_partkey % 60 + 1) / 2.0)) ELSE 0.5 END, 6) AS gsd_m FROM part""")
def sample_gsd(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", "CASE p_partkey % 3 WHEN 0 THEN 4.7D WHEN 1 THEN 0.0001D ELSE -0.5D END AS px", "CASE p_partkey % 3 WHEN 0 THEN 3857 WHEN 1 THEN 4326 ELSE 32617 END AS epsg",
                                            "CASE p_partkey % 3 WHEN 0 THEN CAST(p_partkey % 80 * 100000 AS DOUBLE) ELSE CAST(p_partkey % 60 AS DOUBLE) END AS top", "CAST(p_partkey % 60 + 1 AS DOUBLE) AS bottom")
    return p.select("p_partkey", *r(("gsd_m", physics.sample_gsd("px", "epsg", "top", "bottom"))))


PL = dict(r1=17096.453, r2=0.04546, b=1428.0, f=1.0, o=-342.0)


@query("raw_to_celsius", """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 9000 + l_quantity * 120 AS raw FROM lineitem), a AS (SELECT 17096.453 / (0.04546 * (exp(1428 / 293.15::DOUBLE) - 1)) + 342 AS amb),
s AS (SELECT c.*, (raw - (1 - 0.95::DOUBLE) * 0.98::DOUBLE * amb) / (0.95::DOUBLE * 0.98::DOUBLE) AS srf FROM c, a), k AS (SELECT *, 17096.453 / (0.04546 * (srf - 342)) + 1 AS q FROM s), t AS (SELECT *, CASE WHEN q > 0 AND abs(q - 1) > 1e-12 THEN 1428 / ln(q) END AS kel FROM k)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN kel > 1 AND kel < 5000 THEN kel - 273.15 END, 4) AS celsius FROM t""")
def raw_to_celsius(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("raw", 9000 + F.col("l_quantity") * 120)
    args = [F.lit(PL[k]) for k in ("r1", "r2", "b", "f", "o")]
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(physics.raw_to_celsius("raw", *args, F.lit(0.95), F.lit(20.0), F.lit(0.98)), 4).alias("celsius"))


@query("crack_mechanics", """WITH c AS (SELECT p_partkey, (1 + p_partkey % 400) / 100.0::DOUBLE AS l, (20 + p_partkey % 80)::DOUBLE AS s FROM part), k AS (SELECT *, 1.12 * s * sqrt(pi() * l / 2) AS ki, 1.12 * 12 * sqrt(pi() * l / 2) AS dk, pow(32 / (1.12 * s), 2) / pi() AS ac FROM c),
f AS (SELECT *, least(100, greatest(0, ac / (l / 2))) AS fos, least(1, greatest(0, 1 - exp(-greatest(0, least(5, l / 2 / ac) - 0.8) * 1.4))) AS fp FROM k)
SELECT p_partkey, round(ki, 5) AS k_i, round(dk, 5) AS delta_k, round(fos, 5) AS fos, round(1e-9 * pow(dk, 3) * 1000, 8) AS step_m, round(fp, 6) AS failure_p, CASE WHEN fos < 1 OR fp > 0.5 THEN 'Critical' WHEN fos < 1.5 OR fp > 0.2 THEN 'High' WHEN fos < 3 OR fp > 0.05 THEN 'Medium' ELSE 'Low' END AS risk FROM f""")
def crack_mechanics(spark, sf):
    c = table(spark, sf, "part").selectExpr("p_partkey", "(1 + p_partkey % 400) / 100.0D AS l", "CAST(20 + p_partkey % 80 AS DOUBLE) AS s").withColumn("k", physics.stress_intensity("l", "s"))
    fp = physics.failure_probability("k.half_length_m", "k.a_crit_m")
    return c.select("p_partkey", *r(("k_i", F.col("k.k_i")), ("delta_k", F.col("k.delta_k")), ("fos", F.col("k.fos")), n=5), F.round(physics.paris_step("k.delta_k", F.lit(1e-9), F.lit(3.0), F.lit(1000.0)), 8).alias("step_m"),
                    F.round(fp, 6).alias("failure_p"), physics.crack_risk("k.fos", fp, F.lit(False)).alias("risk"))


@query("detection_floor", "SELECT p_partkey, round(sqrt(pow((p_partkey % 7) / 100.0, 2) + pow((p_partkey % 5) / 100.0, 2)) + abs((p_partkey % 3 - 1) / 50.0), 6) AS floor_m, round(1 - exp(-(p_partkey % 9) / 100.0 * 0.5), 6) AS p6 FROM part")
def detection_floor(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select("p_partkey", *r(("floor_m", physics.detection_floor((k % 7) / 100.0, (k % 5) / 100.0, (k % 3 - 1) / 50.0)), ("p6", physics.hazard_probability((k % 9) / 100.0, F.lit(0.5)))))


@query("names", """SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^a-z0-9]+', '_', 'g'), '_') AS canonical, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS tag FROM documents""")
def names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.canonical_name("text").alias("canonical"), text.normalise_tag("text").alias("tag"))


@query("classes_and_paths", """SELECT p_partkey, replace(replace(lower(p_name), ' ', '_'), '-', '_') AS class, regexp_replace(CAST(p_partkey % 10 AS VARCHAR) || ' ' || p_name, '^[0-9]+ +', '') AS cleaned, p_name || '.JPG' AS base, '.jpg' AS ext, p_name AS stem, 'asset_' || lower(replace(replace(p_brand, '#', '_'), ' ', '_')) AS slug FROM part""")
def classes_and_paths(spark, sf):
    p = table(spark, sf, "part").withColumn("path", F.concat(F.lit("/data/x.y/"), "p_name", F.lit(".JPG")))
    return p.select("p_partkey", text.normalise_class("p_name").alias("class"), text.clean_class_name(F.concat(F.lit("'"), (F.col("p_partkey") % 10).cast("string"), F.lit(" "), "p_name", F.lit("'"))).alias("cleaned"), text.base_name("path").alias("base"),
                    text.extension("path").alias("ext"), text.stem("path").alias("stem"), F.concat(F.lit("asset_"), text.slug("p_brand")).alias("slug"))


@query("payload_access", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def payload_access(spark, sf):
    return table(spark, sf, "events").select("event_id", text.payload("props", "$.k").cast("long").alias("k"))


@query("bands", """SELECT o_orderkey, CASE WHEN s >= 0.75 THEN 'immediate' WHEN s >= 0.55 THEN 'urgent' WHEN s >= 0.35 THEN 'planned' WHEN s >= 0.15 THEN 'monitor' ELSE 'record' END AS action, CAST(CASE WHEN s * 100 >= 85 THEN 1 WHEN s * 100 >= 70 THEN 2 WHEN s * 100 >= 55 THEN 3 WHEN s * 100 >= 40 THEN 4 ELSE 5 END AS INT) AS grade,
CASE o_orderkey % 5 WHEN 0 THEN 'autonomous' WHEN 1 THEN 'assisted' WHEN 2 THEN 'manual' ELSE 'unknown' END AS control, CAST(CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS INT) AS severity_rank, round(degrees(atan(o_orderkey % 30 / 100.0)), 6) AS slope_deg,
CASE WHEN o_orderkey % 30 > 0 THEN round(100.0 / (o_orderkey % 30), 6) END AS one_in FROM (SELECT o_orderkey, (o_orderkey % 101) / 100.0::DOUBLE AS s FROM orders)""")
def bands_query(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "(o_orderkey % 101) / 100.0D AS s", "CASE o_orderkey % 5 WHEN 0 THEN ' auto ' WHEN 1 THEN 'Loiter' WHEN 2 THEN 'FBWA' WHEN 3 THEN '' ELSE 'WARP' END AS m",
                                              "CASE o_orderkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS sev").withColumn("g", bands.describe_gradient(-(F.col("o_orderkey") % 30)))
    return o.select("o_orderkey", bands.action_band("s").alias("action"), bands.grade_of_integrity(F.col("s") * 100).alias("grade"), bands.control_mode("m").alias("control"), bands.severity_rank("sev").alias("severity_rank"),
                    *r(("slope_deg", F.col("g.slope_deg")), ("one_in", F.col("g.one_in"))))


@query("telemetry_warnings", cte("telemetry") + "SELECT seq, concat_ws(',', CASE WHEN battery_pct < 20 THEN 'Battery low' END, CASE WHEN gps_fix < 3 THEN 'GPS fix degraded' END, CASE WHEN link_quality_pct < 50 THEN 'Link quality low' END) AS warnings, CAST(gps_fix >= 2 AS INT) AS placed FROM telemetry")
def telemetry_warnings(spark, sf):
    return view(spark, sf, "telemetry").select("seq", F.array_join(bands.telemetry_warnings(), ",").alias("warnings"), bands.has_fix().cast("int").alias("placed"))


@query("date_expiry", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) < DATE '1998-01-01' THEN 'expired' WHEN CAST(o_orderdate AS DATE) - DATE '1998-01-01' <= 30 THEN 'expiring' ELSE 'valid' END AS state FROM orders")
def date_expiry(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.expiry(F.to_date("o_orderdate"), F.to_date(F.lit("1998-01-01"))).alias("state"))


@query("page", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 50 OFFSET 100")
def page(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name").orderBy("p_name", "p_partkey").offset(100).limit(50)


@query("latest_n", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def latest_n(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id")


@query("filter_rows", cte("defects_t1") + "SELECT defect_id FROM defects_t1 WHERE severity = 'high' AND review_state = 'accepted'")
def filter_rows(spark, sf):
    from fieldspark.operators.inspection import filter_rows as run
    return run(view(spark, sf, "defects_t1"), severity="high", review_state="accepted", defect_type=None).select("defect_id")


@query("union_detections", "SELECT origin, CAST(count(*) AS BIGINT) AS detections FROM (SELECT 'classical' AS origin FROM part UNION ALL SELECT 'model' FROM supplier) GROUP BY 1")
def union_detections(spark, sf):
    a = table(spark, sf, "part").select(F.lit("classical").alias("origin"), F.col("p_partkey").alias("id"))
    b = table(spark, sf, "supplier").select(F.lit("model").alias("origin"), F.col("s_suppkey").alias("id"))
    return a.unionByName(b).groupBy("origin").agg(F.count(F.lit(1)).alias("detections"))


@query("shared_keys", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def shared_keys(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")))


@query("distinct_values", cte("defects_t1") + "SELECT DISTINCT defect_type, image FROM defects_t1")
def distinct_values(spark, sf):
    return view(spark, sf, "defects_t1").select("defect_type", "image").distinct()


@query("merge_annotations", """WITH a AS (SELECT p_partkey AS id, p_partkey - p_partkey % 3 AS grp, p_size % 9 = 0 AS s FROM part) SELECT grp, CAST(count(*) AS BIGINT) AS parents, string_agg('c' || CAST(id AS VARCHAR), ',' ORDER BY id) AS claims,
CASE WHEN count(*) < 2 OR count(DISTINCT s) > 1 THEN 'refused' ELSE 'ok' END AS status FROM a GROUP BY 1""")
def merge_annotations(spark, sf):
    from fieldspark.operators.inspection import merge_annotations as run
    a = table(spark, sf, "part").selectExpr("p_partkey AS id", "p_partkey - p_partkey % 3 AS grp", "array(concat('c', p_partkey)) AS claims", "CASE WHEN p_size % 9 = 0 THEN 's1' ELSE 's0' END AS source", "4326 AS epsg")
    return run(a, "grp", "id").select("grp", "parents", F.array_join("claims", ",").alias("claims"), "status")


@query("split_annotation", "SELECT p_partkey AS parent_id, CAST(k AS INT) AS part_no FROM part, LATERAL (SELECT unnest(range(0, 1 + p_partkey % 3)) AS k)")
def split_annotation(spark, sf):
    from fieldspark.operators.inspection import split_annotation as run
    a = table(spark, sf, "part").selectExpr("p_partkey AS id", "sequence(0, CAST(p_partkey % 3 AS INT)) AS parts")
    return run(a, "parts", "id").select("parent_id", "part_no")


@query("validate_annotations", """WITH a AS (SELECT p_partkey AS k FROM part) SELECT k, concat_ws(',', CASE WHEN k % 7 = 0 THEN 'label_required' END, CASE WHEN k % 5 = 0 THEN 'severity_choice' END, CASE WHEN k % 4 = 3 THEN 'geometry' END, CASE WHEN k % 4 = 1 AND k % 6 = 1 THEN 'radius' END, CASE WHEN k % 4 = 2 AND k % 3 = 0 THEN 'line' END) AS broken FROM a""")
def validate_annotations(spark, sf):
    from fieldspark.operators.inspection import validate_annotations as run
    a = table(spark, sf, "part").selectExpr(
        "p_partkey AS k", "CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE 'x' END AS label", "CASE WHEN p_partkey % 5 = 0 THEN 'bad' ELSE 'info' END AS severity", "CASE p_partkey % 4 WHEN 0 THEN 'point' WHEN 1 THEN 'circle' WHEN 2 THEN 'line' ELSE 'text' END AS kind",
        "CASE p_partkey % 4 WHEN 2 THEN 'LineString' WHEN 3 THEN 'Polygon' ELSE 'Point' END AS geometry_type", "CASE WHEN p_partkey % 6 = 1 THEN 0D ELSE 2D END AS radius",
        "CASE WHEN p_partkey % 3 = 0 THEN array(named_struct('x', 0D, 'y', 0D)) ELSE array(named_struct('x', 0D, 'y', 0D), named_struct('x', 1D, 'y', 0D)) END AS ring")
    return run(a).select("k", F.array_join(F.transform("violations", lambda v: v["rule"]), ",").alias("broken"))


@query("validate_measurements", """WITH a AS (SELECT p_partkey AS k FROM part) SELECT k, concat_ws(',', CASE WHEN k % 4 = 3 THEN 'kind_choice' END, CASE WHEN k % 4 <> 3 AND k % 5 = 0 THEN 'unit' END, CASE WHEN k % 4 <> 1 AND k % 3 = 0 THEN 'sign' END, CASE WHEN k % 4 IN (0, 2) AND k % 7 = 0 THEN 'crs' END) AS broken FROM a""")
def validate_measurements(spark, sf):
    from fieldspark.operators.inspection import validate_measurements as run
    m = table(spark, sf, "part").selectExpr("p_partkey AS k", "CASE p_partkey % 4 WHEN 0 THEN 'area' WHEN 1 THEN 'temperature' WHEN 2 THEN 'volume' ELSE 'mood' END AS kind",
                                            "CASE WHEN p_partkey % 5 = 0 THEN 'furlong' ELSE CASE p_partkey % 4 WHEN 0 THEN 'm2' WHEN 1 THEN 'celsius' WHEN 2 THEN 'm3' ELSE 'x' END END AS unit",
                                            "CASE WHEN p_partkey % 3 = 0 THEN -1D ELSE 1D END AS value", "p_partkey % 7 <> 0 AS is_projected")
    return run(m).select("k", F.array_join(F.transform("violations", lambda v: v["rule"]), ",").alias("broken"))


@query("validate_instances", """WITH a AS (SELECT p_partkey AS k FROM part) SELECT k, concat_ws(',', CASE WHEN k % 5 = 0 THEN 'provenance' END, CASE WHEN k % 4 = 3 THEN 'taxonomy' END, CASE WHEN k % 4 = 2 THEN 'geometry' END, CASE WHEN k % 11 > 5 THEN 'confidence' END, CASE WHEN k % 13 = 0 THEN 'crs' END) AS broken FROM a""")
def validate_instances(spark, sf):
    from fieldspark.operators.inspection import validate_instances as run
    m = table(spark, sf, "part").selectExpr("p_partkey AS k", "CASE p_partkey % 4 WHEN 0 THEN 'Utility Pole' WHEN 1 THEN 'rail' WHEN 2 THEN 'panel' ELSE 'gnome' END AS asset_name", "CASE p_partkey % 4 WHEN 0 THEN 'MultiPoint' WHEN 1 THEN 'LineString' ELSE 'Point' END AS geometry_type",
                                            "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'm' END AS model_key", "'ab' AS model_sha256", "(p_partkey % 11) / 5.0D AS confidence", "CASE WHEN p_partkey % 13 <> 0 THEN 4326 END AS epsg")
    return run(m).select("k", F.array_join(F.transform("violations", lambda v: v["rule"]), ",").alias("broken"))
