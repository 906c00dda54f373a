"""Sources and sinks on whole tables: written by one side, read back by the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.plans.adapters import cte, table, view
from fieldspark.plans.flights import FIX
from fieldspark.plans.registry import query
from fieldspark.session import listing, scratch
from fieldspark.sources import readers, writers

TEL = cte("telemetry")


@query("write_track_gpx", TEL + f"""SELECT flight_id, CAST(count(*) AS BIGINT) AS points, round(sum(round(latitude, 8)), 6) AS lat_sum, round(sum(altitude_rel_m + 100), 2) AS ele_sum,
CAST(sum(seq % 15) AS BIGINT) AS sats, round(sum(round((seq % 40) / 8.0, 2)), 2) AS hdop_sum, strftime(min(date_trunc('second', ts)), '%Y-%m-%dT%H:%M:%SZ') AS first_time FROM telemetry WHERE {FIX} GROUP BY 1""")
def write_track_gpx(spark, sf):
    """The documents are parsed back as XML."""
    path = scratch(spark, "gpx")
    t = (view(spark, sf, "telemetry").withColumn("altitude_abs_m", F.col("altitude_rel_m") + 100).withColumn("satellites", F.col("seq") % 15)
         .withColumn("hdop", F.round((F.col("seq") % 40) / 8.0, 2)).withColumn("title", F.concat(F.lit("a <b> & "), F.col("flight_id").cast("string"))))
    writers.write_track(t, path, "gpx", name="title")
    with listing(spark):
        got = spark.read.schema("_lat double, _lon double, ele double, time string, sat long, hdop double, flight_id long").option("rowTag", "trkpt").option("basePath", path).xml(path)
    return got.groupBy("flight_id").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("_lat"), 6).alias("lat_sum"), F.round(F.sum("ele"), 2).alias("ele_sum"), F.sum("sat").alias("sats"),
                                        F.round(F.sum("hdop"), 2).alias("hdop_sum"), F.min("time").alias("first_time"))


@query("write_track_json", TEL + f"""SELECT flight_id, CAST(count(*) AS BIGINT) AS sample_count, CAST(count(*) FILTER (WHERE {FIX}) AS BIGINT) AS positioned_samples, CAST(count(*) FILTER (WHERE NOT {FIX}) AS BIGINT) AS samples_without_fix,
max(CASE WHEN {FIX} THEN altitude_rel_m END) AS max_altitude_rel_m, arg_min(battery_pct, (ts, seq)) FILTER (WHERE battery_pct > 0) AS battery_start_pct, CAST(arg_min(seq, (ts, seq)) AS BIGINT) AS first_seq, CAST(arg_max(seq, (ts, seq)) AS BIGINT) AS last_seq,
round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS last_elapsed FROM telemetry GROUP BY 1""")
def write_track_json(spark, sf):
    path = scratch(spark, "json")
    writers.write_track(view(spark, sf, "telemetry"), path, "json")
    schema = ("summary struct<sample_count: long, positioned_samples: long, samples_without_fix: long, max_altitude_rel_m: double, battery_start_pct: double>, "
              "samples array<struct<seq: long, elapsed_s: double>>, flight_id long")
    with listing(spark):
        got = spark.read.schema(schema).option("multiLine", "true").option("basePath", path).json(path)
    return got.select("flight_id", "summary.*", F.col("samples")[0]["seq"].alias("first_seq"), F.element_at("samples", -1)["seq"].alias("last_seq"), F.round(F.element_at("samples", -1)["elapsed_s"], 3).alias("last_elapsed"))


@query("read_control_points", """SELECT 'P' || chr(10) || 'point, ' || CAST(o_orderkey AS VARCHAR) || ' "x"' AS name, o_orderkey + 0.25 AS x, o_custkey + 0.5 AS y, round(o_totalprice, 2) AS z, CASE WHEN o_orderkey % 2 = 0 THEN 32617 ELSE 4326 END AS epsg,
CASE WHEN o_orderkey % 3 = 0 THEN 0.02 ELSE round(o_custkey % 7 / 100.0, 2) END AS accuracy_m FROM orders""")
def read_control_points(spark, sf):
    """One file per order status and day's remainder, with quoted separators, quotes and line breaks in names."""
    path = scratch(spark, "gcp")
    o = table(spark, sf, "orders")
    quoted = F.concat(F.lit('"P\npoint, '), F.col("o_orderkey").cast("string"), F.lit(' ""x"""'))
    acc = F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise((F.col("o_custkey") % 7 / -100.0).cast("string"))
    row = F.concat_ws(",", quoted, (F.col("o_orderkey") + 0.25).cast("string"), (F.col("o_custkey") + 0.5).cast("string"), F.format_string("%.2f", "o_totalprice"), F.when(F.col("o_orderkey") % 2 == 0, "32617").otherwise("4326"), acc)
    head = o.select("o_orderstatus").distinct().select("o_orderstatus", F.lit(0).alias("k"), F.lit("Label,Easting,Northing,Elevation,EPSG,Accuracy").alias("value"))
    lines = head.unionByName(o.select("o_orderstatus", F.lit(1).alias("k"), row.alias("value")))
    lines.repartition("o_orderstatus").sortWithinPartitions("o_orderstatus", "k").select("o_orderstatus", "value").write.partitionBy("o_orderstatus").text(path)
    return readers.read_control_points(spark, path).select("name", "x", "y", F.round("z", 2).alias("z"), "epsg", F.round("accuracy_m", 2).alias("accuracy_m"))


@query("track_kml_lines", TEL + f"SELECT flight_id, seq, printf('%.8f,%.8f,%.2f', longitude, latitude, altitude_rel_m) AS line FROM telemetry WHERE {FIX}")
def track_kml_lines(spark, sf):
    t = view(spark, sf, "telemetry").withColumn("altitude_abs_m", F.col("altitude_rel_m"))
    return writers.track_lines(t, "kml").where("part = 1").select("flight_id", "seq", "line")


@query("write_features", "SELECT p_partkey AS id, '[' || CAST(p_partkey % 89 AS VARCHAR) || '.5,' || CAST(p_partkey % 83 AS VARCHAR) || '.25]' AS coordinates FROM part")
def write_features(spark, sf):
    path = scratch(spark, "features")
    p = table(spark, sf, "part").selectExpr("p_partkey AS id", "array(named_struct('x', p_partkey % 89 + 0.5D, 'y', p_partkey % 83 + 0.25D)) AS ring")
    writers.write_features(p, path, "Point", "ring", ["id"])
    return spark.read.text(path).select(F.get_json_object("value", "$.properties.id").cast("long").alias("id"), F.get_json_object("value", "$.geometry.coordinates").alias("coordinates"))


@query("read_flight_log", TEL + "SELECT flight_id, CAST(count(*) AS BIGINT) AS samples, round(sum(battery_pct), 4) AS battery_sum, CAST(max(seq) AS BIGINT) AS last_seq FROM telemetry GROUP BY 1")
def read_flight_log(spark, sf):
    path = scratch(spark, "log")
    view(spark, sf, "telemetry").withColumn("flight_id", F.col("flight_id").cast("string")).write.json(path)
    log = readers.read_flight_log(spark, path)
    return log.groupBy(F.col("flight_id").cast("long").alias("flight_id")).agg(F.count(F.lit(1)).alias("samples"), F.round(F.sum("battery_pct"), 4).alias("battery_sum"), F.max("seq").alias("last_seq"))


@query("read_audit_log", "SELECT event_id, event_type AS action FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def read_audit_log(spark, sf):
    path = scratch(spark, "audit")
    table(spark, sf, "events").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS created_at", "CAST(user_id AS STRING) AS user_id", "event_type AS action", "'' AS resource", "props AS detail").write.json(path)
    return readers.read_audit_log(spark, path, limit=200).select("event_id", "action")


@query("read_camera_events", "SELECT event_id AS sequence, CAST(2200 + user_id % 50 AS INT) AS gps_week, CASE event_id % 4 WHEN 0 THEN 'fixed' WHEN 1 THEN 'float' WHEN 2 THEN 'single' ELSE 'unknown(7)' END AS solution, round(value / 1000, 8) AS north_m, CAST(epoch_us(TIMESTAMP '1980-01-06') + (2200 + user_id % 50) * 604800000000 + (event_id % 600000) * 1000000 + 500000 - 18000000 AS BIGINT) AS us FROM events")
def read_camera_events(spark, sf):
    path = scratch(spark, "mrk")
    e = table(spark, sf, "events")
    flag = F.expr("CASE event_id % 4 WHEN 0 THEN 50 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 7 END")
    e.select(F.concat_ws("\t", "event_id", F.concat((F.col("event_id") % 600000).cast("string"), F.lit(".5")), 2200 + F.col("user_id") % 50, F.concat("value", F.lit(",N")), F.concat(flag.cast("string"), F.lit(",Q"))).alias("value")).write.text(path)
    r = readers.read_camera_events(spark, path)
    return r.select(F.col("sequence").cast("long").alias("sequence"), "gps_week", "solution", F.round("north_m", 8).alias("north_m"), F.unix_micros("ts").alias("us"))


@query("read_points", "SELECT l_orderkey AS x, l_quantity AS y, round(l_extendedprice, 2) AS z FROM lineitem")
def read_points(spark, sf):
    path = scratch(spark, "points")
    li = table(spark, sf, "lineitem")
    li.select(F.concat_ws(" ", "l_orderkey", "l_quantity", F.format_string("%.2f", F.col("l_extendedprice")), F.lit("extra")).alias("value")).write.text(path)
    return readers.read_points(spark, path).select(F.col("x").cast("long").alias("x"), "y", F.round("z", 2).alias("z"))


@query("read_voc_boxes", """SELECT p_partkey AS id, 'crack' AS class_name, round((least(200, p_partkey % 150 + 80) + p_partkey % 150) / 2.0 / 200, 6) AS cx, round((least(200, p_partkey % 150 + 80) - p_partkey % 150) / 200.0, 6) AS bw FROM part""")
def read_voc_boxes(spark, sf):
    path = scratch(spark, "voc")
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    doc = F.format_string("<annotation><filename>%d.jpg</filename><size><width>200</width><height>100</height></size><object><name>crack</name><bndbox><xmin>%d</xmin><ymin>10</ymin><xmax>%d</xmax><ymax>20</ymax></bndbox></object></annotation>",
                          k, k % 150, k % 150 + 80)
    p.select(doc.alias("value")).write.text(path)
    b = readers.read_voc_boxes(spark, path, one_per_line=True)
    return b.select(F.regexp_replace("filename", "\\.jpg$", "").cast("long").alias("id"), "class_name", F.round("cx", 6).alias("cx"), F.round("bw", 6).alias("bw"))


@query("write_yolo_corpus", "SELECT CASE p_partkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, printf('%d %.6f %.6f %.6f %.6f', p_partkey % 4, (p_partkey % 100) / 100.0, 0.5, 0.1, 0.2) AS value FROM part")
def write_yolo_corpus(spark, sf):
    b = table(spark, sf, "part").selectExpr("CASE p_partkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split", "p_partkey AS sample_id", "CAST(p_partkey % 4 AS INT) AS class_id", "(p_partkey % 100) / 100.0D AS cx", "0.5D AS cy", "0.1D AS bw", "0.2D AS bh")
    return writers.yolo_lines(b).select("split", "value")


@query("write_manifest", cte("images") + "SELECT image_id, concat_ws(',', CASE WHEN sharpness < 100 THEN 'blurry' END, CASE WHEN greatest(dark_ratio, bright_ratio) > 0.10 THEN CASE WHEN dark_ratio > bright_ratio THEN 'underexposed' ELSE 'overexposed' END END, CASE WHEN gps_lat IS NULL THEN 'missing_gps' END) AS qa_flags FROM images")
def write_manifest(spark, sf):
    from fieldspark.operators.inspection import image_qa_flags
    path = scratch(spark, "manifest")
    writers.write_manifest(image_qa_flags(view(spark, sf, "images")), path)
    back = spark.read.option("header", "true").csv(path, schema=None)
    return back.select(F.col("image_id").cast("long").alias("image_id"), F.coalesce("qa_flags", F.lit("")).alias("qa_flags"))


@query("write_defect_table", cte("defects_t1") + "SELECT printf('| %s | %s | %.2f | %s | %d | (1, 2) |', image, defect_type, confidence + 0.001, severity, defect_id % 50) AS value FROM defects_t1")
def write_defect_table(spark, sf):
    d = view(spark, sf, "defects_t1").withColumn("image_path", F.concat(F.lit("d/"), "image")).withColumn("area_px", F.col("defect_id") % 50).withColumn("bbox", F.array(F.lit(1), F.lit(2))).withColumn("confidence", F.col("confidence") + 0.001)
    return writers.markdown_rows(d)


@query("upsert_table", "SELECT k, max(o_orderkey) AS seq, arg_max(o_orderpriority, o_orderkey) AS priority FROM (SELECT o_custkey AS k, o_orderkey, o_orderpriority FROM orders) GROUP BY 1")
def upsert_table(spark, sf):
    """Orders arrive in two batches by status; the table keeps the newest per customer."""
    path = scratch(spark, "table")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("priority"), "o_orderstatus")
    writers.upsert_table(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), path, ["k"], "seq")
    writers.upsert_table(o.where("o_orderstatus <> 'F'").drop("o_orderstatus"), path, ["k"], "seq")
    return writers.current_table(spark, path)


@query("record_lineage", "SELECT o_custkey AS artifact, CAST(count(*) AS BIGINT) AS source_count, array_to_string((list(CAST(o_orderkey AS VARCHAR) ORDER BY CAST(o_orderkey AS VARCHAR)))[1:5], ',') AS sources FROM orders GROUP BY 1")
def record_lineage(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("artifact"), F.col("o_orderkey").cast("string").alias("source"))
    a = o.select(F.col("artifact").alias("path")).distinct().withColumn("sha256", F.sha2(F.col("path").cast("string"), 256)).withColumn("size_bytes", F.lit(1))
    r = writers.lineage_rows(a, o, "engine", "{}", keep=5)
    return r.select("artifact", "source_count", F.array_join("sources", ",").alias("sources"))


@query("boundary_summary", cte("zones") + "SELECT zone_id, 4 AS vertices, round((x1 - x0) / 1000 * (y1 - y0) / 1000 * 111320 * 110540 * cos(radians((y0 + y1) / 2000)), 2) AS area_m2, round((x0 + x1) / 2000, 6) AS centroid_lon FROM zones")
def boundary_summary(spark, sf):
    from fieldspark.plans.rasters import zone_rings
    z = zone_rings(spark, sf, False).withColumn("ring", F.transform("ring", lambda p: F.struct((p["x"] / 1000).alias("x"), (p["y"] / 1000).alias("y"))))
    return readers.boundary_summary(z).select("zone_id", "vertices", F.round("area_m2", 2).alias("area_m2"), F.round("centroid_lon", 6).alias("centroid_lon"))


@query("bundle_from_folders", "WITH f AS (SELECT page_id % 7 AS b, page_id % 3 AS s, lpad(CAST(page_id AS VARCHAR), 9, '0') AS n FROM pages) SELECT 'site' || CAST(b AS VARCHAR) || '_bundle' AS bundle_id, CASE s WHEN 0 THEN 'rgb' WHEN 1 THEN 'thermal' ELSE 'multispectral' END AS sensor, n || '_nir' AS id, (row_number() OVER (PARTITION BY b, s ORDER BY n) - 1) * 200.0::DOUBLE AS t_ms FROM f")
def bundle_from_folders(spark, sf):
    p = table(spark, sf, "pages").select(F.expr("concat('/x/site', page_id % 7, '/', CASE page_id % 3 WHEN 0 THEN 'rgb' WHEN 1 THEN 'thermal' ELSE 'multispectral' END, '/', lpad(CAST(page_id AS STRING), 9, '0'), '_nir.jpg')").alias("path"))
    return readers.bundle_from_folders(p).select("bundle_id", "sensor", "id", "t_ms")


@query("validate_bundle", cte("frames") + """, v AS (SELECT bundle_id, count(*) AS n FROM frames WHERE sensor = 'view' GROUP BY 1), c AS (SELECT bundle_id, count(*) AS n, count(*) FILTER (WHERE value >= 50) AS bad FROM frames WHERE sensor = 'click' GROUP BY 1)
SELECT bundle_id, CAST(coalesce(v.n, 0) AS BIGINT) AS rgb_count, CAST(coalesce(c.n, 0) AS BIGINT) AS thermal_count, CAST(coalesce(v.n, 0) > 0 AND coalesce(bad, 0) = 0 AS INT) AS valid FROM v FULL JOIN c USING (bundle_id)""")
def validate_bundle(spark, sf):
    f = view(spark, sf, "frames")
    thermal = f.where("sensor = 'click'").withColumn("path", F.when(F.col("value") >= 50, F.lit("x.doc")).otherwise(F.col("path")))
    d = readers.validate_bundle({"rgb": f.where("sensor = 'view'"), "thermal": thermal})
    return d.select("bundle_id", "rgb_count", "thermal_count", F.col("valid").cast("int").alias("valid"))


@query("align_sensors", cte("frames") + """, r AS (SELECT * FROM frames WHERE sensor = 'view'), t AS (SELECT * FROM frames WHERE sensor = 'click'),
j AS (SELECT r.bundle_id, r.seq, abs(t.t_ms - r.t_ms) AS d, row_number() OVER (PARTITION BY r.bundle_id, r.seq ORDER BY abs(t.t_ms - r.t_ms), t.t_ms) AS k FROM r LEFT JOIN t ON t.bundle_id = r.bundle_id)
SELECT bundle_id, CAST(count(*) AS BIGINT) AS frame_count, round(100.0 * count(*) FILTER (WHERE d <= 120) / count(*), 4) AS thermal_match_pct, round(avg(d), 2) AS thermal_mean_ms FROM j WHERE k = 1 GROUP BY 1""")
def align_sensors(spark, sf):
    from fieldspark.operators import asof
    f = view(spark, sf, "frames").select("bundle_id", "t_ms", "seq", "path", "sensor", "value")
    pick = lambda kind: f.where(F.col("sensor") == kind)
    imu = pick("error").select("bundle_id", "t_ms", "seq", F.array("value", "value", "value").alias("accel"), F.array("value", "value", "value").alias("gyro"))
    gnss = pick("purchase").select("bundle_id", "t_ms", "seq", F.col("value").alias("lat"), F.col("value").alias("lon"), F.col("value").alias("alt_m"), F.lit("3d").alias("fix"))
    cols = ("bundle_id", "t_ms", "seq", "path")
    a = asof.align_sensors(pick("view").select(*cols), pick("click").select(*cols), {"nir": pick("signup").select(*cols)}, pick("signup").select(*cols), imu, gnss)
    s = asof.alignment_stats(a).where("reference_sensor = 'rgb'")
    return s.select("bundle_id", "frame_count", F.round("thermal_match_pct", 4).alias("thermal_match_pct"), F.round("thermal_mean_ms", 2).alias("thermal_mean_ms"))


_ALIGNED = cte("frames") + """, coarse AS (SELECT * REPLACE (floor(t_ms / 1000000) AS t_ms) FROM frames), f AS (SELECT bundle_id, t_ms, sensor, arg_min(path, seq) AS p1, arg_min(value, seq) AS v1, arg_max(value, seq) AS v2, count(*) AS c FROM coarse GROUP BY 1, 2, 3),
s AS (SELECT *, row_number() OVER (PARTITION BY bundle_id, sensor ORDER BY t_ms) AS k FROM f),
r AS (SELECT *, 'rgb' AS reference_sensor FROM coarse WHERE sensor = 'view'
  UNION ALL SELECT *, 'thermal' FROM coarse WHERE sensor = 'click' AND bundle_id NOT IN (SELECT bundle_id FROM coarse WHERE sensor = 'view')),
b AS (SELECT r.bundle_id, r.seq, r.t_ms, r.reference_sensor, n.name, lo.t_ms AS lt, lo.p1 AS lp, lo.v1 AS lv1, lo.v2 AS lv, lo.k AS lk, hi.t_ms AS ht, hi.p1 AS hp, hi.v1 AS hv
  FROM r, (VALUES ('click'), ('signup'), ('error'), ('purchase')) n(name)
  LEFT JOIN LATERAL (SELECT * FROM s WHERE s.bundle_id = r.bundle_id AND s.sensor = n.name AND s.t_ms <= r.t_ms ORDER BY s.t_ms DESC LIMIT 1) lo ON TRUE
  LEFT JOIN LATERAL (SELECT * FROM s WHERE s.bundle_id = r.bundle_id AND s.sensor = n.name AND s.t_ms > r.t_ms ORDER BY s.t_ms LIMIT 1) hi ON TRUE),
d AS (SELECT *, CASE WHEN lt IS NOT NULL AND (ht IS NULL OR t_ms - lt <= ht - t_ms) THEN t_ms - lt ELSE ht - t_ms END AS d,
  CASE WHEN lt IS NOT NULL AND (ht IS NULL OR t_ms - lt <= ht - t_ms) THEN lp ELSE hp END AS p,
  CASE WHEN lt IS NULL THEN hv WHEN lk = 1 AND lt = t_ms THEN lv1 WHEN ht IS NULL THEN lv ELSE lv + (hv - lv) * (t_ms - lt) / (ht - lt) END AS v FROM b)
SELECT bundle_id, seq AS ref_seq, min(reference_sensor) AS reference_sensor, max(CASE WHEN name = 'click' AND d <= 120 THEN p END) AS thermal_path, round(max(CASE WHEN name = 'click' THEN d END), 3) AS thermal_ms,
 max(CASE WHEN name = 'signup' AND d <= 120 THEN p END) AS nir_path, max(CASE WHEN name = 'signup' AND d <= 220 THEN p END) AS lidar_path, round(max(CASE WHEN name = 'signup' THEN d END), 3) AS lidar_ms,
 round(max(CASE WHEN name = 'error' AND d <= 50 THEN v END) + 1e-9, 4) AS accel_x, round(max(CASE WHEN name = 'error' AND d <= 50 THEN v + 1 END) + 1e-9, 4) AS gyro_z, round(max(CASE WHEN name = 'error' THEN d END), 3) AS imu_ms,
 round(max(CASE WHEN name = 'purchase' AND d <= 250 THEN v END) + 1e-9, 4) AS lat, max(CASE WHEN name = 'purchase' AND d <= 250 THEN '3d' END) AS fix, round(max(CASE WHEN name = 'purchase' THEN d END), 3) AS gnss_ms
FROM d GROUP BY 1, 2"""


@query("align_sensor_frames", _ALIGNED)
def align_sensor_frames(spark, sf):
    """Every reference frame with the values of all sensors; times are in steps of 1,000 s, so that equal times and all tolerances occur;
    halves are rounded up on both sides."""
    from fieldspark.operators import asof
    f = view(spark, sf, "frames").select("bundle_id", F.floor(F.col("t_ms") / 1_000_000).cast("double").alias("t_ms"), "seq", "path", "sensor", "value")
    pick = lambda kind: f.where(F.col("sensor") == kind)
    v = F.col("value")
    imu = pick("error").select("bundle_id", "t_ms", "seq", F.array(v, v, v).alias("accel"), F.array(v, v, v + 1).alias("gyro"))
    gnss = pick("purchase").select("bundle_id", "t_ms", "seq", v.alias("lat"), v.alias("lon"), v.alias("alt_m"), F.lit("3d").alias("fix"))
    cols = ("bundle_id", "t_ms", "seq", "path")
    a = asof.align_sensors(pick("view").select(*cols), pick("click").select(*cols), {"nir": pick("signup").select(*cols)}, pick("signup").select(*cols), imu, gnss, chunk_ms=500.0)
    ms = lambda c: F.round(f"{c}_delta", 3).alias(f"{c}_ms")
    return a.select("bundle_id", "ref_seq", "reference_sensor", "thermal_path", ms("thermal"), F.col("multispectral")["nir"].alias("nir_path"), "lidar_path", ms("lidar"), F.round(F.col("imu_accel")[0] + 1e-9, 4).alias("accel_x"),
                    F.round(F.col("imu_gyro")[2] + 1e-9, 4).alias("gyro_z"), ms("imu"), F.round(F.col("gnss_lat") + 1e-9, 4).alias("lat"), F.col("gnss_fix").alias("fix"), ms("gnss"))


@query("image_pixel_metrics", "SELECT vec_id, CAST(count(*) AS BIGINT) AS cells FROM (SELECT vec_id, unnest(embedding) FROM embeddings) GROUP BY 1")
def image_pixel_metrics(spark, sf):
    """Each vector, scaled to grey values, as a small picture of eight columns."""
    from fieldspark.plugins import image_pixel_metrics as run
    e = table(spark, sf, "embeddings")
    grey = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), ((v + 1) * 127).cast("int"))))
    rows = F.transform(F.sequence(F.lit(0), (F.size("g") / 8).cast("int") - 1), lambda i: F.slice("g", i * 8 + 1, F.lit(8)))
    m = run(e.withColumn("g", grey).withColumn("luma", rows).withColumn("n", F.size("g")).select("vec_id", "n", "luma"))
    return m.where("laplacian_var >= 0 AND p90 >= p10 AND length(average_hash) = 16").select("vec_id", F.col("n").cast("long").alias("cells"))


@query("write_measurements", "SELECT o_orderkey AS id, o_orderpriority AS kind, round(o_totalprice / 7, 5) AS value FROM orders")
def write_measurements(spark, sf):
    path = scratch(spark, "measurements")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), (F.col("o_totalprice").cast("double") / 7).alias("value"))
    writers.write_measurements(rows, path)
    return spark.read.schema("id long, kind string, value double").option("header", "true").csv(path).withColumn("value", F.round("value", 5))


@query("write_corpus_manifest", """WITH s AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, 'src' || CAST(p_size % 4 AS VARCHAR) AS source FROM part)
SELECT id, split, source, CAST(count(*) OVER (PARTITION BY split, source) AS BIGINT) AS samples FROM s""")
def write_corpus_manifest(spark, sf):
    path = scratch(spark, "corpus")
    s = table(spark, sf, "part").selectExpr("p_partkey AS id", "CASE p_partkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split", "concat('src', p_size % 4) AS source", "p_size AS site_id",
                                            "CASE WHEN p_partkey % 5 > 0 THEN '2024-01-01' END AS capture_date")
    writers.write_corpus_manifest(s, s.groupBy("split", "source").agg(F.count(F.lit(1)).alias("samples")), path)
    back = spark.read.schema("id long, split string, source string").json(f"{path}/samples")
    return back.join(spark.read.schema("split string, source string, samples long").json(f"{path}/counts"), ["split", "source"]).select("id", "split", "source", "samples")
