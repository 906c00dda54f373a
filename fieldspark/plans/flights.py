"""Telemetry tracks, run history, mission versions and sorties."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.operators import flights
from fieldspark.operators.ordered import block, time_chunk
from fieldspark.plans.adapters import cte, table, view
from fieldspark.plans.captures import hav
from fieldspark.plans.registry import query

DAY = 86400
TEL = cte("telemetry")
FIX = "(gps_fix >= 2 AND NOT (abs(latitude) < 1e-9 AND abs(longitude) < 1e-9))"
LEGS = TEL + f""",
fixes AS (SELECT flight_id, seq, ts, latitude AS lat, longitude AS lon, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon
          FROM telemetry WHERE {FIX} WINDOW w AS (PARTITION BY flight_id ORDER BY ts, seq)),
legs AS (SELECT flight_id, seq, {hav('p', '', 6371000.0)} AS leg_m FROM fixes)"""


@query("track_distance", LEGS + """
SELECT t.flight_id, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) AS duration_s, CAST(count(*) AS BIGINT) AS samples,
       round(coalesce(max(d.m), 0), 2) AS distance_m
FROM telemetry t LEFT JOIN (SELECT flight_id, sum(leg_m) AS m FROM legs GROUP BY 1) d USING (flight_id) GROUP BY 1""")
def track_distance(spark, sf):
    d = flights.track_distance(view(spark, sf, "telemetry"), seconds=DAY)
    return d.select("flight_id", F.round("duration_s", 3).alias("duration_s"), "samples", F.round("distance_m", 2).alias("distance_m"))


@query("flight_summary", LEGS + f"""
SELECT t.flight_id, CAST(count(*) AS BIGINT) AS samples, round(coalesce(max(d.m), 0), 2) AS distance_m, CAST(count(*) FILTER (WHERE {FIX}) AS BIGINT) AS positioned,
       max(CASE WHEN {FIX} THEN altitude_rel_m END) AS max_altitude_m, arg_min(battery_pct, (ts, seq)) FILTER (WHERE battery_pct > 0) AS battery_first,
       arg_max(battery_pct, (ts, seq)) FILTER (WHERE battery_pct > 0) AS battery_last
FROM telemetry t LEFT JOIN (SELECT flight_id, sum(leg_m) AS m FROM legs GROUP BY 1) d USING (flight_id) GROUP BY 1""")
def flight_summary(spark, sf):
    d = flights.flight_summary(view(spark, sf, "telemetry"), seconds=DAY)
    return d.select("flight_id", "samples", F.round("distance_m", 2).alias("distance_m"), "positioned", "max_altitude_m", "battery_first", "battery_last")


@query("flight_legs", LEGS + "SELECT flight_id, seq, round(leg_m, 3) AS leg_m FROM legs")
def flight_legs(spark, sf):
    return flights.legs(view(spark, sf, "telemetry"), seconds=DAY).select("flight_id", "seq", F.round("leg_m", 3).alias("leg_m"))


@query("elapsed", TEL + """SELECT flight_id, seq, round((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY flight_id))) / 1e6, 3) AS elapsed_s FROM telemetry""")
def elapsed(spark, sf):
    return flights.elapsed(view(spark, sf, "telemetry")).select("flight_id", "seq", F.round("elapsed_s", 3).alias("elapsed_s"))


@query("monotonic_check", TEL + """, o AS (SELECT flight_id, value AS v, lag(value) OVER (PARTITION BY flight_id ORDER BY seq) AS p FROM telemetry)
SELECT flight_id, CAST(bool_and(coalesce(p <= v, true)) AS INT) AS monotonic FROM o GROUP BY 1""")
def monotonic_check(spark, sf):
    return flights.monotonic_check(view(spark, sf, "telemetry"), ["flight_id"], "value", "seq").withColumn("monotonic", F.col("monotonic").cast("int"))


RUNS = cte("runs")


@query("health_trend", RUNS + """,
o AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY run_utc DESC, run_seq DESC) AS k, epoch_us(run_utc) / 86400e6 AS day FROM runs),
s AS (SELECT asset_id, count(*) AS n, CASE WHEN max(day) - min(day) >= 7 THEN coalesce(regr_slope(integrity_score, day), 0) ELSE 0 END AS slope FROM o GROUP BY 1),
j AS (SELECT s.asset_id, s.n, s.slope, a.integrity_score AS now, b.integrity_score AS prev, a.day - b.day AS days FROM s JOIN o a ON a.asset_id = s.asset_id AND a.k = 1
      LEFT JOIN o b ON b.asset_id = s.asset_id AND b.k = 2)
SELECT asset_id, CAST(n AS BIGINT) AS history_points, now AS integrity_score, prev AS previous_integrity, round(coalesce(now - prev, 0), 4) AS delta_integrity,
       round(coalesce(days, 0), 4) AS days_since_previous, round(slope, 4) AS slope_per_day, round(least(100, greatest(0, now + slope * 182.625)), 4) AS projected_6m,
       round(least(100, greatest(0, now + slope * 365.25)), 4) AS projected_12m,
       CASE WHEN slope * 30.4375 <= -1 THEN 'degrading' WHEN slope * 30.4375 >= 1 THEN 'improving' ELSE 'stable' END AS direction
FROM j""")
def health_trend(spark, sf):
    d = flights.health_trend(view(spark, sf, "runs"))
    r = [F.round(c, 4).alias(c) for c in ("delta_integrity", "days_since_previous", "slope_per_day", "projected_6m", "projected_12m")]
    return d.select("asset_id", "history_points", "integrity_score", "previous_integrity", *r, "direction")


@query("recent_runs", RUNS + """,
k AS (SELECT *, CONCAT('run-', lpad(CAST(run_seq AS VARCHAR), 12, '0')) AS run_name FROM runs ORDER BY run_name DESC LIMIT 160)
SELECT asset_id, run_seq FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY run_utc DESC, run_seq DESC) AS n FROM k) WHERE n <= 30""")
def recent_runs(spark, sf):
    named = view(spark, sf, "runs").withColumn("run_name", F.concat(F.lit("run-"), F.lpad(F.col("run_seq").cast("string"), 12, "0")))
    return flights.recent_runs(named, keep=30, folders=160).select("asset_id", "run_seq")


@query("growth_series", cte("images") + """,
g AS (SELECT dataset_id, arg_min(crack_ratio, image_id) AS initial, arg_max(crack_ratio, image_id) AS final, count(*) AS n FROM images GROUP BY 1)
SELECT dataset_id, round(initial, 4) AS initial, round(final, 4) AS final, round(CASE WHEN n >= 2 THEN greatest(0, final - initial) ELSE 0 END, 4) AS delta,
       round(least(1, CASE WHEN n >= 2 THEN greatest(0, final - initial) ELSE 0 END / 0.12), 4) AS growth_norm FROM g""")
def growth_series(spark, sf):
    g = flights.growth_series(view(spark, sf, "images"), "dataset_id", "image_id", "crack_ratio")
    return g.select("dataset_id", *[F.round(c, 4).alias(c) for c in ("initial", "final", "delta", "growth_norm")])


@query("neighbour_overlap", cte("images") + """,
o AS (SELECT dataset_id, image_id, CASE WHEN lag(image_id) OVER w IS NULL THEN NULL ELSE sharpness / 240 END AS p,
             lead(sharpness / 240) OVER w AS n FROM images WINDOW w AS (PARTITION BY dataset_id ORDER BY captured_at, image_id))
SELECT dataset_id, image_id, round(p, 4) AS prev_overlap, round(n, 4) AS next_overlap,
       CAST(least(coalesce(p, 0), coalesce(n, 0)) < 0.14 AS INT) AS low_overlap FROM o""")
def neighbour_overlap(spark, sf):
    im = view(spark, sf, "images").select("dataset_id", "image_id", "captured_at", (F.col("sharpness") / 240).alias("score"))
    d = flights.neighbour_overlap(im, order=["captured_at", "image_id"], score="score", chunk=[time_chunk("captured_at", DAY)])
    return d.select("dataset_id", "image_id", F.round("prev_overlap", 4).alias("prev_overlap"), F.round("next_overlap", 4).alias("next_overlap"),
                    F.col("low_overlap").cast("int").alias("low_overlap"))


VER = cte("versions")


@query("version_history", VER + """,
o AS (SELECT *, lag(altitude_m) OVER w AS pa, lag(overlap) OVER w AS po, lag(waypoints) OVER w AS pw, lag(geofence) OVER w AS pg FROM versions
      WINDOW w AS (PARTITION BY mission_id ORDER BY version_seq))
SELECT mission_id, version_seq, CASE WHEN pw IS NULL THEN NULL ELSE concat_ws(',', CASE WHEN abs(altitude_m - pa) > 1e-6 THEN 'altitude_m' END,
       CASE WHEN abs(overlap - po) > 1e-6 THEN 'overlap' END) END AS changed, waypoints - pw AS waypoint_delta,
       CAST(pw IS NOT NULL AND geofence <> pg AS INT) AS geofence_changed FROM o""")
def version_history(spark, sf):
    v = flights.version_history(view(spark, sf, "versions"), ["altitude_m", "overlap"], geometry=["geofence"])
    return v.select("mission_id", "version_seq", F.when(F.col("changed").isNotNull(), F.array_join("changed", ",")).alias("changed"), "waypoint_delta",
                    F.coalesce(F.col("geofence_changed"), F.lit(False)).cast("int").alias("geofence_changed"))


@query("next_version", VER + "SELECT mission_id, CAST(max(version_seq) + 1 AS BIGINT) AS next_version FROM versions GROUP BY 1")
def next_version(spark, sf):
    return flights.next_version(view(spark, sf, "versions"), num="version_seq")


PLAN = cte("planned")


@query("battery_splits", PLAN + """,
o AS (SELECT mission_id, idx, row_number() OVER (PARTITION BY mission_id ORDER BY idx) AS rn, count(*) OVER (PARTITION BY mission_id) AS n FROM planned)
SELECT mission_id, idx, CAST((rn - 1) // CAST(ceil(n / CAST(1 + mission_id % 4 AS DOUBLE)) AS BIGINT) + 1 AS BIGINT) AS sortie FROM o""")
def battery_splits(spark, sf):
    p = view(spark, sf, "planned")
    need = p.select("mission_id").distinct().withColumn("batteries_required", 1 + F.col("mission_id") % 4)
    return flights.battery_splits(p, need).select("mission_id", "idx", "sortie")


@query("overlapping_chunks", PLAN + """,
o AS (SELECT mission_id, idx, row_number() OVER (PARTITION BY mission_id ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY mission_id) AS n FROM planned),
l AS (SELECT *, CASE WHEN n <= 12 THEN 0 ELSE CAST(ceil((n - 12) / 8.0) AS BIGINT) END AS last0 FROM o),
m AS (SELECT *, CASE WHEN last0 > 0 AND n - last0 * 8 <= 4 THEN last0 - 1 ELSE last0 END AS last FROM l)
SELECT mission_id, idx, CAST(c.k AS BIGINT) AS chunk_no FROM m, LATERAL (SELECT unnest(range(0, last + 1)) AS k) c
WHERE pos >= c.k * 8 AND (pos < c.k * 8 + 12 OR c.k = last)""")
def overlapping_chunks(spark, sf):
    d = flights.overlapping_chunks(view(spark, sf, "planned"), 12, 4, key="mission_id", order=["idx"], chunk=[block("idx", 1e6)])
    return d.select("mission_id", "idx", "chunk_no")


@query("even_sample", PLAN + """,
o AS (SELECT mission_id, idx, row_number() OVER (PARTITION BY mission_id ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY mission_id) AS n FROM planned),
s AS (SELECT mission_id, n, CAST(floor(k * (n / 7.0)) AS BIGINT) AS pick FROM (SELECT DISTINCT mission_id, n FROM o), LATERAL (SELECT unnest(range(0, 7)) AS k) WHERE n > 7)
SELECT o.mission_id, o.idx FROM o LEFT JOIN s ON s.mission_id = o.mission_id AND s.pick = o.pos WHERE o.n <= 7 OR s.pick IS NOT NULL""")
def even_sample(spark, sf):
    return flights.even_sample(view(spark, sf, "planned"), 7, key="mission_id", order=["idx"], chunk=[block("idx", 1e6)]).select("mission_id", "idx")


@query("retain_latest", cte("org_events") + """
SELECT org_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY event_id DESC) AS n FROM org_events) WHERE n <= 100""")
def retain_latest(spark, sf):
    return flights.retain_latest(view(spark, sf, "org_events"), 100, key="org_id", order="event_id").select("org_id", "event_id")


@query("number_new_versions", """WITH saved AS (SELECT o_custkey AS mission_id, max(o_orderkey % 10) AS m FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_custkey AS mission_id, o_orderkey AS seq, CAST(coalesce(m, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS version_num
FROM orders LEFT JOIN saved ON mission_id = o_custkey WHERE o_orderstatus <> 'F'""")
def number_new_versions(spark, sf):
    """Finished orders are the saved versions, the others arrive as new ones."""
    o = table(spark, sf, "orders")
    saved = o.where("o_orderstatus = 'F'").selectExpr("o_custkey AS mission_id", "o_orderkey % 10 AS version_num")
    new = o.where("o_orderstatus <> 'F'").selectExpr("o_custkey AS mission_id", "o_orderkey AS seq")
    return flights.number_new_versions(saved, new, key="mission_id", num="version_num", seq="seq").select("mission_id", "seq", F.col("version_num").cast("long").alias("version_num"))
