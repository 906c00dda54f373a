"""Fleet, usage, uploads, jobs, estimates, readiness and organisation events."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.operators import fleet
from fieldspark.plans.adapters import cte, table, view
from fieldspark.plans.registry import query


def r4(*cols, n=4):
    return [F.round(c, n).alias(c) for c in cols]


PILOTS = """pilots AS (SELECT c_custkey AS pilot_id, c_nationkey AS organization_id, CAST(DATE '2024-01-01' + CAST(c_custkey % 90 - 20 AS INT) AS DATE) AS licence_expires_on,
CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(DATE '2024-01-01' + CAST(c_custkey % 70 - 5 AS INT) AS DATE) END AS medical_expires_on FROM customer)"""


def pilots(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS pilot_id", "c_nationkey AS organization_id", "date_add(DATE '2024-01-01', CAST(c_custkey % 90 - 20 AS INT)) AS licence_expires_on",
        "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE date_add(DATE '2024-01-01', CAST(c_custkey % 70 - 5 AS INT)) END AS medical_expires_on")


TODAY = "2024-01-10"


@query("fleet_status", cte("aircraft", "batteries") + f""", {PILOTS},
a AS (SELECT organization_id, count(*) AS aircraft, count(*) FILTER (WHERE greatest(0, hours_total - hours_at_service) >= greatest(1, service_interval_h)) AS service_due, count(*) FILTER (WHERE status = 'grounded') AS grounded FROM aircraft GROUP BY 1),
b AS (SELECT organization_id, count(*) AS batteries, count(*) FILTER (WHERE cycle_count >= cycle_limit) AS past_limit, count(*) FILTER (WHERE retired) AS retired FROM batteries GROUP BY 1),
x AS (SELECT *, coalesce(licence_expires_on < DATE '{TODAY}', false) OR coalesce(medical_expires_on < DATE '{TODAY}', false) AS expired,
      coalesce(licence_expires_on - DATE '{TODAY}' <= 30, false) OR coalesce(medical_expires_on - DATE '{TODAY}' <= 30, false) AS near FROM pilots),
p AS (SELECT organization_id, count(*) AS pilots, count(*) FILTER (WHERE expired) AS not_current, count(*) FILTER (WHERE NOT expired AND near) AS expiring_soon FROM x GROUP BY 1)
SELECT organization_id, CAST(coalesce(aircraft, 0) AS BIGINT) AS aircraft, CAST(coalesce(service_due, 0) AS BIGINT) AS service_due, CAST(coalesce(grounded, 0) AS BIGINT) AS grounded,
  CAST(coalesce(batteries, 0) AS BIGINT) AS batteries, CAST(coalesce(past_limit, 0) AS BIGINT) AS past_limit, CAST(coalesce(retired, 0) AS BIGINT) AS retired,
  CAST(coalesce(pilots, 0) AS BIGINT) AS pilots, CAST(coalesce(not_current, 0) AS BIGINT) AS not_current, CAST(coalesce(expiring_soon, 0) AS BIGINT) AS expiring_soon
FROM a FULL JOIN b USING (organization_id) FULL JOIN p USING (organization_id)""")
def fleet_status(spark, sf):
    return fleet.fleet_status(view(spark, sf, "aircraft"), view(spark, sf, "batteries"), pilots(spark, sf), F.to_date(F.lit(TODAY)))


@query("battery_status", cte("batteries") + """SELECT battery_id, CAST(cycle_count >= cycle_limit AS INT) AS past_limit,
concat_ws(',', CASE WHEN cycle_count >= cycle_limit THEN 'past_cycle_limit' END, CASE WHEN health_pct < 80 THEN 'low_health' END, CASE WHEN retired THEN 'retired' END) AS warnings FROM batteries""")
def battery_status(spark, sf):
    return fleet.battery_status(view(spark, sf, "batteries")).select("battery_id", F.col("past_limit").cast("int").alias("past_limit"), F.array_join("warnings", ",").alias("warnings"))


@query("fleet_usage", cte("usage") + """SELECT aircraft_id, round(coalesce(sum(flight_hours) FILTER (WHERE flight_hours > 0), 0), 4) AS flight_hours, CAST(count(*) FILTER (WHERE flight_hours > 0) AS BIGINT) AS flights,
CAST(count(battery_health) AS BIGINT) AS cycles, arg_max(least(100, greatest(0, battery_health)), (ts, seq)) FILTER (WHERE battery_health IS NOT NULL) AS battery_health_pct,
arg_max(service_hours, (ts, seq)) FILTER (WHERE service_hours IS NOT NULL) AS last_service_hours FROM usage GROUP BY 1""")
def fleet_usage(spark, sf):
    return fleet.fleet_usage(view(spark, sf, "usage")).select("aircraft_id", *r4("flight_hours"), "flights", "cycles", "battery_health_pct", "last_service_hours")


@query("pilot_usage", cte("usage") + "SELECT pilot_id, round(coalesce(sum(flight_hours) FILTER (WHERE flight_hours > 0), 0), 4) AS flight_hours, CAST(count(*) FILTER (WHERE flight_hours > 0) AS BIGINT) AS flights FROM usage GROUP BY 1")
def pilot_usage(spark, sf):
    return fleet.pilot_usage(view(spark, sf, "usage")).select("pilot_id", *r4("flight_hours"), "flights")


@query("upload_completeness", cte("uploads") + """,
u AS (SELECT o_orderkey AS upload_id, 500 + o_orderkey % 900 AS total_bytes, 200 AS chunk_size FROM orders),
g AS (SELECT upload_id, list(DISTINCT chunk) AS got, sum(chunk_bytes) AS received FROM uploads GROUP BY 1),
m AS (SELECT u.*, CAST(ceil(total_bytes / 200.0) AS BIGINT) AS want, coalesce(got, []) AS got, coalesce(received, 0) AS received FROM u LEFT JOIN g USING (upload_id))
SELECT upload_id, CAST(want AS INT) AS expected_chunks, CAST(received AS BIGINT) AS received_bytes, array_to_string(list_sort(list_filter(range(0, want), lambda k: NOT list_contains(got, k))), ',') AS missing_chunks FROM m""")
def upload_completeness(spark, sf):
    u = table(spark, sf, "orders").select(F.col("o_orderkey").alias("upload_id"), (500 + F.col("o_orderkey") % 900).alias("total_bytes"), F.lit(200).alias("chunk_size"))
    c = view(spark, sf, "uploads").withColumnRenamed("chunk_bytes", "bytes")
    d = fleet.upload_completeness(u, c)
    return d.select("upload_id", "expected_chunks", "received_bytes", F.array_join(F.transform("missing_chunks", lambda k: k.cast("string")), ",").alias("missing_chunks"))


@query("missing_sequence", """SELECT o_orderkey AS upload_id FROM orders EXCEPT ALL SELECT DISTINCT l_orderkey FROM lineitem""")
def missing_sequence(spark, sf):
    return fleet.missing_sequence(table(spark, sf, "orders").select(F.col("o_orderkey").alias("upload_id")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("upload_id")).distinct())


@query("job_report", """SELECT o_custkey AS project_id, CAST(count(*) AS BIGINT) AS jobs, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS running, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS queued,
round(max(epoch_us(TIMESTAMP '2002-01-01') - epoch_us(o_orderdate)) FILTER (WHERE o_orderstatus = 'O') / 1e6, 1) AS longest_wait_s, CAST(count(*) FILTER (WHERE o_orderkey % 4 > 1) AS BIGINT) AS retried FROM orders GROUP BY 1""")
def job_report(spark, sf):
    j = table(spark, sf, "orders").selectExpr("o_custkey AS project_id", "CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'O' THEN 'queued' ELSE 'done' END AS status",
                                              "CAST(o_orderdate AS TIMESTAMP) AS queued_at", "o_orderkey % 4 AS attempts")
    return fleet.job_report(j, F.expr("TIMESTAMP '2002-01-01 00:00:00'"), "project_id").withColumn("longest_wait_s", F.round("longest_wait_s", 1))


@query("mission_estimates", """WITH p AS (SELECT p_partkey AS mission_id, p_size * 20 AS image_count, 4000 + p_partkey % 3 * 500 AS w, 3000 AS h, CAST(p_partkey % 90 AS DOUBLE) AS t, 30.0::DOUBLE AS e, CAST(p_partkey % 7 * 5 AS DOUBLE) + 10 AS rsv FROM part)
SELECT mission_id, CAST(w * h * 0.4 * image_count AS BIGINT) AS total_bytes, CAST(greatest(1, ceil(t / (e * (1 - rsv / 100)))) AS BIGINT) AS batteries_required, CAST(t <= e * (1 - rsv / 100) AS INT) AS fits, CAST(rsv < 15 AS INT) AS thin_reserve FROM p""")
def mission_estimates(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey AS mission_id", "p_size * 20 AS image_count", "4000 + p_partkey % 3 * 500 AS image_w_px", "3000 AS image_h_px",
                                            "CAST(p_partkey % 90 AS DOUBLE) AS flight_time_min", "30.0D AS endurance_min", "CAST(p_partkey % 7 * 5 AS DOUBLE) + 10 AS reserve_pct")
    d = fleet.mission_estimates(p)
    return d.select("mission_id", "total_bytes", "batteries_required", F.col("fits").cast("int").alias("fits"), F.col("thin_reserve").cast("int").alias("thin_reserve"))


SEGMENTS = """WITH p AS (SELECT p_size AS mission_id, p_partkey AS idx, CASE WHEN p_size % 10 = 3 AND p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 4 END AS segment, p_partkey % 5 < p_size % 6 AS done FROM part),
r AS (SELECT mission_id FROM p GROUP BY 1 HAVING count(*) FILTER (WHERE segment IS NULL) > 0),
g AS (SELECT mission_id, segment, count(*) AS n, count(*) FILTER (WHERE done) AS k FROM p WHERE mission_id NOT IN (SELECT mission_id FROM r) GROUP BY 1, 2)
"""


@query("segment_progress", SEGMENTS + """SELECT mission_id, CAST(segment AS INT) AS segment, CAST(n AS BIGINT) AS planned, CAST(k AS BIGINT) AS completed, round(100.0 * k / n, 4) AS percent,
CASE WHEN k = n THEN 'complete' WHEN k = 0 THEN 'not_started' ELSE 'partial' END AS state, CAST(NULL AS VARCHAR) AS reason FROM g
UNION ALL SELECT mission_id, NULL, NULL, NULL, NULL, 'refused', 'capture points without a segment' FROM r""")
def segment_progress(spark, sf):
    return segments(spark, sf).withColumn("percent", F.round("percent", 4))


def segments(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_size AS mission_id", "p_partkey AS idx", "CASE WHEN p_size % 10 = 3 AND p_partkey % 7 = 0 THEN 'orbit' ELSE CONCAT('linked_seg', p_partkey % 4, ':strip') END AS primitive", "p_partkey % 5 < p_size % 6 AS done")
    return fleet.segment_progress(p, p.where("done"))


@query("next_segment", SEGMENTS + """, m AS (SELECT mission_id, min(CASE WHEN k > 0 AND k < n THEN segment END) AS part, min(CASE WHEN k = 0 THEN segment END) AS todo FROM g GROUP BY 1)
SELECT mission_id, CAST(coalesce(part, todo) AS INT) AS next_segment, CASE WHEN part IS NOT NULL THEN 'finish' WHEN todo IS NOT NULL THEN 'start' ELSE 'none' END AS action FROM m
UNION ALL SELECT mission_id, NULL, 'none' FROM r""")
def next_segment(spark, sf):
    return fleet.next_segment(segments(spark, sf))


SPEC = "SELECT p_partkey AS site, CASE p_partkey % 3 WHEN 0 THEN 'a' ELSE 'b' END AS camera, CAST(50 + p_partkey % 7 AS DOUBLE) AS altitude_m, CAST(70 + p_partkey % 3 AS DOUBLE) AS front_overlap, CAST(60 AS DOUBLE) AS side_overlap, (50 + p_partkey % 7) / 20.0{d} AS gsd_cm FROM {t}"
SPEC2 = "SELECT p_partkey AS site, 'b' AS camera, CAST(53 AS DOUBLE) AS altitude_m, CAST(71 + p_partkey % 2 AS DOUBLE) AS front_overlap, CAST(60 + p_partkey % 4 AS DOUBLE) AS side_overlap, 53 / 20.0{d} AS gsd_cm FROM {t}"


@query("repeat_comparability", f"""WITH a AS ({SPEC.format(d='::DOUBLE', t='part')}), b AS ({SPEC2.format(d='::DOUBLE', t='part')})
SELECT a.site, concat_ws(',', CASE WHEN a.camera <> b.camera THEN 'camera' END, CASE WHEN abs(a.altitude_m - b.altitude_m) > 1 THEN 'altitude' END, CASE WHEN abs(a.front_overlap - b.front_overlap) > 1 THEN 'front overlap' END,
CASE WHEN abs(a.side_overlap - b.side_overlap) > 1 THEN 'side overlap' END) AS differences, round(100 * abs(b.gsd_cm - a.gsd_cm) / a.gsd_cm, 4) AS gsd_difference_pct, CAST(abs(b.gsd_cm - a.gsd_cm) / a.gsd_cm <= 0.05 AS INT) AS comparable
FROM a JOIN b USING (site)""")
def repeat_comparability(spark, sf):
    p = table(spark, sf, "part")
    a, b = spark.sql(SPEC.format(d="D", t="{p}"), p=p), spark.sql(SPEC2.format(d="D", t="{p}"), p=p)
    d = fleet.repeat_comparability(a, b, ["site"])
    return d.select("site", F.array_join("differences", ",").alias("differences"), *r4("gsd_difference_pct"), F.col("comparable").cast("int").alias("comparable"))


@query("preflight_checks", """WITH r AS (SELECT c_custkey AS k FROM customer),
s AS (SELECT k, CASE WHEN k % 7 >= 5 THEN 'pass' WHEN k % 7 >= 3 AND k % 12 >= 8 THEN 'pass' WHEN k % 7 >= 3 THEN 'warn' ELSE 'block' END AS gps, k % 10 <> 0 AS home, CASE WHEN k % 100 < 15 THEN 'block' WHEN k % 100 < 30 THEN 'warn' ELSE 'pass' END AS bat,
 CASE k % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'block' ELSE 'warn' END AS fence, CASE k % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'block' ELSE 'warn' END AS compass, CASE k % 5 WHEN 0 THEN 'block' WHEN 1 THEN 'warn' ELSE 'pass' END AS mission FROM r)
SELECT k AS mission_id, gps AS gps_status, bat AS battery, fence AS geofence, compass, mission AS mission_valid,
 concat_ws(',', CASE WHEN gps = 'block' THEN 'gps_status' END, CASE WHEN NOT home THEN 'home_position' END, CASE WHEN bat = 'block' AND k % 2 = 0 THEN 'battery' END, CASE WHEN mission = 'block' THEN 'mission_valid' END, CASE WHEN fence = 'block' THEN 'geofence' END, CASE WHEN compass = 'block' THEN 'compass' END) AS blocking FROM s""")
def preflight_checks(spark, sf):
    r = table(spark, sf, "customer").selectExpr(
        "c_custkey AS mission_id", "c_custkey % 7 AS gps_fix", "c_custkey % 12 AS satellites", "c_custkey % 10 <> 0 AS home_set", "CAST(c_custkey % 100 AS DOUBLE) AS battery_pct", "true AS rth_ok",
        "CASE c_custkey % 5 WHEN 0 THEN array('Error: no path') WHEN 1 THEN array('note') ELSE array() END AS issues", "CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS geofence_inside",
        "0 AS no_fly_conflicts", "CASE c_custkey % 4 WHEN 0 THEN 'healthy' WHEN 1 THEN 'unhealthy' WHEN 2 THEN 'absent' ELSE 'unknown' END AS compass_state", "'healthy' AS imu_state",
        "CASE WHEN c_custkey % 2 = 1 THEN array('battery') ELSE array() END AS confirmed")
    d = fleet.preflight_checks(r)
    return d.select("mission_id", "gps_status", "battery", "geofence", "compass", "mission_valid", F.array_join("blocking", ",").alias("blocking"))


@query("request_metrics", """SELECT event_type AS route, CAST(count(*) AS BIGINT) AS requests, round(sum(value / 100), 3) AS duration_sum, CAST(count(*) FILTER (WHERE value / 100 <= 0.05) AS BIGINT) AS le_0_05,
CAST(count(*) FILTER (WHERE value / 100 <= 0.5) AS BIGINT) AS le_0_5, CAST(count(*) FILTER (WHERE value / 100 <= 1.0) AS BIGINT) AS le_1_0 FROM events GROUP BY 1""")
def request_metrics(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("route"), (F.col("value") / 100).alias("duration"))
    return fleet.request_metrics(e, [0.05, 0.5, 1.0], ["route"]).withColumn("duration_sum", F.round("duration_sum", 3))


@query("route_subscriptions", """WITH w AS (SELECT s_suppkey AS webhook_id, s_nationkey % 5 AS org_id, CASE s_suppkey % 3 WHEN 0 THEN ['click', 'error'] WHEN 1 THEN ['view'] ELSE ['signup', 'purchase'] END AS ev, s_suppkey % 4 <> 0 AS active FROM supplier)
SELECT e.event_id, w.webhook_id FROM events e JOIN w ON w.org_id = e.user_id % 5 AND list_contains(w.ev, e.event_type) WHERE w.active""")
def route_subscriptions(spark, sf):
    from fieldspark.streaming.flows import route
    return route(view(spark, sf, "org_events").select("event_id", "org_id", "event"), webhooks(spark, sf), ["event_id"]).select("event_id", "webhook_id")


def webhooks(spark, sf):
    return table(spark, sf, "supplier").selectExpr("s_suppkey AS webhook_id", "CAST(s_nationkey % 5 AS BIGINT) AS org_id",
                                                   "CASE s_suppkey % 3 WHEN 0 THEN array('click', 'error') WHEN 1 THEN array('view') ELSE array('signup', 'purchase') END AS events", "s_suppkey % 4 <> 0 AS active")
