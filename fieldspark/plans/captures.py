"""Planned-versus-flown matching, defect epochs, sensor alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldspark.operators import asof, capture
from fieldspark.plans.adapters import cte, table, view
from fieldspark.plans.registry import query

HAV = "2 * {r} * asin(sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)))"


def hav(a: str, b: str, r: float = 6371008.8) -> str:
    return HAV.format(a=a, b=b, r=r)


# Greedy one-to-one matching: all groups step through their own sorted pair list together.
GREEDY = """
cand AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY d, l, r) AS k FROM pairs),
walk(g, k, ls, rs, l, r, d) AS (
  SELECT g, k, [l], [r], l, r, d FROM cand WHERE k = 1
  UNION ALL
  SELECT c.g, c.k,
         CASE WHEN list_contains(w.ls, c.l) OR list_contains(w.rs, c.r) THEN w.ls ELSE list_append(w.ls, c.l) END,
         CASE WHEN list_contains(w.ls, c.l) OR list_contains(w.rs, c.r) THEN w.rs ELSE list_append(w.rs, c.r) END,
         CASE WHEN list_contains(w.ls, c.l) OR list_contains(w.rs, c.r) THEN NULL ELSE c.l END,
         CASE WHEN list_contains(w.ls, c.l) OR list_contains(w.rs, c.r) THEN NULL ELSE c.r END,
         CASE WHEN list_contains(w.ls, c.l) OR list_contains(w.rs, c.r) THEN NULL ELSE c.d END
  FROM walk w JOIN cand c ON c.g = w.g AND c.k = w.k + 1),
matched AS MATERIALIZED (SELECT g, l, r, d FROM walk WHERE l IS NOT NULL)
"""

CAPTURE_CTE = cte("planned", "captured") + f""",
pairs AS (SELECT p.mission_id AS g, p.idx AS l, c.image_seq AS r, {hav('p.', 'c.')} AS d
          FROM planned p JOIN captured c ON p.mission_id = c.mission_id AND c.lon IS NOT NULL
          WHERE {hav('p.', 'c.')} <= 15),
{GREEDY}"""


def matches(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs without altitudes, which only ``match_captures`` reports."""
    return capture.pair_captures(view(spark, sf, "planned"), view(spark, sf, "captured"))


@query("match_captures", CAPTURE_CTE + """
SELECT m.g AS mission_id, m.l AS idx, m.r AS image_seq, round(m.d, 4) AS distance_m, round(c.alt_m - p.alt_m, 4) AS altitude_diff_m
FROM matched m JOIN planned p ON p.mission_id = m.g AND p.idx = m.l JOIN captured c ON c.mission_id = m.g AND c.image_seq = m.r""")
def match_captures(spark, sf):
    d = capture.match_captures(view(spark, sf, "planned"), view(spark, sf, "captured"))
    return d.select("mission_id", "idx", "image_seq", F.round("distance_m", 4).alias("distance_m"), F.round("altitude_diff_m", 4).alias("altitude_diff_m"))


@query("capture_coverage", CAPTURE_CTE + """,
p AS (SELECT mission_id, count(*) AS n FROM planned GROUP BY 1),
i AS (SELECT mission_id, count(*) AS n, count(lon) AS placed FROM captured GROUP BY 1),
m AS (SELECT g AS mission_id, count(*) AS n FROM matched GROUP BY 1)
SELECT mission_id, CAST(coalesce(p.n, 0) AS BIGINT) AS planned, CAST(coalesce(i.n, 0) AS BIGINT) AS images, CAST(coalesce(m.n, 0) AS BIGINT) AS matched,
       CAST(coalesce(p.n, 0) - coalesce(m.n, 0) AS BIGINT) AS missed, CAST(coalesce(i.placed, 0) - coalesce(m.n, 0) AS BIGINT) AS unplanned,
       CAST(coalesce(i.n - i.placed, 0) AS BIGINT) AS ungeotagged, round(100.0 * coalesce(m.n, 0) / p.n, 4) AS coverage_pct
FROM p FULL JOIN i USING (mission_id) LEFT JOIN m USING (mission_id)""")
def capture_coverage(spark, sf):
    return capture.coverage(view(spark, sf, "planned"), view(spark, sf, "captured"), matches(spark, sf)).withColumn("coverage_pct", F.round("coverage_pct", 4))


@query("capture_statuses", CAPTURE_CTE + """
SELECT p.mission_id, p.idx AS item, 'missed' AS status FROM planned p LEFT JOIN matched m ON m.g = p.mission_id AND m.l = p.idx WHERE m.l IS NULL
UNION ALL
SELECT c.mission_id, c.image_seq, CASE WHEN c.lon IS NULL THEN 'ungeotagged' ELSE 'unplanned' END
FROM captured c LEFT JOIN matched m ON m.g = c.mission_id AND m.r = c.image_seq WHERE m.r IS NULL""")
def capture_statuses(spark, sf):
    return capture.unmatched(view(spark, sf, "planned"), view(spark, sf, "captured"), matches(spark, sf))


@query("capture_deviation", CAPTURE_CTE + """,
o AS (SELECT g, d, row_number() OVER (PARTITION BY g ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY g) AS n FROM matched)
SELECT g AS mission_id, round(avg(d), 4) AS mean_m, round(max(CASE WHEN k = n // 2 THEN d END), 4) AS median_m, round(max(d), 4) AS max_m,
       CAST(sum(CASE WHEN d > 8 THEN 1 ELSE 0 END) AS BIGINT) AS over_warning FROM o GROUP BY g""")
def capture_deviation(spark, sf):
    d = capture.deviation(matches(spark, sf))
    return d.select("mission_id", *[F.round(c, 4).alias(c) for c in ("mean_m", "median_m", "max_m")], "over_warning")


@query("pose_priors", CAPTURE_CTE + """
SELECT m.g AS mission_id, split_part(c.path, '/', 2) AS image, round(p.lon, 6) AS lon, round(p.lat, 6) AS lat, p.alt_m AS alt_m, p.yaw AS yaw
FROM matched m JOIN planned p ON p.mission_id = m.g AND p.idx = m.l JOIN captured c ON c.mission_id = m.g AND c.image_seq = m.r""")
def pose_priors(spark, sf):
    d = capture.pose_priors(matches(spark, sf), view(spark, sf, "planned"), view(spark, sf, "captured"))
    return d.select("mission_id", "image", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "alt_m", "yaw")


@query("remaining_captures", CAPTURE_CTE + """
SELECT p.mission_id, p.idx, CAST(row_number() OVER (PARTITION BY p.mission_id ORDER BY p.idx) AS BIGINT) AS remaining_no
FROM planned p LEFT JOIN matched m ON m.g = p.mission_id AND m.l = p.idx WHERE m.l IS NULL""")
def remaining_captures(spark, sf):
    return capture.remaining(view(spark, sf, "planned"), matches(spark, sf).select("mission_id", "idx"))


@query("site_verdict", CAPTURE_CTE + """,
flown AS (SELECT mission_id, lon, lat, alt_m FROM captured UNION ALL SELECT 1000000 + s_nationkey, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_acctbal / 100 END, 41.0, 60.0 FROM supplier),
q AS (SELECT mission_id, count(*) AS n, sum(CASE WHEN alt_m < 59 THEN 1 ELSE 0 END) AS flagged, sum(CASE WHEN lon IS NULL THEN 1 ELSE 0 END) AS unread FROM flown GROUP BY 1),
g AS (SELECT mission_id, count(*) FILTER (WHERE lon IS NULL OR lat IS NULL) AS bare FROM flown GROUP BY 1),
d AS (SELECT p.mission_id, 100.0 * count(m.l) / count(*) AS pct, count(*) - count(m.l) AS missed FROM planned p LEFT JOIN matched m ON m.g = p.mission_id AND m.l = p.idx GROUP BY 1),
c AS (SELECT g.mission_id, d.pct, coalesce(missed, 0) AS missed FROM g LEFT JOIN d USING (mission_id))
SELECT c.mission_id, round(c.pct, 4) AS coverage_pct, CAST(unread AS BIGINT) AS unreadable, round(100.0 * flagged / n, 4) AS flagged_pct,
       CASE WHEN unread > 0 OR pct < 95 OR 100.0 * flagged / n > 5 THEN 'blocked' WHEN flagged > 0 OR missed > 0 OR (bare > 0 AND pct IS NOT NULL) THEN 'warnings' ELSE 'ready' END AS verdict,
       CASE WHEN pct IS NULL THEN 'coverage' ELSE '' END AS unchecked,
       concat_ws(',', CASE WHEN pct >= 95 AND missed > 0 THEN 'missed' END, CASE WHEN bare > 0 AND pct IS NOT NULL THEN 'ungeotagged' END, CASE WHEN flagged > 0 AND 100.0 * flagged / n <= 5 THEN 'quality' END) AS warnings
FROM c JOIN q USING (mission_id) JOIN g USING (mission_id)""")
def site_verdict(spark, sf):
    """Suppliers' pictures, one survey per nation, were flown without a plan."""
    free = table(spark, sf, "supplier").selectExpr("1000000 + s_nationkey AS mission_id", "CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_acctbal / 100 END AS lon", "41.0D AS lat", "60.0D AS alt_m")
    flown = view(spark, sf, "captured").select("mission_id", "lon", "lat", "alt_m").unionByName(free)
    cov = capture.coverage(view(spark, sf, "planned"), flown, matches(spark, sf))
    quality = (flown.groupBy("mission_id").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("alt_m") < 59).alias("flagged"),
                                               F.count_if(F.col("lon").isNull()).alias("unreadable")))
    v = capture.site_verdict(cov, quality, "mission_id")
    return v.select("mission_id", F.round("coverage_pct", 4).alias("coverage_pct"), "unreadable", F.round("flagged_pct", 4).alias("flagged_pct"), "verdict",
                    F.array_join("unchecked", ",").alias("unchecked"), F.array_join("warnings", ",").alias("warnings"))


EPOCH_CTE = cte("defects_t1", "defects_t2") + f""",
pairs AS (SELECT CONCAT(CAST(p.survey_id AS VARCHAR), '|', p.defect_type) AS g, p.defect_id AS l, c.defect_id AS r, {hav('p.', 'c.')} AS d
          FROM defects_t1 p JOIN defects_t2 c ON p.survey_id = c.survey_id AND p.defect_type = c.defect_type
          WHERE {hav('p.', 'c.')} <= 2),
{GREEDY},
change AS (
SELECT a.survey_id, a.defect_type, a.defect_id AS earlier_id, b.defect_id AS later_id, round(b.area_m2 - a.area_m2, 4) AS area_delta_m2, round(m.d, 4) AS moved_m,
       CASE WHEN a.area_m2 <= 0 AND b.area_m2 <= 0 THEN 'unchanged' WHEN (b.area_m2 - a.area_m2) / greatest(a.area_m2, 1e-9) > 0.10 THEN 'grown'
            WHEN (b.area_m2 - a.area_m2) / greatest(a.area_m2, 1e-9) < -0.10 THEN 'shrunk' ELSE 'unchanged' END AS change
FROM matched m JOIN defects_t1 a ON a.defect_id = m.l JOIN defects_t2 b ON b.defect_id = m.r
UNION ALL SELECT survey_id, defect_type, defect_id, NULL, NULL, NULL, 'resolved' FROM defects_t1 WHERE defect_id NOT IN (SELECT l FROM matched)
UNION ALL SELECT survey_id, defect_type, NULL, defect_id, NULL, NULL, 'new' FROM defects_t2 WHERE defect_id NOT IN (SELECT r FROM matched))
"""


@query("defect_epochs", EPOCH_CTE + "SELECT * FROM change")
def defect_epochs(spark, sf):
    c = capture.compare_defect_epochs(view(spark, sf, "defects_t1"), view(spark, sf, "defects_t2"))
    return c.select("survey_id", "defect_type", "earlier_id", "later_id", F.round("area_delta_m2", 4).alias("area_delta_m2"),
                    F.round("moved_m", 4).alias("moved_m"), "change")


@query("defect_epoch_counts", EPOCH_CTE + """SELECT defect_type, change, CAST(count(*) AS BIGINT) AS defects, round(sum(area_delta_m2), 4) AS area_delta_m2
FROM change GROUP BY 1, 2""")
def defect_epoch_counts(spark, sf):
    c = capture.compare_defect_epochs(view(spark, sf, "defects_t1"), view(spark, sf, "defects_t2"))
    return c.groupBy("defect_type", "change").agg(F.count(F.lit(1)).alias("defects"), F.round(F.sum("area_delta_m2"), 4).alias("area_delta_m2"))


SUPPRESS_CTE = cte("defects_t1") + f""",
near AS MATERIALIZED (SELECT a.survey_id AS g, a.defect_id AS a, b.defect_id AS b, b.area_m2 AS pb FROM defects_t1 a JOIN defects_t1 b
         ON a.survey_id = b.survey_id AND (b.area_m2 > a.area_m2 OR (b.area_m2 = a.area_m2 AND b.defect_id < a.defect_id)) AND {hav('a.', 'b.')} <= 1.0),
nb AS (SELECT g, a, list(b) AS l FROM near GROUP BY 1, 2),
ordered AS MATERIALIZED (SELECT survey_id AS g, defect_id AS i, coalesce(nb.l, []) AS l, row_number() OVER (PARTITION BY survey_id ORDER BY area_m2 DESC, defect_id) AS k
            FROM defects_t1 LEFT JOIN nb ON nb.g = survey_id AND nb.a = defect_id),
walk(g, k, kept, i, ok) AS (
  SELECT g, k, [i], i, true FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.g, o.k, CASE WHEN list_has_any(w.kept, o.l) THEN w.kept ELSE list_append(w.kept, o.i) END, o.i, NOT list_has_any(w.kept, o.l)
  FROM walk w JOIN ordered o ON o.g = w.g AND o.k = w.k + 1),
done AS MATERIALIZED (SELECT g, i, ok, k FROM walk),
owner AS (SELECT n.g, n.a AS i, arg_min(n.b, d.k) AS own FROM near n JOIN done d ON d.g = n.g AND d.i = n.b AND d.ok GROUP BY 1, 2)
"""


@query("suppress_nearby", SUPPRESS_CTE + """
SELECT w.g AS survey_id, w.i AS defect_id, w.ok AS kept, CASE WHEN w.ok THEN w.i ELSE o.own END AS kept_by FROM done w LEFT JOIN owner o ON o.g = w.g AND o.i = w.i""")
def suppress_nearby(spark, sf):
    from fieldspark.operators.matching import suppress_nearby as run
    return run(view(spark, sf, "defects_t1"), ["survey_id"], 1.0, priority="area_m2", seq="defect_id").select("survey_id", "defect_id", "kept", "kept_by")


def sensor(spark, sf, kind):
    return view(spark, sf, "frames").where(F.col("sensor") == kind)


FRAMES = cte("frames")
NEAREST_SQL = """,
ref AS (SELECT * FROM frames WHERE sensor = 'view'), oth AS (SELECT * FROM frames WHERE sensor = '{kind}'),
j AS (SELECT r.bundle_id, r.seq, r.t_ms, o.path, abs(o.t_ms - r.t_ms) AS d,
             row_number() OVER (PARTITION BY r.bundle_id, r.seq ORDER BY abs(o.t_ms - r.t_ms), o.t_ms, o.seq) AS k
      FROM ref r LEFT JOIN oth o ON o.bundle_id = r.bundle_id)
SELECT bundle_id, seq, round(d, 3) AS near_delta, CASE WHEN d <= {tol} THEN path END AS near_path FROM j WHERE k = 1"""


@query("asof_nearest", FRAMES + NEAREST_SQL.format(kind="click", tol=3600000))
def asof_nearest(spark, sf):
    out = asof.nearest(sensor(spark, sf, "view"), sensor(spark, sf, "click"), ["bundle_id"], ["path"], 3_600_000.0, chunk_ms=86_400_000.0)
    return out.select("bundle_id", "seq", F.round("near_delta", 3).alias("near_delta"), "near_path")


@query("asof_interpolate", FRAMES + """,
ref AS (SELECT * FROM frames WHERE sensor = 'view'), oth AS (SELECT * FROM frames WHERE sensor = 'signup'),
lo AS (SELECT r.bundle_id, r.seq, max(o.t_ms) AS t FROM ref r JOIN oth o ON o.bundle_id = r.bundle_id AND o.t_ms <= r.t_ms GROUP BY 1, 2),
hi AS (SELECT r.bundle_id, r.seq, min(o.t_ms) AS t FROM ref r JOIN oth o ON o.bundle_id = r.bundle_id AND o.t_ms > r.t_ms GROUP BY 1, 2),
j AS (SELECT r.bundle_id, r.seq, r.t_ms, lo.t AS t0, hi.t AS t1, a.value AS v0, b.value AS v1, a.path AS p0, b.path AS p1
      FROM ref r LEFT JOIN lo USING (bundle_id, seq) LEFT JOIN hi USING (bundle_id, seq)
      LEFT JOIN oth a ON a.bundle_id = r.bundle_id AND a.t_ms = lo.t LEFT JOIN oth b ON b.bundle_id = r.bundle_id AND b.t_ms = hi.t),
k AS (SELECT *, CASE WHEN t0 IS NULL THEN t1 - t_ms WHEN t1 IS NULL THEN t_ms - t0 ELSE least(t_ms - t0, t1 - t_ms) END AS d,
             CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * ((t_ms - t0) / (t1 - t0)) END AS v FROM j)
SELECT bundle_id, seq, round(d, 3) AS at_delta, CASE WHEN d <= 36000000 THEN round(v, 4) END AS at_value,
       CASE WHEN d <= 36000000 THEN coalesce(p0, p1) END AS at_path FROM k""")
def asof_interpolate(spark, sf):
    out = asof.interpolate(sensor(spark, sf, "view"), sensor(spark, sf, "signup").withColumn("value", F.col("value")), ["bundle_id"], ["value"], [], ["path"],
                           36_000_000.0, chunk_ms=86_400_000.0)
    return out.select("bundle_id", "seq", F.round("at_delta", 3).alias("at_delta"), F.round("at_value", 4).alias("at_value"), "at_path")
