"""Defects, risk, health, control, image catalogue, annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import bands
from fieldspark.operators import inspection as ins
from fieldspark.plans.adapters import cte, table, view
from fieldspark.plans.captures import hav
from fieldspark.plans.registry import query


def r4(*cols, n=4):
    return [F.round(c, n).alias(c) for c in cols]


DEF = cte("defects_t1")


@query("defect_summary", DEF + """,
u AS (SELECT survey_id, 'category' AS facet, defect_type AS value, count(*) AS n FROM defects_t1 GROUP BY 1, 3
      UNION ALL SELECT survey_id, 'severity', severity, count(*) FROM defects_t1 GROUP BY 1, 3
      UNION ALL SELECT survey_id, 'review_state', review_state, count(*) FROM defects_t1 GROUP BY 1, 3
      UNION ALL SELECT DISTINCT survey_id, 'severity', s, 0 FROM defects_t1, (VALUES ('low'), ('medium'), ('high'), ('critical')) v(s)
      UNION ALL SELECT DISTINCT survey_id, 'review_state', s, 0 FROM defects_t1, (VALUES ('unreviewed'), ('accepted'), ('rejected'), ('reclassified')) v(s))
SELECT survey_id, facet, value, CAST(sum(n) AS BIGINT) AS defects FROM u GROUP BY 1, 2, 3""")
def defect_summary(spark, sf):
    return ins.defect_summary(view(spark, sf, "defects_t1"), "survey_id")


@query("defect_extent", DEF + """
SELECT survey_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE review_state = 'accepted') AS BIGINT) AS human_confirmed,
       CAST(count(*) FILTER (WHERE review_state = 'unreviewed') AS BIGINT) AS awaiting_review, round(sum(area_m2), 4) AS total_area_m2, round(sum(length_m), 4) AS total_length_m,
       CAST(count(*) FILTER (WHERE area_m2 = 0 AND length_m = 0) AS BIGINT) AS unmeasured FROM defects_t1 GROUP BY 1""")
def defect_extent(spark, sf):
    d = ins.defect_extent(view(spark, sf, "defects_t1"), "survey_id")
    return d.select("survey_id", "total", "human_confirmed", "awaiting_review", *r4("total_area_m2", "total_length_m"), "unmeasured")


@query("defect_totals", DEF + """
SELECT survey_id, defect_type, CAST(count(*) AS BIGINT) AS defects, round(sum(area_m2), 4) AS area_m2, round(sum(length_m), 4) AS length_m, max(area_m2) AS largest_area_m2
FROM defects_t1 GROUP BY GROUPING SETS ((survey_id, defect_type), (survey_id))""")
def defect_totals(spark, sf):
    return ins.defect_totals(view(spark, sf, "defects_t1"), "survey_id").select("survey_id", "defect_type", "defects", *r4("area_m2", "length_m"), "largest_area_m2")


RISK = cte("findings") + """,
k AS (SELECT *, CASE WHEN defect_type IS NULL THEN 'unknown' ELSE replace(replace(lower(trim(defect_type)), ' ', '_'), '-', '_') END AS cls FROM findings),
d AS (SELECT *, CASE cls WHEN 'crack' THEN 0.7 WHEN 'cell_crack' THEN 0.6 WHEN 'hotspot' THEN 0.75 WHEN 'spalling' THEN 0.85 WHEN 'rust' THEN 0.6 WHEN 'stain' THEN 0.2 ELSE 0.5 END::DOUBLE AS sev,
             (CASE cls WHEN 'crack' THEN 0.32::DOUBLE WHEN 'cell_crack' THEN 0.08::DOUBLE WHEN 'hotspot' THEN 0.08::DOUBLE WHEN 'rust' THEN 0.14::DOUBLE ELSE 0.24::DOUBLE END) / 0.32::DOUBLE AS expo,
             CASE WHEN coalesce(area_m2, 0) > 0 THEN least(1, 0.35::DOUBLE + 0.65::DOUBLE * (area_m2 / 2)) WHEN length_m > 0 THEN least(1, 0.35::DOUBLE + 0.65::DOUBLE * (length_m / 2)) ELSE 0.6::DOUBLE END AS ext,
             least(1, greatest(0.05::DOUBLE, CASE WHEN confidence = 0 THEN 0.7::DOUBLE ELSE confidence END)) AS conf FROM k),
s AS (SELECT *, round_even(sev * ext * expo * conf, 4) AS risk_score FROM d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY survey_id ORDER BY risk_score DESC, seq) AS rank, count(*) OVER (PARTITION BY survey_id) AS n FROM s)"""


@query("risk_scores", RISK + """
SELECT survey_id, seq, cls AS class, round(ext, 6) AS extent_factor, round(expo, 6) AS exposure, risk_score,
       CASE WHEN risk_score >= 0.75 THEN 'immediate' WHEN risk_score >= 0.55 THEN 'urgent' WHEN risk_score >= 0.35 THEN 'planned' WHEN risk_score >= 0.15 THEN 'monitor' ELSE 'record' END AS action FROM s""")
def risk_scores(spark, sf):
    return ins.risk_scores(view(spark, sf, "findings")).select("survey_id", "seq", "class", *r4("extent_factor", "exposure", n=6), "risk_score", "action")


@query("risk_rank", RISK + "SELECT survey_id, seq, risk_score, CAST(rank AS BIGINT) AS rank FROM ranked")
def risk_rank(spark, sf):
    return ins.risk_rank(ins.risk_scores(view(spark, sf, "findings")), "survey_id", "seq").select("survey_id", "seq", "risk_score", "rank")


@query("risk_index", RISK + """,
i AS (SELECT survey_id, count(*) AS n, avg(risk_score) FILTER (WHERE rank <= greatest(1, n // 10)) AS idx FROM ranked GROUP BY 1)
SELECT survey_id, CAST(n AS BIGINT) AS defect_count, round(idx, 8) AS risk_index, round(greatest(0, 100 * (1 - idx)), 5) AS integrity_score,
       CAST(CASE WHEN 100 * (1 - idx) >= 85 THEN 1 WHEN 100 * (1 - idx) >= 70 THEN 2 WHEN 100 * (1 - idx) >= 55 THEN 3 WHEN 100 * (1 - idx) >= 40 THEN 4 ELSE 5 END AS INT) AS grade FROM i""")
def risk_index(spark, sf):
    d = ins.risk_index(ins.risk_scores(view(spark, sf, "findings")), "survey_id")
    return d.select("survey_id", "defect_count", F.round("risk_index", 8).alias("risk_index"), F.round("integrity_score", 5).alias("integrity_score"), "grade")


@query("risk_by_type", RISK + "SELECT survey_id, cls AS class, CAST(count(*) AS BIGINT) AS defects, max(risk_score) AS max_risk, round(avg(risk_score), 8) AS mean_risk FROM s GROUP BY 1, 2")
def risk_by_type(spark, sf):
    return ins.risk_by(ins.risk_scores(view(spark, sf, "findings")), "survey_id", "class").select("survey_id", "class", "defects", "max_risk", *r4("mean_risk", n=8))


@query("merge_observations", DEF + f""",
e AS MATERIALIZED (SELECT a.survey_id AS g, a.defect_type AS t, a.defect_id AS u, b.defect_id AS v FROM defects_t1 a JOIN defects_t1 b
      ON a.survey_id = b.survey_id AND a.defect_type = b.defect_type AND {hav('a.', 'b.')} <= 0.35),
reach(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v),
c AS (SELECT u AS defect_id, min(v) AS cluster FROM reach GROUP BY 1),
m AS (SELECT d.*, c.cluster, CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END AS rk FROM defects_t1 d JOIN c USING (defect_id))
SELECT survey_id, defect_type, cluster, CAST(count(*) AS BIGINT) AS observation_count, round(avg(lon), 6) AS lon, max(area_m2) AS area_m2, max(confidence) AS confidence,
       CASE max(rk) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity, array_to_string(list_sort(list(DISTINCT image)), ',') AS images
FROM m GROUP BY 1, 2, 3""")
def merge_observations(spark, sf):
    m = ins.merge_observations(view(spark, sf, "defects_t1"), ["survey_id", "defect_type"], "defect_id")
    return m.select("survey_id", "defect_type", "cluster", "observation_count", F.round("lon", 6).alias("lon"), "area_m2", "confidence", "severity",
                    F.array_join("images", ",").alias("images"))


IMG = cte("images")
FLAGS = """CASE WHEN sharpness < 100 THEN 'blurry' END, CASE WHEN greatest(dark_ratio, bright_ratio) > 0.10 THEN CASE WHEN dark_ratio > bright_ratio THEN 'underexposed' ELSE 'overexposed' END END,
CASE WHEN gps_lat IS NULL THEN 'missing_gps' END"""


@query("image_qa_flags", IMG + f"SELECT image_id, concat_ws(',', {FLAGS}) AS qa_flags FROM images")
def image_qa_flags(spark, sf):
    return ins.image_qa_flags(view(spark, sf, "images")).select("image_id", F.array_join("qa_flags", ",").alias("qa_flags"))


@query("survey_quality_flags", IMG + """SELECT image_id, concat_ws(',', CASE WHEN sharpness < 120 THEN 'blur' END, CASE WHEN dark_ratio * 5 < 0.5 THEN 'lens_blur' END,
CASE WHEN bright_ratio * 6 > 0.45 AND sharpness < 168 THEN 'motion_blur' END, CASE WHEN dark_ratio > 0.12 THEN 'under_exposed' END, CASE WHEN bright_ratio > 0.12 THEN 'over_exposed' END) AS qa_flags FROM images""")
def survey_quality_flags(spark, sf):
    im = (view(spark, sf, "images").withColumn("lens_ratio", F.col("dark_ratio") * 5).withColumn("motion", F.col("bright_ratio") * 6)
          .withColumnRenamed("dark_ratio", "dark_clip").withColumnRenamed("bright_ratio", "bright_clip"))
    return ins.survey_quality_flags(im).select("image_id", F.array_join("qa_flags", ",").alias("qa_flags"))


@query("metadata_coverage", IMG + """SELECT dataset_id, CAST(count(*) AS BIGINT) AS total, CAST(count(gps_lat) AS BIGINT) AS with_gps, CAST(count(camera_model) AS BIGINT) AS with_camera,
round(100.0 * count(gps_lat) / count(*), 4) AS gps_pct FROM images GROUP BY 1""")
def metadata_coverage(spark, sf):
    return ins.metadata_coverage(view(spark, sf, "images"), "dataset_id").select("dataset_id", "total", "with_gps", "with_camera", *r4("gps_pct"))


@query("duplicate_groups", IMG + "SELECT dataset_id, phash, CAST(count(*) AS BIGINT) AS copies, CAST(count(*) - 1 AS BIGINT) AS duplicates FROM images GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return ins.duplicate_groups(view(spark, sf, "images"), ["dataset_id"], "phash")


@query("dataset_validation", IMG + """,
d AS (SELECT dataset_id, sum(n - 1) AS dup FROM (SELECT dataset_id, phash, count(*) AS n FROM images GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
b AS (SELECT dataset_id, count(*) AS total, count(*) FILTER (WHERE corrupt) AS corrupt, count(*) FILTER (WHERE sharpness < 100 AND NOT corrupt) AS blurry, count(*) FILTER (WHERE gps_lat IS NULL) AS missing_gps FROM images GROUP BY 1)
SELECT dataset_id, CAST(total AS BIGINT) AS total, CAST(corrupt AS BIGINT) AS corrupt, CAST(blurry AS BIGINT) AS blurry, CAST(missing_gps AS BIGINT) AS missing_gps, CAST(coalesce(dup, 0) AS BIGINT) AS duplicates,
       CASE WHEN corrupt > 0 OR 100.0 * blurry / total > 40 THEN 'failing' WHEN blurry > 0 OR coalesce(dup, 0) > 0 OR 100.0 * (total - missing_gps) / total < 80 THEN 'warnings' ELSE 'passing' END AS status
FROM b LEFT JOIN d USING (dataset_id)""")
def dataset_validation(spark, sf):
    return ins.dataset_validation(view(spark, sf, "images"), "dataset_id").drop("gps_pct")


@query("image_metric_means", IMG + """SELECT dataset_id, round(avg(crack_ratio), 4) AS crack_ratio_avg, round(avg(CASE WHEN sharpness < 100 THEN 1.0 ELSE 0.0 END), 4) AS quality_fail_ratio,
round(avg(CASE WHEN dark_ratio > 0.15 THEN 1.0 ELSE 0.0 END), 4) AS low_overlap_ratio FROM images GROUP BY 1""")
def image_metric_means(spark, sf):
    return ins.image_metric_means(health_images(spark, sf), "dataset_id").select("dataset_id", *r4("crack_ratio_avg", "quality_fail_ratio", "low_overlap_ratio"))


def health_images(spark, sf):
    im = view(spark, sf, "images").withColumn("quality_ok", F.col("sharpness") >= 100).withColumn("low_overlap", F.col("dark_ratio") > 0.15)
    return im.select("dataset_id", "crack_ratio", (F.col("sharpness") * 4).alias("crack_length_px"), (F.col("sharpness") / 60).alias("crack_max_width_px"),
                     (F.col("dark_ratio") / 10).alias("metal_ratio"), (F.col("bright_ratio") / 8).alias("structural_ratio"), F.lit(0.001).alias("solar_ratio"), "quality_ok", "low_overlap")


@query("asset_health", IMG + """,
m AS (SELECT dataset_id, avg(crack_ratio) AS cr, avg(sharpness * 4) AS cl, avg(sharpness / 60) AS cw, avg(dark_ratio / 10) AS me, avg(bright_ratio / 8) AS st,
             avg(CASE WHEN sharpness < 100 THEN 1.0 ELSE 0.0 END) AS qf, avg(CASE WHEN dark_ratio > 0.15 THEN 1.0 ELSE 0.0 END) AS lo, count(*) AS n, quantile_cont(crack_ratio, 0.9) AS hi FROM images GROUP BY 1),
x AS (SELECT *, least(1, 0.7 * least(1, cr / 0.02) + 0.2 * least(1, cw / 8) + 0.1 * least(1, cl / 1800)) AS crack, least(1, 0.30 * qf + 0.20 * lo + 0.20 * least(1, (dataset_id % 7) / 20.0) + 0.20 * least(1, (dataset_id % 5) / 12.0)
             + 0.10 * least(1, greatest(0, (95.0 - (90 + dataset_id % 10)) / 45.0))) AS cov, least(1, 0.55 * least(1, n / 10000.0 / 0.015) + 0.45 * greatest(cr, hi)) AS crit, least(1, cr * 2) AS growth FROM m),
y AS (SELECT *, 100 * least(1, greatest(0, 0.32 * crack + 0.14 * least(1, me / 0.015) + 0.24 * least(1, st / 0.03) + 0.08 * least(1, 0.001 / 0.025) + 0.12 * growth + 0.06 * crit + 0.04 * cov)) AS sev FROM x),
z AS (SELECT *, least(100, 0.62 * sev + 20 * growth + 12 * crit + 6 * cov + 8 * least(1, greatest(0, (dataset_id % 3) / 4.0))) AS risk FROM y),
h AS (SELECT *, (0.028 + 0.002) * (1 + 1.8 * (risk / 100) + 0.9 * growth + 0.7 * crit + 0.8 * least(1, (dataset_id % 3) / 4.0)) AS hz FROM z)
SELECT dataset_id, round(sev, 4) AS severity_index, round(100 - sev, 4) AS integrity_score, round(risk, 4) AS structural_risk_score, round(hz, 6) AS hazard_per_year,
       round(1 - exp(-hz), 6) AS probability_1y, round(1 - exp(-hz * 3), 6) AS probability_3y, round(0.6 + 0.4 * (1 - cov), 4) AS model_confidence FROM h""")
def asset_health(spark, sf):
    im = health_images(spark, sf)
    crit = ins.criticality(im.withColumn("criticality", F.col("crack_ratio")), "dataset_id")
    k = F.col("dataset_id")
    rows = (ins.image_metric_means(im, "dataset_id").join(crit, "dataset_id").withColumn("structure_type", F.lit("bridge")).withColumn("material_type", F.lit("concrete"))
            .withColumn("growth_norm", F.least(F.lit(1.0), F.col("avg_critical") * 2)).withColumn("total_points", F.lit(10000)).withColumn("gap_count", k % 7)
            .withColumn("fail_count", k % 5).withColumn("completion_pct", 90.0 + k % 10).withColumn("change_per_month", -(k % 3).cast("double")))
    d = ins.asset_health(rows)
    return d.select("dataset_id", *r4("severity_index", "integrity_score", "structural_risk_score", "model_confidence"), *r4("hazard_per_year", "probability_1y", "probability_3y", n=6))


@query("survey_reference", IMG + """,
g AS (SELECT l_orderkey % 150 AS k, count(*) AS n FROM lineitem GROUP BY 1),
i AS (SELECT dataset_id, count(*) AS images, count(gps_lat) FILTER (WHERE event_ok) AS geotagged FROM (SELECT *, camera_model IS NOT NULL AS event_ok FROM images) GROUP BY 1)
SELECT dataset_id, CAST(images AS BIGINT) AS images, CAST(geotagged AS BIGINT) AS geotagged, CAST(coalesce(n, 0) AS BIGINT) AS gcps,
       CASE WHEN geotagged / images >= 0.6 THEN 'georeferenced' WHEN coalesce(n, 0) >= 3 THEN 'control_referenced' ELSE 'arbitrary' END AS mode
FROM i LEFT JOIN g ON g.k = i.dataset_id""")
def survey_reference(spark, sf):
    im = view(spark, sf, "images").withColumn("gps_lat", F.when(F.col("camera_model").isNotNull(), F.col("gps_lat")))
    control = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 150).alias("dataset_id"))
    return ins.survey_reference(im, control, "dataset_id").drop("measurable")


GCP = cte("gcp") + ", r AS (SELECT *, sqrt((cx-x)*(cx-x)+(cy-y)*(cy-y)+(cz-z)*(cz-z)) AS total, sqrt((cx-x)*(cx-x)+(cy-y)*(cy-y)) AS hor FROM gcp)"


def gcp_tables(spark, sf):
    g = view(spark, sf, "gcp").groupBy("survey_id", "name").agg(*[F.max(c).alias(c) for c in ("x", "y", "z", "cx", "cy", "cz", "marks")])
    return g.select("survey_id", "name", "x", "y", "z", "marks"), g.select("survey_id", "name", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))


GCP1 = cte("gcp") + """, g AS (SELECT survey_id, name, max(x) AS x, max(y) AS y, max(z) AS z, max(cx) AS cx, max(cy) AS cy, max(cz) AS cz, max(marks) AS marks FROM gcp GROUP BY 1, 2),
r AS (SELECT *, sqrt((cx-x)*(cx-x)+(cy-y)*(cy-y)+(cz-z)*(cz-z)) AS total, sqrt((cx-x)*(cx-x)+(cy-y)*(cy-y)) AS hor FROM g)"""


@query("gcp_residuals", GCP1 + "SELECT survey_id, name, round(cx - x, 5) AS dx, round(cy - y, 5) AS dy, round(cz - z, 5) AS dz, round(total, 5) AS total_m FROM r")
def gcp_residuals(spark, sf):
    d = ins.gcp_residuals(*gcp_tables(spark, sf), ["survey_id"])
    return d.select("survey_id", "name", *r4("dx", "dy", "dz", "total_m", n=5))


@query("control_accuracy", GCP1 + """
SELECT survey_id, CAST(count(*) AS BIGINT) AS used, round(sqrt(avg(total * total)), 8) AS rmse_m, round(sqrt(avg(hor * hor)), 8) AS horizontal_rmse_m, round(sqrt(avg((cz - z) * (cz - z))), 8) AS vertical_rmse_m,
       round(max(total), 8) AS max_residual_m, CAST(count(*) FILTER (WHERE total > 0.5) AS BIGINT) AS outliers, CAST(count(*) FILTER (WHERE marks = 0) AS BIGINT) AS unmarked,
       CAST(count(*) FILTER (WHERE marks IN (1, 2)) AS BIGINT) AS thin, CAST(sqrt(avg(total * total)) <= 0.05 AS INT) AS survey_grade FROM r GROUP BY 1""")
def control_accuracy(spark, sf):
    s, c = gcp_tables(spark, sf)
    d = ins.control_accuracy(ins.gcp_residuals(s, c, ["survey_id"]), s, ["survey_id"])
    return d.select("survey_id", "used", *r4("rmse_m", "horizontal_rmse_m", "vertical_rmse_m", "max_residual_m", n=8), "outliers", "unmarked", "thin", F.col("survey_grade").cast("int").alias("survey_grade"))


POS = cte("camera_events") + """,
b AS (SELECT survey_id, CASE WHEN survey_id % 7 = 0 THEN NULL ELSE max(ts) - INTERVAL 1 HOUR END AS last_obs, min(ts) + INTERVAL 1 HOUR AS first_obs FROM camera_events GROUP BY 1),
p AS (SELECT e.*, b.first_obs, b.last_obs, CASE WHEN last_obs IS NULL THEN 'refused' WHEN ts < first_obs THEN 'before' WHEN ts > last_obs THEN 'after' ELSE 'covered' END AS placement FROM camera_events e JOIN b USING (survey_id))"""


def placed_events(spark, sf):
    e = view(spark, sf, "camera_events")
    base = e.groupBy("survey_id").agg((F.min("ts") + F.expr("INTERVAL 1 HOUR")).alias("first_obs"), (F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("last_obs"))
    base = base.withColumn("last_obs", F.when(F.col("survey_id") % 7 != 0, F.col("last_obs")))
    return ins.events_in_window(e, base, "survey_id")


@query("events_in_window", POS + "SELECT survey_id, sequence, placement FROM p")
def events_in_window(spark, sf):
    return placed_events(spark, sf).select("survey_id", "sequence", "placement")


@query("positioning_report", POS + """,
o AS (SELECT survey_id, std_h, row_number() OVER (PARTITION BY survey_id ORDER BY std_h) - 1 AS k, count(*) OVER (PARTITION BY survey_id) AS n FROM p),
md AS (SELECT survey_id, max(CASE WHEN k = n // 2 THEN std_h END) AS m FROM o GROUP BY 1)
SELECT p.survey_id, CAST(count(*) AS BIGINT) AS events, CAST(count(*) FILTER (WHERE placement = 'covered') AS BIGINT) AS covered, CAST(count(*) FILTER (WHERE solution = 'fixed') AS BIGINT) AS fixed,
       round(count(*) FILTER (WHERE solution = 'fixed') / count(*), 4) AS fixed_fraction, round(max(md.m), 6) AS median_std_m, round((epoch_us(min(ts)) - epoch_us(min(first_obs))) / 1e6, 3) AS lead_in_s,
       CASE WHEN max(last_obs) IS NULL THEN 'refused' WHEN count(*) FILTER (WHERE placement = 'covered') < count(*) OR max(last_obs) <= min(first_obs) THEN 'blocked' ELSE 'ok' END AS status
FROM p JOIN md USING (survey_id) GROUP BY 1""")
def positioning_report(spark, sf):
    d = ins.positioning_report(placed_events(spark, sf), "survey_id")
    return d.select("survey_id", "events", "covered", "fixed", *r4("fixed_fraction"), F.round("median_std_m", 6).alias("median_std_m"), F.round("lead_in_s", 3).alias("lead_in_s"), "status")


NAMES = "CASE p_partkey % 9 WHEN 0 THEN 'Utility Pole' WHEN 1 THEN 'pylon' WHEN 2 THEN 'PV-module' WHEN 3 THEN 'wire' WHEN 4 THEN 'trees' WHEN 5 THEN 'seedling' WHEN 6 THEN 'structure' WHEN 7 THEN 'gnome' ELSE 'rail' END"
ASSET = "CASE p_partkey % 9 WHEN 0 THEN 'pole' WHEN 1 THEN 'tower' WHEN 2 THEN 'module' WHEN 3 THEN 'conductor' WHEN 4 THEN 'tree' WHEN 5 THEN 'plant' WHEN 6 THEN 'building' WHEN 7 THEN NULL ELSE 'track' END"


@query("resolve_taxonomy", f"SELECT p_partkey, {ASSET} AS asset, CASE WHEN p_partkey % 9 = 7 THEN 'refused' ELSE 'ok' END AS status FROM part")
def resolve_taxonomy(spark, sf):
    return ins.resolve_taxonomy(table(spark, sf, "part").withColumn("n", F.expr(NAMES)), "n").select("p_partkey", "asset", "status")


@query("asset_inventory", f"""WITH a AS (SELECT p_size, {ASSET} AS asset FROM part)
SELECT p_size, asset, CASE WHEN asset IN ('conductor', 'track') THEN NULL ELSE CAST(count(*) AS BIGINT) END AS assets FROM a WHERE asset IS NOT NULL GROUP BY 1, 2""")
def asset_inventory(spark, sf):
    r = ins.resolve_taxonomy(table(spark, sf, "part").withColumn("n", F.expr(NAMES)), "n")
    return ins.asset_inventory(r, "p_size").select("p_size", "asset", "assets")


@query("confidence_report", DEF + "SELECT survey_id, CAST(count(*) FILTER (WHERE confidence >= 0.5) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE confidence < 0.5) AS BIGINT) AS removed FROM defects_t1 GROUP BY 1")
def confidence_report(spark, sf):
    return ins.confidence_report(view(spark, sf, "defects_t1"), "survey_id", 0.5)


@query("validate_findings", """WITH f AS (SELECT p_partkey, p_partkey % 4 AS k, p_partkey % 3 AS e, p_partkey % 5 AS m, (p_partkey % 13) / 10.0 AS c FROM part)
SELECT p_partkey, concat_ws(',', CASE WHEN k = 3 THEN 'class' END, CASE WHEN e = 2 THEN 'evidence' END, CASE WHEN e = 0 AND m = 0 THEN 'model' END, CASE WHEN e = 0 AND c > 1 THEN 'confidence' END) AS broken FROM f""")
def validate_findings(spark, sf):
    p = table(spark, sf, "part").selectExpr(
        "p_partkey", "CASE p_partkey % 4 WHEN 0 THEN 'Pothole' WHEN 1 THEN 'crack' WHEN 2 THEN ' Debris' ELSE 'graffiti' END AS kind",
        "CASE p_partkey % 3 WHEN 0 THEN 'validated model' WHEN 1 THEN 'Manual-Review' ELSE 'hearsay' END AS evidence_source",
        "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'm' END AS model_key", "'1' AS model_version", "(p_partkey % 13) / 10.0D AS confidence")
    v = ins.validate_findings(p, "kind", ["pothole", "crack", "waterlogging", "debris"])
    return v.select("p_partkey", F.array_join(F.transform("violations", lambda x: x["rule"]), ",").alias("broken"))


@query("tag_counts", """WITH t AS (SELECT s_nationkey, unnest(string_split(CASE s_suppkey % 3 WHEN 0 THEN 'roof,urgent' WHEN 1 THEN 'urgent' ELSE 'wall,roof,damp' END, ',')) AS tag FROM supplier)
SELECT s_nationkey, tag, CAST(count(*) AS BIGINT) AS "rows" FROM t GROUP BY 1, 2""")
def tag_counts(spark, sf):
    s = table(spark, sf, "supplier").withColumn("tags", F.split(F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'roof,urgent' WHEN 1 THEN 'urgent' ELSE 'wall,roof,damp' END"), ","))
    return ins.tag_counts(s, ["s_nationkey"])


TAGGED = "CASE s_suppkey % 3 WHEN 0 THEN 'roof,urgent' WHEN 1 THEN 'urgent' ELSE 'wall,roof,damp' END"


@query("edit_tags", f"""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'roof,new one' WHEN 1 THEN 'new one' ELSE 'wall,roof,damp,new one' END AS tags FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, {TAGGED} FROM supplier WHERE s_suppkey % 2 = 1""")
def edit_tags(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.split(F.expr(TAGGED), ",").alias("tags"))
    even = F.col("s_suppkey") % 2 == 0
    add = s.select("s_suppkey", F.when(even, F.array(F.lit(" New   One "), F.lit("new one"))).otherwise(F.array().cast("array<string>")).alias("new_tags"))
    drop = s.select("s_suppkey", F.when(even, F.array(F.lit("URGENT"))).otherwise(F.array().cast("array<string>")).alias("new_tags"))
    return ins.remove_tags(ins.add_tags(s, add, "s_suppkey"), drop, "s_suppkey").select("s_suppkey", F.array_join("tags", ",").alias("tags"))


@query("review_transition", DEF + """,
dec AS (SELECT l_orderkey AS defect_id, arg_max(CASE WHEN l_returnflag = 'A' THEN 'accepted' WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'reclassified' END, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS st FROM lineitem GROUP BY 1)
SELECT d.defect_id, coalesce(dec.st, d.review_state) AS review_state, d.severity FROM defects_t1 d LEFT JOIN dec USING (defect_id)""")
def review_transition(spark, sf):
    li = table(spark, sf, "lineitem")
    dec = li.select(F.col("l_orderkey").alias("defect_id"), F.col("l_shipdate").alias("decided_at"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("decision_seq"),
                    F.expr("CASE WHEN l_returnflag = 'A' THEN 'accepted' WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'reclassified' END").alias("review_state"), F.lit(None).cast("string").alias("severity"))
    return ins.review_transition(view(spark, sf, "defects_t1"), dec, "defect_id").select("defect_id", "review_state", "severity")


@query("provenance_audit", """SELECT CAST(page_id AS VARCHAR) AS path, CASE WHEN page_id % 11 = 0 THEN 'missing_artifact' WHEN page_id % 5 = 0 THEN 'modified' ELSE 'verified' END AS state FROM pages
UNION ALL SELECT 'moved-' || CAST(page_id AS VARCHAR), 'no_provenance' FROM pages WHERE page_id % 11 = 0""")
def provenance_audit(spark, sf):
    """Every page is recorded; some were edited since, some were moved."""
    p = table(spark, sf, "pages")
    k = F.col("page_id")
    recorded = p.select(k.cast("string").alias("path"), F.sha2("html", 256).alias("sha256"))
    actual = p.select(F.concat(F.when(k % 11 == 0, F.lit("moved-")).otherwise(F.lit("")), k.cast("string")).alias("path"),
                      F.sha2(F.when(k % 5 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")), 256).alias("sha256"))
    return ins.provenance_audit(recorded, actual)


@query("asset_timeline", DEF + """,
p AS (SELECT c_custkey AS survey_id, c_nationkey AS asset_id FROM customer),
d AS (SELECT survey_id, count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE review_state = 'accepted') AS confirmed FROM defects_t1 GROUP BY 1),
j AS (SELECT p.*, coalesce(n, 0) AS n, coalesce(critical, 0) AS critical, coalesce(confirmed, 0) AS confirmed FROM p LEFT JOIN d USING (survey_id)),
e AS (SELECT asset_id, arg_min(n, survey_id) AS f, arg_max(n, survey_id) AS l, count(*) AS k FROM j GROUP BY 1)
SELECT j.asset_id, survey_id, CAST(n AS BIGINT) AS defects, CAST(critical AS BIGINT) AS critical, CAST(confirmed AS BIGINT) AS confirmed,
       CASE WHEN k < 2 THEN 'unknown' WHEN l > f THEN 'worsening' WHEN l < f THEN 'improving' ELSE 'stable' END AS trend FROM j JOIN e USING (asset_id)""")
def asset_timeline(spark, sf):
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("survey_id"), F.col("c_nationkey").alias("asset_id"), F.col("c_custkey").alias("inspected_at"))
    t = ins.asset_timeline(p, view(spark, sf, "defects_t1"), asset="asset_id", project="survey_id", when="inspected_at")
    return t.select("asset_id", "survey_id", "defects", "critical", "confirmed", "trend")


@query("corridor_summary", """WITH f AS (SELECT p_size AS survey_id, CASE p_partkey % 3 WHEN 0 THEN 'tower' WHEN 1 THEN 'insulator' ELSE 'conductor' END AS c, CASE p_partkey % 4 WHEN 0 THEN 'rust' ELSE 'normal' END AS n,
  CASE WHEN p_partkey % 8 = 0 THEN 1 ELSE 0 END AS rc FROM part)
SELECT survey_id, 'class' AS facet, c AS value, CAST(count(*) AS BIGINT) AS "rows", CAST(sum(rc) AS BIGINT) AS review_candidates FROM f GROUP BY 1, 3
UNION ALL SELECT survey_id, 'finding', n, CAST(count(*) AS BIGINT), CAST(sum(rc) AS BIGINT) FROM f GROUP BY 1, 3""")
def corridor_summary(spark, sf):
    f = table(spark, sf, "part").selectExpr("p_size AS survey_id", "CASE p_partkey % 3 WHEN 0 THEN 'tower' WHEN 1 THEN 'insulator' ELSE 'conductor' END AS asset_class",
                                            "CASE p_partkey % 4 WHEN 0 THEN 'rust' ELSE 'normal' END AS finding", "CASE WHEN p_partkey % 8 = 0 THEN 'review_candidate' ELSE 'validated' END AS finding_status")
    return ins.corridor_summary(f, "survey_id")


@query("severity_of_detection", """WITH d AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'hotspot' WHEN 1 THEN 'crack' ELSE 'stain' END AS t, (o_orderkey % 11) / 10.0 AS c, o_orderkey % 700 AS a FROM orders)
SELECT o_orderkey, CASE WHEN t = 'hotspot' AND c >= 0.8 THEN 'critical' WHEN 100.0 * a / 10000 >= 5 THEN 'critical' WHEN 100.0 * a / 10000 >= 1 THEN 'high' WHEN 100.0 * a / 10000 >= 0.25 THEN 'medium'
WHEN c >= 0.8 THEN 'medium' ELSE 'low' END AS severity FROM d""")
def severity_of_detection(spark, sf):
    d = table(spark, sf, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 3 WHEN 0 THEN 'hotspot' WHEN 1 THEN 'crack' ELSE 'stain' END AS t", "(o_orderkey % 11) / 10.0D AS c", "o_orderkey % 700 AS a")
    return d.select("o_orderkey", bands.severity_of_detection("t", "c", "a", F.lit(10000)).alias("severity"))


REPORT = DEF + """,
p AS (SELECT c_custkey AS survey_id FROM customer),
e AS (SELECT survey_id, 'defects' AS entry_of, defect_id AS seq FROM defects_t1 WHERE survey_id IN (SELECT survey_id FROM p)
      UNION ALL SELECT o_custkey, 'measurements', o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT survey_id FROM p))
"""


def report_tables(spark, sf):
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("survey_id"))
    d = view(spark, sf, "defects_t1").select("survey_id", F.col("defect_id").alias("seq"), "severity")
    m = table(spark, sf, "orders").select(F.col("o_custkey").alias("survey_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") == "F").alias("include_in_report"))
    return p, {"defects": d, "measurements": m}


@query("report_context", REPORT + """SELECT survey_id, entry_of, CAST(seq AS BIGINT) AS seq, CAST(seq AS VARCHAR) AS entry_seq,
CAST(row_number() OVER (PARTITION BY survey_id, entry_of ORDER BY seq DESC) AS BIGINT) AS position FROM e""")
def report_context(spark, sf):
    rows = ins.report_context(*report_tables(spark, sf), None, "survey_id")
    return rows.select("survey_id", "entry_of", "seq", F.get_json_object("entry", "$.seq").alias("entry_seq"), "position")


@query("report_counts", REPORT + """SELECT survey_id, CAST(count(*) FILTER (WHERE entry_of = 'defects') AS BIGINT) AS defects_count, CAST(count(*) FILTER (WHERE entry_of = 'measurements') AS BIGINT) AS measurements_count
FROM p LEFT JOIN e USING (survey_id) GROUP BY 1""")
def report_counts(spark, sf):
    return ins.report_counts(*report_tables(spark, sf), "survey_id")
