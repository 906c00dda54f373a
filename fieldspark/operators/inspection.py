"""Defect summaries, risk, asset health, control accuracy, image catalogue checks, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldspark.functions.bands import SEVERITIES, action_band, action_guidance, grade_label, grade_of_integrity, severity_of_rank, severity_rank
from fieldspark.functions.physics import clip
from fieldspark.functions.rules import Rule, check, one_of, required
from fieldspark.functions.text import canonical_name, normalise_class, normalise_tag
from fieldspark.operators.components import cluster_points
from fieldspark.operators.ordered import block, quantiles, top_mean, with_row_number

# Fixed values that decide the results.
REVIEW_STATES = ("unreviewed", "accepted", "rejected", "reclassified")
CLASS_SEVERITY = {
    "rebar_exposure": 0.95, "exposed_bar": 0.95, "spalling": 0.85, "spallation": 0.85, "delamination": 0.80, "crack": 0.70,
    "corrosion": 0.65, "rust": 0.60, "efflorescence": 0.40, "moisture_intrusion": 0.45, "stain": 0.20, "soiling": 0.15,
    "hotspot": 0.75, "cell_crack": 0.60, "diode_failure": 0.70, "shading": 0.25, "unknown": 0.50,
}
CLASS_GROUP = {
    "crack": "crack", "cell_crack": "solar", "hotspot": "solar", "diode_failure": "solar", "shading": "solar", "soiling": "solar",
    "corrosion": "metal", "rust": "metal", "rebar_exposure": "structural", "exposed_bar": "structural", "spalling": "structural",
    "spallation": "structural", "delamination": "structural", "efflorescence": "structural", "moisture_intrusion": "structural", "stain": "structural",
}
WEIGHTS = {
    "solar": {"crack": 0.18, "metal": 0.07, "structural": 0.10, "solar": 0.35, "growth": 0.12, "criticality": 0.12, "quality": 0.06},
    "tower": {"crack": 0.20, "metal": 0.25, "structural": 0.20, "solar": 0.00, "growth": 0.12, "criticality": 0.15, "quality": 0.08},
    "generic": {"crack": 0.32, "metal": 0.14, "structural": 0.24, "solar": 0.08, "growth": 0.12, "criticality": 0.06, "quality": 0.04},
}
HAZARD_STRUCTURE = {"bridge": 0.028, "building": 0.020, "tower": 0.024, "pipeline": 0.031, "solar": 0.016, "generic": 0.022}
HAZARD_MATERIAL = {"steel": 0.005, "reinforced_steel": 0.006, "concrete": 0.002, "masonry": 0.003, "composite": 0.002, "mixed": 0.003}
OUTLIER_M, GOOD_RMSE_M, MIN_MARKS = 0.5, 0.05, 3
MERGE_RADIUS_M = 0.35
MIN_GEOTAG_FRACTION, MIN_GCP_COUNT = 0.6, 3
ASSETS = {
    "tower": ("power", "point", True, ("pylon", "transmission_tower")), "pole": ("power", "point", True, ("utility_pole", "electric_pole")),
    "insulator": ("power", "point", True, ("insulator_string",)), "transformer": ("power", "point", True, ()),
    "conductor": ("power", "line", False, ("wire", "cable")), "track": ("rail", "line", False, ("rail", "railway_track")),
    "signal": ("rail", "point", True, ("rail_signal",)), "overhead_equipment": ("rail", "line", False, ("ohe", "catenary")),
    "module": ("solar", "polygon", True, ("panel", "pv_module", "solar_module")), "inverter": ("solar", "point", True, ()),
    "tree": ("vegetation", "point", True, ("trees", "crown")), "plant": ("agriculture", "point", True, ("crop_plant", "seedling")),
    "building": ("built", "polygon", True, ("structure",)), "road": ("built", "polygon", False, ("road_surface", "paved_road", "carriageway")),
    "equipment": ("built", "point", True, ("machinery", "plant_equipment")),
}


def _lookup(values: dict, key: Column, default=None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    hit = F.element_at(pairs, key)
    return hit if default is None else F.coalesce(hit, F.lit(default))


# --- defects -------------------------------------------------------------------------------------

def defect_summary(defects: DataFrame, project: str) -> DataFrame:
    """Counts by category, severity and review state in one pass: ``project, facet, value, defects``.

    Levels that are known but absent appear with 0.
    """
    g = (defects.groupingSets([[project, "defect_type"], [project, "severity"], [project, "review_state"]], project, "defect_type", "severity", "review_state")
         .agg(F.count(F.lit(1)).alias("defects"), F.grouping_id().alias("_g")))
    facet = F.when(F.col("_g") == 3, "category").when(F.col("_g") == 5, "severity").otherwise("review_state")
    value = F.when(F.col("_g") == 3, F.col("defect_type")).when(F.col("_g") == 5, F.col("severity")).otherwise(F.col("review_state"))
    counted = g.select(project, facet.alias("facet"), value.alias("value"), "defects")
    known = [F.struct(F.lit("severity").alias("facet"), F.lit(s).alias("value")) for s in SEVERITIES]
    known += [F.struct(F.lit("review_state").alias("facet"), F.lit(s).alias("value")) for s in REVIEW_STATES]
    grid = defects.select(project).distinct().withColumn("_k", F.explode(F.array(*known))).select(project, "_k.facet", "_k.value")
    return counted.join(grid, [project, "facet", "value"], "full_outer").na.fill(0, ["defects"])


def defect_extent(defects: DataFrame, project: str) -> DataFrame:
    """Totals over measured rows; null or zero extents count as unmeasured."""
    a, l = F.coalesce("area_m2", F.lit(0.0)), F.coalesce("length_m", F.lit(0.0))
    return defects.groupBy(project).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("review_state") == "accepted").alias("human_confirmed"),
                                        F.count_if(F.col("review_state") == "unreviewed").alias("awaiting_review"), F.sum(a).alias("total_area_m2"),
                                        F.sum(l).alias("total_length_m"), F.count_if((a == 0) & (l == 0)).alias("unmeasured"))


def defect_totals(defects: DataFrame, survey: str) -> DataFrame:
    """Per survey and type, with the survey total as ``defect_type`` null."""
    a, l = F.coalesce("area_m2", F.lit(0.0)), F.coalesce("length_m", F.lit(0.0))
    named = defects.withColumn("defect_type", F.coalesce("defect_type", F.lit("unknown")))
    return named.rollup(survey, "defect_type").agg(F.count(F.lit(1)).alias("defects"), F.sum(a).alias("area_m2"), F.sum(l).alias("length_m"),
                                                   F.max(a).alias("largest_area_m2")).where(F.col(survey).isNotNull())


def risk_scores(findings: DataFrame, structure: str = "generic") -> DataFrame:
    """Severity, extent, exposure and confidence of each finding and their product, rounded half-even to 4."""
    w = WEIGHTS["tower" if structure in ("tower", "steel_tower") else structure if structure == "solar" else "generic"]
    top = max(w.values())
    cls = normalise_class("defect_type")
    area, length = F.coalesce("area_m2", F.lit(0.0)), F.coalesce("length_m", F.lit(0.0))
    extent = (F.when(area > 0, F.least(F.lit(1.0), 0.35 + 0.65 * (area / 2.0))).when(length > 0, F.least(F.lit(1.0), 0.35 + 0.65 * (length / 2.0))).otherwise(0.6))
    conf = clip(F.coalesce(F.nullif("confidence", F.lit(0.0)), F.nullif("score", F.lit(0.0)), F.lit(0.7)), 0.05, 1.0)
    exposure = _lookup({g: v / top for g, v in w.items()}, _lookup(CLASS_GROUP, cls, "structural"), 0.15 / top)
    out = (findings.withColumn("class", cls).withColumn("class_severity", _lookup(CLASS_SEVERITY, cls, CLASS_SEVERITY["unknown"]))
           .withColumn("extent_factor", extent).withColumn("extent_basis", F.when(area > 0, "area_m2").when(length > 0, "length_m").otherwise("unmeasured"))
           .withColumn("exposure", exposure).withColumn("confidence_used", conf))
    score = F.bround(F.col("class_severity") * F.col("extent_factor") * F.col("exposure") * F.col("confidence_used"), 4)
    return out.withColumn("risk_score", score).withColumn("action", action_band("risk_score")).withColumn("guidance", action_guidance("risk_score"))


def risk_rank(scored: DataFrame, survey: str, seq: str) -> DataFrame:
    """Rank by rounded score, stable on input order. Scores have four decimals, so they chunk the order."""
    neg = scored.withColumn("_neg", -F.col("risk_score"))
    return with_row_number(neg, [survey], ["_neg", seq], [F.col("_neg"), block(seq, 1e6)], "rank").drop("_neg")


def risk_index(scored: DataFrame, survey: str) -> DataFrame:
    """Mean of the worst tenth (at least one), integrity, grade."""
    idx = top_mean(scored.select(survey, "risk_score"), [survey], "risk_score", F.greatest(F.lit(1), F.floor(F.col("n") / 10)), "_idx")
    integrity = F.greatest(F.lit(0.0), 100.0 * (1.0 - F.col("_idx")))
    return idx.select(survey, F.col("n").alias("defect_count"), F.col("_idx").alias("risk_index"), integrity.alias("integrity_score"),
                      grade_of_integrity(integrity).alias("grade"), grade_label(integrity).alias("grade_label"))


def risk_by(scored: DataFrame, survey: str, column: str) -> DataFrame:
    return scored.groupBy(survey, column).agg(F.count(F.lit(1)).alias("defects"), F.max("risk_score").alias("max_risk"), F.avg("risk_score").alias("mean_risk"))


def merge_observations(obs: DataFrame, keys: list[str], obs_id: str, radius_m: float = MERGE_RADIUS_M) -> DataFrame:
    """One defect per single-link cluster of same-type observations."""
    c = cluster_points(obs, keys, obs_id, radius_m)
    return (c.withColumn("_sev", severity_rank("severity")).groupBy(*keys, "cluster").agg(
        F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.max_by(obs_id, F.struct(F.col("area_m2"), -F.col(obs_id))).alias("shape_of"),
        F.max("area_m2").alias("area_m2"), F.max("_sev").alias("_sev"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("observation_count"),
        F.array_sort(F.collect_set("image")).alias("images")).withColumn("severity", severity_of_rank("_sev")).drop("_sev"))


# --- health --------------------------------------------------------------------------------------

def image_metric_means(images: DataFrame, key: str) -> DataFrame:
    val = lambda c: F.avg(F.coalesce(F.col(c), F.lit(0.0)))
    return images.groupBy(key).agg(*[val(c).alias(f"{c}_avg") for c in ("crack_ratio", "crack_length_px", "crack_max_width_px", "metal_ratio", "structural_ratio", "solar_ratio")],
                                   F.avg((~F.coalesce("quality_ok", F.lit(True))).cast("double")).alias("quality_fail_ratio"),
                                   F.avg(F.coalesce("low_overlap", F.lit(False)).cast("double")).alias("low_overlap_ratio"))


def criticality(points: DataFrame, key: str) -> DataFrame:
    """Mean and 90th percentile of the criticality of a reconstruction's critical points."""
    base = points.groupBy(key).agg(F.count("criticality").alias("critical_points"), F.avg("criticality").alias("avg_critical"))
    return base.join(quantiles(points, [key], "criticality", {"high_critical": 0.9}), key, "left")


def asset_health(assets: DataFrame) -> DataFrame:
    """Severity, integrity, risk, hazard, failure probabilities and confidence of each asset row.

    Needs the columns of :func:`image_metric_means` plus ``structure_type, material_type, growth_norm,
    critical_points, total_points, avg_critical, high_critical, gap_count, fail_count, completion_pct,
    change_per_month``.
    """
    one = lambda c: clip(c, 0.0, 1.0)
    col = F.col
    coverage = one(0.30 * col("quality_fail_ratio") + 0.20 * col("low_overlap_ratio") + 0.20 * one(col("gap_count") / 20.0)
                   + 0.20 * one(col("fail_count") / 12.0) + 0.10 * one(F.greatest(F.lit(0.0), (95.0 - col("completion_pct")) / 45.0)))
    critical = one(0.55 * one(col("critical_points") / F.greatest(F.lit(1), col("total_points")) / 0.015)
                   + 0.45 * F.greatest(F.coalesce("avg_critical", F.lit(0.0)), F.coalesce("high_critical", F.lit(0.0))))
    crack = one(0.70 * one(col("crack_ratio_avg") / 0.020) + 0.20 * one(col("crack_max_width_px_avg") / 8.0) + 0.10 * one(col("crack_length_px_avg") / 1800.0))
    kind = F.lower(F.trim(F.coalesce("structure_type", F.lit("generic"))))
    family = F.when(kind == "solar", "solar").when(kind.isin("tower", "steel_tower"), "tower").otherwise("generic")
    w = lambda part: _lookup({k: v[part] for k, v in WEIGHTS.items()}, family)
    out = assets.withColumn("coverage_norm", coverage).withColumn("critical_norm", critical).withColumn("crack_norm", crack)
    severity = one(w("crack") * col("crack_norm") + w("metal") * one(col("metal_ratio_avg") / 0.015) + w("structural") * one(col("structural_ratio_avg") / 0.030)
                   + w("solar") * one(col("solar_ratio_avg") / 0.025) + w("growth") * col("growth_norm") + w("criticality") * col("critical_norm") + w("quality") * col("coverage_norm"))
    out = out.withColumn("severity_index", 100.0 * severity).withColumn("integrity_score", 100.0 - col("severity_index"))
    out = out.withColumn("trend_penalty", one(F.greatest(F.lit(0.0), -col("change_per_month")) / 4.0))
    out = out.withColumn("structural_risk_score", clip(0.62 * col("severity_index") + 20.0 * col("growth_norm") + 12.0 * col("critical_norm")
                                                       + 6.0 * col("coverage_norm") + 8.0 * col("trend_penalty"), 0.0, 100.0))
    base = F.greatest(F.lit(1e-4), _lookup(HAZARD_STRUCTURE, kind, 0.022) + _lookup(HAZARD_MATERIAL, F.lower(F.trim(F.coalesce("material_type", F.lit("concrete")))), 0.002))
    factor = 1.0 + 1.8 * (col("structural_risk_score") / 100.0) + 0.9 * col("growth_norm") + 0.7 * col("critical_norm") + 0.8 * col("trend_penalty")
    out = out.withColumn("hazard_per_year", F.greatest(F.lit(1e-6), base * factor))
    for name, years in (("probability_6m", 0.5), ("probability_1y", 1.0), ("probability_3y", 3.0)):
        out = out.withColumn(name, 1.0 - F.exp(-col("hazard_per_year") * years))
    return (out.withColumn("condition_level", grade_of_integrity("integrity_score")).withColumn("condition_label", grade_label("integrity_score"))
            .withColumn("model_confidence", one(0.6 + 0.4 * one(1.0 - col("coverage_norm")))))


# --- image catalogue -----------------------------------------------------------------------------

def image_qa_flags(images: DataFrame) -> DataFrame:
    """Flags from metric columns ``sharpness, dark_ratio, bright_ratio, gps_lat, gps_lon``."""
    clipped = F.greatest("dark_ratio", "bright_ratio")
    flags = F.array_compact(F.array(
        F.when(F.col("sharpness") < 100, "blurry"), F.when((clipped > 0.10) & (F.col("dark_ratio") > F.col("bright_ratio")), "underexposed"),
        F.when((clipped > 0.10) & (F.col("dark_ratio") <= F.col("bright_ratio")), "overexposed"),
        F.when(F.col("gps_lat").isNull() | F.col("gps_lon").isNull(), "missing_gps")))
    return images.withColumn("qa_flags", flags).withColumn("quality_ok", F.size("qa_flags") == 0)


def survey_quality_flags(images: DataFrame) -> DataFrame:
    """Survey profile: ``sharpness, lens_ratio, motion, dark_clip, bright_clip``."""
    c = F.col
    flags = F.array_compact(F.array(F.when(c("sharpness") < 120, "blur"), F.when(c("lens_ratio") < 0.5, "lens_blur"), F.when((c("motion") > 0.45) & (c("sharpness") < 168), "motion_blur"),
                                    F.when(c("dark_clip") > 0.12, "under_exposed"), F.when(c("bright_clip") > 0.12, "over_exposed")))
    return images.withColumn("qa_flags", flags).withColumn("quality_ok", F.size("qa_flags") == 0)


def metadata_coverage(images: DataFrame, key: str) -> DataFrame:
    gps = F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull()
    out = images.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(gps).alias("with_gps"), F.count("captured_at").alias("with_timestamp"),
                                  F.count("camera_model").alias("with_camera"))
    for c in ("gps", "timestamp", "camera"):
        out = out.withColumn(f"{c}_pct", 100.0 * F.col(f"with_{c}") / F.col("total"))
    return out


def duplicate_groups(images: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Digests shared by more than one image, with the number of spare copies."""
    return (images.where(F.col(digest).isNotNull()).groupBy(*keys, digest).agg(F.count(F.lit(1)).alias("copies"))
            .where(F.col("copies") > 1).withColumn("duplicates", F.col("copies") - 1))


def dataset_validation(images: DataFrame, key: str, digest: str = "phash") -> DataFrame:
    """Counts and status of a dataset. Sharpness counts only for images that can be opened."""
    flagged = image_qa_flags(images)
    base = flagged.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if("corrupt").alias("corrupt"),
                                    F.count_if(F.array_contains("qa_flags", "blurry") & ~F.coalesce("corrupt", F.lit(False))).alias("blurry"),
                                    F.count_if(F.array_contains("qa_flags", "missing_gps")).alias("missing_gps"))
    dup = duplicate_groups(images, [key], digest).groupBy(key).agg(F.sum("duplicates").alias("duplicates"))
    j = base.join(dup, key, "left").na.fill(0, ["duplicates"])
    gps_pct = 100.0 * (F.col("total") - F.col("missing_gps")) / F.col("total")
    bad = (F.col("corrupt") > 0) | (100.0 * F.col("blurry") / F.col("total") > 40)
    warn = (F.col("blurry") > 0) | (F.col("duplicates") > 0) | (gps_pct < 80)
    return j.withColumn("gps_pct", gps_pct).withColumn("status", F.when(bad, "failing").when(warn, "warnings").otherwise("passing"))


def survey_reference(images: DataFrame, control: DataFrame, key: str) -> DataFrame:
    """What a survey's coordinates will mean: georeferenced, control_referenced or arbitrary."""
    i = images.groupBy(key).agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull()).alias("geotagged"))
    c = control.groupBy(key).agg(F.count(F.lit(1)).alias("gcps"))
    j = i.join(c, key, "left").na.fill(0, ["gcps"])
    mode = (F.when(F.col("geotagged") / F.col("images") >= MIN_GEOTAG_FRACTION, "georeferenced").when(F.col("gcps") >= MIN_GCP_COUNT, "control_referenced")
            .otherwise("arbitrary"))
    return j.withColumn("mode", mode).withColumn("measurable", F.col("mode") != "arbitrary")


# --- control and positioning ---------------------------------------------------------------------

def gcp_residuals(surveyed: DataFrame, computed: DataFrame, keys: list[str]) -> DataFrame:
    s = surveyed.select(*keys, "name", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"), "marks")
    j = s.join(computed, keys + ["name"])
    dx, dy, dz = F.col("x") - F.col("_x"), F.col("y") - F.col("_y"), F.col("z") - F.col("_z")
    return j.select(*keys, "name", dx.alias("dx"), dy.alias("dy"), dz.alias("dz"), F.hypot(dx, dy).alias("horizontal_m"),
                    F.sqrt(dx * dx + dy * dy + dz * dz).alias("total_m"), "marks")


def control_accuracy(residuals: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    rms = lambda c: F.sqrt(F.avg(F.pow(F.col(c), 2)))
    r = residuals.groupBy(*keys).agg(F.count(F.lit(1)).alias("used"), rms("total_m").alias("rmse_m"), rms("horizontal_m").alias("horizontal_rmse_m"), rms("dz").alias("vertical_rmse_m"),
                                     F.max("total_m").alias("max_residual_m"), F.max_by("name", F.struct("total_m", "name")).alias("worst_point"),
                                     F.count_if(F.col("total_m") > OUTLIER_M).alias("outliers"))
    p = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("marks") == 0).alias("unmarked"),
                                  F.count_if((F.col("marks") > 0) & (F.col("marks") < MIN_MARKS)).alias("thin"))
    return p.join(r, keys, "left").withColumn("survey_grade", F.col("rmse_m") <= GOOD_RMSE_M)


def events_in_window(events: DataFrame, base: DataFrame, key: str, margin_s: float = 0.0) -> DataFrame:
    """Camera events against the base session: before, covered, after; no session end refuses."""
    j = events.join(base, key, "left")
    t = F.unix_micros("ts")
    lo, hi = F.unix_micros("first_obs") - margin_s * 1e6, F.unix_micros("last_obs") + margin_s * 1e6
    place = F.when(F.col("last_obs").isNull(), "refused").when(t < lo, "before").when(t > hi, "after").otherwise("covered")
    return j.withColumn("placement", place)


def positioning_report(placed: DataFrame, key: str, required: float = 1.0) -> DataFrame:
    s = F.col("solution")
    base = placed.groupBy(key).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("placement") == "covered").alias("covered"), F.count_if(F.col("placement") == "before").alias("before"),
        F.count_if(F.col("placement") == "after").alias("after"), F.count_if(s == "fixed").alias("fixed"), F.count_if(s == "float").alias("float"), F.count_if(s == "single").alias("single"),
        ((F.unix_micros(F.min("ts")) - F.unix_micros(F.min("first_obs"))) / 1e6).alias("lead_in_s"),
        ((F.unix_micros(F.max("last_obs")) - F.unix_micros(F.max("ts"))) / 1e6).alias("lead_out_s"), F.max(F.col("placement") == "refused").alias("_refused"),
        F.max(F.coalesce(F.col("last_obs") <= F.col("first_obs"), F.lit(False))).alias("_empty"))
    out = base.join(quantiles(placed, [key], "std_h", {"median_std_m": 0.5}, kind="upper"), key, "left")
    out = out.withColumn("fixed_fraction", F.col("fixed") / F.col("events")).withColumn("coverage_fraction", F.col("covered") / F.col("events"))
    short = F.col("coverage_fraction") < required
    blocking = F.array_compact(F.array(F.when(short, "events outside the base session"), F.when(F.col("_empty"), "the base session has no duration")))
    return (out.withColumn("status", F.when(F.col("_refused"), "refused").when(short | F.col("_empty"), "blocked").otherwise("ok"))
            .withColumn("reason", F.when(F.col("_refused"), "the base session has no end").otherwise(F.nullif(F.array_join(blocking, "; "), F.lit("")))).drop("_refused", "_empty"))


# --- taxonomy, annotations, provenance ------------------------------------------------------------

def resolve_taxonomy(df: DataFrame, name: str) -> DataFrame:
    """Canonical asset, domain, geometry and countable flag; unknown names are refused."""
    alias = {a: canon for canon, (_, _, _, names) in ASSETS.items() for a in (canon, *names)}
    key = F.translate(F.lower(F.trim(F.coalesce(F.col(name), F.lit("")))), " -", "__")
    canon = _lookup(alias, key)
    return (df.withColumn("asset", canon).withColumn("domain", _lookup({k: v[0] for k, v in ASSETS.items()}, F.col("asset")))
            .withColumn("geometry", _lookup({k: v[1] for k, v in ASSETS.items()}, F.col("asset"))).withColumn("countable", _lookup({k: v[2] for k, v in ASSETS.items()}, F.col("asset")))
            .withColumn("status", F.when(F.col("asset").isNull(), "refused").otherwise("ok"))
            .withColumn("reason", F.when(F.col("asset").isNull(), "not in the asset taxonomy")))


def assets_for_domain(domain: str) -> list[str]:
    found = [k for k, v in ASSETS.items() if v[0] == domain.strip().lower()]
    if not found:
        raise ValueError(f"{domain!r} is not a known domain")
    return found


def asset_inventory(resolved: DataFrame, key: str) -> DataFrame:
    """Counts of countable assets; others are present but not counted."""
    ok = resolved.where("status = 'ok'")
    n = ok.groupBy(key, "asset", "domain", "countable").agg(F.count(F.lit(1)).alias("_n"))
    return n.select(key, "asset", "domain", F.when(F.col("countable"), F.col("_n")).alias("assets"),
                    F.when(F.col("countable"), "counted").otherwise("present but not counted").alias("state"))


def filter_by_confidence(df: DataFrame, minimum: float) -> DataFrame:
    if not 0 <= minimum <= 1:
        raise ValueError("minimum confidence must be within 0..1")
    return df.where(F.col("confidence") >= minimum)


def confidence_report(df: DataFrame, key: str, minimum: float) -> DataFrame:
    keep = F.coalesce(F.col("confidence") >= minimum, F.lit(False))
    return df.groupBy(key).agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("removed"))


def validate_findings(findings: DataFrame, class_col: str, allowed: list[str]) -> DataFrame:
    named = findings.withColumn("finding_class", canonical_name(F.coalesce(F.col(class_col), F.lit("")))).withColumn(
        "evidence", canonical_name(F.coalesce("evidence_source", F.lit(""))))
    model = F.col("evidence") == "validated_model"
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return check(named, [
        Rule("class", ~F.col("finding_class").isin(*allowed), "the class is not in the validated schema"),
        Rule("evidence", ~F.col("evidence").isin("validated_model", "manual_review"), "evidence_source must be validated_model or manual_review"),
        Rule("model", model & (blank("model_key") | blank("model_version")), "a model finding needs model_key and model_version"),
        Rule("confidence", model & (F.col("confidence").isNull() | (F.col("confidence") < 0) | (F.col("confidence") > 1)), "a model finding needs confidence within 0..1")])


def validate_instances(instances: DataFrame, asset: str = "asset_name", geometry: str = "geometry_type") -> DataFrame:
    r = resolve_taxonomy(instances, asset).withColumnRenamed("geometry", "_want").drop("status", "reason")
    shape = F.lower(F.regexp_replace(geometry, "^Multi", ""))
    want = F.when(F.col("_want") == "line", "linestring").otherwise(F.col("_want"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return check(r, [
        Rule("provenance", blank("model_key") | blank("model_sha256"), "model key and digest are required"),
        Rule("taxonomy", F.col("asset").isNull(), "not in the asset taxonomy"), Rule("geometry", shape != want, "the geometry does not fit the asset type"),
        Rule("confidence", F.col("confidence").isNull() | (F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence within 0..1 is required"),
        Rule("crs", F.col("epsg").isNull(), "a coordinate system is required")]).drop("_want")


def validate_annotations(ann: DataFrame) -> DataFrame:
    """``kind, geometry_type, ring array<struct<x,y>>, radius, label, severity, review_state``."""
    c, ring = F.col, F.col("ring")
    wanted = (F.when(c("kind").isin("point", "circle", "text"), "Point").when(c("kind").isin("line", "freehand"), "LineString").otherwise("Polygon"))
    n = F.size("ring")
    closed = (F.element_at(ring, 1) == F.element_at(ring, -1))
    xs, ys = F.array_distinct(F.transform(ring, lambda p: p["x"])), F.array_distinct(F.transform(ring, lambda p: p["y"]))
    return check(ann, [
        required("label"), one_of("severity", ["critical", "high", "medium", "low", "info"]),
        Rule("geometry", c("geometry_type") != wanted, "the annotation type fixes its geometry"),
        Rule("radius", (c("kind") == "circle") & F.coalesce(c("radius") <= 0, F.lit(True)), "a circle needs a positive radius"),
        Rule("line", (wanted == "LineString") & (n < 2), "a line needs two points"),
        Rule("ring", (wanted == "Polygon") & ((n < 4) | ~closed), "a polygon needs a closed ring of four points"),
        Rule("rectangle", (c("kind") == "rectangle") & ((F.size(xs) != 2) | (F.size(ys) != 2)), "a rectangle must be axis-aligned")])


# Fixed values that decide the results.
MEASURE_UNITS = {"distance": "m", "perimeter": "m", "area": "m2", "volume": "m3", "temperature": "celsius", "count": "count"}
METRIC_KINDS = ("distance", "perimeter", "area", "volume")


def validate_measurements(m: DataFrame) -> DataFrame:
    """``kind, unit, value, is_projected``."""
    v = F.col("value")
    return check(m, [
        one_of("kind", list(MEASURE_UNITS)), Rule("unit", _lookup(MEASURE_UNITS, F.col("kind")) != F.col("unit"), "the kind fixes the unit"),
        Rule("finite", v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "the value must be finite"),
        Rule("sign", (F.col("kind") != "temperature") & (v < 0), "the value must not be negative"),
        Rule("crs", F.col("kind").isin(*METRIC_KINDS) & ~F.coalesce("is_projected", F.lit(False)), "a metric measurement needs a projected coordinate system")])


def add_tags(rows: DataFrame, requests: DataFrame, row_id: str) -> DataFrame:
    """Union of tags, order kept, new ones normalised. ``requests(row_id, new_tags)``."""
    new = F.filter(F.transform("new_tags", lambda t: normalise_tag(t)), lambda t: t != "")
    return (rows.join(requests, row_id, "left").withColumn("tags", F.array_distinct(F.concat("tags", F.coalesce(new, F.array().cast("array<string>"))))).drop("new_tags"))


def remove_tags(rows: DataFrame, requests: DataFrame, row_id: str) -> DataFrame:
    gone = F.transform("new_tags", lambda t: normalise_tag(t))
    return rows.join(requests, row_id, "left").withColumn("tags", F.array_except("tags", F.coalesce(gone, F.array().cast("array<string>")))).drop("new_tags")


def missing_ids(rows: DataFrame, requests: DataFrame, row_id: str) -> DataFrame:
    return requests.join(rows, row_id, "left_anti").select(row_id)


def tag_counts(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    return (rows.withColumn("tag", F.explode(F.array_distinct("tags"))).groupBy(*keys, "tag").agg(F.count(F.lit(1)).alias("rows")))


def filter_rows(df: DataFrame, **wanted) -> DataFrame:
    """Conjunction of the filters that are given; ``tag`` is normalised and looked up in ``tags``."""
    for name, value in wanted.items():
        if value is None:
            continue
        df = df.where(F.array_contains("tags", normalise_tag(F.lit(value)))) if name == "tag" else df.where(F.col(name) == value)
    return df


def review_transition(defects: DataFrame, decisions: DataFrame, row_id: str) -> DataFrame:
    """Latest human decision applied; what the model claimed stays as it was."""
    last = decisions.groupBy(row_id).agg(F.max(F.struct("decided_at", "decision_seq", "review_state", "severity")).alias("_d"))
    return (defects.join(last, row_id, "left").withColumn("review_state", F.coalesce("_d.review_state", F.col("review_state")))
            .withColumn("severity", F.coalesce("_d.severity", F.col("severity"))).drop("_d"))


def merge_annotations(parents: DataFrame, group: str, row_id: str) -> DataFrame:
    """N to 1: claims concatenated in id order; refused when the parents differ in source or CRS.

    A merge request names few parents, which bounds the lists.
    """
    g = parents.groupBy(group).agg(F.min(row_id).alias("first_parent"), F.count(F.lit(1)).alias("parents"),
                                   F.array_sort(F.collect_list(row_id)).alias("parent_ids"), F.array_sort(F.collect_list(F.struct(F.col(row_id).alias("i"), F.col("claims").alias("c")))).alias("_c"),
                                   (F.countDistinct("source") > 1).alias("_s"), (F.countDistinct("epsg") > 1).alias("_e"))
    return (g.withColumn("claims", F.flatten(F.transform("_c", lambda v: v["c"])))
            .withColumn("reason", F.when(F.col("parents") < 2, "a merge needs two annotations").when(F.col("_s"), "different sources").when(F.col("_e"), "different coordinate systems"))
            .withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("refused")).drop("_c", "_s", "_e"))


def split_annotation(parents: DataFrame, parts: str, row_id: str) -> DataFrame:
    """1 to N: one child per part, claims copied."""
    return parents.select("*", F.posexplode(parts).alias("part_no", "part")).withColumn("parent_id", F.col(row_id)).drop(parts)


def provenance_audit(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """``recorded(path, sha256)`` against ``actual(path, sha256)``."""
    r, a = recorded.select("path", F.col("sha256").alias("_r")), actual.select("path", F.col("sha256").alias("_a"))
    state = (F.when(F.col("_r").isNull(), "no_provenance").when(F.col("_a").isNull(), "missing_artifact").when(F.col("_r") == F.col("_a"), "verified").otherwise("modified"))
    return r.join(a, "path", "full_outer").withColumn("state", state).select("path", "state")


def asset_timeline(inspections: DataFrame, defects: DataFrame, *, asset: str, project: str, when: str, confirmed_states: tuple = ("accepted",)) -> DataFrame:
    """One row per inspection with counts by severity and review, and the asset's first-to-last trend."""
    d = defects.groupBy(project).agg(F.count(F.lit(1)).alias("defects"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES],
                                     F.count_if(F.col("review_state").isin(*confirmed_states)).alias("confirmed"), F.count_if(F.col("review_state") == "unreviewed").alias("unreviewed"))
    rows = inspections.join(d, project, "left").na.fill(0)
    ends = rows.groupBy(asset).agg(F.min_by("defects", F.struct(when, project)).alias("_f"), F.max_by("defects", F.struct(when, project)).alias("_l"), F.count(F.lit(1)).alias("inspections"))
    trend = F.when(F.col("inspections") < 2, "unknown").when(F.col("_l") > F.col("_f"), "worsening").when(F.col("_l") < F.col("_f"), "improving").otherwise("stable")
    return rows.join(ends.withColumn("trend", trend).drop("_f", "_l"), asset)


def corridor_summary(findings: DataFrame, survey: str) -> DataFrame:
    """Counts by class and by finding in one pass, with review candidates."""
    g = (findings.groupingSets([[survey, "asset_class"], [survey, "finding"]], survey, "asset_class", "finding")
         .agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("finding_status") == "review_candidate").alias("review_candidates"), F.grouping_id().alias("_g")))
    return g.select(survey, F.when(F.col("_g") == 1, "class").otherwise("finding").alias("facet"), F.coalesce("asset_class", "finding").alias("value"), "rows", "review_candidates")


def road_surface_flag(findings: DataFrame, road_cells: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the cell under a finding is road; off-road findings need review."""
    at = keys + ["row_idx", "col_idx"]
    return (findings.join(road_cells.select(*at).distinct().withColumn("on_road", F.lit(True)), at, "left")
            .withColumn("on_road", F.coalesce("on_road", F.lit(False))).withColumn("requires_review", ~F.col("on_road")))


def _reported(df: DataFrame) -> DataFrame:
    return df.where("include_in_report") if "include_in_report" in df.columns else df


def report_counts(projects: DataFrame, tables: dict[str, DataFrame], project: str) -> DataFrame:
    """Per project: number of report rows of every table."""
    out = projects.select(project).distinct()
    for name, df in tables.items():
        out = out.join(_reported(df).groupBy(project).agg(F.count(F.lit(1)).alias(f"{name}_count")), project, "left")
    return out.na.fill(0)


def report_context(projects: DataFrame, tables: dict[str, DataFrame], audit: DataFrame | None, project: str, audit_limit: int | None = None) -> DataFrame:
    """Every report row of a project's tables: ``project, entry_of, position, seq, entry``, newest (by ``seq``) first.

    ``entry`` is the row as JSON. Rows stay rows, so a project of any size is dealt to many tasks. ``audit_limit`` is the
    report's own limit on its audit trail; no other table is cut.
    """
    known = projects.select(project).distinct()
    out = None
    for name, df in (tables | ({"audit": audit} if audit is not None else {})).items():
        cols = [c for c in df.columns if c != project]
        rows = (_reported(df).join(known, project, "left_semi")
                .select(project, F.lit(name).alias("entry_of"), F.col("seq").cast("long").alias("seq"), F.to_json(F.struct(*cols)).alias("entry")))
        rows = with_row_number(rows.withColumn("_neg", -F.col("seq")), [project], ["_neg", "entry"], [block("_neg", 1e5)], "position").drop("_neg")
        if name == "audit" and audit_limit is not None:
            rows = rows.where(F.col("position") <= audit_limit)
        out = rows if out is None else out.unionByName(rows)
    return out


#: fixed values: what a list of findings is ordered by, first key first
FINDING_ORDER = {"risk": ("-risk_score",), "regions": ("-volume_m3", "region_id"), "deformation": ("-max_displacement_m",), "defects": ("-area_m2",)}


def order_findings(findings: DataFrame, kind: str, ties: str) -> DataFrame:
    """Findings in report order, for the sink; equal ones by ``ties``."""
    by = [F.desc_nulls_last(k[1:]) if k.startswith("-") else F.asc(k) for k in FINDING_ORDER[kind]]
    return findings.orderBy(*by, F.asc(ties))

