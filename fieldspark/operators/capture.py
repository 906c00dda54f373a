"""Planned-versus-flown reports and epoch-to-epoch defect change."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldspark.functions.text import base_name
from fieldspark.operators.matching import match_one_to_one
from fieldspark.operators.ordered import block, quantiles, with_row_number
from fieldspark.session import sorted_side

# Fixed values that decide the results.
MATCH_RADIUS_M = 15.0
DEVIATION_WARNING_M = 8.0
DEFECT_RADIUS_M = 2.0
AREA_TOLERANCE = 0.10
MIN_COVERAGE_PCT = 95.0
MAX_FLAGGED_PCT = 5.0


def pair_captures(planned: DataFrame, captured: DataFrame, radius_m: float = MATCH_RADIUS_M, mission: str = "mission_id") -> DataFrame:
    """``mission_id, idx, image_seq, distance_m`` of the one-to-one pairs, stored: reports may read them several times."""
    return match_one_to_one(planned, captured, [mission], radius_m, left_id="idx", right_id="image_seq")


def match_captures(planned: DataFrame, captured: DataFrame, radius_m: float = MATCH_RADIUS_M, mission: str = "mission_id") -> DataFrame:
    """``mission_id, idx, image_seq, distance_m, altitude_diff_m`` of the one-to-one pairs."""
    pairs = pair_captures(planned, captured, radius_m, mission)
    return (pairs.join(sorted_side(planned.select(mission, "idx", F.col("alt_m").alias("_pa"))), [mission, "idx"])
            .join(sorted_side(captured.select(mission, "image_seq", F.col("alt_m").alias("_ia"))), [mission, "image_seq"])
            .withColumn("altitude_diff_m", F.col("_ia") - F.col("_pa")).drop("_pa", "_ia"))


def coverage(planned: DataFrame, captured: DataFrame, pairs: DataFrame, mission: str = "mission_id") -> DataFrame:
    """Counts of every survey that has a plan or images. Without a plan there is no coverage (null)."""
    p = planned.groupBy(mission).agg(F.count(F.lit(1)).alias("planned"))
    placed = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    i = captured.groupBy(mission).agg(F.count(F.lit(1)).alias("images"), F.count_if(placed).alias("_placed"))
    m = pairs.groupBy(mission).agg(F.count(F.lit(1)).alias("matched"))
    j = p.join(i, mission, "full").join(m, mission, "left").na.fill(0, ["planned", "images", "_placed", "matched"])
    return j.select(mission, "planned", "images", "matched", (F.col("planned") - F.col("matched")).alias("missed"),
                    (F.col("_placed") - F.col("matched")).alias("unplanned"), (F.col("images") - F.col("_placed")).alias("ungeotagged"),
                    F.when(F.col("planned") > 0, 100.0 * F.col("matched") / F.nullif("planned", F.lit(0))).alias("coverage_pct"))


def unmatched(planned: DataFrame, captured: DataFrame, pairs: DataFrame, mission: str = "mission_id") -> DataFrame:
    """Missed capture points, unplanned images and images without a position: ``mission_id, item, status``."""
    missed = planned.join(sorted_side(pairs), [mission, "idx"], "left_anti").select(mission, F.col("idx").alias("item"), F.lit("missed").alias("status"))
    placed = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    rest = captured.join(sorted_side(pairs), [mission, "image_seq"], "left_anti").select(
        mission, F.col("image_seq").alias("item"), F.when(placed, "unplanned").otherwise("ungeotagged").alias("status"))
    return missed.unionByName(rest)


def deviation(pairs: DataFrame, mission: str = "mission_id", warning_m: float = DEVIATION_WARNING_M) -> DataFrame:
    """Mean, upper median, maximum and count over the warning distance."""
    base = pairs.groupBy(mission).agg(F.avg("distance_m").alias("mean_m"), F.max("distance_m").alias("max_m"),
                                      F.count_if(F.col("distance_m") > warning_m).alias("over_warning"))
    return base.join(sorted_side(quantiles(pairs, [mission], "distance_m", {"median_m": 0.5}, kind="upper")), mission)


def pose_priors(pairs: DataFrame, planned: DataFrame, captured: DataFrame, mission: str = "mission_id") -> DataFrame:
    """Planned pose of every matched image, by file name."""
    return (pairs.select(mission, "idx", "image_seq").join(sorted_side(planned), [mission, "idx"])
            .join(sorted_side(captured.select(mission, "image_seq", base_name("path").alias("image"))), [mission, "image_seq"]))


def remaining(planned: DataFrame, done: DataFrame, mission: str = "mission_id") -> DataFrame:
    """Planned points not done, numbered in plan order."""
    left = planned.join(sorted_side(done), [mission, "idx"], "left_anti").select(mission, "idx")
    return with_row_number(left, [mission], ["idx"], [block("idx", 1e6)], "remaining_no")


def site_verdict(cov: DataFrame, quality: DataFrame, key: str) -> DataFrame:
    """Blocked, warnings or ready from coverage and image checks, with the reasons and the points to fly again.

    ``quality(key, checked, flagged, unreadable)``. Missed points within the tolerance and images without a position are
    warnings; a survey without a plan or without checked images says what was not checked.
    """
    j = cov.join(quality, key, "left").na.fill(0, ["checked", "flagged", "unreadable"])
    pct = F.when(F.col("checked") > 0, 100.0 * F.col("flagged") / F.col("checked")).otherwise(0.0)
    planned = F.coalesce("planned", F.lit(0)) > 0
    low = planned & (F.col("coverage_pct") < MIN_COVERAGE_PCT)
    bad = (F.col("unreadable") > 0) | low | (pct > MAX_FLAGGED_PCT)
    blocking = F.array_compact(F.array(F.when(F.col("unreadable") > 0, "unreadable"), F.when(low, "coverage"), F.when(pct > MAX_FLAGGED_PCT, "quality")))
    warnings = F.array_compact(F.array(F.when(planned & ~low & (F.col("missed") > 0), "missed"), F.when(planned & (F.col("ungeotagged") > 0), "ungeotagged"),
                                       F.when((F.col("flagged") > 0) & (pct <= MAX_FLAGGED_PCT), "quality")))
    unchecked = F.array_compact(F.array(F.when(~planned, "coverage"), F.when(F.col("checked") == 0, "quality")))
    return (j.withColumn("flagged_pct", pct).withColumn("blocking", blocking).withColumn("warnings", warnings).withColumn("unchecked", unchecked)
            .withColumn("verdict", F.when(bad, "blocked").when(F.size("warnings") > 0, "warnings").when(F.col("checked") == 0, "unchecked").otherwise("ready")))


def refly_points(planned: DataFrame, pairs: DataFrame, verdicts: DataFrame, mission: str = "mission_id") -> DataFrame:
    """Missed points of the surveys that coverage blocks: ``mission_id, idx``."""
    short = verdicts.where(F.array_contains("blocking", "coverage")).select(mission)
    return planned.join(short, mission, "left_semi").join(sorted_side(pairs), [mission, "idx"], "left_anti").select(mission, "idx")


def compare_defect_epochs(earlier: DataFrame, later: DataFrame, radius_m: float = DEFECT_RADIUS_M, tolerance: float = AREA_TOLERANCE,
                          survey: str = "survey_id") -> DataFrame:
    """Same-type one-to-one pairs labelled grown, shrunk or unchanged; the rest resolved or new."""
    keys = [survey, "defect_type"]
    a = earlier.select(*keys, F.col("defect_id").alias("earlier_id"), "lon", "lat", F.col("area_m2").alias("_a"))
    b = later.select(*keys, F.col("defect_id").alias("later_id"), "lon", "lat", F.col("area_m2").alias("_b"))
    pairs = match_one_to_one(a, b, keys, radius_m, left_id="earlier_id", right_id="later_id")
    both = (pairs.join(sorted_side(a.drop("lon", "lat")), keys + ["earlier_id"]).join(sorted_side(b.drop("lon", "lat")), keys + ["later_id"]))
    rel = (F.col("_b") - F.col("_a")) / F.greatest(F.col("_a"), F.lit(1e-9))
    blank = (F.col("_a") <= 0) & (F.col("_b") <= 0)
    both = both.select(*keys, "earlier_id", "later_id", (F.col("_b") - F.col("_a")).alias("area_delta_m2"), F.col("distance_m").alias("moved_m"),
                       F.when(blank, "unchanged").when(rel > tolerance, "grown").when(rel < -tolerance, "shrunk").otherwise("unchanged").alias("change"),
                       F.when(blank, "neither survey measured an extent").alias("note"))
    gone = a.join(sorted_side(pairs), keys + ["earlier_id"], "left_anti").select(*keys, "earlier_id", F.lit("resolved").alias("change"))
    new = b.join(sorted_side(pairs), keys + ["later_id"], "left_anti").select(*keys, "later_id", F.lit("new").alias("change"))
    return both.unionByName(gone, allowMissingColumns=True).unionByName(new, allowMissingColumns=True)


def compare_surveys(surface: DataFrame | None, defects: DataFrame | None, surveys: DataFrame, survey: str = "survey_id") -> DataFrame:
    """Surface and defect change side by side; a side that is absent becomes a warning, not a failure."""
    out, warn = surveys.select(survey).distinct(), []
    if surface is not None:
        out = out.join(surface, survey, "left")
        warn.append(F.when(F.col("compared_cells").isNull(), "surface comparison unavailable"))
    else:
        warn.append(F.lit("no elevation surfaces supplied"))
    if defects is not None:
        counts = defects.groupBy(survey).pivot("change", ["new", "resolved", "grown", "shrunk", "unchanged"]).count().na.fill(0)
        out = out.join(counts, survey, "left")
        warn.append(F.when(F.col("unchanged").isNull(), "defect comparison unavailable"))
    else:
        warn.append(F.lit("no defect layers supplied"))
    return out.withColumn("warnings", F.array_compact(F.array(*warn)))
