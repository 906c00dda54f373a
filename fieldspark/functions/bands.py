"""Threshold tables: severities, grades, actions, control modes, ranks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fieldspark.functions.geo import col
from fieldspark.functions.text import strip

# Fixed values that decide the results.
SEVERITIES = ("low", "medium", "high", "critical")
CRITICAL_TYPES = ("rebar_exposure", "collapse", "hotspot")
ACTIONS = (
    (0.75, "immediate", "Inspect on site before further loading or operation."),
    (0.55, "urgent", "Schedule a close-range inspection within days."),
    (0.35, "planned", "Include in the next scheduled maintenance cycle."),
    (0.15, "monitor", "Re-survey at the next routine interval and compare."),
    (0.00, "record", "No action beyond keeping the record."),
)
GRADES = ((85.0, 1, "Excellent"), (70.0, 2, "Good"), (55.0, 3, "Fair"), (40.0, 4, "Poor"), (float("-inf"), 5, "Critical"))
AUTONOMOUS = ("AUTO", "MISSION", "AUTO.MISSION", "GUIDED", "AUTO.LOITER", "RTL", "AUTO.RTL", "SMART_RTL", "AUTO.LAND",
              "LAND", "AUTO.TAKEOFF", "TAKEOFF", "FOLLOW", "AUTO.FOLLOW_TARGET", "GUIDED_NOGPS")
ASSISTED = ("LOITER", "POSHOLD", "POSCTL", "ALT_HOLD", "ALTCTL", "BRAKE", "CIRCLE", "HOLD", "AUTO.LOITER_HOLD", "POSITION")
MANUAL = ("STABILIZE", "MANUAL", "ACRO", "SPORT", "DRIFT", "RATTITUDE", "STABILIZED", "FBWA", "FBWB", "CRUISE")
AIRBORNE_PHASES = ("armed", "flying", "paused")
CAMERA_SOLUTIONS = {0: "single", 1: "float", 16: "fixed", 34: "fixed", 50: "fixed"}


def severity_rank(severity) -> Column:
    out = F.when(col(severity) == SEVERITIES[0], 0)
    for rank, name in enumerate(SEVERITIES[1:], 1):
        out = out.when(col(severity) == name, rank)
    return out


def severity_of_rank(rank) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (col(rank) + 1).cast("int"))


def severity_of_detection(defect_type, confidence, area_px, image_area_px) -> Column:
    share = 100.0 * col(area_px) / F.greatest(F.lit(1), col(image_area_px))
    sure = col(confidence) >= 0.8
    return (F.when(col(defect_type).isin(*CRITICAL_TYPES) & sure, "critical").when(share >= 5.0, "critical")
            .when(share >= 1.0, "high").when(share >= 0.25, "medium").when(sure, "medium").otherwise("low"))


def _ladder(value: Column, steps, pick: int) -> Column:
    out = None
    for step in steps[:-1]:
        out = F.when(value >= step[0], F.lit(step[pick])) if out is None else out.when(value >= step[0], F.lit(step[pick]))
    return out.otherwise(F.lit(steps[-1][pick]))


def action_band(score) -> Column:
    return _ladder(col(score), ACTIONS, 1)


def action_guidance(score) -> Column:
    return _ladder(col(score), ACTIONS, 2)


def grade_of_integrity(integrity) -> Column:
    return _ladder(col(integrity), GRADES, 1)


def grade_label(integrity) -> Column:
    return _ladder(col(integrity), GRADES, 2)


def control_mode(mode) -> Column:
    name = F.upper(strip(F.coalesce(col(mode), F.lit(""))))
    return (F.when(name.isin(*AUTONOMOUS), "autonomous").when(name.isin(*ASSISTED), "assisted")
            .when(name.isin(*MANUAL), "manual").otherwise("unknown"))


def camera_solution(flag) -> Column:
    out = None
    for code, name in CAMERA_SOLUTIONS.items():
        out = F.when(col(flag) == code, name) if out is None else out.when(col(flag) == code, name)
    return out.otherwise(F.concat(F.lit("unknown("), col(flag).cast("string"), F.lit(")")))


def telemetry_warnings(battery="battery_pct", fix="gps_fix", link="link_quality_pct") -> Column:
    return F.array_compact(F.array(F.when(col(battery) < 20.0, "Battery low"), F.when(col(fix) < 3, "GPS fix degraded"),
                                   F.when(col(link) < 50.0, "Link quality low")))


def has_fix(lat="latitude", lon="longitude", fix="gps_fix") -> Column:
    """Usable position of a telemetry sample."""
    return (col(fix) >= 2) & ~((F.abs(col(lat)) < 1e-9) & (F.abs(col(lon)) < 1e-9))


def possibly_airborne(phase, clean_shutdown) -> Column:
    return col(phase).isin(*AIRBORNE_PHASES) & ~col(clean_shutdown)


def describe_gradient(percent) -> Column:
    p = F.abs(col(percent))
    slope = F.degrees(F.atan(p / 100.0))
    return F.struct(slope.alias("slope_deg"), F.when(p > 0, 100.0 / p).alias("one_in"), (p / 100.0 * 12.0).alias("rise_per_12"))
