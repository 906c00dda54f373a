"""Camera, radiometry, crack and hazard formulas as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from fieldspark.functions.geo import col, METRES_PER_DEGREE_LON, WGS84_A

ABSOLUTE_ZERO_C = -273.15
MIN_PHYSICAL_KELVIN = 1.0
MAX_PHYSICAL_KELVIN = 5000.0
GPS_EPOCH_SECONDS = 315964800       # 1980-01-06 in Unix time
DEFAULT_LEAP_SECONDS = 18


def clip(value: Column, lo: float, hi: float) -> Column:
    """Value within bounds; null stays null."""
    return F.when(value > hi, F.lit(float(hi))).when(value < lo, F.lit(float(lo))).otherwise(value)


def gps_to_utc(week, seconds, leap: int = DEFAULT_LEAP_SECONDS) -> Column:
    whole = F.lit(GPS_EPOCH_SECONDS) + col(week).cast("long") * 604800 - leap
    return F.timestamp_micros((whole * 1_000_000 + F.round(col(seconds) * 1_000_000)).cast("long"))


# pinhole cameras
def gsd_cm(altitude, sensor_w, focal, image_w) -> Column:
    return F.when(col(altitude) > 0, col(altitude) * (col(sensor_w) / col(focal)) / col(image_w) * 100.0)


def footprint_m(altitude, sensor_w, sensor_h, focal) -> Column:
    scale = F.when(col(altitude) > 0, col(altitude) / col(focal))
    return F.struct((col(sensor_w) * scale).alias("width"), (col(sensor_h) * scale).alias("height"))


def fov_deg(sensor, focal) -> Column:
    return F.degrees(2.0 * F.atan(col(sensor) / (2.0 * col(focal))))


def altitude_for_gsd_m(gsd, sensor_w, focal, image_w) -> Column:
    return F.when(col(gsd) > 0, col(gsd) / 100.0 * col(image_w) / (col(sensor_w) / col(focal)))


def megapixels(width, height) -> Column:
    return col(width) * col(height) / 1_000_000


def pixel_pitch_um(sensor_w, image_w) -> Column:
    return col(sensor_w) * 1000.0 / col(image_w)


def shutter_s(speed, gsd, blur_px: float = 0.7) -> Column:
    motion = F.greatest(F.lit(1e-4), col(gsd) / 100.0) * max(0.2, blur_px)
    return clip(motion / F.greatest(F.lit(0.5), col(speed)), 1 / 2000, 1 / 250)


def sample_gsd(pixel, epsg, top, bottom, recorded=None) -> Column:
    """Ground metres per pixel of a tile, corrected for web-mercator and degree grids."""
    lat3857 = F.degrees(2 * F.atan(F.exp(col(top) / WGS84_A)) - math.pi / 2)
    lat4326 = (col(top) + col(bottom)) / 2
    value = (F.when(col(epsg) == 3857, F.abs(col(pixel)) * F.cos(F.radians(lat3857)))
             .when(col(epsg) == 4326, F.abs(col(pixel)) * METRES_PER_DEGREE_LON * F.cos(F.radians(lat4326)))
             .otherwise(F.abs(col(pixel))))
    return value if recorded is None else F.coalesce(F.nullif(col(recorded), F.lit(0.0)), value)


# radiometry: calibration columns r1, r2, b, f, o, emissivity, reflected_c, transmission
def raw_to_kelvin(raw, r1, r2, b, f, o) -> Column:
    ratio = col(r1) / F.nullif(col(r2) * (col(raw) + col(o)), F.lit(0.0)) + col(f)
    kelvin = F.when((ratio > 0) & (F.abs(ratio - 1.0) > 1e-12), col(b) / F.log(ratio))
    return F.when((kelvin > MIN_PHYSICAL_KELVIN) & (kelvin < MAX_PHYSICAL_KELVIN), kelvin)


def kelvin_to_raw(kelvin, r1, r2, b, f, o) -> Column:
    return col(r1) / (col(r2) * (F.exp(col(b) / col(kelvin)) - col(f))) - col(o)


def emissivity_corrected(raw, r1, r2, b, f, o, emissivity, reflected_c, transmission) -> Column:
    e, t = clip(col(emissivity), 0.01, 1.0), clip(col(transmission), 0.01, 1.0)
    ambient = kelvin_to_raw(col(reflected_c) - ABSOLUTE_ZERO_C, r1, r2, b, f, o)
    return (col(raw) - (1.0 - e) * t * ambient) / (e * t)


def raw_to_celsius(raw, r1, r2, b, f, o, emissivity, reflected_c, transmission) -> Column:
    """Null where the constants are missing or no physical temperature exists."""
    surface = emissivity_corrected(raw, r1, r2, b, f, o, emissivity, reflected_c, transmission)
    return raw_to_kelvin(surface, r1, r2, b, f, o) + ABSOLUTE_ZERO_C


# cracks
def stress_intensity(length_m, sigma, delta_sigma=12.0, factor: float = 1.12, toughness: float = 32.0) -> Column:
    a = F.greatest(F.lit(1e-6), 0.5 * col(length_m))
    y = max(0.5, factor)
    root = F.sqrt(math.pi * a)
    crit = F.pow(toughness / F.greatest(y * col(sigma), F.lit(1e-9)), 2) / math.pi
    return F.struct((y * col(sigma) * root).alias("k_i"), (y * col(delta_sigma) * root).alias("delta_k"),
                    a.alias("half_length_m"), crit.alias("a_crit_m"),
                    clip(crit / F.greatest(a, F.lit(1e-9)), 0.0, 100.0).alias("fos"))


def paris_step(delta_k, c, m, cycles) -> Column:
    grown = F.greatest(F.lit(0.0), col(c)) * F.pow(F.greatest(col(delta_k), F.lit(1e-9)), col(m)) * col(cycles)
    return F.when((col(cycles) <= 0) | (col(delta_k) <= 0), F.lit(0.0)).otherwise(grown)


def failure_probability(a, a_crit) -> Column:
    progress = clip(col(a) / F.greatest(col(a_crit), F.lit(1e-9)), 0.0, 5.0)
    return clip(1.0 - F.exp(-F.greatest(F.lit(0.0), progress - 0.80) * 1.4), 0.0, 1.0)


def crack_risk(fos, fail_p, grew) -> Column:
    return (F.when((col(fos) < 1.0) | (col(fail_p) > 0.5), "Critical")
            .when((col(fos) < 1.5) | (col(fail_p) > 0.2) | col(grew), "High")
            .when((col(fos) < 3.0) | (col(fail_p) > 0.05), "Medium").otherwise("Low"))


def hazard_probability(hazard, years) -> Column:
    return 1.0 - F.exp(-col(hazard) * col(years))


def detection_floor(first_m, second_m, registration_m) -> Column:
    return F.hypot(col(first_m), col(second_m)) + F.abs(col(registration_m))
