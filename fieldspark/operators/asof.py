"""As-of joins on time, without collecting a bundle into one task.

Reference and sensor rows are laid on one time line. Each reference row receives the last sensor
row at or before it and the first one after it (carried across chunk borders), and picks from the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldspark.operators.ordered import block, carry

# Tolerances in milliseconds (fixed values).
FRAME_TOLERANCE_MS = 120.0
LIDAR_TOLERANCE_MS = 220.0
IMU_TOLERANCE_MS = 50.0
GNSS_TOLERANCE_MS = 250.0

# Rows of a time line that one task sorts: its memory stays the same, and the tasks become more.
ROWS_A_TASK = 100_000


def bracket_all(ref: DataFrame, others: list[tuple[DataFrame, list[str]]], keys: list[str], *, t: str = "t_ms", seq: str = "seq",
                chunk_ms: float = 3_600_000.0) -> DataFrame:
    """Add ``_lo<i>`` (last sample with time <= t, first and last of equal times), ``_hi<i>`` (first sample after t) and
    ``_n<i>`` (distinct sample times up to t) of every sensor ``others[i] = (samples, payload)`` to every reference row.

    All sensors share one time line, so the rows are grouped once by time and swept once, however many sensors there are.
    Samples without a time are left out; equal times without ``seq`` come first. The rows are counted first, for the number of tasks.
    """
    counted = ref.select(F.lit(1))
    for other, _ in others:
        counted = counted.unionByName(other.select(F.lit(1)))
    parts = counted.count() // ROWS_A_TASK + 1
    samples, aggs = None, []
    for i, (other, payload) in enumerate(others):
        rows = other.where(F.col(t).isNotNull()).select(*keys, t, F.struct(seq).alias(f"_q{i}"), F.struct(t, *payload).alias(f"_r{i}"))
        samples = rows if samples is None else samples.unionByName(rows, allowMissingColumns=True)
        row, at = F.col(f"_r{i}"), F.col(f"_q{i}")
        aggs.append(F.when(F.count(row) > 0, F.struct(F.min_by(row, at).alias("first"), F.max_by(row, at).alias("last"))).alias(f"_s{i}"))
    ref_cols = [c for c in ref.columns if c not in keys and c != t]
    held = [F.struct(*ref_cols).alias("_ref")] if ref_cols else []
    line = (samples.repartition(parts, *keys, t).groupBy(*keys, t).agg(*aggs).withColumn("_side", F.lit(0))
            .unionByName(ref.select(*keys, t, F.lit(1).alias("_side"), *held), allowMissingColumns=True))
    # samples sort before references of the same time, so "forward" from a reference is strictly later
    span = range(len(others))
    out = carry(line, keys, [t, "_side"], [block(t, chunk_ms)], {f"_lo{i}": f"_s{i}" for i in span}, {f"_hi{i}": f"_s{i}" for i in span},
                {f"_n{i}": f"_s{i}" for i in span}, parts)
    return (out.where(F.col("_side") == 1)
            .select(*keys, t, *[F.col(f"_ref.{c}").alias(c) for c in ref_cols], *[f"_{x}{i}" for i in span for x in ("lo", "hi", "n")]))


def bracket(ref: DataFrame, other: DataFrame, keys: list[str], payload: list[str], *, t: str = "t_ms", seq: str = "seq",
            chunk_ms: float = 3_600_000.0) -> DataFrame:
    """``bracket_all`` of one sensor, as ``lo``, ``hi`` and ``lo_count``."""
    b = bracket_all(ref, [(other, payload)], keys, t=t, seq=seq, chunk_ms=chunk_ms)
    return b.withColumnsRenamed({"_lo0": "lo", "_hi0": "hi", "_n0": "lo_count"})


def _nearest(i: int, payload: list[str], tolerance: float, t: str, prefix: str) -> list[Column]:
    lo, hi = F.col(f"_lo{i}.first"), F.col(f"_hi{i}.first")
    before, after = F.col(t) - lo[t], hi[t] - F.col(t)
    pick = F.when(before.isNotNull() & (after.isNull() | (before <= after)), lo).otherwise(hi)
    delta = F.abs(pick[t] - F.col(t))
    return [delta.alias(prefix + "delta"), *[F.when(delta <= tolerance, pick[c]).alias(prefix + c) for c in payload]]


def _interpolated(i: int, scalars: list[str], vectors: list[str], held: list[str], tolerance: float, t: str, prefix: str) -> list[Column]:
    none, last = F.col(f"_lo{i}").isNull(), F.col(f"_hi{i}").isNull()
    lo, hi = F.col(f"_lo{i}.last"), F.col(f"_hi{i}.first")
    at_start = none | ((F.col(f"_n{i}") <= 1) & (lo[t] == F.col(t)))
    start = F.when(none, hi).otherwise(F.col(f"_lo{i}.first"))
    alpha = (F.col(t) - lo[t]) / F.nullif(hi[t] - lo[t], F.lit(0.0))
    delta = (F.when(at_start, F.abs(F.col(t) - start[t])).when(last, F.abs(F.col(t) - lo[t]))
             .otherwise(F.least(F.abs(F.col(t) - lo[t]), F.abs(F.col(t) - hi[t]))))

    def value(c: str, blend: Column) -> Column:
        return F.when(delta <= tolerance, F.when(at_start, start[c]).when(last, lo[c]).otherwise(blend)).alias(prefix + c)

    def mixed(c: str) -> Column:
        both = F.zip_with(F.slice(lo[c], 1, 3), F.slice(hi[c], 1, 3), lambda p, q: p + (q - p) * alpha)
        return F.when((F.size(lo[c]) >= 3) & (F.size(hi[c]) >= 3), both).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))

    return [delta.alias(prefix + "delta"), *[value(c, lo[c] + (hi[c] - lo[c]) * alpha) for c in scalars],
            *[value(c, mixed(c)) for c in vectors], *[value(c, lo[c]) for c in held]]


def _with(bracketed: DataFrame, sensors: int, columns: list[Column]) -> DataFrame:
    return bracketed.select("*", *columns).drop(*[f"_{x}{i}" for i in range(sensors) for x in ("lo", "hi", "n")])


def nearest(ref: DataFrame, other: DataFrame, keys: list[str], payload: list[str], tolerance: float, *, t: str = "t_ms",
            seq: str = "seq", prefix: str = "near_", chunk_ms: float = 3_600_000.0) -> DataFrame:
    """Nearest sample by absolute time difference; a tie takes the earlier one.

    The difference is reported always; the payload is null beyond the tolerance.
    """
    return _with(bracket_all(ref, [(other, payload)], keys, t=t, seq=seq, chunk_ms=chunk_ms), 1, _nearest(0, payload, tolerance, t, prefix))


def interpolate(ref: DataFrame, other: DataFrame, keys: list[str], scalars: list[str], vectors: list[str], held: list[str],
                tolerance: float, *, t: str = "t_ms", seq: str = "seq", prefix: str = "at_",
                chunk_ms: float = 3_600_000.0) -> DataFrame:
    """Linear interpolation between the bracketing samples, clamped at both ends.

    ``held`` columns come from the earlier sample. The difference to the closer sample is always
    reported; values are null beyond the tolerance.
    """
    b = bracket_all(ref, [(other, scalars + vectors + held)], keys, t=t, seq=seq, chunk_ms=chunk_ms)
    return _with(b, 1, _interpolated(0, scalars, vectors, held, tolerance, t, prefix))


def align_sensors(rgb: DataFrame, thermal: DataFrame, bands: dict[str, DataFrame], lidar: DataFrame, imu: DataFrame,
                  gnss: DataFrame, *, chunk_ms: float = 3_600_000.0) -> DataFrame:
    """One row per reference frame with every other sensor attached, all in one sweep of one time line.

    The reference of a bundle is its RGB stream, or its thermal stream where it has no RGB.
    All inputs carry ``bundle_id, t_ms, seq``; frames carry ``path``, imu ``accel, gyro``,
    gnss ``lat, lon, alt_m, fix``.
    """
    has_rgb = rgb.select("bundle_id").distinct()
    ref = (rgb.select("bundle_id", "t_ms", "seq", F.col("path").alias("ref_path"), F.lit("rgb").alias("reference_sensor"))
           .unionByName(thermal.join(has_rgb, "bundle_id", "left_anti")
                        .select("bundle_id", "t_ms", "seq", F.col("path").alias("ref_path"), F.lit("thermal").alias("reference_sensor"))))
    ref = ref.withColumnRenamed("seq", "ref_seq")
    names = sorted(bands)
    frames = [("thermal_", thermal, FRAME_TOLERANCE_MS), *[(f"ms_{n}_", bands[n], FRAME_TOLERANCE_MS) for n in names], ("lidar_", lidar, LIDAR_TOLERANCE_MS)]
    sensors = [(df, ["path"]) for _, df, _ in frames] + [(imu, ["accel", "gyro"]), (gnss, ["lat", "lon", "alt_m", "fix"])]
    columns = [c for i, (prefix, _, tolerance) in enumerate(frames) for c in _nearest(i, ["path"], tolerance, "t_ms", prefix)]
    k = len(frames)
    columns += _interpolated(k, [], ["accel", "gyro"], [], IMU_TOLERANCE_MS, "t_ms", "imu_")
    columns += _interpolated(k + 1, ["lat", "lon", "alt_m"], [], ["fix"], GNSS_TOLERANCE_MS, "t_ms", "gnss_")
    out = _with(bracket_all(ref, sensors, ["bundle_id"], chunk_ms=chunk_ms), len(sensors), columns)
    paths, deltas = [], [F.lit("thermal"), F.col("thermal_delta"), F.lit("lidar"), F.col("lidar_delta"),
                         F.lit("imu"), F.col("imu_delta"), F.lit("gnss"), F.col("gnss_delta")]
    for name in names:
        paths += [F.lit(name), F.col(f"ms_{name}_path")]
        deltas += [F.lit(f"multispectral_{name}"), F.col(f"ms_{name}_delta")]
    multi = F.map_filter(F.create_map(*paths), lambda k, v: v.isNotNull()) if paths else F.create_map().cast("map<string,string>")
    return out.withColumn("multispectral", multi).withColumn("sync_error_ms", F.map_filter(F.create_map(*deltas), lambda k, v: v.isNotNull()))


def alignment_stats(aligned: DataFrame) -> DataFrame:
    """Match percentages and mean absolute differences of each sensor, per bundle."""
    def pct(c: Column) -> Column:
        return 100.0 * F.count_if(c) / F.count(F.lit(1))
    return aligned.groupBy("bundle_id").agg(
        F.first("reference_sensor").alias("reference_sensor"), F.count(F.lit(1)).alias("frame_count"),
        pct(F.col("thermal_path").isNotNull()).alias("thermal_match_pct"), pct(F.col("lidar_path").isNotNull()).alias("lidar_match_pct"),
        pct(F.col("imu_accel").isNotNull()).alias("imu_match_pct"), pct(F.col("gnss_lat").isNotNull()).alias("gnss_match_pct"),
        F.avg("thermal_delta").alias("thermal_mean_ms"), F.avg("lidar_delta").alias("lidar_mean_ms"),
        F.avg("imu_delta").alias("imu_mean_ms"), F.avg("gnss_delta").alias("gnss_mean_ms"))
