"""Raster algebra on cell tables ``(keys..., row_idx, col_idx, value columns)``.

Absent or null cells are no data. Group totals are partial aggregates; stencils run on tiles that carry a rim of their
neighbours' cells, one shuffle each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fieldspark.functions.geo import aspect_deg, in_ring
from fieldspark.functions.physics import detection_floor
from fieldspark.operators.components import TILE, label_regions
from fieldspark.operators.ordered import join_side, quantiles
from fieldspark.session import cut

# Thresholds of the measurements (fixed values).
CHANGE_THRESHOLD_M = 0.05
ABOVE_GROUND_M = 0.5
MIN_SLOPE_CELLS = 12
PLANAR_SHARE = 0.15
MIN_REGION_CELLS = 9
NOISE_MULTIPLE = 2.0
INDICES = {"ndvi": ("nir", "red"), "gndvi": ("nir", "green"), "ndre": ("nir", "red_edge")}


def aligned_grids(first: DataFrame, second: DataFrame, keys: list[str], affine_tol: float = 1e-9) -> DataFrame:
    """``keys, status, reason``: whether two ``grid_meta`` tables describe the same grid."""
    a, b = first.alias("a"), second.alias("b")
    j = a.join(b, keys, "full_outer")
    px = lambda t: F.sqrt(F.abs(F.col(f"{t}.a") * F.col(f"{t}.e")))
    off = F.lit(False)
    for c in "abcdef":
        off = off | (F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) > affine_tol)
    reason = (F.when(F.col("a.width").isNull() | F.col("b.width").isNull(), "one survey is missing")
              .when(~F.col("a.epsg").eqNullSafe(F.col("b.epsg")), "different coordinate systems")
              .when((F.col("a.width") != F.col("b.width")) | (F.col("a.height") != F.col("b.height")), "different raster shapes")
              .when(F.abs(px("a") - px("b")) > 1e-6 * F.greatest(px("a"), px("b")), "different resolutions")
              .when(off, "different grid origins or orientations"))
    return j.select(*keys, F.when(reason.isNull(), "ok").otherwise("refused").alias("status"), reason.alias("reason"))


def difference(first: DataFrame, second: DataFrame, keys: list[str], value: str = "value", status: DataFrame | None = None) -> DataFrame:
    """Cells known in both grids with ``earlier, later, delta``; refused surveys yield no cell."""
    at = keys + ["row_idx", "col_idx"]
    out = (first.where(F.col(value).isNotNull()).select(*at, F.col(value).alias("earlier"))
           .join(second.where(F.col(value).isNotNull()).select(*at, F.col(value).alias("later")), at))
    if status is not None:
        out = out.join(status.where("status = 'ok'").select(*keys), keys, "left_semi")
    return out.withColumn("delta", F.col("later") - F.col("earlier"))


def surface_change(diff: DataFrame, keys: list[str], cell_area: Column | float, threshold: float = CHANGE_THRESHOLD_M) -> DataFrame:
    """Added, removed and net volume over every compared cell; changed area over the threshold only."""
    d = F.col("delta")
    return (diff.withColumn("_a", F.lit(cell_area)).groupBy(*keys).agg(
        F.sum(F.when(d > 0, d * F.col("_a")).otherwise(0.0)).alias("added_volume_m3"),
        F.sum(F.when(d < 0, -d * F.col("_a")).otherwise(0.0)).alias("removed_volume_m3"),
        F.sum(d * F.col("_a")).alias("net_volume_m3"),
        F.greatest(F.lit(0.0), F.max(d)).alias("max_rise_m"), F.greatest(F.lit(0.0), -F.min(d)).alias("max_fall_m"),
        F.sum(F.when(F.abs(d) >= threshold, F.col("_a")).otherwise(0.0)).alias("changed_area_m2"),
        F.count(F.lit(1)).alias("compared_cells")))


def clip_to_ring(cells: DataFrame, x: str, y: str, ring: Column) -> DataFrame:
    """Cells whose centre lies in one literal ring."""
    return cells.where(in_ring(x, y, ring))


def volumes(cells: DataFrame, keys: list[str], value: str, cell_area: Column | float, *, dtm: str | None = None,
            base: float | None = None) -> DataFrame:
    """Cut, fill and net per datum (``reference``): dtm, plane (given or the minimum) and lowest point.

    ``preferred`` marks the datum to quote. Without a valid cell no row exists for the group; see
    :func:`with_refusals`.
    """
    v = F.col(value)
    known = cells.where(v.isNotNull()).withColumn("_a", F.lit(cell_area))
    low = known.groupBy(*keys).agg(F.min(v).alias("_min"))
    # the minimum of a group comes back to its cells through the small per-group table
    j = join_side(known, low, keys)
    if base is not None:
        j = j.withColumn("_base", F.lit(float(base)))
    refs = [F.struct(F.lit("plane").alias("reference"), (F.col("_base") if base is not None else F.col("_min")).alias("datum"))]
    if base is not None:
        refs.append(F.struct(F.lit("lowest_point").alias("reference"), F.col("_min").alias("datum")))
    if dtm:
        refs.insert(0, F.struct(F.lit("dtm").alias("reference"), F.col(dtm).alias("datum")))
    d = v - F.col("_r.datum")
    out = (j.withColumn("_r", F.explode(F.array(*refs))).where(F.col("_r.datum").isNotNull())
           .groupBy(*keys, F.col("_r.reference").alias("reference")).agg(
               F.sum(F.when(d > 0, d * F.col("_a")).otherwise(0.0)).alias("cut_m3"),
               F.sum(F.when(d < 0, -d * F.col("_a")).otherwise(0.0)).alias("fill_m3"),
               F.sum(d * F.col("_a")).alias("net_m3"), F.sum("_a").alias("area_m2"), F.count(F.lit(1)).alias("cell_count"),
               F.avg(d).alias("mean_height_m"), F.max(d).alias("max_height_m")))
    best = F.lit("dtm" if dtm else "plane")
    return out.withColumn("preferred", F.col("reference") == best)


def with_refusals(groups: DataFrame, result: DataFrame, keys: list[str], reason: str, probe: str) -> DataFrame:
    """Every group of ``groups`` with the result or with ``status = refused`` and a reason."""
    return (groups.select(*keys).distinct().join(result, keys, "left")
            .withColumn("status", F.when(F.col(probe).isNull(), "refused").otherwise("ok"))
            .withColumn("reason", F.when(F.col(probe).isNull(), F.lit(reason))))


def terrain_stats(cells: DataFrame, keys: list[str], value: str, cell_area: Column | float, total_cells: Column, ground: str | None = None) -> DataFrame:
    v = F.col(value)
    aggs = [F.sum(F.when(v.isNotNull(), F.col("_a")).otherwise(0.0)).alias("covered_area_m2"),
            (F.count(v) / F.first("_t")).alias("coverage_fraction"), F.min(v).alias("min_m"), F.max(v).alias("max_m"),
            F.avg(v).alias("mean_m"), (F.max(v) - F.min(v)).alias("relief_m")]
    if ground:
        h = v - F.col(ground)
        aggs += [F.avg(h).alias("mean_height_m"), F.max(h).alias("max_height_m"),
                 F.sum(F.when(h > ABOVE_GROUND_M, F.col("_a")).otherwise(0.0)).alias("above_ground_area_m2")]
    return cells.withColumn("_a", F.lit(cell_area)).withColumn("_t", total_cells).groupBy(*keys).agg(*aggs)


def stencil(cells: DataFrame, keys: list[str], inputs: list[Column], made: list[str], rim: int,
            fn: Callable[[np.ndarray, list[np.ndarray]], list[np.ndarray]], tile: int = TILE) -> DataFrame:
    """``cells`` with columns ``made``, which depend on cells up to ``rim`` rows and columns away.

    A cell goes to its tile and, without its other columns, to tiles whose rim it lies in. ``fn`` gets the mask of present cells
    and one array per input (NaN: no data), of a tile with its rim, and gives one array per column.
    """
    sent = cells.select(F.struct(*[F.col(c) for c in cells.columns]).alias("_row"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                        F.col("row_idx").cast("long").alias("_r"), F.col("col_idx").cast("long").alias("_c"), *[v.cast("double").alias(f"_v{i}") for i, v in enumerate(inputs)])
    reach = lambda v: F.sequence(F.floor((F.col(v) - rim) / tile), F.floor((F.col(v) + rim) / tile))
    sent = sent.withColumn("_tr", F.explode(reach("_r"))).withColumn("_tc", F.explode(reach("_c")))
    own = (F.floor(F.col("_r") / tile) == F.col("_tr")) & (F.floor(F.col("_c") / tile) == F.col("_tc"))
    sent = sent.withColumn("_own", own).withColumn("_row", F.when(F.col("_own"), F.col("_row")))
    side, count = tile + 2 * rim, len(inputs)

    def run(table: pa.Table) -> pa.Table:
        r = table["_r"].to_numpy() - (table["_tr"][0].as_py() * tile - rim)
        c = table["_c"].to_numpy() - (table["_tc"][0].as_py() * tile - rim)
        present, arrays = np.zeros((side, side), bool), []
        present[r, c] = True
        for i in range(count):
            arrays.append(np.full((side, side), np.nan))
            arrays[-1][r, c] = table[f"_v{i}"].to_numpy()
        mine = table["_own"].to_numpy()
        out = [v[r[mine], c[mine]] for v in fn(present, arrays)]
        return pa.table([table["_row"].filter(pa.array(mine)), *[pa.array(v, mask=np.isnan(v)) for v in out]], names=["_row", *made])

    schema = StructType([sent.schema["_row"], *[StructField(m, DoubleType()) for m in made]])
    found = sent.groupBy(*[f"_k{i}" for i in range(len(keys))], "_tr", "_tc").applyInArrow(run, schema)
    return found.select(*[F.col("_row").getField(c).alias(c) for c in cells.columns if c not in made], *made)


def gradients(cells: DataFrame, keys: list[str], value: str, width: Column, height: Column, step_x: float, step_y: float, tile: int = TILE) -> DataFrame:
    """Add ``dz_east, dz_north``: central differences, one-sided on the raster rim, null next to no data."""
    end = lambda axis, size: F.when(F.col(axis) == 0, 1).when(F.col(axis) == size - 1, 2).otherwise(0)

    def slope(z: np.ndarray, at: np.ndarray, spacing: float) -> np.ndarray:
        """Along the second axis."""
        before, after = np.full(z.shape, np.nan), np.full(z.shape, np.nan)
        before[:, 1:], after[:, :-1] = z[:, :-1], z[:, 1:]
        return np.where(at == 1, (after - z) / spacing, np.where(at == 2, (z - before) / spacing, (after - before) / (2 * spacing)))

    def both(present: np.ndarray, v: list[np.ndarray]) -> list[np.ndarray]:
        return [slope(v[0], v[1], step_x), -slope(v[0].T, v[2].T, step_y).T]

    return stencil(cells, keys, [F.col(value), end("col_idx", width), end("row_idx", height)], ["dz_east", "dz_north"], 1, both, tile)


def plane_fit(points: DataFrame, keys: list[str], x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Least-squares ``z = a x + b y + c`` from centred moments; null where the points are collinear."""
    m = points.where(F.col(z).isNotNull()).groupBy(*keys).agg(
        F.count(z).alias("n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.avg(z).alias("_mz"), F.var_pop(x).alias("_xx"),
        F.var_pop(y).alias("_yy"), F.var_pop(z).alias("_zz"), F.covar_pop(x, y).alias("_xy"), F.covar_pop(x, z).alias("_xz"),
        F.covar_pop(y, z).alias("_yz"), (F.max(z) - F.min(z)).alias("height_range_m"))
    det = F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")
    ok = F.abs(det) > 1e-12 * F.greatest(F.lit(1e-12), F.col("_xx") * F.col("_yy"))
    a = F.when(ok, (F.col("_xz") * F.col("_yy") - F.col("_yz") * F.col("_xy")) / det)
    b = F.when(ok, (F.col("_yz") * F.col("_xx") - F.col("_xz") * F.col("_xy")) / det)
    m = m.withColumn("a", a).withColumn("b", b)
    rest = F.col("_zz") - F.col("a") * F.col("_xz") - F.col("b") * F.col("_yz")
    return m.select(*keys, "n", "a", "b", (F.col("_mz") - F.col("a") * F.col("_mx") - F.col("b") * F.col("_my")).alias("c"),
                    F.sqrt(F.greatest(F.lit(0.0), rest)).alias("residual_m"), "height_range_m")


def slope_stats(grads: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per survey gradient distribution and fitted plane; refused below twelve usable cells.

    Expects ``x, y`` and the output of :func:`gradients`.
    """
    use = grads.where(F.col(value).isNotNull() & F.col("dz_east").isNotNull() & F.col("dz_north").isNotNull())
    size = F.hypot("dz_east", "dz_north")
    # five passes read it
    use = cut(use.select(*dict.fromkeys([*keys, "x", "y", value, "dz_east", "dz_north"]), size.alias("_mag"), F.degrees(F.atan(size)).alias("_deg")))
    dist = use.groupBy(*keys).agg(F.count(F.lit(1)).alias("cell_count"), F.avg("_deg").alias("mean_deg"), F.max("_deg").alias("max_deg"),
                                  (F.avg("_mag") * 100.0).alias("mean_percent"),
                                  aspect_deg(F.avg("dz_east"), F.avg("dz_north")).alias("aspect_deg"))
    q = quantiles(use, keys, "_deg", {"median_deg": 0.5, "p95_deg": 0.95})
    p = plane_fit(use, keys, "x", "y", value)
    p = p.select(*keys, F.degrees(F.atan(F.hypot("a", "b"))).alias("plane_dip_deg"), aspect_deg(F.col("a"), F.col("b")).alias("plane_aspect_deg"),
                 F.col("residual_m").alias("plane_residual_m"), "height_range_m",
                 ((F.col("height_range_m") > 0) & (F.col("residual_m") <= PLANAR_SHARE * F.col("height_range_m"))).alias("planar"))
    out = dist.join(q, keys, "left").join(p, keys, "left")
    return (out.withColumn("status", F.when(F.col("cell_count") >= MIN_SLOPE_CELLS, "ok").otherwise("refused"))
            .withColumn("reason", F.when(F.col("cell_count") < MIN_SLOPE_CELLS, "too few cells for a gradient")))


def hillshade(grads: DataFrame, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Add ``shade`` 0..255. Uses downward row order, as display rasters do."""
    import math
    dx, dy = F.col("dz_east"), -F.col("dz_north")
    az, alt = math.radians(360.0 - azimuth + 90.0), math.radians(altitude)
    slope, aspect = F.atan(F.hypot(dx, dy)), F.atan2(-dx, dy)
    shaded = math.sin(alt) * F.cos(slope) + math.cos(alt) * F.sin(slope) * F.cos(az - aspect)
    return grads.withColumn("shade", F.greatest(F.lit(0), F.least(F.lit(255), ((shaded + 1.0) * 127.5).cast("int"))))


def sliding(z: np.ndarray, half: int, take: np.ufunc, empty: float) -> np.ndarray:
    """Least or greatest value within ``half`` places along the second axis: running values from the borders of blocks as wide
    as the window, two of which make up every window."""
    wide = 2 * half + 1
    rows, cols = z.shape
    padded = np.full((rows, -(-(cols + 2 * half) // wide) * wide), empty)
    padded[:, half:half + cols] = z
    blocks = padded.reshape(rows, -1, wide)
    ahead = take.accumulate(blocks, axis=2).reshape(rows, -1)
    behind = take.accumulate(blocks[:, :, ::-1], axis=2)[:, :, ::-1].reshape(rows, -1)
    return take(behind[:, :cols], ahead[:, 2 * half:2 * half + cols])


def grid_opening(cells: DataFrame, keys: list[str], value: str, kernel: int, tile: int = TILE) -> DataFrame:
    """Erosion then dilation with a square kernel of odd side; no-data cells take the survey maximum first."""
    half = kernel // 2

    def opened(present: np.ndarray, v: list[np.ndarray]) -> list[np.ndarray]:
        z = v[0]
        for take, empty in ((np.minimum, np.inf), (np.maximum, -np.inf)):
            for turn in (False, True):
                z = np.where(present, z, empty)  # absent cells take no part in a window
                z = sliding(z.T, half, take, empty).T if turn else sliding(z, half, take, empty)
        return [np.where(np.isfinite(z) & present, z, np.nan)]

    top = cells.groupBy(*keys).agg(F.max(value).alias("_fill"))
    filled = join_side(cells, top, keys)
    out = stencil(filled, keys, [F.coalesce(value, "_fill")], ["_z"], 2 * half, opened, tile)
    return out.withColumn("ground", F.when(F.col(value).isNotNull(), F.col("_z"))).drop("_z", "_fill")


def opening_kernel(pixel_m: float) -> int:
    return min(51, max(3, int(round(5.0 / max(pixel_m, 1e-6))) | 1))


def ndvi_frames(bands: DataFrame, keys: list[str]) -> DataFrame:
    """Frame statistics of (nir-red)/max(nir+red, 1e-6) from columns ``nir`` and ``red``."""
    nd = (F.col("nir") - F.col("red")) / F.greatest(F.col("nir") + F.col("red"), F.lit(1e-6))
    return bands.withColumn("ndvi", nd).groupBy(*keys).agg(F.avg("ndvi").alias("ndvi_mean"), F.min("ndvi").alias("ndvi_min"),
                                                           F.max("ndvi").alias("ndvi_max"), F.count("ndvi").alias("cells"))


def vegetation_indices(bands: DataFrame, calibration: dict[str, dict], indices: dict[str, tuple[str, str]] = INDICES) -> DataFrame:
    """Calibrated index columns; a band without calibration makes its indices null with a reason.

    ``calibration[band] = {scale, offset, lo, hi}``; band columns carry the band names.
    """
    out = bands
    for name, c in calibration.items():
        r = F.col(name) * c["scale"] + c["offset"]
        out = out.withColumn(f"_{name}", F.when((r >= c["lo"]) & (r <= c["hi"]), r))
    for index, (pos, neg) in indices.items():
        missing = [b for b in (pos, neg) if b not in calibration]
        if missing:
            out = out.withColumn(index, F.lit(None).cast("double")).withColumn(f"{index}_reason", F.lit(f"band missing: {', '.join(missing)}"))
            continue
        p, n = F.col(f"_{pos}"), F.col(f"_{neg}")
        ratio = F.when(F.abs(p + n) > 1e-8, (p - n) / (p + n))
        out = (out.withColumn(index, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))).withColumn(index, F.when(ratio.isNotNull(), F.col(index)))
               .withColumn(f"{index}_reason", F.lit(None).cast("string")))
    return out.drop(*[f"_{n}" for n in calibration])


def class_areas(cells: DataFrame, keys: list[str], class_col: str, categories: dict[str, list[int]], cell_area: Column | float) -> DataFrame:
    """One row per group and category: area, or unavailable when the schema has no such class."""
    counted = cells.where(F.col(class_col).isNotNull()).withColumn("_a", F.lit(cell_area))
    aggs = [F.sum(F.when(F.col(class_col).isin(ids), F.col("_a")).otherwise(0.0)).alias(name) for name, ids in categories.items() if ids]
    wide = counted.groupBy(*keys).agg(*aggs, F.sum("_a").alias("_whole"))
    rows = [F.struct(F.lit(n).alias("category"), (F.col(n) if ids else F.lit(None).cast("double")).alias("area_m2"),
                     F.lit("available" if ids else "unavailable").alias("status")) for n, ids in categories.items()]
    return wide.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*")


def canopy_cover(cells: DataFrame, keys: list[str], class_col: str, canopy: list[int], unwanted: list[int], soil: list[int], cell_area: Column | float) -> DataFrame:
    c = F.col(class_col)
    share = F.count_if(c.isin(canopy)) / F.nullif(F.count_if(c.isin(canopy + unwanted + soil)), F.lit(0))
    area = lambda ids: F.sum(F.when(c.isin(ids), F.col("_a")).otherwise(0.0))
    out = cells.withColumn("_a", F.lit(cell_area)).groupBy(*keys).agg(area(canopy).alias("canopy_area_m2"), area(canopy + unwanted + soil).alias("field_area_m2"),
                                                              (100.0 * share).alias("canopy_cover_percent"))
    return out.withColumn("status", F.when(F.col("canopy_cover_percent").isNull(), "refused").otherwise("ok"))


def stress_zones(cells: DataFrame, keys: list[str], index: str, canopy: Column, severe_below: float, moderate_below: float, cell_area: Column | float) -> DataFrame:
    if not severe_below < moderate_below:
        raise ValueError("severe_below must be under moderate_below")
    zone = (F.when(F.col(index) < severe_below, "severe_stress").when(F.col(index) < moderate_below, "moderate_stress")
            .otherwise("reference_or_healthy_range"))
    return (cells.where(canopy & F.col(index).isNotNull()).withColumn("zone", zone).withColumn("_a", F.lit(cell_area))
            .groupBy(*keys, "zone").agg(F.sum("_a").alias("area_m2"), F.count(F.lit(1)).alias("cell_count")))


def class_transitions(first: DataFrame, second: DataFrame, keys: list[str], class_col: str, ids: list[int], cell_area: Column | float) -> DataFrame:
    """Cells that hold one of the classes now and did not before (unknown before counts as not)."""
    at = keys + ["row_idx", "col_idx"]
    was = first.where(F.col(class_col).isin(ids)).select(*at)
    return (second.where(F.col(class_col).isin(ids)).join(was, at, "left_anti").withColumn("_a", F.lit(cell_area))
            .groupBy(*keys).agg(F.sum("_a").alias("new_area_m2"), F.count(F.lit(1)).alias("new_cells")))


def region_stats(regions: DataFrame, keys: list[str], value: str, cell_area: Column | float) -> DataFrame:
    """Cells, area, volume, extremes and mean cell position of labelled regions."""
    return (regions.withColumn("_a", F.lit(cell_area)).groupBy(*keys, "region").agg(
        F.count(F.lit(1)).alias("cell_count"), F.sum("_a").alias("area_m2"), F.sum(F.col(value) * F.col("_a")).alias("volume_m3"),
        F.avg(value).alias("mean_value"), F.max(value).alias("max_value"), F.min(value).alias("min_value"),
        F.avg("row_idx").alias("centroid_row"), F.avg("col_idx").alias("centroid_col")))


def change_regions(diff: DataFrame, keys: list[str], cell_area: Column | float, threshold: float, min_area_m2: float) -> DataFrame:
    """Eight-connected regions of rise and of fall at or over the threshold, smaller ones left out."""
    d = F.col("delta")
    marked = diff.withColumn("change", F.when(d >= threshold, "surface_rise").when(d <= -threshold, "surface_fall")).where("change is not null")
    lab = label_regions(marked, keys + ["change"], 8)
    out = region_stats(lab, keys + ["change"], "delta", cell_area).where(F.col("area_m2") >= min_area_m2)
    return out.select(*keys, "change", "region", "cell_count", "area_m2", F.abs("volume_m3").alias("volume_m3"), F.col("mean_value").alias("mean_delta_m"),
                      F.when(F.col("change") == "surface_rise", F.col("max_value")).otherwise(F.col("min_value")).alias("extreme_delta_m"))


def deformation_regions(diff: DataFrame, keys: list[str], cell_area: Column | float, first_accuracy: float | None, second_accuracy: float | None,
                        registration: float | None, min_cells: int = MIN_REGION_CELLS) -> DataFrame:
    """Four-connected subsidence and uplift regions beyond the detection floor.

    All three uncertainties must be stated; none has a default.
    """
    if first_accuracy is None or second_accuracy is None or registration is None:
        raise ValueError("displacement needs both survey accuracies and the registration residual")
    if first_accuracy <= 0 or second_accuracy <= 0:
        raise ValueError("survey accuracies must be positive")
    floor = detection_floor(F.lit(float(first_accuracy)), F.lit(float(second_accuracy)), F.lit(float(registration)))
    d = F.col("delta")
    moved = diff.where(F.abs(d) > floor).withColumn("direction", F.when(d < 0, "subsidence").otherwise("uplift"))
    lab = label_regions(moved, keys + ["direction"], 4).withColumn("_abs", F.abs("delta")).withColumn("_a", F.lit(cell_area))
    return (lab.groupBy(*keys, "direction", "region").agg(
        F.count(F.lit(1)).alias("cell_count"), F.sum("_a").alias("area_m2"), F.max("_abs").alias("max_displacement_m"),
        F.avg("_abs").alias("mean_displacement_m"), F.sum(F.col("delta") * F.col("_a")).alias("volume_change_m3"),
        F.avg("row_idx").alias("centroid_row"), F.avg("col_idx").alias("centroid_col")).where(F.col("cell_count") >= min_cells))


def remap_labels(cells: DataFrame, class_col: str, mapping: dict[int, int], variant: str, nodata: Column | None = None) -> DataFrame:
    """Class ids through a mapping. ``corpus``: unmapped becomes 0; ``semantic``: unmapped and no data become 255."""
    if variant not in ("corpus", "semantic"):
        raise ValueError("variant must be corpus or semantic")
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    new = F.coalesce(F.element_at(F.create_map(*pairs), F.col(class_col)), F.lit(0 if variant == "corpus" else 255))
    new = F.when(nodata, F.lit(255)).otherwise(new) if nodata is not None else new
    return cells.withColumn("label", new.cast("int"))


def remap_palette(cells: DataFrame, palette: dict[tuple[int, int, int], int]) -> DataFrame:
    """Label of an exact red/green/blue triple, else 0."""
    key = F.concat_ws(",", "red", "green", "blue")
    pairs = [x for (r, g, b), v in palette.items() for x in (F.lit(f"{r},{g},{b}"), F.lit(v))]
    return cells.withColumn("label", F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(0)))


def binarise(cells: DataFrame) -> DataFrame:
    return cells.withColumn("label", (F.greatest("red", "green", "blue") > 127).cast("int"))
