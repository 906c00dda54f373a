"""Statistics of zones and instances on cell tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldspark.operators.components import dilate, label_regions
from fieldspark.operators.spatial import zones_over_cells


def instance_zonal(cells: DataFrame, keys: list[str], instance: str, cell_area: Column | float, *, health: str | None = None, min_area: float = 0.0,
                   max_area: float | None = None) -> DataFrame:
    """Area, mean cell position and majority health class (ties: smallest id) of each positive instance id.

    Kept instances are numbered in id order.
    """
    rows = cells.where(F.col(instance) > 0).withColumn("_a", F.lit(cell_area))
    base = rows.groupBy(*keys, instance).agg(F.count(F.lit(1)).alias("cell_count"), F.sum("_a").alias("area_m2"),
                                             F.avg("row_idx").alias("centroid_row"), F.avg("col_idx").alias("centroid_col"))
    base = base.where(F.col("area_m2") >= min_area)
    if max_area is not None:
        base = base.where(F.col("area_m2") <= max_area)
    if health:
        votes = rows.where(F.col(health).isNotNull()).groupBy(*keys, instance, health).agg(F.count(F.lit(1)).alias("_n"))
        best = votes.groupBy(*keys, instance).agg(F.max_by(health, F.struct(F.col("_n"), -F.col(health))).alias("health_class"))
        base = base.join(best, keys + [instance], "left")
    # instances per survey: result-level rows
    return base.withColumn("instance_no", F.row_number().over(W.partitionBy(*keys).orderBy(instance)).cast("long"))


def missing_modules(layout_cells: DataFrame, observed: DataFrame, keys: list[str], feature: str) -> DataFrame:
    """Layout features with at least one cell, none of which holds an observed instance.

    ``layout_cells(keys, feature, row_idx, col_idx)`` from :func:`zones_over_cells`.
    """
    at = keys + ["row_idx", "col_idx"]
    covered = layout_cells.join(observed.select(*at).distinct(), at, "left_semi").select(*keys, feature).distinct()
    return layout_cells.select(*keys, feature).distinct().join(covered, keys + [feature], "left_anti")


def associate_findings(findings: DataFrame, inventory: DataFrame, keys: list[str], module: str) -> DataFrame:
    known = inventory.select(*keys, module, F.lit(True).alias("_known")).distinct()
    return (findings.join(known, keys + [module], "left")
            .withColumn("association", F.when(F.col("_known"), "associated").otherwise("review_candidate")).drop("_known"))


def module_arrays(cells: DataFrame, keys: list[str], instance: str, join_cells: int, height: int, width: int) -> DataFrame:
    """Array group of each module: instances whose cells join once grown by ``join_cells`` cross-shaped steps inside the raster."""
    occupied = cells.where(F.col(instance) > 0)
    grown = dilate(occupied, keys, join_cells).where(F.col("row_idx").between(0, height - 1) & F.col("col_idx").between(0, width - 1))
    lab = label_regions(grown, keys, 8)
    at = keys + ["row_idx", "col_idx"]
    return (occupied.join(lab.select(*at, "region"), at).groupBy(*keys, instance).agg(F.min("region").alias("array_id")))


def module_temperatures(cells: DataFrame, *, hot_cell: float, warning: float, critical: float) -> DataFrame:
    """Temperature statistics, peer deltas, findings and severity of each module.

    ``cells(site_id, string_id, module_id, row_idx, col_idx, celsius)``; null temperatures are invalid
    pixels. References: median of a string's module medians, median of a site's string medians.
    """
    key = ["site_id", "string_id", "module_id"]
    mod = cells.where(F.col("celsius").isNotNull()).groupBy(*key).agg(
        F.min("celsius").alias("min_c"), F.max("celsius").alias("max_c"), F.avg("celsius").alias("mean_c"), F.median("celsius").alias("median_c"),
        F.max_by(F.struct("row_idx", "col_idx"), F.struct(F.col("celsius"), -F.col("row_idx"), -F.col("col_idx"))).alias("hottest"),
        F.count(F.lit(1)).alias("cell_count"))
    string = mod.groupBy("site_id", "string_id").agg(F.median("median_c").alias("string_reference_c"))
    site = string.groupBy("site_id").agg(F.median("string_reference_c").alias("site_reference_c"))
    zero = F.lit(0.0)
    out = (mod.join(string, ["site_id", "string_id"]).join(site, "site_id")
           .withColumn("hot_cell_delta_c", F.greatest(zero, F.col("max_c") - F.col("median_c")))
           .withColumn("module_delta_c", F.greatest(zero, F.col("median_c") - F.col("string_reference_c")))
           .withColumn("string_delta_c", F.greatest(zero, F.col("string_reference_c") - F.col("site_reference_c"))))
    found = F.array_compact(F.array(F.when(F.col("hot_cell_delta_c") >= hot_cell, "hot_cell_candidate"),
                                    F.when(F.col("module_delta_c") >= warning, "module_deviation_candidate"),
                                    F.when(F.col("string_delta_c") >= warning, "string_deviation_candidate")))
    top = F.greatest("hot_cell_delta_c", "module_delta_c", "string_delta_c")
    return (out.withColumn("finding_types", found).withColumn("max_delta_c", top)
            .withColumn("severity", F.when(top >= critical, "critical").when(F.size("finding_types") > 0, "warning").otherwise("normal"))
            .withColumn("hottest_row", F.col("hottest.row_idx")).withColumn("hottest_col", F.col("hottest.col_idx")).drop("hottest"))


def iou_association(first: DataFrame, second: DataFrame, keys: list[str], value: str | None, *, min_iou: float, min_valid: float) -> DataFrame:
    """Overlap of two cell sets per key with intersection over union and valid share; refused below either limit.

    ``value`` is a column of ``second`` whose nulls count as invalid pixels.
    """
    at = keys + ["row_idx", "col_idx"]
    a = first.select(*at).distinct().withColumn("_a", F.lit(1))
    b = second.groupBy(*at).agg(F.lit(1).alias("_b"), (F.max(value) if value else F.lit(1)).alias("_v"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    out = a.join(b, at, "full_outer").groupBy(*keys).agg(F.count_if(both).alias("shared"), F.count(F.lit(1)).alias("joint"),
                                                        F.count_if(both & F.col("_v").isNotNull()).alias("valid"))
    out = (out.withColumn("iou", F.col("shared") / F.greatest(F.lit(1), F.col("joint")))
           .withColumn("valid_fraction", F.col("valid") / F.greatest(F.lit(1), F.col("shared"))))
    why = F.when(F.col("iou") < min_iou, "outlines do not overlap enough").when(F.col("valid_fraction") < min_valid, "too few valid temperatures")
    return out.withColumn("reason", why).withColumn("status", F.when(why.isNull(), "ok").otherwise("refused"))


def design_progress(cells: DataFrame, elements: DataFrame, keys: list[str], class_col: str, cell_area: Column | float, *, bucket: float, complete_at: float) -> DataFrame:
    """Observed share of each design element (``element_id, expected_class, ring``) over its valid cells."""
    zones = zones_over_cells(cells, elements, keys, "element_id", bucket, cell_key=["row_idx", "col_idx"])
    j = (zones.join(cells.select(*keys, "row_idx", "col_idx", class_col), keys + ["row_idx", "col_idx"]).where(F.col(class_col).isNotNull())
         .join(elements.select(*keys, "element_id", "expected_class").distinct(), keys + ["element_id"]).withColumn("_a", F.lit(cell_area)))
    seen = F.col(class_col) == F.col("expected_class")
    got = j.groupBy(*keys, "element_id").agg(F.count(F.lit(1)).alias("design_cells"), F.count_if(seen).alias("observed_cells"),
                                             F.sum("_a").alias("design_area_m2"), F.sum(F.when(seen, F.col("_a")).otherwise(0.0)).alias("observed_area_m2"))
    out = elements.select(*keys, "element_id", "expected_class").distinct().join(got, keys + ["element_id"], "left")
    pct = 100.0 * F.col("observed_cells") / F.col("design_cells")
    return (out.withColumn("coverage_percent", pct)
            .withColumn("state", F.when(pct.isNull(), "unavailable").when(pct >= complete_at, "observed").when(pct > 0, "partially_observed").otherwise("not_observed"))
            .withColumn("missing_area_m2", F.col("design_area_m2") - F.col("observed_area_m2")))


def design_overall(progress: DataFrame, keys: list[str]) -> DataFrame:
    return progress.groupBy(*keys).agg((100.0 * F.sum("observed_cells") / F.nullif(F.sum("design_cells"), F.lit(0))).alias("coverage_percent"),
                                       F.count(F.lit(1)).alias("elements"), F.sum("missing_area_m2").alias("missing_area_m2"))


def outside_zones(cells: DataFrame, rings: DataFrame, keys: list[str], feature: str, *, bucket: float) -> DataFrame:
    """Cells whose centre lies in no zone."""
    at = ["row_idx", "col_idx"]
    inside = zones_over_cells(cells, rings, keys, feature, bucket, cell_key=at).select(*keys, *at).distinct()
    return cells.join(inside, keys + at, "left_anti")


def encroachment(cells: DataFrame, rings: DataFrame, keys: list[str], class_col: str, kinds: dict[str, list[int]], cell_area: Column | float, *,
                 bucket: float, tolerance_m: float = 0.0) -> DataFrame:
    """Cells of building / road classes outside every boundary grown by the tolerance, with their area."""
    from fieldspark.functions.geo import segment_distance
    from fieldspark.operators.spatial import _bucket, segments, walk
    out = outside_zones(cells.where(F.col(class_col).isin([i for ids in kinds.values() for i in ids])), rings, keys, "boundary_id", bucket=bucket)
    if tolerance_m > 0:
        size = max(tolerance_m * 8, bucket)
        seg = segments(rings.withColumn("_ring", F.lit(True)), keys, "boundary_id", "_ring")
        seg = seg.withColumn("_c", F.explode(walk(size, tolerance_m))).withColumn("_bx", F.col("_c.bx")).withColumn("_by", F.col("_c.by")).drop("_c")
        near = (out.withColumn("_bx", _bucket(F.col("x"), size)).withColumn("_by", _bucket(F.col("y"), size))
                .join(seg, keys + ["_bx", "_by"]).where(segment_distance("x", "y", "ax", "ay", "bx", "by") <= tolerance_m)
                .select(*keys, "row_idx", "col_idx").distinct())
        out = out.join(near, keys + ["row_idx", "col_idx"], "left_anti")
    kind = None
    for name, ids in kinds.items():
        kind = F.when(F.col(class_col).isin(ids), name) if kind is None else kind.when(F.col(class_col).isin(ids), name)
    return out.withColumn("finding", kind).withColumn("cell_area_m2", F.lit(cell_area))
