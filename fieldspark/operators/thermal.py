"""Temperature frames: statistics, display ranges, hot spots, deviations from a validated baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldspark.operators.components import label_regions
from fieldspark.operators.ordered import join_side, quantiles
from fieldspark.session import cut

# Fixed values that decide the results.
HOTSPOT_C, HOTSPOT_PERCENTILE, HOTSPOT_MIN_CELLS = 65.0, 0.992, 60
MAD_SCALE, MIN_BASELINE_PIXELS, MIN_SCALE = 1.4826, 32, 1e-12
ANOMALY_SIGMA, ANOMALY_MIN_AREA_M2 = 3.5, 1.0


def thermal_stats(cells: DataFrame, keys: list[str], value: str, sigma: float = 3.0) -> DataFrame:
    """Range, mean, median and population deviation of each frame, with cells beyond ``sigma`` deviations.

    An isothermal frame has no outliers.
    """
    known = cells.where(F.col(value).isNotNull())
    base = known.groupBy(*keys).agg(F.min(value).alias("min_c"), F.max(value).alias("max_c"), F.avg(value).alias("mean_c"), F.stddev_pop(value).alias("std_c"),
                                    F.count(value).alias("cells"))
    j = join_side(known.select(*keys, F.col(value).alias("_v")), base.select(*keys, "mean_c", "std_c"), keys)
    out = j.groupBy(*keys).agg(F.count_if((F.col("std_c") > 0) & (F.col("_v") > F.col("mean_c") + sigma * F.col("std_c"))).alias("hot_cells"),
                               F.count_if((F.col("std_c") > 0) & (F.col("_v") < F.col("mean_c") - sigma * F.col("std_c"))).alias("cold_cells"))
    return base.join(quantiles(known, keys, value, {"median_c": 0.5}), keys, "left").join(out, keys, "left")


def region_stats(cells: DataFrame, keys: list[str], value: str, row0: int, col0: int, row1: int, col1: int, sigma: float = 3.0) -> DataFrame:
    """The same over one rectangle (end row and column excluded)."""
    box = (F.col("row_idx") >= row0) & (F.col("row_idx") < row1) & (F.col("col_idx") >= col0) & (F.col("col_idx") < col1)
    return thermal_stats(cells.where(box), keys, value, sigma)


def display_range(cells: DataFrame, keys: list[str], value: str, method: str, *, low: float | None = None, high: float | None = None, sigma: float = 2.0) -> DataFrame:
    """Colour range of each frame and what it leaves out: manual, percentile (low/high in percent) or sigma.

    A frame of one temperature gets a range around it. ``low`` and ``high`` are the limits before that, with what lies ``below`` and ``above``.
    """
    known = cells.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    base = known.groupBy(*keys).agg(F.min("_v").alias("data_min"), F.max("_v").alias("data_max"), F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_s"), F.count("_v").alias("cells"))
    if method == "manual":
        if low is None or high is None or high <= low:
            raise ValueError("a manual range needs two numbers, the second above the first")
        scale = base.withColumn("low", F.lit(float(low))).withColumn("high", F.lit(float(high))).withColumn("_pad", F.lit(0.0))
    elif method == "percentile":
        lo, hi = (1.0 if low is None else low), (99.0 if high is None else high)
        if not 0 <= lo < hi <= 100:
            raise ValueError("percentiles must satisfy 0 <= low < high <= 100")
        scale = base.join(quantiles(known, keys, "_v", {"low": lo / 100, "high": hi / 100}), keys)
        scale = scale.withColumn("_pad", F.when(F.col("high") <= F.col("low"), F.greatest(F.lit(0.5), F.abs("low") * 0.01)).otherwise(0.0))
    elif method == "sigma":
        if sigma <= 0:
            raise ValueError("sigma must be positive")
        scale = (base.withColumn("low", F.col("_m") - sigma * F.col("_s")).withColumn("high", F.col("_m") + sigma * F.col("_s"))
                 .withColumn("_pad", F.when(F.col("_s") > 0, 0.0).otherwise(sigma * F.greatest(F.lit(0.5), F.abs("_m") * 0.01))))
    else:
        raise ValueError("method must be manual, percentile or sigma")
    scale = scale.withColumn("range_min", F.col("low") - F.col("_pad")).withColumn("range_max", F.col("high") + F.col("_pad"))
    cut = join_side(known, scale.select(*keys, "range_min", "range_max", "low", "high"), keys).groupBy(*keys).agg(
        F.count_if(F.col("_v") < F.col("range_min")).alias("clipped_low"), F.count_if(F.col("_v") > F.col("range_max")).alias("clipped_high"),
        F.count_if(F.col("_v") < F.col("low")).alias("below"), F.count_if(F.col("_v") > F.col("high")).alias("above"))
    return (scale.select(*keys, "range_min", "range_max", "low", "high", "data_min", "data_max", "cells").join(cut, keys)
            .withColumn("hides_hottest", F.col("clipped_high") > 0))


def legend(scales: DataFrame, steps: int = 5) -> DataFrame:
    """Tick rows of a colour bar."""
    if steps < 2:
        raise ValueError("a legend needs two ticks")
    f = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i / F.lit(float(steps - 1))))
    return scales.withColumn("fraction", f).withColumn("celsius", F.col("range_min") + (F.col("range_max") - F.col("range_min")) * F.col("fraction"))


def hotspot_frames(cells: DataFrame, keys: list[str], value: str, *, threshold: float = HOTSPOT_C, min_cells: int = HOTSPOT_MIN_CELLS) -> DataFrame:
    """Hot spots of each frame: eight-connected cells at or over max(threshold, 99.2 percentile), small ones left out."""
    base = cells.groupBy(*keys).agg(F.max(value).alias("max_c"), F.avg(value).alias("mean_c"))
    limit = quantiles(cells, keys, value, {"_q": HOTSPOT_PERCENTILE}).select(*keys, F.greatest(F.lit(float(threshold)), F.col("_q")).alias("threshold_c"))
    hot = join_side(cells.where(F.col(value) >= threshold).select(*keys, "row_idx", "col_idx", F.col(value).alias("_v")), limit, keys).where(F.col("_v") >= F.col("threshold_c"))
    spots = label_regions(cut(hot), keys, 8).groupBy(*keys, "region").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_cells)
    per = spots.groupBy(*keys).agg(F.count(F.lit(1)).alias("hotspots"), F.sum("_n").alias("hotspot_cells"))
    return base.join(limit, keys).join(per, keys, "left").na.fill(0, ["hotspots", "hotspot_cells"])


def robust_baseline(pixels: DataFrame, keys: list[str], band: str, value: str, source: str, *, validated_by: str, scope: str) -> DataFrame:
    """Median and scaled median absolute deviation of each band over at least two normal sources."""
    if not validated_by.strip() or not scope.strip():
        raise ValueError("a baseline must state who validated it and for what")
    on = keys + [band]
    known = pixels.where(F.col(value).isNotNull())
    n = known.groupBy(*on, source).agg(F.count(F.lit(1)).alias("_n")).groupBy(*on).agg(F.count(F.lit(1)).alias("sources"), F.sum("_n").alias("valid_pixels"))
    center = quantiles(known, on, value, {"center": 0.5})
    dev = join_side(known.select(*on, F.col(value).alias("_v")), center, on).select(*on, F.abs(F.col("_v") - F.col("center")).alias("_d"))
    scale = quantiles(dev, on, "_d", {"_mad": 0.5}).select(*on, (F.col("_mad") * MAD_SCALE).alias("scale"))
    out = n.join(center, on).join(scale, on)
    why = (F.when(F.col("sources") < 2, "a baseline needs two sources").when(F.col("valid_pixels") < MIN_BASELINE_PIXELS, "too few valid pixels")
           .when(F.col("scale") <= MIN_SCALE, "no measurable variation"))
    out = out.withColumn("reason", why).withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("refused"))
    return out.withColumn("baseline_id", F.sha2(F.concat_ws("|", F.lit(validated_by.strip()), F.lit(scope.strip()), *[F.col(k).cast("string") for k in on],
                                                            F.col("center").cast("string"), F.col("scale").cast("string")), 256))


def anomaly_scores(pixels: DataFrame, baseline: DataFrame, cell: list[str], keys: list[str], band: str, value: str) -> DataFrame:
    """Largest deviation of each cell over its bands, in robust sigmas: ``score``. A cell missing a valid baseline band scores null.

    ``ratio`` is the largest quotient of deviation and scale over all ``bands`` the cell has a value in, also where the baseline is
    refused: without variation it is infinite, or not a number for a cell that does not deviate.
    """
    base = baseline.select(*keys, band, "center", "scale", F.col("status").eqNullSafe("ok").alias("_ok"))
    bands = base.groupBy(*keys).agg(F.count_if("_ok").alias("_bands"))
    gap = F.abs(F.col(value) - F.col("center"))
    ratio = F.when(F.col("scale") != 0, gap / F.nullif("scale", F.lit(0.0))).when(gap > 0, float("inf")).otherwise(float("nan"))
    s = (pixels.where(F.col(value).isNotNull()).join(base, keys + [band]).withColumn("_z", ratio)
         .groupBy(*keys, *cell).agg(F.max(F.when(F.col("_ok"), F.col("_z"))).alias("_s"), F.count_if("_ok").alias("_n"), F.max("_z").alias("ratio"), F.count(F.lit(1)).alias("bands")))
    return s.join(bands, keys).withColumn("score", F.when(F.col("_n") == F.col("_bands"), F.col("_s"))).drop("_s", "_n", "_bands")


def anomaly_candidates(scores: DataFrame, keys: list[str], cell_area: Column | float, *, threshold: float = ANOMALY_SIGMA, min_area_m2: float = ANOMALY_MIN_AREA_M2) -> DataFrame:
    """Eight-connected regions of cells at or over the threshold, with their largest and mean score."""
    # scoring is costly: settle the few candidate cells before they are labelled
    lab = label_regions(cut(scores.where(F.col("score") >= threshold)), keys, 8).withColumn("_a", F.lit(cell_area))
    return (lab.groupBy(*keys, "region").agg(F.count(F.lit(1)).alias("cell_count"), F.sum("_a").alias("area_m2"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"))
            .where(F.col("area_m2") >= min_area_m2))
