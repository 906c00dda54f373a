"""Model scoring over label cells and scored samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

IGNORE = 255
MAX_FOREGROUND = 0.25


def confusion(cells: DataFrame, keys: list[str], truth: str, guess: str, classes: int, ignore: int = IGNORE) -> DataFrame:
    """Counts of (truth, guess) over labelled cells; guesses are clipped into the class range."""
    t = F.col(truth)
    use = cells.where(t.isNotNull() & (t != ignore) & (t < classes))
    return (use.groupBy(*keys, t.alias("truth"), F.greatest(F.lit(0), F.least(F.lit(classes - 1), F.col(guess))).alias("guess"))
            .agg(F.count(F.lit(1)).alias("cells")))


def class_scores(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """IoU, precision and recall of each class from confusion counts."""
    hit = F.when(F.col("truth") == F.col("guess"), F.col("cells")).otherwise(0)
    by_truth = matrix.groupBy(*keys, F.col("truth").alias("class_id")).agg(F.sum(hit).alias("tp"), F.sum("cells").alias("labelled"))
    by_guess = matrix.groupBy(*keys, F.col("guess").alias("class_id")).agg(F.sum("cells").alias("predicted"))
    j = by_truth.join(by_guess, keys + ["class_id"], "full_outer").na.fill(0, ["tp", "labelled", "predicted"])
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, lab, pred = F.col("tp"), F.col("labelled"), F.col("predicted")
    return (j.withColumn("iou", div(tp, lab + pred - tp)).withColumn("precision", div(tp, pred)).withColumn("recall", div(tp, lab)).withColumn("present", lab > 0))


def overall_scores(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Mean IoU over classes that occur, pixel accuracy and scored cells."""
    if not keys:
        return overall_scores(matrix.withColumn("_all", F.lit(1)), ["_all"]).drop("_all")
    hit = F.when(F.col("truth") == F.col("guess"), F.col("cells")).otherwise(0)
    m = class_scores(matrix, keys).groupBy(*keys).agg(F.avg(F.when(F.col("present"), F.col("iou"))).alias("mean_iou"), F.count_if("present").alias("classes_present"))
    return m.join(matrix.groupBy(*keys).agg((F.sum(hit) / F.sum("cells")).alias("accuracy"), F.sum("cells").alias("scored")), keys)


def binary_iou(cells: DataFrame, keys: list[str], truth: str, guess: str, positive: int = 1) -> DataFrame:
    """Scores of one class with every unlabelled cell counted as negative."""
    t, g = F.coalesce(F.col(truth) == positive, F.lit(False)), F.coalesce(F.col(guess) == positive, F.lit(False))
    n = cells.groupBy(*keys).agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count(F.lit(1)).alias("cells"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (n.withColumn("iou", div(tp, tp + fp + fn)).withColumn("precision", div(tp, tp + fp)).withColumn("recall", div(tp, tp + fn))
            .withColumn("predicted_fraction", (tp + fp) / F.col("cells")).withColumn("labelled_fraction", (tp + fn) / F.col("cells")))


def threshold_sweep(scored: DataFrame, keys: list[str], score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """Pooled scores at each threshold (strictly above counts as positive), in one pass over the data.

    Rows fall into the histogram between thresholds; the few bins are then summed from the top.
    """
    levels = sorted(thresholds)
    slot = sum((F.when(F.col(score) > t, 1).otherwise(0) for t in levels[1:]), F.when(F.col(score) > levels[0], 1).otherwise(0))
    known = scored.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
    hist = known.groupBy(*keys, slot.alias("_slot")).agg(F.count_if(F.col(truth) == 1).alias("_p"), F.count_if(F.col(truth) != 1).alias("_n"))
    per = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(i + 1).alias("at")) for i, t in enumerate(levels)])
    each = hist.withColumn("_t", F.explode(per))
    above = F.col("_slot") >= F.col("_t.at")
    g = each.groupBy(*keys, F.col("_t.threshold").alias("threshold")).agg(
        F.sum(F.when(above, F.col("_p")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("_n")).otherwise(0)).alias("fp"), F.sum(F.when(~above, F.col("_p")).otherwise(0)).alias("fn"))
    one = F.lit(1)
    out = (g.withColumn("iou", F.col("tp") / F.greatest(one, F.col("tp") + F.col("fp") + F.col("fn"))).withColumn("precision", F.col("tp") / F.greatest(one, F.col("tp") + F.col("fp")))
           .withColumn("recall", F.col("tp") / F.greatest(one, F.col("tp") + F.col("fn"))))
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-9), F.col("precision") + F.col("recall")))


def best_threshold(sweep: DataFrame, keys: list[str]) -> DataFrame:
    """Threshold of the best IoU; the lowest wins a tie."""
    best = F.max_by(F.struct("threshold", "iou"), F.struct(F.col("iou"), -F.col("threshold")))
    return (sweep.groupBy(*keys) if keys else sweep.groupBy()).agg(best.alias("_b")).select(*keys, F.col("_b.threshold").alias("best_threshold"), F.col("_b.iou").alias("best_iou"))


def foreground_gate(cells: DataFrame, keys: list[str], truth: str, limit: float = MAX_FOREGROUND) -> DataFrame:
    """Masks whose foreground share says the pairing or the polarity is wrong."""
    f = cells.groupBy(*keys).agg(F.avg((F.coalesce(F.col(truth), F.lit(0)) == 1).cast("double")).alias("foreground"))
    bad = F.col("foreground") > limit
    return f.withColumn("status", F.when(bad, "refused").otherwise("ok")).withColumn("reason", F.when(bad, "the mask covers too much of the frame"))


def hann_weight(pos: str, size: int):
    """One axis of the blending window."""
    import math
    return 0.5 - 0.5 * F.cos(2 * math.pi * F.col(pos) / (size - 1))


def tile_starts(length: int, tile: int, overlap: int) -> list[int]:
    """Offsets of overlapping tiles that end flush with the raster."""
    if length <= tile:
        return [0]
    starts = list(range(0, length - tile + 1, tile - overlap))
    return starts if starts[-1] == length - tile else starts + [length - tile]


def blend_tiles(logits: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Weighted mean logits of overlapping tiles per cell, softmax, best class (smallest id on a tie).

    ``logits(keys, top, left, row_idx, col_idx, class_id, logit)``, raster positions in ``row_idx, col_idx``.
    """
    placed = logits.withColumn("_y", F.col("row_idx") - F.col("top")).withColumn("_x", F.col("col_idx") - F.col("left"))
    w = F.greatest(F.lit(1e-3), hann_weight("_y", tile) * hann_weight("_x", tile))
    at = keys + ["row_idx", "col_idx"]
    mean = (placed.withColumn("_w", w).groupBy(*at, "class_id").agg((F.sum(F.col("logit") * F.col("_w")) / F.sum("_w")).alias("_l")))
    # a cell has one row per class: the softmax denominator needs the cell's classes only
    cell = W.partitionBy(*at)
    e = mean.withColumn("_e", F.exp(F.col("_l") - F.max("_l").over(cell))).withColumn("_p", F.col("_e") / F.sum("_e").over(cell))
    return e.groupBy(*at).agg(F.max_by("class_id", F.struct(F.col("_p"), -F.col("class_id"))).alias("class_id"), F.max("_p").alias("confidence"))


def class_stats(blended: DataFrame, keys: list[str], cell_area: float) -> DataFrame:
    return blended.groupBy(*keys, "class_id").agg(F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * cell_area).alias("area_m2"), F.avg("confidence").alias("mean_confidence"))
