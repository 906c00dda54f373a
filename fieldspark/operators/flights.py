"""Telemetry tracks, sensor checks and run history: ordered computations per flight, bundle or asset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldspark.functions.bands import has_fix
from fieldspark.functions.geo import EARTH_RADIUS_TRACK_M, haversine_m
from fieldspark.operators.ordered import block, join_side, time_chunk, with_previous, with_row_number

DAYS_PER_MONTH = 30.4375
DAYS_HALF_YEAR, DAYS_YEAR = 182.625, 365.25
MIN_TREND_DAYS = 7.0
MIN_OVERLAP = 0.14


def legs(telemetry: DataFrame, *, seconds: int = 3600, key: str = "flight_id") -> DataFrame:
    """Positioned samples with the distance from the previous positioned sample."""
    placed = telemetry.where(has_fix()).select(key, "ts", "seq", "latitude", "longitude")
    prev = with_previous(placed, [key], ["ts", "seq"], ["latitude", "longitude"], [time_chunk("ts", seconds)])
    return prev.withColumn("leg_m", haversine_m(F.col("prev_latitude"), F.col("prev_longitude"), F.col("latitude"), F.col("longitude"), EARTH_RADIUS_TRACK_M))


def track_distance(telemetry: DataFrame, *, seconds: int = 3600, key: str = "flight_id") -> DataFrame:
    """Distance over positioned samples, duration over all samples (0 for one sample)."""
    dist = legs(telemetry, seconds=seconds, key=key).groupBy(key).agg(F.coalesce(F.sum("leg_m"), F.lit(0.0)).alias("distance_m"))
    span = telemetry.groupBy(key).agg(((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("duration_s"), F.count(F.lit(1)).alias("samples"))
    return span.join(dist, key, "left").na.fill(0.0, ["distance_m"])


def flight_summary(telemetry: DataFrame, *, seconds: int = 3600, key: str = "flight_id") -> DataFrame:
    order = F.struct("ts", "seq")
    lit = F.col("battery_pct") > 0
    more = telemetry.groupBy(key).agg(
        F.count_if(has_fix()).alias("positioned"), F.max(F.when(has_fix(), F.col("altitude_rel_m"))).alias("max_altitude_m"),
        F.min_by("battery_pct", F.when(lit, order)).alias("battery_first"), F.max_by("battery_pct", F.when(lit, order)).alias("battery_last"))
    return track_distance(telemetry, seconds=seconds, key=key).join(more, key)


def elapsed(telemetry: DataFrame, key: str = "flight_id") -> DataFrame:
    """Seconds since the first sample of the flight. The start comes back by a salted join on the flight."""
    from fieldspark.session import join_salted
    start = telemetry.groupBy(key).agg(F.min("ts").alias("_start"))
    return (join_salted(telemetry, start, [key], ["seq"], how="inner")
            .withColumn("elapsed_s", (F.unix_micros("ts") - F.unix_micros("_start")) / 1e6).drop("_start"))


def monotonic_check(rows: DataFrame, keys: list[str], t: str, seq: str, width: float = 1e6) -> DataFrame:
    """Whether time never decreases in file order."""
    prev = with_previous(rows.select(*keys, t, seq), keys, [seq], [t], [block(seq, width)])
    return prev.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col(f"prev_{t}") <= F.col(t), F.lit(True))).alias("monotonic"))


def health_trend(runs: DataFrame, key: str = "asset_id") -> DataFrame:
    """Change since the previous run and fitted trend of the latest run of each asset.

    Needs only aggregates: the last two runs are the two largest time/sequence pairs.
    """
    day = F.unix_micros("run_utc") / 86400e6
    order = F.struct("run_utc", "run_seq")
    row = F.struct(F.col("run_utc").alias("ts"), F.col("run_seq").alias("seq"), F.col("integrity_score").alias("integrity"), F.col("severity_index").alias("severity"))
    last = runs.groupBy(key).agg(F.max(row).alias("_last"), F.count(F.lit(1)).alias("history_points"), (F.max(day) - F.min(day)).alias("_span"),
                                 F.regr_slope(F.col("integrity_score"), day).alias("_slope"))
    # second largest: the maximum once the largest is set aside
    prev = (join_side(runs, last.select(key, F.col("_last.ts").alias("_lt"), F.col("_last.seq").alias("_ls")), [key])
            .where(~((F.col("run_utc") == F.col("_lt")) & (F.col("run_seq") == F.col("_ls")))).groupBy(key).agg(F.max(row).alias("_prev")))
    j = last.join(prev, key, "left")
    slope = F.when(F.col("_span") >= MIN_TREND_DAYS, F.coalesce("_slope", F.lit(0.0))).otherwise(0.0)
    now = F.col("_last.integrity")
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    month = F.col("slope_per_day") * DAYS_PER_MONTH
    return (j.withColumn("slope_per_day", slope).select(
        key, "history_points", now.alias("integrity_score"), F.col("_prev.integrity").alias("previous_integrity"), F.col("_prev.severity").alias("previous_severity"),
        F.coalesce(now - F.col("_prev.integrity"), F.lit(0.0)).alias("delta_integrity"),
        F.coalesce(F.col("_last.severity") - F.col("_prev.severity"), F.lit(0.0)).alias("delta_severity"),
        F.coalesce((F.unix_micros("_last.ts") - F.unix_micros("_prev.ts")) / 86400e6, F.lit(0.0)).alias("days_since_previous"),
        "slope_per_day", month.alias("change_per_month"), clip(now + F.col("slope_per_day") * DAYS_HALF_YEAR).alias("projected_6m"),
        clip(now + F.col("slope_per_day") * DAYS_YEAR).alias("projected_12m"),
        F.when(month <= -1.0, "degrading").when(month >= 1.0, "improving").otherwise("stable").alias("direction")))


def recent_runs(runs: DataFrame, *, keep: int, folders: int, key: str = "asset_id", name: str = "run_name") -> DataFrame:
    """Last ``keep`` runs of each asset by time, among the last ``folders`` runs of all by name.

    The folder limit is a global top-k: a sort with a limit keeps k rows per task.
    """
    known = runs.orderBy(F.desc(name)).limit(folders)
    order = W.partitionBy(key).orderBy(F.desc("run_utc"), F.desc("run_seq"))
    return known.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")


def growth_series(series: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """First against last forecast step: change and change over 0.12, clipped to one."""
    g = series.groupBy(key).agg(F.min_by(value, step).alias("initial"), F.max_by(value, step).alias("final"), F.count(F.lit(1)).alias("_n"))
    d = F.when(F.col("_n") >= 2, F.greatest(F.lit(0.0), F.col("final") - F.col("initial"))).otherwise(0.0)
    return g.withColumn("delta", d).withColumn("growth_norm", F.least(F.lit(1.0), d / 0.12)).drop("_n")


def neighbour_overlap(frames: DataFrame, *, key: str = "dataset_id", order: list[str], score: str, chunk: list[Column], flag_ends: bool = True,
                      minimum: float = MIN_OVERLAP) -> DataFrame:
    """Overlap with the previous and the next frame, low when either is under the minimum.

    ``score`` is the overlap of a frame with the one before it. The first frame has no previous and
    the last no next overlap; both count as 0 unless ``flag_ends`` is off.
    """
    back = with_previous(frames, [key], order, [score], chunk, prefix="_p_")
    # the next frame's score, by running the same pass over the reversed order
    flipped = frames.select(key, *order, F.col(score).alias("_s"))
    neg = [(-F.col(c).cast("double") if c not in ("captured_at", "ts") else -F.unix_micros(c)).alias(f"_o{i}") for i, c in enumerate(order)]
    rev = flipped.select(key, *order, "_s", *neg)
    rchunk = [-c for c in chunk]
    nxt = with_previous(rev, [key], [f"_o{i}" for i in range(len(order))], ["_s"], rchunk, prefix="_n")
    out = back.join(nxt.select(key, *order, F.col("_n_s").alias("next_overlap")), [key] + order)
    out = out.withColumn("prev_overlap", F.when(F.col(f"_p_{score}").isNotNull(), F.col(score))).drop(f"_p_{score}")
    worst = F.least(F.coalesce("prev_overlap", F.lit(0.0)), F.coalesce("next_overlap", F.lit(0.0))) if flag_ends else F.least("prev_overlap", "next_overlap")
    return out.withColumn("low_overlap", F.coalesce(worst < minimum, F.lit(False)))


def version_history(versions: DataFrame, fields: list[str], *, key: str = "mission_id", seq: str = "version_seq", geometry: list[str] = (),
                    width: float = 1e6, eps: float = 1e-6) -> DataFrame:
    """Each version against the one before: changed fields in order, waypoint change, geometry changed as a whole."""
    cols = fields + ["waypoints"] + list(geometry)
    v = with_previous(versions, [key], [seq], cols, [block(seq, width)])

    def differs(c: str) -> Column:
        a, b = F.col(f"prev_{c}"), F.col(c)
        if dict(versions.dtypes)[c] in ("double", "float"):
            return ~a.eqNullSafe(b) & F.coalesce(F.abs(a - b) > eps, F.lit(True))
        return ~a.eqNullSafe(b)

    known = F.col("prev_waypoints").isNotNull()
    out = v.withColumn("changed", F.when(known, F.array_compact(F.array(*[F.when(differs(c), F.lit(c)) for c in sorted(fields)]))))
    out = out.withColumn("waypoint_delta", F.col("waypoints") - F.col("prev_waypoints"))
    for g in geometry:
        out = out.withColumn(f"{g}_changed", known & differs(g))
    return out.drop(*[f"prev_{c}" for c in cols])


def next_version(versions: DataFrame, key: str = "mission_id", num: str = "version_num") -> DataFrame:
    return versions.groupBy(key).agg((F.max(num) + 1).alias("next_version"))


def number_new_versions(saved: DataFrame, new: DataFrame, *, key: str, num: str, seq: str, width: float = 1e6) -> DataFrame:
    """Version numbers for a batch of new versions, after the highest saved one of their mission."""
    n = with_row_number(new, [key], [seq], [block(seq, width)], "_n")
    return (n.join(saved.groupBy(key).agg(F.max(num).alias("_m")), key, "left")
            .withColumn(num, F.coalesce("_m", F.lit(0)) + F.col("_n")).drop("_m", "_n"))


def battery_splits(planned: DataFrame, required: DataFrame, *, key: str = "mission_id", idx: str = "idx", width: float = 1e6) -> DataFrame:
    """Sortie number of each capture: ``ceil(n / required)`` captures per sortie, in plan order."""
    n = planned.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    per = n.join(required, key).withColumn("_per", F.ceil(F.col("_n") / F.greatest(F.lit(1), F.col("batteries_required"))))
    return (join_side(with_row_number(planned, [key], [idx], [block(idx, width)], "_rn"), per.select(key, "_per"), [key])
            .withColumn("sortie", (F.floor((F.col("_rn") - 1) / F.col("_per")) + 1).cast("long")).drop("_rn", "_per"))


def overlapping_chunks(items: DataFrame, size: int, overlap: int, *, key: str = "dataset_id", order: list[str], chunk: list[Column]) -> DataFrame:
    """Overlapping work chunks: one row per item and chunk it belongs to.

    A tail no longer than the overlap joins the chunk before it.
    """
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("chunk size must be positive and larger than the overlap")
    step = size - overlap
    n = items.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    rows = join_side(with_row_number(items, [key], order, chunk, "_rn"), n, [key])
    # chunks start every `step` items until one reaches the end
    last = F.when(F.col("_n") <= size, F.lit(0)).otherwise(F.ceil((F.col("_n") - size) / F.lit(step)).cast("long"))
    tail = F.col("_n") - last * step
    last = F.when((last > 0) & (tail <= overlap), last - 1).otherwise(last)
    pos = F.col("_rn") - 1
    lo = F.greatest(F.lit(0), F.ceil((pos - size + 1) / F.lit(float(step)))).cast("long")
    hi = F.least(last, F.floor(pos / F.lit(step))).cast("long")
    return (rows.withColumn("chunk_no", F.explode(F.sequence(F.least(lo, hi), hi))).drop("_rn", "_n"))


def even_sample(items: DataFrame, limit: int, *, key: str, order: list[str], chunk: list[Column], integer_stride: bool = False) -> DataFrame:
    """About ``limit`` rows spread evenly over each group (a sampling operator): every ``n/limit``-th row."""
    n = items.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    rows = join_side(with_row_number(items, [key], order, chunk, "_rn"), n, [key])
    pos = F.col("_rn") - 1
    if integer_stride:
        stride = F.greatest(F.lit(1), F.floor(F.col("_n") / limit))
        keep = (pos % stride == 0) & (pos / stride < limit)
    else:
        stride = F.col("_n") / F.lit(float(limit))
        # row i is the pick of slot k when i = floor(k * stride)
        slot = F.ceil(pos / stride)
        keep = (F.col("_n") <= limit) | ((F.floor(slot * stride) == pos) & (slot < limit))
    return rows.where(keep).drop("_rn", "_n")


def retain_latest(events: DataFrame, keep: int, *, key: str, order: str, width: float = 1e5) -> DataFrame:
    """Newest ``keep`` rows of each group by a rising id; the rule of a bounded buffer."""
    neg = events.withColumn("_neg", -F.col(order))
    return with_row_number(neg, [key], ["_neg"], [block("_neg", width)], "_rn").where(F.col("_rn") <= keep).drop("_rn", "_neg")
