"""Fleet records, usage, uploads, jobs, mission estimates and readiness checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values that decide the results.
HEALTH_WARNING_PCT = 80.0
JPEG_BYTES_PER_PIXEL, RAW_BYTES_PER_PIXEL = 0.40, 1.50
MIN_SAFE_RESERVE_PCT = 15.0
GSD_TOLERANCE = 0.05


def aircraft_status(aircraft: DataFrame) -> DataFrame:
    """``hours_total, hours_at_service, service_interval_h, status`` to hours since service and due flag."""
    since = F.greatest(F.lit(0.0), F.col("hours_total") - F.col("hours_at_service"))
    interval = F.greatest(F.lit(1.0), F.col("service_interval_h"))
    return (aircraft.withColumn("hours_since_service", since).withColumn("service_due", since >= interval)
            .withColumn("hours_until_service", interval - since).withColumn("grounded", F.col("status") == "grounded"))


def battery_status(batteries: DataFrame) -> DataFrame:
    past = (F.col("cycle_limit") > 0) & (F.col("cycle_count") >= F.col("cycle_limit"))
    warn = F.array_compact(F.array(F.when(past, "past_cycle_limit"), F.when(F.col("health_pct") < HEALTH_WARNING_PCT, "low_health"),
                                   F.when(F.col("retired"), "retired")))
    return batteries.withColumn("past_limit", past).withColumn("warnings", warn)


def default_today() -> Column:
    """Calendar date that is already current somewhere on Earth (UTC+14)."""
    return F.to_date(F.current_timestamp() + F.expr("INTERVAL 14 HOURS"))


def pilot_status(pilots: DataFrame, today: Column) -> DataFrame:
    """Licence and medical dates to current / expiring / expired."""
    late = lambda c: F.coalesce(F.col(c) < today, F.lit(False))
    soon = lambda c: F.coalesce(F.datediff(F.col(c), today) <= 30, F.lit(False))
    expired = late("licence_expires_on") | late("medical_expires_on")
    near = soon("licence_expires_on") | soon("medical_expires_on")
    return pilots.withColumn("current", ~expired).withColumn("expiring_soon", ~expired & near)


def fleet_status(aircraft: DataFrame, batteries: DataFrame, pilots: DataFrame, today: Column, org: str = "organization_id") -> DataFrame:
    """One row per organisation: totals and what needs attention."""
    a = aircraft_status(aircraft).groupBy(org).agg(F.count(F.lit(1)).alias("aircraft"), F.count_if("service_due").alias("service_due"), F.count_if("grounded").alias("grounded"))
    b = battery_status(batteries).groupBy(org).agg(F.count(F.lit(1)).alias("batteries"), F.count_if("past_limit").alias("past_limit"),
                                                   F.count_if("retired").alias("retired"))
    p = pilot_status(pilots, today).groupBy(org).agg(F.count(F.lit(1)).alias("pilots"), F.count_if(~F.col("current")).alias("not_current"),
                                                     F.count_if("expiring_soon").alias("expiring_soon"))
    return a.join(b, org, "full_outer").join(p, org, "full_outer").na.fill(0)


def attention(status: DataFrame, flag: str, name: str, org: str = "organization_id") -> DataFrame:
    """Names behind one flag, one row each (an organisation's fleet may be large)."""
    return status.where(F.col(flag)).select(org, F.col(name).alias("name"), F.lit(flag).alias("flag"))


def fleet_usage(usage: DataFrame) -> DataFrame:
    """Usage events rolled up per aircraft: hours and flights, last battery health (0..100), last service."""
    flown = F.col("flight_hours") > 0
    order = F.struct("ts", "seq")
    return usage.groupBy("aircraft_id").agg(
        F.coalesce(F.sum(F.when(flown, F.col("flight_hours"))), F.lit(0.0)).alias("flight_hours"), F.count_if(flown).alias("flights"),
        F.count("battery_health").alias("cycles"),
        F.max_by(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("battery_health"))), F.when(F.col("battery_health").isNotNull(), order)).alias("battery_health_pct"),
        F.max_by("service_hours", F.when(F.col("service_hours").isNotNull(), order)).alias("last_service_hours"),
        F.max(F.when(F.col("service_hours").isNotNull(), F.col("ts"))).alias("last_service_at"))


def pilot_usage(usage: DataFrame) -> DataFrame:
    flown = F.col("flight_hours") > 0
    return usage.groupBy("pilot_id").agg(F.coalesce(F.sum(F.when(flown, F.col("flight_hours"))), F.lit(0.0)).alias("flight_hours"), F.count_if(flown).alias("flights"))


def upload_completeness(uploads: DataFrame, chunks: DataFrame) -> DataFrame:
    """``uploads(upload_id, total_bytes, chunk_size)`` against received ``chunks(upload_id, chunk, bytes)``.

    Missing numbers are set differences of one upload's expected sequence, whose length its chunk count bounds.
    """
    got = chunks.groupBy("upload_id").agg(F.collect_set(F.col("chunk").cast("int")).alias("_got"), F.sum("bytes").alias("received_bytes"))
    want = F.ceil(F.col("total_bytes") / F.col("chunk_size")).cast("int")
    out = uploads.join(got, "upload_id", "left").withColumn("expected_chunks", want)
    missing = F.array_except(F.when(want > 0, F.sequence(F.lit(0), want - 1)).otherwise(F.array().cast("array<int>")), F.coalesce("_got", F.array().cast("array<int>")))
    return (out.withColumn("missing_chunks", F.array_sort(missing)).withColumn("received_bytes", F.coalesce("received_bytes", F.lit(0)))
            .withColumn("complete", F.size("missing_chunks") == 0).withColumn("size_mismatch", (F.size("missing_chunks") == 0) & (F.col("received_bytes") != F.col("total_bytes")))
            .drop("_got"))


def missing_sequence(expected: DataFrame, received: DataFrame) -> DataFrame:
    """Expected rows that never arrived, as rows."""
    return expected.exceptAll(received)


def job_report(jobs: DataFrame, now: Column, key: str | None = None) -> DataFrame:
    """Counts by state, longest wait of a queued job in seconds, jobs with more than one attempt."""
    wait = F.unix_micros(now) - F.unix_micros("queued_at")
    g = jobs.groupBy(key) if key else jobs.groupBy()
    return g.agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "queued").alias("queued"),
                 F.max(F.when(F.col("status") == "queued", wait / 1e6)).alias("longest_wait_s"), F.count_if(F.col("attempts") > 1).alias("retried"))


def mission_estimates(plans: DataFrame, raw: bool = False) -> DataFrame:
    """Storage and batteries of ``plans(image_count, image_w_px, image_h_px, flight_time_min, endurance_min, reserve_pct)``."""
    per = F.round(F.col("image_w_px") * F.col("image_h_px") * (RAW_BYTES_PER_PIXEL if raw else JPEG_BYTES_PER_PIXEL)).cast("long")
    usable = F.col("endurance_min") * (1.0 - F.col("reserve_pct") / 100.0)
    need = F.greatest(F.lit(1), F.ceil(F.col("flight_time_min") / usable)).cast("long")
    ok = usable > 0
    return (plans.withColumn("bytes_per_image", per).withColumn("total_bytes", per * F.col("image_count"))
            .withColumn("batteries_required", F.when(ok, need)).withColumn("swaps", F.when(ok, need - 1))
            .withColumn("fits", F.when(ok, F.col("flight_time_min") <= usable)).withColumn("thin_reserve", F.col("reserve_pct") < MIN_SAFE_RESERVE_PCT)
            .withColumn("status", F.when(ok, "ok").otherwise("refused")).withColumn("reason", F.when(~ok, "the reserve leaves no usable endurance")))


def segment_progress(planned: DataFrame, done: DataFrame, mission: str = "mission_id") -> DataFrame:
    """Progress of linked segments, named ``linked_seg<n>:...`` in the primitive of each capture point.

    A plan with unstamped capture points, or with another number of segments than its ``declared_segments`` (if the
    planned table has that column), is refused: one row without a segment that says why.
    """
    seg = F.nullif(F.regexp_extract(F.coalesce("primitive", F.lit("")), "^linked_seg([0-9]+):", 1), F.lit("")).cast("int")
    p = planned.withColumn("segment", seg)
    declared = F.max("declared_segments") if "declared_segments" in planned.columns else F.lit(None).cast("long")
    plans = p.groupBy(mission).agg(F.count_if(F.col("segment").isNull()).alias("_bare"), F.count_distinct("segment").alias("_named"), declared.alias("_declared"))
    why = F.when(F.col("_bare") > 0, "capture points without a segment").when(F.col("_named") != F.col("_declared"), "number of segments differs from the plan")
    plans = plans.select(mission, why.alias("reason"))
    refused = plans.where("reason IS NOT NULL").select(mission, F.lit("refused").alias("state"), "reason")
    p = p.join(plans.where("reason IS NULL").select(mission), mission, "left_semi")
    flown = done.select(mission, "idx", F.lit(1).alias("_done")).distinct()
    g = p.join(flown, [mission, "idx"], "left").groupBy(mission, "segment").agg(F.count(F.lit(1)).alias("planned"), F.count("_done").alias("completed"))
    good = (g.withColumn("percent", 100.0 * F.col("completed") / F.col("planned"))
            .withColumn("state", F.when(F.col("completed") == F.col("planned"), "complete").when(F.col("completed") == 0, "not_started").otherwise("partial"))
            .withColumn("reason", F.lit(None).cast("string")))
    return good.unionByName(refused, allowMissingColumns=True)


def next_segment(progress: DataFrame, mission: str = "mission_id") -> DataFrame:
    """First part-flown segment, else the first untouched one; null when all are complete."""
    part = F.when(F.col("state") == "partial", F.col("segment"))
    todo = F.when(F.col("state") == "not_started", F.col("segment"))
    return progress.groupBy(mission).agg(F.coalesce(F.min(part), F.min(todo)).alias("next_segment"),
                                         F.when(F.min(part).isNotNull(), "finish").when(F.min(todo).isNotNull(), "start").otherwise("none").alias("action"))


def repeat_comparability(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Two survey specifications side by side: ``camera, altitude_m, front_overlap, side_overlap, gsd_cm``."""
    j = first.alias("a").join(second.alias("b"), keys)
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    diffs = F.array_compact(F.array(
        F.when(a("camera") != b("camera"), "camera"), F.when(F.abs(a("altitude_m") - b("altitude_m")) > 1.0, "altitude"),
        F.when(F.abs(a("front_overlap") - b("front_overlap")) > 1.0, "front overlap"), F.when(F.abs(a("side_overlap") - b("side_overlap")) > 1.0, "side overlap")))
    rel = F.when((a("gsd_cm") > 0) & (b("gsd_cm") > 0), F.abs(b("gsd_cm") - a("gsd_cm")) / a("gsd_cm"))
    return j.select(*keys, diffs.alias("differences"), (rel * 100).alias("gsd_difference_pct"), F.coalesce(rel <= GSD_TOLERANCE, F.lit(True)).alias("comparable"))


def preflight_checks(ready: DataFrame, *, critical_pct: float = 15.0, reserve_pct: float = 30.0) -> DataFrame:
    """Readiness rows to one pass / warn / block column per check and ``can_start``.

    Columns: ``gps_fix, satellites, home_set, battery_pct, rth_ok, issues array, geofence_inside boolean,
    no_fly_conflicts int, compass_state, imu_state, confirmed array``. An unknown sensor state is never a pass.
    """
    c = F.col
    gps = (F.when(c("gps_fix") >= 5, "pass").when((c("gps_fix") >= 3) & (c("satellites") >= 8), "pass").when(c("gps_fix") >= 3, "warn").otherwise("block"))
    sensor = lambda s: F.when(c(s) == "healthy", "pass").when(c(s) == "unhealthy", "block").otherwise("warn")
    checks = {
        "gps_status": gps, "home_position": F.when(c("home_set"), "pass").otherwise("block"),
        "battery": F.when(c("battery_pct") < critical_pct, "block").when(c("battery_pct") < reserve_pct, "warn").otherwise("pass"),
        "rth_altitude": F.when(c("rth_ok"), "pass").otherwise("block"),
        "mission_valid": F.when(c("issues").isNull(), "block").when(F.exists("issues", lambda i: F.lower(i).startswith("error")), "block")
        .when(F.size("issues") > 0, "warn").otherwise("pass"),
        "geofence": F.when(c("geofence_inside").isNull(), "warn").when(c("geofence_inside"), "pass").otherwise("block"),
        "no_fly_zones": F.when(F.coalesce(c("no_fly_conflicts"), F.lit(0)) > 0, "block").otherwise("pass"),
        "compass": sensor("compass_state"), "imu": sensor("imu_state")}
    out = ready
    for name, level in checks.items():
        out = out.withColumn(name, level)
    blocked = F.array_compact(F.array(*[F.when((c(n) == "block") & ~F.array_contains(F.coalesce("confirmed", F.array().cast("array<string>")), n), F.lit(n)) for n in checks]))
    return out.withColumn("blocking", blocked).withColumn("can_start", F.size("blocking") == 0)


def request_metrics(requests: DataFrame, buckets: list[float], keys: list[str]) -> DataFrame:
    """Count, duration sum and cumulative buckets per key."""
    aggs = [F.count(F.lit(1)).alias("requests"), F.sum("duration").alias("duration_sum")]
    aggs += [F.count_if(F.col("duration") <= b).alias("le_" + str(b).replace(".", "_")) for b in buckets]
    return requests.groupBy(*keys).agg(*aggs)
