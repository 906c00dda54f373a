"""Live telemetry and event streams.

Defaults: watermark 10 minutes, session gap 60 seconds, update mode for state, append for windows
that close. State lives per key; a micro-batch's rows of one key are bounded by the source's
trigger limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldspark.functions.bands import AIRBORNE_PHASES, has_fix, telemetry_warnings
from fieldspark.functions.geo import EARTH_RADIUS_TRACK_M
from fieldspark.functions.rules import Rule, check
from fieldspark.session import join_salted, scratch, sorted_side

WATERMARK = "10 minutes"
SESSION_GAP = "60 seconds"


def run_available(df: DataFrame, label: str, mode: str = "append") -> str:
    """Process what is there now into a parquet folder with a ``batch_id`` column, and return the folder."""
    spark = df.sparkSession
    target, log = scratch(spark, label), scratch(spark, f"{label}-log")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{target}/batch_no={batch_id}")

    q = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", log).trigger(availableNow=True).start()
    q.awaitTermination()
    return target


def read_output(spark, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.withColumn("batch_id", F.lit(0).cast("long")).schema).option("recursiveFileLookup", "true").parquet(path)


def latest(output: DataFrame, keys: list[str]) -> DataFrame:
    """Last update of each key."""
    cols = [c for c in output.columns if c not in keys and c != "batch_id"]
    return output.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def ingest(telemetry: DataFrame) -> DataFrame:
    """Range-checked samples; an absent sensor stays null and breaks no rule."""
    def outside(c: str, lo: float, hi: float) -> Rule:
        return Rule(c, (F.col(c) < lo) | (F.col(c) > hi), f"{c} out of range")
    rules = [Rule("flight", F.coalesce(F.col("flight_id").cast("string"), F.lit("")) == "", "a flight or aircraft id is required"), Rule("ts", F.col("ts").isNull(), "a time is required")]
    present = set(telemetry.columns)
    for c, lo, hi in (("latitude", -90, 90), ("longitude", -180, 180), ("battery_pct", 0, 100), ("heading_deg", 0, 360), ("satellites", 0, 1_000), ("speed_mps", 0, 1e9)):
        if c in present:
            rules.append(outside(c, lo, hi))
    return check(telemetry, rules)


def current_state(telemetry: DataFrame, key: str = "flight_id") -> DataFrame:
    """Latest sample of each aircraft with progress and warnings (update mode)."""
    cols = [c for c in telemetry.columns if c != key]
    last = telemetry.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("ts", "seq")).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])
    pct = F.when(F.col("waypoint_total") > 0, 100.0 * F.col("waypoint_index") / F.col("waypoint_total"))
    return last.withColumn("progress_pct", pct).withColumn("warnings", telemetry_warnings())


def flight_sessions(telemetry: DataFrame, key: str = "flight_id", gap: str = SESSION_GAP, watermark: str = WATERMARK) -> DataFrame:
    """Sessions split where a flight is silent for longer than the gap."""
    s = F.session_window("ts", gap)
    g = telemetry.withWatermark("ts", watermark).groupBy(key, s.alias("session"))
    lit = F.col("battery_pct") > 0
    return g.agg(F.count(F.lit(1)).alias("samples"), F.count_if(has_fix()).alias("positioned"), F.max("altitude_rel_m").alias("max_altitude_m"),
                 F.min_by("battery_pct", F.when(lit, F.col("ts"))).alias("battery_first"), F.max_by("battery_pct", F.when(lit, F.col("ts"))).alias("battery_last"),
                 F.min("ts").alias("started_at"), F.max("ts").alias("ended_at")).drop("session")


def _arrays(batches: Iterator[pd.DataFrame], columns: list[str]) -> list[np.ndarray]:
    """Columns of one key's rows. Most keys have few rows a batch, where a sort or a selection in pandas costs more than its rows."""
    parts = list(batches)
    return [parts[0][c].to_numpy() if len(parts) == 1 else np.concatenate([p[c].to_numpy() for p in parts]) for c in columns]


def running_distance(telemetry: DataFrame, key: str = "flight_id") -> DataFrame:
    """Distance so far of each flight over its positioned samples. Rows older than the state are counted as late."""
    placed = telemetry.where(has_fix()).select(F.col(key).cast("string").alias("key"), F.unix_micros("ts").alias("us"), "seq", "latitude", "longitude")
    radius = EARTH_RADIUS_TRACK_M

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, seqs, lats, lons = _arrays(batches, ["us", "seq", "latitude", "longitude"])
        us, lat, lon, total, n, late = state.get if state.exists else (-(2**62), np.nan, np.nan, 0.0, 0, 0)
        order = np.lexsort((seqs, times))
        fresh = order[~(times[order] < us)]
        late += len(order) - len(fresh)
        if len(fresh):
            la, lo = np.radians(np.append(lat, lats[fresh])), np.radians(np.append(lon, lons[fresh]))
            s = np.sin(np.diff(la) / 2) ** 2 + np.cos(la[:-1]) * np.cos(la[1:]) * np.sin(np.diff(lo) / 2) ** 2
            total += float(np.nansum(2 * radius * np.arcsin(np.minimum(1.0, np.sqrt(s)))))
            us, lat, lon, n = int(times[fresh[-1]]), float(lats[fresh[-1]]), float(lons[fresh[-1]]), n + len(fresh)
        state.update((us, lat, lon, total, n, late))
        yield pd.DataFrame({"key": [k[0]], "distance_m": [total], "positioned": [n], "late": [late]})

    return placed.groupBy("key").applyInPandasWithState(step, "key string, distance_m double, positioned long, late long",
                                                        "us long, lat double, lon double, total double, n long, late long", "update", GroupStateTimeout.NoTimeout)


def contact_lost(states: DataFrame, silence_ms: int = 60_000, watermark: str = WATERMARK) -> DataFrame:
    """Alerts for aircraft that fall silent while possibly airborne.

    ``states(aircraft_id string, ts, phase, clean_shutdown, latitude, longitude, battery_pct, waypoint_index)``.
    """
    airborne = list(AIRBORNE_PHASES)

    def watch(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            ms, phase, clean, lat, lon, bat, wp = state.get
            state.remove()
            if phase in airborne and not clean:
                yield pd.DataFrame({"aircraft_id": [k[0]], "last_seen": [pd.Timestamp(ms, unit="ms")], "phase": [phase], "latitude": [lat], "longitude": [lon], "battery_pct": [bat], "waypoint_index": [wp]})
            return
        times, *rest = _arrays(batches, ["ts", "phase", "clean_shutdown", "latitude", "longitude", "battery_pct", "waypoint_index"])
        us = times.astype("datetime64[us]").astype("int64")
        last = len(us) - 1 - int(us[::-1].argmax())  # the last to come of those with the newest time
        ms = int(us[last] // 1000)
        if state.exists and state.get[0] > ms:
            return
        phase, clean, lat, lon, bat, wp = (c[last] for c in rest)
        state.update((ms, str(phase), bool(clean), float(lat), float(lon), float(bat), int(wp)))
        state.setTimeoutTimestamp(max(ms + silence_ms, state.getCurrentWatermarkMs() + 1))

    return (states.withWatermark("ts", watermark).groupBy("aircraft_id")
            .applyInPandasWithState(watch, "aircraft_id string, last_seen timestamp, phase string, latitude double, longitude double, battery_pct double, waypoint_index int",
                                    "ms long, phase string, clean boolean, lat double, lon double, bat double, wp int", "append", GroupStateTimeout.EventTimeTimeout))


def event_buffer(events: DataFrame, path: str, log: str, keep: int, key: str = "org_id", order: str = "event_id"):
    """Append events to a buffer and keep the newest ``keep`` per organisation after each batch.

    Each batch writes a new buffer version and then names it; a re-run of a batch rewrites the same version.
    """
    from fieldspark.operators.flights import retain_latest

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = newest_version(spark, path, below=batch_id)
        both = batch if before is None else spark.read.schema(batch.schema).parquet(f"{path}/version={before}").unionByName(batch)
        kept = retain_latest(both.dropDuplicates([order]), keep, key=key, order=order)
        kept.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        spark.createDataFrame([(batch_id,)], "version long").coalesce(1).write.mode("append").parquet(f"{path}/_versions")

    return events.writeStream.foreachBatch(sink).option("checkpointLocation", log).trigger(availableNow=True).start()


def newest_version(spark, path: str, below: int | None = None) -> int | None:
    """Newest published version of a buffer, below a batch number if one is given; None if there is none."""
    from pyspark.errors import AnalysisException
    try:
        named = spark.read.schema("version long").parquet(f"{path}/_versions")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return (named if below is None else named.where(F.col("version") < below)).agg(F.max("version")).first()[0]


def read_buffer(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/version={newest_version(spark, path)}")


def read_after(buffer: DataFrame, cursor: int, limit: int, order: str = "event_id") -> DataFrame:
    """Next page of a buffer after a cursor, in order; the page size is 1 to 1000."""
    return buffer.where(F.col(order) > cursor).orderBy(order).limit(min(1000, max(1, limit)))


def route(events: DataFrame, webhooks: DataFrame, row_key: list[str] | None = None) -> DataFrame:
    """Events paired with the active subscriptions of their organisation: rows of an outbox.

    Subscriptions join by organisation and event name, one row per subscribed name. With ``row_key``, the events of a name
    are spread over tasks by it and come out side by side, so that files hold their subscribers as repetitions.
    """
    subs = webhooks.where("active").select("webhook_id", "org_id", F.explode(F.array_distinct("events")).alias("event"))
    if row_key:
        return join_salted(events, sorted_side(subs), ["org_id", "event"], row_key, how="inner")
    return events.join(subs, ["org_id", "event"])


def route_counts(events: DataFrame, webhooks: DataFrame) -> DataFrame:
    """How many events each active subscription gets: ``webhook_id, org_id, event, deliveries`` (update mode on a stream).

    Events are counted by organisation and name before they meet the subscriptions, so no delivery is a row.
    """
    return route(events.groupBy("org_id", "event").agg(F.count(F.lit(1)).alias("deliveries")), webhooks)


def metrics_windows(requests: DataFrame, duration: str, buckets: list[float], keys: list[str], slide: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Request metrics per time window."""
    w = F.window("ts", duration, slide) if slide else F.window("ts", duration)
    aggs = [F.count(F.lit(1)).alias("requests"), F.sum("duration").alias("duration_sum")] + [F.count_if(F.col("duration") <= b).alias("le_" + str(b).replace(".", "_")) for b in buckets]
    return requests.withWatermark("ts", watermark).groupBy(w.alias("_w"), *keys).agg(*aggs).withColumn("window_start", F.col("_w.start")).drop("_w")


def sensor_sync(ref: DataFrame, other: DataFrame, tolerance: str, watermark: str = WATERMARK) -> DataFrame:
    """Live pairing: every reference frame with the other sensor's frames inside the tolerance.

    Left outer, so a frame without partner appears once its time has passed. ``nearest_of`` then keeps the closest.
    """
    a = ref.withWatermark("ts", watermark).select(F.col("bundle_id").alias("bundle_id"), F.col("seq").alias("ref_seq"), F.col("ts").alias("ref_ts"))
    b = other.withWatermark("ts", watermark).select(F.col("bundle_id").alias("_b"), F.col("seq").alias("other_seq"), F.col("ts").alias("other_ts"))
    near = (F.col("bundle_id") == F.col("_b")) & (F.col("other_ts") >= F.col("ref_ts") - F.expr(f"INTERVAL {tolerance}")) & (F.col("other_ts") <= F.col("ref_ts") + F.expr(f"INTERVAL {tolerance}"))
    return a.join(b, near, "leftOuter").drop("_b")


def nearest_of(pairs: DataFrame) -> DataFrame:
    gap = F.abs(F.unix_micros("other_ts") - F.unix_micros("ref_ts"))
    return pairs.groupBy("bundle_id", "ref_seq").agg(F.min_by("other_seq", F.when(F.col("other_ts").isNotNull(), F.struct(gap.alias("g"), F.col("other_ts").alias("t")))).alias("other_seq"),
                                                     F.min(gap / 1000.0).alias("delta_ms"))


def dedup_events(events: DataFrame, key: str = "event_id", ts: str = "created_at", watermark: str = WATERMARK) -> DataFrame:
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def job_notifications(jobs: DataFrame) -> DataFrame:
    """One message per change of a job's status. ``jobs(job_id string, seq, name, status, message, error)``."""
    levels = {"done": "success", "failed": "error", "cancelled": "warning"}

    def tell(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("seq")
        last = state.get[0] if state.exists else None
        prev = pdf["status"].shift(1)
        prev.iloc[0] = last
        changed = pdf[pdf["status"] != prev]
        state.update((str(pdf["status"].iloc[-1]),))
        if len(changed):
            s = changed["status"]
            word = s.map({"done": "finished"}).fillna(s)
            detail = changed["error"].where((s == "failed") & changed["error"].notna() & (changed["error"] != ""), changed["message"])
            yield pd.DataFrame({"job_id": k[0], "seq": changed["seq"], "level": s.map(levels).fillna("info"), "title": changed["name"] + " " + word, "detail": detail})

    return jobs.groupBy("job_id").applyInPandasWithState(tell, "job_id string, seq long, level string, title string, detail string", "status string", "append", GroupStateTimeout.NoTimeout)


def count_late(stream: DataFrame, path: str, log: str, delay_s: float = 600.0, ts: str = "ts"):
    """Rows of each batch that lie behind the newest time of all earlier batches by more than the delay.

    Each batch writes its own count row and its newest time, so a re-run changes nothing.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = None
        if batch_id > 0:
            try:
                seen = spark.read.parquet(path).where(F.col("batch_no") < batch_id).agg(F.max("newest_us")).first()[0]
            except Exception as err:  # noqa: BLE001 - nothing written yet
                if "PATH_NOT_FOUND" not in str(err):
                    raise
        edge = F.lit(seen).cast("long") - int(delay_s * 1e6)
        us = F.unix_micros(F.col(ts))
        (batch.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(us < edge, F.lit(False))).alias("late"), F.max(us).alias("newest_us"))
         .write.mode("overwrite").parquet(f"{path}/batch_no={batch_id}"))

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", log).trigger(availableNow=True).start()
