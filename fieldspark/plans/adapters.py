"""Views that read the given tables as survey tables.

Each text is valid in Spark SQL and in DuckDB alike, and keeps every row of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")

ADAPTERS = {
    "telemetry": """
SELECT user_id AS flight_id, event_id AS seq, CAST(ts AS TIMESTAMP) AS ts,
       CAST(41.3 AS DOUBLE) + CAST(event_id % 997 AS DOUBLE) / 100000 AS latitude,
       CAST(-81.75 AS DOUBLE) + CAST(event_id % 991 AS DOUBLE) / 100000 AS longitude,
       CAST(event_id % 120 AS DOUBLE) AS altitude_rel_m, CAST(100 - event_id % 100 AS DOUBLE) AS battery_pct,
       CAST(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 3 END AS INT) AS gps_fix, CAST(event_id % 101 AS DOUBLE) AS link_quality_pct,
       event_type AS flight_mode, CAST(event_id % 12 AS INT) AS waypoint_index, CAST(event_id % 4 * 4 AS INT) AS waypoint_total, value AS value
FROM events""",
    "frames": """
SELECT user_id AS bundle_id, event_id AS seq, CAST(EPOCH_MS_OF(ts) AS DOUBLE) AS t_ms, event_type AS sensor, value AS value,
       CONCAT(event_type, '/', CAST(event_id AS VARCHAR(20)), '.jpg') AS path
FROM events""",
    "planned": """
SELECT p_size AS mission_id, p_partkey AS idx,
       CAST(-81.75 AS DOUBLE) + CAST(p_partkey % 251 AS DOUBLE) / 100000 AS lon,
       CAST(41.3 AS DOUBLE) + CAST(FLOOR(CAST(p_partkey AS DOUBLE) / 251) AS DOUBLE) / 100000 AS lat,
       CAST(60 AS DOUBLE) AS alt_m, CAST(p_partkey % 360 AS DOUBLE) AS yaw
FROM part""",
    "captured": """
SELECT p_size AS mission_id, p_partkey AS image_seq,
       CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(-81.75 AS DOUBLE) + CAST(p_partkey % 251 AS DOUBLE) / 100000
         + CAST((p_partkey % 13) * 710 + (p_partkey % 7) * 113 AS DOUBLE) / 100000000
         + CASE WHEN p_partkey % 5 = 0 THEN 0.01 ELSE 0 END END AS lon,
       CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(41.3 AS DOUBLE) + CAST(FLOOR(CAST(p_partkey AS DOUBLE) / 251) AS DOUBLE) / 100000
         + CAST((p_partkey % 17) * 590 + (p_partkey % 19) * 107 AS DOUBLE) / 100000000 END AS lat,
       CAST(58 + p_partkey % 5 AS DOUBLE) AS alt_m, CONCAT('dcim/', CAST(p_partkey AS VARCHAR(20)), '.JPG') AS path
FROM part""",
    "defects_t1": """
SELECT o_custkey AS survey_id, o_orderkey AS defect_id, o_orderpriority AS defect_type,
       CAST(-81.75 AS DOUBLE) + CAST((o_orderkey * 7919) % 2300 AS DOUBLE) / 100000000 + CASE WHEN o_orderkey % 5 = 0 THEN 0.01 ELSE 0 END AS lon,
       CAST(41.3 AS DOUBLE) + CAST((o_orderkey * 6007) % 1900 AS DOUBLE) / 100000000 AS lat,
       CAST(o_orderkey % 40 AS DOUBLE) / 16 AS area_m2, CAST(o_orderkey % 12 AS DOUBLE) / 4 AS length_m,
       CAST(o_orderkey % 9 AS DOUBLE) / 8 AS confidence,
       CASE o_orderkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
       CASE o_orderkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'unreviewed' ELSE 'rejected' END AS review_state,
       CONCAT('img', CAST(o_orderkey % 31 AS VARCHAR(9))) AS image
FROM orders""",
    "defects_t2": """
SELECT o_custkey AS survey_id, o_orderkey AS defect_id, o_orderpriority AS defect_type,
       CAST(-81.75 AS DOUBLE) + CAST((o_orderkey * 10477) % 2500 AS DOUBLE) / 100000000 + CASE WHEN o_orderkey % 4 = 0 THEN 0.02 ELSE 0 END AS lon,
       CAST(41.3 AS DOUBLE) + CAST((o_orderkey * 5003) % 1700 AS DOUBLE) / 100000000 AS lat,
       CAST(o_orderkey % 37 AS DOUBLE) / 16 AS area_m2
FROM orders""",
    "findings": """
SELECT p_size AS survey_id, p_partkey AS seq,
       CASE p_partkey % 8 WHEN 0 THEN 'Crack' WHEN 1 THEN 'cell-crack' WHEN 2 THEN 'hotspot' WHEN 3 THEN 'spalling'
            WHEN 4 THEN 'rust' WHEN 5 THEN 'stain' WHEN 6 THEN 'odd thing' ELSE NULL END AS defect_type,
       CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 40 AS DOUBLE) / 16 END AS area_m2, CAST(p_partkey % 12 AS DOUBLE) / 4 AS length_m,
       CAST(p_partkey % 9 AS DOUBLE) / 8 AS confidence, CAST(NULL AS DOUBLE) AS score
FROM part""",
    "cells": """
SELECT CAST(l_suppkey % 4 AS INT) AS survey_id, CAST(l_orderkey % 64 AS INT) AS row_idx, CAST(l_partkey % 64 AS INT) AS col_idx,
       MAX(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END) AS z_t1, MIN(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END) AS z_t2,
       CAST(MAX(l_orderkey + l_partkey) % 6 AS INT) AS class_id, CAST(MIN(l_orderkey + l_partkey) % 6 AS INT) AS guess_id,
       CAST(MAX(l_partkey) % 25 AS INT) AS instance_id
FROM lineitem GROUP BY CAST(l_suppkey % 4 AS INT), CAST(l_orderkey % 64 AS INT), CAST(l_partkey % 64 AS INT)""",
    "runs": """
SELECT o_custkey AS asset_id, o_orderkey AS run_seq, CAST(o_orderdate AS TIMESTAMP) AS run_utc, CAST(o_orderkey % 100 AS DOUBLE) AS integrity_score,
       CAST(100 - o_orderkey % 100 AS DOUBLE) AS severity_index
FROM orders""",
    "samples": """
SELECT d.doc_id AS id, d.source AS source, d.lang AS site_id,
       CASE d.doc_id % 3 WHEN 0 THEN 'CC BY 4.0' WHEN 1 THEN 'CC BY-SA 4.0' ELSE 'CC BY-NC-SA 4.0' END AS license,
       d.text AS content, CAST(COALESCE(l.quality, 2) AS INT) AS label, CAST(d.n_chars AS BIGINT) AS n_chars
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "scores": """
SELECT doc_id AS sample_id, CAST(quality AS INT) AS truth, CAST((doc_id * 7) % 100 AS DOUBLE) / 100 AS score, CAST(toxic AS INT) AS toxic FROM labels""",
    "images": """
SELECT event_id AS image_id, user_id AS dataset_id, CAST(ts AS TIMESTAMP) AS captured_at,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(41.3 AS DOUBLE) + CAST(event_id % 97 AS DOUBLE) / 10000 END AS gps_lat,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(-81.75 AS DOUBLE) + CAST(event_id % 89 AS DOUBLE) / 10000 END AS gps_lon,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS camera_model,
       CAST(event_id % 240 AS DOUBLE) AS sharpness, CAST(event_id % 20 AS DOUBLE) / 100 AS dark_ratio, CAST(event_id % 17 AS DOUBLE) / 100 AS bright_ratio,
       CAST(event_id % 450 AS BIGINT) AS phash, event_id % 33 = 0 AS corrupt, CAST(value AS DOUBLE) / 500 AS crack_ratio
FROM events""",
    "batteries": """
SELECT s_suppkey AS battery_id, s_nationkey AS organization_id, CAST(s_suppkey % 400 AS INT) AS cycle_count, 300 AS cycle_limit,
       CAST(60 + s_suppkey % 41 AS DOUBLE) AS health_pct, s_suppkey % 9 = 0 AS retired
FROM supplier""",
    "aircraft": """
SELECT c_custkey AS aircraft_id, c_nationkey AS organization_id, CAST(c_custkey % 300 AS DOUBLE) AS hours_total,
       CAST(c_custkey % 200 AS DOUBLE) AS hours_at_service, CAST(c_custkey % 3 * 50 AS DOUBLE) AS service_interval_h,
       CASE WHEN c_custkey % 13 = 0 THEN 'grounded' ELSE 'active' END AS status, CAST(DATE '2024-01-01' AS DATE) AS today
FROM customer""",
    "usage": """
SELECT o_custkey AS aircraft_id, o_custkey % 97 AS pilot_id, o_orderkey AS seq, CAST(o_orderdate AS TIMESTAMP) AS ts,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 8 AS DOUBLE) / 4 END AS flight_hours,
       CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderkey % 130 AS DOUBLE) END AS battery_health,
       CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderkey % 500 AS DOUBLE) END AS service_hours
FROM orders""",
    "org_events": """
SELECT event_id, user_id % 5 AS org_id, CAST(ts AS TIMESTAMP) AS created_at, event_type AS event, props AS payload_json, value AS value FROM events""",
    "gcp": """
SELECT l_orderkey AS survey_id, CONCAT('GCP', CAST(l_linenumber AS VARCHAR(9)), '-', CAST(l_partkey AS VARCHAR(12)), '-', CAST(l_suppkey AS VARCHAR(12))) AS name,
       CAST(l_partkey % 1000 AS DOUBLE) AS x, CAST(l_suppkey % 1000 AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS z,
       CAST(l_partkey % 1000 AS DOUBLE) + CAST(l_orderkey % 9 AS DOUBLE) / 16 AS cx,
       CAST(l_suppkey % 1000 AS DOUBLE) - CAST(l_partkey % 7 AS DOUBLE) / 32 AS cy, CAST(l_quantity AS DOUBLE) + CAST(l_suppkey % 5 AS DOUBLE) / 64 AS cz,
       CAST(l_linenumber % 5 AS INT) AS marks
FROM lineitem""",
    "camera_events": """
SELECT user_id AS survey_id, event_id AS sequence, CAST(ts AS TIMESTAMP) AS ts,
       CASE event_id % 5 WHEN 0 THEN 'single' WHEN 1 THEN 'float' ELSE 'fixed' END AS solution,
       CAST(event_id % 64 AS DOUBLE) / 1024 AS std_h
FROM events""",
    "uploads": """
SELECT l_orderkey AS upload_id, CAST(l_linenumber AS INT) AS chunk, CAST(l_quantity * 100 AS BIGINT) AS chunk_bytes FROM lineitem""",
    "versions": """
SELECT o_custkey AS mission_id, o_orderkey AS version_seq, CAST(o_orderkey % 5 * 10 AS DOUBLE) AS altitude_m, CAST(o_orderkey % 3 AS DOUBLE) / 10 AS overlap,
       CAST(o_orderkey % 40 AS INT) AS waypoints, CONCAT('g', CAST(o_orderkey % 2 AS VARCHAR(3))) AS geofence
FROM orders""",
    "points": """
SELECT vec_id AS point_id, label AS cloud_id, CAST(EMB_AT(1) AS DOUBLE) AS x, CAST(EMB_AT(2) AS DOUBLE) AS y, CAST(EMB_AT(3) AS DOUBLE) AS z FROM embeddings""",
    "zones": """
SELECT n_nationkey AS zone_id, CAST(n_nationkey % 5 * 12 AS DOUBLE) + 0.25 AS x0, CAST(FLOOR(CAST(n_nationkey AS DOUBLE) / 5) * 12 AS DOUBLE) + 0.25 AS y0,
       CAST(n_nationkey % 5 * 12 + 4 + n_nationkey % 7 AS DOUBLE) + 0.25 AS x1, CAST(FLOOR(CAST(n_nationkey AS DOUBLE) / 5) * 12 + 5 AS DOUBLE) + 0.25 AS y1
FROM nation""",
}

# Spellings that differ between the two engines.
_SPARK = {"EPOCH_MS_OF(ts)": "unix_micros(CAST(ts AS TIMESTAMP)) / 1000.0", "EMB_AT(1)": "embedding[0]", "EMB_AT(2)": "embedding[1]", "EMB_AT(3)": "embedding[2]"}
_ANSI = {"EPOCH_MS_OF(ts)": "epoch_us(ts) / 1000.0", "EMB_AT(1)": "embedding[1]", "EMB_AT(2)": "embedding[2]", "EMB_AT(3)": "embedding[3]"}


def _spell(text: str, words: dict[str, str]) -> str:
    for a, b in words.items():
        text = text.replace(a, b)
    return text


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One adapter as a DataFrame."""
    import re
    text = _spell(ADAPTERS[name], _SPARK)
    used = {t: table(spark, sf, t) for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)}
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **used)


def cte(*names: str) -> str:
    """``WITH`` clause that defines the adapters for the other engine."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_spell(ADAPTERS[n], _ANSI)})" for n in names)
