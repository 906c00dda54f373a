"""Cases in which rows or values were once lost or judged wrongly."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fieldspark.functions import bands, text
from fieldspark.operators import capture, fleet, inspection, matching, spatial
from fieldspark.sources import readers, writers
from fieldspark.streaming import flows


def test_upsert_keeps_the_stored_table(spark, folder):
    path = f"{folder}/t"
    writers.upsert_table(spark.createDataFrame([(1, "a", 1)], "id long, v string, ver long"), path, ["id"], "ver")
    with pytest.raises(AnalysisException):
        writers.upsert_table(spark.createDataFrame([(2, [1], 2)], "id long, v array<int>, ver long"), path, ["id"], "ver")
    assert [tuple(r) for r in writers.current_table(spark, path).collect()] == [(1, "a", 1)]
    writers.upsert_table(spark.createDataFrame([(1, "b", 2), (3, "c", 1)], "id long, v string, ver long"), path, ["id"], "ver")
    assert sorted(tuple(r) for r in writers.current_table(spark, path).collect()) == [(1, "b", 2), (3, "c", 1)]


def test_buffer_takes_the_newest_version_before(spark, folder):
    for number in (0, 4):
        spark.createDataFrame([(number,)], "version long").write.mode("append").parquet(f"{folder}/_versions")
    assert flows.newest_version(spark, folder, below=7) == 4 and flows.newest_version(spark, folder, below=4) == 0
    assert flows.newest_version(spark, folder, below=0) is None and flows.newest_version(spark, f"{folder}/none") is None


def test_camera_events_with_a_repeated_tag(spark, folder):
    line = "1 345600.5 2200 1,N 2,E 3,V 46.5,Lat 46.75,Lat 8.0,Lon 400,Ellh " + "0,Z " * 1100 + "1,Q"
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{folder}/e")
    row = readers.read_camera_events(spark, f"{folder}/e").first()
    assert row["status"] == "ok" and row["lat"] == 46.75 and row["solution"] != readers.read_camera_events(spark, f"{folder}/e").select(bands.camera_solution(F.lit(0)).alias("s")).first()["s"]


def test_control_points_with_quoted_names(spark, folder):
    lines = [("name,x,y,z,epsg",), ('"P1, north",1,2,3,32617',), ('"the ""old"" mark",4,5,6,32617',), ("P3,7,8,9,32617",)]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(f"{folder}/c")
    got = {r["name"]: (r["x"], r["y"], r["z"]) for r in readers.read_control_points(spark, f"{folder}/c").collect()}
    assert got == {"P1, north": (1, 2, 3), 'the "old" mark': (4, 5, 6), "P3": (7, 8, 9)}


def test_hazards_far_and_none(spark):
    ways = spark.createDataFrame([("m", 8.0, 46.0)], "mission_id string, lon double, lat double")
    markers = spark.createDataFrame([("m", 1, 8.0, 47.3, 150_000.0), ("m", 2, 8.0, 49.0, 150_000.0)], "mission_id string, marker_id long, lon double, lat double, radius_m double")
    assert [r["marker_id"] for r in spatial.hazards_near(ways, markers, ["mission_id"], 10.0).collect()] == [1]
    none = spatial.hazards_near(ways, markers.limit(0), ["mission_id"], 10.0)
    assert none.columns == ["mission_id", "marker_id", "gap_m"] and none.count() == 0


def test_pairs_across_the_date_line(spark):
    a = spark.createDataFrame([("k", 1, 179.99999, 10.0), ("k", 2, -179.99999, -10.0)], "k string, a long, lon double, lat double")
    b = spark.createDataFrame([("k", 1, -179.99999, 10.0), ("k", 2, 179.99999, -10.0)], "k string, b long, mx double, my double")
    got = matching.near_pairs(a, b, ["k"], 5.0, lpos=("lon", "lat"), rpos=("mx", "my"))
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [(1, 1), (2, 2)]


def test_names_and_white_space(spark):
    row = spark.range(1).select(text.canonical_name(F.lit("Straße ﬁn")).alias("a"), text.normalise_class(F.lit("\tRust Spot\n")).alias("b"), bands.control_mode(F.lit("\tAUTO\n")).alias("c")).first()
    assert row["a"] == "strasse_fin" and row["b"] == "rust_spot" and row["c"] == "autonomous"


def test_site_verdict_warns(spark):
    cov = spark.createDataFrame([("a", 100, 98, 2, 5, 98.0), ("b", 100, 90, 10, 0, 90.0), ("c", 10, 10, 0, 0, 100.0)], "m string, planned long, matched long, missed long, ungeotagged long, coverage_pct double")
    quality = spark.createDataFrame([("a", 100, 0, 0), ("b", 90, 0, 0)], "m string, checked long, flagged long, unreadable long")
    got = {r["m"]: r for r in capture.site_verdict(cov, quality, "m").collect()}
    assert got["a"]["verdict"] == "warnings" and got["a"]["warnings"] == ["missed", "ungeotagged"]
    assert got["b"]["verdict"] == "blocked" and got["b"]["blocking"] == ["coverage"] and got["c"]["verdict"] == "unchecked" and got["c"]["unchecked"] == ["quality"]
    planned = spark.createDataFrame([("b", 1), ("b", 2), ("a", 1)], "m string, idx long")
    pairs = spark.createDataFrame([("b", 1)], "m string, idx long")
    assert [tuple(r) for r in capture.refly_points(planned, pairs, capture.site_verdict(cov, quality, "m"), "m").collect()] == [("b", 2)]


def test_corrupt_images_are_not_blurry(spark):
    images = spark.createDataFrame([("d", True, 5.0, "a"), ("d", False, 500.0, "b")], "dataset_id string, corrupt boolean, sharpness double, phash string")
    images = images.selectExpr("*", "0.0D AS dark_ratio", "0.0D AS bright_ratio", "1.0D AS gps_lat", "1.0D AS gps_lon")
    row = inspection.dataset_validation(images, "dataset_id").first()
    assert (row["corrupt"], row["blurry"]) == (1, 0)


def test_plans_with_unstamped_points_are_refused(spark):
    planned = spark.createDataFrame([(1, 0, "linked_seg0:strip"), (1, 1, None), (2, 0, "linked_seg0:strip"), (2, 1, "linked_seg1:strip")], "mission_id long, idx long, primitive string")
    done = planned.where("idx = 0")
    got = sorted((r["mission_id"], r["segment"], r["state"]) for r in fleet.segment_progress(planned, done).collect())
    assert got == [(1, None, "refused"), (2, 0, "complete"), (2, 1, "not_started")]
    counted = planned.where("mission_id = 2").withColumn("declared_segments", F.lit(3))
    assert [r["state"] for r in fleet.segment_progress(counted, done).collect()] == ["refused"]


def test_report_has_every_row(spark):
    projects = spark.createDataFrame([(1,), (2,)], "p long")
    rows = spark.range(700).selectExpr("1L AS p", "id AS seq", "id % 2 = 0 AS include_in_report")
    audit = spark.range(50).selectExpr("1L AS p", "id AS seq")
    got = inspection.report_context(projects, {"runs": rows}, audit, "p", audit_limit=10).groupBy("entry_of").count().collect()
    assert {r["entry_of"]: r["count"] for r in got} == {"runs": 350, "audit": 10}
    assert {r["p"]: r["runs_count"] for r in inspection.report_counts(projects, {"runs": rows}, "p").collect()} == {1: 350, 2: 0}


def test_findings_in_report_order(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 5.0), (3, None), (4, 5.0)], "id long, risk_score double")
    assert [r["id"] for r in inspection.order_findings(rows, "risk", "id").collect()] == [2, 4, 1, 3]
