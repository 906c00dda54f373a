"""Nearest and interpolated sensor rows, ties, duplicates, clamps and chunk borders."""

import random

import pytest

from fieldspark.operators import asof


def frame(spark, rows, extra="path string"):
    return spark.createDataFrame(rows, f"bundle_id string, t_ms double, seq long, {extra}")


@pytest.mark.parametrize("chunk", [10.0, 1e9])
def test_nearest_equals_scan(spark, chunk):
    rng = random.Random(2)
    other = [("b", float(rng.randrange(300)), i, f"p{i}") for i in range(80)]
    ref = [("b", float(rng.randrange(-20, 320)), i, "r") for i in range(60)]
    out = asof.nearest(frame(spark, ref), frame(spark, other), ["bundle_id"], ["path"], 5.0, chunk_ms=chunk).collect()
    ordered = sorted(other, key=lambda s: (s[1], s[2]))
    for r in out:
        best = min(ordered, key=lambda s: abs(s[1] - r["t_ms"]))
        d = abs(best[1] - r["t_ms"])
        assert r["near_delta"] == d and r["near_path"] == (best[3] if d <= 5.0 else None)
    assert len(out) == 60


def test_tie_takes_the_earlier(spark):
    out = asof.nearest(frame(spark, [("b", 10.0, 0, "r")]), frame(spark, [("b", 5.0, 0, "old"), ("b", 15.0, 1, "new")]), ["bundle_id"], ["path"], 50.0).first()
    assert out["near_path"] == "old"


def test_no_partner_in_the_bundle(spark):
    out = asof.nearest(frame(spark, [("b", 10.0, 0, "r")]), frame(spark, [("c", 5.0, 0, "x")]), ["bundle_id"], ["path"], 50.0).first()
    assert out["near_path"] is None and out["near_delta"] is None


def test_interpolation_and_clamps(spark):
    s = frame(spark, [("b", 100.0, 0, [0.0, 0.0, 0.0], 1.0, "a"), ("b", 200.0, 1, [10.0, 20.0, 30.0], 2.0, "z")], "acc array<double>, alt double, fix string")
    ref = frame(spark, [("b", t, i, "r") for i, t in enumerate([90.0, 100.0, 125.0, 200.0, 230.0])])
    out = {r["t_ms"]: r for r in asof.interpolate(ref, s, ["bundle_id"], ["alt"], ["acc"], ["fix"], 28.0, chunk_ms=30.0).collect()}
    assert out[125.0]["at_alt"] == 1.25 and out[125.0]["at_acc"] == [2.5, 5.0, 7.5] and out[125.0]["at_fix"] == "a"
    assert out[90.0]["at_alt"] == 1.0 and out[90.0]["at_delta"] == 10.0
    assert out[200.0]["at_alt"] == 2.0 and out[230.0]["at_alt"] is None and out[230.0]["at_delta"] == 30.0


def test_alignment(spark):
    rgb = frame(spark, [("b", 0.0, 0, "r0"), ("b", 100.0, 1, "r1")])
    thermal = frame(spark, [("b", 10.0, 0, "t0"), ("b", 400.0, 1, "t1"), ("only", 0.0, 0, "t")])
    nir = frame(spark, [("b", 95.0, 0, "n0")])
    lidar = frame(spark, [("b", 300.0, 0, "l0")])
    imu = frame(spark, [("b", 0.0, 0, [1.0, 0.0, 0.0], [0.0, 0.0, 0.0])], "accel array<double>, gyro array<double>")
    gnss = frame(spark, [("b", 0.0, 0, 1.0, 2.0, 3.0, "fix")], "lat double, lon double, alt_m double, fix string")
    a = asof.align_sensors(rgb, thermal, {"nir": nir}, lidar, imu, gnss)
    rows = {(r["bundle_id"], r["t_ms"]): r for r in a.collect()}
    assert rows[("b", 0.0)]["thermal_path"] == "t0" and rows[("b", 0.0)]["multispectral"] == {"nir": "n0"} and rows[("b", 100.0)]["lidar_path"] == "l0"
    assert rows[("b", 100.0)]["imu_accel"] is None and rows[("b", 100.0)]["sync_error_ms"]["imu"] == 100.0
    assert rows[("only", 0.0)]["reference_sensor"] == "thermal" and rows[("only", 0.0)]["thermal_path"] == "t"
    stats = {r["bundle_id"]: r for r in asof.alignment_stats(a).collect()}
    assert stats["b"]["imu_match_pct"] == 50.0 and stats["b"]["thermal_match_pct"] == 100.0
