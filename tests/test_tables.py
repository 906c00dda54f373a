"""Splits against hashlib, rules, corpus gates, geometry, similarity, streams against batches."""

import hashlib
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.functions import geo, physics, rules, splits
from fieldspark.operators import cloud, corpus, inspection as ins, spatial
from fieldspark.streaming import flows


def test_splits_equal_hashlib(spark):
    df = spark.range(500).select(F.concat(F.lit("é"), F.col("id").cast("string")).alias("k"))
    got = df.select("k", splits.sha1_position("s", "k").alias("a"), splits.sha256_position("s", "k").alias("b"), splits.sha1_mod("s", "k").alias("c")).collect()
    for r in got:
        assert r["a"] == int(hashlib.sha1(f"s/{r['k']}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
        assert r["b"] == int.from_bytes(hashlib.sha256(f"s\0{r['k']}".encode()).digest()[:8], "big") / float(2**64)
        assert r["c"] == int(hashlib.sha1(f"s/{r['k']}".encode()).hexdigest(), 16) % 10_000


def test_one_split_per_site(spark):
    s = spark.createDataFrame([(f"i{i}", "src", f"site{i // 2}", "CC BY 4.0") for i in range(60)], "id string, source string, site_id string, license string")
    a = corpus.assign_groups(s, "v1", pinned=["src::site3"])
    assert a.groupBy("group").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert {r["split"] for r in a.where("site_id = 'site3'").collect()} == {"test"}
    again = corpus.assign_groups(s.orderBy(F.desc("id")), "v1", pinned=["src::site3"])
    assert {tuple(r) for r in a.select("id", "split").collect()} == {tuple(r) for r in again.select("id", "split").collect()}


def test_union_refuses_other_schema(spark):
    with pytest.raises(rules.Refused):
        corpus.union_sources([("a", spark.range(1)), ("b", spark.range(1))])


def test_rule_engine_and_gate(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, 50.0, "z"), (3, None, " ")], "id int, v double, c string")
    out = rules.check(df, [rules.in_range("v", 0, 10), rules.one_of("c", ["a"], "warning"), rules.required("c")])
    got = {r["id"]: (r["status"], r["reason"], len(r["violations"])) for r in out.collect()}
    assert got == {1: ("ok", None, 0), 2: ("refused", "v must be between 0 and 10", 2), 3: ("refused", "c is required", 2)}
    with pytest.raises(rules.Refused):
        rules.require(out)
    assert rules.require(out.where("id = 1")).count() == 1


def test_missing_position_is_no_distance(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    assert df.select(geo.haversine_m("a", "a", "b", "b").alias("d")).first()["d"] is None
    assert df.select(physics.clip(F.col("b"), 0, 1).alias("d")).first()["d"] is None


def test_utm_known_point(spark):
    r = spark.range(1).select(geo.lonlat_to_utm(F.lit(9.0), F.lit(0.0), F.lit(32632)).alias("u"), geo.lonlat_to_utm(F.lit(-81.7505), F.lit(41.3042), F.lit(32617)).alias("v")).first()
    assert r["u"]["easting"] == pytest.approx(500000.0, abs=1e-6) and r["u"]["northing"] == pytest.approx(0.0, abs=1e-6)
    assert r["v"]["easting"] == pytest.approx(437184.5, abs=50) and r["v"]["northing"] == pytest.approx(4572800, abs=600)


def test_similarity_with_and_without_outliers(spark):
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    p = rng.normal(size=(60, 3)) * 20
    t = 1.7 * p @ q.T + [5, -3, 2]
    bad = t.copy()
    bad[::6] += 50
    schema = "s string, point_id long, px double, py double, pz double, qx double, qy double, qz double"
    make = lambda m: spark.createDataFrame([("a", i, *map(float, p[i]), *map(float, m[i])) for i in range(60)], schema)
    fit = cloud.fit_similarity(make(t), ["s"]).first()
    assert fit["scale"] == pytest.approx(1.7) and np.allclose(np.array(fit["rotation"]).reshape(3, 3), q) and np.allclose(fit["translation"], [5, -3, 2])
    robust = cloud.fit_similarity_robust(make(bad), ["s"], "point_id", rounds=48).first()
    assert robust["scale"] == pytest.approx(1.7) and robust["inliers"] == 50 and np.allclose(robust["translation"], [5, -3, 2])
    assert robust["method"] == "consensus" and robust["rmse_m"] < 1e-9 and fit["method"] == "least_squares" and fit["max_residual_m"] < 1e-9


def test_similarity_refusals_and_residuals(spark):
    rng = np.random.default_rng(2)
    p, miss = rng.normal(size=(30, 3)) * 5, rng.normal(size=(30, 3))
    rows = [("few", i, 1.0 * i, 0.0, 0.0, 1.0 * i, 0.0, 0.0) for i in range(2)] + [("same", i, 1.0, 1.0, 1.0, 1.0 * i, 0.0, 0.0) for i in range(5)]
    rows += [("noisy", i, *map(float, a), *map(float, a + e)) for i, (a, e) in enumerate(zip(p, miss))] + [("noisy", 99, None, 0.0, 0.0, 1.0, 1.0, 1.0)]
    pairs = spark.createDataFrame(rows, "s string, point_id long, px double, py double, pz double, qx double, qy double, qz double")
    got = {r["s"]: r for r in cloud.fit_similarity(pairs, ["s"]).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"few": "refused", "same": "refused", "noisy": "ok"} and got["few"]["scale"] is None and got["noisy"]["n"] == 30
    r = got["noisy"]
    off = np.linalg.norm(r["scale"] * p @ np.array(r["rotation"]).reshape(3, 3).T + r["translation"] - (p + miss), axis=1)
    assert r["rmse_m"] == pytest.approx(np.sqrt((off ** 2).mean())) and r["max_residual_m"] == pytest.approx(off.max())
    best = {r["s"]: r for r in cloud.fit_similarity_robust(pairs, ["s"], "point_id", rounds=16, tolerance=1e-6).collect()}
    assert best["few"]["status"] == best["same"]["status"] == "refused" and best["few"]["method"] == "least_squares" and best["noisy"]["status"] == "ok"


def test_idw_exact_and_within_its_error(spark):
    rng = np.random.default_rng(5)
    xy, z = rng.uniform(0, 400, size=(1500, 2)).round(1), rng.uniform(100, 160, size=1500)
    xy[:300] = xy[0]  # many samples of one place
    samples = spark.createDataFrame([("a", *map(float, p), float(h)) for p, h in zip(xy, z)] + [("b", 1.0, 1.0, 7.0), ("b", 2.0, 2.0, None), ("b", None, 3.0, 9.0)],
                                    "site string, x double, y double, z double")
    spots = [("a", i, *map(float, p)) for i, p in enumerate(rng.uniform(-50, 450, size=(40, 2)))] + [("a", 40, *map(float, xy[0])), ("b", 41, 0.0, 0.0), ("c", 42, 0.0, 0.0), ("a", 43, None, 0.0)]
    points = spark.createDataFrame(spots, "site string, pid long, x double, y double")
    d = lambda x, y: np.maximum(np.hypot(xy[:, 0] - x, xy[:, 1] - y), 0.25)
    want = {i: (z / d(x, y)).sum() / (1 / d(x, y)).sum() for s, i, x, y in spots if s == "a" and x is not None}
    for error, bound in ((0.0, 1e-9), (0.05, 0.05 * (z.max() - z.min()))):
        got = {r["pid"]: r for r in spatial.idw_at_points(points, samples, ["site"], "pid", error=error, block_samples=16).collect()}
        assert len(got) == len(spots) and all(abs(got[i]["elevation_m"] - v) <= bound for i, v in want.items())
        assert all(got[i]["status"] == "refused" and got[i]["elevation_m"] is None for i in (41, 42, 43)) and "position" in got[43]["reason"]


def test_polygon_rule_and_holes(spark):
    pts = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate([(0.5, 0.5), (0.0, 0.5), (1.0, 0.5), (5.0, 5.0)])], "i int, x double, y double")
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    poly = spark.createDataFrame([("sq", ring), ("thin", ring[:2])], "pid string, ring array<struct<x:double,y:double>>")
    got = {(r["i"], r["pid"]) for r in spatial.points_in_polygons(pts, poly, [], 0.4).collect()}
    assert got == {(0, "sq"), (1, "sq")}
    outer = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    hole = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
    rings = spark.createDataFrame([("z", outer), ("z", hole)], "pid string, ring array<struct<x:double,y:double>>")
    c = spark.createDataFrame([(r, q, q + 0.5, r + 0.5) for r in range(4) for q in range(4)], "row_idx int, col_idx int, x double, y double")
    assert spatial.zones_over_cells(c, rings, [], "pid", 2.0, cell_key=["row_idx", "col_idx"]).count() == 12


def test_zero_confidence_reads_as_absent(spark):
    f = spark.createDataFrame([("s", 0, "spalling", 0.8, None, 0.0, None), ("s", 1, "crack", 0.05, None, None, 0.9), ("s", 2, None, None, None, 0.01, None)],
                              "survey_id string, seq long, defect_type string, area_m2 double, length_m double, confidence double, score double")
    r = {x["seq"]: x for x in ins.risk_scores(f).collect()}
    assert (r[0]["confidence_used"], r[1]["confidence_used"], r[2]["confidence_used"]) == (0.7, 0.9, 0.05) and r[2]["class"] == "unknown"
    ranked = {x["seq"]: x["rank"] for x in ins.risk_rank(ins.risk_scores(f), "survey_id", "seq").collect()}
    assert ranked[0] == 1


def write_events(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))


TEL = "flight_id string, seq long, ts timestamp, latitude double, longitude double, gps_fix int, battery_pct double"


def sample(i, flight="f", minute=None, fix=3):
    m = i if minute is None else minute
    return {"flight_id": flight, "seq": i, "ts": f"2024-01-01T{m // 60:02d}:{m % 60:02d}:00Z", "latitude": 41.0 + i * 1e-4, "longitude": -81.0, "gps_fix": fix, "battery_pct": 90.0 - i}


def test_running_distance_over_batches(spark, folder):
    for b in range(3):
        write_events(folder + "/in", f"{b}.json", [sample(b * 4 + k, fix=0 if k == 2 else 3) for k in range(4)])
        os.utime(f"{folder}/in/{b}.json", (1_700_000_000 + b, 1_700_000_000 + b))
    s = flows.running_distance(spark.readStream.schema(TEL).option("maxFilesPerTrigger", 1).json(folder + "/in"))
    last = flows.latest(flows.read_output(spark, flows.run_available(s, "t", "update"), s), ["key"]).first()
    assert last["distance_m"] == pytest.approx(11 * 1e-4 * np.pi / 180 * 6371000, rel=1e-6) and last["positioned"] == 9 and last["late"] == 0


def test_contact_lost_alert(spark, folder):
    states = lambda a, m, phase, clean: {"aircraft_id": a, "ts": f"2024-01-01T{m // 60:02d}:{m % 60:02d}:00Z", "phase": phase, "clean_shutdown": clean, "latitude": 1.0, "longitude": 2.0, "battery_pct": 50.0, "waypoint_index": 3}
    write_events(folder + "/in", "0.json", [states("lost", 0, "flying", False), states("done", 0, "completed", True)])
    write_events(folder + "/in", "1.json", [states("other", 120, "idle", True)])
    write_events(folder + "/in", "2.json", [states("other", 240, "idle", True)])
    for b in range(3):
        os.utime(f"{folder}/in/{b}.json", (1_700_000_000 + b, 1_700_000_000 + b))
    schema = "aircraft_id string, ts timestamp, phase string, clean_shutdown boolean, latitude double, longitude double, battery_pct double, waypoint_index int"
    s = flows.contact_lost(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder + "/in"))
    out = flows.read_output(spark, flows.run_available(s, "c", "append"), s).collect()
    assert [(r["aircraft_id"], r["phase"], r["waypoint_index"]) for r in out] == [("lost", "flying", 3)]


def test_late_rows_are_counted(spark, folder):
    write_events(folder + "/in", "0.json", [sample(i, minute=600 + i) for i in range(3)])
    write_events(folder + "/in", "1.json", [sample(9, minute=30), sample(10, minute=605)])
    for b in range(2):
        os.utime(f"{folder}/in/{b}.json", (1_700_000_000 + b, 1_700_000_000 + b))
    src = spark.readStream.schema(TEL).option("maxFilesPerTrigger", 1).json(folder + "/in")
    flows.count_late(src, folder + "/late", folder + "/log").awaitTermination()
    assert tuple(spark.read.parquet(folder + "/late").agg(F.sum("rows"), F.sum("late")).first()) == (5, 1)


def test_buffer_keeps_newest_over_batches(spark, folder):
    for b in range(3):
        write_events(folder + "/in", f"{b}.json", [{"event_id": b * 10 + k, "org_id": k % 2, "event": "e"} for k in range(10)])
        os.utime(f"{folder}/in/{b}.json", (1_700_000_000 + b, 1_700_000_000 + b))
    src = spark.readStream.schema("event_id long, org_id long, event string").option("maxFilesPerTrigger", 1).json(folder + "/in")
    flows.event_buffer(src, folder + "/buf", folder + "/log", keep=4).awaitTermination()
    got = sorted(r["event_id"] for r in flows.read_buffer(spark, folder + "/buf").collect())
    assert got == [22, 23, 24, 25, 26, 27, 28, 29]
    assert [r["event_id"] for r in flows.read_after(flows.read_buffer(spark, folder + "/buf"), 25, 2).collect()] == [26, 27]


@pytest.mark.parametrize("seed,bucket", [(1, 0.05), (2, 1.0), (3, 1e-3)])
def test_cover_equals_even_odd(spark, seed, bucket):
    """Ragged, self-crossing and thin polygons; points on vertices, on sides and on borders of cells."""
    rng = random.Random(seed)
    polys = []
    for pid in range(12):
        n, size = rng.choice([3, 4, 9, 60, 300]), rng.choice([0.3, 2.0, 40.0])
        ring = [(rng.uniform(-size, size), rng.choice([rng.uniform(-size, size), 0.5, 1.0])) for _ in range(n)]
        polys.append((pid, ring))
    polys += [(90, [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)]), (91, [(0.0, 0.0), (1.0, 1.0)]), (92, [(0.0, 0.0), (100.0, 99.9), (100.0, 100.0)])]
    pts = [(i, rng.uniform(-3, 9), rng.uniform(-3, 9)) for i in range(150)] + [(200 + i, float(i % 9), float(i // 9)) for i in range(81)]
    pts += [(400 + i, *rng.choice(polys[i % 12][1])) for i in range(60)] + [(999, None, 1.0)]
    got = spatial.points_in_polygons(spark.createDataFrame(pts, "i int, x double, y double"), spark.createDataFrame(polys, "pid int, ring array<struct<x:double,y:double>>"), [], bucket, row_key=["i"])
    want = set()
    for i, x, y in pts[:-1]:
        for pid, ring in polys:
            sides = zip(ring, ring[1:] + ring[:1])
            hits = sum((py > y) != (qy > y) and x < px + (y - py) * (qx - px) / (qy - py) for (px, py), (qx, qy) in sides)
            if len(ring) > 2 and hits % 2:
                want.add((i, pid))
    assert sorted((r["i"], r["pid"]) for r in got.collect()) == sorted(want)


def test_cells_along_a_segment(spark):
    """A slanted 100 km segment needs about its length over the cell's size, not the cells of its box; all near places are in them."""
    seg = spark.createDataFrame([(0.0, 0.0, 70_000.0, 71_000.0), (5.0, 5.0, 5.0, 5.0), (0.0, 3.0, 50.0, 3.0), (3.0, 0.0, 3.0, -50.0)], "ax double, ay double, bx double, by double")
    cells = [{(c["bx"], c["by"]) for c in r["c"]} for r in seg.select(spatial.walk(10.0, 2.0).alias("c")).collect()]
    assert len(cells[0]) < 4 * 14_200 and len(cells[2]) <= 14
    rng = random.Random(5)
    for (ax, ay, bx, by), held in zip([tuple(r) for r in seg.collect()], cells):
        for _ in range(300):
            t, a = rng.random(), rng.uniform(0, 6.283)
            x, y = ax + t * (bx - ax) + 1.99 * math.cos(a), ay + t * (by - ay) + 1.99 * math.sin(a)
            assert (math.floor(x / 10), math.floor(y / 10)) in held


def test_a_large_polygon_is_covered_in_linear_rows(spark):
    ring = [(1e5 * math.cos(k / 500 * math.pi), 1e5 * math.sin(k / 500 * math.pi)) for k in range(1000)]
    poly = spark.createDataFrame([(1, ring)], "pid int, ring array<struct<x:double,y:double>>")
    n = spatial.cover(poly, "ring", 0.01).agg(F.count(F.lit(1)).alias("n"), F.count_if("_full").alias("full"), F.sum(F.coalesce(F.size("_e"), F.lit(0))).alias("e")).first()
    assert n["n"] < 1100 and n["full"] > n["n"] / 2 and n["e"] < 30_000


def test_a_base_session_without_duration_blocks(spark):
    rows = [("s", "2024-01-01 10:00:00", "2024-01-01 10:00:00", "2024-01-01 10:00:00"), ("t", "2024-01-01 10:00:00", "2024-01-01 09:00:00", "2024-01-01 11:00:00")]
    placed = (spark.createDataFrame(rows, "survey_id string, ts string, first_obs string, last_obs string")
              .select("survey_id", *[F.col(c).cast("timestamp").alias(c) for c in ("ts", "first_obs", "last_obs")], F.lit("covered").alias("placement"), F.lit("fixed").alias("solution"), F.lit(0.1).alias("std_h")))
    got = {r["survey_id"]: (r["status"], r["reason"]) for r in ins.positioning_report(placed, "survey_id").collect()}
    assert got == {"s": ("blocked", "the base session has no duration"), "t": ("ok", None)}
