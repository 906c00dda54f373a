"""Distributed matching equals the sorted greedy scan, also with ties, copies and crowds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldspark.operators import capture, matching as m

R = 6371008.8


def hav(a, b):
    (x1, y1), (x2, y2) = a, b
    p1, p2 = math.radians(y1), math.radians(y2)
    s = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * R * math.asin(min(1.0, math.sqrt(s)))


def greedy(left, right, radius):
    out = set()
    for key in {k for k, *_ in left}:
        pairs = sorted((hav((lx, ly), (rx, ry)), i, j) for k, i, lx, ly in left if k == key for kk, j, rx, ry in right if kk == key)
        used_l, used_r = set(), set()
        for d, i, j in pairs:
            if d <= radius and i not in used_l and j not in used_r:
                used_l.add(i)
                used_r.add(j)
                out.add((key, i, j))
    return out


def frames(spark, left, right):
    return (spark.createDataFrame(left, "g string, idx long, lon double, lat double"), spark.createDataFrame(right, "g string, image_seq long, lon double, lat double"))


def scattered(seed, n, lat=41.0, spread=4e-4, grid=None, groups="ab"):
    rng = random.Random(seed)
    pick = (lambda: rng.randrange(grid) * spread / grid) if grid else (lambda: rng.random() * spread)
    return [(rng.choice(groups), i, -81.0 + pick(), lat + pick()) for i in range(n)]


def pairs_of(df):
    return {(r["g"], r["idx"], r["image_seq"]) for r in df.collect()}


@pytest.mark.parametrize("seed,grid", [(1, None), (2, 4)])
def test_bounded_groups(spark, seed, grid):
    left, right = scattered(seed, 60, grid=grid), scattered(seed + 50, 70, grid=grid)
    a, b = frames(spark, left, right)
    assert pairs_of(m.match_one_to_one(a, b, ["g"], 15.0, left_id="idx", right_id="image_seq")) == greedy(left, right, 15.0)


@pytest.mark.parametrize("seed,grid,crowd", [(3, None, 4_000_000), (4, 3, 4_000_000), (5, None, 20)])
def test_distributed_rounds(spark, seed, grid, crowd):
    """No group may be scanned in one task here; ``grid`` makes copies and ties, ``crowd`` forces staged radii."""
    left, right = scattered(seed, 40, grid=grid, groups="a"), scattered(seed + 50, 45, grid=grid, groups="a")
    a, b = frames(spark, left, right)
    got = m.match_one_to_one(a, b, ["g"], 15.0, left_id="idx", right_id="image_seq", group_pairs=0, crowd=crowd)
    assert pairs_of(got) == greedy(left, right, 15.0)


def test_across_latitude_bands(spark):
    left = [("a", i, 10.0 + i * 1e-3, 60.0 - 2e-5) for i in range(5)]
    right = [("a", i, 10.0 + i * 1e-3 + 1e-5, 60.0 + 3e-5) for i in range(5)]
    a, b = frames(spark, left, right)
    assert len(pairs_of(m.match_one_to_one(a, b, ["g"], 15.0, left_id="idx", right_id="image_seq"))) == 5


@pytest.mark.parametrize("seed,lon,lat", [(9, -81.0, 41.0), (10, 179.9999, 10.0), (11, 20.0, 88.99995), (12, 5.0, -0.0001)])
def test_suppression_equals_greedy(spark, seed, lon, lat):
    """Also across the date line, near a pole, and where latitude bands meet."""
    rng = random.Random(seed)
    turn = lambda x: x - 360 if x > 180 else x
    wide = 2e-4 / math.cos(math.radians(lat))
    items = [("a", i, float(rng.randrange(5)), turn(lon + rng.random() * wide), lat + rng.random() * 2e-4) for i in range(60)]
    items += [("a", 100 + i, float(rng.randrange(5)), *items[0][3:]) for i in range(5)]
    df = spark.createDataFrame(items, "g string, seq long, p double, lon double, lat double")
    got = {r["seq"]: r["kept_by"] for r in m.suppress_nearby(df, ["g"], 5.0, priority="p", seq="seq").collect()}
    kept, want = [], {}
    for _, i, p, x, y in sorted(items, key=lambda t: (-t[2], t[1])):
        owner = next((k for k, kx, ky in kept if hav((x, y), (kx, ky)) <= 5.0), None)
        want[i] = i if owner is None else owner
        if owner is None:
            kept.append((i, x, y))
    assert got == want


def test_suppressed_reasons_and_limit(spark):
    items = [("a", 1, 9.0, -81.0, 41.0, ["x"]), ("a", 2, 8.0, -81.0, 41.00001, ["y"]), ("a", 3, 7.0, -81.0, 41.01, ["z"]), ("a", 4, 6.0, -81.0, 41.00002, ["w"])]
    df = spark.createDataFrame(items, "g string, seq long, p double, lon double, lat double, reasons array<string>")
    marked = m.suppress_nearby(df, ["g"], 5.0, priority="p", seq="seq")
    two = {r["seq"]: r["reasons"] for r in m.merge_suppressed(marked, ["g"], priority="p", seq="seq", reasons="reasons", max_items=5).collect()}
    one = {r["seq"]: r["reasons"] for r in m.merge_suppressed(marked, ["g"], priority="p", seq="seq", reasons="reasons", max_items=1).collect()}
    assert two == {1: ["w", "x", "y"], 3: ["z"]}
    assert one == {1: ["x"]} or one == {1: ["x", "y"]}


def test_capture_report(spark):
    planned = spark.createDataFrame([("m", i, -81.7505 + i * 5e-4, 41.3042, 60.0, 0.0) for i in range(4)], "mission_id string, idx long, lon double, lat double, alt_m double, yaw double")
    shots = [("m", 0, -81.7505, 41.3042, 61.0), ("m", 1, -81.75, 41.30421, 60.0), ("m", 2, -81.749, 41.31, 60.0), ("m", 3, None, None, None)]
    captured = spark.createDataFrame([(*s, f"c/{s[1]}.jpg") for s in shots], "mission_id string, image_seq long, lon double, lat double, alt_m double, path string")
    pairs = capture.match_captures(planned, captured)
    cov = capture.coverage(planned, captured, pairs).first()
    assert (cov["matched"], cov["missed"], cov["unplanned"], cov["ungeotagged"], cov["coverage_pct"]) == (2, 2, 1, 1, 50.0)
    free = captured.withColumn("mission_id", F.lit("free")).unionByName(captured)
    seen = {r["mission_id"]: r for r in capture.coverage(planned, free, pairs).collect()}
    assert (seen["free"]["planned"], seen["free"]["images"], seen["free"]["missed"], seen["free"]["coverage_pct"]) == (0, 4, 0, None)
    checked = spark.createDataFrame([("free", 4, 0, 0), ("m", 4, 0, 0)], "mission_id string, checked int, flagged int, unreadable int")
    verdict = {r["mission_id"]: r for r in capture.site_verdict(capture.coverage(planned, free, pairs), checked, "mission_id").collect()}
    assert (verdict["free"]["verdict"], verdict["free"]["unchecked"], verdict["free"]["warnings"]) == ("ready", ["coverage"], [])
    assert (verdict["m"]["verdict"], verdict["m"]["blocking"]) == ("blocked", ["coverage"])
    assert {r["status"] for r in capture.unmatched(planned, captured, pairs).collect()} == {"missed", "unplanned", "ungeotagged"}


def test_defect_epochs(spark):
    s = "survey_id string, defect_type string, defect_id string, lon double, lat double, area_m2 double"
    at = lambda i: (-81.0 + i * 1e-3, 41.0)
    old = [("s", "crack", 1, *at(1), 1.0), ("s", "crack", 2, *at(2), 1.0), ("s", "crack", 3, *at(3), 1.0), ("s", "crack", 4, *at(4), 0.0), ("s", "crack", 5, *at(5), 1.0)]
    new = [("s", "crack", 11, *at(1), 1.2), ("s", "crack", 12, *at(2), 0.8), ("s", "crack", 13, *at(3), 1.05), ("s", "crack", 14, *at(4), 0.0), ("s", "spall", 15, *at(5), 1.0)]
    s = s.replace("defect_id string", "defect_id long")
    c = capture.compare_defect_epochs(spark.createDataFrame(old, s), spark.createDataFrame(new, s))
    got = {(r["earlier_id"], r["later_id"]): r["change"] for r in c.collect()}
    assert got == {(1, 11): "grown", (2, 12): "shrunk", (3, 13): "unchanged", (4, 14): "unchanged", (5, None): "resolved", (None, 15): "new"}


def test_suppression_of_a_crowd_stays_linear(spark):
    """10^5 items in one place and 10^5 more within one cell: one row per cell and round, no pair of them."""
    same = spark.range(100_000).selectExpr("'a' AS g", "id AS seq", "CAST(id % 7 AS DOUBLE) AS p", "-81.0D AS lon", "41.0D AS lat")
    near = spark.range(100_000).selectExpr("'b' AS g", "id AS seq", "CAST(id % 7 AS DOUBLE) AS p", "-81.0D + id * 1e-11 AS lon", "41.0D AS lat")
    got = m.suppress_nearby(same.unionByName(near), ["g"], 5.0, priority="p", seq="seq").groupBy("g", "kept_by").count().collect()
    assert {(r["g"], r["kept_by"], r["count"]) for r in got} == {("a", 6, 100_000), ("b", 6, 100_000)}


def test_nothing_to_suppress(spark):
    df = spark.createDataFrame([("a", 1, 1.0, None, None), ("a", 2, 2.0, None, 3.0)], "g string, seq long, p double, lon double, lat double")
    assert {(r["seq"], r["kept"], r["kept_by"]) for r in m.suppress_nearby(df, ["g"], 5.0, priority="p", seq="seq").collect()} == {(1, True, 1), (2, True, 2)}
    assert m.suppress_nearby(df.limit(0), ["g"], 5.0, priority="p", seq="seq").count() == 0


def test_pairs_next_to_a_pole(spark):
    a = spark.createDataFrame([("a", 1, 0.0, 89.99), ("a", 2, 170.0, 89.99999)], "g string, i long, lon double, lat double")
    b = spark.createDataFrame([("a", 1, 0.1, 89.99), ("a", 2, -10.0, 89.99999)], "g string, j long, mx double, my double")
    got = m.near_pairs(a, b, ["g"], 5.0, lpos=("lon", "lat"), rpos=("mx", "my")).collect()
    assert {(r["i"], r["j"]) for r in got} == {(1, 1), (2, 2)}


@pytest.mark.parametrize("name", ["defect_epochs", "defect_epoch_counts"])
def test_pairs_of_one_length_equal_sql(spark, folder, name):
    """Two pairs as long as each other, which the last bits of the distance must not tell apart, and a distance next to half a unit of the last place."""
    import duckdb

    import __spark_entry__ as entry
    from check import rows_of
    orders = [(577380, "3-MEDIUM", k) for k in (5763086, 5768438, 5846338)] + [(332665, "2-HIGH", k) for k in (3388274, 3404193, 3414485, 3429816)]
    orders += [(1, "1-URGENT", k) for k in (3537797, 3547297, 5459459)]
    spark.createDataFrame(orders, "o_custkey long, o_orderpriority string, o_orderkey long").write.parquet(f"{folder}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet/*.parquet'")
    got = entry.queries()[name](spark, folder).toPandas()
    assert rows_of(got) == rows_of(con.execute(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("seed,grid", [(6, None), (7, 100)])
def test_blocks_equal_the_scan(spark, monkeypatch, seed, grid):
    """A group too large for one task is scanned block by block; no pair is stored, as rounds store them."""
    monkeypatch.setattr(m, "_match_rounds", None)
    left, right = (scattered(k, n, spread=8e-3, grid=grid, groups="a") for k, n in ((seed, 1400), (seed + 50, 1300)))
    a, b = frames(spark, left, right)
    got = pairs_of(m.match_one_to_one(a, b, ["g"], 15.0, left_id="idx", right_id="image_seq", group_pairs=4_000))
    # on a grid the order of equal pairs rests on the formula's last bits
    assert got == (pairs_of(m.match_one_to_one(a, b, ["g"], 15.0, left_id="idx", right_id="image_seq")) if grid else greedy(left, right, 15.0))


def test_a_chain_across_blocks(spark, monkeypatch):
    """Each pair hangs on the next, shorter one, from block to block; a group that needs no blocks is settled beside it."""
    monkeypatch.setattr(m, "_match_rounds", None)
    x, at = -81.0, []
    for k in range(70):
        at.append(x)
        x += (14.9 - 0.1 * k) / (111_195.08 * math.cos(math.radians(41.0)))
    left, right = [("a", i, x, 41.0) for i, x in enumerate(at[::2])], [("a", i, x, 41.0) for i, x in enumerate(at[1::2])]
    left, right = left + scattered(8, 5, groups="b"), right + scattered(9, 5, groups="b")
    a, b = frames(spark, left, right)
    got = pairs_of(m.match_one_to_one(a, b, ["g"], 15.0, left_id="idx", right_id="image_seq", group_pairs=400))
    assert got == greedy(left, right, 15.0) and len(got) > 34
