"""Analytic surfaces, regions across tile borders, ponding."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import components as c, grid as g, hydrology as h

K = ["survey_id"]


def cells(spark, z, name="value", sid="s"):
    rows = [(sid, int(r), int(q), float(v) if np.isfinite(v) else None) for (r, q), v in np.ndenumerate(z)]
    return spark.createDataFrame(rows, f"survey_id string, row_idx int, col_idx int, {name} double")


def block(n=80, size=20, up=3.0):
    z = np.full((n, n), 100.0)
    z[30:30 + size, 30:30 + size] += up
    return z


def test_block_is_300_cubic_metres(spark):
    v = {r["reference"]: r for r in g.volumes(cells(spark, block()), K, "value", 0.25).collect()}
    assert v["plane"]["cut_m3"] == 300.0 and v["plane"]["fill_m3"] == 0.0 and v["plane"]["preferred"]


def test_half_of_the_block(spark):
    df = cells(spark, block()).withColumn("x", F.col("col_idx") + 0.5).withColumn("y", F.col("row_idx") + 0.5)
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (40, 0), (40, 80), (0, 80))])
    assert g.volumes(g.clip_to_ring(df, "x", "y", ring), K, "value", 0.25).first()["cut_m3"] == 150.0


def test_no_cell_is_refused(spark):
    df = cells(spark, np.full((3, 3), np.nan))
    out = g.with_refusals(df, g.volumes(df, K, "value", 0.25), K, "no valid cell", "cut_m3").first()
    assert out["status"] == "refused" and out["reason"] == "no valid cell"


@pytest.mark.parametrize("up,added,removed", [(2.0, 200.0, 0.0), (-2.0, 0.0, 200.0)])
def test_pile_epochs(spark, up, added, removed):
    d = g.difference(cells(spark, np.full((80, 80), 100.0)), cells(spark, block(up=up)), K)
    r = g.surface_change(d, K, 0.25).first()
    assert (r["added_volume_m3"], r["removed_volume_m3"], r["changed_area_m2"]) == (added, removed, 100.0)


def test_grid_mismatch_is_refused(spark):
    s = "survey_id string, epsg int, a double, b double, c double, d double, e double, f double, width int, height int"
    one = spark.createDataFrame([(x, 32617, 0.5, 0.0, 0.0, 0.0, -0.5, 0.0, 8, 8) for x in "abcde"], s)
    two = spark.createDataFrame([("a", 32617, 0.5, 0.0, 0.0, 0.0, -0.5, 0.0, 8, 8), ("b", 32618, 0.5, 0.0, 0.0, 0.0, -0.5, 0.0, 8, 8), ("c", 32617, 0.5, 0.0, 0.0, 0.0, -0.5, 0.0, 9, 8),
                                 ("d", 32617, 0.25, 0.0, 0.0, 0.0, -0.25, 0.0, 8, 8), ("e", 32617, 0.5, 0.0, 1.0, 0.0, -0.5, 0.0, 8, 8)], s)
    got = {r["survey_id"]: r["reason"] for r in g.aligned_grids(one, two, K).collect()}
    assert got == {"a": None, "b": "different coordinate systems", "c": "different raster shapes", "d": "different resolutions", "e": "different grid origins or orientations"}


def test_one_in_four_plane(spark):
    n = 30
    z = np.add.outer(np.zeros(n), np.arange(n) * 0.25 * 0.5)
    df = cells(spark, z).withColumn("x", F.col("col_idx") * 0.5).withColumn("y", -F.col("row_idx") * 0.5)
    s = g.slope_stats(g.gradients(df, K, "value", F.lit(n), F.lit(n), 0.5, 0.5), K, "value").first()
    assert s["mean_percent"] == pytest.approx(25.0) and s["planar"] and s["aspect_deg"] == pytest.approx(270.0) and s["cell_count"] == n * n


def test_few_cells_refused(spark):
    df = cells(spark, np.ones((3, 3))).withColumn("x", F.col("col_idx") * 1.0).withColumn("y", F.col("row_idx") * 1.0)
    assert g.slope_stats(g.gradients(df, K, "value", F.lit(3), F.lit(3), 1, 1), K, "value").first()["status"] == "refused"


def labels(mask, conn):
    out, steps = {}, [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if conn == 8 else [])
    for r, q in zip(*np.nonzero(mask)):
        if (r, q) in out:
            continue
        todo, out[(r, q)] = [(r, q)], (r, q)
        while todo:
            a, b = todo.pop()
            for dr, dc in steps:
                n = (a + dr, b + dc)
                if 0 <= n[0] < mask.shape[0] and 0 <= n[1] < mask.shape[1] and mask[n] and n not in out:
                    out[n] = (r, q)
                    todo.append(n)
    return {(int(r), int(q)): int(a) * 2**31 + int(b) for (r, q), (a, b) in out.items()}


@pytest.mark.parametrize("conn", [4, 8])
def test_regions_cross_tiles(spark, conn):
    mask = np.random.default_rng(3).random((40, 40)) < 0.55
    df = spark.createDataFrame([("s", int(r), int(q)) for r, q in zip(*np.nonzero(mask))], "survey_id string, row_idx int, col_idx int")
    got = {(r["row_idx"], r["col_idx"]): r["region"] for r in c.label_regions(df, K, conn, tile=8).collect()}
    assert got == labels(mask, conn)


@pytest.mark.parametrize("bound", [0, 2_000_000])
def test_grouped_components(spark, bound):
    rng = np.random.default_rng(5)
    e = [("ab"[int(k)], int(u), int(v)) for k, u, v in zip(rng.integers(0, 2, 80), rng.integers(0, 60, 80), rng.integers(0, 60, 80))]
    got = {(r["g"], r["node"]): r["component"] for r in c.grouped_components(spark.createDataFrame(e, "g string, u long, v long"), ["g"], bound).collect()}
    low = {(g, x): x for g, u, v in e if u != v for x in (u, v)}
    for _ in range(80):
        for g, u, v in e:
            if u != v:
                low[(g, u)] = low[(g, v)] = min(low[(g, u)], low[(g, v)])
    assert got == low


def test_long_chain_of_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "u long, v long")
    got = {r["node"]: r["component"] for r in c.connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000


def test_cluster_points_is_single_link(spark):
    rng = np.random.default_rng(4)
    pts = [("a", i, float(10 + x), float(50 + y)) for i, (x, y) in enumerate(rng.random((120, 2)) * 4e-4)]
    got = {r["id"]: r["cluster"] for r in c.cluster_points(spark.createDataFrame(pts, "g string, id long, lon double, lat double"), ["g"], "id", 3.0).collect()}
    from tests.test_matching import hav
    lab, moved = {i: i for _, i, _, _ in pts}, True
    while moved:
        moved = False
        for _, i, x, y in pts:
            for _, j, u, v in pts:
                if lab[i] != lab[j] and hav((x, y), (u, v)) <= 3.0:
                    lab[i] = lab[j] = min(lab[i], lab[j])
                    moved = True
    assert {frozenset(k for k in got if got[k] == v) for v in got.values()} == {frozenset(k for k in lab if lab[k] == v) for v in lab.values()}


def sweep(z):
    known = np.isfinite(z)
    pad = np.pad(known, 1)
    drain = known & ~(pad[:-2, 1:-1] & pad[2:, 1:-1] & pad[1:-1, :-2] & pad[1:-1, 2:])
    f = np.where(drain, z, np.where(known, np.inf, np.nan))
    while True:
        p = np.pad(f, 1, constant_values=np.nan)
        low = np.fmin.reduce([p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
        n = np.where(known & ~drain, np.minimum(f, np.maximum(z, low)), f)
        if np.array_equal(np.nan_to_num(n, posinf=1e9), np.nan_to_num(f, posinf=1e9)):
            return n
        f = n


@pytest.mark.parametrize("tile,side", [(16, 64), (4, 70), (128, 40)])
def test_fill_equals_sweep_across_tiles(spark, tile, side):
    """One to three contractions; a bowl over all tiles with noise, plateaus, islands of no data and a lake inside it."""
    rng = np.random.default_rng(tile)
    z = np.round(rng.random((side, side)) * 10, 1)
    z += np.hypot(*np.meshgrid(np.arange(side) - side / 2, np.arange(side) - side / 2)).round() if tile == 4 else 0
    z[rng.random(z.shape) < 0.004] = np.nan
    z[20:24, 20:24] = 1.0
    want = sweep(z)
    got = h.fill_sinks(cells(spark, z), K, "value", tile=tile).where("value IS NOT NULL").collect()
    assert all(r["filled"] == want[r["row_idx"], r["col_idx"]] for r in got) and len(got) == np.isfinite(z).sum()


def test_known_basin(spark):
    z = np.full((40, 40), 10.0)
    z[10:14, 10:14] = 9.0
    p = h.ponding_regions(cells(spark, z), K, "value", 0.25, 0.02, tile=16).collect()
    assert len(p) == 1 and p[0]["cell_count"] == 16 and p[0]["volume_m3"] == pytest.approx(4.0) and p[0]["max_depth_m"] == pytest.approx(1.0)
    z[10:14, 0:14] = 9.0          # open to the edge
    assert h.ponding_regions(cells(spark, z), K, "value", 0.25, 0.02, tile=16).count() == 0


def test_uncertainties_are_required(spark):
    df = cells(spark, block())
    with pytest.raises(ValueError):
        h.ponding_regions(df, K, "value", 0.25, None)
    with pytest.raises(ValueError):
        g.deformation_regions(df, K, 0.25, 0.01, None, 0.0)


def test_subsidence_and_uplift_are_separate(spark):
    z = np.full((40, 40), 10.0)
    later = z.copy()
    later[5:10, 5:10] -= 1.0
    later[5:10, 10:15] += 1.0
    d = g.difference(cells(spark, z), cells(spark, later), K)
    got = {r["direction"]: r for r in g.deformation_regions(d, K, 0.25, 0.03, 0.04, 0.02).collect()}
    assert set(got) == {"subsidence", "uplift"} and got["uplift"]["cell_count"] == 25 and got["subsidence"]["volume_change_m3"] == -6.25
    assert g.deformation_regions(d, K, 0.25, 1.0, 1.0, 0.0).count() == 0


@pytest.mark.parametrize("seed,lon,lat,spread", [(1, 10.0, 50.0, 3e-4), (2, 179.9999, -20.0, 2e-4), (3, -7.0, 60.9999, 2.5e-4), (4, 10.0, 50.0, 6e-5)])
def test_cell_links_equal_all_pairs(spark, seed, lon, lat, spread):
    """Refinement is forced: a pair of cells may compare two positions only."""
    from tests.test_matching import hav
    rng = np.random.default_rng(seed)
    turn = lambda x: x - 360 if x > 180 else x
    pts = [("a", i, turn(float(lon + x / math.cos(math.radians(lat)))), float(lat + y)) for i, (x, y) in enumerate(rng.random((90, 2)) * spread)]
    pts += [("a", 500 + i, *pts[i][2:]) for i in range(5)] + [("a", 900, None, None)]
    got = {r["id"]: r["cluster"] for r in c.cluster_points(spark.createDataFrame(pts, "g string, id long, lon double, lat double"), ["g"], "id", 2.5, leaf_pairs=2).collect()}
    home = {i: i for _, i, *_ in pts}
    def top(i):
        while home[i] != i:
            i = home[i]
        return i
    for _, i, x, y in pts[:-1]:
        for _, j, u, v in pts[:-1]:
            if hav((x, y), (u, v)) <= 2.5:
                a, b = sorted((top(i), top(j)))
                home[b] = a
    assert got == {i: top(i) for i in home}


def test_clusters_of_a_crowd_stay_linear(spark):
    """Two rows of 10^5 positions each, one radius and a millimetre apart: all within cells, none linked across."""
    near = spark.range(200_000).selectExpr("'a' AS g", "id", "IF(id % 2 = 0, 0.0D, 5.001D / 111194.92664455873) AS lon", "1e-12 * id AS lat")
    got = c.cluster_points(near, ["g"], "id", 5.0).groupBy("cluster").count().collect()
    assert {(r["cluster"], r["count"]) for r in got} == {(0, 100_000), (1, 100_000)}


def test_spill_levels_by_hand():
    """0 and 5 are seeds; 1-2-3 lie in a pit between them; 6 has no way out."""
    level, root = h.spill(7, np.array([0, 1, 2, 3, 4]), np.array([1, 2, 3, 4, 5]), np.array([9.0, 1.0, 2.0, 7.0, 3.0]), np.array([True, False, False, False, False, True, False]))
    assert level.tolist() == [-np.inf, 7.0, 7.0, 7.0, 3.0, -np.inf, -np.inf]
    assert root.tolist() == [0, 5, 5, 5, 5, 5, 6]


def test_a_long_channel_floods_in_few_rounds():
    """A winding path of all cells: rounds halve the components, whatever its length."""
    z = np.full((101, 101), 50.0)
    z[1::2, 1:-1] = 1.0
    z[2:-1:4, 99], z[4:-1:4, 1] = 1.0, 1.0
    level, source, passes = h.flood_tile(z, np.zeros(z.shape, bool), np.arange(z.size).reshape(z.shape))
    assert (level[1:-1, 1:-1] == 50.0).all() and len(passes[0])


@pytest.mark.parametrize("tile", [7, 256])
def test_stencils_across_tiles(spark, tile):
    """Rims, no data and absent cells; the plan has one exchange."""
    rng = np.random.default_rng(2)
    z = np.round(rng.random((23, 31)) * 20, 2)
    z[rng.random(z.shape) < 0.08] = np.nan
    df = cells(spark, z).where("NOT (row_idx = 5 AND col_idx > 9)")
    here = np.ones(z.shape, bool)
    here[5, 10:] = False
    v = np.where(here, z, np.nan)
    got = {(r["row_idx"], r["col_idx"]): r for r in g.gradients(df, K, "value", F.lit(31), F.lit(23), 0.5, 2.0, tile).collect()}
    pad = np.pad(v, 1, constant_values=np.nan)
    for r, c in zip(*np.nonzero(here)):
        west, east, north, south = pad[r + 1, c], pad[r + 1, c + 2], pad[r, c + 1], pad[r + 2, c + 1]
        x = (east - v[r, c]) / 0.5 if c == 0 else (v[r, c] - west) / 0.5 if c == 30 else (east - west) / 1.0
        y = (south - v[r, c]) / 2.0 if r == 0 else (v[r, c] - north) / 2.0 if r == 22 else (south - north) / 4.0
        for name, want in (("dz_east", x), ("dz_north", -y)):
            assert got[r, c][name] == (None if np.isnan(want) else pytest.approx(want))
    assert len(got) == here.sum()
    plan = g.gradients(df, K, "value", F.lit(31), F.lit(23), 0.5, 2.0, tile)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1

    filled = np.where(np.isnan(v), np.nanmax(v), v)
    for fn, empty in ((np.min, np.inf), (np.max, -np.inf)):
        for axis in (1, 0):
            p = np.pad(np.where(here, filled, empty), [(2, 2) if a == axis else (0, 0) for a in (0, 1)], constant_values=empty)
            filled = fn(np.lib.stride_tricks.sliding_window_view(p, 5, axis), axis=2)
    opened = {(r["row_idx"], r["col_idx"]): r["ground"] for r in g.grid_opening(df, K, "value", 5, tile).collect()}
    assert opened == {(r, c): None if np.isnan(v[r, c]) else filled[r, c] for r, c in zip(*np.nonzero(here))}


@pytest.mark.parametrize("half", [0, 1, 3, 20])
def test_sliding_extremes(half):
    z = np.random.default_rng(half).random((4, 17))
    for take, fn, empty in ((np.minimum, np.min, np.inf), (np.maximum, np.max, -np.inf)):
        p = np.pad(z, [(0, 0), (half, half)], constant_values=empty)
        assert np.array_equal(g.sliding(z, half, take, empty), fn(np.lib.stride_tricks.sliding_window_view(p, 2 * half + 1, 1), axis=2))
