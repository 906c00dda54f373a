"""Connected components of edge tables and of grid masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fieldspark.functions.geo import EARTH_RADIUS_MEAN_M, haversine_m
from fieldspark.operators.matching import by_bucket, fine_cell, near_pairs, split_by_size
from fieldspark.session import cut, join_salted, tidy

TILE = 256


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 200) -> DataFrame:
    """``node, component`` (smallest node of the component) for an edge table with columns ``u, v``.

    Alternating star contraction: every node points its larger neighbours, then all its
    neighbours, at the smallest one it sees. A hub's edges meet its minimum through a partial
    aggregate and a join, so no neighbour list is ever built.
    """
    current = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        # larger neighbours move to the smallest neighbour
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        star = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .where("u <> v").distinct())
        # smaller neighbours and the node itself move to the smallest of them
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        nxt = (star.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
               .unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
               .where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        current = cut(nxt)
        # the edge set is unchanged when every count and checksum is
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        tidy(edges.sparkSession)
        if before == mark:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    labels = current.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = labels.unionByName(roots.join(labels, "node", "left_anti"))
    if nodes is not None:
        out = nodes.select("node").distinct().join(out, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return out


def grouped_components(edges: DataFrame, keys: list[str], group_edges: int = 2_000_000) -> DataFrame:
    """``keys, node, component`` of edges ``keys, u, v`` with long ids that are unique per key.

    Keys with a bounded number of edges are settled where they land after one shuffle; larger ones
    by star contraction.
    """
    edges = cut(edges.select(*keys, F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v").distinct())
    sizes = cut(edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    seen = sizes.agg(F.count_if(F.col("_n") > group_edges).alias("big"), F.sum("_n").alias("n")).first()
    buckets = max(edges.sparkSession.sparkContext.defaultParallelism, -(-(seen["n"] or 0) // (group_edges // 2 or 1)))
    crowded = sizes.where(F.col("_n") > group_edges).select(*keys) if seen["big"] else None
    calm = edges.join(crowded, keys, "left_anti") if crowded is not None else edges
    schema = edges.withColumnRenamed("u", "node").withColumnRenamed("v", "component").schema

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy() if keys else np.zeros(len(pdf), dtype=np.int64)
        both = np.concatenate([np.stack([group, pdf["u"]], 1), np.stack([group, pdf["v"]], 1)])
        nodes, inverse = np.unique(both, axis=0, return_inverse=True)
        inverse = inverse.ravel()
        u, v = inverse[: len(pdf)], inverse[len(pdf):]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[u], root[v])
            new = root.copy()
            np.minimum.at(new, root[u], low)
            np.minimum.at(new, root[v], low)
            while not np.array_equal(new, new[new]):
                new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        first = pdf.iloc[np.unique(group, return_index=True)[1]]
        out = first[keys].iloc[nodes[:, 0]].reset_index(drop=True)
        return out.assign(node=nodes[:, 1], component=nodes[root, 1])

    found = (calm.withColumn("_bucket", F.pmod(F.xxhash64(*keys, F.lit(0)), F.lit(buckets))).groupBy("_bucket").applyInPandas(settle, schema))
    if crowded is None:
        return found
    node = lambda c: F.struct(*keys, F.col(c).alias("id"))
    big = connected_components(edges.join(crowded, keys, "left_semi").select(node("u").alias("u"), node("v").alias("v")))
    big = big.select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.id").alias("node"), F.col("component.id").alias("component"))
    return found.unionByName(big)


def _boxes(spots: DataFrame, by: list[str]) -> DataFrame:
    """One row per cell: number of positions, middle and reach of their box, and the four positions that touch its sides."""
    at = F.struct("lon", "lat")
    out = spots.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min_by(at, "lon").alias("w0"), F.max_by(at, "lon").alias("w1"), F.min_by(at, "lat").alias("w2"), F.max_by(at, "lat").alias("w3"))
    west, east, south, north = F.col("w0.lon"), F.col("w1.lon"), F.col("w2.lat"), F.col("w3.lat")
    out = out.withColumn("mx", (west + east) / 2).withColumn("my", (south + north) / 2)
    corners = [haversine_m("my", "mx", y, x) for y in (south, north) for x in (west, east)]
    # a little more than the farthest corner, for the sides of a box are curved
    return out.select(*by, F.struct("n", "mx", "my", (F.greatest(*corners) * 1.01 + 1e-6).alias("reach"), F.array("w0", "w1", "w2", "w3").alias("touch")).alias("box"))


def cell_links(spots: DataFrame, keys: list[str], radius_m: float, earth: float, leaf_pairs: int = 1024) -> DataFrame:
    """``keys, u, v``: heads of cells that hold two positions within the radius of each other.

    ``spots`` holds one row per position with its cell's ``head``. A pair of cells is linked as soon as one pair of
    positions is found and dropped when its boxes are too far apart; only what remains is looked into, position by position
    where that takes at most ``leaf_pairs`` comparisons, else through the 16 cells of the next level on each side.
    """
    far = lambda a, b: haversine_m(f"{a}.my", f"{a}.mx", f"{b}.my", f"{b}.mx", earth)
    close = F.exists("a.touch", lambda p: F.exists("b.touch", lambda q: haversine_m(p["lat"], p["lon"], q["lat"], q["lon"], earth) <= radius_m))
    pair = [*keys, "u", "v"]
    leaves = spots.withColumn("_k", fine_cell(radius_m, 0))
    boxes = cut(_boxes(leaves, [*keys, "head", "_k"]))
    side = lambda u, k, box: boxes.select(*keys, F.col("head").alias(u), F.col("_k").alias(k), F.col("box").alias(box), F.col("box.mx").alias(f"_{u}x"), F.col("box.my").alias(f"_{u}y"))
    # middles of boxes that hold a close pair are within twice the radius
    open_pairs = (near_pairs(side("u", "ka", "a"), side("v", "kb", "b"), keys, 2.05 * radius_m, lpos=("_ux", "_uy"), rpos=("_vx", "_vy"), earth=earth)
                  .where("u < v").select(*pair, "ka", "kb", "a", "b"))
    found, level = [], 0
    while True:
        tested = cut(open_pairs.where(far("a", "b") <= F.lit(radius_m) + F.col("a.reach") + F.col("b.reach")).withColumn("hit", close))
        hits = tested.where("hit").select(*pair).distinct()
        rest = tested.where("NOT hit").join(hits, pair, "left_anti")
        few = F.col("a.n") * F.col("b.n") <= leaf_pairs
        at = lambda k, n: leaves.select(*keys, F.col("_k").alias(k), F.col("lon").alias(f"x{n}"), F.col("lat").alias(f"y{n}"))
        near = (rest.where(few).select(*pair, "ka", "kb").join(at("ka", 1), [*keys, "ka"]).join(at("kb", 2), [*keys, "kb"])
                .where(haversine_m("y1", "x1", "y2", "x2", earth) <= radius_m).select(*pair).distinct())
        found.append(cut(hits.unionByName(near)))
        wide = rest.where(~few).join(found[-1], pair, "left_anti").select(*pair, "ka", "kb")
        if wide.isEmpty():
            break
        level += 1
        finer = leaves.withColumnRenamed("_k", "_up").withColumn("_k", fine_cell(radius_m, level))
        parts = _boxes(finer, [*keys, "_up", "_k"])
        part = lambda up, k, box: parts.select(*keys, F.col("_up").alias(up), F.col("_k").alias(k), F.col("box").alias(box))
        open_pairs = (wide.withColumnRenamed("ka", "ua").withColumnRenamed("kb", "ub").join(part("ua", "ka", "a"), [*keys, "ua"])
                      .join(part("ub", "kb", "b"), [*keys, "ub"]).select(*pair, "ka", "kb", "a", "b"))
        leaves = finer.drop("_up")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def cluster_points(points: DataFrame, keys: list[str], point_id: str, radius_m: float,
                   earth: float = EARTH_RADIUS_MEAN_M, leaf_pairs: int = 1024, group_rows: int = 700) -> DataFrame:
    """Single-link clusters of lon/lat points: adds ``cluster`` (smallest id of the cluster).

    Groups of at most ``group_rows`` points are settled where they land after one shuffle; larger ones by cells.
    Points of one cell are within the radius of each other, so the clusters are the components of a graph of cells, each
    standing for its smallest id; see ``cell_links``. A point without a position is a cluster of its own.
    """
    calm, crowded, buckets = split_by_size(points, keys, group_rows)
    out = by_bucket(calm, keys, buckets, [point_id], _lowest, radius_m, earth, "cluster")
    return out if crowded is None else out.unionByName(_cluster_cells(crowded, keys, point_id, radius_m, earth, leaf_pairs).select(*out.columns))


def _lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row of the component of each of ``n`` rows."""
    root = np.arange(n)
    while True:
        low, new = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _cluster_cells(points: DataFrame, keys: list[str], point_id: str, radius_m: float, earth: float, leaf_pairs: int) -> DataFrame:
    """The same clusters from a graph of cells."""
    placed = points.select(*keys, F.col(point_id).alias("_id"), "lon", "lat").where("lon IS NOT NULL AND lat IS NOT NULL").withColumn("_c", fine_cell(radius_m, 0))
    heads = cut(placed.groupBy(*keys, "_c").agg(F.min("_id").alias("head")))
    spots = cut(join_salted(placed.select(*keys, "_c", "lon", "lat").distinct(), heads, [*keys, "_c"], ["lon", "lat"], 4, "inner").drop("_c"))
    found = grouped_components(cell_links(spots, keys, radius_m, earth, leaf_pairs), keys).select(*keys, F.col("node").alias("head"), "component")
    homes = heads.join(found, [*keys, "head"], "left").select(*keys, "_c", F.coalesce("component", "head").alias("cluster"))
    return (join_salted(points.withColumn("_c", fine_cell(radius_m, 0)), homes, [*keys, "_c"], [point_id])
            .withColumn("cluster", F.coalesce("cluster", point_id)).drop("_c"))


def label_mask(mask: np.ndarray, connectivity: int) -> np.ndarray:
    """Component labels of a small boolean array (-1 outside), as smallest flat index."""
    far = mask.size
    lab = np.where(mask, np.arange(mask.size).reshape(mask.shape), far)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    while True:
        new = lab.copy()
        for dr, dc in steps:
            hi, lo = (slice(dr, None), slice(0, mask.shape[0] - dr))
            right, left = (slice(dc, None), slice(0, mask.shape[1] - dc)) if dc >= 0 else (slice(0, dc), slice(-dc, None))
            both = mask[hi, right] & mask[lo, left]
            low = np.where(both, np.minimum(new[hi, right], new[lo, left]), far)
            new[hi, right] = np.minimum(new[hi, right], low)
            new[lo, left] = np.minimum(new[lo, left], low)
        # pull whole labels down, then shorten the chains
        flat = np.append(np.arange(mask.size), far)
        np.minimum.at(flat, lab[mask], new[mask])
        while True:
            short = flat[flat]
            if np.array_equal(short, flat):
                break
            flat = short
        new[mask] = flat[new[mask]]
        if np.array_equal(new, lab):
            return np.where(mask, lab, -1)
        lab = new


def label_regions(cells: DataFrame, keys: list[str], connectivity: int, *, row: str = "row_idx", col: str = "col_idx",
                  tile: int = TILE) -> DataFrame:
    """Add ``region`` (smallest row-major cell of the region, as ``row * 2^31 + col``) to masked cells.

    A tile is labelled in one task (at most tile*tile cells); tile labels that touch across a
    border become edges of a small graph, whose components stitch the tiles.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    gkeys = keys + ["_tr", "_tc"]
    at = cells.select(*keys, F.col(row).cast("long").alias("_r"), F.col(col).cast("long").alias("_c")).distinct()
    at = at.withColumn("_tr", F.floor(F.col("_r") / tile)).withColumn("_tc", F.floor(F.col("_c") / tile))
    schema = at.withColumn("_lab", F.lit(0).cast("long")).schema

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["_tr"].iloc[0]) * tile, int(pdf["_tc"].iloc[0]) * tile
        r, c = pdf["_r"].to_numpy() - r0, pdf["_c"].to_numpy() - c0
        mask = np.zeros((tile, tile), dtype=bool)
        mask[r, c] = True
        lab = label_mask(mask, connectivity)[r, c]
        return pdf.assign(_lab=(lab // tile + r0).astype("int64") * 2**31 + lab % tile + c0)

    local = cut(at.groupBy(*gkeys).applyInPandas(one, schema))
    # contacts across tile borders: only cells on a border take part
    on_edge = F.pmod("_r", F.lit(tile)).isin(0, tile - 1) | F.pmod("_c", F.lit(tile)).isin(0, tile - 1)
    rim = local.where(on_edge)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    there = rim.withColumn("_d", F.explode(F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in steps])))
    there = there.select(*keys, (F.col("_r") + F.col("_d.r")).alias("_r"), (F.col("_c") + F.col("_d.c")).alias("_c"),
                         F.col("_lab").alias("_other"), F.col("_tr").alias("_otr"), F.col("_tc").alias("_otc"))
    touch = (rim.join(there, keys + ["_r", "_c"])
             .where((F.col("_tr") != F.col("_otr")) | (F.col("_tc") != F.col("_otc"))))
    found = grouped_components(touch.select(*keys, F.col("_lab").alias("u"), F.col("_other").alias("v")), keys)
    found = found.select(*keys, F.col("node").alias("_lab"), F.col("component").alias("region"))
    out = local.join(found, keys + ["_lab"], "left").withColumn("region", F.coalesce("region", "_lab"))
    out = out.select(*keys, F.col("_r").alias(row), F.col("_c").alias(col), "region")
    return cells.join(out, keys + [row, col])


def dilate(cells: DataFrame, keys: list[str], radius: int, *, row: str = "row_idx", col: str = "col_idx", tile: int = TILE) -> DataFrame:
    """Cells within ``radius`` cross-shaped growth steps of a masked cell.

    A cell is sent to its tile and to the tiles whose margin it falls in; each task grows one
    ``tile + 2 radius`` square.
    """
    if radius <= 0:
        return cells.select(*keys, row, col).distinct()
    r, c = F.col(row).cast("long"), F.col(col).cast("long")
    reach = lambda v: F.sequence(F.floor((v - radius) / tile), F.floor((v + radius) / tile))
    sent = (cells.select(*keys, r.alias("_r"), c.alias("_c")).distinct()
            .withColumn("_tr", F.explode(reach(F.col("_r")))).withColumn("_tc", F.explode(reach(F.col("_c")))))
    schema = sent.schema

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[[0]]
        r0, c0 = int(first["_tr"].iloc[0]) * tile - radius, int(first["_tc"].iloc[0]) * tile - radius
        m = np.zeros((tile + 2 * radius, tile + 2 * radius), dtype=bool)
        m[pdf["_r"].to_numpy() - r0, pdf["_c"].to_numpy() - c0] = True
        for _ in range(radius):
            n = m.copy()
            n[1:] |= m[:-1]
            n[:-1] |= m[1:]
            n[:, 1:] |= m[:, :-1]
            n[:, :-1] |= m[:, 1:]
            m = n
        rr, cc = np.nonzero(m[radius:radius + tile, radius:radius + tile])
        out = pd.concat([first] * len(rr), ignore_index=True) if len(rr) else pdf.iloc[0:0]
        return out.assign(_r=rr + r0 + radius, _c=cc + c0 + radius) if len(rr) else out

    grown = sent.groupBy(*keys, "_tr", "_tc").applyInPandas(grow, schema)
    return grown.select(*keys, F.col("_r").alias(row), F.col("_c").alias(col))


def region_boundary(regions: DataFrame, keys: list[str], *, row: str = "row_idx", col: str = "col_idx") -> DataFrame:
    """Cell sides that belong to exactly one cell of their region: the outline, as unit edges."""
    r, c = F.col(row), F.col(col)
    sides = F.array(F.struct(r.alias("r"), c.alias("c"), F.lit("h").alias("o")), F.struct((r + 1).alias("r"), c.alias("c"), F.lit("h").alias("o")),
                    F.struct(r.alias("r"), c.alias("c"), F.lit("v").alias("o")), F.struct(r.alias("r"), (c + 1).alias("c"), F.lit("v").alias("o")))
    return (regions.withColumn("_e", F.explode(sides)).groupBy(*keys, "region", "_e").agg(F.count(F.lit(1)).alias("_n"))
            .where("_n = 1").select(*keys, "region", F.col("_e.r").alias("edge_row"), F.col("_e.c").alias("edge_col"), F.col("_e.o").alias("orientation")))
