"""Sinks and ponding on tiled surfaces.

Every tile floods itself from its rim in one bounded task. Rim cells of neighbouring tiles then form a graph that is contracted
by squares of four by four tiles, sixteen by sixteen and so on, each again in one task that keeps only what crosses its border;
the levels found at the top go back down by joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fieldspark.operators.components import TILE, label_regions
from fieldspark.operators.grid import MIN_REGION_CELLS, NOISE_MULTIPLE, region_stats
from fieldspark.session import cut

OUTLET = -1
SPAN = 4  # squares of a side that are contracted together


def spill(nodes: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node the lowest level at which water reaches a seed over links ``u, v`` of level ``w``, and that seed.

    Whole components move at once: each without a seed goes over its lowest link, whose level all its nodes must reach, and
    at least half of them are gone after a round. Seeds have level -inf; nodes that no link leads to a seed keep a root that
    is none.
    """
    order = np.lexsort((v, u, w))
    u, v, w = u[order], v[order], w[order]
    level, root = np.full(nodes, -np.inf), np.arange(nodes)
    while True:
        a, b = root[u], root[v]
        live = (a != b) & ~(seed[a] & seed[b])
        if not live.any():
            return level, root
        u, v, w, a, b = u[live], v[live], w[live], a[live], b[live]
        # links lie in order, so the first of a component is its lowest
        ends = np.stack([a, b], 1).ravel()
        who, first = np.unique(ends, return_index=True)
        free = ~seed[who]
        who, link = who[free], first[free] // 2
        to, step = np.arange(nodes), np.full(nodes, -np.inf)
        to[who] = a[link] + b[link] - who
        step[who] = w[link]
        level = np.maximum(level, step[root])
        both = who[to[to[who]] == who]
        to[both[both < to[both]]] = both[both < to[both]]
        while not np.array_equal(to, to[to]):
            to = to[to]
        root = to[root]


def lowest_passes(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowest level between each two different ends."""
    apart = a != b
    a, b, w = np.minimum(a, b)[apart], np.maximum(a, b)[apart], w[apart]
    order = np.lexsort((w, b, a))
    a, b, w = a[order], b[order], w[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[first], b[first], w[first]


def flood_tile(z: np.ndarray, outlet: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Level of each cell of a tile when water may leave at its outlets and rim cells, the source that it drains to (OUTLET or
    the number of a rim cell), and the lowest passes between touching sources."""
    rim = np.zeros(z.shape, dtype=bool)
    rim[[0, -1], :] = rim[:, [0, -1]] = True
    known = np.isfinite(z)
    at = np.arange(z.size).reshape(z.shape)
    ends = []
    for near, far in ((np.s_[:, :-1], np.s_[:, 1:]), (np.s_[:-1, :], np.s_[1:, :])):
        both = known[near] & known[far]
        ends.append((at[near][both], at[far][both]))
    u, v = (np.concatenate(x) for x in zip(*ends))
    flat = z.ravel()
    seed = (known & (outlet | rim)).ravel()
    level, root = spill(z.size, u, v, np.maximum(flat[u], flat[v]), seed)
    level = np.where(seed, flat, np.where(seed[root], level, np.inf))
    source = np.where(outlet.ravel()[root], OUTLET, node.ravel()[root])
    return level.reshape(z.shape), source.reshape(z.shape), lowest_passes(source[u], source[v], np.maximum(level[u], level[v]))


def fill_sinks(cells: DataFrame, keys: list[str], value: str, *, tile: int = TILE) -> DataFrame:
    """Cells with ``filled``: the lowest level at which water leaves over the edge or into no data.

    Only tiles and their one-cell surroundings are held in a task.
    """
    at = keys + ["_r", "_c"]
    known = cells.where(F.col(value).isNotNull()).select(*keys, F.col("row_idx").cast("long").alias("_r"), F.col("col_idx").cast("long").alias("_c"), F.col(value).cast("double").alias("_z"))
    # a cell is an outlet when one of its four neighbours is absent: raster edge and no data alike
    nb = known.withColumn("_d", F.explode(F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))])))
    around = nb.select(*keys, (F.col("_r") + F.col("_d.r")).alias("_r"), (F.col("_c") + F.col("_d.c")).alias("_c")).groupBy(*at).agg(F.count(F.lit(1)).alias("_nb"))
    marked = known.join(around, at, "left").withColumn("_out", F.coalesce(F.col("_nb"), F.lit(0)) < 4).drop("_nb")
    marked = marked.withColumn("_tr", F.floor(F.col("_r") / tile)).withColumn("_tc", F.floor(F.col("_c") / tile))
    gkeys = keys + ["_tr", "_tc"]
    types = {f.name: f.dataType.simpleString() for f in marked.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in gkeys) + ", kind string, _r long, _c long, u long, v long, level double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["_tr"].iloc[0]) * tile, int(pdf["_tc"].iloc[0]) * tile
        rr, cc = pdf["_r"].to_numpy() - r0, pdf["_c"].to_numpy() - c0
        z, out = np.full((tile, tile), np.nan), np.zeros((tile, tile), dtype=bool)
        z[rr, cc], out[rr, cc] = pdf["_z"].to_numpy(), pdf["_out"].to_numpy()
        g_r, g_c = np.meshgrid(np.arange(tile) + r0, np.arange(tile) + c0, indexing="ij")
        level, source, passes = flood_tile(z, out, g_r.astype("int64") * 2**31 + g_c)
        cell = pd.DataFrame({"kind": "cell", "_r": pdf["_r"].to_numpy(), "_c": pdf["_c"].to_numpy(), "u": source[rr, cc], "v": 0, "level": level[rr, cc]})
        edge = pd.DataFrame({"kind": "pass", "_r": 0, "_c": 0, "u": passes[0], "v": passes[1], "level": passes[2]})
        both = pd.concat([cell, edge], ignore_index=True) if len(edge) else cell
        for k in gkeys:
            both[k] = pdf[k].iloc[0]
        return both[gkeys + ["kind", "_r", "_c", "u", "v", "level"]]

    flooded = cut(marked.groupBy(*gkeys).applyInPandas(one, schema))
    cell = flooded.where("kind = 'cell'")
    inner = flooded.where("kind = 'pass'").select(*keys, "u", "v", "level")
    # neighbouring rim cells of two tiles pass water at the higher of their elevations
    rim = marked.where(F.pmod("_r", F.lit(tile)).isin(0, tile - 1) | F.pmod("_c", F.lit(tile)).isin(0, tile - 1))
    rim = rim.select(*at, "_z", F.when(F.col("_out"), F.lit(OUTLET).cast("long")).otherwise(F.col("_r") * 2**31 + F.col("_c")).alias("n"), "_tr", "_tc")
    step = rim.withColumn("_d", F.explode(F.array(F.struct(F.lit(0).alias("r"), F.lit(1).alias("c")), F.struct(F.lit(1).alias("r"), F.lit(0).alias("c")))))
    step = step.select(*keys, (F.col("_r") + F.col("_d.r")).alias("_r"), (F.col("_c") + F.col("_d.c")).alias("_c"), F.col("_z").alias("_z2"), F.col("n").alias("n2"), F.col("_tr").alias("_tr2"), F.col("_tc").alias("_tc2"))
    across = (rim.join(step, at).where((F.col("_tr") != F.col("_tr2")) | (F.col("_tc") != F.col("_tc2"))).where("n <> n2")
              .select(*keys, F.least("n", "n2").alias("u"), F.greatest("n", "n2").alias("v"), F.greatest("_z", "_z2").alias("level")))
    water = drain(inner.unionByName(across), keys, tile)
    out = cell.join(water.withColumnRenamed("n", "u"), keys + ["u"], "left").select(
        *keys, F.col("_r").alias("_fr"), F.col("_c").alias("_fc"), F.greatest(F.col("level"), F.coalesce(F.col("w"), F.col("level"))).alias("filled"))
    key = lambda a, b: [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.row_idx") == F.col("b._fr"), F.col("a.col_idx") == F.col("b._fc")]
    return cells.alias("a").join(out.alias("b"), key("a", "b"), "left").select("a.*", "b.filled")


def contraction(keys: list[str], size: int | None):
    """Function of the links within one square: the nodes that it settles and the passes between those it keeps."""
    def contract(pdf: pd.DataFrame) -> pd.DataFrame:
        n, ends = np.unique(np.concatenate([[OUTLET], pdf["u"], pdf["v"]]), return_inverse=True)
        u, v = ends[1:].reshape(2, -1)
        kept = n == OUTLET
        if size is not None:
            r, c = (n >> 31) % size, (n & (2**31 - 1)) % size
            kept |= (r == 0) | (r == size - 1) | (c == 0) | (c == size - 1)
        w = pdf["level"].to_numpy()
        level, root = spill(len(n), u, v, w, kept)
        gone = ~kept & kept[root]
        a, b, h = lowest_passes(n[root[u]], n[root[v]], np.maximum(w, np.maximum(level[u], level[v])))
        out = pd.concat([pd.DataFrame({"kind": "node", "u": n[gone], "v": n[root[gone]], "level": level[gone]}), pd.DataFrame({"kind": "pass", "u": a, "v": b, "level": h})], ignore_index=True)
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "kind", "u", "v", "level"]]

    return contract


def drain(links: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """``keys, n, w``: lowest level at which each rim cell of ``links`` (``keys, u, v, level``) drains to the outlet.

    A task holds the links within one square of the current size and settles all nodes but those on its border; what it hands
    on are the passes between these. The last square of a survey holds the border nodes of its sixteen parts only.
    """
    links = cut(links)
    place = lambda n, size: (F.floor(F.shiftright(n, 31) / size), F.floor(F.col(n).bitwiseAND(2**31 - 1) / size))
    far = links.agg(F.max(F.greatest(*[F.greatest(F.shiftright(n, 31), F.col(n).bitwiseAND(2**31 - 1) * (F.col(n) >= 0).cast("int")) for n in "uv"]))).first()[0] or 0
    sizes, size = [], tile * SPAN
    while size <= far:
        sizes.append(size)
        size *= SPAN
    types = {f.name: f.dataType.simpleString() for f in links.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", kind string, u long, v long, level double"
    settled = []
    for size in [*sizes, None]:
        inside, rest = links.withColumn("_sr", F.lit(0)).withColumn("_sc", F.lit(0)), None
        if size is not None:
            (ur, uc), (vr, vc) = place("u", size), place("v", size)
            home = F.when(F.col("u") == OUTLET, F.struct(vr.alias("r"), vc.alias("c"))).otherwise(F.struct(ur.alias("r"), uc.alias("c")))
            same = (F.col("u") == OUTLET) | (F.col("v") == OUTLET) | ((ur == vr) & (uc == vc))
            inside, rest = links.where(same).withColumn("_h", home).withColumn("_sr", F.col("_h.r")).withColumn("_sc", F.col("_h.c")).drop("_h"), links.where(~same)
        inside = inside.select(*keys, "_sr", "_sc", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "level")

        done = cut(inside.groupBy(*keys, "_sr", "_sc").applyInPandas(contraction(keys, size), schema))
        settled.append(done.where("kind = 'node'").select(*keys, F.col("u").alias("n"), F.col("v").alias("to"), "level"))
        links = done.where("kind = 'pass'").select(*keys, "u", "v", "level")
        links = links if rest is None else links.unionByName(rest.select(*keys, "u", "v", "level"))
    water = settled[-1].select(*keys, "n", F.col("level").alias("w"))
    for lower in reversed(settled[:-1]):
        step = lower.join(water.withColumnRenamed("n", "to"), [*keys, "to"], "left").where((F.col("to") == OUTLET) | F.col("w").isNotNull())
        water = cut(water.unionByName(step.select(*keys, "n", F.greatest("level", "w").alias("w"))))
    return water


def ponding_regions(cells: DataFrame, keys: list[str], value: str, cell_area: Column | float, vertical_accuracy_m: float | None, *, min_cells: int = MIN_REGION_CELLS,
                    tile: int = TILE) -> DataFrame:
    """Closed depressions deeper than twice the vertical accuracy, which has no default."""
    if vertical_accuracy_m is None or vertical_accuracy_m <= 0:
        raise ValueError("ponding needs the surface's vertical accuracy as a positive distance")
    wet = fill_sinks(cells, keys, value, tile=tile).withColumn("depth", F.col("filled") - F.col(value)).where(F.col("depth") > NOISE_MULTIPLE * vertical_accuracy_m)
    lab = label_regions(wet, keys, 4)
    out = region_stats(lab, keys, "depth", cell_area).where(F.col("cell_count") >= min_cells)
    return out.select(*keys, "region", "cell_count", "area_m2", F.col("max_value").alias("max_depth_m"), F.col("mean_value").alias("mean_depth_m"), "volume_m3", "centroid_row", "centroid_col")
