"""Point clouds, meshes and reconstruction alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fieldspark.operators.ordered import block, join_side, quantiles_of, with_row_number
from fieldspark.session import sorted_side

RANSAC_SEED, RANSAC_ROUNDS, RANSAC_TOLERANCE_M = 20260814, 512, 3.0


def voxel_downsample(points: DataFrame, keys: list[str], voxel: float, order: str, max_points: int | None = None) -> DataFrame:
    """First point (by ``order``) of each voxel, then an even stride down to about ``max_points`` (a sampling operator)."""
    v = max(1e-4, voxel)
    cell = [F.floor(F.col(a) / F.lit(v)).cast("long").alias(f"_v{a}") for a in "xyz"]
    cols = [c for c in points.columns if c not in keys]
    out = points.groupBy(*keys, *cell).agg(F.min_by(F.struct(*cols), order).alias("_p")).select(*keys, *[F.col(f"_p.{c}").alias(c) for c in cols])
    if max_points is None:
        return out
    n = out.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / max_points)).alias("_step"), (F.count(F.lit(1)) > max_points).alias("_over"))
    rn = with_row_number(out, keys, [order], [block(order, 1e6)], "_rn")
    return rn.join(n, keys).where(~F.col("_over") | ((F.col("_rn") - 1) % F.col("_step") == 0)).drop("_rn", "_step", "_over")


def rasterize_points(points: DataFrame, keys: list[str], pixel: float, colours: list[str] = ()) -> DataFrame:
    """Points binned to cells: highest and lowest z, mean colour; gross outliers set aside first.

    Cells are rows, so a raster may have any extent at the pixel asked for. Fewer than 16 points give nothing.
    """
    q = quantiles_of(points, keys, {f"_{end}{axis}": (axis, p) for axis in "xyz" for end, p in (("lo", 0.005), ("hi", 0.995))})
    limits = []
    for axis in "xyz":
        span = F.greatest(F.col(f"_hi{axis}") - F.col(f"_lo{axis}"), F.lit(1e-6)) * 0.25
        limits += [(F.col(f"_lo{axis}") - span).alias(f"_l{axis}"), (F.col(f"_hi{axis}") + span).alias(f"_h{axis}")]
    trimmed = join_side(points, q.select(*keys, *limits), keys)
    inside = F.lit(True)
    for axis in "xyz":
        inside = inside & F.col(axis).between(F.col(f"_l{axis}"), F.col(f"_h{axis}"))
    trimmed = trimmed.withColumn("_in", inside)
    n = trimmed.groupBy(*keys).agg(F.count_if("_in").alias("_kept"), F.count(F.lit(1)).alias("_all"))
    use = join_side(trimmed, n, keys).where((F.col("_all") >= 16) & (F.col("_in") | (F.col("_kept") < 16)))
    box = use.groupBy(*keys).agg(F.min("x").alias("west"), F.max("y").alias("north"))
    box = box.withColumn("pixel", F.lit(float(pixel)))
    placed = join_side(use.select(*keys, "x", "y", "z", *colours), box.select(*keys, "west", "north", "pixel"), keys)
    return (placed.groupBy(*keys, F.floor((F.col("north") - F.col("y")) / F.col("pixel")).cast("int").alias("row_idx"), F.floor((F.col("x") - F.col("west")) / F.col("pixel")).cast("int").alias("col_idx"))
            .agg(F.max("z").alias("dsm"), F.min("z").alias("z_min"), F.count(F.lit(1)).alias("points"), *[F.avg(c).alias(c) for c in colours]))


def clip_by_plane(points: DataFrame, origin: tuple, normal: tuple) -> DataFrame:
    """Points on or in front of a plane."""
    return points.where(in_front(origin, normal))


def in_front(origin: tuple, normal: tuple) -> Column:
    dot = sum(((F.col(a) - float(o)) * float(n) for a, o, n in list(zip("xyz", origin, normal))[1:]), (F.col("x") - float(origin[0])) * float(normal[0]))
    return dot >= 0


def plane_from_orientation(dip_deg: float, azimuth_deg: float) -> tuple[float, float, float]:
    """Unit normal of a plane by dip from vertical and compass direction."""
    import math
    d, a = math.radians(dip_deg), math.radians(azimuth_deg)
    return math.sin(d) * math.sin(a), math.sin(d) * math.cos(a), math.cos(d)


def clip_points(points: DataFrame, clips: list[Column]) -> DataFrame:
    """Points that pass every visible clip."""
    keep = F.lit(True)
    for c in clips:
        keep = keep & c
    return points.where(keep)


def clip_mesh(faces: DataFrame, kept: DataFrame, keys: list[str], vid: str = "vid") -> DataFrame:
    """Faces whose three vertices survive."""
    out = faces
    for corner in ("a", "b", "c"):
        out = out.join(kept.select(*keys, F.col(vid).alias(corner)), keys + [corner], "left_semi")
    return out


def mesh_closure_volume(vertices: DataFrame, faces: DataFrame, keys: list[str]) -> DataFrame:
    """Volume and surface of a closed mesh; open when some undirected edge is not used exactly twice."""
    e = faces.select(*keys, F.explode(F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])).alias("_e"))
    open_edges = e.groupBy(*keys, "_e").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.count_if(F.col("_n") != 2).alias("open_edges"))
    out = faces
    for corner in ("a", "b", "c"):
        v = vertices.select(*keys, F.col("vid").alias(corner), *[F.col(x).alias(f"{corner}{x}") for x in "xyz"])
        out = out.join(sorted_side(v), keys + [corner])
    c = F.col
    cross = lambda ux, uy, uz, vx, vy, vz: (uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx)
    bx, by, bz = cross(c("bx"), c("by"), c("bz"), c("cx"), c("cy"), c("cz"))
    nx, ny, nz = cross(c("bx") - c("ax"), c("by") - c("ay"), c("bz") - c("az"), c("cx") - c("ax"), c("cy") - c("ay"), c("cz") - c("az"))
    size = out.groupBy(*keys).agg(F.abs(F.sum((c("ax") * bx + c("ay") * by + c("az") * bz) / 6.0)).alias("_vol"), F.sum(F.sqrt(nx * nx + ny * ny + nz * nz) / 2).alias("area_m2"), F.count(F.lit(1)).alias("faces"))
    j = open_edges.join(sorted_side(size), keys)
    return (j.withColumn("volume_m3", F.when(c("open_edges") == 0, c("_vol"))).withColumn("status", F.when(c("open_edges") == 0, "ok").otherwise("refused"))
            .withColumn("reason", F.when(c("open_edges") > 0, "the mesh is not closed")).drop("_vol"))


# --- similarity from paired points ---------------------------------------------------------------

def _moments(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Centred second moments of source ``px,py,pz`` against target ``qx,qy,qz``: nine covariances and the source variance."""
    p, q = ("px", "py", "pz"), ("qx", "qy", "qz")
    whole = F.lit(True)
    for c in (*p, *q):
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    return pairs.where(whole).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in (*p, *q)], *[F.covar_pop(b, a).alias(f"c_{b}_{a}") for b in q for a in p],
        (F.var_pop("px") + F.var_pop("py") + F.var_pop("pz")).alias("var_p"))


def _solve(row: pd.Series) -> tuple[float, np.ndarray, np.ndarray]:
    cov = np.array([[row[f"c_{b}_{a}"] for a in ("px", "py", "pz")] for b in ("qx", "qy", "qz")], dtype=float)
    u, d, vt = np.linalg.svd(cov)
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    rot = u @ flip @ vt
    scale = float((d * np.diag(flip)).sum() / row["var_p"]) if row["var_p"] > 0 else float("nan")
    mp, mq = (np.array([row[f"m_{a}{x}"] for x in "xyz"], dtype=float) for a in "pq")
    return scale, rot, mq - scale * rot @ mp


def _fit(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``n, scale, rotation[9], translation[3]`` per group; null where three points or an extent are missing."""
    m = _moments(pairs, keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in m.select(*keys, "n").schema) + ", scale double, rotation array<double>, translation array<double>"

    def run(batches):
        for pdf in batches:
            done = [_solve(r) if r["n"] >= 3 and r["var_p"] > 0 else None for _, r in pdf.iterrows()]
            yield pdf[keys + ["n"]].assign(scale=[d[0] if d else None for d in done], rotation=[d[1].ravel().tolist() if d else None for d in done],
                                           translation=[d[2].tolist() if d else None for d in done])

    return m.mapInPandas(run, schema)


def _report(pairs: DataFrame, fit: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``rmse_m, max_residual_m`` over the pairs that were fitted, ``status`` and ``reason``."""
    r = F.col("residual_m")
    missed = residuals(pairs, fit.where("scale IS NOT NULL"), keys).groupBy(*keys).agg(F.sqrt(F.avg(r * r)).alias("rmse_m"), F.max(r).alias("max_residual_m"))
    why = F.when(F.col("n") < 3, "fewer than three paired points").when(F.col("scale").isNull(), "the points have no extent")
    return fit.join(missed, keys, "left").withColumn("status", F.when(F.col("scale").isNull(), "refused").otherwise("ok")).withColumn("reason", why)


def fit_similarity(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares ``scale, rotation[9], translation[3]`` per group from moments, with residuals: a group's points never meet in one task.

    Pairs with a missing coordinate are left out; a group of fewer than three pairs, or of pairs at one place, is refused.
    """
    return _report(pairs, _fit(pairs, keys), keys).withColumn("method", F.lit("least_squares"))


def residuals(pairs: DataFrame, fit: DataFrame, on: list[str]) -> DataFrame:
    r, t = F.col("rotation"), F.col("translation")
    miss = [F.col("scale") * (r[3 * i] * F.col("px") + r[3 * i + 1] * F.col("py") + r[3 * i + 2] * F.col("pz")) + t[i] - F.col(q) for i, q in enumerate(("qx", "qy", "qz"))]
    return join_side(pairs, fit, on).withColumn("residual_m", F.sqrt(miss[0] * miss[0] + miss[1] * miss[1] + miss[2] * miss[2]))


def fit_similarity_robust(pairs: DataFrame, keys: list[str], point_id: str, *, rounds: int = RANSAC_ROUNDS, tolerance: float = RANSAC_TOLERANCE_M,
                          seed: int = RANSAC_SEED) -> DataFrame:
    """Consensus fit: models from point triples, all points scored against all models, refit on the best model's inliers.

    Triples come from the 3 x rounds points with the smallest seeded hash; with fewer points the
    hash order is reused in shifted triples. Without a consensus of three points, all points are fitted; ``method`` says which.
    Points meet the models on salted keys, and votes are summed up in the tasks.
    """
    hashed = pairs.withColumn("_h", F.xxhash64(F.lit(seed), *keys, point_id))
    # the smallest hashes by a bucket-wise top-k: 256 hash chunks, each a bounded sort
    top = with_row_number(hashed, keys, ["_h", point_id], [F.floor(F.col("_h") / F.lit(float(2**56)))], "_rn").where(F.col("_rn") <= 3 * rounds)
    n = top.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    slots = n.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(rounds * 3 - 1)))).withColumn("model", (F.col("_s") / 3).cast("int"))
    turn = F.floor(F.col("_s") / F.col("_n"))
    slots = slots.withColumn("_rn", ((F.col("_s") + turn * (1 + F.col("_s") % 3)) % F.col("_n") + 1).cast("long"))
    triples = slots.join(top, keys + ["_rn"])
    models = _fit(triples, keys + ["model"]).where("scale > 0").drop("n")
    scored = residuals(pairs.select(*keys, point_id, "px", "py", "pz", "qx", "qy", "qz"), models, keys)
    votes = scored.groupBy(*keys, "model").agg(F.count_if(F.col("residual_m") <= tolerance).alias("inliers"))
    best = votes.groupBy(*keys).agg(F.max_by("model", F.struct(F.col("inliers"), -F.col("model"))).alias("model"), F.max("inliers").alias("inliers"))
    # a group without any model keeps all its pairs and is fitted, or refused, as it is
    chosen = n.select(*keys).join(best.join(models, keys + ["model"]), keys, "left").withColumn("inliers", F.coalesce("inliers", F.lit(0).cast("long")))
    marked = residuals(pairs, chosen, keys)
    use = marked.where((F.col("residual_m") <= tolerance) | (F.col("inliers") < 3)).select(*keys, "px", "py", "pz", "qx", "qy", "qz")
    out = _report(use, _fit(use, keys), keys).join(chosen.select(*keys, "inliers"), keys)
    return out.withColumn("method", F.when(F.col("inliers") >= 3, "consensus").otherwise("least_squares"))
