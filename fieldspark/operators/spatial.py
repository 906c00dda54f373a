"""Point-in-polygon, clearance, coverage and sampling joins on explicit bucket keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldspark.functions.geo import EARTH_RADIUS_TRACK_M, in_ring, lonlat_to_utm, ring_pairs, segment_distance, utm_epsg
from fieldspark.session import join_salted


def _bounds(ring: Column) -> Column:
    return F.struct(F.array_min(F.transform(ring, lambda p: p["x"])).alias("x0"), F.array_max(F.transform(ring, lambda p: p["x"])).alias("x1"),
                    F.array_min(F.transform(ring, lambda p: p["y"])).alias("y0"), F.array_max(F.transform(ring, lambda p: p["y"])).alias("y1"))


def _bucket(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("long")


def local_enu(points: DataFrame, keys: list[str], *, lon: str = "lon", lat: str = "lat", alt: str = "alt_m", epsg: str | None = None) -> DataFrame:
    """Positions projected to UTM, less the mean of their group: adds ``epsg, east, north, up`` and the projected origin.

    ``epsg`` names a column that is the same within a group; without it the zone of the group's mean position holds. A missing
    altitude counts as 0; points without a position have no place and no part in the origin.
    """
    placed = F.col(lon).isNotNull() & F.col(lat).isNotNull()
    if epsg is None:
        zone = points.where(placed).groupBy(*keys).agg(F.avg(lat).alias("_lat"), F.avg(lon).alias("_lon")).select(*keys, utm_epsg("_lat", "_lon").alias("epsg"))
        flat = join_salted(points, zone, keys, [lon, lat])
    else:
        flat = points.withColumn("epsg", F.col(epsg))
    flat = flat.withColumn("_u", F.when(placed, lonlat_to_utm(lon, lat, "epsg"))).withColumn("_z", F.when(placed, F.coalesce(F.col(alt), F.lit(0.0))))
    origin = flat.groupBy(*keys).agg(F.avg("_u.easting").alias("origin_east"), F.avg("_u.northing").alias("origin_north"), F.avg("_z").alias("origin_up"))
    out = join_salted(flat, origin, keys, [lon, lat])
    return (out.withColumn("east", F.col("_u.easting") - F.col("origin_east")).withColumn("north", F.col("_u.northing") - F.col("origin_north"))
            .withColumn("up", F.col("_z") - F.col("origin_up")).drop("_u", "_z"))


def _size(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def cover(polygons: DataFrame, ring: str, finest: float) -> DataFrame:
    """Cells that polygons touch or hold, instead of their boxes: the columns of ``polygons`` but the ring, with the cell
    (``_lv, _bx, _by``), ``_full`` and, where a side runs through the cell, ``_e``, the sides that can lie right of its points.

    Cells are squares of 2^level; a polygon of n sides gets the level at which its box has about 64 + n of them, not under
    ``finest``. A cell without a side is held whole or not at all, as its middle is; holding it needs no test of a point.
    """
    lo = lambda e, c: F.least(e["p"][c], e["q"][c])
    hi = lambda e, c: F.greatest(e["p"][c], e["q"][c])
    out = polygons.where(F.size(ring) >= 3).withColumn("_b", _bounds(F.col(ring))).withColumn("_p", ring_pairs(F.col(ring)))
    wide = F.greatest(F.col("_b.x1") - F.col("_b.x0"), F.col("_b.y1") - F.col("_b.y0")) / F.sqrt(F.size("_p") + 64.0)
    out = out.withColumn("_lv", F.ceil(F.log2(F.greatest(wide, F.lit(float(finest))))).cast("int")).withColumn("_s", _size(F.col("_lv")))
    # sides this close to a cell count as running through it, for crossings are rounded
    out = out.withColumn("_m", F.col("_s") * 1e-9 + F.greatest(*[F.abs(F.col(f"_b.{c}")) for c in ("x0", "x1", "y0", "y1")]) * 1e-12)
    at = lambda v: F.floor(v / F.col("_s")).cast("long")
    out = out.withColumn("_by", F.explode(F.sequence(at(F.col("_b.y0") - F.col("_m")), at(F.col("_b.y1") + F.col("_m"))))).drop("_b", ring)
    south, north = F.col("_by") * F.col("_s") - F.col("_m"), (F.col("_by") + 1) * F.col("_s") + F.col("_m")
    out = out.withColumn("_y0", south).withColumn("_y1", north)
    out = out.withColumn("_e", F.filter("_p", lambda e: (lo(e, "y") <= F.col("_y1")) & (hi(e, "y") >= F.col("_y0")))).drop("_p")

    def columns(e: Column) -> Column:
        west, east = _stretch(e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"], F.col("_y0"), F.col("_y1"))
        return F.sequence(at(west - F.col("_m")), at(east + F.col("_m")))

    out = out.withColumn("_t", F.array_distinct(F.flatten(F.transform("_e", columns)))).where(F.size("_t") > 0)
    gaps = F.array_except(F.sequence(F.array_min("_t"), F.array_max("_t")), F.col("_t"))
    held = F.filter(gaps, lambda c: _odd((c + 0.5) * F.col("_s"), (F.col("_by") + 0.5) * F.col("_s"), F.col("_e")))
    cell = lambda full: lambda c: F.struct(c.alias("x"), F.lit(full).alias("full"))
    out = out.withColumn("_c", F.explode(F.concat(F.transform("_t", cell(False)), F.transform(held, cell(True)))))
    right = F.filter("_e", lambda e: hi(e, "x") >= F.col("_c.x") * F.col("_s") - F.col("_m"))
    return (out.withColumn("_e", F.when(~F.col("_c.full"), right)).withColumn("_bx", F.col("_c.x")).withColumn("_full", F.col("_c.full"))
            .drop("_c", "_t", "_s", "_m", "_y0", "_y1"))


def _stretch(ax: Column, ay: Column, bx: Column, by: Column, south: Column, north: Column) -> tuple[Column, Column]:
    """Least and greatest x of the part of a segment between two heights that it reaches."""
    rise = F.nullif(by - ay, F.lit(0.0))
    t = lambda y: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - ay) / rise)), F.lit(None).cast("double"))
    one, two = ax + t(south) * (bx - ax), ax + t(north) * (bx - ax)
    flat = by == ay
    return F.when(flat, F.least(ax, bx)).otherwise(F.least(one, two)), F.when(flat, F.greatest(ax, bx)).otherwise(F.greatest(one, two))


def _odd(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd rule of ``in_ring`` over the sides that can matter."""
    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.nullif(q["y"] - p["y"], F.lit(0.0))
        return ((p["y"] > y) != (q["y"] > y)) & (x < at)
    return F.size(F.filter(edges, crosses)) % 2 == 1


def walk(size: Column | float, grow: Column | float, ax: str = "ax", ay: str = "ay", bx: str = "bx", by: str = "by") -> Column:
    """Cells (``bx, by``) that hold a place within ``grow`` of a segment, row by row: about its length over the cell's size."""
    size, grow = (v if isinstance(v, Column) else F.lit(float(v)) for v in (size, grow))
    ax, ay, bx, by = F.col(ax), F.col(ay), F.col(bx), F.col(by)
    at = lambda v: F.floor(v / size).cast("long")

    def row(r: Column) -> Column:
        west, east = _stretch(ax, ay, bx, by, r * size - grow, (r + 1) * size + grow)
        return F.transform(F.sequence(at(west - grow), at(east + grow)), lambda c: F.struct(c.alias("bx"), r.alias("by")))

    return F.flatten(F.transform(F.sequence(at(F.least(ay, by) - grow), at(F.greatest(ay, by) + grow)), row))


def points_in_polygons(points: DataFrame, polygons: DataFrame, keys: list[str], bucket: float, *, x: str = "x", y: str = "y",
                       ring: str = "ring", row_key: list[str] | None = None) -> DataFrame:
    """Points joined to every polygon that holds them (even-odd, half-open edges), without its ring.

    Points meet the cells of :func:`cover` by equi-join, once for each level in use; no cell is smaller than ``bucket``.
    ``row_key`` spreads crowded cells over salts.
    """
    cells = cover(polygons, ring, bucket)
    levels = [r[0] for r in cells.select("_lv").distinct().collect()]  # powers of two between the finest cell and the widest polygon
    pts = points.withColumn("_lv", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
    pts = pts.withColumn("_bx", F.floor(F.col(x) / _size(F.col("_lv"))).cast("long")).withColumn("_by", F.floor(F.col(y) / _size(F.col("_lv"))).cast("long"))
    on = keys + ["_lv", "_bx", "_by"]
    joined = join_salted(pts, cells, on, row_key, how="inner") if row_key else pts.join(cells, on, "inner")
    return joined.where(F.col("_full") | _odd(F.col(x), F.col(y), F.col("_e"))).drop("_lv", "_bx", "_by", "_full", "_e")


def zones_over_cells(cells: DataFrame, rings: DataFrame, keys: list[str], feature: str, bucket: float, *, cell_key: list[str],
                     x: str = "x", y: str = "y", ring: str = "ring") -> DataFrame:
    """Cells whose centre lies in a feature of one or more rings; holes are rings met an even number of times."""
    hit = points_in_polygons(cells, rings, keys, bucket, x=x, y=y, ring=ring, row_key=cell_key)
    odd = (hit.groupBy(*keys, *cell_key, feature).agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").drop("_n"))
    return odd


def tile_covers_area(areas: DataFrame, tiles: DataFrame, margin: float = 0.0, degrees: float = 1.0) -> DataFrame:
    """First tile (by ``tile_seq``) that contains an area's bounds, or the reason there is none.

    ``areas(area_id, west, south, east, north)``, ``tiles(tile_seq, tile_id, west, south, east, north, present)``.
    A whole containing tile also contains the area's south-west corner, which gives the equi-join bucket.
    """
    # tiles of equal bounds fold to their first one, areas of equal bounds to one place
    there = F.coalesce("present", F.lit(False))
    t = (tiles.groupBy(*[F.col(c).alias(f"t_{c}") for c in ("west", "south", "east", "north")])
         .agg(F.min(F.when(there, F.struct("tile_seq", "tile_id"))).alias("_first"), F.max(there).alias("present"), F.max(~F.coalesce("present", F.lit(True))).alias("absent")))
    spread = (t.withColumn("_bx", F.explode(F.sequence(_bucket(F.col("t_west"), degrees), _bucket(F.col("t_east"), degrees))))
              .withColumn("_by", F.explode(F.sequence(_bucket(F.col("t_south"), degrees), _bucket(F.col("t_north"), degrees)))))
    box = ["_w", "_s", "_e", "_n"]
    a = areas.select("area_id", (F.col("west") - margin).alias("_w"), (F.col("south") - margin).alias("_s"), (F.col("east") + margin).alias("_e"), (F.col("north") + margin).alias("_n"))
    # every bucket the area touches, so that partial overlaps are seen too
    cells = (a.select(*box).distinct().withColumn("_bx", F.explode(F.sequence(_bucket(F.col("_w"), degrees), _bucket(F.col("_e"), degrees))))
             .withColumn("_by", F.explode(F.sequence(_bucket(F.col("_s"), degrees), _bucket(F.col("_n"), degrees)))))
    j = cells.join(spread, ["_bx", "_by"], "left")
    inside = (F.col("t_west") <= F.col("_w")) & (F.col("t_south") <= F.col("_s")) & (F.col("t_east") >= F.col("_e")) & (F.col("t_north") >= F.col("_n"))
    touches = (F.col("present") & (F.col("t_west") <= F.col("_e")) & (F.col("t_east") >= F.col("_w"))
               & (F.col("t_south") <= F.col("_n")) & (F.col("t_north") >= F.col("_s")))
    places = j.groupBy(*box).agg(
        F.min(F.when(inside, F.col("_first"))).alias("_first"), F.max(F.coalesce(inside & F.col("present"), F.lit(False))).alias("_ok"),
        F.max(F.coalesce(inside & F.col("absent"), F.lit(False))).alias("_gone"), F.max(F.coalesce(touches, F.lit(False))).alias("_part"))
    found = (join_salted(a, places, box, ["area_id"], how="inner").groupBy("area_id")
             .agg(F.min("_first")["tile_id"].alias("tile_id"), *[F.max(c).alias(c) for c in ("_ok", "_gone", "_part")]))
    none = tiles.isEmpty()
    return found.select("area_id", F.when(F.col("_ok"), F.col("tile_id")).alias("tile_id"),
                        F.when(F.col("_ok"), "covered").when(F.col("_gone"), "file_missing").when(F.col("_part"), "partial")
                        .otherwise("no_cache" if none else "elsewhere").alias("status"))


def clearance(points: DataFrame, surfaces: DataFrame, keys: list[str], minimum_m: float, *, point_id: str, surface_id: str,
              floor_m: float = 2.0, closed: str | None = None) -> DataFrame:
    """Point/surface pairs closer than ``max(minimum, floor)`` with the distance and the shortfall.

    Coordinates are metres. Each boundary segment is repeated per cell within the limit of it (:func:`walk`); only pairs
    that can violate are compared.
    """
    limit = max(minimum_m, floor_m)
    seg = segments(surfaces, keys, surface_id, closed)
    size = max(limit * 8, 1.0)
    seg = seg.withColumn("_c", F.explode(walk(size, limit))).withColumn("_bx", F.col("_c.bx")).withColumn("_by", F.col("_c.by")).drop("_c")
    pts = points.withColumn("_bx", _bucket(F.col("x"), size)).withColumn("_by", _bucket(F.col("y"), size))
    near = pts.join(seg, keys + ["_bx", "_by"]).withColumn("distance_m", segment_distance("x", "y", "ax", "ay", "bx", "by"))
    return (near.groupBy(*keys, point_id, surface_id).agg(F.min("distance_m").alias("distance_m")).where(F.col("distance_m") < limit)
            .withColumn("shortfall_m", F.lit(limit) - F.col("distance_m")))


def segments(surfaces: DataFrame, keys: list[str], surface_id: str, closed: str | None = None) -> DataFrame:
    """Boundary segments of polylines or rings as listed; ``closed`` names a boolean column that adds the closing side."""
    whole = F.col(closed) if closed else F.lit(False)
    pairs = ring_pairs(F.col("ring"))
    kept = F.when(whole, pairs).otherwise(F.slice(pairs, 1, F.greatest(F.size("ring") - 1, F.lit(0))))
    return (surfaces.withColumn("_e", F.explode(kept))
            .select(*keys, surface_id, F.col("_e.p.x").alias("ax"), F.col("_e.p.y").alias("ay"), F.col("_e.q.x").alias("bx"), F.col("_e.q.y").alias("by")))


def closest_approach(points: DataFrame, surfaces: DataFrame, keys: list[str], surface_id: str, *, start_m: float = 50.0,
                     closed: str | None = None) -> DataFrame:
    """Smallest distance of any point to each surface, exact, by a search radius that grows fourfold until none is left.

    A surface leaves the search once its best distance is within the radius already searched. Surfaces whose key has no
    point come back without a distance, with status ``no_points``.
    """
    from fieldspark.session import cut
    seg = cut(segments(surfaces, keys, surface_id, closed))
    placed = points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    if keys:
        todo = seg.join(placed.select(*keys).distinct(), keys, "left_semi")
    else:
        todo = seg.limit(0) if placed.isEmpty() else seg
    bare = seg.select(*keys, surface_id).distinct().join(todo.select(*keys, surface_id).distinct(), keys + [surface_id], "left_anti")
    radius, done = start_m, [bare.withColumn("closest_m", F.lit(None).cast("double")).withColumn("status", F.lit("no_points"))]
    todo = cut(todo)
    while not todo.isEmpty():
        grown = todo.withColumn("_c", F.explode(walk(radius * 4, radius))).withColumn("_bx", F.col("_c.bx")).withColumn("_by", F.col("_c.by")).drop("_c")
        pts = points.select(*keys, "x", "y").withColumn("_bx", _bucket(F.col("x"), radius * 4)).withColumn("_by", _bucket(F.col("y"), radius * 4))
        best = (grown.join(pts, keys + ["_bx", "_by"]).groupBy(*keys, surface_id)
                .agg(F.min(segment_distance("x", "y", "ax", "ay", "bx", "by")).alias("closest_m")).where(F.col("closest_m") <= radius))
        best = cut(best)
        done.append(best.withColumn("status", F.lit("ok")))
        todo = cut(todo.join(best, keys + [surface_id], "left_anti"))
        radius *= 4
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def hazards_near(waypoints: DataFrame, markers: DataFrame, keys: list[str], clearance_m: float) -> DataFrame:
    """Markers whose edge comes within ``clearance_m`` of a waypoint, with the smallest gap.

    ``markers(marker_id, lon, lat, radius_m)``. Markers are split by size class, so that each class
    joins on cells of its own reach; there are no more classes than powers of two up to half the globe, since a larger reach
    covers everything. No marker gives no row.
    """
    from fieldspark.operators.matching import near_pairs
    reach = F.least(F.lit(25), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("radius_m") + clearance_m)))).cast("int")
    sized = markers.withColumn("_class", reach)
    classes = sorted(r["_class"] for r in sized.select("_class").distinct().collect())  # 0 to 25
    out = None
    for k in classes:
        m = sized.where(F.col("_class") == k).select(*keys, "marker_id", "radius_m", F.col("lon").alias("_mx"), F.col("lat").alias("_my"))
        w = waypoints.select(*keys, F.col("lon").alias("_wx"), F.col("lat").alias("_wy")).distinct()
        hit = near_pairs(w, m, keys, float(2**k), lpos=("_wx", "_wy"), rpos=("_mx", "_my"), earth=EARTH_RADIUS_TRACK_M)
        part = (hit.groupBy(*keys, "marker_id").agg(F.min(F.col("distance_m") - F.col("radius_m")).alias("gap_m")).where(F.col("gap_m") <= clearance_m))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = markers.select(*keys, "marker_id", F.lit(None).cast("double").alias("gap_m")).limit(0)
    return out


def sample_grid(points: DataFrame, cells: DataFrame, keys: list[str], origin_x: float, origin_y: float, step_x: float, step_y: float,
                *, value: str = "value", row_key: list[str]) -> DataFrame:
    """Cell value under a point (truncated row and column; outside or no data gives null)."""
    pts = (points.withColumn("row_idx", F.floor((F.col("y") - origin_y) / step_y).cast("int"))
           .withColumn("col_idx", F.floor((F.col("x") - origin_x) / step_x).cast("int")))
    side = cells.select(*keys, "row_idx", "col_idx", F.col(value).alias("sample"))
    return join_salted(pts, side, keys + ["row_idx", "col_idx"], row_key, how="left")


def sample_bilinear(points: DataFrame, cells: DataFrame, keys: list[str], *, width: int, height: int, row_key: list[str],
                    value: str = "value") -> DataFrame:
    """Bilinear value at fractional grid positions ``gx, gy`` (cell units; on and beyond the rim the clamped cell itself); null if a corner is missing."""
    ix, iy = F.floor("gx").cast("int"), F.floor("gy").cast("int")
    rim = (ix < 0) | (iy < 0) | (ix >= width - 1) | (iy >= height - 1)
    x0, y0 = F.greatest(F.lit(0), F.least(F.lit(width - 1), ix)), F.greatest(F.lit(0), F.least(F.lit(height - 1), iy))
    fx, fy = F.when(rim, 0.0).otherwise(F.col("gx") - ix), F.when(rim, 0.0).otherwise(F.col("gy") - iy)
    x1, y1 = F.least(x0 + 1, F.lit(width - 1)), F.least(y0 + 1, F.lit(height - 1))
    corner = lambda r, c, w: F.struct(r.alias("row_idx"), c.alias("col_idx"), w.alias("w"))
    spread = points.select(*keys, *row_key, F.explode(F.array(
        corner(y0, x0, (1 - fx) * (1 - fy)), corner(y0, x1, fx * (1 - fy)), corner(y1, x0, (1 - fx) * fy), corner(y1, x1, fx * fy))).alias("_k"))
    spread = spread.select(*keys, *row_key, "_k.row_idx", "_k.col_idx", "_k.w")
    j = spread.join(cells.select(*keys, "row_idx", "col_idx", F.col(value).alias("_v")), keys + ["row_idx", "col_idx"], "left")
    total = (j.groupBy(*keys, *row_key).agg(F.sum(F.col("_v") * F.col("w")).alias("_s"),
                                            F.max((F.col("_v").isNull() & (F.col("w") > 0)).cast("int")).alias("_hole")))
    return points.join(total.select(*keys, *row_key, F.when(F.col("_hole") == 0, F.col("_s")).alias("sample")), keys + row_key, "left")


def thin_samples(samples: DataFrame, keys: list[str], order: list[str], chunk: list[Column], limit: int) -> DataFrame:
    """Every ``ceil(n / limit)``-th elevation sample of a site, from the first on (a sampling operator)."""
    from fieldspark.operators.ordered import join_side, with_row_number
    step = samples.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(float(limit)))).alias("_step"))
    rows = join_side(with_row_number(samples, keys, order, chunk, "_at"), step, keys)
    return rows.where((F.col("_at") - 1) % F.col("_step") == 0).drop("_at", "_step")


def idw_at_points(points: DataFrame, samples: DataFrame, keys: list[str], point_id: str, *, minimum: int = 3, d_min: float = 0.25,
                  error: float = 0.0, block_samples: int = 256) -> DataFrame:
    """Inverse-distance weighted elevation over all samples of the point's site (metres).

    Samples of one place fold into one, and so do points; near samples share blocks of about ``block_samples``. A point meets blocks, not samples,
    on salted keys, and a block gives two partial sums. With ``error`` above 0 a block that is far for its size counts as
    one place at its middle: if r is half its diagonal and D its distance, each weight is off by at most r / D, so blocks with
    r / D <= error / (1 + error) move an elevation by at most ``error`` times the range of the site's samples. At 0 all is exact.
    Samples without position or height are left out; a point without position is refused.
    """
    from fieldspark.operators.ordered import join_side
    rows = samples.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    spots = rows.groupBy(*keys, F.col("x").cast("double").alias("_sx"), F.col("y").cast("double").alias("_sy")).agg(F.sum("z").alias("_sz"), F.count(F.lit(1)).alias("_sn"))
    box = spots.groupBy(*keys).agg(F.min("_sx").alias("_x0"), F.min("_sy").alias("_y0"), F.count(F.lit(1)).alias("_c"),
                                   F.greatest(F.max("_sx") - F.min("_sx"), F.max("_sy") - F.min("_sy")).alias("_w"))
    side = F.greatest(F.col("_w") * F.sqrt(F.lit(float(block_samples)) / F.col("_c")), F.lit(1e-6))
    tiled = join_side(spots, box, keys).select(*keys, "_sx", "_sy", "_sz", "_sn", F.floor((F.col("_sx") - F.col("_x0")) / side).alias("_tx"),
                                               F.floor((F.col("_sy") - F.col("_y0")) / side).alias("_ty"))
    tile = [*keys, "_tx", "_ty"]
    parts = tiled.groupBy(*tile).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block_samples))).alias("_parts"))
    split = join_side(tiled, parts, tile).withColumn("_part", F.pmod(F.xxhash64("_sx", "_sy"), F.col("_parts")))
    mid = lambda c: (F.min(c) + F.max(c)) / 2
    blocks = split.groupBy(*tile, "_part").agg(
        F.collect_list(F.struct("_sx", "_sy", "_sz", "_sn")).alias("_list"), mid("_sx").alias("_cx"), mid("_sy").alias("_cy"), F.sum("_sz").alias("_zs"), F.sum("_sn").alias("_ns"),
        (F.hypot(F.max("_sx") - F.min("_sx"), F.max("_sy") - F.min("_sy")) / 2).alias("_rad")).drop("_tx", "_ty", "_part")
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    # points of one place share its elevation
    at = [*keys, "_px", "_py"]
    points = points.withColumn("_px", F.col("x").cast("double")).withColumn("_py", F.col("y").cast("double"))
    met = join_salted(points.where(placed).select(*at).distinct(), blocks, keys, ["_px", "_py"], how="inner").withColumn("x", F.col("_px")).withColumn("y", F.col("_py"))
    far = F.hypot(F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy"))
    reach = F.lit(error / (1.0 + error))

    middle = F.array(F.struct(F.col("_cx").alias("_sx"), F.col("_cy").alias("_sy"), F.col("_zs").alias("_sz"), F.col("_ns").alias("_sn")))
    chosen = F.when((F.col("_rad") <= reach * far) & (far - F.col("_rad") >= d_min), middle).otherwise(F.col("_list")) if error > 0 else F.col("_list")
    dx, dy = F.col("x") - F.col("_sx"), F.col("y") - F.col("_sy")
    d = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(d_min))  # hypot takes many times as long
    got = (met.select(*at, "x", "y", F.inline(chosen)).groupBy(*at)
           .agg((F.sum(F.col("_sz") / d) / F.sum(F.col("_sn") / d)).alias("elevation_m"), F.sum("_sn").alias("_n")))
    return (join_salted(points, got, at, [point_id])
            .withColumn("status", F.when(F.coalesce("_n", F.lit(0)) >= minimum, "ok").otherwise("refused"))
            .withColumn("reason", F.when(F.col("status") == "refused", F.when(placed, F.lit(f"fewer than {minimum} terrain samples")).otherwise("the point has no position")))
            .withColumn("elevation_m", F.when(F.col("status") == "ok", F.col("elevation_m"))).drop("_n", "_px", "_py"))
