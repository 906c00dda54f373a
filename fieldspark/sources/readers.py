"""Readers: every source becomes a typed DataFrame; what cannot be read carries a status and a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from fieldspark import schemas
from fieldspark.functions.bands import camera_solution
from fieldspark.functions.physics import DEFAULT_LEAP_SECONDS, gps_to_utc
from fieldspark.functions.text import base_name, extension, stem
from fieldspark.session import cut, join_salted

# Fixed values that decide the results.
LIBRARY_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff")
LIDAR_EXTENSIONS = (".csv", ".xyz", ".txt", ".npy", ".npz")
MS_BANDS = ("nir", "red", "green", "blue", "rededge", "swir")
FRAME_STEP_MS, LIDAR_STEP_MS, IMU_STEP_MS = 100.0, 120.0, 10.0
CONTROL_ALIASES = {
    "name": ("name", "id", "point", "label", "gcp"), "x": ("x", "easting", "east", "lon", "longitude"), "y": ("y", "northing", "north", "lat", "latitude"),
    "z": ("z", "elevation", "height", "alt", "altitude"), "accuracy": ("accuracy", "accuracy_m", "sigma", "precision"), "epsg": ("epsg", "crs", "srid"),
}
DEFAULT_ACCURACY_M = 0.02
TERRAIN_ALIASES = {"lon": ("lon", "longitude"), "lat": ("lat", "latitude"), "x": ("x_m", "x"), "y": ("y_m", "y"),
                   "z": ("elevation_m", "elevation", "z_m", "z", "height_m", "height")}
BOUNDARY_LON = ("lon", "long", "lng", "longitude", "x", "easting_deg", "lon_deg")
BOUNDARY_LAT = ("lat", "latitude", "y", "northing_deg", "lat_deg")


def scan_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Supported images below a folder with size and content digest; hidden files are left out.

    The digest is taken next to the read, so file content never reaches a shuffle.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = base_name("path")
    keep = extension("path").isin(*LIBRARY_EXTENSIONS) & ~name.startswith(".")
    return raw.where(keep).select(F.col("path").alias("file_path"), name.alias("file_name"), F.col("length").alias("file_size_bytes"), F.sha1("content").alias("sha1"))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """``path, sha256, size`` of every file below a folder."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
            .select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes")))


# --- multi-sensor bundles ------------------------------------------------------------------------

_MANIFEST = ("bundle_id string, payload_id string, rgb_frames array<string>, thermal_frames array<string>, multispectral_frames array<string>, "
             "lidar_packets array<string>, imu array<string>, gnss array<string>")


def read_capture_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Bundle manifests (one JSON document per file) as one table per sensor.

    An entry may be a bare path or an object. Missing times become position times the sensor's step.
    """
    doc = spark.read.schema(_MANIFEST).option("multiLine", "true").json(path).withColumn("_file", F.input_file_name())
    doc = doc.withColumn("bundle_id", F.coalesce(F.nullif("bundle_id", F.lit("")), stem("_file")))
    item = lambda field: F.get_json_object("entry", f"$.{field}")
    t = lambda step: F.coalesce(item("timestamp_ms").try_cast("double"), F.col("pos") * step).alias("t_ms")

    def each(column: str) -> DataFrame:
        return doc.select("bundle_id", F.posexplode(column).alias("pos", "entry"))

    def frames(column: str, step: float, bare: bool = True) -> DataFrame:
        is_obj = F.col("entry").startswith("{")
        p = F.when(is_obj, F.trim(item("path"))).otherwise(F.col("entry") if bare else None)
        out = each(column).withColumn("path", p).where(F.coalesce(F.col("path"), F.lit("")) != "")
        return out.select("bundle_id", t(step), F.col("pos").cast("long").alias("seq"), "path", F.coalesce(F.nullif(item("id"), F.lit("")), stem("path")).alias("id"),
                          F.lower(F.coalesce(F.nullif(item("band"), F.lit("")), F.lit("unknown"))).alias("band"))

    def vector(*names: str) -> Column:
        got = F.coalesce(*[F.from_json(item(n), "array<double>") for n in names])
        zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
        return F.when(F.size(got) >= 3, F.slice(got, 1, 3)).otherwise(zero)

    imu = each("imu").select("bundle_id", t(IMU_STEP_MS), F.col("pos").cast("long").alias("seq"), vector("accel_m_s2", "accel").alias("accel"), vector("gyro_rad_s", "gyro").alias("gyro"))
    num = lambda *names: F.coalesce(*[item(n).try_cast("double") for n in names], F.lit(0.0))
    gnss = each("gnss").select("bundle_id", t(FRAME_STEP_MS), F.col("pos").cast("long").alias("seq"), num("lat").alias("lat"), num("lon").alias("lon"),
                               num("alt_m", "alt").alias("alt_m"), F.coalesce(item("fix"), F.lit("unknown")).alias("fix"))
    return {"rgb": frames("rgb_frames", FRAME_STEP_MS).drop("band"), "thermal": frames("thermal_frames", FRAME_STEP_MS).drop("band"),
            "multispectral": frames("multispectral_frames", FRAME_STEP_MS, bare=False), "lidar": frames("lidar_packets", LIDAR_STEP_MS).drop("band"),
            "imu": imu, "gnss": gnss}


def bundle_from_folders(files: DataFrame, start_ms: float = 0.0, step_ms: float = 200.0) -> DataFrame:
    """Frames of ``<root>/{rgb,thermal,multispectral,lidar}/file`` listings (column ``path``), timed by name order.

    A folder's frames are numbered in chunks by the first characters of their paths, which sort as the paths do.
    """
    from fieldspark.operators.ordered import with_row_number
    parts = "([^/\\\\]+)[/\\\\](rgb|thermal|multispectral|lidar)[/\\\\][^/\\\\]+$"
    rows = (files.select("path").withColumn("bundle_id", F.concat(F.regexp_extract("path", parts, 1), F.lit("_bundle"))).withColumn("sensor", F.regexp_extract("path", parts, 2))
            .where((F.col("sensor") != "") & F.when(F.col("sensor") == "lidar", extension("path").isin(*LIDAR_EXTENSIONS)).otherwise(extension("path").isin(*IMAGE_EXTENSIONS))))
    numbered = with_row_number(rows, ["bundle_id", "sensor"], ["path"], [F.substring("path", 1, 64)], "_rn")
    band = F.lit("unknown")
    for name in reversed(MS_BANDS):
        band = F.when(F.lower(stem("path")).contains(name), name).otherwise(band)
    return numbered.select("bundle_id", "sensor", (F.lit(start_ms) + (F.col("_rn") - 1) * step_ms).alias("t_ms"), (F.col("_rn") - 1).alias("seq"), "path", stem("path").alias("id"),
                           F.when(F.col("sensor") == "multispectral", band).alias("band"))


def bundle_status(frames: DataFrame) -> DataFrame:
    """A folder bundle without RGB frames is refused."""
    n = frames.groupBy("bundle_id").agg(F.count_if(F.col("sensor") == "rgb").alias("rgb"))
    return n.withColumn("status", F.when(F.col("rgb") > 0, "ok").otherwise("refused")).withColumn("reason", F.when(F.col("rgb") == 0, "no RGB files"))


def validate_bundle(bundles: dict[str, DataFrame], listing: DataFrame | None = None) -> DataFrame:
    """Per bundle: counts of each sensor, errors, warnings and ``valid``."""
    from fieldspark.operators.flights import monotonic_check
    out = None
    for name, df in bundles.items():
        allowed = LIDAR_EXTENSIONS if name == "lidar" else IMAGE_EXTENSIONS
        n = df.groupBy("bundle_id").agg(F.count(F.lit(1)).alias(f"{name}_count"))
        if "path" in df.columns:
            n = n.join(df.groupBy("bundle_id").agg(F.count_if(~extension("path").isin(*allowed)).alias(f"{name}_bad_ext")), "bundle_id", "left")
            if listing is not None:
                gone = df.join(listing.select("path"), "path", "left_anti").groupBy("bundle_id").agg(F.count(F.lit(1)).alias(f"{name}_missing"))
                n = n.join(gone, "bundle_id", "left")
        n = n.join(monotonic_check(df, ["bundle_id"], "t_ms", "seq").withColumnRenamed("monotonic", f"{name}_monotonic"), "bundle_id", "left")
        out = n if out is None else out.join(n, "bundle_id", "full_outer")
    out = out.na.fill(0)
    errors, warnings = [F.when(F.col("rgb_count") == 0, "no RGB frames")], []
    for name in bundles:
        warnings.append(F.when(F.col(f"{name}_monotonic") == F.lit(False), f"{name} times are not monotonic"))
        if f"{name}_bad_ext" in out.columns:
            errors.append(F.when(F.col(f"{name}_bad_ext") > 0, f"{name} has unsupported files"))
        if f"{name}_missing" in out.columns:
            errors.append(F.when(F.col(f"{name}_missing") > 0, f"{name} has missing files"))
    return (out.withColumn("errors", F.array_compact(F.array(*errors))).withColumn("warnings", F.array_compact(F.array(*warnings)))
            .withColumn("valid", F.size("errors") == 0))


# --- control, positioning ------------------------------------------------------------------------

def _outside_quotes(text: Column, old: str, new: str) -> Column:
    """``text`` with ``old`` replaced where it does not stand between double quotes."""
    return F.array_join(F.transform(F.split(text, '"'), lambda part, i: F.when(i % 2 == 0, F.replace(part, F.lit(old), F.lit(new))).otherwise(part)), '"')


def _lines(spark: SparkSession, path: str, quoted: bool = False) -> DataFrame:
    """One row per line: ``file, line_no, line``; with ``quoted`` a break between double quotes is part of its line.

    Files are read in splits of any number. Windows run inside a split; counts of lines and quotes of the splits before it
    travel in one row per split.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("_c"), F.monotonically_increasing_id().alias("_i"), F.regexp_replace("value", "\\r$", "").alias("line"))
    marks = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit(""))) if quoted else F.lit(0)
    inner = W.partitionBy("file", "_c").orderBy("_i")
    upto, prior = inner.rowsBetween(W.unboundedPreceding, 0), W.partitionBy("file").orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    # a line begins where an even number of quotes stands before it, counted from the split's start or from one quote more
    raw = raw.withColumn("_q", marks).withColumn("_even", (F.sum("_q").over(upto) - F.col("_q")) % 2 == 0)
    raw = raw.withColumn("_n", F.row_number().over(inner)).withColumn("_n0", F.sum(F.col("_even").cast("long")).over(upto))
    splits = raw.groupBy("file", "_c").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_q").alias("_marks"), F.max("_n0").alias("_rows0"))
    splits = splits.withColumn("_odd", F.coalesce(F.sum("_marks").over(prior), F.lit(0)) % 2 == 1)
    splits = splits.withColumn("_before", F.coalesce(F.sum(F.when(F.col("_odd"), F.col("_rows") - F.col("_rows0")).otherwise(F.col("_rows0"))).over(prior), F.lit(0)))
    at = F.col("_before") + F.when(F.col("_odd"), F.col("_n") - F.col("_n0")).otherwise(F.col("_n0")) - 1
    lines = join_salted(raw, splits.select("file", "_c", "_odd", "_before"), ["file", "_c"], ["_i"], how="inner").withColumn("line_no", at)
    if quoted:
        parts = F.array_sort(F.collect_list(F.struct("_c", "_i", "line")))
        lines = lines.groupBy("file", "line_no").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("line"))
    return lines.select("file", "line_no", F.when(F.col("line_no") == 0, F.regexp_replace("line", "^\\x{FEFF}", "")).otherwise(F.col("line")).alias("line"))


def _header_index(cells: Column, names: tuple[str, ...]) -> Column:
    """0-based position of the first header cell that is one of ``names``; null when none is."""
    found = F.filter(F.transform(cells, lambda c, i: F.when(F.lower(F.trim(c)).isin(*names), i)), lambda v: v.isNotNull())
    return F.get(found, F.lit(0))


def csv_cells(line: str, sep: str = ",") -> Column:
    """Fields of a CSV line. A field in double quotes may hold the separator, and two quotes for one."""
    parts = F.split(_outside_quotes(F.col(line), sep, "\u0001"), "\u0001")
    quoted = lambda p: F.trim(p).startswith('"') & F.trim(p).endswith('"') & (F.length(F.trim(p)) > 1)
    return F.transform(parts, lambda p: F.when(quoted(p), F.replace(F.substring(F.trim(p), F.lit(2), F.length(F.trim(p)) - 2), F.lit('""'), F.lit('"'))).otherwise(p))


def _csv_by_alias(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]], sep: str = ",") -> DataFrame:
    """Rows of header-led tables whose columns go by several names: ``file, row_no, <fields>`` plus ``has_<field>``."""
    # read once; headers, refusals and rows come from it
    lines = cut(_lines(spark, path, quoted=True).where(F.trim(F.translate("line", sep, "")) != "").select("file", "line_no", csv_cells("line", sep).alias("cells")))
    head = lines.groupBy("file").agg(F.min_by("cells", "line_no").alias("head"), F.min("line_no").alias("head_no"))
    head = head.select("file", "head_no", *[_header_index(F.col("head"), names).alias(f"_i_{field}") for field, names in aliases.items()])
    rows = join_salted(lines, head, ["file"], ["line_no"], how="inner").where(F.col("line_no") > F.col("head_no"))
    return rows.select("file", (F.col("line_no") - F.col("head_no")).alias("row_no"), *[F.trim(F.get("cells", F.col(f"_i_{f}"))).alias(f) for f in aliases],
                       *[F.col(f"_i_{f}").isNotNull().alias(f"has_{f}") for f in aliases])


def read_control_points(spark: SparkSession, path: str, default_epsg: int | None = None) -> DataFrame:
    """Control points from CSV files with a header under any known alias.

    Files without x, y or z, or without a coordinate system, come back as one refused row.
    Rows that are not numeric are skipped.
    """
    raw = _csv_by_alias(spark, path, CONTROL_ALIASES)
    num = lambda c: F.col(c).try_cast("double")
    epsg = F.coalesce(num("epsg").cast("int"), F.lit(default_epsg).cast("int"))
    ok = raw.where(num("x").isNotNull() & num("y").isNotNull() & num("z").isNotNull())
    why = (F.when(~(F.col("has_x") & F.col("has_y") & F.col("has_z")), "no x, y or z column").when(F.col("_n") == 0, "no numeric rows")
           .when(F.col("_bare"), "no coordinate system"))
    files = raw.groupBy("file").agg(F.max("has_x").alias("has_x"), F.max("has_y").alias("has_y"), F.max("has_z").alias("has_z"),
                                    F.count_if(num("x").isNotNull() & num("y").isNotNull() & num("z").isNotNull()).alias("_n"),
                                    F.max(num("x").isNotNull() & epsg.isNull()).alias("_bare")).withColumn("reason", why)
    name = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("GCP"), F.lpad(F.col("row_no").cast("string"), 3, "0")))
    good = join_salted(ok, files.where("reason IS NULL").select("file"), ["file"], ["row_no"], how="inner").select(
        "file", "row_no", name.alias("name"), num("x").alias("x"), num("y").alias("y"), num("z").alias("z"), epsg.alias("epsg"),
        F.coalesce(F.abs(num("accuracy")), F.lit(DEFAULT_ACCURACY_M)).alias("accuracy_m"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason"))
    bad = files.where("reason IS NOT NULL").select("file", F.lit("refused").alias("status"), "reason")
    return good.unionByName(bad, allowMissingColumns=True)


def read_camera_events(spark: SparkSession, path: str, leap: int = DEFAULT_LEAP_SECONDS) -> DataFrame:
    """Shutter events: sequence, second of week, week, then ``value,TAG`` tokens. Corrections come in millimetres."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).withColumn("line", F.trim("value")).where("line <> '' AND NOT startswith(line, '#')")
    f = lines.withColumn("_f", F.split("line", "\\s+"))
    tokens = F.filter(F.slice("_f", F.lit(4), F.greatest(F.size("_f"), F.lit(1))), lambda t: t.contains(",") & F.regexp_replace(t, ",[^,]*$", "").try_cast("double").isNotNull())
    tags = F.transform(tokens, lambda t: F.struct(F.trim(F.regexp_extract(t, "([^,]*)$", 1)).alias("k"), F.regexp_replace(t, ",[^,]*$", "").cast("double").alias("v")))
    f = f.withColumn("_t", tags)
    last = lambda k: F.try_element_at(F.filter("_t", lambda e: e["k"] == k), F.lit(-1))["v"]  # a repeated tag: the last one counts
    tag = lambda k: F.coalesce(last(k), F.lit(0.0))
    at = lambda i: F.get("_f", F.lit(i))
    flag = F.coalesce(last("Q"), last("Flag"), F.lit(0.0)).cast("int")
    seq, sow, week = at(0).try_cast("int"), at(1).try_cast("double"), at(2).try_cast("int")
    broken = (F.size("_f") < 3) | seq.isNull() | sow.isNull() | week.isNull()
    return f.select("file", seq.alias("sequence"), week.alias("gps_week"), sow.alias("gps_seconds"), gps_to_utc(week, sow, leap).alias("ts"), tag("Lat").alias("lat"), tag("Lon").alias("lon"),
                    tag("Ellh").alias("height_m"), (tag("N") * 0.001).alias("north_m"), (tag("E") * 0.001).alias("east_m"), (tag("V") * 0.001).alias("vertical_m"),
                    tag("Ns").alias("std_north_m"), tag("Es").alias("std_east_m"), tag("Vs").alias("std_vertical_m"), camera_solution(flag).alias("solution"),
                    F.when(broken, "refused").otherwise("ok").alias("status"), F.when(broken, "not a camera event record").alias("reason"))


def read_base_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Headers of RINEX observation files: label from column 61, body before it."""
    doc = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    head = F.substring_index("value", "END OF HEADER", 1)
    doc = doc.select("file", F.col("value").contains("END OF HEADER").alias("_end"), F.split(head, "\\r?\\n").alias("_l"))

    def body(label: str) -> Column:
        hit = F.filter("_l", lambda l: F.trim(F.substring(l, 61, 20)) == label)
        return F.trim(F.substring(F.get(hit, F.size(hit) - 1), 1, 60))

    def epoch(label: str) -> Column:
        p = F.split(body(label), "\\s+")
        n = lambda i: F.get(p, F.lit(i)).try_cast("double")
        return F.when(F.size(p) >= 6, F.make_timestamp(n(0).cast("int"), n(1).cast("int"), n(2).cast("int"), n(3).cast("int"), n(4).cast("int"), n(5).cast("decimal(18,6)"), F.lit("UTC")))

    xyz = F.transform(F.slice(F.split(body("APPROX POSITION XYZ"), "\\s+"), 1, 3), lambda v: v.try_cast("double"))
    rec, ant = F.split(body("REC # / TYPE / VERS"), "\\s+"), F.split(body("ANT # / TYPE"), "\\s+")
    out = doc.select("file", "_end", F.coalesce(body("MARKER NAME"), F.lit("")).alias("marker"), F.when(F.size(rec) >= 3, F.array_join(F.slice(rec, 2, 2), " ")).otherwise(body("REC # / TYPE / VERS")).alias("receiver"),
                     F.array_join(F.slice(ant, F.lit(2), F.greatest(F.size(ant), F.lit(1))), " ").alias("antenna"), xyz.alias("approx_xyz_m"), epoch("TIME OF FIRST OBS").alias("first_obs"), epoch("TIME OF LAST OBS").alias("last_obs"),
                     F.get(F.split(body("INTERVAL"), "\\s+"), F.lit(0)).try_cast("double").alias("interval_s"))
    why = (F.when(~F.col("_end"), "no end of header").when(F.col("first_obs").isNull(), "no time of first observation")
           .when((F.size(F.coalesce("approx_xyz_m", F.array().cast("array<double>"))) < 3) | F.exists("approx_xyz_m", lambda v: v.isNull()), "no approximate position"))
    return out.withColumn("reason", why).withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("refused")).drop("_end")


# --- vectors -------------------------------------------------------------------------------------

def read_features(spark: SparkSession, path: str, allowed: list[str] | None = None) -> DataFrame:
    """GeoJSON feature collections: one row per feature with its CRS, geometry, anchor and properties text.

    A polygon's anchor is the mean of its ring's vertices, the closing one included.
    """
    schema = "type string, crs struct<properties:struct<name:string>>, features array<struct<type:string,id:string,properties:string,geometry:struct<type:string,coordinates:string>>>"
    doc = spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("file", F.input_file_name())
    code = F.regexp_extract(F.coalesce("crs.properties.name", F.lit("")), "EPSG:+([0-9]+)$", 1)
    rows = doc.select("file", F.coalesce(F.nullif(code, F.lit("")).cast("int"), F.lit(4326)).alias("epsg"), F.posexplode("features").alias("feature_no", "_f"))
    g, c = F.col("_f.geometry.type"), F.col("_f.geometry.coordinates")
    pt = F.from_json(c, "array<double>")
    line = F.from_json(c, "array<array<double>>")
    poly = F.get(F.from_json(c, "array<array<array<double>>>"), F.lit(0))
    multi = F.get(F.get(F.from_json(c, "array<array<array<array<double>>>>"), F.lit(0)), F.lit(0))
    ring = F.when(g == "Point", F.array(pt)).when(g == "LineString", line).when(g.isin("Polygon", "MultiLineString"), poly).when(g == "MultiPolygon", multi)
    ring = F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    out = rows.select("file", "epsg", "feature_no", g.alias("geom_type"), ring.alias("ring"), F.col("_f.properties").alias("properties"))
    mean = lambda part: F.aggregate("ring", F.lit(0.0), lambda a, p: a + p[part]) / F.nullif(F.size("ring"), F.lit(0))
    bad = ~F.col("geom_type").isin(*allowed) if allowed else F.lit(False)
    return (out.withColumn("anchor_x", mean("x")).withColumn("anchor_y", mean("y"))
            .withColumn("reason", F.when(F.col("geom_type").isNull(), "no geometry").when(bad, "geometry type not allowed"))
            .withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("refused")))


def _valid_ring(points: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Boundary vertices to one ring per key: range check, repeated and closing vertices dropped, three at least.

    A hand-drawn boundary is a bounded list.
    """
    g = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("i"), F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("_p"))
    p = F.col("_p")
    same = lambda a, b: (a["x"] == b["x"]) & (a["y"] == b["y"])
    kept = F.filter(p, lambda v, i: (i == 0) | ~same(v, F.coalesce(F.get(F.col("_p"), i - 1), v.withField("x", F.lit(float("nan"))))))
    g = g.withColumn("_k", kept)
    closed = (F.size("_k") > 1) & same(F.element_at("_k", 1), F.element_at("_k", -1))
    ring = F.transform(F.when(closed, F.slice("_k", 1, F.size("_k") - 1)).otherwise(F.col("_k")), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    out = g.withColumn("ring", ring)
    wild = F.exists("ring", lambda v: (F.abs(v["x"]) > 180) | (F.abs(v["y"]) > 90))
    why = F.when(wild, "coordinate out of range").when(F.size("ring") < 3, "fewer than three distinct points")
    return out.withColumn("reason", why).withColumn("status", F.when(why.isNull(), "ok").otherwise("refused")).drop("_p", "_k")


def read_boundary_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv_by_alias(spark, path, {"lon": BOUNDARY_LON, "lat": BOUNDARY_LAT})
    pts = raw.select("file", "row_no", F.col("lon").try_cast("double").alias("lon"), F.col("lat").try_cast("double").alias("lat"))
    rings = _valid_ring(pts.where("lon IS NOT NULL AND lat IS NOT NULL"), ["file"], "row_no")
    files = raw.groupBy("file").agg((F.max("has_lon") & F.max("has_lat")).alias("_h"))
    why = F.when(~F.col("_h"), "no latitude/longitude header").when(F.col("ring").isNull(), "no numeric rows").otherwise(F.col("reason"))
    return (files.join(rings, "file", "left").withColumn("reason", why).withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("refused"))
            .withColumn("ring", F.when(F.col("reason").isNull(), F.col("ring"))).drop("_h"))


def read_boundary_geojson(spark: SparkSession, path: str) -> DataFrame:
    f = read_features(spark, path).where(F.col("geom_type").isin("Polygon", "MultiPolygon", "LineString", "MultiLineString"))
    first = f.groupBy("file").agg(F.min_by("ring", "feature_no").alias("_r"))
    pts = first.select("file", F.posexplode("_r").alias("row_no", "_p")).select("file", "row_no", F.col("_p.x").alias("lon"), F.col("_p.y").alias("lat"))
    return _valid_ring(pts, ["file"], "row_no")


def boundary_summary(rings: DataFrame) -> DataFrame:
    """Vertices, centroid, bounds, area and UTM code of each boundary."""
    from fieldspark.functions.geo import METRES_PER_DEGREE_LAT, METRES_PER_DEGREE_LON, mean_of, shoelace, utm_epsg
    r = F.col("ring")
    out = rings.withColumn("vertices", F.size(r)).withColumn("centroid_lon", mean_of(r, "x")).withColumn("centroid_lat", mean_of(r, "y"))
    xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    out = out.withColumns({"west": F.array_min(xs), "east": F.array_max(xs), "south": F.array_min(ys), "north": F.array_max(ys)})
    sx = F.cos(F.radians(F.col("centroid_lat"))) * METRES_PER_DEGREE_LON
    # measured from the centroid: the same area with less cancellation
    local = F.transform(r, lambda p: F.struct(((p["x"] - F.col("centroid_lon")) * sx).alias("x"), ((p["y"] - F.col("centroid_lat")) * METRES_PER_DEGREE_LAT).alias("y")))
    return (out.withColumn("area_m2", shoelace(local)).withColumn("hectares", F.col("area_m2") / 10_000.0).withColumn("utm_epsg", utm_epsg("centroid_lat", "centroid_lon")))


# --- labels and tiles ----------------------------------------------------------------------------

def read_voc_boxes(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Pascal-VOC annotations as normalised boxes: clamped to the stated size, empty boxes dropped.

    One annotation per file, or one per line of splittable files with ``one_per_line``.
    """
    schema = "filename string, size struct<width:double,height:double>, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
    doc = spark.read.format("xml").option("rowTag", "annotation").option("multiLine", str(not one_per_line).lower()).schema(schema).load(path).withColumn("file", F.input_file_name())
    o = doc.where("size.width > 0 AND size.height > 0").select("file", "filename", "size", F.posexplode("object").alias("object_no", "o"))
    w, h, b = F.col("size.width"), F.col("size.height"), F.col("o.bndbox")
    zero = F.lit(0.0)
    val = lambda c: F.coalesce(b[c], zero)
    x0, x1 = F.greatest(zero, F.least(val("xmin"), val("xmax"))), F.least(w, F.greatest(val("xmin"), val("xmax")))
    y0, y1 = F.greatest(zero, F.least(val("ymin"), val("ymax"))), F.least(h, F.greatest(val("ymin"), val("ymax")))
    ok = b.isNotNull() & (x1 > x0) & (y1 > y0)
    return o.where(ok).select("file", "filename", stem("file").alias("sample_id"), "object_no", F.trim("o.name").alias("class_name"), ((x0 + x1) / 2 / w).alias("cx"), ((y0 + y1) / 2 / h).alias("cy"),
                              ((x1 - x0) / w).alias("bw"), ((y1 - y0) / h).alias("bh"))


def read_yolo_boxes(spark: SparkSession, path: str, local_names: DataFrame) -> DataFrame:
    """YOLO label lines with the class name of their source. ``local_names(source, local_index, class_name)``;
    the source is the folder above ``labels``. Unknown or dropped classes leave the table."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).withColumn("_p", F.split(F.trim("value"), "\\s+")).where(F.size("_p") >= 5)
    v = lambda i: F.get("_p", F.lit(i)).try_cast("double")
    rows = lines.select("file", F.regexp_extract("file", "([^/]+)/labels/[^/]+$", 1).alias("source"), stem("file").alias("sample_id"), v(0).cast("int").alias("local_index"),
                        v(1).alias("cx"), v(2).alias("cy"), v(3).alias("bw"), v(4).alias("bh"))
    named = local_names.where(F.coalesce("class_name", F.lit("")) != "")
    return rows.join(named, ["source", "local_index"])


def merge_class_ids(boxes: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Class ids of the union of names, in name order. Names outside ``allowed`` are dropped."""
    from fieldspark.operators.corpus import merged_class_ids
    kept = boxes.where(F.col("class_name").isin(allowed)) if allowed else boxes
    return kept.join(F.broadcast(merged_class_ids(kept, "class_name")), "class_name")      # a class vocabulary


def index_tiles(files: DataFrame, regions: DataFrame) -> DataFrame:
    """Tile listing (``path``) with region, licence and label path.

    ``regions(alias, region, license)``. A path part that is an alias wins; otherwise the longest alias
    the file stem starts with, when nothing or a digit follows. Labels sit in the ``labels`` twin of ``images``.
    """
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    img = files.where(F.col("path").rlike("[/\\\\]images[/\\\\]")).withColumn("stem", norm(stem("path")))
    parts = F.transform(F.filter(F.split("path", "[/\\\\]"), lambda p: (F.lower(p) != "images") & (p != "")), lambda p: norm(p))
    img = img.withColumn("_parts", F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))))
    alias = regions.select(norm("alias").alias("alias"), "region", "license")
    # equi-joins only: every folder part, and every prefix of the stem, is looked up by value
    part = img.select("path", F.posexplode("_parts").alias("_d", "alias")).join(alias, "alias").groupBy("path").agg(F.min_by(F.struct("region", "license"), "_d").alias("_a"))
    pre = img.select("path", "stem", F.explode(F.sequence(F.lit(1), F.length("stem"))).alias("_n")).withColumn("alias", F.expr("substr(stem, 1, _n)"))
    pre = pre.where((F.col("_n") == F.length("stem")) | F.expr("substr(stem, _n + 1, 1)").rlike("[0-9]")).join(alias, "alias")
    pre = pre.groupBy("path").agg(F.max_by(F.struct("region", "license"), "_n").alias("_b"))
    out = img.select("path").join(part, "path", "left").join(pre, "path", "left").withColumn("_r", F.coalesce("_a", "_b"))
    twin = F.regexp_replace("path", "([/\\\\])images([/\\\\][^/\\\\]*)$", "$1labels$2")
    labels = files.where(F.col("path").rlike("[/\\\\]labels[/\\\\]")).select(F.regexp_replace("path", "\\.[^.]*$", "").alias("_k"), F.col("path").alias("label")).groupBy("_k").agg(F.min("label").alias("label"))
    out = out.withColumn("_k", F.regexp_replace(twin, "\\.[^.]*$", "")).join(labels, "_k", "left")
    return out.select("path", F.col("_r.region").alias("region"), F.col("_r.license").alias("license"), "label",
                      F.when(F.col("_r").isNull(), "unknown_region").when(F.col("label").isNull(), "missing_label").otherwise("ok").alias("status"))


def label_pixel_counts(cells: DataFrame, mapping: dict[int, int]) -> DataFrame:
    """Pixels of each merged class per sample; unmapped ids count as ignored (255)."""
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    new = F.coalesce(F.element_at(F.create_map(*pairs), F.col("class_id")), F.lit(255))
    n = cells.groupBy("sample_id", new.alias("class_id")).agg(F.count(F.lit(1)).alias("pixels"))
    # one entry per class of the mapping: a bounded map
    return n.groupBy("sample_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_id", "pixels")))).alias("class_pixel_counts"))


# --- logs, terrain, clouds, tables -----------------------------------------------------------------

def read_flight_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(schemas.TELEMETRY).json(path)


def read_audit_log(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    df = spark.read.schema(schemas.AUDIT).json(path)
    return df if limit is None else df.orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit)


def read_terrain_csv(spark: SparkSession, path: str) -> DataFrame:
    """Elevation samples under any known header; a bare three-column file is read in order. ``file, x, y, z, geographic``."""
    lines = _lines(spark, path).where(F.trim("line") != "").withColumn("cells", F.split("line", "[,\\t]"))
    head = lines.groupBy("file").agg(F.min_by("cells", "line_no").alias("head"), F.min("line_no").alias("head_no")).withColumn("named", F.exists("head", lambda c: c.rlike("[A-Za-z]")))
    rows = lines.join(head, "file").where(~F.col("named") | (F.col("line_no") > F.col("head_no")))
    tidy = F.transform("head", lambda c: F.translate(F.lower(F.trim(c)), "- ", "__"))
    rows = rows.withColumn("head", tidy)
    pick = lambda names: F.get("cells", _header_index(F.col("head"), names)).try_cast("double")
    bare = lambda i: F.when(~F.col("named"), F.get("cells", F.lit(i)).try_cast("double"))
    world = pick(TERRAIN_ALIASES["lon"]).isNotNull() & pick(TERRAIN_ALIASES["lat"]).isNotNull()
    x = F.coalesce(F.when(world, pick(TERRAIN_ALIASES["lon"])), pick(TERRAIN_ALIASES["x"]), bare(0))
    y = F.coalesce(F.when(world, pick(TERRAIN_ALIASES["lat"])), pick(TERRAIN_ALIASES["y"]), bare(1))
    z = F.coalesce(pick(TERRAIN_ALIASES["z"]), bare(2))
    geo = world | (~F.col("named") & (F.abs(bare(0)) <= 180) & (F.abs(bare(1)) <= 90))
    return (rows.select("file", "line_no", x.alias("x"), y.alias("y"), z.alias("z"), F.coalesce(geo, F.lit(False)).alias("geographic")).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL"))


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """ESRI ASCII grids as cells with the position of their centres; no-data cells are left out."""
    lines = _lines(spark, path).where(F.trim("line") != "").withColumn("_w", F.split(F.trim("line"), "\\s+"))
    key = F.lower(F.get("_w", F.lit(0)))
    names = ("ncols", "nrows", "xllcorner", "xllcenter", "yllcorner", "yllcenter", "cellsize", "nodata_value")
    is_head = key.isin(*names)
    head = lines.where(is_head).groupBy("file").agg(F.max("line_no").alias("_last"), *[F.max(F.when(key == n, F.get("_w", F.lit(1)).try_cast("double"))).alias(n) for n in names])
    head = head.withColumn("x0", F.coalesce("xllcorner", F.col("xllcenter") - F.col("cellsize") / 2)).withColumn("y0", F.coalesce("yllcorner", F.col("yllcenter") - F.col("cellsize") / 2))
    body = lines.join(head, "file").where(F.col("line_no") > F.col("_last"))
    row = F.row_number().over(W.partitionBy("file").orderBy("line_no")) - 1          # rows of one grid file
    cell = body.withColumn("row_idx", row).where(F.col("row_idx") < F.col("nrows")).select("file", "row_idx", "nrows", "x0", "y0", "cellsize", "nodata_value", F.posexplode("_w").alias("col_idx", "_v"))
    v = F.col("_v").try_cast("double")
    keep = v.isNotNull() & ~F.coalesce(F.abs(v - F.col("nodata_value")) <= 1e-8 + 1e-5 * F.abs("nodata_value"), F.lit(False))
    return cell.where(keep).select("file", "row_idx", "col_idx", v.alias("value"), (F.col("x0") + (F.col("col_idx") + 0.5) * F.col("cellsize")).alias("x"),
                                   (F.col("y0") + (F.col("nrows") - 1 - F.col("row_idx") + 0.5) * F.col("cellsize")).alias("y"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Point packets (csv by comma, xyz and txt by blanks); rows without three leading numbers are dropped."""
    raw = spark.read.text(path).withColumn("path", F.input_file_name())
    f = F.when(extension("path") == ".csv", F.split("value", ",")).otherwise(F.split(F.trim("value"), "\\s+"))
    v = lambda i: F.get(f, F.lit(i)).try_cast("double")
    return raw.select("path", v(0).alias("x"), v(1).alias("y"), v(2).alias("z")).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")


def read_table(spark: SparkSession, url: str, table: str, *, key: str, lower: int, upper: int, partitions: int, properties: dict | None = None) -> DataFrame:
    """Partitioned scan of a relational table."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=properties or {})
