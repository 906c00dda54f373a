"""Writers: tables, exports, tracks, features and label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldspark.functions.bands import has_fix
from fieldspark.functions.text import base_name


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "error") -> None:
    """CSV with a header; arrays become comma-joined text."""
    types = dict(df.dtypes)
    flat = [F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c) if types[c].startswith("array") else F.col(c) for c in columns]
    df.select(*flat).write.mode(mode).option("header", "true").option("escape", '"').csv(path)


def write_manifest(images: DataFrame, path: str, fmt: str = "csv", mode: str = "error") -> None:
    cols = [c for c in ("image_id", "file_path", "width", "height", "gps_lat", "gps_lon", "altitude_m", "captured_at", "camera_make", "camera_model", "iso", "exposure_s",
                        "focal_length_mm", "file_size_bytes", "sha1", "qa_flags", "tags") if c in images.columns]
    ordered = images.sort("file_path") if "file_path" in images.columns else images
    if fmt == "json":
        ordered.select(*cols).write.mode(mode).json(path)
    else:
        write_csv(ordered, path, cols, mode)


def write_defect_table(defects: DataFrame, path: str, fmt: str = "csv", mode: str = "error") -> None:
    """CSV, JSON lines, or markdown table rows."""
    if fmt == "json":
        defects.write.mode(mode).json(path)
    elif fmt in ("md", "markdown"):
        markdown_rows(defects).write.mode(mode).text(path)
    else:
        write_csv(defects, path, defects.columns, mode)


def markdown_rows(defects: DataFrame) -> DataFrame:
    """Body rows of the markdown table; its two heading lines are fixed text."""
    c = F.col
    box = F.array_join(F.transform("bbox", lambda v: v.cast("string")), ", ")
    return defects.select(F.format_string("| %s | %s | %.2f | %s | %s | (%s) |", base_name("image_path"), c("defect_type"), c("confidence"), c("severity"), c("area_px").cast("string"), box).alias("value"))


# The two heading lines of the table.
MARKDOWN_HEAD = ("| Image | Type | Confidence | Severity | Area px | bbox |", "|---|---|---:|---|---:|---|")


def write_measurements(rows: DataFrame, path: str, fmt: str = "csv", mode: str = "error") -> None:
    out = rows.withColumn("value", F.bround("value", 6))
    out.write.mode(mode).json(path) if fmt == "json" else write_csv(out, path, out.columns, mode)


def write_annotations(rows: DataFrame, path: str, fmt: str = "json", mode: str = "error") -> None:
    rows.write.mode(mode).json(path) if fmt == "json" else write_csv(rows, path, [c for c, t in rows.dtypes if not t.startswith(("struct", "map"))], mode)


# --- tracks --------------------------------------------------------------------------------------

def xml_text(value: Column) -> Column:
    """Text as it stands in XML."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(sign), F.lit(name))
    return value


def track_lines(telemetry: DataFrame, fmt: str, key: str = "flight_id", name: str | None = None, creator: str = "fieldspark") -> DataFrame:
    """Text of a GPX or KML track as one line per element, in order: ``flight, part, ts, seq, line``.

    Only positioned samples appear. ``name`` is a column with the flight's title, else its key is. ``satellites`` and ``hdop``
    are written where the table has them.
    """
    pts = telemetry.where(has_fix())
    lat, lon = F.format_string("%.8f", F.col("latitude")), F.format_string("%.8f", F.col("longitude"))
    alt = F.format_string("%.2f", F.coalesce("altitude_abs_m", F.lit(0.0)))
    flights = telemetry.groupBy(key).agg(F.min(name or key).cast("string").alias("_name"))
    title = F.concat(F.lit("<name>"), xml_text(F.coalesce("_name", F.lit("Flight"))), F.lit("</name>"))
    head = F.lit('<?xml version="1.0" encoding="UTF-8"?>')
    if fmt == "gpx":
        extra = [F.concat(F.lit("<sat>"), F.coalesce(F.col("satellites").cast("string"), F.lit("0")), F.lit("</sat>"))] if "satellites" in telemetry.columns else []
        extra += [F.concat(F.lit("<hdop>"), F.format_string("%.2f", F.coalesce(F.col("hdop").cast("double"), F.lit(0.0))), F.lit("</hdop>"))] if "hdop" in telemetry.columns else []
        start = F.concat(head, F.lit(f'<gpx version="1.1" creator="{creator}" xmlns="http://www.topografix.com/GPX/1/1"><metadata>'), title, F.lit("</metadata><trk>"), title, F.lit("<trkseg>"))
        body = F.concat(F.lit('<trkpt lat="'), lat, F.lit('" lon="'), lon, F.lit('"><ele>'), alt, F.lit("</ele><time>"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
                        F.lit("</time>"), *extra, F.lit("</trkpt>"))
        stop = F.lit("</trkseg></trk></gpx>")
    elif fmt == "kml":
        start = F.concat(head, F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Document>'), title, F.lit("<Placemark>"), title,
                         F.lit("<LineString><extrude>0</extrude><altitudeMode>absolute</altitudeMode><coordinates>"))
        body = F.concat_ws(",", lon, lat, alt)
        stop = F.lit("</coordinates></LineString></Placemark></Document></kml>")
    else:
        raise ValueError("fmt must be gpx or kml")
    none = F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("seq")
    return (flights.select(key, F.lit(0).alias("part"), *none, start.alias("line"))
            .unionByName(pts.select(key, F.lit(1).alias("part"), "ts", "seq", body.alias("line")))
            .unionByName(flights.select(key, F.lit(2).alias("part"), *none, stop.alias("line"))))


def track_json_lines(telemetry: DataFrame, key: str = "flight_id") -> DataFrame:
    """Lines of one JSON document per flight: its summary, then all samples with their elapsed seconds."""
    from fieldspark.operators.flights import elapsed, flight_summary
    from fieldspark.operators.ordered import time_chunk, with_row_number
    about = [c for c in ("aircraft", "pilot", "mission_name") if c in telemetry.columns]
    known = telemetry.groupBy(key).agg(*[F.min(c).alias(c) for c in about], F.count(F.lit(1)).alias("_n")).drop("_n")
    s = flight_summary(telemetry, key=key).join(known, key)
    body = F.struct(F.col("samples").alias("sample_count"), F.col("positioned").alias("positioned_samples"), (F.col("samples") - F.col("positioned")).alias("samples_without_fix"),
                    F.bround("duration_s", 1).alias("duration_s"), F.bround("distance_m", 1).alias("distance_m"), F.bround("max_altitude_m", 1).alias("max_altitude_rel_m"),
                    F.col("battery_first").alias("battery_start_pct"), F.col("battery_last").alias("battery_end_pct"), *about)
    as_json = lambda row: F.to_json(row, {"ignoreNullFields": "false"})
    none = F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("seq")
    rows = with_row_number(elapsed(telemetry, key), [key], ["ts", "seq"], [time_chunk("ts")], "_no")
    comma = F.when(F.col("_no") > 1, ",").otherwise("")
    return (s.select(key, F.lit(0).alias("part"), *none, F.concat(F.lit('{"summary":'), as_json(body), F.lit(',"samples":[')).alias("line"), F.lit(0).cast("long").alias("no"))
            .unionByName(rows.select(key, F.lit(1).alias("part"), "ts", "seq", F.concat(comma, as_json(F.struct(*[c for c in rows.columns if c not in (key, "_no")]))).alias("line"), F.col("_no").alias("no")))
            .unionByName(s.select(key, F.lit(2).alias("part"), *none, F.lit("]}").alias("line"), F.lit(0).cast("long").alias("no"))))


def write_track(telemetry: DataFrame, path: str, fmt: str, key: str = "flight_id", mode: str = "error", name: str | None = None) -> None:
    """One valid document per flight, in a folder of its own: all samples as CSV or as JSON with a summary, positioned ones as
    GPX or KML.

    A document has one writer, so a flight is one task's; it is sorted outside memory and written line by line.
    """
    if fmt == "csv":
        telemetry.repartition(key).sortWithinPartitions(key, "ts", "seq").write.mode(mode).partitionBy(key).option("header", "true").csv(path)
        return
    lines = track_json_lines(telemetry, key) if fmt == "json" else track_lines(telemetry, fmt, key, name)
    order = [key, "part", "no"] if fmt == "json" else [key, "part", "ts", "seq"]
    # what a task costs is its documents, not its bytes, so partitions are not merged by size
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartition(parts, key).sortWithinPartitions(*order).select(key, F.col("line").alias("value")).write.mode(mode).partitionBy(key).text(path)


# --- features ------------------------------------------------------------------------------------

def feature_json(geom_type: str, ring: str, properties: list[str], epsg: str | None = None) -> Column:
    """One GeoJSON feature as text. Polygons are closed when open; a CRS other than WGS84 is named."""
    r = F.col(ring)
    xy = lambda a: F.transform(a, lambda p: F.array(p["x"], p["y"]))
    if geom_type == "Polygon":
        open_ = (F.element_at(r, 1)["x"] != F.element_at(r, -1)["x"]) | (F.element_at(r, 1)["y"] != F.element_at(r, -1)["y"])
        coords = F.array(xy(F.when(open_, F.concat(r, F.slice(r, 1, 1))).otherwise(r)))
    elif geom_type == "LineString":
        coords = xy(r)
    elif geom_type == "Point":
        coords = F.array(F.element_at(r, 1)["x"], F.element_at(r, 1)["y"])
    else:
        raise ValueError("geometry must be Point, LineString or Polygon")
    crs = F.when(F.col(epsg) != 4326, F.struct(F.lit("name").alias("type"), F.struct(F.concat(F.lit("urn:ogc:def:crs:EPSG::"), F.col(epsg).cast("string")).alias("name")).alias("properties"))) if epsg else F.lit(None)
    parts = [F.lit("Feature").alias("type"), F.struct(F.lit(geom_type).alias("type"), coords.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")]
    return F.to_json(F.struct(*parts, *([crs.alias("crs")] if epsg else [])))


def write_features(df: DataFrame, path: str, geom_type: str, ring: str, properties: list[str], epsg: str | None = None, mode: str = "error") -> None:
    """One feature per line, so the layer splits and appends."""
    df.select(feature_json(geom_type, ring, properties, epsg).alias("value")).write.mode(mode).text(path)


# --- corpora, lineage, tables ----------------------------------------------------------------------

def yolo_lines(boxes: DataFrame) -> DataFrame:
    return boxes.select("split", "sample_id", F.format_string("%d %.6f %.6f %.6f %.6f", F.col("class_id").cast("int"), "cx", "cy", "bw", "bh").alias("value"))


def write_yolo_corpus(boxes: DataFrame, path: str, mode: str = "error") -> None:
    """Label lines per split and image. Image bytes are not copied."""
    yolo_lines(boxes).repartition("split", "sample_id").write.mode(mode).partitionBy("split", "sample_id").text(path)


def write_corpus_manifest(samples: DataFrame, counts: DataFrame, path: str, mode: str = "error") -> None:
    samples.sort("split", "source", "site_id", F.coalesce("capture_date", F.lit("")), "id").write.mode(mode).json(f"{path}/samples")
    counts.write.mode(mode).json(f"{path}/counts")


def lineage_rows(artifacts: DataFrame, sources: DataFrame, engine: str, parameters: str, keep: int) -> DataFrame:
    """One row per artifact: digest, size, true source count and its first ``keep`` sources by name.

    The listed sources are the record's own limit; the count covers all of them.
    """
    n = sources.groupBy("artifact").agg(F.count(F.lit(1)).alias("source_count"))
    # the first names by a two-level top-k: each hash slice keeps its own first, then the slices meet
    part = W.partitionBy("artifact", F.pmod(F.xxhash64("source"), F.lit(64))).orderBy("source")
    few = sources.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= keep).drop("_n")
    few = few.withColumn("_n", F.row_number().over(W.partitionBy("artifact").orderBy("source"))).where(F.col("_n") <= keep)
    first = few.groupBy("artifact").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    a = artifacts.select(F.col("path").alias("artifact"), "sha256", "size_bytes")
    return (a.join(n, "artifact", "left").join(first, "artifact", "left").na.fill(0, ["source_count"])
            .withColumn("engine", F.lit(engine)).withColumn("parameters", F.lit(parameters)))


def append_table(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def upsert_table(new: DataFrame, path: str, key: list[str], version: str) -> None:
    """Latest row per key of the stored table and ``new``, written beside the table; a pointer row names the live folder.

    The stored version is never overwritten while it is read. Only a table without any pointer counts as new; columns that
    cannot be merged raise and leave the stored table as it is.
    """
    number, live = _pointer(new.sparkSession, path)
    both = new if live is None else new.sparkSession.read.parquet(f"{path}/{live}").unionByName(new, allowMissingColumns=True)
    spark = new.sparkSession
    cols = [c for c in both.columns if c not in key]
    merged = both.groupBy(*key).agg(F.max_by(F.struct(*cols), F.col(version)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in cols])
    import uuid
    folder = f"v-{uuid.uuid4().hex}"
    merged.write.parquet(f"{path}/{folder}")
    spark.createDataFrame([(folder, number + 1)], "folder string, number long").coalesce(1).write.mode("append").parquet(f"{path}/_live")


def _pointer(spark, path: str) -> tuple[int, str | None]:
    """Number and folder of the live version; 0 and None before the first."""
    from pyspark.errors import AnalysisException
    try:
        named = spark.read.schema("folder string, number long").parquet(f"{path}/_live")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, None
    last = named.agg(F.max(F.struct("number", "folder")).alias("_p")).first()["_p"]
    return (last["number"], last["folder"]) if last else (0, None)


def current_table(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{_pointer(spark, path)[1]}")
