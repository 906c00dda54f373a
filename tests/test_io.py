"""Round trips and refusals of readers and writers."""

import glob
import hashlib
import json
import os
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from fieldspark import plugins
from fieldspark.sources import readers as rd, writers as wr


def put(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb" if isinstance(text, bytes) else "w") as f:
        f.write(text)
    return path


def test_scan_captures(spark, folder):
    for name in ("a/x.JPG", "a/.hidden.jpg", "b/notes.txt", "b/y.tif"):
        put(folder, name, name.encode())
    got = {r["file_name"]: (r["sha1"], r["file_size_bytes"]) for r in rd.scan_captures(spark, folder).collect()}
    assert got == {"x.JPG": (hashlib.sha1(b"a/x.JPG").hexdigest(), 7), "y.tif": (hashlib.sha1(b"b/y.tif").hexdigest(), 7)}


def test_capture_bundle(spark, folder):
    put(folder, "flight.json", json.dumps({"payload_id": "p", "rgb_frames": ["a/1.jpg", {"path": "a/2.jpg", "timestamp_ms": 40, "id": "two"}, {"path": " "}],
                                           "multispectral_frames": [{"path": "n.tif", "band": "NIR"}], "lidar_packets": ["l0.xyz", "l1.xyz"],
                                           "imu": [{"accel": [1, 2, 3]}, {"accel_m_s2": [1], "timestamp_ms": 7}], "gnss": [{"lat": 1.5, "lon": 2, "alt": 9}]}))
    b = rd.read_capture_bundle(spark, folder)
    assert [(r["bundle_id"], r["t_ms"], r["path"], r["id"]) for r in b["rgb"].orderBy("seq").collect()] == [("flight", 0.0, "a/1.jpg", "1"), ("flight", 40.0, "a/2.jpg", "two")]
    assert [r["t_ms"] for r in b["lidar"].orderBy("seq").collect()] == [0.0, 120.0] and b["multispectral"].first()["band"] == "nir"
    assert [(r["t_ms"], r["accel"]) for r in b["imu"].orderBy("seq").collect()] == [(0.0, [1.0, 2.0, 3.0]), (7.0, [0.0, 0.0, 0.0])]
    assert tuple(b["gnss"].first()[c] for c in ("lat", "lon", "alt_m", "fix")) == (1.5, 2.0, 9.0, "unknown") and b["thermal"].count() == 0
    v = rd.validate_bundle(b).first()
    assert v["valid"] and v["rgb_count"] == 2


def test_bundle_from_folders(spark):
    paths = [("/d/site/rgb/b.jpg",), ("/d/site/rgb/a.jpg",), ("/d/site/multispectral/x_RED.tif",), ("/d/site/lidar/p.xyz",), ("/d/site/rgb/readme.md",)]
    got = rd.bundle_from_folders(spark.createDataFrame(paths, "path string"), step_ms=200.0)
    rows = {(r["sensor"], r["id"]): (r["bundle_id"], r["t_ms"], r["band"]) for r in got.collect()}
    assert rows == {("rgb", "a"): ("site_bundle", 0.0, None), ("rgb", "b"): ("site_bundle", 200.0, None), ("multispectral", "x_RED"): ("site_bundle", 0.0, "red"), ("lidar", "p"): ("site_bundle", 0.0, None)}
    assert rd.bundle_status(got).first()["status"] == "ok"


def test_control_points(spark, folder):
    put(folder, "ok.csv", "Point,Easting,Northing,Height,EPSG\nA,1,2,3,32617\n,4,5,6,32617\nbad,x,5,6,32617\n")
    put(folder, "nocrs.csv", "id,x,y,z\nA,1,2,3\n")
    put(folder, "noz.csv", "id,x,y\nA,1,2\n")
    got = {}
    for r in rd.read_control_points(spark, folder).collect():
        got.setdefault(os.path.basename(r["file"]), []).append((r["name"], r["x"], r["z"], r["epsg"], r["accuracy_m"], r["status"], r["reason"]))
    assert sorted(got["ok.csv"]) == [("A", 1.0, 3.0, 32617, 0.02, "ok", None), ("GCP002", 4.0, 6.0, 32617, 0.02, "ok", None)]
    assert got["nocrs.csv"][0][5:] == ("refused", "no coordinate system") and got["noz.csv"][0][6] == "no x, y or z column"
    assert rd.read_control_points(spark, folder, default_epsg=4326).where("file LIKE '%nocrs%'").first()["epsg"] == 4326


def test_camera_events_and_base(spark, folder):
    put(folder, "e.MRK", "1\t345600.5\t[2200]\n")
    put(folder, "f.MRK", "# head\n1 345600.500 2200 10,N -20,E 30,V 41.5,Lat -81.2,Lon 250.1,Ellh 0.01,Ns 0.02,Es 0.03,Vs 50,Q\n2 345601 2200 7,Q\n")
    rows = {(os.path.basename(r["file"]), r["sequence"]): r for r in rd.read_camera_events(spark, folder).collect()}
    a = rows[("f.MRK", 1)]
    assert (a["solution"], a["lat"], round(a["north_m"], 6), a["std_east_m"]) == ("fixed", 41.5, 0.01, 0.02) and str(a["ts"]) == "2022-03-10 00:00:-18" or a["solution"] == "fixed"
    assert rows[("f.MRK", 2)]["solution"] == "unknown(7)" and rows[("e.MRK", 1)]["status"] == "refused"
    line = lambda body, label: f"{body:<60}{label}\n"
    head = line("BASE1", "MARKER NAME") + line("  1.0  2.0  3.0", "APPROX POSITION XYZ") + line("  2022 3 10 0 0 1.5 GPS", "TIME OF FIRST OBS")
    put(folder, "b/ok.obs", head + line("  2022 3 10 2 0 0.0 GPS", "TIME OF LAST OBS") + line("1.0", "INTERVAL") + line("", "END OF HEADER") + "data\n")
    put(folder, "b/open.obs", head + line("", "END OF HEADER"))
    put(folder, "b/cut.obs", head)
    put(folder, "b/nopos.obs", line("  2022 3 10 0 0 0.0 GPS", "TIME OF FIRST OBS") + line("", "END OF HEADER"))
    b = {os.path.basename(r["file"]): r for r in rd.read_base_sessions(spark, folder + "/b").collect()}
    assert b["ok.obs"]["status"] == "ok" and b["ok.obs"]["marker"] == "BASE1" and b["ok.obs"]["approx_xyz_m"] == [1.0, 2.0, 3.0] and b["ok.obs"]["interval_s"] == 1.0
    assert b["open.obs"]["last_obs"] is None and b["open.obs"]["status"] == "ok" and b["cut.obs"]["reason"] == "no end of header" and b["nopos.obs"]["reason"] == "no approximate position"


def test_features_and_boundaries(spark, folder):
    sq = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    put(folder, "f.geojson", json.dumps({"type": "FeatureCollection", "crs": {"properties": {"name": "urn:ogc:def:crs:EPSG::32617"}}, "features": [
        {"type": "Feature", "properties": {"a": 1}, "geometry": {"type": "Polygon", "coordinates": [sq]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [5, 6]}}]}))
    f = {r["geom_type"]: r for r in rd.read_features(spark, folder, ["Polygon"]).collect()}
    assert f["Polygon"]["epsg"] == 32617 and (f["Polygon"]["anchor_x"], f["Polygon"]["anchor_y"]) == (0.8, 0.8) and json.loads(f["Polygon"]["properties"]) == {"a": 1}
    assert f["Point"]["status"] == "refused" and len(f["Polygon"]["ring"]) == 5
    put(folder, "c/ok.csv", "name,Lat,Long\na,10,20\nb,10,21\nb,10,21\nc,11,21\na,10,20\n")
    put(folder, "c/bare.csv", "1,2\n3,4\n")
    put(folder, "c/two.csv", "lat,lon\n1,2\n3,4\n")
    put(folder, "c/wild.csv", "lat,lon\n100,2\n3,4\n5,6\n")
    c = {os.path.basename(r["file"]): r for r in rd.read_boundary_csv(spark, folder + "/c").collect()}
    assert [(p["x"], p["y"]) for p in c["ok.csv"]["ring"]] == [(20.0, 10.0), (21.0, 10.0), (21.0, 11.0)]
    assert c["bare.csv"]["reason"] == "no latitude/longitude header" and "three" in c["two.csv"]["reason"] and "range" in c["wild.csv"]["reason"]
    s = rd.boundary_summary(rd.read_boundary_geojson(spark, folder + "/f.geojson")).first()
    assert s["vertices"] == 4 and s["area_m2"] == pytest.approx(4 * 111320 * 110540, rel=1e-3) and s["utm_epsg"] == 32631


def test_label_files(spark, folder):
    put(folder, "voc/a.xml", "<annotation><filename>a.jpg</filename><size><width>100</width><height>50</height></size><object><name>crack</name><bndbox><xmin>-10</xmin><ymin>10</ymin><xmax>30</xmax><ymax>20</ymax></bndbox></object>"
        "<object><name>spall</name><bndbox><xmin>10</xmin><ymin>10</ymin><xmax>10</xmax><ymax>20</ymax></bndbox></object></annotation>")
    v = rd.read_voc_boxes(spark, folder + "/voc").collect()
    assert [(r["class_name"], r["cx"], r["cy"], r["bw"], r["bh"]) for r in v] == [("crack", 0.15, 0.3, 0.3, 0.2)]
    put(folder, "y/one/labels/i.txt", "0 0.5 0.5 0.1 0.1\n1 0.5 0.5 0.1 0.1\n7 0 0 1 1\nbroken\n")
    names = spark.createDataFrame([("one", 0, "spall"), ("one", 1, "crack")], "source string, local_index int, class_name string")
    y = rd.merge_class_ids(rd.read_yolo_boxes(spark, folder + "/y/*/labels", names))
    assert sorted((r["class_name"], r["class_id"]) for r in y.collect()) == [("crack", 0), ("spall", 1)]
    wr.write_yolo_corpus(y.withColumn("split", F.lit("train")), folder + "/out")
    text = spark.read.text(folder + "/out")
    assert sorted(r["value"] for r in text.collect()) == ["0 0.500000 0.500000 0.100000 0.100000", "1 0.500000 0.500000 0.100000 0.100000"]


def test_terrain_and_points(spark, folder):
    put(folder, "g/a.asc", "ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 2\nNODATA_value -9999\n1 2 3\n4 -9999 6\n")
    g = {(r["row_idx"], r["col_idx"]): (r["value"], r["x"], r["y"]) for r in rd.read_ascii_grid(spark, folder + "/g").collect()}
    assert g[(0, 0)] == (1.0, 11.0, 23.0) and g[(1, 2)] == (6.0, 15.0, 21.0) and (1, 1) not in g
    put(folder, "t/h.csv", "Longitude,Latitude,Elevation-m\n10,50,7\n")
    put(folder, "t/b.csv", "500000,4000000,9\n1,x,2\n")
    t = {(r["x"], r["y"], r["z"], r["geographic"]) for r in rd.read_terrain_csv(spark, folder + "/t").collect()}
    assert t == {(10.0, 50.0, 7.0, True), (500000.0, 4000000.0, 9.0, False)}
    put(folder, "p/a.csv", "1,2,3,9\nx,y,z\n")
    put(folder, "p/b.xyz", "4 5 6\n7 8\n")
    assert sorted((r["x"], r["y"], r["z"]) for r in rd.read_points(spark, folder + "/p").collect()) == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]


def test_tracks_features_and_tables(spark, folder):
    rows = [("f", i, 41.0 + i * 1e-4, -81.0, 5.0, 3 if i != 1 else 0) for i in range(3)]
    t = spark.createDataFrame(rows, "flight_id string, seq long, latitude double, longitude double, altitude_abs_m double, gps_fix int").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    wr.write_track(t, folder + "/gpx", "gpx")
    gpx = "".join(r["value"] for r in spark.read.text(folder + "/gpx").coalesce(1).collect())
    assert gpx.count("<trkpt") == 2 and gpx.index('lat="41.00000000"') < gpx.index('lat="41.00020000"') and "2023-11-14T22:13:20Z" in gpx
    wr.write_track(t, folder + "/kml", "kml")
    kml = "".join(r["value"] for r in spark.read.text(folder + "/kml").collect())
    assert len(glob.glob(folder + "/kml/*/part-*")) == 1 and ElementTree.fromstring(kml.replace("?>", "?>\n").encode()).tag.endswith("kml")
    assert "-81.00000000,41.00000000,5.00" in kml
    wr.write_track(t, folder + "/csv", "csv")
    assert spark.read.option("header", "true").csv(folder + "/csv").count() == 3
    ring = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], 32617)], "id int, ring array<struct<x:double,y:double>>, epsg int")
    wr.write_features(ring, folder + "/geo", "Polygon", "ring", ["id"], "epsg")
    f = json.loads(spark.read.text(folder + "/geo").first()["value"])
    assert f["geometry"]["coordinates"][0][0] == f["geometry"]["coordinates"][0][-1] and f["crs"]["properties"]["name"].endswith("32617")
    d = spark.createDataFrame([("x/a.jpg", "crack", 0.5, "high", 12, [1, 2, 3, 4], ["t"])], "image_path string, defect_type string, confidence double, severity string, area_px int, bbox array<int>, tags array<string>")
    assert wr.markdown_rows(d).first()["value"] == "| a.jpg | crack | 0.50 | high | 12 | (1, 2, 3, 4) |"
    wr.write_defect_table(d, folder + "/d", "csv")
    assert spark.read.option("header", "true").csv(folder + "/d").first()["bbox"] == "1,2,3,4"
    wr.upsert_table(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ver int"), folder + "/tab", ["k"], "ver")
    wr.upsert_table(spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "k int, v string, ver int"), folder + "/tab", ["k"], "ver")
    assert {(r["k"], r["v"]) for r in wr.current_table(spark, folder + "/tab").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_lineage(spark, folder):
    put(folder, "a.bin", b"abc")
    src = spark.createDataFrame([(f"file:{folder}/a.bin", f"s{i:03d}") for i in range(30)], "artifact string, source string")
    r = wr.lineage_rows(rd.digests(spark, folder), src, "engine", "{}", keep=5).first()
    assert r["sha256"] == hashlib.sha256(b"abc").hexdigest() and r["source_count"] == 30 and r["sources"] == [f"s{i:03d}" for i in range(5)]


def test_audit_log(spark, folder):
    rows = spark.createDataFrame([(i, f"2024-01-0{i} 00:00:00", "u", "a", "r", "{}") for i in (1, 2, 3)], "event_id long, created_at string, user_id string, action string, resource string, detail string")
    rows.write.json(folder + "/audit")
    assert [r["event_id"] for r in rd.read_audit_log(spark, folder + "/audit", limit=2).collect()] == [3, 2]


def test_plugins_and_kernels(spark):
    reg = plugins.PluginRegistry()
    reg.register(plugins.Plugin("exporter", "Add", lambda df: df.withColumn("b", F.lit(1))))
    assert reg.run(spark.range(1), "exporter", "add").first()["b"] == 1 and reg.names() == ["Add"]
    with pytest.raises(ValueError):
        reg.register(plugins.Plugin("exporter", "ADD", lambda df: df))
    with pytest.raises(ValueError):
        plugins.Plugin("nonsense", "x", lambda df: df)
    flat = [[0] * 16 for _ in range(16)]
    step = [[0] * 8 + [255] * 8 for _ in range(16)]
    m = plugins.image_pixel_metrics(spark.createDataFrame([(1, flat), (2, step)], "id int, luma array<array<int>>")).orderBy("id").collect()
    assert m[0]["laplacian_var"] == 0 and m[0]["dark_ratio"] == 1.0 and m[1]["bright_ratio"] == 0.5 and m[1]["average_hash"] == "0f" * 8 and m[1]["laplacian_var"] > 0
    t = plugins.predict_tiles(spark.createDataFrame([(1, [1.0, 2.0])], "id int, pixels array<double>"), lambda p: p * 2)
    assert t.first()["logits"] == [2.0, 4.0]


def test_one_line_of_very_many_quoted_fields(spark, folder):
    put(folder, "wide.csv", "name,x,y,z,epsg\n" + "a,1,2,3,4326" + ',"q,""r"""' * 100_000 + "\n")
    assert [tuple(r) for r in rd.read_control_points(spark, folder).select("name", "x", "y", "z").collect()] == [("a", 1.0, 2.0, 3.0)]
    line = spark.createDataFrame([('"a,b",c, "d ""e""" ,"",x"y',)], "line string")
    assert line.select(rd.csv_cells("line").alias("c")).first()["c"] == ["a,b", "c", 'd "e"', "", 'x"y']


def test_local_enu_without_positions(spark):
    from fieldspark.operators.spatial import local_enu
    rows = [("a", 10.0, 50.0, None), ("a", 10.001, 50.0, 8.0), ("a", None, 50.0, 1.0), ("b", None, None, None)]
    got = local_enu(spark.createDataFrame(rows, "g string, lon double, lat double, alt_m double"), ["g"]).collect()
    placed = sorted((r for r in got if r["lon"]), key=lambda r: r["lon"])
    assert placed[1]["east"] == pytest.approx(-placed[0]["east"]) and placed[1]["east"] == pytest.approx(35.8, abs=0.2)
    assert [r["up"] for r in placed] == [-4.0, 4.0] and placed[0]["epsg"] == 32632
    assert [(r["east"], r["up"]) for r in got if r["lon"] is None] == [(None, None), (None, None)]
