"""Steps whose cost must follow the input: no side by way of the driver, no pair of copies twice."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@contextmanager
def no_broadcast(spark):
    """Every broadcast of more than a few rows fails."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1k")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.mark.parametrize("name", ["match_captures", "capture_statuses", "pose_priors", "remaining_captures", "defect_epochs", "mesh_closure_volume"])
def test_growing_sides_stay_off_the_driver(spark, name):
    with no_broadcast(spark):
        assert entry.queries()[name](spark, SMALL).count() > 0


def test_growing_sides_of_reports_stay_off_the_driver(spark):
    from fieldspark.operators.capture import deviation
    from fieldspark.plans.captures import matches
    from fieldspark.session import cut
    with no_broadcast(spark):
        assert entry.queries()["defect_epoch_counts"](spark, SMALL).count() > 0
        pairs = cut(matches(spark, SMALL))
    assert deviation(pairs).count() > 0  # what meets here has a row per mission


def test_deviation_stays_off_the_driver(spark):
    """Neither the pairs nor what each mission has is broadcast, and no report but the one of altitudes meets plan and images again."""
    from fieldspark.plans.captures import matches
    pairs = matches(spark, SMALL)
    assert "Join" not in pairs._jdf.queryExecution().analyzed().toString()
    with no_broadcast(spark):
        assert entry.queries()["capture_deviation"](spark, SMALL).count() > 0


def test_copies_of_tiles_and_areas_fold(spark):
    """A crowd of equal tiles and areas meets once; pairs of copies (4 * 10^8 here) would not end."""
    from fieldspark.operators import spatial
    areas = spark.range(20_000).selectExpr("id AS area_id", "0.1D AS west", "0.1D AS south", "0.5D AS east", "0.5D AS north")
    tiles = spark.range(20_000).selectExpr("id AS tile_seq", "concat('t', id) AS tile_id", "0D AS west", "0D AS south", "1D AS east", "1D AS north", "id > 6 AS present")
    out = spatial.tile_covers_area(areas, tiles)
    assert "Deduplicate [_w" in out._jdf.queryExecution().analyzed().toString()
    assert [tuple(r) for r in out.select("tile_id", "status").distinct().collect()] == [("t7", "covered")] and out.count() == 20_000


def test_points_of_one_place_share_their_elevation(spark):
    """Points and samples fold by place, so 10^5 points over 10^4 samples of few places end."""
    from fieldspark.operators import spatial
    points = spark.range(100_000).selectExpr("id AS pid", "1 AS site", "CAST(id % 3 AS DOUBLE) AS x", "0D AS y")
    samples = spark.range(10_000).selectExpr("1 AS site", "CAST(id % 2 * 10 AS DOUBLE) AS x", "0D AS y", "CAST(id % 2 * 100 AS DOUBLE) AS z")
    out = spatial.idw_at_points(points, samples, ["site"], "pid")
    assert "Deduplicate [site" in out._jdf.queryExecution().analyzed().toString()
    got = {r["x"]: round(r["elevation_m"], 6) for r in out.groupBy("x").agg(F.max("elevation_m").alias("elevation_m"), F.min("elevation_m").alias("low")).where("elevation_m = low").collect()}
    assert got == {x: round(100 / (10 - x) / (1 / max(x, 0.25) + 1 / (10 - x)), 6) for x in (0, 1, 2)}


def test_deliveries_are_counted_before_they_meet_subscriptions(spark):
    from fieldspark.streaming import flows
    events = spark.range(60).selectExpr("id AS event_id", "id % 2 AS org_id", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS event")
    hooks = spark.createDataFrame([(1, 0, ["a", "b", "a"], True), (2, 0, ["a"], True), (3, 1, ["b"], False), (4, 1, ["b"], True)], "webhook_id long, org_id long, events array<string>, active boolean")
    got = {(r["webhook_id"], r["event"]): r["deliveries"] for r in flows.route_counts(events, hooks).collect()}
    rows = {(r["webhook_id"], r["event"]): r["count"] for r in flows.route(events, hooks).groupBy("webhook_id", "event").count().collect()}
    assert got == rows and len(got) == 4


@pytest.fixture(scope="session")
def level(spark):
    """The given tables with one quantity in all line items: a surface of one height."""
    import os
    import tempfile
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name in os.listdir(SMALL):
        if name != "lineitem.parquet":
            os.symlink(f"{SMALL}/{name}", f"{folder}/{name}")
    spark.read.parquet(f"{SMALL}/lineitem.parquet").withColumn("l_quantity", F.lit(50.0)).write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", ["display_legend", "display_range", "slope_stats"])
def test_level_surface_equals_sql(spark, level, name):
    import duckdb

    from check import rows_of
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{level}/lineitem.parquet/*.parquet'")
    got = entry.queries()[name](spark, level).toPandas()
    assert rows_of(got) == rows_of(con.execute(entry.oracle_sql()[name]).df()) and len(got) > 0


@pytest.fixture(scope="session")
def flat(spark):
    """The given tables with one quantity in most line items: bands without variation, and some cells that deviate."""
    import tempfile
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.read.parquet(f"{SMALL}/lineitem.parquet").withColumn("l_quantity", F.when(F.col("l_orderkey") % 64 < 3, F.col("l_quantity")).otherwise(50.0)).write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", ["anomaly_scores", "anomaly_candidates"])
def test_bands_without_variation_equal_sql(spark, flat, name):
    """Scores are infinite or not a number, as the SQL's division by a scale of 0; null stays apart from not a number."""
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{flat}/lineitem.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    rows = lambda found: sorted(tuple(repr(v) for v in r) for r in found)
    got = rows(entry.queries()[name](spark, flat).select(*names).collect())
    assert got == rows(want.fetchall()) and any("nan" in r for r in got)
    assert name != "anomaly_scores" or any("inf" in r for r in got)


def test_refused_baseline_scores_null(spark):
    """The operator keeps the reference's refusal."""
    from fieldspark.operators import thermal
    pixels = spark.range(40).selectExpr("1 AS site", "id AS cell", "'b' AS band", "CASE WHEN id = 7 THEN 9D ELSE 5D END AS v", "id % 2 AS src")
    base = thermal.robust_baseline(pixels, ["site"], "band", "v", "src", validated_by="x", scope="y")
    got = thermal.anomaly_scores(pixels, base, ["cell"], ["site"], "band", "v")
    assert base.first()["status"] == "refused" and got.where("score IS NULL").count() == 40
    assert got.where("ratio = double('infinity')").first()["cell"] == 7


def test_range_around_one_temperature_stays(spark):
    from fieldspark.operators import thermal
    cells = spark.range(9).selectExpr("1 AS survey_id", "50D AS v")
    r = thermal.display_range(cells, ["survey_id"], "v", "percentile").first()
    assert (r["range_min"], r["range_max"], r["low"], r["high"], r["below"], r["above"]) == (49.5, 50.5, 50.0, 50.0, 0, 0)


def test_control_points_are_read_in_splits(spark, folder):
    """Quoted breaks across splits, a byte order mark, blank lines and Windows line ends; no file is one task's."""
    rows = [f'"P\n{i}, ""q"""\t{i}.5\t{i + 1}\t{i + 2}\t32617' if i % 3 else f"\t{i}.5\t{i + 1}\t{i + 2}\t32617" for i in range(1, 400)]
    text = "﻿" + "\r\n".join(["Label,Easting,Northing,Elevation,EPSG", "", *[r.replace("\t", ",") for r in rows]]) + "\r\n"
    with open(f"{folder}/points.csv", "w", newline="") as f:
        f.write(text)
    from fieldspark.sources import readers
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512b")
    spark.sparkContext.setJobGroup("splits", "splits")
    try:
        got = {r["row_no"]: (r["name"], r["x"], r["z"]) for r in readers.read_control_points(spark, folder).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.sparkContext.setJobGroup("tests", "tests")
    assert got == {i + 1: (f'P\n{i}, "q"' if i % 3 else f"GCP{i + 1:03d}", i + 0.5, i + 2.0) for i in range(1, 400)}
    track = spark.sparkContext.statusTracker()
    stages = [s for j in track.getJobIdsForGroup("splits") for s in track.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in map(track.getStageInfo, stages) if s) > 8


def test_small_groups_are_scanned_after_one_shuffle(spark):
    """Groups below the bound give what the rounds give, and do so without a checkpoint per round."""
    from fieldspark.operators import components, matching
    rows = spark.range(600).selectExpr("id % 40 AS g", "id AS seq", "CASE WHEN id % 17 = 0 THEN NULL ELSE 10 + (id * 7919 % 101) / 5e6 END AS lon", "50 + (id * 31 % 89) / 5e6 AS lat",
                                       "CASE WHEN id % 13 = 0 THEN NULL ELSE CAST(id % 5 AS DOUBLE) END AS p")
    near = lambda n: {tuple(r) for r in matching.suppress_nearby(rows, ["g"], 1.0, priority="p", seq="seq", group_rows=n).select("seq", "kept", "kept_by").collect()}
    group = lambda n: {tuple(r) for r in components.cluster_points(rows, ["g"], "seq", 0.5, group_rows=n).select("seq", "cluster").collect()}
    assert near(700) == near(0) and group(700) == group(0) and 1 < len({c for _, c in group(700)}) < 600
    plan = matching.suppress_nearby(rows, ["g"], 1.0, priority="p", seq="seq")._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan


def test_a_sweep_gets_tasks_by_its_rows(spark, monkeypatch):
    """A task sorts a bounded number of rows of a time line, however many there are."""
    from fieldspark.operators import asof
    monkeypatch.setattr(asof, "ROWS_A_TASK", 100, raising=False)
    ref = spark.range(1_000).selectExpr("id % 7 AS bundle_id", "CAST(id * 1000 AS DOUBLE) AS t_ms", "id AS seq")
    out = asof.nearest(ref, ref.selectExpr("bundle_id", "t_ms + 10 AS t_ms", "seq", "seq AS v"), ["bundle_id"], ["v"], 50.0)
    assert out.rdd.getNumPartitions() == 21
    assert out.where("near_v = seq AND near_delta = 10").count() == 1_000


def test_turns_of_a_stream_are_written_by_several_tasks(spark):
    """A turn has several files, and a micro-batch is still one turn."""
    from fieldspark.plans import streams
    from fieldspark.streaming import flows
    t = streams.live_in_turns(spark, SMALL, "telemetry", rows_a_file=50)
    out = streams.finish(t.select("seq", F.unix_micros("ts").alias("us"), F.input_file_name().alias("file")), "turns", "append")
    got = out.groupBy("batch_id").agg(F.min("us").alias("a"), F.max("us").alias("b"), F.countDistinct("file").alias("files")).orderBy("batch_id").collect()
    assert len(got) == 3 and all(r["files"] > 1 for r in got) and got[0]["b"] < got[1]["a"] and got[1]["b"] < got[2]["a"]


def test_tracks_are_dealt_and_listed_by_cores(spark, folder):
    """Small documents are not merged into one task, and their folders are not listed in a task each."""
    import glob
    from fieldspark.plans.adapters import view
    from fieldspark.session import listing
    from fieldspark.sources import writers
    writers.write_track(view(spark, SMALL, "telemetry").withColumn("altitude_abs_m", F.col("altitude_rel_m")), folder + "/gpx", "gpx")
    tasks = {f.rsplit("part-", 1)[1][:5] for f in glob.glob(folder + "/gpx/*/part-*")}
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    with listing(spark):
        assert int(spark.conf.get(name)) == 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(name) == before


def test_deliveries_of_a_name_lie_together(spark):
    """Events are spread by their id and sorted by name, so subscribers repeat in a file; no side passes through the driver."""
    from pyspark.sql import Window as W

    from fieldspark.plans import fleets
    from fieldspark.plans.adapters import view
    from fieldspark.streaming import flows
    out = entry.queries()["route_subscriptions"](spark, SMALL)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    named = out.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}).join(view(spark, SMALL, "org_events").select("event_id", "org_id", "event"), "event_id")
    turns = named.withColumn("new", F.struct("org_id", "event") != F.lag(F.struct("org_id", "event")).over(W.partitionBy("part").orderBy("at")))
    assert turns.groupBy("part").agg(F.count_if("new").alias("n"), F.countDistinct("org_id", "event").alias("names")).where("n >= names").isEmpty()
    plain = flows.route(view(spark, SMALL, "org_events"), fleets.webhooks(spark, SMALL)).select("event_id", "webhook_id")
    assert out.exceptAll(plain).isEmpty() and plain.exceptAll(out).isEmpty() and out.count() > 0
