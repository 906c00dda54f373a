"""Chunked windows equal plain windows, whatever the chunk width."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from fieldspark.operators import ordered as o


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [("hot" if i % 3 else f"k{i % 7}", rng.randrange(1000), i, rng.choice([None, rng.random()])) for i in range(900)]
    return spark.createDataFrame(data, "k string, t long, seq long, v double").cache()


@pytest.mark.parametrize("width", [1, 37, 1e9])
def test_previous_and_row_number(rows, width):
    chunk = [o.block("t", width)]
    w = W.partitionBy("k").orderBy("t", "seq")
    want = rows.withColumn("p", F.lag("seq").over(w)).withColumn("n", F.row_number().over(w)).select("seq", "p", "n").collect()
    got = o.with_row_number(o.with_previous(rows, ["k"], ["t", "seq"], ["seq"], chunk), ["k"], ["t", "seq"], chunk, "n").select("seq", F.col("prev_seq").alias("p"), "n").collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, got))


@pytest.mark.parametrize("width", [1, 50])
def test_carry(rows, width):
    w = W.partitionBy("k").orderBy("t", "seq")
    up, on = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    want = rows.select("seq", F.last("v", True).over(up).alias("b"), F.first("v", True).over(on).alias("f"), F.count("v").over(up).alias("c")).collect()
    got = o.carry(rows, ["k"], ["t", "seq"], [o.block("t", width)], {"b": "v"}, {"f": "v"}, {"c": "v"}).select("seq", "b", "f", "c").collect()
    assert sorted(want, key=str) == sorted(got, key=str)


def test_quantiles_are_exact(rows):
    got = {r["k"]: r for r in o.quantiles(rows, ["k"], "t", {"a": 0.0, "m": 0.5, "p": 0.9, "z": 1.0}).collect()}
    upper = {r["k"]: r["u"] for r in o.quantiles(rows, ["k"], "t", {"u": 0.5}, kind="upper").collect()}
    by = {}
    for r in rows.collect():
        by.setdefault(r["k"], []).append(r["t"])
    for k, v in by.items():
        assert np.allclose([got[k][c] for c in "ampz"], np.percentile(v, [0, 50, 90, 100]))
        assert upper[k] == sorted(v)[len(v) // 2]


@pytest.mark.parametrize("margin", [5e-4, 0.0, 0.2])
def test_quantiles_of_a_large_group(spark, margin):
    """Far and repeated values, infinities, NaN; without a margin the splitters may miss the rank."""
    df = spark.range(300_000).selectExpr("'k' AS k", "CASE WHEN id = 7 THEN 1e300D WHEN id = 8 THEN -1e300D WHEN id < 4 THEN DOUBLE('Infinity') WHEN id % 3 = 0 THEN 5.0D "
                                         "WHEN id = 10 THEN DOUBLE('NaN') WHEN id = 11 THEN NULL ELSE (id * 7919 % 100003) / 1000.0D END AS v", "CAST(id % 11 AS DOUBLE) AS w")
    v = np.array([r["v"] for r in df.where("v IS NOT NULL").select("v").collect()])
    v = v[~np.isnan(v)]
    w = np.arange(300_000) % 11
    got = o.quantiles_of(df, ["k"], {"a": ("v", 0.0), "b": ("v", 0.008), "m": ("v", 0.5), "q": ("v", 0.995), "z": ("v", 1.0), "wm": ("w", 0.25)}, margin=margin).first()
    assert [got[c] for c in "abmqz"] == pytest.approx([*np.percentile(v[np.isfinite(v)], [0]), *np.percentile(v, [0.8, 50, 99.5]), np.inf])
    assert got["wm"] == np.percentile(w, 25)
    upper = o.quantiles(df, ["k"], "v", {"u": 0.3}, kind="upper", margin=margin).first()["u"]
    assert upper == np.sort(v)[int(len(v) * 0.3)]


def test_quantiles_of_missing_values(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", float("nan"), 3.0), ("b", None, None), ("c", 2.0, None)], "k string, v double, w double")
    got = {r["k"]: (r["m"], r["n"]) for r in o.quantiles_of(df, ["k"], {"m": ("v", 0.5), "n": ("w", 0.5)}).collect()}
    assert got == {"a": (None, 2.0), "c": (2.0, None)}
    assert o.quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


def test_quantiles_of_one_value(spark):
    df = spark.createDataFrame([("a", 2.0)] * 5 + [("b", 1.0)], "k string, v double")
    assert {tuple(r) for r in o.quantiles(df, ["k"], "v", {"m": 0.5}).collect()} == {("a", 2.0), ("b", 1.0)}


def test_top_mean(spark):
    rng = random.Random(1)
    data = [("x", round(rng.random(), 2)) for _ in range(237)] + [("y", 0.5)]
    df = spark.createDataFrame(data, "k string, s double")
    got = {r["k"]: r["m"] for r in o.top_mean(df, ["k"], "s", F.greatest(F.lit(1), F.floor(F.col("n") / 10)), "m").collect()}
    assert got["x"] == pytest.approx(statistics.mean(sorted((s for k, s in data if k == "x"), reverse=True)[:23]))
    assert got["y"] == 0.5
