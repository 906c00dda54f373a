"""Corpus manifests, splits and label tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import splits
from fieldspark.operators import corpus
from fieldspark.plans.adapters import cte, table, view
from fieldspark.plans.registry import query
from fieldspark.sources import readers

SAM = cte("samples")
POS1 = "CAST(('0x' || substr(sha1('{salt}/' || CAST(id AS VARCHAR)), 1, 8)) AS BIGINT)::DOUBLE / 4294967295"
POS2 = "CAST(('0x' || substr(sha256('{salt}' || chr(0) || grp), 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616.0"
ALLOWED = ["CC BY 4.0", "CC BY-SA 4.0"]


def samples(spark, sf):
    s = view(spark, sf, "samples")
    return s.withColumn("capture_date", F.when(F.col("id") % 10 == 0, F.lit("")).otherwise(F.lit("2024-05-01"))).withColumn("capture_date_unknown_reason", F.when(F.col("id") % 20 == 0, F.lit("lost")))


@query("split_sha1", SAM + f", p AS (SELECT id, {POS1.format(salt='fs')} AS p FROM samples) SELECT id, CASE WHEN p < 0.10 THEN 'test' WHEN p < 0.25 THEN 'val' ELSE 'train' END AS split FROM p")
def split_sha1(spark, sf):
    return view(spark, sf, "samples").select("id", splits.split_sha1("fs", "id").alias("split"))


@query("split_sha256", SAM + f", g AS (SELECT id, source || '::' || site_id AS grp FROM samples), p AS (SELECT id, grp, {POS2.format(salt='fs')} AS p FROM g) SELECT id, grp, CASE WHEN grp = 'src1::en' THEN 'test' WHEN p < 0.70 THEN 'train' WHEN p < 0.85 THEN 'validation' ELSE 'test' END AS split FROM p")
def split_sha256(spark, sf):
    return corpus.assign_groups(view(spark, sf, "samples"), "fs", pinned=["src1::en"]).select("id", F.col("group").alias("grp"), "split")


@query("split_mod", SAM + """, h AS (SELECT id, sha1('fs/' || CAST(id AS VARCHAR)) AS h FROM samples),
m AS (SELECT id, list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 40), lambda i: strpos('0123456789abcdef', substr(h, i + 1, 1))::BIGINT - 1)), lambda a, d: (a * 16 + d) % 10000) AS p FROM h)
SELECT id, CASE WHEN p < 7000 THEN 'train' WHEN p < 8500 THEN 'val' ELSE 'test' END AS split FROM m""")
def split_mod(spark, sf):
    return view(spark, sf, "samples").select("id", splits.split_mod("fs", "id", {"train": 70, "val": 15, "test": 15}).alias("split"))


@query("validate_samples", SAM + """SELECT id, CASE WHEN id % 10 = 0 AND id % 20 <> 0 THEN 'refused' ELSE 'ok' END AS status, CASE WHEN license = 'CC BY-NC-SA 4.0' THEN 'license_not_allowed' END AS excluded FROM samples""")
def validate_samples(spark, sf):
    return corpus.validate_samples(samples(spark, sf), ALLOWED).select("id", "status", "excluded")


@query("corpus_counts", SAM + f", g AS (SELECT id, source || '::' || site_id AS grp FROM samples WHERE license <> 'CC BY-NC-SA 4.0'), p AS (SELECT grp, {POS2.format(salt='fs')} AS p FROM g) SELECT CASE WHEN p < 0.70 THEN 'train' WHEN p < 0.85 THEN 'validation' ELSE 'test' END AS split, CAST(count(*) AS BIGINT) AS samples, CAST(count(DISTINCT grp) AS BIGINT) AS sites FROM p GROUP BY 1")
def corpus_counts(spark, sf):
    s = corpus.validate_samples(samples(spark, sf), ALLOWED).where("excluded IS NULL")
    return corpus.corpus_counts(corpus.assign_groups(s, "fs"))


@query("corpus_exclusions", SAM + "SELECT license, 'license_not_allowed' AS reason, CAST(count(*) AS BIGINT) AS samples FROM samples WHERE license = 'CC BY-NC-SA 4.0' GROUP BY 1")
def corpus_exclusions(spark, sf):
    return corpus.exclusions(corpus.validate_samples(samples(spark, sf), ALLOWED))


@query("class_sample_counts", SAM + "SELECT c AS class_id, CAST(count(s.id) AS BIGINT) AS samples, CAST(count(s.id) = 0 AS INT) AS uncovered FROM (VALUES (0), (1), (2), (3), (4), (9)) v(c) LEFT JOIN samples s ON s.label = c OR s.n_chars % 5 = c GROUP BY 1")
def class_sample_counts(spark, sf):
    s = view(spark, sf, "samples").withColumn("class_ids", F.array("label", (F.col("n_chars") % 5).cast("int")))
    return corpus.class_sample_counts(s, [0, 1, 2, 3, 4, 9]).withColumn("uncovered", F.col("uncovered").cast("int"))


@query("class_pixel_counts", SAM + "SELECT label AS class_id, CAST(sum(n_chars) AS BIGINT) AS pixels FROM samples GROUP BY 1")
def class_pixel_counts(spark, sf):
    return corpus.class_pixel_counts(view(spark, sf, "samples").withColumn("class_pixel_counts", F.create_map("label", "n_chars")))


@query("pinned_counts", SAM + "SELECT v.g AS \"group\", CAST(count(s.id) AS BIGINT) AS samples FROM (VALUES ('src1::en'), ('nowhere::x')) v(g) LEFT JOIN samples s ON s.source || '::' || s.site_id = v.g GROUP BY 1")
def pinned_counts(spark, sf):
    return corpus.pinned_counts(corpus.assign_groups(view(spark, sf, "samples"), "fs"), ["src1::en", "nowhere::x"])


@query("corpus_check", SAM + f", g AS (SELECT *, source || '::' || site_id AS grp, CASE WHEN id % 50 = 0 THEN 0 ELSE (1 + id % 7) / 10.0 END AS gsd FROM samples), p AS (SELECT *, {POS2.format(salt='fs')} AS p FROM g) SELECT CAST(count(*) AS BIGINT) AS samples, CAST(count(*) FILTER (WHERE gsd = 0) AS BIGINT) AS missing_gsd, min(gsd) FILTER (WHERE gsd > 0)::DOUBLE AS gsd_min, max(gsd)::DOUBLE AS gsd_max, CAST(count(*) FILTER (WHERE source = 'src2') AS BIGINT) AS hold_samples, CAST(count(*) FILTER (WHERE source = 'src2' AND p < 0.85) AS BIGINT) AS hold_leaked, 'refused' AS status FROM p")
def corpus_check(spark, sf):
    s = corpus.assign_groups(view(spark, sf, "samples"), "fs").withColumn("gsd_m", F.when(F.col("id") % 50 == 0, 0.0).otherwise((1 + F.col("id") % 7) / 10.0))
    return corpus.corpus_check(s, {"hold": F.col("source") == "src2"})


@query("duplicate_ids", "SELECT text AS id, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return corpus.duplicate_ids(table(spark, sf, "documents").select(F.col("text").alias("id")))


@query("deduplicate", SAM + """, g AS (SELECT sha1(content) AS digest, min(id) AS id, count(*) AS copies, min(label) <> max(label) AS clash FROM samples GROUP BY 1)
SELECT digest, id, CAST(copies AS BIGINT) AS copies, CASE WHEN clash THEN 'refused' ELSE 'ok' END AS status FROM g""")
def deduplicate(spark, sf):
    s = view(spark, sf, "samples").withColumn("digest", F.sha1("content")).select("digest", "id", "label")
    return corpus.deduplicate(s, "digest", "label", "id").select("digest", "id", "copies", "status")


STRAT = SAM + """, g AS (SELECT sha1(content) AS digest, arg_min(label, id) AS label, min(id) AS id FROM samples GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha1('fs/' || digest)) AS pos, count(*) OVER (PARTITION BY label) AS n FROM g),
c AS (SELECT DISTINCT label, n FROM o), e AS (SELECT label, n, unnest([{'s': 'train', 'i': 0, 'x': n * 0.7::DOUBLE}, {'s': 'val', 'i': 1, 'x': n * 0.15::DOUBLE}, {'s': 'test', 'i': 2, 'x': n * 0.15::DOUBLE}]) AS u FROM c),
f AS (SELECT label, n, u.s, u.i, floor(u.x) AS base, row_number() OVER (PARTITION BY label ORDER BY -(u.x - floor(u.x)), u.i) AS k, n - sum(floor(u.x)) OVER (PARTITION BY label) AS spare FROM e),
t AS (SELECT label, s, i, base + CASE WHEN k <= spare THEN 1 ELSE 0 END AS take FROM f), b AS (SELECT label, s, sum(take) OVER (PARTITION BY label ORDER BY i) AS hi, sum(take) OVER (PARTITION BY label ORDER BY i) - take AS lo FROM t),
sp AS (SELECT o.id, o.digest, o.label, b.s AS split FROM o JOIN b ON b.label = o.label AND o.pos > b.lo AND o.pos <= b.hi)"""


def stratified(spark, sf):
    s = view(spark, sf, "samples").withColumn("digest", F.sha1("content")).select("digest", "id", "label")
    d = s.groupBy("digest").agg(F.min_by("label", "id").alias("label"), F.min("id").alias("id"))
    return corpus.stratified_split(d, "digest", "label", "fs")


@query("stratified_split", STRAT + " SELECT id, split FROM sp")
def stratified_split(spark, sf):
    return stratified(spark, sf).select("id", "split")


@query("leakage_check", STRAT + """, p AS (SELECT label, count(*) AS n, count(*) FILTER (WHERE split = 'val') AS v FROM sp GROUP BY 1), q AS (SELECT count(*) AS c, count(*) FILTER (WHERE n < 10) AS thin, count(*) FILTER (WHERE v < 3) AS un, max(n) >= 10 * min(n) AS im FROM p)
SELECT 'classes' AS "check", CASE WHEN c < 2 THEN 'refused' ELSE 'ok' END AS status, CAST(c AS BIGINT) AS value FROM q UNION ALL SELECT 'thin_classes', CASE WHEN thin > 0 THEN 'refused' ELSE 'ok' END, thin FROM q
UNION ALL SELECT 'validation', CASE WHEN un > 0 THEN 'refused' ELSE 'ok' END, un FROM q UNION ALL SELECT 'balance', CASE WHEN im THEN 'warning' ELSE 'ok' END, CAST(im AS BIGINT) FROM q UNION ALL SELECT 'leakage', 'ok', 0""")
def leakage_check(spark, sf):
    return corpus.leakage_check(stratified(spark, sf), "digest", "label")


@query("pair_labels", "SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'paired' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)")
def pair_labels(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    both, lone = corpus.pair_labels(d, table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id")
    return both.withColumn("state", F.lit("paired")).unionByName(lone.withColumn("state", F.lit("missing")))


@query("union_sources", "SELECT lang, CAST(count(*) AS BIGINT) AS samples FROM (SELECT lang FROM documents UNION ALL SELECT 'bench' FROM benchmark) GROUP BY 1")
def union_sources(spark, sf):
    a = table(spark, sf, "documents").select("lang", F.col("text"))
    b = table(spark, sf, "benchmark").select(F.lit("bench").alias("lang"), "text")
    return corpus.union_sources([("v1", a), ("v1", b)]).groupBy("lang").agg(F.count(F.lit(1)).alias("samples"))


@query("merged_class_ids", "WITH n AS (SELECT DISTINCT p_type FROM part) SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) - 1 AS INT) AS class_id FROM n")
def merged_class_ids(spark, sf):
    return corpus.merged_class_ids(table(spark, sf, "part"), "p_type")


@query("index_tiles", """SELECT 'data/' || CASE page_id % 3 WHEN 0 THEN 'accra' WHEN 1 THEN 'x' ELSE 'lima' END || '/images/' || CASE page_id % 4 WHEN 0 THEN 'abancay_' WHEN 1 THEN 'aba' WHEN 2 THEN 'chiclayo' ELSE 'aba_' END || CAST(page_id AS VARCHAR) || '.tif' AS path,
CASE page_id % 3 WHEN 0 THEN 'Accra' WHEN 2 THEN 'Lima' ELSE CASE page_id % 4 WHEN 0 THEN 'Abancay' WHEN 2 THEN NULL ELSE 'Aba' END END AS region,
CASE WHEN page_id % 3 = 1 AND page_id % 4 = 2 THEN 'unknown_region' WHEN page_id % 5 = 0 THEN 'missing_label' ELSE 'ok' END AS status FROM pages""")
def index_tiles(spark, sf):
    p = table(spark, sf, "pages")
    img = F.expr("'data/' || CASE page_id % 3 WHEN 0 THEN 'accra' WHEN 1 THEN 'x' ELSE 'lima' END || '/images/' || CASE page_id % 4 WHEN 0 THEN 'abancay_' WHEN 1 THEN 'aba' WHEN 2 THEN 'chiclayo' ELSE 'aba_' END || CAST(page_id AS STRING) || '.tif'")
    files = p.select(img.alias("path")).unionByName(p.select(F.regexp_replace(F.regexp_replace(img, "/images/", F.when(F.col("page_id") % 5 == 0, F.lit("/old_labels/")).otherwise(F.lit("/labels/"))), "\\.tif$", ".png").alias("path")))
    regions = spark.createDataFrame([("Accra", "Accra", "a"), ("Lima", "Lima", "b"), ("Abancay", "Abancay", "c"), ("Aba", "Aba", "d")], "alias string, region string, license string")
    return readers.index_tiles(files, regions).select("path", "region", "status")


@query("label_pixel_counts", cte("cells") + "SELECT survey_id AS sample_id, string_agg(CAST(k AS VARCHAR) || ':' || CAST(n AS VARCHAR), ',' ORDER BY k) AS counts FROM (SELECT survey_id, CASE class_id WHEN 1 THEN 7 WHEN 2 THEN 8 ELSE 255 END AS k, count(*) AS n FROM cells GROUP BY 1, 2) GROUP BY 1")
def label_pixel_counts(spark, sf):
    c = view(spark, sf, "cells").select(F.col("survey_id").alias("sample_id"), "class_id")
    d = readers.label_pixel_counts(c, {1: 7, 2: 8})
    text = F.array_join(F.transform(F.array_sort(F.map_entries("class_pixel_counts")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return d.select("sample_id", text.alias("counts"))
