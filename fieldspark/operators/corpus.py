"""Corpus manifests: gates, licence filter, leakage-safe splits, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldspark.functions.rules import Refused, Rule, check
from fieldspark.functions.splits import split_sha256
from fieldspark.operators.ordered import join_side, with_row_number

# Fixed values that decide the results.
DEFAULT_SPLITS = {"train": 0.70, "val": 0.15, "test": 0.15}
MIN_PER_CLASS, MIN_VALIDATION_PER_CLASS, IMBALANCE = 10, 3, 10


def union_sources(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Several manifests with the same semantic schema text; a different one refuses the lot."""
    if not sources:
        raise Refused("at least one source manifest is required")
    if len({schema for schema, _ in sources}) != 1:
        raise Refused("the source manifests use different semantic schemas")
    out = sources[0][1]
    for _, df in sources[1:]:
        out = out.unionByName(df)
    return out


def duplicate_ids(samples: DataFrame, key: str = "id") -> DataFrame:
    return samples.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def validate_samples(samples: DataFrame, allowed: list[str]) -> DataFrame:
    """Identity, licence and date rules; a licence outside the list excludes, it does not refuse."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    date = F.to_date(F.try_to_timestamp("capture_date", F.lit("yyyy-MM-dd"))) if "capture_date" in samples.columns else None
    rules = [Rule("id", blank("id"), "every sample needs a stable id"), Rule("origin", blank("source") | blank("site_id") | blank("license"), "source, site and licence are required")]
    if date is not None:
        rules.append(Rule("date", blank("capture_date") & blank("capture_date_unknown_reason"), "a capture date or the reason it is unknown is required"))
        rules.append(Rule("date_format", ~blank("capture_date") & date.isNull(), "the capture date must be YYYY-MM-DD"))
    out = check(samples, rules)
    return out.withColumn("excluded", F.when(~F.col("license").isin(allowed), "license_not_allowed"))


def assign_groups(samples: DataFrame, salt: str, pinned: list[str] = (), native: str | None = None) -> DataFrame:
    """One split per ``source::site``; a native split, where present, is kept."""
    out = samples.withColumn("group", F.concat_ws("::", "source", "site_id"))
    split = split_sha256(salt, "group", list(pinned))
    return out.withColumn("split", F.coalesce(F.col(native), split) if native else split)


def corpus_counts(samples: DataFrame) -> DataFrame:
    """Samples and distinct sites of each split."""
    g = samples.groupBy("split", "group").agg(F.count(F.lit(1)).alias("_n"))
    return g.groupBy("split").agg(F.sum("_n").alias("samples"), F.count(F.lit(1)).alias("sites"))


def class_sample_counts(samples: DataFrame, schema_ids: list[int]) -> DataFrame:
    """Samples that declare each class of the schema; absent classes appear with 0."""
    spark = samples.sparkSession
    n = samples.select(F.explode(F.array_distinct("class_ids")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("samples"))
    schema = spark.range(1).select(F.explode(F.array(*[F.lit(i) for i in schema_ids])).alias("class_id"))
    return schema.join(n, "class_id", "left").na.fill(0, ["samples"]).withColumn("uncovered", F.col("samples") == 0)


def class_pixel_counts(samples: DataFrame) -> DataFrame:
    return samples.select(F.explode("class_pixel_counts").alias("class_id", "n")).groupBy("class_id").agg(F.sum("n").alias("pixels"))


def exclusions(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("excluded").isNotNull()).groupBy("license", F.col("excluded").alias("reason")).agg(F.count(F.lit(1)).alias("samples"))


def pinned_counts(samples: DataFrame, pinned: list[str]) -> DataFrame:
    """Samples each pinned group caught, 0 for a pin that matched nothing."""
    want = samples.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p) for p in pinned])).alias("group"))
    n = samples.where(F.col("group").isin(list(pinned))).groupBy("group").agg(F.count(F.lit(1)).alias("samples"))
    return want.join(n, "group", "left").na.fill(0, ["samples"])


def corpus_check(samples: DataFrame, holdouts: dict[str, Column]) -> DataFrame:
    """One row: samples without ground distance, its range, and hold-outs found outside the test split."""
    aggs = [F.count(F.lit(1)).alias("samples"), F.count_if(F.coalesce(F.col("gsd_m"), F.lit(0.0)) == 0).alias("missing_gsd"), F.min(F.nullif("gsd_m", F.lit(0.0))).alias("gsd_min"), F.max("gsd_m").alias("gsd_max")]
    for name, match in holdouts.items():
        aggs += [F.count_if(match).alias(f"{name}_samples"), F.count_if(match & (F.col("split") != "test")).alias(f"{name}_leaked")]
    out = samples.agg(*aggs)
    bad = (F.col("samples") == 0) | (F.col("missing_gsd") > 0)
    for name in holdouts:
        bad = bad | (F.col(f"{name}_leaked") > 0)
    return out.withColumn("status", F.when(bad, "refused").otherwise("ok"))


def deduplicate(samples: DataFrame, digest: str, label: str, seq: str) -> DataFrame:
    """First sample of each digest; a digest under two labels is refused. Needs no sort of a copy group."""
    cols = [c for c in samples.columns if c != digest]
    g = samples.groupBy(digest).agg(F.min_by(F.struct(*cols), seq).alias("_s"), (F.min(label) != F.max(label)).alias("_clash"), F.count(F.lit(1)).alias("copies"))
    out = g.select(digest, *[F.col(f"_s.{c}").alias(c) for c in cols], "copies", "_clash")
    return (out.withColumn("status", F.when(F.coalesce("_clash", F.lit(False)), "refused").otherwise("ok"))
            .withColumn("reason", F.when(F.col("status") == "refused", "one image carries two labels")).drop("_clash"))


def stratified_split(samples: DataFrame, digest: str, label: str, salt: str, ratios: dict[str, float] = DEFAULT_SPLITS) -> DataFrame:
    """Split inside each class by largest remainder, ordered by sha1(salt/digest).

    The hash order is chunked by its leading digits, so a dominant class spreads over 4096 chunks.
    """
    total = float(sum(ratios.values()))
    if total <= 0:
        raise Refused("split ratios must sum to more than zero")
    names = list(ratios)
    keyed = samples.withColumn("_h", F.sha1(F.concat(F.lit(salt + "/"), F.col(digest).cast("string"))))
    n = samples.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    exact = [F.col("_n") * F.lit(ratios[x] / total) for x in names]
    base = [F.floor(e) for e in exact]
    spare = F.col("_n") - sum(base[1:], base[0])
    frac = F.array(*[F.struct((-(e - b)).alias("f"), F.lit(i).alias("i")) for i, (e, b) in enumerate(zip(exact, base))])
    order = F.transform(F.array_sort(frac), lambda s: s["i"])
    takes, start = [], F.lit(0)
    for i in range(len(names)):
        takes.append(base[i] + F.when(F.array_position(F.col("_order"), F.lit(i)) <= F.col("_spare"), 1).otherwise(0))
    plan = n.withColumn("_order", order).withColumn("_spare", spare)
    edges = plan.select(label, *[sum(takes[1:i + 1], takes[0]).alias(f"_e{i}") for i in range(len(names))])
    pos = join_side(with_row_number(keyed, [label], ["_h"], [F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")], "_pos"), edges, [label])
    split = F.when(F.col("_pos") <= F.col("_e0"), names[0])
    for i in range(1, len(names)):
        split = split.when(F.col("_pos") <= F.col(f"_e{i}"), names[i])
    return pos.withColumn("split", split).drop("_h", "_pos", *[f"_e{i}" for i in range(len(names))])


def leakage_check(samples: DataFrame, digest: str, label: str) -> DataFrame:
    """Status rows of a labelled split: digests in two splits, thin classes, too few validation examples, balance."""
    leaked = samples.groupBy(digest).agg((F.min("split") != F.max("split")).alias("_l")).agg(F.count_if("_l").alias("v"))
    per = samples.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "val").alias("val"))
    c = per.agg(F.count(F.lit(1)).alias("classes"), F.count_if(F.col("n") < MIN_PER_CLASS).alias("thin"), F.count_if(F.col("val") < MIN_VALIDATION_PER_CLASS).alias("unmeasurable"),
                (F.max("n") >= IMBALANCE * F.min("n")).alias("imbalanced"))
    row = F.array(
        F.struct(F.lit("classes").alias("check"), F.when(F.col("classes") < 2, "refused").otherwise("ok").alias("status"), F.col("classes").alias("value")),
        F.struct(F.lit("thin_classes").alias("check"), F.when(F.col("thin") > 0, "refused").otherwise("ok").alias("status"), F.col("thin").alias("value")),
        F.struct(F.lit("validation").alias("check"), F.when(F.col("unmeasurable") > 0, "refused").otherwise("ok").alias("status"), F.col("unmeasurable").alias("value")),
        F.struct(F.lit("balance").alias("check"), F.when(F.col("imbalanced"), "warning").otherwise("ok").alias("status"), F.col("imbalanced").cast("bigint").alias("value")))
    rows = c.select(F.explode(row).alias("_r")).select("_r.*")
    return rows.unionByName(leaked.select(F.lit("leakage").alias("check"), F.when(F.col("v") > 0, "refused").otherwise("ok").alias("status"), F.col("v").alias("value")))


def pair_labels(images: DataFrame, labels: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Images with their label, and images without one."""
    return images.join(labels, key), images.join(labels, key, "left_anti")


def merged_class_ids(classes: DataFrame, name: str) -> DataFrame:
    """Ids of the merged class list: rank in name order. A class list is a vocabulary, not data."""
    from pyspark.sql import Window as W
    return classes.select(name).distinct().withColumn("class_id", F.row_number().over(W.orderBy(name)) - 1)
